"""Language ID: the byte network of gru.py labels every position of a text, and its positions' probabilities are pooled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gru
from .common import small, stage
from .shingles import parts

#: Windows to learn from, about (each of a document of its own): of a language at most, and of all languages together.
PER_LANGUAGE, MAX_TRAIN = 1500, 400_000
#: The pipeline's stage rejects documents without a language, and those of which the network is less sure than this.
LEAST_SCORE = 0.4
UNKNOWN = "und"


def held_out():
    """True for a fifth of the documents, by their doc_id: these are never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(windows, classes, languages): one window each of about per_language documents a language, chosen by hash.

    Every lang value of a document with a text that isn't empty is learned; with so many that max_train is exceeded, fewer
    documents of each are. A shorter text fills its window by repeating itself.
    """
    size = F.octet_length("text")
    known = docs.select("doc_id", "text", "lang").where(~F.coalesce(held_out(), F.lit(False)) & F.col("lang").isNotNull() & (size > 0))
    counts = stage(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = sorted(r["lang"] for r in counts.select("lang").collect())
    if not languages:
        return np.zeros((0, gru.WINDOW), np.uint8), np.zeros(0, np.int64), []
    each = min(per_language, max(1, max_train // len(languages)))
    share = F.least(F.lit(1.0), each / F.col("n"))
    h = F.xxhash64("doc_id", F.lit("sample"))
    chosen = known.join(small(counts, len(languages)), "lang").where(F.pmod(h, F.lit(1 << 20)) < share * (1 << 20))
    at = F.pmod(F.shiftright(h, 20), F.greatest(size - gru.WINDOW, F.lit(0)) + 1) + 1
    raw = chosen.select("doc_id", "lang", F.substring(F.encode("text", "UTF-8"), at.cast("int"), F.lit(gru.WINDOW)).alias("w"))
    rows = sorted((str(r["doc_id"]), r["lang"], bytes(r["w"])) for r in raw.limit(2 * each * len(languages)).collect())
    full = [((w + b" ") * gru.WINDOW)[: gru.WINDOW] if len(w) < gru.WINDOW else w for _, _, w in rows]
    place = {lang: i for i, lang in enumerate(languages)}
    return np.frombuffer(b"".join(full), np.uint8).reshape(-1, gru.WINDOW), np.array([place[lang] for _, lang, _ in rows], np.int64), languages


def predict(docs: DataFrame, model: dict | None, languages: list[str], text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs' columns (that of the text only if kept) with lang_pred and score.

    und with score 0 for texts that are null or have no letter, and for all if nothing could be learned.
    """
    passed = [f for f in docs.schema.fields if f.name != text or keep_text]
    schema = T.StructType([*passed, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = [f.name for f in passed]

    def run(batches):
        import pyarrow as pa

        for batch in (p for b in batches for p in parts(b, text)):
            raw = [t.encode("utf-8", "replace") if t and any(map(str.isalpha, t)) else b"" for t in batch.column(text).to_pylist()]
            p = gru.pooled(model, raw) if model else np.zeros((len(raw), 1))
            best = p.argmax(axis=1)
            said = [languages[c] if b and model else UNKNOWN for c, b in zip(best, raw, strict=True)]
            score = np.minimum(1.0, p[np.arange(len(raw)), best])
            out = [batch.column(n) for n in names] + [pa.array(said, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang).

    The languages are the lang values learned, see sample(); see predict() for null, empty and letterless texts. A null doc_id isn't held
    out. Repeated rows get equal results, empty tables give no rows. Other columns are not read.
    """
    windows, classes, languages = sample(docs, per_language)
    model = gru.train(windows, classes, len(languages)) if languages else None
    plain = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return predict(plain, model, languages)


def accepted(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, all columns, whose text has a language of which the network is sure enough.

    Null, empty and letterless texts go, and all rows if nothing could be learned. Repeated rows stay or go together. Empty
    tables give no rows.
    """
    windows, classes, languages = sample(docs)
    model = gru.train(windows, classes, len(languages)) if languages else None
    renamed = docs.select(*[F.col(c).alias(f"in_{c}") for c in docs.columns])
    judged = predict(renamed, model, languages, "in_text", keep_text=True)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])
