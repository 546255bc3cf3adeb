"""Toxicity: a factorization machine over hashed terms, which also learns what pairs of terms mean together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import BY_LETTER, chunks, word_hashes
from .common import small, stage
from .language import held_out
from .shingles import parts

#: Labelled documents to learn from, about; hashed terms (bits), those that are used, documents that a used one is in at least.
MAX_TRAIN, BITS, TERMS, MIN_DOCS = 8_000, 20, 2048, 4
#: Terms are words, and their first so many bytes: words of one stem share those.
PREFIXES = (4, 5, 6)
#: Factors of a term, passes over the documents, documents of a step, step size, weight decay.
FACTORS, EPOCHS, BATCH, RATE, DECAY = 6, 10, 128, 0.03, 1e-4


def _terms(texts: list[bytes]) -> list[np.ndarray]:
    """The different hashed terms of each text."""
    out = []
    for a, b in chunks(texts):
        hashes, at = word_hashes(texts[a:b], BY_LETTER, PREFIXES)
        terms = (hashes >> np.uint64(64 - BITS)).astype(np.int32)
        out += [np.unique(terms[:, at[i] : at[i + 1]]) for i in range(b - a)]
    return out


def _raw(batch) -> list[bytes]:
    return [t.encode("utf-8", "replace") if t else b"" for t in batch.column("text").to_pylist()]


def sample(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(used terms, those of each document, labels) of about max_train labelled documents that aren't held out, chosen by hash.

    Used are the TERMS terms that tell most of the labels (chi-squared). They are chosen before anything is collected, so
    the driver gets at most TERMS numbers a document, however long the texts are.
    """
    known = labels.select("doc_id", "toxic").where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, max_train / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select("doc_id", "text").join(small(stage(chosen, "labelled"), bound=2 * max_train), "doc_id")

    def of_texts(batches):
        import pyarrow as pa

        for batch in (p for b in batches for p in parts(b)):
            terms = _terms(_raw(batch))
            ends = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *terms]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), pa.array([int(y > 0) for y in batch.column("toxic").to_pylist()], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "toxic", "terms"])

    found = stage(texts.mapInArrow(of_texts, "doc_id string, toxic int, terms array<int>"), "terms")
    n, pos = found.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < pos < n:
        return np.zeros(0, np.int32), [np.zeros(0, np.int32)] * n, np.full(n, float(pos > 0), np.float32)
    each = found.select("toxic", F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).where(F.col("n") >= MIN_DOCS)
    expected = F.col("n") * (pos / n)
    tells = F.pow(F.col("bad") - expected, F.lit(2.0)) / F.greatest(expected * (1 - pos / n) * (1 - F.col("n") / (n + 1)), F.lit(1e-9))
    used = np.sort(np.array([r["t"] for r in each.orderBy(tells.desc(), "t").limit(TERMS).select("t").collect()], np.int32))

    def of_used(batches):
        import pyarrow as pa

        for batch in batches:
            lists = [np.array(t, np.int32) for t in batch.column("terms").to_pylist()]
            kept = pa.array([t[np.isin(t, used)].tobytes() for t in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), kept], names=["doc_id", "toxic", "terms"])

    rows = found.mapInArrow(of_used, "doc_id string, toxic int, terms binary").limit(2 * max_train).collect()
    rows = sorted((r["doc_id"] or "", r["toxic"], bytes(r["terms"])) for r in rows)
    return used, [np.frombuffer(t, np.int32) for _, _, t in rows], np.array([y for _, y, _ in rows], np.float32)


def train(used: np.ndarray, terms: list[np.ndarray], y: np.ndarray, seed: int = 5) -> dict:
    """terms (the used ones, sorted), bias, weights, factors; learned from the used terms of each document and its label."""
    if not len(y) or y.min() == y.max():
        return {"terms": np.zeros(0, np.int32), "bias": 4.0 * float(y.mean() if len(y) else 0) - 2.0, "weights": np.zeros(0, np.float32), "factors": np.zeros((0, FACTORS), np.float32)}
    n, pos = len(y), float(y.sum())
    rows = [np.searchsorted(used, t) for t in terms]
    rng = np.random.default_rng(seed)
    par = {"bias": np.array([np.log(pos / (n - pos))], np.float64), "weights": np.zeros(len(used)), "factors": rng.standard_normal((len(used), FACTORS)) * 0.02}
    seen = {k: np.full_like(v, 1e-6) for k, v in par.items()}
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            mine = order[at : at + BATCH]
            x = np.zeros((len(mine), len(used)))
            for i, k in enumerate(mine):
                x[i, rows[k]] = 1
            both = x @ par["factors"]
            s = par["bias"] + x @ par["weights"] + 0.5 * ((both**2).sum(1) - x @ (par["factors"] ** 2).sum(1))
            d = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[mine]) / len(mine)
            xd = x.T @ d
            grad = {"bias": np.array([d.sum()]), "weights": xd + DECAY * par["weights"], "factors": x.T @ (d[:, None] * both) - xd[:, None] * par["factors"] + DECAY * par["factors"]}
            for k, g in grad.items():
                seen[k] += g * g
                par[k] -= RATE * g / np.sqrt(seen[k])
    return {"terms": used, "bias": float(par["bias"][0]), "weights": par["weights"].astype(np.float32), "factors": par["factors"].astype(np.float32)}


def scores(model: dict, texts: list[bytes]) -> np.ndarray:
    """Scores from 0 to 1 of whole texts."""
    slot = np.full(1 << BITS, -1, np.int32)
    slot[model["terms"]] = np.arange(len(model["terms"]))
    out = np.zeros(len(texts))
    square = (model["factors"] ** 2).sum(1)
    for a, b in chunks(texts):
        hashes, at = word_hashes(texts[a:b], BY_LETTER, PREFIXES)
        s = slot[(hashes >> np.uint64(64 - BITS)).astype(np.int32)].ravel()
        owner = np.tile(np.repeat(np.arange(b - a), np.diff(at)), 1 + len(PREFIXES))
        hit = s >= 0
        pair = np.unique(owner[hit].astype(np.int64) * max(1, len(model["terms"])) + s[hit])
        doc, term = pair // max(1, len(model["terms"])), pair % max(1, len(model["terms"]))
        add = lambda v: np.bincount(doc, weights=v, minlength=b - a)  # noqa: B023, E731
        total = model["bias"] + add(model["weights"][term] - 0.5 * square[term])
        for f in range(model["factors"].shape[1]):
            total += 0.5 * add(model["factors"][term, f]) ** 2
        out[a:b] = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
    return out


def score_documents(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); labels: doc_id, toxic.

    Learned only from rows that aren't held out; a doc_id labelled more than once counts as toxic if any label says so, null
    labels aren't learned from. Null and empty texts have no terms and get the score of the bias alone. Without labels of
    both kinds all get one score. Repeated rows get equal results, empty tables give no rows. Other columns are not read.
    """
    model = train(*sample(docs, labels, max_train))
    plain = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    schema = T.StructType([plain.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        import pyarrow as pa

        for batch in (p for b in batches for p in parts(b)):
            s = scores(model, _raw(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return plain.mapInArrow(run, schema)
