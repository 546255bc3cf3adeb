import brute
from conftest import ROWS
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from wavequill.llm import gru, language, line_dedup
from wavequill.llm.common import table


def plain(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_stages_are_plain_python(spark, sf):
    """run() beside the same five decisions for one document after the other."""
    docs = table(spark, sf, "documents")
    model_of = language.sample(docs)
    model = gru.train(*model_of[:2], len(model_of[2]))
    kept = []
    for i, text, source in plain(docs):
        raw = (text or "").encode()
        if any(map(str.isalpha, text or "")) and gru.pooled(model, [raw]).max() >= language.LEAST_SCORE:
            kept.append((i, text, source))
    cut = brute.without_boilerplate([(s, t) for _, t, s in kept], line_dedup.RATIO)
    kept = [(i, t, s) for (i, _, s), t in zip(kept, cut, strict=True)]
    root = brute.components({i: t for i, t, _ in kept}, 5, 80)
    kept = [d for d in kept if root[d[0]] == d[0]]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    hit = brute.decontaminated([t for _, t, _ in kept], items)
    kept = [(i, s, t) for (i, t, s), (_, n, _) in zip(kept, hit, strict=True) if not n]
    want = {d[0]: m for d, m in zip(kept, brute.mixed(kept), strict=True)}
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in pipeline.run(spark, sf).collect()}
    assert set(got) == set(want) and 0 < len(got) < docs.count()
    assert all(abs(got[i][2] - want[i][2]) < 1e-6 and got[i][:2] + got[i][3:] == want[i][:2] + want[i][3:] for i in want)


def test_stages_take_odd_and_empty_tables(spark, sf, odd, none):
    """Nulls, blanks, repeated rows, a long text and further columns: each stage's result, and that of no rows."""
    sizes = {i: len(brute.words(t)) for i, t, *_ in ROWS}
    want = {
        "line dedup": [(i, t) for (i, *_), t in zip(ROWS, brute.without_boilerplate([(r[3], r[1]) for r in ROWS], line_dedup.RATIO), strict=True)],
        "near duplicates": [(r[0], r[1]) for r in ROWS[1:] if r[0] != 5],
        "decontamination": [(r[0], r[1]) for r in ROWS],
    }
    for name, stage in pipeline.STAGES:
        out = stage(spark, odd, sf)
        assert stage(spark, none, sf).count() == 0
        if name == "mixing":
            got = out.collect()
            assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r[0]), sizes[r[0]]) for r in ROWS)
            assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
        else:
            assert out.columns == pipeline.COLUMNS
            got = [(r["doc_id"], r["text"]) for r in out.collect()]
            if name == "language":
                assert not {2, 3, 4} & {i for i, _ in got} and set(got) <= {(r[0], r[1]) for r in ROWS}
            else:
                assert sorted(got, key=str) == sorted(want[name], key=str)


def test_copies_keep_one(spark, sf):
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(i, text if i < 5 else f"{text} and {i} more {i}x" if i < 8 else f"other {i} text", "en", "s", 1) for i in range(10)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in pipeline.without_near_duplicates(spark, docs, sf).collect()) == [0, 8, 9]
    assert docs.where(F.col("doc_id") < 0).count() == 0


def test_repeated_rows_keep_one(spark, sf):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "s", 1)] * 3 + [(2, text, "en", "s", 1), (3, "other words", "en", "s", 1), (3, "more words", "en", "s", 1), (4, None, "en", "s", 1), (4, None, "en", "s", 1), (6, "alone", "en", "s", 1)]
    rows += [(None, "no number", "en", "s", 1)] * 2 + [(None, "no number", "de", "s", 1), (None, None, None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r) for r in pipeline.without_near_duplicates(spark, docs, sf).collect()]
    want = [rows[0], (3, "more words", "en", "s", 1), rows[6], (6, "alone", "en", "s", 1), (None, "no number", "en", "s", 1), (None, "no number", "de", "s", 1), (None,) * 5]
    assert sorted(got, key=str) == sorted(want, key=str)
