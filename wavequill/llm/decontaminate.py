"""Benchmark decontamination: a prefix-filtered set join of documents with windows of benchmark items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, DELIMITER, all_of, ascii_lower, same, small, split_words, stage, text_of

#: DELIMITER before A-Z are lowered: words are counted without that.
EITHER_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words in the shingles that stand for a window in the join.
SHINGLE = 3


def _windows(benchmark: DataFrame, ngram: int) -> DataFrame:
    """item_id, wid, w (its words), size: every run of ngram words of an item, or the whole of a shorter one."""
    words = benchmark.select("item_id", split_words(ascii_lower(text_of()), DELIMITER).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(ngram))
    at = words.select("item_id", "words", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("j"))
    cut = at.select("item_id", "size", F.slice("words", F.col("j") + 1, F.col("size")).alias("w"))
    return cut.withColumn("wid", F.md5(F.concat_ws(" ", "w"))).distinct()


def _shingle(words: str, at, k: int):
    return F.xxhash64(F.lit(k), *[F.get(F.col(words), at + i) for i in range(k)])


def _shingles(windows: DataFrame) -> DataFrame:
    """wid, k, o, h: the shingles of every different window, in order. Shorter windows are one shingle."""
    one = windows.dropDuplicates(["wid"]).select("wid", "w", "size")
    parts = []
    for k in range(1, SHINGLE + 1):
        mine = one.where((F.least("size", F.lit(SHINGLE)) == k))
        at = mine.select("wid", "w", "size", F.explode(F.sequence(F.lit(0), F.col("size") - k)).alias("o"))
        parts.append(at.select("wid", F.lit(k).alias("k"), "o", _shingle("w", F.col("o"), k).alias("h")))
    return reduce(DataFrame.unionByName, parts)


def _places(docs: DataFrame, shingles: DataFrame, bound: int) -> DataFrame:
    """doc_id, th, words, pos, h: each place of one of shingles (k, h) in a document.

    The shingle table is broadcast in blocks of bound rows, so memory is bounded however large the benchmark is.
    """
    wanted = shingles.select("k", "h").distinct()
    sizes = {r["k"]: r["n"] for r in wanted.groupBy("k").agg(F.count("*").alias("n")).collect()}  # at most SHINGLE rows
    words = docs.select("doc_id", F.xxhash64("text").alias("th"), split_words(ascii_lower(text_of()), DELIMITER).alias("words"))
    parts = []
    for k, n in sorted(sizes.items()):
        # The generator's argument is an expression, not a column: Spark would else filter on it below, and split each text twice.
        at = words.select("doc_id", "th", "words", F.explode(F.when(F.size("words") >= k, F.sequence(F.lit(0), F.size("words") - k))).alias("pos"))
        rows = at.select("doc_id", "th", "words", "pos", _shingle("words", F.col("pos"), k).alias("h"))
        blocks = -(-n // bound)
        for b in range(blocks):
            mine = wanted.where(F.col("k") == k).select("h")
            mine = mine.where(F.pmod("h", F.lit(blocks)) == b) if blocks > 1 else mine
            parts.append(rows.join(F.broadcast(mine), "h").select("doc_id", "th", "words", "pos", "h"))
    if not parts:
        parts = [words.select("doc_id", "th", "words", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("h")).where(F.lit(False))]
    return reduce(DataFrame.unionByName, parts)


def occurrences(docs: DataFrame, benchmark: DataFrame, ngram: int = 10, bound: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, start, size, wid) of every occurrence of a window, and (wid, item_id).

    Containment of a whole window needs all its shingles, so its prefix is a single one: the rarest over all documents, which
    a first pass counts. A second pass joins the documents with the prefixes alone: a place of one is a candidate if the
    window fits into the document there; its words are then compared.
    """
    windows = stage(_windows(benchmark, ngram), "windows")
    shingles = stage(_shingles(windows), "shingles")
    found = stage(_places(docs, shingles, bound).groupBy("h").agg(F.count("*").alias("n_found")), "found")
    held = shingles.groupBy("wid").agg(F.count("*").alias("n_all"))
    order = shingles.join(small(found), "h").groupBy("wid").agg(F.count("*").alias("n_there"), F.min(F.struct("n_found", "h", "o", "k")).alias("rare"))
    prefix = order.join(held, "wid").where(F.col("n_there") == F.col("n_all"))
    words = windows.dropDuplicates(["wid"]).select("wid", "w", "size")
    anchors = stage(prefix.join(words, "wid").select("wid", "w", "size", F.col("rare.h").alias("h"), F.col("rare.o").alias("o"), F.col("rare.k").alias("k")), "anchors")
    places = _places(docs, anchors, bound)
    c0 = F.greatest(F.col("pos") - (ngram - 1), F.lit(0))
    hits = places.select("doc_id", "th", F.size("words").alias("n"), "pos", "h", c0.alias("c0"), F.slice("words", c0 + 1, F.col("pos") - c0 + ngram).alias("ctx"))
    start = F.col("pos") - F.col("o")
    fits = hits.join(small(anchors, bound=bound // 10), "h").where((start >= 0) & (start + F.col("size") <= F.col("n")))
    right = fits.where(F.slice("ctx", start - F.col("c0") + 1, F.col("size")) == F.col("w"))
    return right.select("doc_id", "th", start.alias("start"), "size", "wid").distinct(), windows.select("wid", "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, ngram: int = 10, bound: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, items, contaminated.

    Null and empty texts have no words and are clean. Rows that repeat get equal results each; rows with one doc_id and
    different texts are judged apart, a null doc_id like any other. Items that repeat count once, null and empty texts of items
    match nothing. An item without item_id hits words, but has no name and isn't counted: n_hit > 0 with n_items 0. Empty tables give no rows, or no hits. Other columns of either table are not read.
    """
    docs, benchmark = docs.select("doc_id", "text"), benchmark.select("item_id", "text")
    places, items = occurrences(docs, benchmark, ngram, bound)
    places = stage(places, "occurrences")
    key = ["doc_id", "th"]
    before = F.max(F.col("start") + F.col("size")).over(Window.partitionBy(*key).orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("size")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    covered = places.select(*key, "start", "size").distinct().withColumn("fresh", fresh).groupBy(*key).agg(F.sum("fresh").alias("n_hit"))
    named = places.select(*key, "wid").distinct().join(small(items), "wid").groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hit = covered.join(named, same(covered, named, key)).select(covered["doc_id"], covered["th"], "n_hit", "items")
    all_docs = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(split_words(text_of(), EITHER_CASE)).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    out = all_docs.join(hit, all_of([all_docs[c].eqNullSafe(hit[c]) for c in key]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(all_docs["doc_id"], "n_words", n_hit.alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), (n_hit > 0).alias("contaminated"))


def digest(result: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return result.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


#: DuckDB. chr(160) and up are the letters beyond ASCII: the class is the complement of the delimiters.
SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, j, j + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS j FROM b WHERE len(w) > 0)),
pos AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
occ AS (SELECT p.doc_id, p.j, p.k, win.item_id FROM (SELECT doc_id, j, k, array_to_string(list_slice(w, j, j + k - 1), ' ') AS g FROM pos) p JOIN win USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(j, j + k)) AS q FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
