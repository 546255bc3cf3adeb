"""Mixing sources to target weights: golden-ratio points choose a source for each slot, slots take shuffled equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, same, small, stage, text_of

WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MAX_EPOCHS = 3
#: Tokens of a block at most, and slots of a schedule at least (as far as there are tokens).
BLOCK, SLOTS = 4096, 65536
#: With blocks of several tokens, sources that have or get fewer blocks than this take their target by the token.
FEW = 64
#: Fixed value: the golden ratio less 1; multiples of it modulo 1 are the schedule's points.
GOLDEN = 0.6180339887498949
#: Slots in a chunk and documents in a bucket, about: ranks are counted in these and carried over between them.
CHUNK, BUCKET = 512, 2048
#: Cells of [0, 1) that points and sources are joined by.
CELLS = 4096


def _sized(docs: DataFrame) -> DataFrame:
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), key.alias("h"))


def _sources(sized: DataFrame, weights) -> DataFrame:
    """One row per source: sid, source, docs, source_size, total, target and its share [lo, hi) of the points.

    Sources that would pass MAX_EPOCHS times their size stop there. Sorted by size for weight, the first k stop for one k;
    what they leave is dealt to the rest by weight. Windows here run over one row per source.
    """
    every = Window.partitionBy()
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sid = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights) + 1)
    cap = F.col("source_size") * MAX_EPOCHS
    s = by.select("*", sid.alias("sid")).select("*", weight.alias("w"), cap.alias("cap"), F.sum("source_size").over(every).alias("total"))
    before = Window.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.select("*", (F.col("w") * left / rest > F.col("cap")).alias("stopped"))
    level = (F.col("total") - F.sum(F.when(F.col("stopped"), F.col("cap")).otherwise(0)).over(every)) / F.sum(F.when(F.col("stopped"), 0.0).otherwise(F.col("w"))).over(every)
    s = s.withColumn("target", F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(F.col("w") * level))
    s = s.withColumn("hi", F.sum("target").over(Window.orderBy("sid")) / F.nullif(F.col("total"), F.lit(0)))
    lo = F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0.0))
    return s.select("sid", "source", "docs", "source_size", "total", "target", lo.alias("lo"), "hi")


def _ranked(rows: DataFrame, group: str, chunk: str, order: list, amount, name: str) -> DataFrame:
    """rows with the sum of amount over the group's earlier rows, chunks in order first.

    Counted within chunks and carried over between them, so no task holds a whole group.
    """
    sums = rows.groupBy(group, chunk).agg(F.sum(amount).alias("_sum"))
    carry = F.sum("_sum").over(Window.partitionBy(group).orderBy(chunk)) - F.col("_sum")
    carried = sums.select(group, chunk, carry.alias("_carry"))
    within = F.sum(amount).over(Window.partitionBy(group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - amount
    return rows.withColumn(name, within).join(carried, [group, chunk]).withColumn(name, F.col(name) + F.col("_carry")).drop("_carry")


def schedule(spark, sources: DataFrame, slots: int, block: int) -> DataFrame:
    """slot, sid, epoch, block: what each slot takes. Points of the golden ratio fall into the sources' shares."""
    point = (F.col("id") * F.lit(GOLDEN)) % 1.0
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("u"), F.floor(point * CELLS).alias("cell"))
    last = F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1).cast("long"))
    cells = sources.where(F.col("hi") > F.col("lo")).select("sid", "lo", "hi", "source_size", F.explode(F.sequence(F.least(F.floor(F.col("lo") * CELLS), last), last)).alias("cell"))
    # Rounding may leave the last share ending just below 1: points there go to it as well.
    top = F.col("hi") >= 1 - 1e-9
    hit = points.join(small(cells), "cell").where((F.col("u") >= F.col("lo")) & ((F.col("u") < F.col("hi")) | top))
    dealt = hit.select("slot", "sid", "source_size", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    ranked = _ranked(dealt, "sid", "chunk", ["slot"], F.lit(1), "rank")
    blocks = F.ceil(F.col("source_size") / block)
    return ranked.select("slot", "sid", F.floor(F.col("rank") / blocks).alias("epoch"), (F.col("rank") % blocks).alias("block")).where(F.col("epoch") < MAX_EPOCHS)


def mix(docs: DataFrame, weights=WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs (doc_id, text, source).

    Each source's documents, shuffled by md5 of doc_id, lie end to end; every block of equal tokens is taken as often as
    the schedule has slots for it, so a source is passed whole before it is begun again. taken counts a document's tokens in
    the blocks, repeats included, at most MAX_EPOCHS times its size. Where blocks are of several tokens, a source of fewer
    than FEW of them (or with a target of fewer) would miss its target by whole blocks or get no slot: it takes its target
    rounded to a token, whole epochs and then the first documents of the next. Null and empty texts have size 0 and are not taken; null
    is a source like any other, the last. Rows that repeat are documents of their own. Empty tables give no rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    sized = stage(_sized(docs.select("doc_id", "text", "source")), "sized")
    sources = stage(_sources(sized, weights), "sources")
    top = sources.agg(F.max("total").alias("total"), F.sum("docs").alias("docs")).first()
    total, n_docs = top["total"] or 0, top["docs"] or 0
    block = max(1, min(BLOCK, total // SLOTS))
    digits = next(d for d in range(33) if 16**d * BUCKET >= n_docs)
    joined = sized.join(small(sources.select("sid", "source", "source_size", "target").withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = _ranked(joined.withColumn("bucket", F.substring("h", 1, digits)), "sid", "bucket", ["h", "doc_id", "size"], F.col("size"), "at")
    placed = stage(placed.select("doc_id", "source", "size", "source_size", "target", "sid", "at"), "placed")
    times = schedule(spark, sources, -(-total // block), block).groupBy("sid", "block").agg(F.count("*").alias("times"))
    few = (F.lit(block) > 1) & (F.least("source_size", "target") < FEW * block)
    due = F.least(F.round("target").cast("long"), MAX_EPOCHS * F.col("source_size"))
    whole = F.nullif(F.col("source_size"), F.lit(0))
    begun = F.greatest(F.lit(0), F.least("size", due % whole - F.col("at")))
    placed = placed.withColumn("exact", F.when(few, F.col("size") * F.floor(due / whole) + begun))
    end = F.col("at") + F.col("size")
    spans = placed.where(F.col("size") > 0).select("sid", "at", end.alias("end"), F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((end - 1) / block))).alias("block"))
    overlap = F.least("end", (F.col("block") + 1) * block) - F.greatest("at", F.col("block") * block)
    taken = spans.join(times, ["sid", "block"]).groupBy("sid", "at").agg(F.sum(overlap * F.col("times")).alias("taken"))
    took = F.when(F.col("size") == 0, 0).otherwise(F.coalesce("exact", "taken", F.lit(0))).cast("long")
    out = placed.join(taken, same(placed, taken, ["sid", "at"]), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", took.alias("taken"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB. The schedule point by point; a document's share of its source's whole and started epochs in closed form.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid, (SELECT CAST(sum(size) AS BIGINT) FROM d) AS total FROM s0),
w AS (SELECT *, CAST([5, 2, 1][sid % 3 + 1] AS DOUBLE) AS w FROM s),
fill AS (
  SELECT 0 AS step, sid, w, source_size, total, false AS stopped FROM w
  UNION ALL
  SELECT step + 1, sid, w, source_size, total, stopped OR w * (total - sum(CASE WHEN stopped THEN 3 * source_size ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN stopped THEN 0.0 ELSE w END) OVER (), 0) > 3 * source_size
  FROM fill WHERE step < 25),
t AS (
  SELECT sid, source_size, total, CASE WHEN stopped THEN CAST(3 * source_size AS DOUBLE) ELSE w * ((total - sum(CASE WHEN stopped THEN 3 * source_size ELSE 0 END) OVER ()) / sum(CASE WHEN stopped THEN 0.0 ELSE w END) OVER ()) END AS target
  FROM fill WHERE step = 25),
u AS (SELECT *, sum(target) OVER (ORDER BY sid) / total AS hi, greatest(1, least(4096, total // 65536)) AS block FROM t),
v AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY sid), 0) AS lo, CAST(ceil(source_size / block) AS BIGINT) AS blocks FROM u),
p AS (SELECT (i * CAST(0.6180339887498949 AS DOUBLE)) % 1.0 AS x FROM (SELECT unnest(range(CAST(ceil(max(total) / max(block)) AS BIGINT))) AS i FROM v)),
k AS (SELECT sid, least(count(*), 3 * any_value(blocks)) AS slots FROM p JOIN v ON x >= lo AND (x < hi OR hi >= 1 - 1e-9) GROUP BY sid),
c AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM d)
SELECT doc_id, size, v.source_size, v.target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE size * (coalesce(slots, 0) // blocks) + greatest(0, least(size, (coalesce(slots, 0) % blocks) * block - place)) END AS BIGINT) AS taken
FROM c JOIN s ON c.source IS NOT DISTINCT FROM s.source JOIN v ON s.sid = v.sid LEFT JOIN k ON k.sid = v.sid
"""
