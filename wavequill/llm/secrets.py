"""Secret scans: an incremental ledger of blobs. A text is scanned once for each rule version, whatever paths hold it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import same, small, stage, text_of


@dataclass(frozen=True)
class Rule:
    """pattern's matches count if the group has at least this many characters. A new version is scanned again."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 0
    version: int = 1


#: Fixed values. The first three are the base. A run of hex digits of 16 and more, and a key of 18 and more, are the same
#: matches as those of any length that are long enough, as a run's first match takes all of it; so the pattern counts.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


def _found(texts: DataFrame, rule: Rule) -> DataFrame:
    """blob, kind, start, stop of a rule's matches: leftmost, not overlapping; code points, stop exclusive.

    Between matches lie the pieces that split() leaves, so lengths of pieces and matches add up to positions.
    """
    pattern = F.lit(rule.pattern)
    hit = texts.where(F.col("text").rlike(rule.pattern))
    whole, group = F.regexp_extract_all("text", pattern, F.lit(0)), F.regexp_extract_all("text", pattern, F.lit(rule.group))
    lists = hit.select("blob", F.arrays_zip(F.split("text", rule.pattern).alias("gap"), whole.alias("whole"), group.alias("grp")).alias("all"))
    each = lists.select("blob", F.posexplode("all").alias("i", "m")).where(F.col("m.whole").isNotNull())
    each = each.select("blob", "i", F.length("m.gap").alias("gap"), F.length("m.whole").alias("len"), F.length("m.grp").alias("grp"))
    stop = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("blob").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    placed = each.select("blob", "grp", (stop - F.col("len")).alias("start"), stop.alias("stop"))
    return placed.where(F.col("grp") >= rule.at_least).select("blob", F.lit(rule.kind).alias("kind"), "start", "stop")


#: Columns of a ledger.
LEDGER = {"blob": "string", "kind": "string", "rule_version": "int", "spans": "array<struct<start:bigint,stop:bigint>>"}


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, ledger) of versions (path, version, text).

    paths: path, version, blob, spans for each row of versions; spans: array of (start, kind's place in rules, stop, kind)
    in that order. ledger: what is known of each blob and rule version, with empty spans where nothing was found; give it to
    the next call, which scans only the pairs that it lacks. Null texts count as empty. Repeated rows get the same spans, ties
    of start are in the order of rules, empty tables give no rows. Other columns are not read.
    """
    spark = versions.sparkSession
    if ledger is None:
        ledger = spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in LEDGER.items()])
    versions = versions.select("path", "version", text_of().alias("text"))
    paths = stage(versions.select("path", "version", F.sha2("text", 256).alias("blob")), "paths")
    rows = paths.groupBy("blob", "path", "version").agg(F.count("*").alias("n"))
    blobs = rows.groupBy("blob").agg(F.min(F.struct("path", "version", "n")).alias("at"))
    pairs = blobs.select("blob", "at", F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules])).alias("r"))
    unseen = pairs.select("blob", "at.*", "r.*").join(ledger.select("blob", "kind", "rule_version"), ["blob", "kind", "rule_version"], "left_anti")
    todo = stage(unseen.groupBy("blob", "path", "version", "n").agg(F.collect_set("kind").alias("kinds")), "todo")
    # One path stands for a blob: its text is fetched by path, which no hot text makes uneven.
    fetched = versions.join(todo.hint("merge"), same(versions, todo, ["path", "version"])).select(todo["blob"], "kinds", "n", "text")
    stands = fetched.where(F.sha2("text", 256) == F.col("blob"))
    hits = reduce(lambda a, r: a.withColumn(f"hit_{r.kind}", F.array_contains("kinds", r.kind) & F.col("text").rlike(r.pattern)), rules, stands).where(reduce(lambda a, b: a | b, [F.col(f"hit_{r.kind}") for r in rules]))
    # Only rows that repeat have to be brought together to keep one of them.
    texts = stage(hits.where("n = 1").unionByName(hits.where("n > 1").dropDuplicates(["blob"])), "texts")
    found = reduce(DataFrame.unionByName, [_found(texts.where(F.col(f"hit_{r.kind}")).select("blob", "text"), r) for r in rules])
    spans = found.groupBy("blob", "kind").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    now = todo.select("blob", F.explode("kinds").alias("kind")).join(spans, ["blob", "kind"], "left")
    rule_version = reduce(lambda a, r: F.when(F.col("kind") == r.kind, r.version).otherwise(a), rules, F.lit(0))
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    new = stage(now.select("blob", "kind", rule_version.alias("rule_version"), F.coalesce("spans", empty).alias("spans")), "ledger")
    known = ledger.unionByName(new)
    wanted = reduce(lambda a, b: a | b, [(F.col("kind") == r.kind) & (F.col("rule_version") == r.version) for r in rules])
    place = reduce(lambda a, x: F.when(F.col("kind") == x[1].kind, x[0]).otherwise(a), enumerate(rules), F.lit(-1))
    flat = known.where(wanted & (F.size("spans") > 0)).select("blob", "kind", place.alias("place"), F.explode("spans").alias("s"))
    per_blob = stage(flat.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), "place", F.col("s.stop").alias("stop"), "kind"))).alias("spans")), "findings")
    out = paths.join(small(per_blob, bound=100_000), "blob", "left")
    return out.select("path", "version", "blob", F.coalesce("spans", F.array().cast(per_blob.schema["spans"].dataType)).alias("spans")), known


def digest(paths: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return paths.select(F.col("path").alias("doc_id"), *[count(k) for k in BASE], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def _sql() -> str:
    quoted = lambda s: s.replace("'", "''")
    parts = []
    for i, r in enumerate(RULES):
        p = quoted(r.pattern)
        parts.append(f"""SELECT doc_id, {i} AS place, '{r.kind}' AS kind, g, w, grp FROM (
  SELECT doc_id, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}', 0) AS w, regexp_extract_all(text, '{p}', {r.group}) AS grp FROM t WHERE regexp_matches(text, '{p}'))""")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
e AS (SELECT doc_id, place, kind, unnest(range(1, len(w) + 1)) AS i, g, w, grp FROM m),
f AS (SELECT doc_id, place, kind, i, length(g[i]) AS gap, length(w[i]) AS n, length(grp[i]) AS k FROM e),
s AS (SELECT doc_id, place, kind, n, k, sum(gap + n) OVER (PARTITION BY doc_id, place ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM f),
z AS (SELECT doc_id, place, kind, stop - n AS start, kind || ':' || CAST(stop - n AS BIGINT) || ':' || CAST(stop AS BIGINT) AS x FROM s WHERE place > 0 OR k >= 12),
a AS (SELECT doc_id, count(*) FILTER (place = 0) AS n0, count(*) FILTER (place = 1) AS n1, count(*) FILTER (place = 2) AS n2,
  string_agg(x, ',' ORDER BY start, place) FILTER (place < 3) AS b, string_agg(x, ',' ORDER BY start, place) AS s FROM z GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans
FROM t LEFT JOIN a USING (doc_id)
"""


SQL = _sql()
