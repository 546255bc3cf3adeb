"""Line dedup by site-relative frequency: a line on more than a share of its host's pages is boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stage, text_of

#: A line is dropped from a page if more than this share of the host's pages are others that have it too.
RATIO = 0.02
#: White space around lines.
BLANKS = " \t\n\x0b\f\r"


def _trimmed(line):
    return F.trim(line, F.lit(BLANKS))


def _key(line):
    return F.unhex(F.md5(_trimmed(line)))


def boilerplate(docs: DataFrame, ratio: float = RATIO, host: str = "source") -> DataFrame:
    """site, bad: the keys of each site's boilerplate lines. A site can't have more of them than its lines a page over ratio.

    A site's pages are its different texts: copies of a page, and repeated rows, count once, and null counts as an empty text.
    A line that n of them have, of so many in total, is boilerplate if n - 1 > ratio * total: so a line of one page never is,
    and a site of one page has none. Null hosts are one site. Empty tables give no rows.
    """
    text = text_of()
    lines = F.array_distinct(F.transform(F.split(text, "\n"), _trimmed))
    page = F.xxhash64(text).alias("page")
    on_page = docs.select(F.col(host).alias("site"), page, F.explode(F.filter(lines, lambda x: x != "")).alias("line"))
    on_page = on_page.select("site", F.unhex(F.md5("line")).alias("line"), "page").distinct()
    pages = on_page.groupBy("site", "line").agg(F.count("*").alias("n")).where("n > 1")
    totals = docs.select(F.col(host).alias("_site"), page).distinct().groupBy("_site").agg(F.count("*").alias("total"))
    over = pages.join(small(totals, bound=100_000), F.col("site").eqNullSafe(F.col("_site"))).where(F.col("n") - 1 > ratio * F.col("total"))
    return over.groupBy("site").agg(F.collect_set("line").alias("bad"))


def drop_lines(docs: DataFrame, ratio: float = RATIO, host: str = "source") -> DataFrame:
    """docs with boilerplate lines taken out of text, and n_lines, n_dropped added (replacing columns of these names).

    Each row is a page; see boilerplate() for what is dropped. Lines are compared without white space around them, so those of
    pages with \\r\\n meet the others'; lines of white space alone are no lines, and stay. Null texts stay null, rows with equal
    texts and hosts lose the same lines, empty tables give no rows. All columns of docs are kept.
    """
    plain = docs.drop("n_lines", "n_dropped")
    bad = stage(boilerplate(plain, ratio, host).select(F.col("site").alias("_wq_site"), F.col("bad").alias("_wq_bad")), "boilerplate")
    joined = plain.join(small(bad, bound=10_000), F.col(host).eqNullSafe(F.col("_wq_site")), "left")
    lines = F.split(F.col("text"), "\n")
    with_words = F.size(F.filter(lines, lambda x: _trimmed(x) != ""))
    stays = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("_wq_bad", _key(x)), F.lit(False)))
    kept = joined.withColumn("_wq_kept", F.when(F.col("_wq_bad").isNull(), lines).otherwise(stays))
    out = {c: F.col(c) for c in plain.columns} | {"text": F.array_join("_wq_kept", "\n")}
    count = F.coalesce(with_words, F.lit(0)).cast("long")
    dropped = F.coalesce(F.size(lines) - F.size("_wq_kept"), F.lit(0)).cast("long")
    return kept.select(*[v.alias(c) for c, v in out.items()], count.alias("n_lines"), dropped.alias("n_dropped"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_dropped", F.md5(text_of()).alias("text_md5"))


SQL = r"""
WITH l AS (SELECT doc_id, source, page, i, lines[i] AS line, trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM (SELECT doc_id, source, page, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, source, md5(coalesce(text, '')) AS page, string_split(text, chr(10)) AS lines FROM documents))),
t AS (SELECT source, count(DISTINCT md5(coalesce(text, ''))) AS total FROM documents GROUP BY source),
b AS (SELECT l.source, k FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source WHERE k <> '' GROUP BY l.source, k HAVING count(DISTINCT page) - 1 > CAST(0.02 AS DOUBLE) * any_value(total)),
m AS (SELECT l.*, b.k IS NOT NULL AS bad FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.k = b.k),
a AS (SELECT doc_id, count(*) FILTER (k <> '') AS n, count(*) FILTER (bad) AS x, string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad) AS s FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(x, 0) AS BIGINT) AS n_dropped, md5(coalesce(s, '')) AS text_md5 FROM documents d LEFT JOIN a USING (doc_id)
"""
