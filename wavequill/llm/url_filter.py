"""URL filters: host and path rules, then a blocked Bloom filter of listed URLs before an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, small, stage

#: Verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Bits that a listed URL sets in its block of 64, and bits of the filter for each listed URL.
BITS_SET, BITS_EACH = 4, 16


def url_parts(url: Column) -> tuple[Column, Column]:
    """host (A-Z lowered) and path. Null, or without ://, both empty."""
    text, pattern = F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def canonical(url: Column) -> Column:
    """Host without www., m. or blog. and port; path without a last slash; sorted query without tracking. Scheme and fragment go."""
    host, path = url_parts(url)
    host = F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"^(www|m|blog)\.", "")
    asked = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda x: (x != "") & ~x.rlike(r"^(utm_\w+|ref|fbclid|gclid)(=|$)")))
    return F.concat(host, F.regexp_replace(path, r"/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.concat_ws("&", kept))).otherwise(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, like net/, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _mask(canon: str) -> Column:
    """The bits that a URL sets in its block."""
    h, mask = F.xxhash64(F.lit("mask"), canon), F.lit(0).cast("long")
    for i in range(BITS_SET):
        mask = mask.bitwiseOR(F.expr(f"shiftleft(1L, CAST(pmod(shiftright(xxhash64('mask', {canon}), {6 * i}), 64) AS INT))"))
    return F.when(h.isNotNull(), mask)


def possible_hits(canons: DataFrame, listed: DataFrame) -> DataFrame:
    """The different canon of canons that the filter of listed lets through: all that are listed, and few others.

    The filter is a table of 64-bit blocks, made by bit_or over the listed URLs; it joins on the block's number, broadcast
    only while small. An empty list lets nothing through.
    """
    blocks = max(1, listed.count() * BITS_EACH // 64)
    block = F.pmod(F.xxhash64("canon"), F.lit(blocks))
    words = listed.groupBy(block.alias("block")).agg(F.bit_or(_mask("canon")).alias("word"))
    asked = canons.select("canon").distinct().withColumn("block", block).withColumn("mask", _mask("canon"))
    maybe = asked.join(small(words, blocks), "block").where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask"))
    return maybe.select("canon")


def listed_hits(canons: DataFrame, listed: DataFrame) -> DataFrame:
    """The different canon of canons that are in listed, both frames of one column canon: what passes the filter is joined
    exactly, which removes the false positives. Null is never listed."""
    listed = stage(listed.where(F.col("canon").isNotNull()).distinct(), "listed")
    return possible_hits(canons, listed).join(listed, "canon", "left_semi")


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of pages (page_id, url); listed: bad URLs in a column url.

    A rule decides alone; without one, a listed URL is blocked and any other allowed. Null and malformed urls have empty
    parts and are allowed. Repeated rows are judged alike, null ids kept; other columns are not read.
    """
    pages = pages.select("page_id", "url")
    host, path = url_parts(F.col("url"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    split = pages.select("page_id", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("canon"))
    split = split.withColumn("canon", F.when(F.col("canon") != "", F.col("canon")))
    ruled = split.select("*", rule.alias("rule"), said.alias("said"))
    bad = listed.select(canonical(F.col("url")).alias("canon")).where(F.col("canon") != "")
    asked = ruled.where(F.col("rule").isNull() & F.col("canon").isNotNull())
    hits = stage(listed_hits(asked.select("canon"), bad).withColumn("hit", F.lit(True)), "hits")
    found = ruled.join(small(hits), "canon", "left")
    is_listed = F.coalesce("hit", F.lit(False))
    return found.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(is_listed, "block").otherwise("allow")).alias("verdict"), (is_listed & F.col("rule").isNull()).alias("listed"))


def listed_pages(pages: DataFrame) -> DataFrame:
    """The list of the registered query, which has no list of its own to read: a sixteenth of the different canonical urls of
    pages, by their md5, and as many that no page has. So the list says nothing about hosts or what pages carry."""
    canon = canonical(F.col("url"))
    chosen = pages.select("url", canon.alias("canon")).where((F.col("canon") != "") & F.md5("canon").startswith("0"))
    return chosen.select("url").unionByName(chosen.select(F.concat(F.lit("http://absent.invalid/"), F.md5("canon")).alias("url")))


SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
    regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1) AS asked
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    regexp_replace(regexp_replace(host, ':\d*$', ''), '^(www|m|blog)\.', '') || regexp_replace(path, '/+$', '') ||
      coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(asked, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_\w+|ref|fbclid|gclid)(=|$)'))), '&'), ''), '') AS canon
  FROM p),
l AS (SELECT DISTINCT canon FROM r WHERE canon <> '' AND md5(canon) LIKE '0%')
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN canon IN (SELECT canon FROM l) THEN 'block' ELSE 'allow' END AS verdict,
  (rule IS NULL AND canon IN (SELECT canon FROM l)) AS listed
FROM r
"""
