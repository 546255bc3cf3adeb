"""The registered queries of this subpackage, and their DuckDB SQL where there is any."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, decontaminate, language, line_dedup, mixing, near_duplicates, quality, secrets, toxicity, url_filter
from .common import table


def op1_decontaminate(spark, sf_dir):
    return decontaminate.digest(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_mix_sources(spark, sf_dir):
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents")))


def op3_ngram_jaccard(spark, sf_dir):
    return near_duplicates.link(table(spark, sf_dir, "documents"), size=4, percent=85)


def op4_quality(spark, sf_dir):
    return quality.digest(quality.judge(table(spark, sf_dir, "documents")))


def op5_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op7_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.listed_pages(pages))


def op8_tool_calls(spark, sf_dir):
    return chat.digest(chat.format_chat(chat.from_turns(table(spark, sf_dir, "conversations")), chat.SCHEMAS))


def op9_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    versions = docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text")
    # The rules came in two steps: the second scan finds the base rules' pairs in the ledger, and scans for the others alone.
    _, ledger = secrets.scan(versions, rules=secrets.RULES[: len(secrets.BASE)])
    paths, _ = secrets.scan(versions, ledger)
    return secrets.digest(paths)


def op10_line_dedup(spark, sf_dir):
    return line_dedup.digest(line_dedup.drop_lines(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_mix_sources, op3_ngram_jaccard, op4_quality, op5_toxicity, op6_language, op7_url_filter, op8_tool_calls, op9_secrets, op10_line_dedup)}
ORACLE = {"op1_decontaminate": decontaminate.SQL, "op2_mix_sources": mixing.SQL, "op7_url_filter": url_filter.SQL, "op8_tool_calls": chat.SQL, "op9_secrets": secrets.SQL, "op10_line_dedup": line_dedup.SQL}
