"""Chat formatting: links tool calls and results by identifier, orders them topologically, validates arguments, serialises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import same, stage, text_of, unstage

#: Schemas of the registered query's calls: name -> field -> (JSON type, required). A field that isn't named isn't allowed.
SCHEMAS = {
    "ask": {"text": ("STRING", True), "words": ("BIGINT", True)},
    "instruct": {"text": ("STRING", True), "words": ("BIGINT", True)},
}


def valid(name: Column, body: str, schemas: dict) -> Column:
    """Whether the JSON object in column body keeps the schema of its tool; false for unknown tools and what is no object."""
    value, names = F.try_parse_json(body), F.json_object_keys(F.col(body))
    verdict = F.lit(False)
    for tool, fields in schemas.items():
        kept = F.size(F.array_except(names, F.array(*[F.lit(f) for f in fields]).cast("array<string>"))) == 0
        for field, (kind, required) in fields.items():
            is_kind = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant")).startswith(kind)
            kept = kept & F.coalesce(is_kind, F.lit(False)) if required else kept & F.coalesce(is_kind, ~F.array_contains(names, field))
        verdict = F.when(name == tool, value.isNotNull() & kept).otherwise(verdict)
    return F.coalesce(verdict, F.lit(False))


def depths(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, depth: how many calls each follows, by its parents. Null for calls in a circle or after one.

    Every round doubles the distance that a call looks back, so a chain of n calls takes log2(n) rounds.
    """
    known = calls.groupBy("conv_id", "call_id").agg(F.min("parent_id").alias("parent_id"))
    parents = known.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_p"))
    there = known.join(parents, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("parent_id") == F.col("_p")), "left")
    state = stage(there.select("conv_id", "call_id", F.col("_p").alias("up"), F.when(F.col("_p").isNull(), 0).otherwise(1).cast("long").alias("depth")), "depths")
    rounds = max(1, state.count()).bit_length() + 1
    for _ in range(rounds):
        if not state.where(F.col("up").isNotNull()).count():
            break
        above = state.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_p"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        # Only calls that still look back join; the others are done.
        open_ = state.where(F.col("up").isNotNull()).join(above, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("up") == F.col("_p")))
        moved = open_.select("conv_id", "call_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"))
        before, state = state, stage(state.where(F.col("up").isNull()).unionByName(moved), "depths")
        unstage(before)
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def format_chat(messages: DataFrame, schemas: dict) -> DataFrame:
    """A row for every row of messages (conv_id, turn, role, kind, call_id, parent_id, name, body): these, and

    linked: a call has a result, a result has a call, of the same identifier in the same conversation; ambiguous: the
    identifier has several calls; depth: see depths(), a result's is its call's; position: from 0 in the conversation by
    depth (null last), turn, calls before results, then role and content; valid: see valid(), true for results that are JSON;
    json: the message with keys in order and no blanks, its body too, or with a null body if that is no JSON.

    kind is call, result or other; others are not linked, have no depth and keep their place by turn after the linked ones.
    Null identifiers link nothing; null conversations are one. Repeated rows are messages each, and make an identifier
    ambiguous. Empty tables give no rows. Other columns are not read.
    """
    m = messages.select("conv_id", "turn", "role", "kind", "call_id", "parent_id", "name", "body")
    calls = m.where((F.col("kind") == "call") & F.col("call_id").isNotNull())
    per_id = m.where(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.count_if(F.col("kind") == "call").alias("n_calls"), F.count_if(F.col("kind") == "result").alias("n_results"))
    ids = depths(calls)
    info = per_id.join(ids, same(per_id, ids, ["conv_id", "call_id"]), "left").select(per_id["conv_id"].alias("_c"), per_id["call_id"].alias("_i"), "n_calls", "n_results", "depth")
    joined = m.join(info, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("call_id") == F.col("_i")), "left")
    linked = F.coalesce((F.col("kind").isin("call", "result")) & (F.col("n_calls") > 0) & (F.col("n_results") > 0), F.lit(False))
    value = F.try_parse_json("body")
    ok = F.when(F.col("kind") == "call", valid(F.col("name"), "body", schemas)).otherwise(value.isNotNull())
    # Fields in order of their names; objects of type variant have theirs in order already.
    text = F.to_json(F.struct(value.alias("body"), F.col("call_id").alias("id"), F.col("kind"), F.col("name"), F.col("parent_id").alias("parent"), F.col("role"), F.col("turn")))
    flat = joined.select("conv_id", "turn", "role", "kind", "call_id", linked.alias("linked"), F.coalesce(F.col("n_calls") > 1, F.lit(False)).alias("ambiguous"), F.when(F.col("kind").isin("call", "result"), F.col("depth")).alias("depth"), ok.alias("valid"), text.alias("json"))
    # Ranked within each depth and carried over between depths: a long conversation is many small groups.
    level = F.coalesce("depth", F.lit(1 << 60))
    flat = stage(flat.withColumn("level", level), "messages")
    sums = flat.groupBy("conv_id", "level").agg(F.count("*").alias("n"))
    before = sums.select(F.col("conv_id").alias("_c"), F.col("level").alias("_l"), (F.sum("n").over(Window.partitionBy("conv_id").orderBy("level")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "level").orderBy("turn", "kind", "role", "json")) - 1
    ranked = flat.withColumn("rank", rank).join(before, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("level") == F.col("_l")))
    return ranked.select("conv_id", "turn", "role", "kind", "call_id", "linked", "ambiguous", "depth", (F.col("rank") + F.col("before")).cast("long").alias("position"), "valid", "json")


def from_turns(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as messages: turns of users and systems call for an answer, an assistant's
    turn is the result of the last call before it, and each call follows the one before.

    Not all calls are as they should be, by k = (7 * conv_id + turn) mod 10 (null counts as 0): 0 gives words as a string, 1 has
    a field more, 2 a field less, 3 asks a tool that there isn't, 4 takes the identifier of the call before, without a parent,
    and 5 names itself as its parent. Null texts count as empty. Rows of null conversations are one. Equal turns are taken by
    role and text.
    """
    is_call = F.col("role").isin("user", "system")
    number = lambda c: F.pmod(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(10))
    ident = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.col("turn").cast("string"))
    plain = conversations.select("conv_id", "turn", "role", text_of().alias("text"), ((7 * number("conv_id") + number("turn")) % 10).alias("k"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    new = F.when(is_call & (F.col("k") != 4), ident)
    upto = F.last(new, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = F.last(new, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    kind = F.when(is_call, "call").when(F.col("role") == "assistant", "result").otherwise("other")
    words = F.size(F.array_remove(F.split("text", r"\s+"), ""))
    named = plain.select("conv_id", "turn", "role", "text", "k", kind.alias("kind"), F.coalesce(upto, ident).alias("ident"), last.alias("last"), words.alias("words"))
    right = F.to_json(F.struct("text", "words"))
    broken = F.when(F.col("k") == 0, F.to_json(F.struct("text", F.col("words").cast("string").alias("words"))))
    broken = broken.when(F.col("k") == 1, F.to_json(F.struct("text", "words", F.lit(True).alias("note")))).when(F.col("k") == 2, F.to_json(F.struct("text")))
    body = F.when(F.col("kind") == "call", F.coalesce(broken, right)).otherwise(right)
    call_id = F.when(F.col("kind") == "call", F.col("ident")).when(F.col("kind") == "result", F.col("last"))
    parent = F.when(F.col("kind") == "call", F.when(F.col("k") == 5, F.col("ident")).when(F.col("k") != 4, F.col("last")))
    name = F.when(F.col("kind") == "call", F.when(F.col("k") == 3, "draw").when(F.col("role") == "user", "ask").otherwise("instruct"))
    return named.select("conv_id", "turn", "role", "kind", call_id.alias("call_id"), parent.alias("parent_id"), name.alias("name"), body.alias("body"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("conv_id", "turn", "role", "kind", "call_id", "linked", "ambiguous", "depth", "position", "valid", F.md5("json").alias("json_md5"))


#: DuckDB, for tables in which no conversation has a turn twice.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE WHEN role IN ('user', 'system') THEN 'call' WHEN role = 'assistant' THEN 'result' ELSE 'other' END AS kind,
    conv_id || ':' || turn AS ident, (7 * (conv_id % 10) + turn % 10) % 10 AS k, len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS words FROM conversations),
l AS (
  SELECT *, last_value(CASE WHEN kind = 'call' AND k <> 4 THEN ident END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
    last_value(CASE WHEN kind = 'call' AND k <> 4 THEN ident END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    count(*) FILTER (kind = 'call' AND k <> 4) OVER (PARTITION BY conv_id ORDER BY turn) AS nth,
    count(*) FILTER (kind = 'call' AND k = 5) OVER (PARTITION BY conv_id ORDER BY turn) AS circles FROM t),
c AS (
  SELECT *, CASE kind WHEN 'call' THEN coalesce(upto, ident) WHEN 'result' THEN prev END AS call_id,
    CASE WHEN kind = 'other' OR circles > 0 OR kind = 'result' AND prev IS NULL THEN NULL ELSE greatest(nth - 1, 0) END AS depth,
    CASE WHEN kind = 'call' AND k = 5 THEN ident WHEN kind = 'call' AND k <> 4 THEN prev END AS parent,
    CASE WHEN kind <> 'call' THEN NULL WHEN k = 3 THEN 'draw' WHEN role = 'user' THEN 'ask' ELSE 'instruct' END AS name,
    CASE WHEN kind = 'call' AND k = 1 THEN '{"note":true,"text":' ELSE '{"text":' END || CAST(to_json(text) AS VARCHAR)
      || CASE WHEN kind = 'call' AND k = 0 THEN ',"words":"' || words || '"' WHEN kind = 'call' AND k = 2 THEN '' ELSE ',"words":' || words END || '}' AS body FROM l),
n AS (SELECT *, count(*) FILTER (kind = 'result') OVER (PARTITION BY conv_id, call_id) AS results, count(*) FILTER (kind = 'call') OVER (PARTITION BY conv_id, call_id) AS calls FROM c)
SELECT conv_id, turn, role, kind, call_id, call_id IS NOT NULL AND kind <> 'other' AND results > 0 AND calls > 0 AS linked, call_id IS NOT NULL AND calls > 1 AS ambiguous, CAST(depth AS BIGINT) AS depth,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY depth NULLS LAST, turn) - 1 AS BIGINT) AS position,
  CASE WHEN kind = 'call' THEN name IN ('ask', 'instruct') AND list_sort(json_keys(body)) = ['text', 'words'] AND json_type(body, '$.text') = 'VARCHAR' AND coalesce(json_type(body, '$.words') IN ('UBIGINT', 'BIGINT'), false) ELSE json_valid(body) END AS valid,
  md5('{"body":' || body || CASE WHEN call_id IS NULL THEN '' ELSE ',"id":"' || call_id || '"' END || ',"kind":"' || kind || '"' || CASE WHEN name IS NULL THEN '' ELSE ',"name":"' || name || '"' END
    || CASE WHEN parent IS NULL THEN '' ELSE ',"parent":"' || parent || '"' END || ',"role":"' || role || '","turn":' || turn || '}') AS json_md5
FROM n
"""
