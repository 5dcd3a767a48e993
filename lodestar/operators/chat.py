"""Conversations: validation, context windows, export and import, tool calls."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonx

# Limits of a conversation.
ROLES, MAX_MESSAGES = ("system", "user", "assistant"), 128
MESSAGES = "array<struct<role: string, text: string>>"


def token_estimate(text: Column) -> Column:
    """The default counter: a quarter of the UTF-16 units, rounded up."""
    return F.ceil(F.octet_length(F.encode(text, "UTF-16BE")) / 8).cast("long")


def chat_faults(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text): (conv_id, turn, reason) where a role is unknown, a system message isn't first, user
    and assistant don't alternate from a user on, or there are too many messages."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    marked = turns.withColumn("n", F.row_number().over(by)).withColumn("was", F.lag("role").over(by))
    expected = F.when(F.col("was").isNull() | (F.col("was") == "system") | (F.col("was") == "assistant"), "user").otherwise("assistant")
    reason = (
        F.when(~F.col("role").isin(*ROLES) | F.col("role").isNull(), "role").when((F.col("role") == "system") & (F.col("n") > 1), "system not first")
        .when((F.col("role") != "system") & (F.col("role") != expected), "alternation").when(F.col("n") == MAX_MESSAGES + 1, "too many")
    )
    return marked.withColumn("reason", reason).where("reason is not null").select("conv_id", "turn", "reason")


def context_plan(turns: DataFrame, max_messages: int, max_tokens: int, tokens: Column | None = None) -> DataFrame:
    """turns with own (0 for system messages), place (from 0 among the others) and dropped: how many of these, oldest first, go.

    Whole turns, two messages each, are dropped from the start until the rest fits both bounds with the system messages; at
    least one message is left. dropped is null where nothing fits: that conversation is over its context limit. One running
    sum a conversation, no loop."""
    n = tokens if tokens is not None else token_estimate(F.col("text"))
    conv = Window.partitionBy("conv_id")
    sized = turns.withColumn("own", (F.col("role") != "system").cast("int")).withColumn("tokens", n)
    fixed = lambda x: F.sum((1 - F.col("own")) * x).over(conv)
    rest = Window.partitionBy("conv_id", "own").orderBy("turn", "role", "text").rowsBetween(0, Window.unboundedFollowing)
    sized = sized.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "own").orderBy("turn", "role", "text")) - 1)
    sized = sized.withColumn("n", F.count(F.lit(1)).over(rest) + fixed(F.lit(1))).withColumn("t", F.sum("tokens").over(rest) + fixed(F.col("tokens")))
    start = (F.col("own") == 1) & (F.col("place") % 2 == 0) & (F.col("n") <= max_messages) & (F.col("t") <= max_tokens)
    only = (F.sum("own").over(conv) == 0) & (fixed(F.lit(1)) <= max_messages) & (fixed(F.col("tokens")) <= max_tokens)
    return sized.withColumn("dropped", F.coalesce(F.min(F.when(start, F.col("place"))).over(conv), F.when(only, 0))).drop("n", "t", "tokens")


def drop_oldest(turns: DataFrame, max_messages: int, max_tokens: int, tokens: Column | None = None) -> DataFrame:
    """The window that the policy keeps: system messages and what is left after the oldest turns are dropped. Conversations that
    never fit have no rows; over_context() names them."""
    kept = context_plan(turns, max_messages, max_tokens, tokens).where("dropped is not null and (own = 0 or place >= dropped)")
    return kept.select("conv_id", "turn", "role", "text")


def over_context(turns: DataFrame, max_messages: int, max_tokens: int, tokens: Column | None = None) -> DataFrame:
    """(conv_id, code) of the conversations that no dropping of whole turns makes fit."""
    return context_plan(turns, max_messages, max_tokens, tokens).where("dropped is null").select("conv_id", F.lit("CONTEXT_LIMIT").alias("code")).distinct()


def export_sessions(turns: DataFrame) -> DataFrame:
    """(conv_id, session): each conversation as one JSON text, messages in order."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    return turns.groupBy("conv_id").agg(F.to_json(F.struct(F.lit(1).alias("version"), listed.alias("messages"))).alias("session"))


def import_sessions(sessions: DataFrame) -> DataFrame:
    """Turns of exported sessions; a text that isn't a session of version 1 is an error."""
    read = sessions.withColumn("s", F.from_json("session", f"version int, messages {MESSAGES}", {"mode": "FAILFAST"}))
    checked = F.when(F.col("s.version") == 1, F.col("s.messages")).otherwise(F.raise_error(F.lit("unsupported session version")).cast(MESSAGES))
    return read.select("conv_id", F.posexplode(checked).alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text")


def branch(turns: DataFrame, conv_id: int, new_id: int, until: int) -> DataFrame:
    """A copy of a conversation's turns up to ``until`` under another id."""
    return turns.where((F.col("conv_id") == conv_id) & (F.col("turn") <= until)).withColumn("conv_id", F.lit(new_id).cast("long"))


def tool_registry(schemas: dict[str, dict]) -> dict[str, dict]:
    """Tools by name with the schemas of their arguments: 1 to 64, names of identifier characters, schemas that compile."""
    if not 1 <= len(schemas) <= 64 or not all(re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]{0,63}", n) for n in schemas):
        raise ValueError("a registry has 1 to 64 tools with names of identifier characters")
    for schema in schemas.values():
        jsonx.compile_schema(schema)
    return dict(schemas)


def call_faults(calls: DataFrame, tools: dict[str, dict], order: str) -> DataFrame:
    """calls (conv_id, id, name, arguments, and a column that orders them): the first thing that is wrong with a call: a tool that
    isn't registered, an id that is malformed or used before in the conversation, arguments against the tool's schema."""
    turn = F.row_number().over(Window.partitionBy("conv_id", "id").orderBy(order))
    repeated = F.count(F.lit(1)).over(Window.partitionBy("conv_id", "id"))
    errors = F.lit(None).cast("string")
    for same in {json.dumps(s, sort_keys=True) for s in tools.values()}:
        names = [n for n, s in tools.items() if json.dumps(s, sort_keys=True) == same]
        errors = F.when(F.col("name").isin(names), F.array_join(jsonx.validator(json.loads(same))("arguments"), ";")).otherwise(errors)
    marked = calls.withColumn("turn", turn).withColumn("times", repeated).withColumn("errors", errors)
    reason = (
        F.when(~F.col("name").isin(list(tools)) | F.col("name").isNull(), "unknown tool").when(~F.coalesce(F.col("id").rlike("^[A-Za-z0-9_-]{1,128}$"), F.lit(False)), "malformed id")
        .when((F.col("times") > 1) & (F.col("turn") > 1), "repeated id").when(F.col("errors") != "", F.concat(F.lit("arguments: "), "errors"))
    )
    return marked.select(order, reason.alias("reason")).where("reason is not null")


def tool_faults(calls: DataFrame, results: DataFrame, tools: list[str]) -> DataFrame:
    """calls (conv_id, id, name) and results (conv_id, id, name, status): unknown tools, repeated ids, results without a call
    or of another name, calls that got none or more than one: (conv_id, id, reason)."""
    key = ["conv_id", "id"]
    say = lambda df, why: df.select(*key, F.lit(why).alias("reason"))
    repeated = calls.groupBy(*key).count().where("count > 1")
    twice = results.groupBy(*key).count().where("count > 1")
    renamed = results.join(calls.select(*key, F.col("name").alias("called")), key).where("name <> called")
    parts = [
        say(calls.where(~F.col("name").isin(tools)), "unknown tool"), say(repeated, "repeated id"), say(twice, "answered twice"), say(renamed, "other name"),
        say(results.join(calls, key, "left_anti"), "no call"), say(calls.join(results, key, "left_anti"), "no result"), say(results.where(~F.col("status").isin("ok", "denied", "error", "cancelled")), "status"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct()
