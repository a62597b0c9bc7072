"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of the output, one string per conversation:
    output := turn*
    turn   := "<s>" role "[INST] " text " [/INST]</s>"
Roles and texts hold no control string, so splitting at "</s>" and matching one
pattern recovers the turns. A control string inside a role or text gets a
backslash after its first character; one that already has n backslashes there
gets one more, so taking one away restores every text. The raw rendering is
reparsed first and kept where the turns come back identical; the others are
escaped and reparsed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import read

#: The control strings are <s> </s> [INST] [/INST].
CONTROL = r"(<|\[)(\\*)(/?s>|/?INST\])"
ESCAPED = r"(<|\[)\\(\\*)(/?s>|/?INST\])"
TURN = r"(?s)^<s>(.*?)\[INST\] (.*) \[/INST\]$"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def render(turns: Column, safe: bool) -> Column:
    """One string from an array of (role, text)."""
    part = escape if safe else lambda c: c
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<s>"), part(t["role"]), F.lit("[INST] "), part(t["text"]), F.lit(" [/INST]</s>"))), "")


def parse(output: Column) -> Column:
    """The array of (role, text) that a string of the grammar stands for."""
    pieces = F.split(output, "</s>", -1)
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(pieces, lambda p: F.struct(unescape(F.regexp_extract(p, TURN, 1)).alias("role"), unescape(F.regexp_extract(p, TURN, 2)).alias("text")))


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, exact) from rows(conv_id, turn, role, text).

    turns is read back from formatted; exact says that it equals the source.
    Turns come in order of turn, ties by role and text; null role, text: empty;
    a null turn comes first; a null conv_id is a conversation of its own.
    Repeated rows are repeated turns; an empty table gives no rows. A
    conversation is one output string, so its turns meet in one row.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("rows"))
    whole = whole.select("conv_id", F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    whole = whole.withColumn("raw", render(F.col("source"), False))
    whole = whole.withColumn("formatted", F.when(parse(F.col("raw")) == F.col("source"), F.col("raw")).otherwise(render(F.col("source"), True)))
    return whole.withColumn("turns", parse(F.col("formatted"))).select("conv_id", "formatted", "turns", (F.col("turns") == F.col("source")).alias("exact"))


def digests(chats: DataFrame) -> DataFrame:
    """The turns and the loss mask's text, as read back, in digest columns."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.filter("turns", lambda t: t["role"] == TRAINED)
    loss = F.array_join(F.transform(trained, lambda t: t["text"]), "")
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "exact")


def op9(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    return digests(format_chats(rows.unionByName(more)))


_ESC = r"regexp_replace({}, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')"
OP9_SQL = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('<s>' || {_ESC.format('role')} || '[INST] ' || {_ESC.format('text')} || ' [/INST]</s>'))::bigint as formatted_chars,
  true as exact
from rows group by conv_id"""
