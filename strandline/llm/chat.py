"""Chat formatting by prefix-target expansion, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The template's control strings, without their opening character.
CONTROL = r"(/?s>|/?INST\]|/?SYS\]|/?ROLE(?: [0-9A-F]*)?\])"
TURN = r"(?s)\[SYS\] .*? \[/SYS\]|\[INST\] .*? \[/INST\]|\[ROLE [0-9A-F]*\] .*? \[/ROLE\]|.*?</s>"
BEGIN = "<s>"


def escape(text: Column) -> Column:
    """One backslash after the first character of whatever reads as a control
    string, also of one that holds such backslashes already."""
    return F.regexp_replace(text, r"([<\[])(\\*+)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*+)" + CONTROL, r"$1$2$3")


def _format_turn(t: Column) -> Column:
    role, text = t["role"], escape(t["text"])
    other = F.concat(F.lit("[ROLE "), F.hex(F.encode(role, "UTF-8")), F.lit("] "))
    opening = F.when(role == "user", "[INST] ").when(role == "system", "[SYS] ").when(role == "assistant", "").otherwise(other)
    closing = F.when(role == "user", " [/INST]").when(role == "system", " [/SYS]").when(role == "assistant", "</s>").otherwise(F.lit(" [/ROLE]"))
    return F.struct(
        F.concat(opening, text, closing).alias("piece"),
        (role == "assistant").alias("reply"),
        F.char_length(text).alias("chars"),
    )


def chat_examples(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text): an example for every assistant turn,
    with all turns before it as context; only that reply is trainable. A
    conversation that doesn't end with a reply gives one more example, of all
    its turns and with nothing trainable, so that no turn is lost.

    Returns conv_id, example (0, 1, ...), n_turns (turns in the example),
    formatted, loss_start and loss_end (code points of formatted, the reply
    without its end mark), whole (the conversation's last example).

    A null text is empty, as is a null role; rows with a null conv_id are one
    conversation. Turns go by (turn, nulls first; role; text), so ties and
    repeated rows have one order. An empty table gives none; other columns are
    ignored. An example repeats its context, so a conversation's output grows
    with the square of its number of replies: that is what the expansion is.
    """
    t = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(t)).alias("turns"))
    pieces = grouped.select("conv_id", F.transform("turns", _format_turn).alias("p"))
    n = F.size("p")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("p", i)["reply"])
    ends = F.when(F.element_at("p", -1)["reply"], replies).otherwise(F.concat(replies, F.array(n)))
    each = pieces.select("conv_id", "p", F.posexplode_outer(ends).alias("example", "end"))
    upto = F.concat(F.lit(BEGIN), F.array_join(F.transform(F.slice("p", 1, F.col("end")), lambda x: x["piece"]), ""))
    last = F.element_at("p", F.col("end"))
    out = each.select("conv_id", "example", F.col("end").alias("n_turns"), upto.alias("formatted"), last.alias("last"), (F.col("end") == n).alias("whole"))
    start = F.char_length("formatted") - F.length(F.lit("</s>")) - F.col("last.chars")
    full = F.char_length("formatted")
    return out.select(
        "conv_id",
        "example",
        "n_turns",
        "formatted",
        F.when(F.col("last.reply"), start).otherwise(full).alias("loss_start"),
        F.when(F.col("last.reply"), start + F.col("last.chars")).otherwise(full).alias("loss_end"),
        "whole",
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that an example's text holds."""

    def read(piece: Column) -> Column:
        body = lambda begin, end: unescape(F.substring(piece, F.lit(begin + 1), F.char_length(piece) - begin - end))
        named = F.regexp_extract(piece, r"(?s)^\[ROLE ([0-9A-F]*)\] (.*) \[/ROLE\]$", 1)
        text = F.regexp_extract(piece, r"(?s)^\[ROLE ([0-9A-F]*)\] (.*) \[/ROLE\]$", 2)
        return (
            F.when(piece.startswith("[INST] "), F.struct(F.lit("user").alias("role"), body(7, 8).alias("text")))
            .when(piece.startswith("[SYS] "), F.struct(F.lit("system").alias("role"), body(6, 7).alias("text")))
            .when(piece.rlike(r"^\[ROLE [0-9A-F]*\] "), F.struct(F.decode(F.unhex(named), "UTF-8").alias("role"), unescape(text).alias("text")))
            .otherwise(F.struct(F.lit("assistant").alias("role"), body(0, 4).alias("text")))
        )

    rest = F.substring(formatted, F.lit(len(BEGIN) + 1), F.char_length(formatted))
    return F.transform(F.regexp_extract_all(rest, F.lit(TURN), F.lit(0)), read)


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    return unescape(F.substring(formatted, start + 1, end - start))


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1: a user, then an assistant row, of control strings."""
    row = spark.range(2, numPartitions=1)
    return row.select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))


def conversation_digest(examples: DataFrame) -> DataFrame:
    """What is read back from the examples of each conversation."""
    loss = read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))
    read = examples.select("conv_id", "example", loss.alias("loss"), F.when(F.col("whole"), read_turns(F.col("formatted"))).alias("turns"), F.char_length("formatted").cast("long").alias("chars"))
    by = read.groupBy("conv_id").agg(
        F.first("turns", ignorenulls=True).alias("turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op2_chat_prefix_target(spark, sf_dir):
    """Digest columns of chat_examples over all conversations and number -1."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return conversation_digest(chat_examples(turns.unionByName(control_conversation(spark))))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), p AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE(?: [0-9A-F]*)?\])', '\1\\\2\3', 'g'))
    + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 4 ELSE 15 + 2 * strlen(role) END AS chars
  FROM t
), s AS (
  SELECT *, 3 + sum(chars) OVER w AS upto, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS at_end
  FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR at_end)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
