"""Chat formatting: a template turns conversations into text segments with loss flags.

The template is data: how a turn begins and ends, which roles may follow which
(a finite-state machine), and whose text carries loss. Control characters
inside roles and texts are escaped reversibly: every backslash of the output
starts a two-character code, so a control string can't be forged by a text.

All of it is DataFrame expressions. Turns are gathered per conversation, since
one conversation is one output text.

Nulls: a null text or role is empty; a null conv_id is a conversation; a null
turn comes before all others. Rows of equal turn are ordered by role, then text;
repeated rows are each a turn. Conversations that break the turn
order are formatted and marked valid = false. Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

TEMPLATE = {
    "open": "### {role}: ",
    "close": "</turn>\n",
    "codes": {"\\": "\\b", "#": "\\h", "<": "\\l", ":": "\\c"},
    "text_codes": ["\\", "#", "<"],
    "follows": {"": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "ends": ["assistant"],
    "loss": ["assistant"],
}


def escaped(text: Column, marks: list[str], codes: dict[str, str]) -> Column:
    for mark in marks:  # the backslash comes first
        text = F.replace(text, F.lit(mark), F.lit(codes[mark]))
    return text


def unescaped(text: Column, codes: dict[str, str]) -> Column:
    for mark, code in reversed(codes.items()):  # the backslash comes last
        text = F.replace(text, F.lit(code), F.lit(mark))
    return text


def format_chats(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted text, valid."""
    codes, (before, after) = template["codes"], template["open"].split("{role}")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    allowed = F.array(*(F.lit(f"{a}>{b}") for a, bs in template["follows"].items() for b in bs))
    step = lambda state, t: F.when(state.isNotNull() & F.array_contains(allowed, F.concat(state, F.lit(">"), t["role"])), t["role"])
    last = F.aggregate("turns", F.lit("").cast("string"), step)
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(F.concat(F.lit(before), escaped(t["role"], list(codes), codes), F.lit(after)), F.lit(False)),
                segment(escaped(t["text"], template["text_codes"], codes), t["role"].isin(template["loss"])),
                segment(F.lit(template["close"]), F.lit(False)),
            ),
        )
    )
    made = chats.select("conv_id", segments.alias("segments"), F.coalesce(last.isin(template["ends"]), F.lit(False)).alias("valid"))
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(chats: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """The turns, from `formatted` alone: conv_id, turns array<struct<role, text>>."""
    codes, (before, after) = template["codes"], template["open"].split("{role}")
    close = re.escape(template["close"]).replace("\\\n", "\n")  # a pattern for Java: the closing string as it is
    bodies = F.slice(F.split("formatted", close), 1, F.size(F.split("formatted", close)) - 1)
    turns = F.transform(
        bodies,
        lambda b: F.struct(
            unescaped(F.substring(b, F.lit(len(before) + 1), F.instr(b, F.lit(after)) - len(before) - 1), codes).alias("role"),
            unescaped(F.substring(b, F.instr(b, F.lit(after)) + len(after), F.length(b)), codes).alias("text"),
        ),
    )
    return chats.withColumn("turns", turns)


def with_control_case(rows: DataFrame) -> DataFrame:
    """All conversations plus number -7, whose texts hold control strings."""
    spark = rows.sparkSession
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(extra)


def op5_chat_formatting(spark, sf_dir: str) -> DataFrame:
    made = read_back(format_chats(with_control_case(table(spark, sf_dir, "conversations"))))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], TEMPLATE["codes"])), "")
    read = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(read, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


_SAID = r"'\### Assistant: </turn> ok'"
ORACLE = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_SAID} UNION ALL SELECT -7, 1, 'assistant', {_SAID}
), esc AS (
  SELECT *, length(replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l')) AS n_text,
    length(replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c')) AS n_role,
    lag(role) OVER w AS before, lead(role) OVER w AS after, row_number() OVER w AS k
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_text + n_role + 14) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN k = 1 THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END
    AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM esc GROUP BY conv_id
"""
