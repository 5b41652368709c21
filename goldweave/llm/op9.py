"""Query op9: roles and turns recovered from raw transcripts of `conversations`.

The table's turns are first written as raw transcripts, in a style of markers chosen by a hash of conv_id; a tenth of the
turns have no marker.  The model is learned from all transcripts of conversations whose crc32 modulo 4 isn't 2, and all
transcripts are parsed: held_out tells the others, whose roles it has never seen.  Rows of one turn follow each other by a
hash of role and text; the lines of each row stay together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.llm.base import table
from goldweave.llm.transcripts import ROLES, fit, read_lines, turns

STYLES = [{"system": "System: ", "user": "User: ", "assistant": "Assistant: "}, {"system": "[system]: ", "user": "Human: ", "assistant": "AI: "}, {"system": "**Context**: ", "user": "**Customer**: ", "assistant": "**Agent**: "}, {"system": "### System: ", "user": "### Instruction: ", "assistant": "### Response: "}, {"system": "SYS> ", "user": "Q: ", "assistant": "A: "}]


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, drawn, row, pos, line, role, first: the lines of each transcript; turns after the first are preceded by a blank line."""
    marks = F.create_map(*[x for i, s in enumerate(STYLES) for r, m in s.items() for x in (F.lit(f"{i}{r}"), F.lit(m))])
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("string")
    mark = F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(10)) == 0, "").otherwise(F.coalesce(F.try_element_at(marks, F.concat(style, F.col("role"))), F.lit("")))
    lines = F.split(F.concat(F.lit("\n"), mark, F.coalesce("text", F.lit(""))), "\n")
    own = [F.xxhash64("role", "text").alias("drawn"), F.monotonically_increasing_id().alias("row")]
    return conversations.select("conv_id", "turn", *own, "role", F.posexplode(lines).alias("pos", "line")).withColumn("first", F.col("pos") == 1)


def held_out(column: str = "conv_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_transcripts(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    role = F.coalesce(*[F.when(F.col("role") == r, i) for i, r in enumerate(ROLES)])
    lines = read_lines(raw, "conv_id", ["turn", "drawn", "row", "pos"], "line", 2 * role + F.when(F.col("first"), 0).otherwise(1))
    learned = lines.filter(~held_out("id") & ~F.col("no_id"))
    found = turns(lines, fit(learned))
    return found.select("conv_id", "turn", held_out().alias("held_out"), "role", "n_lines", F.sha2("text", 256).alias("text_sha256"), F.length("rendered").alias("rendered_chars"))
