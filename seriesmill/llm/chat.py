"""Chat formatting by perspective rotation, with DataFrame functions only.

Every participant (distinct role) of a conversation is the assistant once: the
dialogue is rendered with that speaker's turns as the assistant's, all others as
turns of named users, and the loss mask covers the assistant's words and end marks.
A rendered dialogue comes as its segments, one for each turn, with their offsets in
code points: joined in order they are the dialogue. So a conversation of any length
stays distributed. Offsets are prefix sums over three levels: ranges of TURNS turns,
then turn by turn with the turns of one number split by their hash (at most TURNS x 256
sums a range), then within such a part; equal rows are counted before any shuffle.

Defined results: turns are ordered by turn (nulls first), then by the md5 of role and
text, role and text, so ties have a set order; repeated rows follow each other; a null
text is empty, a null role is the participant "unknown"; a row with a null conv_id is a
conversation of its own, as nothing tells which rows belong together; marks can't be
forged: in a text "<|" becomes "< |" and "|>" becomes "| >", in a name "&", "<", "|" and
">" become "&amp;", "&lt;", "&#124;" and "&gt;", so that different names stay different;
very long texts are one segment; other columns are ignored, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm.common import cut, join_salted

TURNS = 256
END = "<|end|>\n"
# How a name shows the characters of marks.
SHOWN = (("&", "&amp;"), ("<", "&lt;"), ("|", "&#124;"), (">", "&gt;"))


def _text(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def _name(x: Column) -> Column:
    for char, shown in SHOWN:
        x = F.replace(x, F.lit(char), F.lit(shown))
    return x


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, perspective, turn, speaker, start, end, mask_start, mask_end, segment."""
    turns = conversations.select("conv_id", "turn", _name(F.coalesce("role", F.lit("unknown"))).alias("role"), _text(F.coalesce("text", F.lit(""))).alias("text"))
    own = F.col("role") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), F.col("role"), F.lit("|>\n")))
    shape = ["conv_id", "perspective", "turn", "role", "text", own.alias("own"), head.alias("head"), F.concat(head, F.col("text"), F.lit(END)).alias("segment")]
    result = [
        "conv_id", "perspective", "turn", F.when(F.col("own"), "assistant").otherwise(F.col("role")).alias("speaker"), "start", (F.col("start") + F.col("size")).alias("end"),
        F.when(F.col("own"), F.col("start") + F.length("head")).alias("mask_start"), F.when(F.col("own"), F.col("start") + F.col("size") - 1).alias("mask_end"), "segment",
    ]

    alone = turns.where("conv_id IS NULL").withColumn("perspective", F.col("role")).select(*shape)
    alone = alone.withColumns({"size": F.length("segment").cast("long"), "start": F.lit(0).cast("long")}).select(*result)

    # Equal rows are one with their number; text moves once.
    counted = cut(turns.where("conv_id IS NOT NULL").groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")))
    people = counted.select("conv_id", F.col("role").alias("perspective")).distinct()
    tie = F.md5(F.concat_ws("|", "role", "text").cast("binary"))
    rows = join_salted(counted, people, ["conv_id"]).select(*shape, "copies", tie.alias("tie")).withColumn("size", F.length("segment").cast("long"))
    part = F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(2**40))).cast("long")
    rows = cut(rows.withColumns({"part": part, "at": F.coalesce(F.col("turn").cast("long"), F.lit(-(2**62))), "slice": F.substring("tie", 1, 2), "total": F.col("size") * F.col("copies")}))
    dialogue = ["conv_id", "perspective"]
    lowest = rows.groupBy(*dialogue, "part", "at", "slice").agg(F.sum("total").alias("total"))
    ranges = lowest.groupBy(*dialogue, "part").agg(F.sum("total").alias("total"))

    def before(keys: list[str], order: list[str]) -> Column:
        return F.coalesce(F.sum("total").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    ranges = ranges.select(*dialogue, "part", before(dialogue, ["part"]).alias("outer"))
    lowest = lowest.select(*dialogue, "part", "at", "slice", before([*dialogue, "part"], ["at", "slice"]).alias("middle")).join(ranges, [*dialogue, "part"])
    inner = before([*dialogue, "part", "at", "slice"], ["tie", "role", "text"])
    placed = rows.withColumn("inner", inner).join(lowest, [*dialogue, "part", "at", "slice"])
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    start = F.col("outer") + F.col("middle") + F.col("inner") + F.col("copy") * F.col("size")
    return placed.withColumn("start", start).select(*result).unionByName(alone)


_SHOWN = "coalesce(role, 'unknown')"
for _char, _entity in SHOWN:
    _SHOWN = f"replace({_SHOWN}, '{_char}', '{_entity}')"

#: The mask ends before the line feed after the end mark.
ORACLE = f"""
WITH turns AS (
  SELECT row_number() OVER () AS k, conv_id, turn, {_SHOWN} AS role, replace(replace(coalesce(text, ''), '<|', '< |'), '|>', '| >') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM turns WHERE conv_id IS NOT NULL),
every AS (
  SELECT conv_id, 0 AS k, perspective, turn, role, text, role = perspective AS own FROM turns JOIN people ON conv_id = c
  UNION ALL SELECT conv_id, k, role, turn, role, text, true FROM turns WHERE conv_id IS NULL),
headed AS (SELECT *, CASE WHEN own THEN '<|assistant|>' || chr(10) ELSE '<|user:' || role || '|>' || chr(10) END AS head FROM every),
sized AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM headed),
placed AS (
  SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, k, perspective ORDER BY turn NULLS FIRST, md5(role || '|' || text), role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized)
SELECT conv_id, perspective, turn, CASE WHEN own THEN 'assistant' ELSE role END AS speaker, start, start + length(segment) AS "end",
  CASE WHEN own THEN start + length(head) END AS mask_start, CASE WHEN own THEN start + length(segment) - 1 END AS mask_end, segment
FROM placed
"""
