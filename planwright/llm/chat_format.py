"""Chat formatting: multi-party perspective rotation.

Method: for every participant of a dialogue, the dialogue is rendered once with that speaker as the
assistant, all others as named users, and a loss mask on the assistant's turns alone.  Speakers named
in ``system`` are no participants: their turns are rendered as system turns in every perspective.

A dialogue is gathered in segments of ``SEGMENT`` turn numbers, so one endless conversation makes
bounded rows; every participant of the dialogue has a perspective of each of its segments.  Where a
dialogue has several, a row without a turn tells each segment of each participant.

Defined results: turns are ordered by number, then speaker, then text; repeated rows are repeated
turns; a null speaker is named ``unknown``; a null text is an empty turn; a null turn number sorts
first, in segment 0; rows with a null conversation id make one-turn dialogues of equal rows; a
dialogue of system turns alone has no perspective and gives no row; marks inside texts and names are
spaced out and line breaks in names become spaces, so neither can forge a turn; a very long text is
rendered whole; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT = 1024
SYSTEM = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
MARKS = ("<|im_start|>", "<|im_end|>")


def _plain(text: Column) -> Column:
    """The text with marks spaced out."""
    for mark in MARKS:
        text = F.replace(text, F.lit(mark), F.lit(f"< {mark[1:-1]} >"))
    return text


def rotated(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: tuple[str, ...] = SYSTEM) -> DataFrame:
    """One row per dialogue segment and participant.

    Columns: conv_id, segment, perspective, n_turns, n_trained, rendered, mask (0 or 1 per turn) and
    trained, the spans of code points of ``rendered`` that carry loss (the assistant's text and its
    closing mark).
    """
    base = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"),
        _plain(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"),
    )
    lone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "speaker", "text")).otherwise(F.lit(0))
    segment = F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(0)).cast("long")
    said = base.select("conv_id", segment.alias("segment"), lone.alias("_lone"), "speaker", F.struct("turn", "speaker", "text").alias("said"))
    told = said.unionByName(_elsewhere(said.select("conv_id", "segment", "speaker")), allowMissingColumns=True)
    dialogues = told.groupBy("conv_id", "segment", "_lone").agg(F.sort_array(F.collect_list("said")).alias("turns"), F.collect_set("speaker").alias("_speakers"))
    views = dialogues.withColumn("perspective", F.explode(F.filter("_speakers", lambda s: ~s.isin(*system))))

    def head(t):
        own = F.when(t["speaker"] == F.col("perspective"), F.lit("assistant")).when(t["speaker"].isin(*system), F.lit("system"))
        return F.concat(F.lit(OPEN), F.coalesce(own, F.concat(F.lit("user name="), F.translate(_plain(t["speaker"]), "\n\r", "  "))), F.lit("\n"))

    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), (t["speaker"] == F.col("perspective")).alias("own")))
    views = views.withColumn("_pieces", pieces)
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["head"])
        stop = begin + F.length(p["body"])
        return F.struct(stop.alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), stop.alias("stop"))))).otherwise(acc["spans"]).alias("spans"))

    return views.select(
        "conv_id",
        "segment",
        "perspective",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("_pieces", lambda p: p["own"])).cast("long").alias("n_trained"),
        F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.array_join(F.transform("_pieces", lambda p: p["own"].cast("int").cast("string")), "").alias("mask"),
        F.aggregate("_pieces", start, step, lambda acc: acc["spans"]).alias("trained"),
    )


def _elsewhere(spoken: DataFrame) -> DataFrame:
    """Each segment with each speaker of its dialogue, for the dialogues of more than one segment."""
    spoken = spoken.where(F.col("conv_id").isNotNull()).distinct()
    long = spoken.groupBy("conv_id").agg(F.min("segment").alias("_a"), F.max("segment").alias("_b")).where("_a < _b").select("conv_id")
    spoken = spoken.join(long, "conv_id")
    return spoken.select("conv_id", "segment").distinct().join(spoken.select("conv_id", "speaker").distinct(), "conv_id").withColumn("_lone", F.lit(0).cast("long"))


#: The digest of ``rotated`` that ``op8`` returns, as DuckDB SQL; for dialogues of one segment.
ROTATED_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(turn // 1024, 0) AS segment, turn, coalesce(role, 'unknown') AS speaker, replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start| >'), '<|im_end|>', '< |im_end| >') AS text FROM {turns}),
v AS (SELECT DISTINCT conv_id, segment, speaker AS perspective FROM t WHERE speaker <> 'system'),
p AS (
  SELECT v.conv_id, v.segment, v.perspective, t.turn, t.speaker, t.text, t.speaker = v.perspective AS own,
    '<|im_start|>' || CASE WHEN t.speaker = v.perspective THEN 'assistant' WHEN t.speaker = 'system' THEN 'system' ELSE 'user name=' || translate(replace(replace(t.speaker, '<|im_start|>', '< |im_start| >'), '<|im_end|>', '< |im_end| >'), chr(10) || chr(13), '  ') END || chr(10) AS head,
    t.text || '<|im_end|>' || chr(10) AS body
  FROM v JOIN t ON t.conv_id = v.conv_id AND t.segment = v.segment),
q AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, segment, perspective ORDER BY turn, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
  FROM p)
SELECT conv_id, segment, perspective, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_trained,
  string_agg(head || body, '' ORDER BY turn, speaker, text) AS rendered,
  string_agg(CASE WHEN own THEN '1' ELSE '0' END, '' ORDER BY turn, speaker, text) AS mask,
  string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(body) AS BIGINT), ',' ORDER BY turn, speaker, text) FILTER (WHERE own) AS trained
FROM q GROUP BY ALL
"""
