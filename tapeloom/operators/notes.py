"""Notes: combined texts, summaries and prompts per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.text import SUMMARY_CHARS, notes_title, summarise
from tapeloom.operators.ordered import PAGE_ROWS, joined_pages, ordinal

# A summary shows SUMMARY_CHARS characters and must know whether there are more.
# Each transcript adds at least its line break to the combined text, so one
# character and one transcript more than shown decide the summary exactly.
_LOOK = SUMMARY_CHARS + 2


def _lines(transcripts: DataFrame) -> DataFrame:
    """Rows that give a line each: every part with a text, and the first part of a transcript without any."""
    filled = transcripts.filter("text <> ''")
    identity = ["session_id", "transcript_id"]
    later = filled.filter("part > 0").select(*identity).distinct()
    silent = transcripts.filter("text = '' AND part = 0").join(later, identity, "left_anti")
    return filled.unionByName(silent)


def combined_texts(transcripts: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """All texts of a session in write order, empties included, one per line."""
    placed = ordinal(
        _lines(transcripts).select("session_id", "row_id", "text"), ["session_id"], "row_id", "position"
    )
    return joined_pages(placed, ["session_id"], "position", F.col("text"), "\n", "combined", page_rows)


def prompts(transcripts: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """``[channel] text`` lines of a session in write order, empty texts left out."""
    spoken = transcripts.filter("text <> ''").select("session_id", "transcript_id", "part", "row_id", "channel", "text")
    # The channel stands before a transcript's first text; further parts go on below it.
    first = spoken.groupBy("session_id", "transcript_id").agg(F.min("part").alias("first"))
    later = spoken.filter("part > 0").join(first, ["session_id", "transcript_id"])
    named = F.concat(F.lit("["), F.col("channel"), F.lit("] "), F.col("text"))
    lines = (
        spoken.filter("part = 0")
        .select("session_id", "row_id", named.alias("line"))
        .unionByName(
            later.select(
                "session_id", "row_id", F.when(F.col("part") == F.col("first"), named).otherwise(F.col("text")).alias("line")
            )
        )
    )
    placed = ordinal(lines, ["session_id"], "row_id", "position")
    return joined_pages(placed, ["session_id"], "position", F.col("line"), "\n", "prompt", page_rows)


def summaries(transcripts: DataFrame) -> DataFrame:
    """The summary of each session that has a transcript.

    Only the head of the combined text can be shown, so each transcript brings
    its head and each session its first transcripts; Spark limits them per
    partition before the shuffle, which keeps a hot session small everywhere.
    """
    first = Window.partitionBy("session_id").orderBy("row_id")
    heads = (
        _lines(transcripts).select(
            "session_id", "row_id", F.substring("text", 1, _LOOK).alias("head")
        )
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= _LOOK)
    )
    ordered = F.sort_array(F.collect_list(F.struct("row_id", "head")))
    combined = F.array_join(F.transform(ordered, lambda item: item["head"]), "\n")
    return heads.groupBy("session_id").agg(summarise(combined).alias("summary"))


def default_notes(sessions: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Notes documents of the built-in generator; it finds no action items."""
    named = sessions.select(F.col("id").alias("session_id"), "name")
    return summaries(transcripts).join(named, "session_id").select(
        "session_id",
        notes_title(F.col("name")).alias("title"),
        "summary",
        F.array().cast("array<string>").alias("action_items"),
    )
