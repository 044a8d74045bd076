"""Merging chunk transcripts, running partials, event folds and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import codec
from tapeloom.functions.text import lstrip, rstrip, seconds, strip
from tapeloom.operators.ordered import PAGE_ROWS, Fold, block_of, joined_pages, running
from tapeloom.schemas import SEGMENTS

KEY = ["session_id", "channel"]


def with_offsets(chunks: DataFrame) -> DataFrame:
    """Add ``start``: the summed duration of all earlier chunks of the channel."""
    plain = chunks.drop("start")
    before = Fold("sum", F.col("duration"), inclusive=False)
    return running(plain, KEY, "chunk_index", {"start": before}).withColumn(
        "start", F.col("start").cast("double")
    )


def parse_responses(chunks: DataFrame) -> DataFrame:
    """Provider responses as ``text``, ``segments`` and ``raw_response``."""
    parsed = chunks.withColumn("parsed", codec.normalise_response(F.col("response")))
    return parsed.select(*[c for c in chunks.columns if c != "response"], "parsed.*")


def _shifted(segments: Column, start: Column) -> Column:
    """Segments on the time line of the whole recording; absent times stay absent."""
    return F.transform(
        segments,
        lambda s: F.struct(
            (s["start"] + start).alias("start"),
            (s["end"] + start).alias("end"),
            strip(s["text"]).alias("text"),
        ),
    )


def merge_chunks(parsed: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """One transcript per (session, channel) from its parsed chunk responses.

    ``chunk_index`` counts from 0, as the split numbers its chunks.  A transcript of up to ``page_rows`` chunks is the row with ``part`` 0; a
    longer one goes on in further parts, each complete for its chunks, so that
    no task gathers an unbounded recording.  Rows marked ``is_whole`` (when the
    column exists) are recordings sent in one piece: they keep their text
    unstripped and their response as it came.
    """
    clean = strip(F.col("text"))
    entry = F.struct(
        F.col("start"),
        F.col("duration"),
        F.col("text"),
        F.try_parse_json(F.col("raw_response")).alias("raw_response"),
    )
    piece = F.struct(
        F.col("chunk_index").alias("i"),
        F.nullif(clean, F.lit("")).alias("text"),
        _shifted(F.col("segments"), F.col("start")).alias("segments"),
        F.to_json(entry).alias("entry"),
    )
    whole = F.col("is_whole") if "is_whole" in parsed.columns else F.lit(False)
    kept = F.struct(F.col("text"), F.col("raw_response"))
    grouped = parsed.groupBy(*KEY, block_of("chunk_index", page_rows).alias("part")).agg(
        F.sort_array(F.collect_list(piece)).alias("pieces"),
        F.any_value(F.when(whole, kept), True).alias("kept"),
    )
    text = F.array_join(F.col("pieces.text"), "\n")
    chunks_json = F.concat(F.lit('{"chunks":['), F.array_join(F.col("pieces.entry"), ","), F.lit("]"))
    text_json = F.to_json(F.struct(F.col("text")))
    merged = grouped.select(
        *KEY,
        "part",
        text.alias("text"),
        F.flatten("pieces.segments").cast(SEGMENTS).alias("segments"),
        chunks_json.alias("head"),
        "kept",
    ).withColumn(
        "raw",
        F.when(F.col("text") == "", F.concat("head", F.lit("}"))).otherwise(
            F.concat("head", F.lit(","), F.substring(text_json, 2, 2**31 - 1))
        ),
    )
    sent_whole = F.col("kept").isNotNull()
    return merged.select(
        *KEY,
        "part",
        F.when(sent_whole, F.col("kept.text")).otherwise(F.col("text")).alias("text"),
        "segments",
        F.when(sent_whole, F.col("kept.raw_response")).otherwise(F.col("raw")).alias("raw_response"),
    )


def empty_transcripts(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Empty transcripts of the targets that have no chunks at all."""
    absent = targets.select(*KEY).distinct().join(chunks.select(*KEY).distinct(), KEY, "left_anti")
    return absent.select(
        *KEY,
        F.lit(0).cast("bigint").alias("part"),
        F.lit("").alias("text"),
        F.array().cast(SEGMENTS).alias("segments"),
        F.lit(None).cast("string").alias("raw_response"),
    )


def running_partials(parsed: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """One update per chunk, as growing prefixes of the merged transcript.

    After chunk *i* the text is the first ``text_length`` characters of the merged
    text, the segments are the first ``n_segments`` and the raw response holds the
    first ``n_entries`` chunk entries; all three run on across parts.  Naming the
    prefix keeps the output as long as the input; writing every prefix out would
    square it.
    """
    clean = strip(F.col("text"))
    added = parsed.select(
        *KEY,
        block_of("chunk_index", page_rows).alias("part"),
        "chunk_index",
        clean.alias("appended"),
        F.coalesce(F.size("segments"), F.lit(0)).cast("bigint").alias("own"),
    )
    one = F.lit(1).cast("bigint")
    counted = running(
        added,
        KEY,
        "chunk_index",
        {
            "filled": Fold("sum", F.when(F.col("appended") != "", one).otherwise(F.lit(0).cast("bigint"))),
            "chars": Fold("sum", F.length("appended").cast("bigint")),
            "n_segments": Fold("sum", F.col("own")),
            "n_entries": Fold("sum", one),
        },
        page_rows,
    )
    return counted.select(
        *KEY,
        "part",
        "chunk_index",
        "appended",
        (F.col("chars") + F.greatest(F.col("filled") - 1, F.lit(0))).cast("bigint").alias("text_length"),
        "n_segments",
        "n_entries",
    )


def _raw_prefix(raw: Column, entries: Column) -> Column:
    """A raw response cut to its first chunk entries, as an update carries it."""
    listed = F.try_variant_get(F.try_parse_json(raw), "$.chunks", "array<variant>")
    kept = F.transform(F.slice(listed, F.lit(1), entries.cast("int")), lambda entry: F.to_json(entry))
    return F.concat(F.lit('{"chunks":['), F.array_join(kept, ","), F.lit("]}"))


def partial_texts(partials: DataFrame, merged: DataFrame) -> DataFrame:
    """Write out the wanted ``partials`` in full: cumulative text, segments and raw response.

    An update in a later part gets one row for each part up to its own: whole parts,
    then the prefix of its own.  Their non-empty texts joined by line breaks are the
    update's text.
    """
    sizes = merged.select(
        *KEY,
        "part",
        F.length("text").alias("chars"),
        F.size("segments").alias("own"),
        F.size(F.try_variant_get(F.try_parse_json("raw_response"), "$.chunks", "array<variant>")).alias("entries"),
    )
    # One narrow row per part meets here.
    earlier = Window.partitionBy(*KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda value: F.coalesce(F.sum(value).over(earlier), F.lit(0)).cast("bigint")
    # Each non-empty part is followed by a line break.
    starts = sizes.select(
        *KEY,
        "part",
        before(F.when(F.col("chars") > 0, F.col("chars") + 1)).alias("__chars"),
        before(F.col("own")).alias("__segments"),
        before(F.col("entries")).alias("__entries"),
    )
    placed = merged.select(*KEY, "part", "text", "segments", "raw_response").join(starts, [*KEY, "part"])
    wanted = partials.select(*KEY, F.col("part").alias("__own"), "chunk_index", "text_length", "n_segments", "n_entries")
    parts = placed.join(wanted, KEY).filter("part <= __own")
    own = F.col("part") == F.col("__own")
    rest = lambda total, start: F.greatest(F.col(total) - F.col(start), F.lit(0)).cast("int")
    text = F.substr("text", F.lit(1), rest("text_length", "__chars"))
    return parts.select(
        *KEY,
        "part",
        "chunk_index",
        F.when(own, text).otherwise(F.col("text")).alias("text"),
        F.when(own, F.slice("segments", F.lit(1), rest("n_segments", "__segments"))).otherwise(F.col("segments")).alias("segments"),
        F.when(own, _raw_prefix(F.col("raw_response"), rest("n_entries", "__entries")))
        .otherwise(F.col("raw_response"))
        .alias("raw_response"),
    )


def emit_if_changed(
    updates: DataFrame, finals: DataFrame, keys: list[str], order: str, payload: list[str]
) -> DataFrame:
    """All updates, and each key's final record unless it repeats the last update in every payload field.

    Updates are never compared with each other: one that repeats its predecessor is
    emitted again.  Final rows are marked ``is_final`` and have no ``order``.
    """
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*payload), order).alias("__last"))
    checked = finals.join(last, keys, "left")
    same = F.col("__last").isNotNull() & F.col("__last").eqNullSafe(F.struct(*payload))
    closing = checked.filter(~same).select(
        *keys, F.lit(None).cast(updates.schema[order].dataType).alias(order), *payload, F.lit(True).alias("is_final")
    )
    return updates.select(*keys, order, *payload, F.lit(False).alias("is_final")).unionByName(closing)


def final_sizes(merged: DataFrame) -> DataFrame:
    """The final record of each merged transcript, in the measures of its updates.

    ``has_text`` tells whether the raw response names the whole text; updates never do.
    """
    chars, filled = F.length("text").cast("bigint"), F.col("text") != ""
    entries = F.size(F.try_variant_get(F.try_parse_json("raw_response"), "$.chunks", "array<variant>"))
    totals = merged.groupBy(*KEY).agg(
        F.sum(F.when(filled, chars + 1).otherwise(F.lit(0))).alias("chars"),
        F.sum(F.size("segments").cast("bigint")).alias("n_segments"),
        F.sum(entries.cast("bigint")).alias("n_entries"),
    )
    return totals.select(
        *KEY,
        F.greatest(F.col("chars") - 1, F.lit(0)).cast("bigint").alias("text_length"),
        "n_segments",
        "n_entries",
        (F.col("chars") > 0).alias("has_text"),
    )


def fold_events(events: DataFrame) -> DataFrame:
    """Fold event lines into partial texts, one row per emitted update.

    Pieces append until the key's first stop line.  The text of an update is
    the first ``raw_end`` characters of the key's concatenated pieces, stripped;
    its segments are the first ``n_segments`` stripped non-blank pieces.
    Nothing is emitted while everything so far is blank.
    """
    decoded = (
        events.filter(codec.may_matter(F.col("line")))
        .withColumn("event", codec.decode_event(F.col("line")))
        .select(*KEY, "seq", "event.is_stop", "event.piece")
    )
    filled = strip(F.col("piece")) != ""
    folded = running(
        decoded,
        KEY,
        "seq",
        {
            "stops": Fold("sum", F.col("is_stop").cast("bigint"), inclusive=False),
            "raw_end": Fold("sum", F.length("piece").cast("bigint")),
            "n_segments": Fold("sum", F.when(filled, 1).otherwise(0).cast("bigint")),
            "position": Fold("sum", F.when(F.col("piece").isNotNull(), 1).otherwise(0).cast("bigint"), False),
        },
    )
    live = folded.filter("stops = 0 AND piece IS NOT NULL AND NOT is_stop")
    return live.select(
        *KEY, "seq", "position", "piece", "raw_end", "n_segments", (F.col("n_segments") > 0).alias("emitted")
    )


def final_records(folded: DataFrame, closings: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """The final transcript of each streamed key, in parts: (KEY, part, text, segments, raw_response).

    ``closings`` has one row per key that was streamed, with the closing ``response``.
    An object decides segments and raw response, and its text if it has one;
    otherwise the text is that of all pieces, stripped, with no segments.
    """
    document = F.try_parse_json("response")
    is_object = F.coalesce(F.schema_of_variant(document).startswith("OBJECT"), F.lit(False))
    parsed = codec.normalise_response(F.col("response"))
    # A JSON null is no text.
    has_text = F.schema_of_variant(F.try_variant_get(document, "$.text", "variant")) != "VOID"
    named = closings.select(
        *KEY,
        F.when(is_object & has_text, parsed["text"]).alias("given"),
        F.when(is_object, parsed["segments"]).otherwise(F.array().cast(SEGMENTS)).alias("segments"),
        F.when(is_object, F.col("response")).alias("raw_response"),
    )
    filled = F.when(strip(F.col("piece")) != "", F.col("position"))
    bounds = folded.groupBy(*KEY).agg(F.min(filled).alias("__first"), F.max(filled).alias("__last"))
    # Blank pieces at both ends go as a whole, the outermost of the rest are stripped on their side.
    inner = folded.join(bounds, KEY).filter("position BETWEEN __first AND __last")
    cut = F.when(F.col("position") == F.col("__first"), lstrip(F.col("piece"))).otherwise(F.col("piece"))
    cut = F.when(F.col("position") == F.col("__last"), rstrip(cut)).otherwise(cut)
    texts = joined_pages(inner, KEY, "position", cut, "", "folded", page_rows)
    joined = named.join(texts, KEY, "left")
    # A text of the closing response is one value and stands in the first part.
    part = F.coalesce("part", F.lit(0)).cast("bigint")
    first = part == F.min(part).over(Window.partitionBy(*KEY))
    kept = joined.withColumn("__part", F.when(F.col("given").isNotNull(), F.lit(0).cast("bigint")).otherwise(part))
    return (
        kept.withColumn("__head", first)
        .filter("given IS NULL OR __head")
        .select(
            *KEY,
            F.col("__part").alias("part"),
            F.coalesce("given", "folded", F.lit("")).alias("text"),
            F.when(F.col("__head"), F.col("segments")).otherwise(F.array().cast(SEGMENTS)).alias("segments"),
            F.when(F.col("__head"), F.col("raw_response")).alias("raw_response"),
        )
    )


def folded_texts(folded: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """The concatenated pieces of each key; strip after joining all its parts."""
    return joined_pages(folded, KEY, "position", F.col("piece"), "", "raw_text", page_rows)


def _timed(segments: Column) -> Column:
    """One line per segment, with its times where it has both."""
    return F.transform(
        F.coalesce(segments, F.array().cast(SEGMENTS)),
        lambda s: F.when(
            s["start"].isNotNull() & s["end"].isNotNull(),
            F.concat(
                F.lit("  "), seconds(s["start"]), F.lit("-"), seconds(s["end"]), F.lit("s  "), s["text"]
            ),
        ).otherwise(F.concat(F.lit("  "), s["text"])),
    )


#: Pieces (parts of a transcript) that one row of a display text holds.
RENDER_PIECES = 64


def render_sessions(transcripts: DataFrame, pieces: int = RENDER_PIECES) -> DataFrame:
    """The display text of each session: its channels in code-point order.

    Takes one transcript per (session, channel) with all its parts.  A channel shows
    its header, the segments of all parts, then the text of all parts; each of
    these is a piece.  A display text of more than ``pieces`` goes on in further rows
    (``part`` 1, 2, …); the rows in order, joined by nothing, are the whole text.
    """
    shown = strip(F.col("text"))
    marks = transcripts.select(
        *KEY,
        "part",
        (F.size(F.coalesce("segments", F.array().cast(SEGMENTS))) > 0).alias("timed"),
        (shown != "").alias("spoken"),
    )
    # The order of pieces is settled on narrow rows: no task sorts the texts of a session.
    channel = Window.partitionBy(*KEY)
    marked = marks.withColumns(
        {
            "any_timed": F.max("timed").over(channel),
            "first_spoken": F.min(F.when(F.col("spoken"), F.col("part"))).over(channel),
        }
    )
    kinds = F.array(
        F.when((F.col("part") == 0) | F.col("timed"), F.lit(0)), F.when(F.col("spoken"), F.lit(1))
    )
    listed = marked.withColumn("kind", F.explode(F.filter(kinds, lambda k: k.isNotNull())))
    session = Window.partitionBy("session_id")
    order = session.orderBy("channel", "kind", "part")
    placed = listed.select(
        *KEY,
        "part",
        "kind",
        "any_timed",
        "first_spoken",
        (F.row_number().over(order) - 1).cast("bigint").alias("position"),
        F.count("*").over(session).alias("n"),
    )
    joined = transcripts.select(*KEY, "part", "text", "segments").join(placed, [*KEY, "part"])
    none = F.array().cast("array<string>")
    first = F.col("part") == 0
    header = F.when(first, F.array(F.concat(F.lit("["), F.col("channel"), F.lit("]")))).otherwise(none)
    lead = F.when(F.col("any_timed"), F.lit("  Full text:\n    ")).otherwise(F.lit("  "))
    body = F.when(F.col("part") == F.col("first_spoken"), F.concat(lead, shown)).otherwise(shown)
    piece = F.when(F.col("kind") == 0, F.array_join(F.concat(header, _timed(F.col("segments"))), "\n")).otherwise(body)
    gap = (
        F.when(F.col("position") == 0, F.lit(""))
        .when((F.col("kind") == 0) & first, F.lit("\n\n"))
        .otherwise(F.lit("\n"))
    )
    ended = F.when(F.col("position") == F.col("n") - 1, rstrip(piece)).otherwise(piece)
    rows = joined.select("session_id", "position", F.concat(gap, ended).alias("piece"))
    page = F.expr(f"position div {pieces}").alias("part")
    items = F.sort_array(F.collect_list(F.struct("position", "piece")))
    return rows.groupBy("session_id", page).agg(
        F.array_join(F.transform(items, lambda p: p["piece"]), "").alias("content")
    )
