"""JSON text <-> nested columns, response normalising and event-line decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.functions.text import strip
from tapeloom.schemas import PATHS, SEGMENT, SEGMENTS

# The event vocabulary of a streamed transcription.
DATA_PREFIX = "data:"
DONE_LINE = "DATA: [DONE]"
DONE_PAYLOAD = "[DONE]"
DELTA_EVENT = "transcript.text.delta"
DONE_EVENT = "transcript.text.done"
COMPLETED_EVENT = "response.completed"


def paths_to_json(paths: Column) -> Column:
    return F.to_json(F.coalesce(paths, F.create_map().cast(PATHS)))


def paths_from_json(text: Column) -> Column:
    return F.from_json(text, PATHS)


def segments_to_json(segments: Column) -> Column:
    """Null times are written as explicit nulls; no segments give ``[]``."""
    filled = F.coalesce(segments, F.array().cast(SEGMENTS))
    return F.to_json(filled, {"ignoreNullFields": "false"})


def segments_from_json(text: Column) -> Column:
    parsed = F.from_json(F.nullif(text, F.lit("")), SEGMENTS)
    return F.coalesce(parsed, F.array().cast(SEGMENTS))


def items_to_json(items: Column) -> Column:
    return F.to_json(F.coalesce(items, F.array().cast("array<string>")))


def items_from_json(text: Column) -> Column:
    parsed = F.from_json(F.nullif(text, F.lit("")), "array<string>")
    return F.coalesce(parsed, F.array().cast("array<string>"))


def raw_to_store(raw: Column) -> Column:
    """An absent or empty object is stored as NULL."""
    return F.when(F.to_json(F.try_parse_json(raw)) == "{}", F.lit(None)).otherwise(raw)


def raw_from_store(raw: Column) -> Column:
    """Stored JSON as VARIANT; NULL for NULL, empty or unreadable text."""
    return F.try_parse_json(F.nullif(raw, F.lit("")))


def _plain_text(value: Column) -> Column:
    """Text of a scalar variant; null, false, zero and empty give ``''``."""
    kind = F.schema_of_variant(value)
    as_text = F.try_variant_get(value, "$", "string")
    as_number = F.try_variant_get(value, "$", "double")
    return (
        F.when(value.isNull() | (kind == "VOID"), F.lit(""))
        .when(kind == "STRING", as_text)
        .when(kind == "BOOLEAN", F.when(as_text == "true", F.lit("True")).otherwise(F.lit("")))
        .when(as_number == 0.0, F.lit(""))
        .otherwise(F.coalesce(as_text, F.to_json(value), F.lit("")))
    )


def _segment(value: Column) -> Column:
    """A segment from an object, or from a scalar that is its text."""
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    text = F.when(is_object, _plain_text(F.try_variant_get(value, "$.text", "variant"))).otherwise(
        _plain_text(value)
    )
    return F.struct(
        F.when(is_object, F.try_variant_get(value, "$.start", "double")).alias("start"),
        F.when(is_object, F.try_variant_get(value, "$.end", "double")).alias("end"),
        strip(text).alias("text"),
    ).cast(SEGMENT)


def normalise_response(response: Column) -> Column:
    """A stored response as ``struct<text, segments, raw_response>``.

    A JSON object carries ``text`` and maybe a list of ``segments``; anything
    else is a bare text.  Blank text is kept as it is, segment texts are stripped.
    """
    # Read as an only list element: text behind the object makes it a bare text.
    listed = F.try_parse_json(F.concat(F.lit("["), response, F.lit("]")))
    document = F.try_variant_get(listed, "$[0]", "variant")
    is_object = (
        F.btrim(response, F.lit(" \t\r\n")).startswith("{")
        & document.isNotNull()
        & F.try_variant_get(listed, "$[1]", "variant").isNull()
    )
    segments = F.try_variant_get(document, "$.segments", "array<variant>")
    empty = F.array().cast(SEGMENTS)
    text = (
        F.when(response.isNull(), F.lit(""))
        .when(is_object, _plain_text(F.try_variant_get(document, "$.text", "variant")))
        .otherwise(response)
    )
    bare = F.when(
        response.isNotNull() & (response != ""), F.to_json(F.struct(response.alias("text")))
    )
    return F.struct(
        text.alias("text"),
        F.when(is_object, F.coalesce(F.transform(segments, _segment), empty)).otherwise(empty).alias("segments"),
        F.when(is_object, response).otherwise(bare).alias("raw_response"),
    )


_EVENT_DDL = "array<struct<type:string,delta:string,text:string>>"


def may_matter(line: Column) -> Column:
    """Cheap pre-filter: drops lines that can neither append nor stop."""
    return line.startswith(DATA_PREFIX) | (F.upper(strip(line)) == DONE_LINE)


def decode_event(line: Column) -> Column:
    """An event line as ``struct<is_stop, piece>``; ``piece`` is NULL for noise.

    Lines that are blank, comments, not data or not a JSON object are noise.  A
    JSON ``null`` text counts as absent.
    """
    payload = F.when(
        line.startswith(DATA_PREFIX), strip(F.substring(line, len(DATA_PREFIX) + 1, 2**31 - 1))
    )
    # As an only list element, text behind the object makes it unreadable.
    listed = F.from_json(F.concat(F.lit("["), payload, F.lit("]")), _EVENT_DDL)
    event = F.when(F.size(listed) == 1, F.get(listed, F.lit(0)))
    piece = F.when(event["type"] == DELTA_EVENT, event["delta"]).when(
        event["type"] == DONE_EVENT, event["text"]
    )
    ended = (F.upper(strip(line)) == DONE_LINE) | F.coalesce(
        event["type"] == COMPLETED_EVENT, F.lit(False)
    )
    return F.struct(
        F.coalesce(ended, F.lit(False)).alias("is_stop"),
        F.nullif(piece, F.lit("")).alias("piece"),
    )
