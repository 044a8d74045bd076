"""Capture-device values: normalising, recommended specs and spec parsing."""

from __future__ import annotations

import shlex

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.pcm import CAPTURE_FORMATS
from tapeloom.functions.text import strip

# Words that switch a device off or leave it to the default, the
# marker of a disabled device, the default sample format and the option prefixes
# of a device spec.
DISABLED_WORDS = ["skip", "none", "off", "disabled"]
DEFAULT_WORDS = ["default", "auto"]
DISABLED_MARK = ":disabled:"
DEFAULT_SAMPLE_FORMAT = "f32le"
INPUT_OPTION, INPUT_FLAG, OUTPUT_OPTION, OUTPUT_FLAG = "opt_", "flag_", "out_opt_", "out_flag_"

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"
_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def normalise_value(value: Column) -> Column:
    """A configured device: NULL for the default, a marker when switched off."""
    text = strip(value)
    word = F.lower(text)
    return (
        F.when((text == "") | word.isin(DEFAULT_WORDS), F.lit(None).cast("string"))
        .when(word.isin(DISABLED_WORDS), F.lit(DISABLED_MARK))
        .otherwise(text)
    )


def is_disabled(value: Column) -> Column:
    return F.coalesce(
        (value == DISABLED_MARK) | F.lower(strip(value)).isin(DISABLED_WORDS), F.lit(False)
    )


# The helpers below name each input once: filters on parsed fields are pushed
# down by substitution, and repeated inputs would multiply at every step.


def quoted_name(name: Column) -> Column:
    """A name in double quotes, inner ones escaped; an outer pair is not doubled."""
    inner = F.regexp_replace(strip(name), '(?s)^"(.*)"$', "$1")
    return F.concat(F.lit('"'), F.replace(inner, F.lit('"'), F.lit('\\"')), F.lit('"'))


def unquoted(value: Column) -> Column:
    """Drop one pair of wrapping quotes, then unescape the inner ones."""
    inner = F.regexp_replace(strip(value), "(?s)^([\"'])(.*)\\1$", "$2")
    return F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\'"), F.lit("'"))


def after_first(text: Column, mark: str) -> Column:
    """Text behind the first ``mark``, one punctuation sign; NULL without one."""
    return F.get(F.split(text, "\\" + mark, 2), F.lit(1))


def recommended_spec(input_format: Column, index: Column, name: Column, details: Column) -> Column:
    """The capture spec to use for a listed device; NULL when nothing identifies it."""
    kind = F.lower(strip(F.coalesce(input_format, F.lit(""))))
    detail, label = strip(F.coalesce(details, F.lit(""))), F.coalesce(name, F.lit(""))
    prefixed = F.lower(detail).startswith("audio=")
    identity = F.when(prefixed, after_first(detail, "=")).otherwise(detail)
    shown = F.when(F.coalesce(details, F.lit("")) != "", details).otherwise(label)
    return (
        F.when(kind == "", F.lit(None).cast("string"))
        .when((kind == "dshow") & (detail != ""), F.concat(F.lit("dshow:audio="), quoted_name(identity)))
        .when((kind == "dshow") & (label != ""), F.concat(F.lit("dshow:audio="), quoted_name(label)))
        .when(kind == "avfoundation", F.concat(F.lit("avfoundation:"), index.cast("string")))
        .when((kind == "pulse") & (strip(shown) != ""), F.concat(F.lit("pulse:"), strip(shown)))
        .when(~kind.isin("dshow", "pulse") & (label != ""), F.concat(kind, F.lit(":"), label))
    )


def has_scheme(text: Column) -> Column:
    return text.rlike(_SCHEME)


def scheme_of(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, _SCHEME, 1))


def is_index(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def guessed_target(base: Column, platform: Column, listed_name: Column) -> Column:
    """A spec for a device given without input format, as the platform implies."""
    named = F.lower(base).startswith("audio=")
    name = F.when(named, F.substring(base, 7, 2**31 - 1)).otherwise(F.coalesce(listed_name, base))
    return F.when(
        base != "",
        F.when(platform == "windows", F.concat(F.lit("dshow:audio="), quoted_name(name)))
        .when((platform == "darwin") & is_index(base), F.concat(F.lit("avfoundation:"), base))
        .when(platform == "linux", F.concat(F.lit("pulse:"), base)),
    )


def input_target(input_format: Column, target: Column) -> Column:
    text = strip(target)
    value = after_first(text, "=")
    keyed = F.concat(F.substring_index(text, "=", 1), F.lit("="), strip(unquoted(value)))
    return F.when((input_format == "dshow") & value.isNotNull(), keyed).otherwise(unquoted(text))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def query_items(query: Column) -> Column:
    """``k=v&…`` as an array of ``struct<key, value>`` in order, blanks kept."""
    parts = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            _decoded(F.substring_index(p, "=", 1)).alias("key"),
            _decoded(F.coalesce(after_first(p, "="), F.lit(""))).alias("value"),
        ),
    )


def as_integer(text: Column) -> Column:
    """A whole number, or NULL when the text is none."""
    digits = F.regexp_extract(strip(text), _INTEGER, 0)
    return F.replace(digits, F.lit("_"), F.lit("")).try_cast("bigint")


def as_decimal(text: Column) -> Column:
    return F.regexp_extract(strip(text), _DECIMAL, 0).try_cast("double")


def last_value(items: Column, key: str) -> Column:
    """The last non-empty value of an option."""
    given = F.filter(items, lambda i: (i["key"] == key) & (i["value"] != ""))
    return F.try_element_at(given, F.lit(-1))["value"]


_TYPED = ["sample_rate", "channels", "chunk_frames", "chunk_ms"]
_GIVEN = ["sample_fmt", "args", "out_args"]


def item_error(item: Column, split_words: Column) -> Column:
    """What is wrong with one option; NULL when it is fine."""
    key, value = item["key"], item["value"]
    number = F.when(key == "chunk_ms", as_decimal(value).isNotNull()).otherwise(as_integer(value).isNotNull())
    free = (key == "") | key.rlike("^(opt_|flag_|out_opt_|out_flag_)")
    return (
        F.when(key.isin(_TYPED) & (value != ""), F.when(~number, F.concat(F.lit("invalid "), key, F.lit(": "), value)))
        .when(key.isin("args", "out_args") & (value != ""), F.when(split_words.isNull(), F.lit("unbalanced quotes")))
        .when(key.isin(_GIVEN) & (value != ""), F.lit(None).cast("string"))
        .when(~free, F.concat(F.lit("unknown option: "), key))
    )


def item_arguments(item: Column, split_words: Column, words_key: str, option: str, flag: str) -> Column:
    """Command-line words of one option on the input or the output side."""
    key, value = item["key"], item["value"]

    def dashed(prefix: str) -> Column:
        rest = F.substring(key, len(prefix) + 1, 2**31 - 1)
        return F.concat(F.lit("-"), F.replace(rest, F.lit("_"), F.lit("-")))

    return (
        F.when((key == words_key) & (value != ""), split_words)
        .when(key.startswith(option), F.when(value != "", F.array(dashed(option), value)).otherwise(F.array(dashed(option))))
        .when(key.startswith(flag), F.array(dashed(flag)))
        .otherwise(F.array().cast("array<string>"))
    )


def words_to_split(items: Column) -> Column:
    return F.transform(items, lambda i: F.when(i["key"].isin("args", "out_args"), i["value"]))


def _shell_words(value: str | None) -> list[str] | None:
    try:
        return None if value is None else shlex.split(value)
    except ValueError:
        return None


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def shell_split(values: pa.Array) -> pa.Array:
    """Shell-quoted texts to words; NULL for NULL and for unbalanced quotes."""
    rows = [[_shell_words(v) for v in row] if row is not None else None for row in values.to_pylist()]
    return pa.array(rows, pa.list_(pa.list_(pa.string())))


# Declared so that filters stay above it: pushed below, they would parse twice.
shell_split = shell_split.asNondeterministic()


def known_format(name: Column) -> Column:
    return name.isin(list(CAPTURE_FORMATS))
