"""Fleet device logs: listings to inventories, spec strings to audited fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import device
from tapeloom.functions.text import strip
from tapeloom.operators.ordered import Fold, windowed

# The marks of the listing formats.
AUDIO_HEADER = "{} audio devices"
VIDEO_HEADER = "{} video devices"
ALTERNATIVE_NAME = r'(?iU)alternative name\s*:?-?\s*"([^"]+)"'
QUOTED_NAME = r'"([^"]+)"'
AUDIO_TAG = "(audio"
BRACKETED_DEVICE = r"(?Us)^\[([0-9]+)\]\s*(.+)"
SOURCE_OPENER = r"(?iU)^source\s*#([0-9]+)"
NUMBERED_OPENER = r"(?Us)^([0-9]+):\s*(.+)"
SPEC_CHANNELS = r"([0-9]+)ch"
SPEC_RATE = r"(?i)([0-9]+)hz"


def _payload(line: Column) -> Column:
    """Text behind the first closing bracket, or the whole line."""
    return strip(F.coalesce(device.after_first(line, "]"), line))


def _lines(listings: DataFrame, platform: str) -> DataFrame:
    chosen = listings.filter(F.col("platform") == platform)
    return (
        chosen.select("host", "line_no", _payload(F.col("line")).alias("payload"))
        .filter("payload <> ''")
        .withColumn("lowered", F.lower("payload"))
    )


def _matched(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _section(name: str) -> Column:
    """TRUE or FALSE on a section header, NULL elsewhere."""
    lowered = F.col("lowered")
    return F.when(lowered.contains(AUDIO_HEADER.format(name)), F.lit(True)).when(
        lowered.contains(VIDEO_HEADER.format(name)), F.lit(False)
    )


def _inventory(devices: DataFrame, input_format: str) -> DataFrame:
    return devices.select(
        "host",
        F.col("index").cast("bigint").alias("index"),
        "name",
        F.lit(input_format).alias("input_format"),
        F.col("channels").cast("bigint").alias("channels"),
        F.col("sample_rate").cast("bigint").alias("sample_rate"),
        F.col("details").cast("string").alias("details"),
        F.col("line_no"),
    )


def dshow_inventory(listings: DataFrame) -> DataFrame:
    """Devices of quoted-name listings, numbered in order per host.

    A name counts inside the audio section or with an audio tag.  An alternative
    name belongs to the last device that counted; before any, it is read like
    any other quoted name.
    """
    lines = _lines(listings, "windows").withColumn("header", _section("directshow"))
    marked = windowed(lines, ["host"], "line_no", {"in_audio": Fold("last", F.col("header"))})
    named = (
        marked.filter("header IS NULL")
        .withColumn("name", _matched(F.col("payload"), QUOTED_NAME))
        .withColumn("alternative", _matched(F.col("payload"), ALTERNATIVE_NAME))
        .filter("name IS NOT NULL")
        .withColumn("counts", F.coalesce("in_audio", F.lit(False)) | F.col("lowered").contains(AUDIO_TAG))
        .withColumn("is_alternative", F.col("alternative").isNotNull())
        .filter("counts OR is_alternative")
    )
    # Devices so far: every plain name that counts, and an alternative name only
    # when it is the very first line that counts.
    numbered = windowed(
        named,
        ["host"],
        "line_no",
        {
            "plain": Fold("sum", F.when(F.col("counts") & ~F.col("is_alternative"), 1).otherwise(0).cast("bigint")),
            "opened_by": Fold("first", F.when(F.col("counts"), F.struct("line_no", "is_alternative"))),
        },
    ).filter("opened_by IS NOT NULL")
    by_alternative = F.col("opened_by.is_alternative")
    opens = F.col("counts") & (~F.col("is_alternative") | (F.col("opened_by.line_no") == F.col("line_no")))
    ordinal = F.col("plain") + by_alternative.cast("bigint") - 1
    marked_devices = numbered.select("host", "line_no", "name", "alternative", opens.alias("opens"), ordinal.alias("index"))
    detail = ~F.col("opens")
    devices = marked_devices.groupBy("host", "index").agg(
        F.max(F.when(F.col("opens"), F.col("name"))).alias("name"),
        F.min(F.when(F.col("opens"), F.col("line_no"))).alias("line_no"),
        F.max_by("alternative", F.when(detail, F.col("line_no"))).alias("details"),
    )
    empty = F.lit(None).cast("bigint")
    return _inventory(devices.withColumn("channels", empty).withColumn("sample_rate", empty), "dshow")


def avfoundation_inventory(listings: DataFrame) -> DataFrame:
    """Devices of bracketed listings: ``[index] name`` lines of the audio section."""
    lines = _lines(listings, "darwin").withColumn("header", _section("avfoundation"))
    marked = windowed(lines, ["host"], "line_no", {"in_audio": Fold("last", F.col("header"))})
    devices = marked.filter("header IS NULL AND in_audio").select(
        "host",
        "line_no",
        _matched(F.col("payload"), BRACKETED_DEVICE).alias("index"),
        strip(F.regexp_extract("payload", BRACKETED_DEVICE, 2)).alias("name"),
        F.lit(None).alias("channels"),
        F.lit(None).alias("sample_rate"),
        F.lit(None).alias("details"),
    )
    return _inventory(devices.filter("index IS NOT NULL"), "avfoundation")


def pulse_inventory(listings: DataFrame) -> DataFrame:
    """Devices of source listings, with attributes from the lines below each.

    Lines count from the first ``sources`` heading to the first ``sinks`` one.
    """
    payload, lowered = F.col("payload"), F.col("lowered")
    lines = (
        _lines(listings, "linux")
        .withColumn("sources", lowered.startswith("sources"))
        .withColumn("sinks", ~F.col("sources") & lowered.startswith("sinks"))
        .withColumn("numbered", _matched(payload, NUMBERED_OPENER))
        .withColumn("index", F.coalesce(_matched(payload, SOURCE_OPENER), F.col("numbered")))
    )

    def count(condition: Column) -> Fold:
        return Fold("sum", F.when(condition, 1).otherwise(0).cast("bigint"))

    placed = windowed(
        lines,
        ["host"],
        "line_no",
        {
            "n_sources": count(F.col("sources")),
            "n_sinks": count(F.col("sinks")),
            "group": count(F.col("sources") | F.col("index").isNotNull()),
        },
    ).filter("n_sources > 0 AND n_sinks = 0 AND NOT sources")
    opens = F.col("index").isNotNull()
    value = strip(device.after_first(payload, ":"))

    def attribute(label: str, found: Column) -> Column:
        return F.when(~opens & lowered.startswith(label), F.nullif(found, F.lit("")))

    parsed = placed.select(
        "host",
        "group",
        "line_no",
        opens.alias("opens"),
        "index",
        F.when(F.col("numbered").isNotNull(), strip(F.regexp_extract("payload", NUMBERED_OPENER, 2))).alias("given"),
        attribute("name:", value).alias("raw"),
        attribute("description:", value).alias("description"),
        attribute("sample spec:", F.regexp_extract(value, SPEC_CHANNELS, 1)).try_cast("bigint").alias("spec_channels"),
        attribute("sample spec:", F.regexp_extract(value, SPEC_RATE, 1)).try_cast("bigint").alias("spec_rate"),
        device.as_integer(attribute("channels:", F.get(F.split(value, r"(?U)\s+"), F.lit(0)))).alias("plain_channels"),
    )

    def pick(by, name: str) -> Column:
        return by(name, F.when(F.col(name).isNotNull(), F.col("line_no")))

    devices = (
        parsed.groupBy("host", "group")
        .agg(
            F.max("index").alias("index"),
            F.max("given").alias("given"),
            F.min(F.when(F.col("opens"), F.col("line_no"))).alias("line_no"),
            pick(F.min_by, "raw").alias("first_raw"),
            pick(F.max_by, "raw").alias("last_raw"),
            pick(F.max_by, "description").alias("description"),
            pick(F.max_by, "spec_channels").alias("spec_channels"),
            pick(F.max_by, "spec_rate").alias("sample_rate"),
            pick(F.min_by, "plain_channels").alias("plain_channels"),
        )
        .filter("index IS NOT NULL")
    )
    name = F.coalesce("description", "given", "first_raw", F.lit(""))
    raw = F.coalesce("last_raw", "given")
    return _inventory(
        devices.select(
            "host",
            "index",
            name.alias("name"),
            F.coalesce("spec_channels", "plain_channels").alias("channels"),
            "sample_rate",
            F.when(raw != name, raw).alias("details"),
            "line_no",
        ),
        "pulse",
    )


def inventory(listings: DataFrame) -> DataFrame:
    """All platforms together."""
    parts = [dshow_inventory(listings), avfoundation_inventory(listings), pulse_inventory(listings)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def by_index(devices: DataFrame) -> DataFrame:
    """Display order: by host and index, equal indexes in listing order."""
    return devices.orderBy("host", "index", "line_no")


def with_recommended_spec(devices: DataFrame) -> DataFrame:
    spec = device.recommended_spec(F.col("input_format"), F.col("index"), F.col("name"), F.col("details"))
    return devices.withColumn("recommended", spec)


def parse_specs(specs: DataFrame, devices: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Parse capture specs into typed fields, with an ``error`` column.

    ``devices`` resolves bare numbers on windows hosts to listed names.  Parsing costs
    far more than moving the short texts: ``tasks`` deals them out where a scan brings
    them in few pieces.
    """
    if tasks:
        specs = specs.repartition(tasks, "host", "channel")
    text = strip(F.col("device"))
    based = specs.withColumn("given", text).withColumn(
        "base", strip(F.substring_index(F.col("given"), "?", 1))
    )
    lookup = (
        F.when((F.col("platform") == "windows") & ~device.has_scheme(F.col("given")) & device.is_index(F.col("base")), F.col("base"))
        .try_cast("bigint")
    )
    if devices is None:
        named = based.withColumn("listed_name", F.lit(None).cast("string"))
    else:
        names = devices.groupBy("host", F.col("index").alias("__index")).agg(
            F.min_by("name", "line_no").alias("listed_name")
        )
        named = based.withColumn("__index", lookup).join(names, ["host", "__index"], "left").drop("__index")
    query_text = device.after_first(F.col("given"), "?")
    guess = device.guessed_target(F.col("base"), F.col("platform"), F.nullif("listed_name", F.lit("")))
    guessed = F.concat(guess, F.coalesce(F.concat(F.lit("?"), query_text), F.lit("")))
    full = F.when(device.has_scheme(F.col("given")), F.col("given")).otherwise(guessed)
    split = (
        named.withColumn("full", F.translate(full, "\t\r\n", ""))
        .withColumn("input_format", F.nullif(device.scheme_of(F.col("full")), F.lit("")))
        .withColumn("rest", F.regexp_replace(device.after_first(F.col("full"), ":"), "^//", ""))
        .withColumn("rest", F.substring_index("rest", "#", 1))
        .withColumn("input_target", device.input_target(F.col("input_format"), F.substring_index("rest", "?", 1)))
        .withColumn("items", device.query_items(device.after_first(F.col("rest"), "?")))
        .withColumn("words", device.shell_split(device.words_to_split(F.col("items"))))
    )
    items = F.col("items")
    option_errors = F.zip_with(items, F.col("words"), device.item_error)

    def arguments(words_key: str, option: str, flag: str) -> Column:
        return F.flatten(
            F.zip_with(items, F.col("words"), lambda i, w: device.item_arguments(i, w, words_key, option, flag))
        )

    given_frames = device.as_integer(device.last_value(items, "chunk_frames"))
    milliseconds = device.as_decimal(device.last_value(items, "chunk_ms"))
    typed = split.select(
        *specs.columns,
        "input_format",
        "input_target",
        F.coalesce(device.as_integer(device.last_value(items, "sample_rate")), F.col("default_sample_rate")).cast("bigint").alias("sample_rate"),
        F.coalesce(device.as_integer(device.last_value(items, "channels")), F.col("default_channels")).cast("bigint").alias("channels"),
        F.lower(F.coalesce(device.last_value(items, "sample_fmt"), F.lit(device.DEFAULT_SAMPLE_FORMAT))).alias("sample_format"),
        given_frames.alias("given_frames"),
        milliseconds.alias("milliseconds"),
        arguments("args", device.INPUT_OPTION, device.INPUT_FLAG).alias("args_before_input"),
        arguments("out_args", device.OUTPUT_OPTION, device.OUTPUT_FLAG).alias("args_after_input"),
        option_errors.alias("option_errors"),
    )
    before = (
        F.when(F.coalesce(F.col("device"), F.lit("")) == "", F.lit("no device given"))
        .when(F.col("input_format").isNull(), F.lit("no input format"))
        .when(F.coalesce(F.col("input_target"), F.lit("")) == "", F.lit("no device identifier"))
    )
    after = (
        F.when(F.col("sample_rate") <= 0, F.lit("sample_rate is not positive"))
        .when(F.col("channels") <= 0, F.lit("channels is not positive"))
        .when(~device.known_format(F.col("sample_format")), F.lit("unknown sample format"))
    )
    # The first error found.  As one array it is filtered in one piece and not
    # taken apart and pushed through all the steps above.
    errors = F.concat(F.array(before), F.col("option_errors"), F.array(after))
    error = F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0))
    # NULL stays NULL: greatest() alone would turn it into the other value.
    from_time = F.floor(F.col("sample_rate") * (F.greatest("milliseconds", F.lit(0.0)) / 1000.0))
    wanted = F.coalesce("given_frames", F.when(F.col("milliseconds").isNotNull(), from_time))
    frames = F.when(wanted.isNotNull(), F.greatest(wanted, F.lit(1))).cast("bigint")
    checked = typed.withColumn("chunk_frames", frames).withColumn("error", error).drop(
        "given_frames", "milliseconds", "option_errors"
    )
    fields = [
        "input_format",
        "input_target",
        "sample_rate",
        "channels",
        "sample_format",
        "chunk_frames",
        "args_before_input",
        "args_after_input",
    ]
    spec = F.when(F.col("error").isNull(), F.struct(*fields))
    return checked.select(*specs.columns, "error", spec.alias("spec")).select(
        *specs.columns, "spec.*", "error"
    )
