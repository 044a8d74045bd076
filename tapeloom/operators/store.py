"""The session store: append-only logs, compacted into keyed tables.

Plain files know no row update, so each keyed write is an appended log row and
the table is the compaction of its log.  Compactions are single aggregations
with map-side partials, so a key written very often costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom import schemas

SAVE = "save"
UPDATE_MIX = "update_mix_path"

TABLES = {
    "session_log": schemas.SESSION_LOG,
    "transcripts": schemas.TRANSCRIPTS,
    "notes_log": schemas.NOTES_LOG,
}


def bootstrap(spark: SparkSession, location: str, database: str = "default") -> None:
    """Create the log tables where they do not exist yet; safe to repeat."""
    for name, schema in TABLES.items():
        columns = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" + ("" if f.nullable else " NOT NULL")
            for f in schema.fields
        )
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) "
            f"USING parquet LOCATION '{location}/{name}'"
        )


def checked(df: DataFrame, table: str) -> DataFrame:
    """Rows as the log has them; one that breaks a NOT NULL column is an error."""
    return df.select(
        *[
            F.when(F.col(f.name).isNull(), F.raise_error(F.lit(f"{table}.{f.name} is NULL")).cast(f.dataType))
            .otherwise(F.col(f.name))
            .cast(f.dataType)
            .alias(f.name)
            if not f.nullable
            else F.col(f.name).cast(f.dataType).alias(f.name)
            for f in TABLES[table].fields
        ]
    )


def append(df: DataFrame, location: str, table: str, batch: int | None = None) -> None:
    """Append rows to a log; rows breaking a NOT NULL column are an error.

    Rows of a numbered batch have a folder of their own, which a repeated batch replaces.
    """
    rows = checked(df, table).write
    if batch is None:
        rows.mode("append").parquet(f"{location}/{table}")
    else:
        rows.mode("overwrite").parquet(f"{location}/{table}/batch={batch}")


def bootstrap_folder(spark: SparkSession, location: str, table: str) -> None:
    """An empty log where there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{location}/{table}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        files.mkdirs(folder)


def read_log(
    spark: SparkSession, location: str, table: str, before: int | None = None, only: int | None = None
) -> DataFrame:
    """All rows of a log, or those of the batches ``before`` one, or of one batch ``only``."""
    names = [f.name for f in TABLES[table].fields]
    if before is None and only is None:
        return spark.read.schema(TABLES[table]).parquet(f"{location}/{table}").select(*names)
    numbered = T.StructType([*TABLES[table].fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(numbered).parquet(f"{location}/{table}")
    wanted = F.col("batch") == only if only is not None else F.coalesce(F.col("batch") < before, F.lit(True))
    return rows.filter(wanted).select(*names)


def numbered_transcripts(results: DataFrame, order: list[str], log: DataFrame | None = None) -> DataFrame:
    """New transcripts as rows of the log: ``row_id`` and ``transcript_id`` go on where the session's log ends.

    ``results`` has one row per (session, target, part); ``order`` names the columns
    that order the targets of a session.  Parts of the log count from 0 without holes.
    Only narrow rows are numbered.
    """
    targets = results.select("session_id", *order, "part")
    session = Window.partitionBy("session_id").orderBy(*order, "part")
    target = Window.partitionBy("session_id", *order)
    placed = targets.withColumn("row_id", F.row_number().over(session).cast("bigint"))
    placed = placed.withColumn("transcript_id", F.min("row_id").over(target))
    placed = placed.withColumn("__part", F.col("row_id") - F.col("transcript_id"))
    if log is not None:
        ends = log.groupBy("session_id").agg(F.max("row_id").alias("__end"))
        end = F.coalesce("__end", F.lit(0))
        placed = placed.join(ends, "session_id", "left").withColumns(
            {"row_id": F.col("row_id") + end, "transcript_id": F.col("transcript_id") + end}
        ).drop("__end")
    numbered = results.join(placed, ["session_id", *order, "part"])
    return numbered.withColumn("part", F.col("__part")).drop("__part")


def append_transcripts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Transcripts are only ever appended; a repeated channel adds a row."""
    return existing.unionByName(new)


def last_writes(log: DataFrame) -> DataFrame:
    """The rows of a session log that still matter: the last of each (id, op)."""
    row = F.struct(*[f.name for f in schemas.SESSION_LOG if f.name not in ("id", "op")])
    newest = log.groupBy("id", "op").agg(F.max_by(row, "seq").alias("row"))
    return newest.select("id", "op", "row.*")


def first_and_last_notes(log: DataFrame) -> DataFrame:
    """The rows of a notes log (or of some of its columns) that still matter: the first (its identity) and
    the last of each session."""
    row = F.struct(*[name for name in log.columns if name != "session_id"])
    ends = log.groupBy("session_id").agg(F.min_by(row, "seq").alias("first"), F.max_by(row, "seq").alias("last"))
    both = F.when(F.col("first.seq") < F.col("last.seq"), F.array("first", "last")).otherwise(F.array("last"))
    return ends.select("session_id", F.explode(both).alias("row")).select("session_id", "row.*")


def last_numbers(numbers: DataFrame) -> DataFrame:
    """The last ``row_id`` of each session."""
    return numbers.groupBy("session_id").agg(F.max("row_id").alias("row_id"))


def _last(value: Column, condition: Column) -> Column:
    return F.max_by(value, F.when(condition, F.col("seq")))


def compact_sessions(log: DataFrame) -> DataFrame:
    """Sessions after all writes of the log.

    The last save replaces the row whole, so it also clears an older mix path.
    An update counts only when it comes after the last save of its id; the
    latest update decides, since every earlier one was overwritten by it.
    ``seq`` is unique inside an id, so the fields of one row stay together; each
    is an aggregate of its own, and a reader of one field scans only that one.
    """
    fields = [f.name for f in schemas.SESSION_FIELDS if f.name != "mix_path"]
    is_save, is_update = F.col("op") == SAVE, F.col("op") == UPDATE_MIX
    folded = log.groupBy("id").agg(
        *[_last(F.col(name), is_save).alias(name) for name in fields],
        _last(F.col("mix_path"), is_save).alias("saved_mix"),
        F.max(F.when(is_save, F.col("seq"))).alias("saved_at"),
        _last(F.col("mix_path"), is_update).alias("updated_mix"),
        F.max(F.when(is_update, F.col("seq"))).alias("updated_at"),
    )
    mix = F.when(F.col("updated_at") > F.col("saved_at"), F.col("updated_mix")).otherwise(F.col("saved_mix"))
    return folded.filter("saved_at IS NOT NULL").select(
        "id", *fields, F.nullif(mix, F.lit("")).alias("mix_path")
    )


def compact_notes(log: DataFrame) -> DataFrame:
    """One row per session: identity of the first write, values of the last."""
    folded = log.groupBy("session_id").agg(
        F.min("seq").alias("row_id"),
        *[F.max_by(name, "seq").alias(name) for name in ("title", "summary", "action_items")],
    )
    items = F.coalesce("action_items", F.array().cast(T.ArrayType(T.StringType())))
    return folded.select("row_id", "session_id", "title", "summary", items.alias("action_items"))


def lookup(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose key is wanted; ``wanted`` holds the key column."""
    return table.join(wanted.select(key).distinct(), key, "left_semi")


def fetch_transcripts(transcripts: DataFrame, wanted: DataFrame) -> DataFrame:
    """All transcript rows of the wanted sessions, in write order."""
    return lookup(transcripts, wanted, "session_id").orderBy("row_id", "session_id")


def list_sessions(sessions: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first; no limit when ``limit`` is None or negative."""
    ordered = sessions.orderBy(F.col("created_at").desc(), F.col("id"))
    return ordered if limit is None or limit < 0 else ordered.limit(limit)


def newest_session(sessions: DataFrame) -> DataFrame:
    return list_sessions(sessions, 1)


def latest_per_channel(transcripts: DataFrame) -> DataFrame:
    """The last written transcript of each (session, channel), with all its parts."""
    key = ["session_id", "channel"]
    newest = transcripts.groupBy(*key).agg(F.max_by("transcript_id", "row_id").alias("transcript_id"))
    return transcripts.join(newest, [*key, "transcript_id"], "left_semi")


def session_outcomes(
    sessions: DataFrame, transcripts: DataFrame, notes: DataFrame, few: bool = False
) -> DataFrame:
    """Sessions with their latest transcripts (one row per channel and part) and notes.

    Sessions without transcripts or notes keep one row with NULLs.  With ``few`` the
    sessions are a small part of the store: both tables are cut down to them
    first, so that nothing else is compacted or joined.
    """
    if few:
        wanted = sessions.select(F.col("id").alias("session_id"))
        transcripts, notes = lookup(transcripts, wanted, "session_id"), lookup(notes, wanted, "session_id")
    latest = latest_per_channel(transcripts).select(
        F.col("session_id").alias("id"), "channel", "part", "text", "segments"
    )
    noted = notes.select(
        F.col("session_id").alias("id"), "title", "summary", "action_items"
    )
    return sessions.join(noted, "id", "left").join(latest, "id", "left")


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child keys without a parent, with their row counts.

    Children are counted per key first, so a hot key meets the join as one row.
    """
    counted = (
        child.filter(F.col(child_key).isNotNull())
        .groupBy(F.col(child_key).cast("string").alias("key"))
        .agg(F.count("*").alias("n_rows"))
    )
    known = parent.select(F.col(parent_key).cast("string").alias("key"))
    return counted.join(known, "key", "left_anti")


def key_audit(
    table: str,
    df: DataFrame,
    required: list[str],
    unique: str | None = None,
    references: list[tuple[str, str, DataFrame, str]] = (),
) -> DataFrame:
    """Violations of the declared keys: ``(table, rule, key, n_rows)``.

    ``references`` lists ``(column, parent name, parent, parent key)``.  NULL
    counts take one pass over the table for all required columns.
    """
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    stacked = nulls.unpivot([], required, "key", "n_rows").select(
        F.lit("not_null").alias("rule"), "key", "n_rows"
    )
    found = stacked.filter("n_rows > 0")
    if unique:
        repeated = (
            df.groupBy(F.col(unique).cast("string").alias("key"))
            .agg(F.count("*").alias("n_rows"))
            .filter("n_rows > 1")
        )
        found = found.unionByName(repeated.select(F.lit("unique").alias("rule"), "key", "n_rows"))
    for column, parent_name, parent, parent_key in references:
        missing = orphans(df, column, parent, parent_key)
        rule = F.lit(f"references {parent_name}").alias("rule")
        found = found.unionByName(missing.select(rule, "key", "n_rows"))
    return found.select(F.lit(table).alias("table"), "rule", "key", "n_rows")
