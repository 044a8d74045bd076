"""A ledger of backend answers: no upload chunk is paid for twice.

Answers are keyed by session, channel, chunk and a digest of what the backend is given.
A run asks for the chunks without an answer only.  A task writes the answers of each call as
one packed journal file the moment it has them, so a task that is repeated finds them there; a run
that follows a failed one first commits what that run's tasks had.  A finished run commits its
answers as one table and removes its journals.  A chunk whose call keeps failing gives a row with an
``error`` and no response: it is asked for again by the next run, and no other chunk is.

Chunks meet the ledger in one shuffle, in blocks of neighbours, and are merged from there without another.
"""

from __future__ import annotations

import gzip
import json
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.operators.ordered import PAGE_ROWS, block_of
from tapeloom.session import fan_out, full_uri
from tapeloom.sources import folders

KEY = ["session_id", "channel", "chunk_index"]
ATTEMPTS = 3
#: Hex digits of a digest: half of the SHA-256 that older ledgers hold whole.
DIGEST_CHARS = 32
#: Setting: shuffle files go with the job that made them, not when the driver next collects garbage.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("chunk_index", T.LongType()),
        T.StructField("digest", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("calls", T.IntegerType()),
    ]
)


def digest_of(manifest: DataFrame) -> Column:
    """A digest of all that a backend is given of a chunk, its samples included."""
    told = [F.col(f"`{c}`") for c in sorted(manifest.columns) if c != "samples"]
    parts = [F.to_json(F.struct(*told))]
    if "samples" in manifest.columns:
        parts += [F.xxhash64("samples").cast("string"), F.size("samples").cast("string")]
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(DIGEST_CHARS))


def contents(chunks: DataFrame) -> DataFrame:
    """A digest of each recording's samples (session_id, channel, content), whatever the order of its chunks."""
    own = F.xxhash64("frame_start", "samples")
    sums = F.bit_xor(own), F.sum(F.shiftrightunsigned(own, 20))
    text = F.concat_ws(":", *[s.cast("string") for s in sums])
    return chunks.where("n_frames > 0").groupBy("session_id", "channel").agg(text.alias("content"))


def recorded(spark: SparkSession, ledger: str) -> DataFrame:
    """All committed rows of a ledger: answers and failures."""
    path = f"{ledger}/runs"
    if not folders.names(spark, path):
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(path).withColumn("digest", F.left("digest", F.lit(DIGEST_CHARS)))


def _journal_rows(filesystem: pafs.FileSystem, path: str) -> Iterator[dict]:
    """Rows of a journal file, packed or plain; a task may have died in the middle of its last line."""
    with filesystem.open_input_file(path) as file:
        data = file.read()
    if path.endswith(".gz"):
        try:
            data = zlib.decompressobj(zlib.MAX_WBITS | 16).decompress(data)  # of a torn file, what there is
        except zlib.error:
            data = b""
    for line in data.splitlines():
        try:
            row = json.loads(line)
        except ValueError:
            continue
        if isinstance(row, dict) and isinstance(row.get("digest"), str):
            yield row | {"digest": row["digest"][:DIGEST_CHARS]}


def _asker(call: Callable[[pd.DataFrame], pd.Series], journals: str, columns: list[str], attempts: int, pause_s: float):
    def journal() -> tuple[Callable[[pd.DataFrame], None], Callable[[list[str]], dict[str, str | None]]]:
        """Writes answers of this task; finds those that an earlier attempt of it wrote."""
        filesystem, top = pafs.FileSystem.from_uri(journals)
        folder = f"{top}/{TaskContext.get().partitionId()}"
        filesystem.create_dir(folder)
        # Only digests are held; the answers of a batch are read when it comes.
        places = {}
        for info in filesystem.get_file_info(pafs.FileSelector(folder)):
            places.update((row["digest"], info.path) for row in _journal_rows(filesystem, info.path))

        def keep(rows: pd.DataFrame) -> None:
            lines = rows[_SCHEMA.names].to_json(orient="records", lines=True).encode("utf-8")
            # Not compressed by the stream: pyarrow goes by the name's ending.
            with filesystem.open_output_stream(f"{folder}/{uuid.uuid4().hex}.json.gz", compression=None) as out:
                out.write(gzip.compress(lines, 6))

        def kept(digests: list[str]) -> dict[str, str | None]:
            wanted = set(digests)
            files = {places[d] for d in wanted if d in places}
            rows = (row for path in files for row in _journal_rows(filesystem, path))
            return {row["digest"]: row["response"] for row in rows if row["digest"] in wanted}

        return keep, kept

    def answered(rows: pd.DataFrame) -> list[str | None]:
        responses = [None if pd.isna(r) else str(r) for r in call(rows[columns])]
        if len(responses) != len(rows):
            raise ValueError(f"{len(responses)} responses for {len(rows)} chunks")
        return responses

    def answered_whole(rows: pd.DataFrame) -> list[str | None] | None:
        try:
            return answered(rows)
        except Exception:  # asked again chunk by chunk, which reports what fails
            return None

    def asked(rows: pd.DataFrame) -> tuple[str | None, str | None, int]:
        """The response of one chunk, or the error of the last attempt, and the number of calls."""
        for n in range(1, attempts + 1):
            try:
                return answered(rows)[0], None, n
            except Exception as error:  # whatever a backend raises is reported with its chunk
                failure = f"{type(error).__name__}: {error}"
                time.sleep(pause_s * (2 ** (n - 1)) if n < attempts else 0)
        return None, failure, attempts

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep, kept = journal()
        for batch in batches:
            batch = batch.reset_index(drop=True)
            known = kept(batch["digest"].to_list())
            found = [known.get(d) for d in batch["digest"]]
            batch["response"], batch["error"], batch["calls"] = pd.Series(found, dtype=object), None, 0
            # One call for the whole batch; if it fails, chunk by chunk, so that one bad chunk costs no other.
            todo = batch.index[~batch["digest"].isin(list(known))]
            whole = answered_whole(batch.loc[todo]) if len(todo) > 1 else None
            if whole is not None:
                batch.loc[todo, "response"], batch.loc[todo, "calls"] = pd.Series(whole, todo, dtype=object), 1
                keep(batch.loc[todo])
            for k in todo if whole is None else ():
                batch.at[k, "response"], batch.at[k, "error"], batch.at[k, "calls"] = asked(batch.loc[[k]])
                if batch.at[k, "error"] is None:
                    keep(batch.loc[[k]])
            yield batch[_SCHEMA.names]

    return answer


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Jobs inside leave no shuffle files behind."""
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SHUFFLES_GO) if before is None else spark.conf.set(_SHUFFLES_GO, before)


def _write(rows: DataFrame, ledger: str, run: str) -> None:
    with _shuffles_go(rows.sparkSession):
        rows.write.option("compression", "zstd").parquet(f"{ledger}/runs/run={run}")


def _commit_open(spark: SparkSession, ledger: str) -> None:
    """Commit the answers that tasks of a failed run had written."""
    journals = f"{ledger}/open"
    if not folders.names(spark, journals):
        return
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(journals)
    places = listed.select(F.substring_index("path", "/open/", -1).alias("place"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, top = pafs.FileSystem.from_uri(journals)
        for place in (place for batch in batches for place in batch["place"]):
            rows = pd.DataFrame(_journal_rows(filesystem, f"{top}/{place}"), columns=_SCHEMA.names, dtype=object)
            yield rows.assign(chunk_index=rows["chunk_index"].astype("Int64"))

    _write(places.mapInPandas(read, _SCHEMA).where("calls > 0 AND error IS NULL"), ledger, uuid.uuid4().hex)
    folders.remove(spark, journals)


def _beside(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """The manifest with ``response``, ``error`` and whether it is ``__known``, from ledger ``rows`` of the same chunk and content.

    Both sides go through one shuffle, by blocks of chunks: neighbours stay together, so what they have in common is
    packed away, and a long recording is spread over its blocks.  Chunks with their samples go one by one: a block of
    them would be too much for a task.  Ledger rows without a whole key meet no chunk.
    """
    told = rows.dropna(subset=KEY).select(
        *[F.col(c).cast(manifest.schema[c].dataType).alias(c) for c in KEY],
        F.unhex("digest").alias("__digest"),
        "response",
        "error",
        F.lit(True).alias("__known"),
        F.lit(False).alias("__wanted"),
    )
    wanted = manifest.withColumns(
        {"__digest": F.unhex(digest_of(manifest)), "__known": F.lit(False), "__wanted": F.lit(True)}
    )
    block = block_of("chunk_index", 1 if "samples" in manifest.columns else PAGE_ROWS)
    both = wanted.unionByName(told, allowMissingColumns=True).repartition("session_id", "channel", block)
    same = Window.partitionBy("session_id", "channel", block, "chunk_index", "__digest")
    met = both.withColumns({c: F.max(c).over(same) for c in ("response", "error", "__known")})
    return met.where("__wanted").select(*manifest.columns, "response", "error", "__known")


def ask_and_tell(
    manifest: DataFrame,
    call: Callable[[pd.DataFrame], pd.Series],
    ledger: str,
    attempts: int = ATTEMPTS,
    pause_s: float = 0.0,
    parallelism: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """As ``ask``, and the recordings (session_id, channel) with a failed chunk; None where no chunk failed."""
    spark = manifest.sparkSession
    ledger = full_uri(spark, ledger).rstrip("/")
    _commit_open(spark, ledger)
    run = uuid.uuid4().hex
    columns = manifest.columns
    todo = manifest
    if folders.names(spark, f"{ledger}/runs"):
        answered = recorded(spark, ledger).where("error IS NULL").withColumn("response", F.lit(None).cast("string"))
        todo = _beside(manifest, answered).where("NOT __known").select(*columns)
    spread = todo.repartition(fan_out(spark, parallelism), *KEY)
    # Digests are made behind the shuffle: no codec makes them any smaller on the way.
    spread = spread.withColumn("digest", digest_of(spread))
    _write(spread.mapInPandas(_asker(call, f"{ledger}/open/{run}", columns, attempts, pause_s), _SCHEMA), ledger, run)
    folders.remove(spark, f"{ledger}/open")
    failed = spark.read.schema(_SCHEMA).parquet(f"{ledger}/runs/run={run}").where("error IS NOT NULL")
    rows, all_answered = recorded(spark, ledger).where("error IS NULL").select(*_SCHEMA.names), failed.isEmpty()
    found = _beside(manifest.dropna(subset=KEY), rows if all_answered else rows.unionByName(failed)).where("__known")
    return found.drop("__known"), None if all_answered else failed.select("session_id", "channel").distinct()


def ask(
    manifest: DataFrame,
    call: Callable[[pd.DataFrame], pd.Series],
    ledger: str,
    attempts: int = ATTEMPTS,
    pause_s: float = 0.0,
    parallelism: int | None = None,
) -> DataFrame:
    """The manifest with ``response`` and ``error``; chunks with an answer in the ledger are not asked for.

    Runs on one ledger follow one another: a run commits what it has found, and then
    removes the journals of its tasks.
    """
    return ask_and_tell(manifest, call, ledger, attempts, pause_s, parallelism)[0]


def failures(spark: SparkSession, ledger: str) -> DataFrame:
    """Chunks that were asked for without success and have no answer since: key, last error, calls so far."""
    rows = recorded(spark, ledger)
    same = [*KEY, "digest"]
    summed = rows.groupBy(*same).agg(
        F.count_if(F.col("error").isNull()).alias("answers"), F.max("error").alias("error"), F.sum("calls").alias("calls")
    )
    return summed.where("answers = 0").select(*KEY, "error", "calls")
