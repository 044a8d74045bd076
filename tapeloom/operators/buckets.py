"""Tables in hash buckets of their key: point reads, and upserts that cost what they touch.

``BucketLog`` keeps numbered batches of appended rows.  Each batch is a folder of its own
(a repeated batch replaces it), its rows lie in hash buckets of the key, sorted by the
key and with Bloom filters on it, so a lookup opens the wanted buckets only and skips row groups
inside them.  Hot buckets are several files: the writer balances them by size.

``Snapshot`` is the compaction of such a log, in the same buckets.  Folding a batch in
reads the log's new rows and the snapshot's rows of the buckets they are in, and writes
these buckets anew; all others stay the files they are.  A small manifest per batch names
the folder of every bucket, so readers see a batch whole or not at all, and older batches
can still be read.  The log stays the truth: repeating an older batch folds it again
together with all batches after it.

``Index`` is a snapshot for long rows: it holds the key and the order of the rows that still matter,
and reads the rows themselves from the log's folders that its manifest was made of.  Folding
moves no payload, so a row is shuffled and written with its batch, whatever number of batches follow.
Its log is a ``KeptLog``: replaced batches stay as they were until ``expire`` removes them.

The number of buckets is fixed when a log is made (it stands beside its batches); a
manifest has one entry for each, which is all that the driver ever holds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.sources import folders

BUCKET = "bucket"
#: Buckets of a small store; choose so many that a bucket of the snapshot is some 100 MB.
N_BUCKETS = 16
#: Wanted keys that are pushed into the scan as literals; more are joined.
FEW_KEYS = 10
#: Distinct keys that the Bloom filter of one row group is sized for.
BLOOM_KEYS = 20_000


class _Layout:
    """Rows of ``schema`` in hash buckets of ``key``."""

    def __init__(self, spark: SparkSession, schema: T.StructType, key: str, n_buckets: int):
        self.spark, self.key, self.n_buckets = spark, key, n_buckets
        self.names = [f.name for f in schema.fields]
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.n_buckets)).cast("int")

    def write(self, rows: DataFrame, path: str) -> None:
        placed = rows.select(*self.names, self.bucket_of(F.col(self.key)).alias(BUCKET))
        # Balanced by bytes: small buckets share a task, a hot one is split into several files.
        placed = placed.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, self.key)
        bloom = f"parquet.bloom.filter.enabled#{self.key}", f"parquet.bloom.filter.expected.ndv#{self.key}"
        writer = placed.write.partitionBy(BUCKET).option(bloom[0], "true").option(bloom[1], str(BLOOM_KEYS))
        writer.mode("overwrite").parquet(path)

    def read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths).select(*self.names)

    def touched(self, path: str) -> list[int]:
        """Buckets that have files in a written folder: one listing, no job."""
        found = (n.partition("=") for n in folders.names(self.spark, path))
        return sorted(int(number) for name, _, number in found if name == BUCKET)

    def _asked(self, keys: DataFrame) -> DataFrame:
        """The wanted keys, once each, with their buckets."""
        key = F.col(self.key).cast(self.schema[self.key].dataType)
        return keys.select(key.alias(self.key)).distinct().withColumn(BUCKET, self.bucket_of(F.col(self.key)))

    def wanted(self, keys: DataFrame) -> list[int]:
        """Buckets of the wanted keys: at most as many rows as there are buckets."""
        return sorted(r[0] for r in self._asked(keys).select(BUCKET).distinct().collect())

    def pick(self, keys: DataFrame) -> tuple[set[int], Callable[[DataFrame], DataFrame]]:
        """Buckets of the wanted keys, and what picks their rows: few keys are literals that the scan
        prunes with, more are joined."""
        asked = self._asked(keys)
        few = asked.limit(FEW_KEYS + 1).collect()
        if len(few) <= FEW_KEYS:
            known = [r[self.key] for r in few if r[self.key] is not None]
            return {r[BUCKET] for r in few}, lambda rows: rows.where(F.col(self.key).isin(known))
        known = asked.select(self.key)
        return set(self.wanted(keys)), lambda rows: rows.join(known, self.key, "left_semi").select(*rows.columns)

    def lookup(self, keys: DataFrame, read: Callable[[set[int]], DataFrame]) -> DataFrame:
        """Rows of the wanted keys from ``read`` of their buckets."""
        buckets, picked = self.pick(keys)
        return picked(read(buckets))


class BucketLog(_Layout):
    """Numbered batches of appended rows under ``{root}/{name}/batch=…/bucket=…``."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: T.StructType, key: str, n_buckets: int = N_BUCKETS):
        self.path = f"{root}/{name}"
        layout = folders.read_text(spark, f"{self.path}/_layout")
        if layout is None:
            folders.write_text(spark, f"{self.path}/_layout", json.dumps({"buckets": n_buckets}))
        else:
            n_buckets = json.loads(layout)["buckets"]
        super().__init__(spark, schema, key, n_buckets)

    def append(self, rows: DataFrame, batch: int) -> None:
        """Write a batch; one of the same number is replaced."""
        self.write(rows, self.batch_path(batch))

    def folder(self, batch: int) -> str:
        return f"batch={batch}"

    def batch_path(self, batch: int) -> str:
        return f"{self.path}/{self.folder(batch)}"

    def batches(self) -> list[int]:
        found = (n.partition("=") for n in folders.names(self.spark, self.path))
        return sorted(int(number) for name, _, number in found if name == "batch")

    def rows(self, batches: Iterable[int] | None = None, wanted: DataFrame | None = None) -> DataFrame:
        """All rows of some (or all) batches, or those of the wanted keys (a column named as the key)."""
        read = self.reader([self.folder(n) for n in (self.batches() if batches is None else batches)])
        return read() if wanted is None else self.lookup(wanted, read)

    def reader(self, chosen: Iterable[str]) -> Callable[..., DataFrame]:
        """Reads some (or all) buckets of some folders."""
        places = [(f"{self.path}/{name}", b) for name in chosen for b in self.touched(f"{self.path}/{name}")]

        def read(buckets: Iterable[int] | None = None) -> DataFrame:
            return self.read([f"{path}/{BUCKET}={b}" for path, b in places if buckets is None or b in buckets])

        return read


class KeptLog(BucketLog):
    """A log whose replaced batches stay until ``expire``: ``_batches/{number}`` names the folder that counts.

    Its folder is no table to be read plainly.  Batches written as those of a ``BucketLog`` are read as they are.
    """

    def append(self, rows: DataFrame, batch: int) -> None:
        folder = f"batch={batch}-{uuid.uuid4().hex[:12]}"
        self.write(rows, f"{self.path}/{folder}")
        folders.write_text(self.spark, f"{self.path}/_batches/{batch}", folder)

    def folder(self, batch: int) -> str:
        return folders.read_text(self.spark, f"{self.path}/_batches/{batch}") or super().folder(batch)

    def batches(self) -> list[int]:
        plain = (n.removeprefix("batch=") for n in folders.names(self.spark, self.path))
        return sorted({int(n) for n in [*plain, *folders.names(self.spark, f"{self.path}/_batches")] if n.isdecimal()})

    def expire(self, used: Iterable[str] = ()) -> list[str]:
        """Remove folders of replaced batches, but for those still ``used``."""
        kept = {*used, *(self.folder(n) for n in self.batches())}
        gone = [n for n in folders.names(self.spark, self.path) if n.startswith("batch=") and n not in kept]
        for name in gone:
            folders.remove(self.spark, f"{self.path}/{name}")
        return gone


class Versions(_Layout):
    """Buckets that are replaced whole; ``manifest/{number}`` names the folder of each bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, n_buckets: int):
        self.path = path
        super().__init__(spark, schema, key, n_buckets)

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in folders.names(self.spark, f"{self.path}/manifest") if n.isdecimal())

    def manifest(self, before: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows, as of the last number (``before`` one)."""
        return self._held(self._entries(before))

    def _entries(self, before: int | None = None) -> dict[str, object]:
        """A manifest as it was written."""
        known = [n for n in self.numbers() if before is None or n < before]
        return json.loads(folders.read_text(self.spark, f"{self.path}/manifest/{known[-1]}")) if known else {}

    def _held(self, entries: dict[str, object]) -> dict[int, str]:
        return {int(b): folder for b, folder in entries.items() if b.isdecimal()}

    def rows(
        self, buckets: Iterable[int] | None = None, before: int | None = None, wanted: DataFrame | None = None
    ) -> DataFrame:
        """All rows, those of some buckets, or those of the wanted keys."""
        read = self.reader(self.manifest(before))
        return read(buckets) if wanted is None else self.lookup(wanted, read)

    def reader(self, held: dict[int, str]) -> Callable[..., DataFrame]:
        """Reads some (or all) buckets of a manifest."""

        def read(asked: Iterable[int] | None = None) -> DataFrame:
            chosen = held if asked is None else sorted(b for b in asked if b in held)
            return self.read([f"{self.path}/{held[b]}/{BUCKET}={b}" for b in chosen])

        return read

    def replace(
        self, rows: DataFrame, buckets: Iterable[int], number: int, base: int | None = None, beside: dict | None = None
    ) -> None:
        """Write new rows of ``buckets`` as ``number``; the others stay as they were before ``base`` (``number``).

        Numbers from ``base`` up to this one are forgotten: they were made of what is replaced.
        The manifest also takes the entries ``beside`` those of the buckets.
        """
        base = number if base is None else base
        held = {b: folder for b, folder in self.manifest(base).items() if b not in set(buckets)}
        folder = f"version={number}-{uuid.uuid4().hex[:12]}"
        if buckets:
            self.write(rows, f"{self.path}/{folder}")
            held |= dict.fromkeys(self.touched(f"{self.path}/{folder}"), folder)
        folders.write_text(self.spark, f"{self.path}/manifest/{number}", json.dumps(held | (beside or {})))
        for old in self.numbers():
            if base <= old < number:
                folders.remove(self.spark, f"{self.path}/manifest/{old}")

    def expire(self, keep: int = 1) -> list[str]:
        """Remove folders that none of the last ``keep`` manifests names, and the manifests before them."""
        numbers = self.numbers()
        kept = numbers[len(numbers) - keep :] if keep else numbers
        used = {folder for n in kept for folder in self.manifest(n + 1).values()}
        for n in numbers:
            if n not in kept:
                folders.remove(self.spark, f"{self.path}/manifest/{n}")
        gone = [n for n in folders.names(self.spark, self.path) if n.startswith("version=") and n not in used]
        for name in gone:
            folders.remove(self.spark, f"{self.path}/{name}")
        return gone


class Snapshot(Versions):
    """The compaction of a log, kept up to date bucket by bucket.

    ``compact`` takes rows of whole buckets and drops those that no longer matter: compacting its
    own result together with later rows gives the same as compacting all rows.  With a ``schema`` it
    is given those columns of the log only.
    """

    def __init__(
        self,
        log: BucketLog,
        compact: Callable[[DataFrame], DataFrame],
        name: str | None = None,
        schema: T.StructType | None = None,
    ):
        path = f"{log.path}_{name or 'snapshot'}"
        super().__init__(log.spark, path, schema or log.schema, log.key, log.n_buckets)
        self.log, self.compact = log, compact

    def fold(self, batch: int) -> list[int]:
        """Fold ``batch`` and all batches after it into the snapshot; gives the buckets written."""
        later = [n for n in self.log.batches() if n >= batch]
        if not later:
            return []
        touched = sorted({b for n in later for b in self.log.touched(self.log.batch_path(n))})
        rows = self.rows(touched, before=batch).unionByName(self.log.rows(later).select(*self.names))
        self.replace(self.compact(rows), touched, later[-1], base=batch)
        return touched


class Index(Snapshot):
    """A snapshot of ``key`` and ``order`` only; ``whole`` reads the rows it names from the log.

    ``order`` tells the rows of a key apart.  A manifest names the log's folders that it was made
    of, so a batch that is written again is seen when it is folded, not before.
    """

    def __init__(self, log: KeptLog, compact: Callable[[DataFrame], DataFrame], order: str, name: str = "index"):
        super().__init__(log, compact, name, T.StructType([log.schema[log.key], log.schema[order]]))
        self.order = order

    def _logged(self, entries: dict[str, object]) -> dict[str, str]:
        """The log's folder of each batch that a manifest was made of."""
        return entries.get("log", {})

    def replace(
        self, rows: DataFrame, buckets: Iterable[int], number: int, base: int | None = None, beside: dict | None = None
    ) -> None:
        base = number if base is None else base
        folded = {str(n): self.log.folder(n) for n in self.log.batches() if base <= n <= number}
        logged = self._logged(self._entries(base)) | folded
        super().replace(rows, buckets, number, base, {"log": logged} | (beside or {}))

    def whole(self, before: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
        """The log's rows that still matter, or those of the wanted keys."""
        entries = self._entries(before)
        buckets, picked = (None, lambda rows: rows) if wanted is None else self.pick(wanted)
        rows = self.log.reader(self._logged(entries).values())(buckets)
        live = picked(self.reader(self._held(entries))(buckets))
        live = live.select(F.col(self.key).alias("__key"), F.col(self.order).alias("__order"))
        # By the order too: a key written very often is spread over the tasks.
        same = rows[self.key].eqNullSafe(live["__key"]) if wanted is None else rows[self.key] == live["__key"]
        return rows.join(live, same & rows[self.order].eqNullSafe(live["__order"]), "left_semi")

    def expire(self, keep: int = 1) -> list[str]:
        gone = super().expire(keep)
        used = {folder for n in self.numbers() for folder in self._logged(self._entries(n + 1)).values()}
        return gone + self.log.expire(used)
