"""SimHash near-duplicates: byte-position inverted index with count filtering.

A fingerprint has 8 bytes.  Two that differ in at most 3 bits differ in at most 3
bytes, so they share at least 5 bytes at their positions: the guaranteed minimum
of the count filter.  The index lists fingerprints by bytes at three positions:
of the 8 triples inside the two halves of a fingerprint, any 5 shared positions
contain one whole triple (one half has 3 of them), so no pair is missed.

Only distinct fingerprints are listed.  A list of more than ``GROUP_LIMIT`` is
never gathered: its members move on to lists that add one of the shared bytes
still guaranteed (two of five positions, then one of four), and from five shared
bytes to nibbles of the other three (at least 3 of 6 are equal).  There only 12
bits are free, so a list has at most 4,096 members.  Nothing is capped: every
linked pair meets in some list that is small enough.

Inside a list the shared positional bytes of each pair are tallied, pairs that
reach the minimum are verified bit by bit, and the list gives a spanning forest
of its links, not all pairs.  Components follow by star contraction.

Defined cases: a text without words (also NULL) has fingerprint zero and is
linked like any other; rows with equal texts share a fingerprint; a repeated
``doc_id`` gives one result row each; a component without any ``doc_id`` has a
NULL ``component_id``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tapeloom.llm.common import few_files, field, packed, small_batches, table, unpacked, written

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
POSITIONS = 8
#: Shared positional bytes that ``MAX_BITS`` differing bits guarantee.
MIN_SHARED = POSITIONS - MAX_BITS
#: Fingerprints of one list that a task compares; longer lists are split further.
GROUP_LIMIT = 4096
#: Shingles whose bits are counted at once.
_CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of one whole text."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    shingles = max(1, len(words) - SHINGLE_WORDS + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = [0, *(ends[:-1] + 1).tolist()][:shingles]
    ends = ends.tolist()[len(words) - shingles :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, shingles, _CHUNK):
        part = zip(begins[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    set_bits = np.packbits(2 * ones > shingles, bitorder="little")
    return int(set_bits.view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the SimHash as a BIGINT (its unsigned bits)."""
    small_batches(df.sparkSession)
    return df.withColumn(name, _fingerprints(text))


def hex_of(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _byte_mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def first_masks() -> list[int]:
    """The triples of byte positions inside each half."""
    return [_byte_mask(t) for half in (range(0, 4), range(4, 8)) for t in combinations(half, 3)]


def wider_masks(mask: int) -> list[int]:
    """Masks with more bits, one of which every linked pair that shares ``mask`` shares too."""
    shared = [p for p in range(POSITIONS) if mask >> (8 * p) & 0xFF == 0xFF]
    free = [p for p in range(POSITIONS) if p not in shared]
    if len(shared) < MIN_SHARED:
        # MIN_SHARED - len(shared) of the free positions are shared as well: so many less one may be left out.
        spare = MIN_SHARED - len(shared) - 1
        return [mask | _byte_mask((p,)) for p in free[spare:]]
    nibbles = [0xF << (8 * p + s) for p in free for s in (0, 4)]
    return [mask | sum(kept) for kept in combinations(nibbles, len(nibbles) - MAX_BITS)]


def mask_levels() -> list[list[int]]:
    levels = [first_masks()]
    while True:
        last = [bin(m).count("1") for m in levels[-1]]
        if min(last) > 8 * MIN_SHARED:
            return levels
        levels.append(sorted({w for m in levels[-1] for w in wider_masks(m)}))


def _local_links(prints: np.ndarray) -> np.ndarray:
    """For each fingerprint of one list, the smallest index of its local component."""
    n = len(prints)
    octets = prints.astype("<u8").view(np.uint8).reshape(n, POSITIONS)
    label = np.full(n, -1)
    for start in range(n):
        if label[start] >= 0:
            continue
        label[start] = start
        reach = [start]
        while reach:
            seed = reach.pop()
            rest = np.flatnonzero(label < 0)
            if not len(rest):
                break
            tally = (octets[rest] == octets[seed]).sum(axis=1)
            rest = rest[tally >= MIN_SHARED]
            rest = rest[np.bitwise_count(prints[rest] ^ prints[seed]) <= MAX_BITS]
            label[rest] = start
            reach.extend(rest.tolist())
    return label


def _verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        froms, tos = [], []
        for members in frame["members"]:
            prints = np.sort(np.asarray(members, dtype=np.int64)).view(np.uint64)
            label = _local_links(prints)
            linked = np.flatnonzero(label != np.arange(len(prints)))
            froms.append(prints[label[linked]].view(np.int64))
            tos.append(prints[linked].view(np.int64))
        if froms:
            yield pd.DataFrame({"a": np.concatenate(froms), "b": np.concatenate(tos)})


def links(prints: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Spanning links (a, b) of distinct fingerprints ``fp`` that differ in at most ``MAX_BITS`` bits."""
    spark = prints.sparkSession
    small_batches(spark)
    key = ["mask", "value"]
    masks = F.explode(F.array(*[F.lit(_signed(m)).cast("bigint") for m in first_masks()]))
    listed = prints.select("fp", masks.alias("mask"))
    found: list[DataFrame] = []
    levels = mask_levels()
    for level, here in enumerate(levels):
        listed = listed.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        small = listed
        if level + 1 < len(levels):
            sizes = listed.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > group_limit)
            long_lists = written(sizes.select(*key), "simhash-long-lists")
            if not long_lists.isEmpty():
                small = listed.join(long_lists, key, "left_anti")
        lists = small.groupBy(*key).agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
        found.append(lists.select("members").mapInPandas(_verified, "a bigint, b bigint"))
        if small is listed:
            break
        rows = [(_signed(m), [_signed(w) for w in wider_masks(m)]) for m in here]
        wider = spark.createDataFrame(rows, "mask bigint, wider array<bigint>")  # at most 128 rows
        listed = (
            listed.join(long_lists, key, "left_semi")
            .join(F.broadcast(wider), "mask")
            .select("fp", F.explode("wider").alias("mask"))
            .distinct()
        )
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (node, root) for every node of an edge, root the smallest node.

    Stars are contracted until nothing changes: larger neighbours move to the
    smallest one, then smaller ones do.  A node with very many neighbours is only
    ever a key of a partial minimum; the joins on it split when they are skewed.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return low.select("u", F.least("u", "m").alias("m"))

    now = written(few_files(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()), "cc")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()  # each node u to a smaller v
        low = smallest(large)
        to_low = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(few_files(to_low.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()), "cc")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(prints: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Component of every distinct fingerprint: (fp, root, component_id).

    ``prints`` has (doc_id, fp), one row per document, and is read twice: give a
    written table.
    """
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(distinct.select("fp"), group_limit))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.select("fp", "root").join(ids, "root").select("fp", "root", "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = with_fingerprint(docs.select("doc_id", "text"), F.col("text"), "fp").select("doc_id", "fp")
    prints = written(prints, "simhash")
    classes = near_duplicates(prints)
    rows = prints.join(classes, "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
    return few_files(rows)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the one with its smallest ``doc_id``.

    Among rows that repeat that ``doc_id`` the one with the smallest text hash stays.
    """
    columns = docs.columns
    # Each text is fingerprinted once: rows are written with their fingerprints, the index reads the narrow part.
    rows = written(with_fingerprint(packed(docs), field("text"), "fp"), "simhash")
    classes = near_duplicates(rows.select(field("doc_id").alias("doc_id"), "fp"))
    first = rows.join(classes, "fp").where(field("doc_id").eqNullSafe(F.col("component_id")))
    rank = Window.partitionBy("root").orderBy(F.xxhash64(field("text")))
    return unpacked(first.withColumn("rank", F.row_number().over(rank)).where("rank = 1"), columns)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
