"""MinHash near-duplicates: one-permutation hashing, banded buckets, star-shaped candidate edges.

A document's set is the 64-bit hashes of its distinct 4-word shingles.  One pass over
the sorted set fills ``BINS`` bins with their minima; an empty bin takes the value of
the first filled bin in an order of its own (optimal densification), so sets of any
size have all bins.  ``BANDS`` bands of ``ROWS`` bins are hashed to bucket keys; a pair
of similarity 0.8 shares no bucket with probability (1 - 0.8^ROWS)^BANDS, under 4e-10.

Equal sets are one node (a 128-bit digest), so groups of exact copies cost one row.
A bucket never gives all of its pairs: it gives a star, from the member that shares the
most buckets with others (of a group of near copies, the one most like the rest), so there are
fewer edges than bucket entries.  Each edge is confirmed on the full sets.  A bucket whose
members are in one component after that has no more to tell.  For the others the star is no
proof: members that are not like its centre may be like each other.  They form lists, which are
compared on the full sets as well: inside a task, between different components only, by
postings of their shingles, and a list gives a spanning forest of its links.  Lists of more
than ``LIST_SETS`` sets or ``LIST_SHINGLES`` shingles are cut into blocks and every two blocks
meet in a task of their own, so nothing is capped and memory is bounded; of buckets with
the same members one is compared.

The members of one centre are dealt to ``SALTS`` streams that hold one set at a time.

Defined cases: a text without words (also NULL) has an empty set and is linked with
nothing, its component is its own ``doc_id``; a text of fewer words than a shingle has the
whole sequence as its one shingle; equal sets are linked; very long texts are one sorted
set in one task; rows that repeat a ``doc_id`` each have their own row and set; a component
without any ``doc_id`` has a NULL ``component_id`` and its rows are kept; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import few_files, small_batches, table, written
from tapeloom.llm.simhash import components

SHINGLE_WORDS = 4
MIN_PERCENT = 80
BANDS, ROWS = 72, 6
BINS = BANDS * ROWS
SEED = 13
#: Sets and shingles of one block of a list.
LIST_SETS, LIST_SHINGLES = 2048, 1_500_000
#: Entries of postings that are counted at once.
_POSTINGS = 1 << 22
#: Streams that the members of one centre are dealt to.
SALTS = 64

_rng = np.random.default_rng(SEED)
#: For each bin the places of all bins in its order: an empty bin takes the first filled one.
_ORDER = np.stack([_rng.permutation(BINS) for _ in range(BINS)]).astype(np.uint16)
_MULTIPLIERS = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; none without words."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    shingles = max(1, len(words) - SHINGLE_WORDS + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = [0, *(ends[:-1] + 1).tolist()][:shingles]
    ends = ends.tolist()[len(words) - shingles :]
    digest = xxhash.xxh64_intdigest
    hashes = (digest(joined[a:b], SEED) for a, b in zip(begins, ends, strict=True))
    return np.unique(np.fromiter(hashes, dtype=np.uint64, count=shingles))


def bins_of(items: np.ndarray) -> np.ndarray:
    """The minimum of each bin of a sorted, non-empty set; empty bins take another bin's value."""
    at = ((items >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))  # bins are ranges of the hash
    filled = at[first].astype(np.int64)
    out = np.empty(BINS, dtype=np.uint64)
    out[filled] = items[first]
    empty = np.ones(BINS, dtype=bool)
    empty[filled] = False
    empty = np.flatnonzero(empty)
    if len(empty):
        out[empty] = items[first[_ORDER[np.ix_(empty, filled)].argmin(axis=1)]]
    return out


def keys_of(bins: np.ndarray) -> np.ndarray:
    """One bucket key for each band."""
    mixed = (bins.reshape(BANDS, ROWS) * _MULTIPLIERS).sum(axis=1, dtype=np.uint64)
    return mixed ^ (mixed >> np.uint64(29)) ^ (np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_SIGNED = "n_shingles bigint, node binary, keys array<bigint>"


def _signatures(texts: pd.Series) -> pd.DataFrame:
    sets = [shingle_set(t) for t in texts]
    return pd.DataFrame(
        {
            "n_shingles": [len(s) for s in sets],
            "node": [xxhash.xxh3_128_digest(s.astype("<u8").tobytes()) if len(s) else None for s in sets],
            "keys": [keys_of(bins_of(s)).view(np.int64) if len(s) else [] for s in sets],
        }
    )


def _sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).astype("<u8").tobytes() for t in texts], dtype=object)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the wanted similarity."""
    if 100 * min(len(a), len(b)) < MIN_PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= MIN_PERCENT * (len(a) + len(b) - both)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of streams of (a, salt, b, items): a centre's own row (b NULL) stands before its members."""
    centre, items = None, np.empty(0, dtype=np.uint64)
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        froms, tos = [], []
        for k, (own, other) in enumerate(zip(a, b, strict=True)):
            here = np.frombuffer(batch.column("items")[k].as_buffer(), dtype="<u8")
            if other is None:
                centre, items = own, here.copy()
            elif own == centre and linked(items, here):
                froms.append(own)
                tos.append(other)
        yield pa.RecordBatch.from_arrays([pa.array(froms, pa.binary()), pa.array(tos, pa.binary())], names=["a", "b"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets (node, items) have the wanted similarity."""
    small_batches(pairs.sparkSession)
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    members = salted.join(sets, F.col("b") == F.col("node")).select("a", "salt", "b", "items")
    centres = salted.select("a", "salt").distinct().join(sets, F.col("a") == F.col("node"))
    centres = centres.select("a", "salt", F.lit(None).cast("binary").alias("b"), "items")
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streams = members.unionByName(centres).repartition(tasks, "a", "salt")
    streams = streams.sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return streams.select("a", "b", "items").mapInArrow(_confirmed, "a binary, b binary")


def _close_sizes(m: Column, n: Column) -> Column:
    return 100 * F.least(m, n) >= MIN_PERCENT * F.greatest(m, n)


def _list_links(sets: list[np.ndarray], roots: list[bytes], blocks: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links between sets of different roots; of two blocks only sets of different blocks are compared."""
    m, sizes = len(sets), np.array([len(x) for x in sets])
    label = np.unique(np.array(roots, dtype=object), return_inverse=True)[1]
    owner = np.repeat(np.arange(m), sizes)
    item = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(item, kind="stable")
    posts, df = owner[order], np.bincount(item)
    offsets, first = np.cumsum(df) - df, np.cumsum(sizes) - sizes
    apart = blocks.min() != blocks.max()
    found = []
    for r in range(m):
        other = (label != label[r]) & (100 * np.minimum(sizes, sizes[r]) >= MIN_PERCENT * np.maximum(sizes, sizes[r]))
        other[: r + 1] = False
        if apart:
            other &= blocks != blocks[r]
        if not other.any():
            continue
        own = item[first[r] : first[r] + sizes[r]]
        cuts = np.searchsorted(np.cumsum(df[own]), np.arange(_POSTINGS, int(df[own].sum()), _POSTINGS))
        both = np.zeros(m, dtype=np.int64)
        for part in np.split(own, cuts):
            n = df[part]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[part], n)
            both += np.bincount(posts[at], minlength=m)
        for k in np.flatnonzero(other & (100 * both >= MIN_PERCENT * (sizes + sizes[r] - both))).tolist():
            if label[k] != label[r]:
                label[label == label[k]] = label[r]
                found.append((r, k))
    return found


def _compared(part: pa.Table) -> pa.Table:
    nodes, roots = part.column("node").to_pylist(), part.column("root").to_pylist()
    sets = [np.frombuffer(x, dtype="<u8") for x in part.column("items").to_pylist()]
    pairs = _list_links(sets, roots, part.column("block").to_numpy())
    return pa.table({"a": pa.array([nodes[i] for i, _ in pairs], pa.binary()), "b": pa.array([nodes[k] for _, k in pairs], pa.binary())})


def compared(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members (key, node, root, n) of one list whose roots differ, by the full sets."""
    hashes = F.xxhash64("node"), F.xxhash64(F.lit(1), "node")
    kinds = lists.groupBy("key").agg(
        F.count("*").alias("m"), F.sum("n").alias("total"),
        F.bit_xor(hashes[0]).alias("one"), F.bit_xor(hashes[1]).alias("two"),
    )
    # Of buckets with the same members one is compared.
    kinds = kinds.groupBy("m", "total", "one", "two").agg(F.min("key").alias("key"))
    n_blocks = F.greatest(F.ceil(F.col("m") / LIST_SETS), F.ceil(F.col("total") / LIST_SHINGLES)).cast("int")
    rows = lists.join(kinds.select("key", n_blocks.alias("n_blocks")), "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key", "node"), F.col("n_blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    # Every block meets itself and each other block in a task of its own.
    rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "root")
    groups = rows.join(sets, "node").groupBy("key", "low", "high")
    return groups.applyInArrow(_compared, "a binary, b binary")


def links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Confirmed links (a, b) that join every component; ``nodes`` has (node, n, keys), one row each.

    ``sets_of(wanted)`` gives (node, items) of the wanted nodes.
    """
    listed = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = written(listed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "minhash-buckets")
    members = written(listed.join(shared, "key"), "minhash-members")
    sets = written(sets_of(members.select("node").distinct()), "minhash-sets")
    company = members.groupBy("node").agg(F.sum("m").alias("company"))
    best = F.max_by(F.struct("node", "n"), F.struct("company", "node"))
    centres = written(members.join(company, "node").groupBy("key").agg(best.alias("centre")), "minhash-centres")
    met = members.join(centres, "key").where(F.col("node") != F.col("centre.node"))
    stars = met.where(_close_sizes(F.col("n"), F.col("centre.n")))
    pairs = stars.select(F.col("centre.node").alias("a"), F.col("node").alias("b")).distinct()
    by_stars = written(confirmed(pairs, sets), "minhash-links")
    # The centre has met all others of its bucket; what they have to tell is told if they are one component.
    roots = components(by_stars)
    rest = met.select("key", "node", "n").join(roots, "node", "left")
    rest = written(rest.select("key", "node", "n", F.coalesce("root", "node").alias("root")), "minhash-rest")
    open_keys = rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    by_lists = written(compared(rest.join(open_keys.select("key"), "key"), sets), "minhash-links")
    return by_stars.unionByName(by_lists)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable) and whether it is the one kept."""
    small_batches(docs.sparkSession)
    signed = F.pandas_udf(_signatures, _SIGNED)(F.col("text"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), signed.alias("s"))
    rows = written(rows.select("doc_id", "text_hash", "s.*"), "minhash")
    present = rows.where("node IS NOT NULL")
    # Any one row of a class serves for its set; the one with the smallest id and hash is always the same.
    first = F.min(F.struct("doc_id", "text_hash"))
    classes = present.groupBy("node").agg(
        first.alias("first"), F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n"), F.first("keys").alias("keys")
    )
    classes = written(classes, "minhash-classes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        chosen = wanted.join(classes, "node").select("node", "first.doc_id", "first.text_hash")
        chosen = chosen.withColumnsRenamed({"doc_id": "own_id", "text_hash": "own_hash"})
        same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.xxhash64("text") == F.col("own_hash"))
        found = docs.select("doc_id", "text").join(chosen, same).select("node", "text")
        found = found.select("node", F.pandas_udf(_sets, "binary")(F.col("text")).alias("items"))
        return found.groupBy("node").agg(F.first("items").alias("items"))

    edges = links(classes.select("node", "n", "keys"), sets_of)
    roots = components(edges)
    rooted = classes.select("node", "first_id").join(roots, "node", "left")
    rooted = rooted.select("node", "first_id", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_node = rooted.join(ids, "root").select("node", "component_id")
    out = rows.join(of_node, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", own.alias("component_id"))
    return few_files(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE = f"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS d, doc_id, {_WORDS} AS words FROM documents),
sets AS (SELECT d, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {SHINGLE_WORDS} THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, CAST(len(words) AS BIGINT) - {SHINGLE_WORDS - 2}),
    lambda i: array_to_string(words[i:i + {SHINGLE_WORDS - 1}], ' '))) END AS items FROM docs),
classes AS (SELECT list_sort(items) AS items, min(d) AS c, list(d) AS members FROM sets WHERE len(items) > 0 GROUP BY 1),
shingles AS (SELECT c, len(items) AS n, unnest(items) AS item FROM classes),
pairs AS (SELECT a.c AS a, b.c AS b FROM shingles a JOIN shingles b ON a.item = b.item AND a.c < b.c
  AND 100 * least(a.n, b.n) >= {MIN_PERCENT} * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= {MIN_PERCENT} * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(node, root) AS (SELECT c, c FROM classes UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
rooted AS (SELECT unnest(c.members) AS d, r.root FROM classes c JOIN roots r ON r.node = c.c),
ids AS (SELECT r.root, min(s.doc_id) AS component_id FROM rooted r JOIN sets s ON s.d = r.d GROUP BY r.root)
SELECT s.doc_id, len(s.items) AS n_shingles, CASE WHEN r.d IS NULL THEN s.doc_id ELSE i.component_id END AS component_id,
  s.doc_id IS NOT DISTINCT FROM CASE WHEN r.d IS NULL THEN s.doc_id ELSE i.component_id END AS kept
FROM sets s LEFT JOIN rooted r ON r.d = s.d LEFT JOIN ids i ON i.root = r.root"""
