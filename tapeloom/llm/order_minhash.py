"""Document fingerprints: order MinHash, sensitive to edit distance.

The k-mers of a text are its runs of ``K`` words; a k-mer that comes again is
numbered, so that (k-mer, occurrence) names each of them once.  One hash puts them
on a circle, and slot ``j`` has its own order: round the circle from ``j`` parts of
it.  A slot takes the ``ELL`` smallest in its order, puts them back into the order
of the text, and hashes that tuple.  Texts agree in a slot when they share its
minimal k-mers in the same order; moved or replaced passages lower the share of
equal slots, which estimates their likeness.  Rotations are no independent orders: only
neighbours on the circle ever make a tuple, so a text of few k-mers repeats its slots
and a swap of others stays unseen (README: measured error).

One sort per text serves all slots.  Everything is DataFrame expressions.  The next
document is found on a narrow table in key order; each text is shuffled once, its
head once more.

Defined cases: a text of fewer than ``K`` words is one k-mer, a text without words
(also NULL) is the empty sequence, which is like itself only; white space between
words is no part of a fingerprint.  Rows are ordered by descending ``doc_id``, NULL
last, rows that repeat a ``doc_id`` by text hash; rows equal in both share their
place and each gives a result row.  A table of one document is followed by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import let, table, window_hashes, words_of, written

K = 2
ELL = 2
#: log2 of the number of slots.
SLOT_BITS = 5
SLOTS = 1 << SLOT_BITS
_KEY = ["id_missing", "id", "text_hash"]


def _kmers(text: Column) -> Column:
    """A hash for each k-mer, in text order."""

    def of_words(hashes: Column) -> Column:
        short = F.when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(hashes)
        return F.when(F.size(hashes) < K, short).otherwise(window_hashes(hashes, K))

    return let(F.transform(words_of(text), lambda w: F.xxhash64(w)), of_words)


def _numbered(kmers: Column) -> Column:
    """(hash of k-mer and occurrence number, position) of each k-mer."""
    point = lambda kmer, n, at: F.struct(F.xxhash64(kmer, n).alias("h"), at.alias("at"))
    once = F.transform(kmers, lambda kmer, at: point(kmer, F.lit(0), at))

    def counted(ordered: Column) -> Column:
        last = F.size(ordered)
        begins = F.filter(
            F.sequence(F.lit(0), last - 1),
            lambda i: ~F.coalesce(F.get(ordered, i)["h"] == F.get(ordered, i - 1)["h"], F.lit(False)),
        )
        numbers = let(
            begins,
            lambda bs: F.flatten(
                F.transform(bs, lambda b, i: F.sequence(F.lit(0), F.coalesce(F.get(bs, i + 1), last) - b - 1))
            ),
        )
        return let(numbers, lambda ns: F.transform(ordered, lambda x, i: point(x["h"], F.get(ns, i), x["at"])))

    ordered = F.sort_array(F.transform(kmers, lambda kmer, at: F.struct(kmer.alias("h"), at.alias("at"))))
    distinct = F.size(F.array_distinct(kmers)) == F.size(kmers)
    return F.when(distinct, once).otherwise(let(ordered, counted))


def slots(text: Column) -> Column:
    """The signature: ``SLOTS`` 32-bit hashes of ordered minimal tuples."""
    half = SLOTS // 2

    def arc(point: Column) -> Column:
        return F.shiftright(point["h"], 64 - SLOT_BITS)

    def chosen(circle: Column) -> Column:
        n = F.size(circle)
        begins = F.filter(
            F.transform(
                circle,
                lambda p, i: F.when(
                    F.coalesce(arc(p) != arc(F.get(circle, i - 1)), F.lit(True)),
                    F.struct(arc(p).alias("arc"), i.alias("i")),
                ),
            ),
            lambda x: x.isNotNull(),
        )

        def tuple_from(first: Column) -> Column:
            nearest = F.transform(
                F.sequence(F.lit(0), F.least(F.lit(ELL), n) - 1),
                lambda k: F.get(circle, (first + k) % n),
            )
            in_text = F.sort_array(F.transform(nearest, lambda p: F.struct(p["at"], p["h"])))
            return F.xxhash64(F.transform(in_text, lambda p: p["h"])).bitwiseAND(0xFFFFFFFF)

        def slot(bs: Column, j: Column) -> Column:
            return tuple_from(F.coalesce(F.get(F.filter(bs, lambda b: b["arc"] >= j - half), F.lit(0))["i"], F.lit(0)))

        all_slots = F.sequence(F.lit(0), F.lit(SLOTS - 1))
        filled = let(begins, lambda bs: F.transform(all_slots, lambda j: slot(bs, j)))
        return F.when(n > 0, filled).otherwise(F.array_repeat(F.lit(0).cast("bigint"), SLOTS))

    return let(_kmers(text), lambda ks: let(F.sort_array(_numbered(ks)), chosen))


def as_text(signature: Column) -> Column:
    return F.lower(F.array_join(F.transform(signature, lambda s: F.lpad(F.hex(s), 8, "0")), ""))


def likeness(one: Column, other: Column) -> Column:
    """Share of equal slots."""
    same = F.zip_with(one, other, lambda a, b: (a == b).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.lit(float(SLOTS))


def followed(items: DataFrame) -> DataFrame:
    """For each distinct (id_missing, id, text_hash): the key and length of the item it follows.

    The order is descending, the first item follows the last.  Range partitions are
    put in order each for itself; only their last items (one row each) meet.
    """
    spark = items.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc("id_missing"), F.desc("id"), F.desc("text_hash")]
    placed = items.distinct().repartitionByRange(parts, *order)
    placed = written(placed.withColumn("part", F.spark_partition_id()), "order")
    item = F.struct(F.col("id_missing"), F.col("id"), F.col("text_hash"), F.col("n"))
    before = F.lag(item).over(Window.partitionBy("part").orderBy(*order))
    # The order's last item: missing ids come last, then the smallest id and hash.
    last = F.min_by(item, F.struct(~F.col("id_missing"), F.col("id"), F.col("text_hash")))
    ends = placed.groupBy("part").agg(last.alias("last"))
    by_part = Window.orderBy("part")  # one row for each partition of the table
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = F.coalesce(F.lag("last").over(by_part), F.last("last").over(whole)).alias("earlier")
    ends = ends.select("part", earlier)
    linked = placed.withColumn("before", before).join(F.broadcast(ends), "part")
    leads = F.coalesce("before", "earlier")
    return linked.select(*_KEY, *[leads[k].alias(f"lead_{k}") for k in [*_KEY, "n"]])


def with_edits(docs: DataFrame) -> DataFrame:
    """Each document with its signature, its edited text, and the next document's signature.

    Edited: the last third of the code points gives way to as many first ones of the
    next document in descending ``doc_id``.
    """
    body = F.coalesce("text", F.lit(""))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(
        F.col("doc_id").isNull().alias("id_missing"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.xxhash64(body).alias("text_hash"),
        body.alias("body"),
    )
    size = F.length("body").cast("bigint").alias("n")
    places = followed(keyed.select(*_KEY, size))
    # Both uses below take the same columns, so that one shuffle serves them and signatures are made once.
    rows = keyed.withColumn("signature", slots(F.col("body"))).repartition(parts, *_KEY)
    third = lambda n: F.floor(F.col(n) / 3).cast("int")
    heads = rows.join(places, _KEY).select(
        *[F.col(f"lead_{k}").alias(k) for k in _KEY],
        F.substr("body", F.lit(1), third("lead_n")).alias("head"),
        F.col("signature").alias("next_signature"),
    )
    heads = heads.groupBy(*_KEY).agg(F.first("head").alias("head"), F.first("next_signature").alias("next_signature"))
    kept = F.substr("body", F.lit(1), F.col("n").cast("int") - third("n"))
    joined = rows.join(heads, _KEY).withColumn("n", size)
    return joined.select(
        F.when(~F.col("id_missing"), F.col("id")).alias("doc_id"),
        "n",
        F.concat(kept, F.col("head")).alias("edited"),
        "signature",
        "next_signature",
    )


def order_minhash(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, its edited text's, and their likenesses."""
    rows = with_edits(docs.select("doc_id", "text")).withColumn("edited_signature", slots(F.col("edited")))
    return rows.select(
        "doc_id",
        F.col("n").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("signature")).alias("fingerprint"),
        as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash(table(spark, sf_dir, "documents"))
