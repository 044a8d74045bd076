"""Source divergence audit: which sources of a language use other words than the rest.

Terms are counted per (lang, source) inside tasks by length-bucketed packing: terms of
up to 8 bytes are one unsigned 64-bit word, those of up to 16 bytes two, both sorted by
radix (stable passes over 16-bit digits) and counted as runs; longer terms are sorted as
bytes, a bucket for each length.  A task counts some ``BATCH_BYTES`` of text at a time and
Spark adds the counts up, inside the task first, so a hot source is never gathered.

The audit itself compares the sources of a language term by term in whole numbers.  Most
terms are absent from most sources: what absence contributes depends on a count alone, so
it comes from each source's histogram of counts, and only terms that both sources have
meet in a join (of one row per source and term).

Defined cases: NULL text, lang and source are ''; an empty text counts as a document
without terms; very long texts are split nowhere and bounded by the batch they fill;
repeated rows (and rows that repeat a ``doc_id``) are documents of their own; a language
without kept terms has pairs of value 0; a language of one source has no pairs; ties are
ranked by the item's UTF-8 bytes; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import small_batches, table, written

#: Documents of a language that must have a term.
MIN_DOCUMENTS = 3
#: Parts that a share is rounded down to.
SCALE = 1_000_000_000
TERM_RANKS = 200
#: Text that a task counts at once.
BATCH_BYTES = 8 << 20

#: Bytes of a term, each with its lower-case form; 0 for all others (control, space, digits, signs).
_LOWER = np.zeros(256, dtype=np.uint8)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWER[0x80:] = np.arange(0x80, 0x100)


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows by unsigned 64-bit words, the first word most significant.

    One stable pass for each 16-bit digit (numpy sorts 16-bit integers by radix); digits that are equal in all
    rows are skipped.
    """
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _packed_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n_words: int) -> list[np.ndarray]:
    """Terms as big-endian words, padded by zero bytes, which no term holds."""
    out = []
    for w in range(n_words):
        word = np.zeros(len(starts), dtype=np.uint64)
        for k in range(8 * w, 8 * w + 8):
            inside = sizes > k
            byte = np.where(inside, data[np.where(inside, starts + k, 0)], 0).astype(np.uint64)
            word |= byte << np.uint64(8 * (7 - k % 8))
        out.append(word)
    return out


def _as_bytes(words: list[np.ndarray], sizes: np.ndarray) -> list[bytes]:
    raw = np.stack(words, axis=1).astype(">u8").tobytes()
    width = 8 * len(words)
    return [raw[width * r : width * r + size] for r, size in enumerate(sizes.tolist())]


def _counted(groups: np.ndarray, docs: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by (group, words): the first row of each run, its length and its number of documents.

    The sort is stable and documents come in order, so a document's rows of a run stand together.
    """
    order = radix_order([groups.astype(np.uint64), *words])
    new = np.ones(len(order), dtype=bool)
    same = groups[order[1:]] == groups[order[:-1]]
    for word in words:
        same &= word[order[1:]] == word[order[:-1]]
    new[1:] = ~same
    new_doc = new.copy()
    new_doc[1:] |= docs[order[1:]] != docs[order[:-1]]
    begins = np.flatnonzero(new)
    counts = np.diff(np.append(begins, len(order)))
    n_docs = np.add.reduceat(new_doc.astype(np.int64), begins) if len(begins) else np.empty(0, dtype=np.int64)
    return order[begins], counts, n_docs


Counts = tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]


def count_terms(texts: list[bytes], groups: np.ndarray) -> Iterator[Counts]:
    """Groups, terms, occurrences and documents of a batch of texts in UTF-8, a table for each bucket of lengths."""
    if not any(texts):
        return
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = _LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    inside = data > 0
    text_begins = np.cumsum(sizes) - sizes
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[text_begins] = True  # a term ends with its text
    starts = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1
    lengths = ends - starts
    # Of texts that begin at one place all but the last are empty, and the search gives the last.
    docs = np.searchsorted(text_begins, starts, side="right") - 1

    for low, high, n_words in ((0, 8, 1), (8, 16, 2)):
        rows = np.flatnonzero((lengths > low) & (lengths <= high))
        words = _packed_words(data, starts[rows], lengths[rows], n_words)
        at, counts, n_docs = _counted(groups[docs[rows]], docs[rows], words)
        yield groups[docs[rows[at]]], _as_bytes([w[at] for w in words], lengths[rows[at]]), counts, n_docs
    long_rows = np.flatnonzero(lengths > 16)
    for length in np.unique(lengths[long_rows]).tolist():
        rows = long_rows[lengths[long_rows] == length]
        terms = np.array([data[s : s + length].tobytes() for s in starts[rows].tolist()], dtype=f"S{length}")
        ranks = np.unique(terms, return_inverse=True)[1].astype(np.uint64)
        at, counts, n_docs = _counted(groups[docs[rows]], docs[rows], [ranks])
        yield groups[docs[rows[at]]], terms[at].tolist(), counts, n_docs


_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of rows (lang, source, text), some ``BATCH_BYTES`` of text at a time."""
    numbers: dict[tuple[str, str], int] = {}
    texts: list[bytes] = []
    groups: list[int] = []

    def counted() -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array([key[k] for key in numbers], pa.string()) for k in (0, 1))
        for owners, terms, n, docs in count_terms(texts, np.array(groups, dtype=np.int64)):
            columns = [langs.take(pa.array(owners)), sources.take(pa.array(owners)), pa.array(terms, pa.binary()).cast(pa.string())]
            rows = pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                                              names=["lang", "source", "term", "n", "docs"])
            yield from (rows.slice(at, 1 << 16) for at in range(0, rows.num_rows, 1 << 16))
        texts.clear()
        groups.clear()

    held = 0
    for batch in batches:
        keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for key, text in zip(keys, batch.column("text"), strict=True):
            texts.append(text.as_buffer().to_pybytes())
            groups.append(numbers.setdefault(key, len(numbers)))
            held += len(texts[-1])
            if held >= BATCH_BYTES:
                yield from counted()
                held = 0
    yield from counted()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all documents."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = rows.mapInArrow(_partials, _COUNTS)
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _div(a: Column, b: Column) -> Column:
    """Whole quotient, exact for whole numbers of any type."""
    return F.call_function("div", a, b)


def share(n: Column, total: Column, kept: Column) -> Column:
    """Smoothed share of a term in parts of ``SCALE``, rounded down, plus 1; counts may be as long as a BIGINT."""
    over = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return 1 + _div(over, (total + kept).cast("decimal(19,0)"))


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of two shares."""
    return _div((p - q) * (p - q), q)


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Rank the items of a group and part from 1; ``most`` limits inside each task before the shuffle."""
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def kept_terms(counts: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, lang_n): the terms of a language that enough of its documents have."""
    by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    return by_term.where(F.col("docs") >= min_documents).select("lang", "term", "lang_n")


def term_part(shares: DataFrame, ranks: int = TERM_RANKS) -> DataFrame:
    """The terms that a group has more of than its language, by excess."""
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    above = shares.withColumn("q", q).where("p > q")
    value = excess(F.col("p"), F.col("q")).alias("value")
    return _ranked(above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value), ranks)


def pair_part(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """Divergence of every group from each other source of its language, over all kept terms.

    A sum over all kept terms of a language is taken apart: what each pair would have if no term were in
    both, from histograms of shares and the share ``p0`` of an absent term; and corrections from terms in both.
    """
    exact = lambda value: value.cast("decimal(38,0)")
    own = groups.select("lang", "source", "p0", "kept", "own_terms")
    other = own.select("lang", *[F.col(c).alias(f"o_{c}") for c in ("source", "p0", "own_terms")])
    pairs = own.join(other, "lang").where("source <> o_source")
    absent = exact(F.col("kept") - F.col("own_terms") - F.col("o_own_terms"))
    rest = pairs.select(
        "lang", "source", "o_source", F.coalesce(absent * excess(F.col("p0"), F.col("o_p0")), exact(F.lit(0))).alias("v")
    )
    histogram = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    here = histogram.join(other, "lang").where("source <> o_source")
    here = here.select("lang", "source", "o_source", (exact(F.col("k")) * excess(F.col("p"), F.col("o_p0"))).alias("v"))
    there = histogram.withColumnRenamed("source", "o_source").join(own, "lang").where("source <> o_source")
    there = there.select("lang", "source", "o_source", (exact(F.col("k")) * excess(F.col("p0"), F.col("p"))).alias("v"))

    a = shares.select("lang", "term", *[F.col(c).alias(f"a_{c}") for c in ("source", "p", "p0")])
    b = shares.select("lang", "term", *[F.col(c).alias(f"b_{c}") for c in ("source", "p", "p0")])
    both = a.join(b, ["lang", "term"]).where("a_source < b_source")

    def correction(x: str, y: str) -> Column:
        p, p0, q, q0 = F.col(f"{x}_p"), F.col(f"{x}_p0"), F.col(f"{y}_p"), F.col(f"{y}_p0")
        return F.sum(exact(excess(p, q) - excess(p, q0) - excess(p0, q) + excess(p0, q0)))

    both = both.groupBy("lang", "a_source", "b_source").agg(correction("a", "b").alias("ab"), correction("b", "a").alias("ba"))
    ab = both.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("o_source"), F.col("ab").alias("v"))
    ba = both.select("lang", F.col("b_source").alias("source"), F.col("a_source").alias("o_source"), F.col("ba").alias("v"))
    parts = rest.unionByName(here).unionByName(there).unionByName(ab).unionByName(ba)
    summed = parts.groupBy("lang", "source", "o_source").agg(F.sum("v").cast("bigint").alias("value"))
    return _ranked(summed.select("lang", "source", F.lit("pair").alias("part"), F.col("o_source").alias("item"), "value"))


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` and ``term`` of every occurring (lang, source)."""
    group = ["lang", "source"]
    counts = written(term_counts(docs), "audit-counts")
    kept = kept_terms(counts, min_documents)
    own = written(counts.drop("docs").join(kept, ["lang", "term"]), "audit-kept")
    by_term = own.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))
    langs = by_term.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = own.groupBy(*group).agg(F.sum("n").alias("total"), F.count("*").alias("own_terms"))
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in group]).distinct()
    groups = groups.join(totals, group, "left").join(langs, "lang", "left").fillna(0)
    absent = F.when(F.col("kept") > 0, share(F.lit(0).cast("bigint"), F.col("total"), F.col("kept")))
    groups = written(groups.withColumn("p0", absent), "audit-groups")  # a row for each source of a language
    shares = own.join(groups.drop("own_terms"), group)
    shares = shares.withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    return pair_part(shares, groups).unionByName(term_part(shares, ranks))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE = f"""WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '{_TERM}') AS terms FROM documents),
words AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS lang_n FROM words GROUP BY lang, term
  HAVING count(DISTINCT d) >= {MIN_DOCUMENTS}),
langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(lang_n) AS HUGEINT) AS lang_total FROM kept GROUP BY lang),
own AS (SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS n FROM words w
  JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, w.source, w.term),
groups AS (SELECT g.lang, g.source, coalesce(t.total, 0) AS total, l.v, l.lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM own GROUP BY lang, source) t
    ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN langs l ON l.lang = g.lang),
shares AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
    1 + ({SCALE} * (coalesce(o.n, 0) + 1)) // (g.total + g.v) AS p,
    1 + ({SCALE} * (k.lang_n + 1)) // (g.lang_total + g.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source
  GROUP BY a.lang, a.source, b.source),
both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM shares WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM both_parts
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= {TERM_RANKS}"""
