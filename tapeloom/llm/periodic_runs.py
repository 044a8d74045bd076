"""Periodic runs of words: harmonic grids over longest common extensions.

A run is a stretch of words with smallest period q, at least ``MIN_LENGTH`` words
and two periods long, that no neighbouring word extends.  For every q the grid
0, q, 2q, … meets each run of period q, so n/1 + n/2 + … pairs (i, i + q) are looked
at: how far the texts behind and before both places agree gives the run around them.

An extension first compares a few words one by one, up to the next distance at which
both places are in the sample of a difference cover.  Only the sampled suffixes are
sorted (blocks of ``PERIOD`` words, then doubling), and from there the extension is a
range minimum over their common prefixes, in a sparse table.  The sorted index of a text
is built when the first pair gets that far, one for the text and one for its reverse.

Everything is arrays over all pairs of a part of the grid (``GRID`` pairs), so memory
is bounded by some 200 bytes a word of the longest text and the time is n log n whatever
the text repeats.

Defined cases: a NULL, empty or blank text has no runs and collapses to the empty
text; a text shorter than ``MIN_LENGTH`` words has none; very long texts are whole in
one task and never cut; repeated rows each give their result; a NULL ``doc_id`` is
not rewritten by the query; an empty table gives an empty result; other columns pass
through untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import small_batches, table

MIN_LENGTH = 12
#: A perfect difference cover: every distance modulo ``PERIOD`` is one of two members.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Words compared one by one before the sample is asked at all.
DIRECT = 6
#: Pairs (i, i + q) that are looked at together.
GRID = 1 << 20

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
RESULT = f"n_words bigint, runs {RUNS}, collapsed string"


def _shifts() -> np.ndarray:
    """For residues (a, b): the least distance of at least ``DIRECT`` words that puts both into the cover."""
    member = np.isin(np.arange(PERIOD), COVER)
    out = np.zeros((PERIOD, PERIOD), dtype=np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            steps = range(DIRECT, DIRECT + PERIOD)
            out[a, b] = next(d for d in steps if member[(a + d) % PERIOD] and member[(b + d) % PERIOD])
    return out


_SHIFT = _shifts()
_PAD = DIRECT + 2 * PERIOD


class Extensions:
    """Longest common extensions of pairs of places of one sequence of word numbers."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.words = np.concatenate([words, np.full(_PAD, -1, dtype=words.dtype)])
        self.ranks: np.ndarray | None = None

    def _sort_sample(self) -> None:
        n, cover = self.n, [c for c in COVER if c < self.n]
        places = np.concatenate([np.arange(c, n, PERIOD) for c in cover])
        sizes = np.array([len(range(c, n, PERIOD)) for c in cover])
        ends = np.repeat(np.cumsum(sizes), sizes)
        self.first = np.full(PERIOD, -1, dtype=np.int64)  # of each residue class in ``places``
        self.first[cover] = np.cumsum(sizes) - sizes
        m = len(places)
        index = np.arange(m)
        # Blocks of PERIOD words; the end of the text counts as a word below all others.
        columns = [self.words[places + k] for k in range(PERIOD)]
        order = np.lexsort(columns[::-1])
        new = np.zeros(m, dtype=bool)
        for column in columns:
            new[1:] |= column[order[1:]] != column[order[:-1]]
        rank = np.empty(m, dtype=np.int64)
        rank[order] = np.cumsum(new) + 1
        levels, step = [rank], 1
        while rank.max() < m:
            ahead = index + step
            second = np.where(ahead < ends, rank[np.minimum(ahead, m - 1)], 0)
            rank = np.unique(rank * (m + 1) + second, return_inverse=True)[1] + 1
            levels.append(rank)
            step *= 2
        order = np.empty(m, dtype=np.int64)
        order[rank - 1] = index
        # Common prefixes of neighbours in the order: whole blocks by their ranks, then single words.
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), dtype=np.int64)
        open_ = np.ones(len(a), dtype=bool)
        for level in range(len(levels) - 1, -1, -1):
            inside = open_ & (a < ends[order[:-1]]) & (b < ends[order[1:]])
            here = np.minimum(a, m - 1), np.minimum(b, m - 1)
            same = inside & (levels[level][here[0]] == levels[level][here[1]])
            blocks = 1 << level
            a[same] += blocks
            b[same] += blocks
            common[same] += blocks * PERIOD
        at = places[order[:-1]] + common, places[order[1:]] + common
        live = np.flatnonzero((at[0] < n) & (at[1] < n))
        for k in range(PERIOD):
            live = live[self.words[at[0][live] + k] == self.words[at[1][live] + k]]
            common[live] += 1
        self.minima = [common]
        while len(self.minima[-1]) > 1 << (len(self.minima) - 1):
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))
        self.ranks = rank - 1

    def _sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The extension of two places of the sample: a minimum between their ranks."""
        if self.ranks is None:
            self._sort_sample()
        a = self.ranks[self.first[i % PERIOD] + i // PERIOD]
        b = self.ranks[self.first[j % PERIOD] + j // PERIOD]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(i), dtype=np.int64)
        for k in np.unique(level):
            here = level == k
            row = self.minima[k]
            out[here] = np.minimum(row[low[here]], row[high[here] - (1 << int(k))])
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from ``i`` and ``j`` on; i < j, j up to the length of the text."""
        out = np.zeros(len(i), dtype=np.int64)
        shift = _SHIFT[i % PERIOD, j % PERIOD]
        live = np.arange(len(i))
        for k in range(DIRECT + PERIOD):
            if not len(live):
                return out
            arrived = shift[live] == k
            if arrived.any():
                done = live[arrived]
                # A place at the end of the text is not in the sample; nothing agrees there.
                inside = j[done] + k < self.n
                done = done[inside]
                out[done] += self._sampled(i[done] + k, j[done] + k)
                live = live[~arrived]
            live = live[self.words[i[live] + k] == self.words[j[live] + k]]
            out[live] += 1
        return out


def _grids(n: int):
    """Pairs (i, q) of the grids of all periods, some ``GRID`` of them at a time."""
    q = 1
    while q <= n // 2:
        last, total = q, n // q
        while last < n // 2 and total + n // (last + 1) <= GRID:
            last += 1
            total += n // last
        periods = np.arange(q, last + 1)
        counts = (n - 1) // periods
        rows = np.repeat(periods, counts)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        yield (np.arange(len(rows)) - first) * rows, rows
        q = last + 1


def runs_of(words: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    n = len(words)
    found = [np.empty((0, 3), dtype=np.int64)]
    if n >= max(2, min_length):
        ahead, back = Extensions(words), Extensions(words[::-1])
        for i, q in _grids(n):
            equal = words[i] == words[i + q]
            i, q = i[equal], q[equal]
            forward = ahead(i, i + q)
            # Words that agree before the pair: an extension of the reversed text.
            backward = back(n - i - q, n - i)
            # A run is taken at its first place of the grid, which has less than a period behind it.
            good = (backward < q) & (forward + backward >= np.maximum(q, min_length - q))
            i, q, forward, backward = i[good], q[good], forward[good], backward[good]
            found.append(np.stack([i - backward, backward + forward + q, q], axis=1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # The same stretch under a multiple of its smallest period is no other run.
    again = np.zeros(len(rows), dtype=bool)
    again[1:] = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
    rows = rows[~again]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: all but those behind the first period of a run."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def analysed(text: str | None) -> tuple[int, list[tuple[int, int, int]], str]:
    """Number of words, runs and collapsed text of one whole text."""
    words = (text or "").encode("utf-8").split()  # bytes: ASCII white space only
    numbers = pd.factorize(np.array(words, dtype=object))[0] if words else np.empty(0, dtype=np.int64)
    runs = runs_of(numbers)
    if len(runs):
        words = [words[k] for k in np.flatnonzero(collapsed(len(words), runs))]
    return len(numbers), [tuple(r) for r in runs.tolist()], b" ".join(words).decode("utf-8")


def _periodic(texts: pd.Series) -> pd.DataFrame:
    rows = [analysed(t) for t in texts]
    names = ("start", "length", "period")
    return pd.DataFrame(
        {
            "n_words": [r[0] for r in rows],
            "runs": [[dict(zip(names, run, strict=True)) for run in r[1]] for r in rows],
            "collapsed": [r[2] for r in rows],
        }
    )


def with_runs(df: DataFrame, text: Column, name: str = "periodic") -> DataFrame:
    """Add a struct: n_words, runs (start, length, period; by start, then period) and the collapsed text."""
    small_batches(df.sparkSession)
    return df.withColumn(name, F.pandas_udf(_periodic, RESULT)(text))


def longest(runs: Column) -> Column:
    """The run of greatest length; of several the smallest start, then period.  NULL without runs."""
    ordered = F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"]))
    best = F.array_min(ordered)
    return F.when(
        F.size(runs) > 0,
        F.struct(best["start"].alias("start"), (-best["less"]).alias("length"), best["period"].alias("period")),
    )


def repeated(text: str | None, h: int | None) -> str | None:
    """One document in ten (by its hash) goes on with its own words, again and again; others are unchanged."""
    words = (text or "").encode("utf-8").split()
    if h is None or h % 10 or not words:
        return text
    n, g = len(words), h // 10
    at = g % n
    period = 1 + (n - at) // (3 + g % 8)
    back = words[at : at + period]
    whole = (back * (1 + (n - at) // period))[: n - at]
    return b" ".join([*words[:at], *whole]).decode("utf-8")


def _repeated(texts: pd.Series, hashes: pd.Series) -> pd.Series:
    return pd.Series([repeated(t, None if pd.isna(h) else int(h)) for t, h in zip(texts, hashes, strict=True)], dtype=object)


def with_repeats(text: Column, doc_id: Column) -> Column:
    """The texts that the query looks at."""
    return F.pandas_udf(_repeated, "string")(text, F.crc32(doc_id.cast("string")))


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document: its number of runs, the longest one, and digests of all runs and of the collapsed text."""
    rows = docs.select("doc_id", with_repeats(F.col("text"), F.col("doc_id")).alias("text"))
    rows = with_runs(rows, F.col("text")).select("doc_id", "periodic")
    runs = F.col("periodic.runs")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")
    rows = rows.select(
        "doc_id",
        F.size(runs).cast("bigint").alias("n_runs"),
        longest(runs).alias("best"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.col("periodic.collapsed"), 256).alias("collapsed_sha256"),
    )
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint")
    return rows.select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        exponent.alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))
