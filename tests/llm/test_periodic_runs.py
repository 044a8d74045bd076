import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import periodic_runs


def plain_runs(words, least=12):
    """All runs by looking along every distance: (start, length, smallest period), by start, then period."""
    n, found = len(words), {}
    numbers = np.unique(np.array(words), return_inverse=True)[1]
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[0], numbers[:-q] == numbers[q:], [0]]).astype(np.int8)
        starts, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for start, length in zip(starts.tolist(), (ends - starts + q).tolist(), strict=True):
            if length >= max(least, 2 * q):
                found.setdefault((start, length), q)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_digests(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id,
        len(runs),
        *best,
        1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def _sequences(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        n, letters = rng.randrange(140), rng.choice([1, 2, 3, 5, 30])
        words = [rng.randrange(letters) for _ in range(n)]
        if n > 10 and rng.random() < 0.6:
            p, s = rng.randrange(1, n // 3 + 1), rng.randrange(n)
            words = [words[i] if i < s else words[s + (i - s) % p] for i in range(n)]
        if n and rng.random() < 0.4:
            words[rng.randrange(n)] = 99
        yield words


@pytest.mark.parametrize("least", [2, 12])
def test_runs_equal_the_plain_search(least):
    for words in _sequences(least, 700):
        got = periodic_runs.runs_of(np.array(words, dtype=np.int64), least)
        assert [tuple(r) for r in got.tolist()] == plain_runs(words, least), words


def test_extensions_of_every_pair():
    for words in _sequences(5, 60):
        n = len(words)
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n + 1)]
        if not pairs:
            continue
        i, j = np.array(pairs).T
        got = periodic_runs.Extensions(np.array(words, dtype=np.int64))(i, j)
        for (a, b), length in zip(pairs, got.tolist(), strict=True):
            want = next((k for k in range(n - b) if words[a + k] != words[b + k]), n - b)
            assert length == want


def test_the_cover_synchronises_every_distance():
    for a in range(periodic_runs.PERIOD):
        for b in range(periodic_runs.PERIOD):
            d = periodic_runs._SHIFT[a, b]
            assert {(a + d) % 13, (b + d) % 13} <= set(periodic_runs.COVER) and 6 <= d < 6 + 13


def test_grids_hold_every_pair_once_in_any_parts(monkeypatch):
    for n in (2, 3, 12, 50):
        want = sorted((i, q) for q in range(1, n // 2 + 1) for i in range(0, n - q, q))
        for most in (1, 7, 1 << 20):
            monkeypatch.setattr(periodic_runs, "GRID", most)
            got = [p for i, q in periodic_runs._grids(n) for p in zip(i.tolist(), q.tolist(), strict=True)]
            assert sorted(got) == want


def test_long_texts_stay_whole_and_quick():
    """A million words that are one run, and a Fibonacci word with very many."""
    same = np.zeros(1_000_000, dtype=np.int64)
    assert periodic_runs.runs_of(same).tolist() == [[0, 1_000_000, 1]]
    a, b = [0], [0, 1]
    while len(b) < 100_000:
        a, b = b, b + a
    runs = periodic_runs.runs_of(np.array(b[:100_000]))
    assert len(runs) < 100_000 and (runs[:, 1] >= 2 * runs[:, 2]).all()


def test_query_equals_brute_force(spark, docs, texts):
    got = sorted(tuple(r) for r in periodic_runs.run_digests(docs).collect())
    want = sorted(plain_digests(d, t) for d, t in texts.items())
    assert got == want and sum(r[1] > 0 for r in got) > 10


def test_odd_rows(odd, clashing):
    got = sorted(map(repr, (tuple(r) for r in periodic_runs.run_digests(odd).collect())))
    want = sorted(repr(plain_digests(r["doc_id"], r["text"])) for r in odd.collect())
    assert got == want
    wide = clashing.select("*", F.lit("mine").alias("runs"), F.lit("mine too").alias("periodic.runs"))
    out = periodic_runs.with_runs(wide, F.col("text"), "found")
    assert out.columns == [*wide.columns, "found"] and {r["runs"] for r in out.collect()} == {"mine"}
    found = {r["doc_id"]: r["found"] for r in out.collect()}
    assert found[9]["runs"] == [(0, 3000, 1)] and found[9]["collapsed"] == "word" and found[9]["n_words"] == 3000
    assert found[2]["runs"] == [] and found[2]["collapsed"] == ""
    assert periodic_runs.run_digests(odd.where("false")).count() == 0
