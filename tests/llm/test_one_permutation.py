import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import one_permutation as op


def plain_set(text):
    lower = (text or "").translate({o: o + 32 for o in range(65, 91)} | {o: 32 for o in range(9, 14)})
    words = [w for w in lower.split(" ") if w]
    return frozenset(" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def plain_classes(rows):
    """(doc_id, size, component_id, kept) of rows (doc_id, text), by comparing all pairs of sets."""
    sets = [plain_set(t) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=sorted)
    root = list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(distinct):
        for j in range(i):
            both = len(a & distinct[j])
            if 100 * both >= 80 * (len(a) + len(distinct[j]) - both):
                root[find(i)] = find(j)
    place = {s: i for i, s in enumerate(distinct)}
    first = {}
    for (doc_id, _), s in zip(rows, sets, strict=True):
        if s and doc_id is not None:
            r = find(place[s])
            first[r] = min(first.get(r, doc_id), doc_id)
    out = []
    for (doc_id, _), s in zip(rows, sets, strict=True):
        component = first.get(find(place[s])) if s else doc_id
        out.append((doc_id, len(s), component, doc_id == component))
    return sorted(out, key=repr)


def _got(df):
    return sorted((tuple(r) for r in op.near_duplicates(df).collect()), key=repr)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_sets(texts):
    for text in [*texts.values(), "", None, "One", "one two THREE", "A b\tC\vd\n", "ÉtÉ x y z w", "a a a a a a"]:
        got = op.shingle_set(text)
        assert len(got) == len(plain_set(text)) and (np.diff(got.astype(object)) > 0).all()
    assert (op.shingle_set("A b C d e") == op.shingle_set("a  B\tc D E\n")).all()


def test_bins_hold_minima_and_other_bins_values():
    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 50, 400, 5000):
        items = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        bins = op.bins_of(items)
        at = [int(x) * op.BINS >> 64 for x in items.tolist()]
        for k in range(op.BINS):
            own = [x for x, b in zip(items.tolist(), at, strict=True) if b == k]
            if not own:  # the first filled bin in this bin's order
                filled = set(at)
                other = min(filled, key=lambda b: op._ORDER[k, b])
                own = [x for x, b in zip(items.tolist(), at, strict=True) if b == other]
            assert int(bins[k]) == min(own)


@pytest.mark.parametrize("size", [5, 20, 100, 1000])
def test_pairs_at_the_limit_share_buckets(size):
    """Of 400 pairs that are just similar enough every one shares a bucket."""
    rng = np.random.default_rng(size)
    fewest = op.BANDS
    for _ in range(400):
        whole = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
        lost = size - -(-80 * size // 100)
        a, b = np.sort(whole[: size - lost // 2]), np.sort(np.concatenate([whole[: size - lost], whole[size - lost // 2 :]]))
        assert op.linked(a, b)
        fewest = min(fewest, int((op.keys_of(op.bins_of(a)) == op.keys_of(op.bins_of(b))).sum()))
    assert fewest > 0


def test_confirmation_at_the_limit():
    a = np.arange(100, dtype=np.uint64)
    for cut, want in ((80, True), (79, False)):
        assert op.linked(a, a[:cut]) is want and op.linked(a[:cut], a) is want
    # 8 of 10 and 8 of 10: 8 common of 12.
    assert not op.linked(a[:10], a[2:12]) and op.linked(a[:18], a[2:20])


def test_postings_in_parts_count_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 60, 200, dtype=np.uint64))
    sets = [np.sort(rng.choice(base, rng.integers(100, 190), replace=False)) for _ in range(40)]
    roots, blocks = [bytes([i]) for i in range(40)], np.zeros(40, dtype=np.int64)

    def classes():
        root = list(range(40))
        for a, b in op._list_links(sets, roots, blocks):
            root = [root[a] if x == root[b] else x for x in root]
        return [root.index(x) for x in root]

    want = list(range(40))
    for i in range(40):
        for j in range(i):
            if op.linked(sets[i], sets[j]):
                want = [want[j] if x == want[i] else x for x in want]
    assert classes() == [want.index(x) for x in want] and len(set(want)) < 40
    monkeypatch.setattr(op, "_POSTINGS", 50)
    assert classes() == [want.index(x) for x in want]


def _clusters(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for size in (2, 5, 60):
        base = [word() for _ in range(rng.randrange(30, 80))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(5)):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text))
    # A chain: each text is like the next, its ends share nothing.
    long = [word() for _ in range(400)]
    rows += [" ".join(long[i : i + 100]) for i in range(0, 300, 10)]
    # A passage that many texts share is no link.
    passage = " ".join(word() for _ in range(50))
    rows += [f"{passage} {' '.join(word() for _ in range(50))}" for _ in range(40)]
    rows += ["", None, "a b", "A B", "a b c", "a b c d", "a b c d e", rows[0], rows[0]]
    return [(1000 + 7 * i % 501, t) for i, t in enumerate(rows)]


def test_components_equal_brute_force(spark):
    rows = _clusters(5)
    assert _got(_frame(spark, rows)) == plain_classes(rows)


@pytest.mark.parametrize("most", [2048, 20])
def test_stars_alone_would_lose_links_that_the_lists_find(spark, monkeypatch, most):
    """With one bucket for all texts there is one star; all other links have to come from lists, in blocks or not."""
    rows = _clusters(6)
    monkeypatch.setattr(op, "LIST_SETS", most)
    want = plain_classes(rows)
    nodes, sets = {}, {}
    for _, text in rows:
        items = op.shingle_set(text)
        if len(items):
            node = hashlib.md5(items.tobytes()).digest()
            nodes[node], sets[node] = (node, len(items), [0]), (node, items.tobytes())
    wanted = spark.createDataFrame([(bytearray(a), n, k) for a, n, k in nodes.values()], "node binary, n bigint, keys array<bigint>")
    held = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in sets.values()], "node binary, items binary")
    edges = [(bytes(r["a"]), bytes(r["b"])) for r in op.links(wanted, lambda _: held).collect()]
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        root[find(a)] = find(b)
    assert len({find(n) for n in nodes}) == len({r[2] for r in want if r[1]})


def test_components_of_the_table(docs, texts):
    assert _got(docs) == plain_classes(list(texts.items()))


def test_odd_rows(odd, clashing):
    want = plain_classes([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert _got(odd) == want
    wide = clashing.select("*", *[F.lit("mine").alias(c) for c in ("node", "keys", "items", "s", "n", "text_hash", "root", "a")])
    assert _got(wide) == want
    assert _got(odd.where("false")) == []
    assert _got(odd.where("text = '' OR text IS NULL")) == [r for r in want if r[1] == 0 and r[0] != 3]
