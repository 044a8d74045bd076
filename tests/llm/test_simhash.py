import random

import numpy as np
import xxhash

from tapeloom.llm import simhash


def plain_fingerprint(text):
    lower = text.translate({o: o + 32 for o in range(65, 91)} | {o: 32 for o in range(9, 14)})
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Root (smallest member) of each distinct fingerprint, by comparing all pairs."""
    prints = np.unique(np.array(prints, dtype=np.uint64))
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {int(p): find(i) for i, p in enumerate(prints)}


def test_fingerprints(texts):
    for text in [*texts.values(), "", "One", "one two", "A b\tC\vd\n", "ÉtÉ   x"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == 0


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = " ".join(str(i % 50) for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    assert simhash.fingerprint(text) == whole


def test_every_allowed_difference_shares_a_mask_at_every_level():
    """Whatever 3 bits differ, some chain of masks keeps the pair together down to the last level."""
    rng = random.Random(3)
    for _ in range(300):
        differs = sum(1 << b for b in rng.sample(range(64), 3))
        kept = [m for m in simhash.first_masks() if not m & differs]
        while True:
            assert kept
            if min(bin(m).count("1") for m in kept) > 8 * simhash.MIN_SHARED:
                break
            kept = [w for m in kept for w in simhash.wider_masks(m) if not w & differs]


def test_last_lists_are_bounded():
    assert {64 - bin(m).count("1") for m in simhash.mask_levels()[-1]} == {12}
    assert 1 << 12 <= simhash.GROUP_LIMIT


def _dense(seed, clusters, size):
    rng = random.Random(seed)
    prints = {0}
    for _ in range(clusters):
        centre = rng.getrandbits(64)
        for _ in range(size):
            prints.add(centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1)
        prints |= {rng.getrandbits(64) for _ in range(5)}
    return sorted(prints)


def test_dense_lists_lose_no_link(spark):
    prints = _dense(5, 6, 60)
    want = plain_components(prints)
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    frame = spark.createDataFrame(rows, "doc_id bigint, fp bigint")
    for limit in (4096, 2):
        got = {r["fp"] & (1 << 64) - 1: r["component_id"] for r in simhash.near_duplicates(frame, limit).collect()}
        classes = {}
        for p, c in got.items():
            classes.setdefault(c, set()).add(want[p])
        assert len(got) == len(prints)
        assert all(len(v) == 1 for v in classes.values()) and len(classes) == len(set(want.values()))


def test_components_of_the_table(docs, texts):
    got = simhash.simhash_components(docs).collect()
    prints = {d: simhash.fingerprint(t) for d, t in texts.items()}
    roots = plain_components(list(prints.values()))
    first = {}
    for d in sorted(prints):
        first.setdefault(roots[prints[d]], d)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {
        d: (f"{p:016x}", first[roots[p]]) for d, p in prints.items()
    }


def test_chains_and_stars_contract(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (900, 901)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 900: 900, 901: 900}


def test_odd_rows(odd, clashing):
    got = simhash.simhash_components(odd).collect()
    assert len(got) == odd.count()
    blank = [r for r in got if r["fingerprint"] == "0" * 16]
    assert {r["component_id"] for r in blank} == {1} and len(blank) == 4
    assert [r["component_id"] for r in got if r["doc_id"] in (4, 5)] == [4, 4]
    one = simhash.keep_one(clashing)
    assert one.columns == clashing.columns
    kept = sorted((r["doc_id"] is None, r["doc_id"]) for r in one.collect())
    assert [k[1] for k in kept if not k[0]].count(6) == 2  # two different texts under one id
    assert simhash.keep_one(odd.where("false")).count() == 0
    assert simhash.simhash_components(odd.where("false")).count() == 0


def test_one_document_of_each_group_stays(docs):
    classes = simhash.simhash_components(docs)
    kept = simhash.keep_one(docs)
    want = {r["component_id"] for r in classes.collect()}
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(want)
    assert kept.join(docs, docs.columns, "left_anti").count() == 0
