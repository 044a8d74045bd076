import hashlib
import random
import struct

import xxhash
from pyspark.sql import functions as F

from tapeloom.llm import order_minhash as om


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def h(*values, seed=42):
    """The hash that SQL gives for long, (value, int) and string arguments."""
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
        seed &= (1 << 64) - 1
    return _signed(seed)


def plain_slots(text):
    words = [w for w in text.translate({o: 32 for o in range(9, 14)}).split(" ") if w]
    hashes = [h(w) for w in words]
    if not hashes:
        return [0] * om.SLOTS
    kmers = [h(*hashes[i : i + om.K]) for i in range(len(hashes) - om.K + 1)] or [h(*hashes)]
    seen, points = {}, []
    for at, kmer in enumerate(kmers):
        n = seen[kmer] = seen.get(kmer, -1) + 1
        points.append((h(kmer, (n,)), at))
    width = 1 << (64 - om.SLOT_BITS)
    out = []
    for j in range(om.SLOTS):
        zero = (j - om.SLOTS // 2) * width
        nearest = sorted(points, key=lambda p: ((p[0] - zero) % (1 << 64), p[1]))[: om.ELL]
        out.append(h(*[p[0] for p in sorted(nearest, key=lambda p: p[1])]) & 0xFFFFFFFF)
    return out


def slots_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["s"] for r in rows.select("i", om.slots(F.col("text")).alias("s")).orderBy("i").collect()]


def test_slots_match_brute_force(spark, texts):
    rng = random.Random(2)
    made = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(40)]
    some = [*list(texts.values())[:40], *made, "", "one", "one two", "one two three", "a b " * 300, " \n\t "]
    assert slots_of(spark, some) == [plain_slots(t) for t in some]


def test_likeness_follows_edits(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    moved = words[300:] + words[:300]
    few = words[:570] + [f"n{i}" for i in range(30)]
    many = words[:200] + [f"n{i}" for i in range(400)]
    base, same, edited, changed, mixed = slots_of(
        spark, [" ".join(w) for w in (words, words, few, many, rng.sample(words, len(words)))]
    )
    near = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / om.SLOTS
    assert near(base, same) == 1
    assert near(base, edited) > 0.6 > near(base, changed)
    assert near(base, mixed) < 0.2  # the same words in another order
    assert near(base, slots_of(spark, [" ".join(moved)])[0]) > 0.2


def _edited(rows):
    ordered = sorted(rows, key=lambda r: r[0], reverse=True)
    out = {}
    for i, (doc_id, text) in enumerate(ordered):
        third = len(text) // 3
        out[doc_id] = text[: len(text) - third] + ordered[(i + 1) % len(ordered)][1][:third]
    return out


def test_edits_and_next_documents(docs, texts):
    got = {r["doc_id"]: r for r in om.order_minhash(docs).collect()}
    edited = _edited(list(texts.items()))
    ordered = sorted(texts, reverse=True)
    slots = {d: plain_slots(t) for d, t in texts.items()}
    share = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / om.SLOTS
    for i, d in enumerate(ordered):
        r, after = got[d], ordered[(i + 1) % len(ordered)]
        assert r["n_chars"] == len(texts[d])
        assert r["edited_sha256"] == hashlib.sha256(edited[d].encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{s:08x}" for s in slots[d])
        assert r["near_next"] == share(slots[d], slots[after])
        assert r["near_edited"] == share(slots[d], plain_slots(edited[d]))


def test_odd_rows(spark, odd):
    got = om.order_minhash(odd).collect()
    assert len(got) == odd.count()
    twins = [r for r in got if r["doc_id"] == 6 and r["n_chars"] == 15]
    assert len(twins) == 2 and twins[0] == twins[1]
    assert om.order_minhash(odd.where("false")).count() == 0
    single = spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")
    row = om.order_minhash(single).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and row["near_next"] == 1.0


def test_plan_has_no_python_and_one_shuffle_of_texts(docs):
    plan = om.order_minhash(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
