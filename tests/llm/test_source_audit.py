import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tapeloom.llm import source_audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {o: o + 32 for o in range(65, 91)}


def plain_terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain_audit(rows, least=3, ranks=200):
    """``rows`` of (lang, source, text): every pair and term by straight loops in Python's whole numbers."""
    rows = [((lang or "", source or ""), plain_terms(text)) for lang, source, text in rows]
    out = []
    for lang in {key[0] for key, _ in rows}:
        documents, counts, total = Counter(), defaultdict(Counter), Counter()
        for key, terms in rows:
            if key[0] == lang:
                documents.update(set(terms))
                counts[key[1]].update(terms)
                total.update(terms)
        kept = sorted(t for t, n in documents.items() if n >= least)

        def shares(found, kept=kept):
            n = sum(found[t] for t in kept)
            return {t: 1 + 10**9 * (found[t] + 1) // (n + len(kept)) for t in kept}

        own, whole = {s: shares(c) for s, c in counts.items()}, shares(total)
        for source in counts:
            pairs = [
                (-sum((own[source][t] - own[o][t]) ** 2 // own[o][t] for t in kept), o.encode()) for o in counts if o != source
            ]
            terms = [
                (-((own[source][t] - whole[t]) ** 2 // whole[t]), t.encode())
                for t in kept
                if counts[source][t] and own[source][t] > whole[t]
            ]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, source, part, i.decode(), -v, r) for r, (v, i) in enumerate(items, 1)]
    return sorted(out)


def _rows(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def _tables(texts, groups):
    return {
        (g, t): [n, d]
        for owners, terms, ns, ds in source_audit.count_terms([t.encode() for t in texts], np.array(groups, dtype=np.int64))
        for g, t, n, d in zip(owners.tolist(), terms, ns.tolist(), ds.tolist(), strict=True)
    }


def test_packed_counts_equal_plain_ones():
    rng = random.Random(2)
    for _ in range(300):
        texts = ["".join(rng.choice("aAbzZ éÉ中.1\0@[") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(12))]
        texts += ["x" * k for k in (0, 7, 8, 9, 15, 16, 17, 40) if rng.random() < 0.4]
        groups = [rng.randrange(3) for _ in texts]
        want = defaultdict(lambda: [0, 0])
        for text, group in zip(texts, groups, strict=True):
            for term, n in Counter(plain_terms(text)).items():
                row = want[group, term.encode()]
                row[0] += n
                row[1] += 1
        assert _tables(texts, groups) == dict(want)


def test_radix_order_is_stable_and_sorted():
    rng = np.random.default_rng(4)
    for high in (3, 1 << 20, 1 << 63):
        words = [rng.integers(0, high, 500, dtype=np.uint64) for _ in range(2)]
        assert (source_audit.radix_order(words) == np.lexsort(words[::-1])).all()
    assert len(source_audit.radix_order([np.empty(0, dtype=np.uint64)])) == 0


def test_counts_do_not_depend_on_the_batches(monkeypatch):
    rows = [("en", f"s{i % 3}", f"one two{i % 5} averyveryverylongterm {'y' * i}") for i in range(40)]
    columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, names=["lang", "source", "text"])

    def totals():
        out = defaultdict(lambda: [0, 0])
        for part in source_audit._partials(iter([batch, batch])):
            for r in part.to_pylist():
                out[r["lang"], r["source"], r["term"]][0] += r["n"]
                out[r["lang"], r["source"], r["term"]][1] += r["docs"]
        return dict(out)

    whole = totals()
    monkeypatch.setattr(source_audit, "BATCH_BYTES", 100)
    assert totals() == whole and whole["en", "s0", "averyveryverylongterm"] == [28, 28]


def test_shares_of_huge_counts_are_exact(spark):
    rows = [(5 * 10**11, 10**13, 10**8), (0, 0, 1), (9 * 10**17, 9 * 10**17, 7)]
    df = spark.createDataFrame(rows, "n bigint, total bigint, kept bigint")
    got = df.select(source_audit.share(F.col("n"), F.col("total"), F.col("kept"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 1) // (t + k) for n, t, k in rows]


def test_audit_equals_plain_loops(spark):
    rng = random.Random(8)
    vocabulary = [f"w{chr(97 + k)}" for k in range(20)] + ["Straße", "éa", "z" * 30, "中文"]
    rows = []
    for i in range(120):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None, "B"])
        rows.append((i, lang, source, " ".join(rng.choices(vocabulary[: 8 + len(source or "")], k=rng.randrange(30)))))
    rows += [(500, "xx", "only", "a b c"), (501, "yy", "p", "rare"), (502, "yy", "q", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string")
    for ranks in (200, 3):
        assert _rows(source_audit.audit(df, ranks=ranks)) == plain_audit([r[1:] for r in rows], ranks=ranks)


def test_odd_rows(odd, clashing):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd.collect()]
    want = plain_audit(rows)
    assert _rows(source_audit.audit(odd)) == want
    wide = clashing.select("*", *[F.lit(1).alias(c) for c in ("term", "n", "docs", "part", "item", "rank ")])
    assert _rows(source_audit.audit(wide)) == want
    assert _rows(source_audit.audit(odd.where("false"))) == []
