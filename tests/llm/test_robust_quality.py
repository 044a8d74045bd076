import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import robust_quality as rq
from tapeloom.llm.common import table

SCALE = rq.SCALE
PRECISION = SCALE * np.array(list(rq.PRECISION.values()))


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": n < 20 or 100 * len(covered) > 30 * n,
        "lines": len(lines),
        "echoes": sum(a == b for a, b in zip(words, words[1:], strict=False)),
        "capitals": len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text)),
    }


def half_up(x):
    return math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)


def plain_vector(c):
    n = c["n_words"] + 20
    return [half_up(SCALE * v) for v in (
        math.log((c["word_chars"] + 100) / n), math.log1p(c["n_symbols"] / n), c["echoes"] / n,
        c["n_dup_lines"] / (c["lines"] + 5), c["capitals"] / (c["word_chars"] + 100),
    )]


def plain_distance(x, centre, root):
    return (np.linalg.solve(root, (x - centre).T) ** 2).sum(axis=0)


def plain_fit(x):
    """Concentration steps on one group with plain numpy."""
    median = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]
    centre = median(x)
    root = np.diag(np.sqrt((1.4826 * median(np.abs(x - centre))) ** 2 + PRECISION**2))
    for _ in range(rq.C_STEPS):
        bins = np.floor(64 * np.log1p(plain_distance(x, centre, root)))
        last = np.sort(bins)[math.ceil(rq.H_SHARE * len(x)) - 1]
        near = x[bins <= last]
        centre = near.mean(axis=0)
        root = np.linalg.cholesky(rq.CONSISTENCY * np.cov(near.T, bias=True) + np.diag(PRECISION**2))
    return centre, root


def plain_kept(rows):
    """doc key -> kept, for (key, text, lang, source) rows."""
    counts = {k: plain_counts(t) for k, t, _, _ in rows}
    vectors = {k: plain_vector(c) for k, c in counts.items() if c["n_words"]}
    size = Counter((lang, source) for k, _, lang, source in rows if k in vectors)
    pool = Counter()
    for (lang, _), n in size.items():
        pool[lang] += n if n < rq.MIN_GROUP else 0
    group = lambda o: o if size[o] >= rq.MIN_GROUP else o[0] if pool[o[0]] >= rq.MIN_GROUP else 0
    members = defaultdict(list)
    for k, _, lang, source in rows:
        if k in vectors:
            members[group((lang, source))].append(k)
    kept = dict.fromkeys(counts, False)
    for keys in members.values():
        x = np.array([vectors[k] for k in keys], dtype=float)
        for k, d in zip(keys, plain_distance(x, *plain_fit(x)), strict=True):
            kept[k] = bool(d <= rq.CUTOFF and not counts[k]["base_failed"])
    return kept


def random_texts():
    rng = random.Random(6)
    out = ["", " \n", "a\n\na\n a\nb", "\x0b\x0c", "x " * 7, "x " * 8, "x " * 9, "é # | <b>\n" * 30]
    for _ in range(150):
        words = [rng.choice("abc") if rng.random() < 0.5 else f"w{rng.randrange(9)}" for _ in range(rng.randrange(60))]
        out.append("".join(w + rng.choice([" ", "\n", "\t", "  ", "\x0b", "# "]) for w in words))
    return out


def test_counts(spark, texts):
    some = [*random_texts(), *texts.values()]
    rows = spark.createDataFrame(list(enumerate(some)), "i int, text string")
    for r in rq.statistics(rows, F.col("text")).collect():
        want = plain_counts(some[r["i"]])
        got = r["stats"].asDict()
        assert got.pop("x") == plain_vector(want)
        assert got == {k: want[k] for k in got}


@pytest.fixture(scope="module")
def many(spark):
    return table(spark, "/root/testdata/sf0.01", "documents")


def test_verdicts_equal_plain_estimates(many):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in many.collect()]
    got = {r["doc_id"]: r["kept"] for r in rq.quality_verdicts(many).collect()}
    assert got == plain_kept(rows)


def test_clean_documents_stay_and_bad_ones_go(spark, many):
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    rows = rq.quality_verdicts(many).join(labels, "doc_id").collect()
    good = [r["kept"] or r["base_failed"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05


def test_a_third_of_outliers_does_not_pull_the_estimates(spark):
    rng = random.Random(9)
    prose = lambda: " ".join("abcdefgh"[: rng.randint(3, 8)] + str(i) for i in range(rng.randint(60, 200)))
    rows = [(i, prose() if i % 3 else " ".join(f"{w}###" for w in prose().split()), "en", "s") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in rq.quality_verdicts(docs).collect()}
    assert all(kept[i] == bool(i % 3) for i in range(600))


def test_odd_rows(odd, clashing):
    got = rq.quality_verdicts(odd).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["n_words"] == 0 and by_id[1]["base_failed"] and not by_id[1]["kept"]
    assert by_id[9]["n_repeat_words"] == 3000 and by_id[9]["base_failed"]
    out = rq.keep_good(clashing)
    assert out.columns == clashing.columns
    assert {r["stats"] for r in out.collect()} <= {"mine stats"}
    want = sorted((r["doc_id"] or 0) for r in got if r["kept"])
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == want
    assert rq.quality_verdicts(odd.where("false")).count() == 0 and rq.keep_good(odd.where("false")).count() == 0
    assert rq.quality_verdicts(odd.where("text IS NULL")).where("kept").count() == 0


def test_plan_has_no_python(docs):
    rows = rq.statistics(docs, F.col("text"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
