from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tapeloom.llm import mixing
from tests.compare import compare, oracle_connection

from .conftest import SF


def plain_targets(sizes):
    """Weights 1, 2, 3 in code point order; shares above three times a size are dealt again until none is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weights[s] / sum(weights[o] for o in open_) for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in above}


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 10, "b": 20, "c": 30}, {"a": 1, "b": 1, "c": 1000, None: 50}, {"z": 0, "a": 7, "é": 100, "Z": 3},
        {f"s{i}": (i * 37) % 11 * (100 if i % 5 == 0 else 1) for i in range(23)}, {"only": 5}, {"a": 0, None: 0}, {"b": 3, "": 900},
    ],
)
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_query_equals_sql(spark):
    columns, names, ours, theirs = compare(spark, oracle_connection(SF), mixing.op5_source_mix, mixing.ORACLE, SF)
    assert columns == names and ours == theirs and ours


def test_taken_words_come_near_the_target(spark, monkeypatch):
    rows = [(i, "w " * (1 + i * i % 40), "hot" if i % 3 else f"s{i % 7}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).collect()
    source = {i: s for i, _, s in rows}
    taken, target, most = Counter(), {}, defaultdict(int)
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        most[source[r["doc_id"]]] = max(most[source[r["doc_id"]]], r["size"])
        assert r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"]
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in got))
    for s in target:
        assert abs(taken[s] - target[s]) <= 2 * most[s]
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_block_length_does_not_matter(docs, monkeypatch):
    first = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BLOCK_DIGITS", 1)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == first


def test_emitted_documents(docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = out.groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("words"))
    got = {r["source"]: r["words"] for r in words.collect()}
    sizes = docs.groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("n"), F.max(mixing.size_of(F.col("text"))).alias("m"))
    rows = {r["source"]: r for r in sizes.collect()}
    for source, target in plain_targets({s: r["n"] for s, r in rows.items()}).items():
        assert abs(got.get(source, 0) - target) <= 2 * rows[source]["m"]
    assert max(Counter(r["doc_id"] for r in out.collect()).values()) <= 3
    assert out.join(docs, docs.columns, "left_anti").count() == 0


def test_odd_rows(odd, clashing):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    assert {r["source_size"] for r in got if r["doc_id"] == 3} == {0}
    out = mixing.mixed(clashing)
    assert out.columns == clashing.columns
    rows = Counter(map(str, clashing.collect()))
    for row, n in Counter(map(str, out.collect())).items():
        assert row in rows and n <= 3 * rows[row]
    assert mixing.mix(odd.where("false")).count() == 0 and mixing.mixed(odd.where("false")).count() == 0
    assert mixing.mix(odd.where("text IS NULL")).agg(F.sum("taken")).first()[0] == 0


def test_one_repeated_row_is_numbered_in_parts(spark, monkeypatch):
    """A third of all rows are one row without an id: their places follow one another, whatever the parts."""
    rows = [(None, "one two three", "en", "hot", 13)] * 5000 + [(i, "word " * (i % 7), "en", f"s{i % 4}", i) for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int").repartition(8)

    def taken():
        got = mixing.mix(docs).where("doc_id IS NULL").collect()
        return Counter(r["taken"] for r in got), got[0]["target"]

    first, target = taken()
    assert sum(first.values()) == 5000 and abs(sum(t * n for t, n in first.items()) - target) <= 3
    assert len(first) <= 2 and max(first) <= 9  # neighbours of one size: whole copies next to each other
    monkeypatch.setattr(mixing, "PART_ROWS", 64)
    assert taken()[0] == first
    out = mixing.mixed(docs).where("doc_id IS NULL")
    assert abs(3 * out.count() - target) <= 3
