import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import attention_mil as mil
from tapeloom.llm.common import table


def test_passages_cover_the_whole_text():
    text = " ".join(f"w{i}" for i in range(1050))
    encoded = mil.encode_passages(text)
    assert encoded.shape == (11, mil.FEATURES)
    changed = mil.encode_passages(text + " !!!!")
    assert (changed[:10] == encoded[:10]).all() and (changed[10] != encoded[10]).any()
    assert (mil.encode_passages(None) == mil.encode_passages("")).all() and len(mil.encode_passages(" ")) == 1


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(0)
    x, sizes, wanted = rng.normal(size=(14, mil.FEATURES)), np.array([1, 5, 3, 5]), np.array([0.0, 1.0, 1.0, 0.0])
    model = mil.GatedAttention(x)

    def loss():
        y = model._forward(x, sizes)["y"]
        return -(wanted * np.log(y) + (1 - wanted) * np.log(1 - y)).mean()

    gradients = model._gradients(x, model._forward(x, sizes), wanted)
    for name, values in model.p.items():
        for at in [np.unravel_index(i, values.shape) for i in (0, values.size // 2, values.size - 1)]:
            kept, step = values[at], 1e-6
            values[at] = kept + step
            above = loss()
            values[at] = kept - step
            below = loss()
            values[at] = kept
            assert gradients[name][at] == pytest.approx((above - below) / (2 * step), abs=1e-6), name


def test_attention_finds_the_telling_passage():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, mil.FEATURES))
    sizes = np.full(100, 4)
    wanted = np.arange(100) % 2
    x[::4][wanted == 0, 0] += 6  # one passage of four gives a bad bag away
    model = mil.GatedAttention(x).train(x, sizes, wanted.astype(float))
    assert ((model.score(x, sizes) >= 0.5) == wanted).mean() > 0.97
    parts = model._forward((x - model.mean) / model.scale, sizes)["a"].reshape(100, 4)
    assert parts.sum(axis=1) == pytest.approx(np.ones(100))


def _long_documents(spark):
    """Bad documents differ from good ones in passage 3 of 130."""
    plain, bad = " ".join(["word text line more"] * 25), " ".join(["#### $$$$ word"] * 33 + ["end"])
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % mil.HELD_OUT_OF]
    text = lambda i: " ".join([*[plain] * 3, plain if i % 2 else bad, *[plain] * 126])
    docs = spark.createDataFrame([(i, text(i)) for i in ids], "doc_id bigint, text string")
    return docs, spark.createDataFrame([(i, i % 2) for i in ids], "doc_id bigint, quality int"), ids, text


@pytest.mark.parametrize("batch", [1 << 16, 300])
def test_every_passage_of_a_labelled_document_teaches(spark, monkeypatch, batch):
    monkeypatch.setattr(mil, "BATCH_PASSAGES", batch)
    docs, labels, ids, text = _long_documents(spark)
    model = mil.fit(docs, labels)
    for i in ids:
        x = mil.encode_passages(text(i))
        assert (model.score(x, np.array([len(x)]))[0] >= 0.5) == i % 2


def test_batches_hold_whole_bags():
    sizes = np.array([5, 70_000, 3, 60_000, 40_000, 1])
    batches = mil._batches(sizes)
    assert sorted(np.concatenate(batches)) == list(range(6)) and len(batches) > 2
    assert all(len(b) == 1 or sizes[b].sum() <= mil.BATCH_PASSAGES for b in batches)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = mil.quality_scores(docs, labels).join(labels, "doc_id").where("held_out AND quality IS NOT NULL").collect()
    assert len(rows) > 40
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_held_out_rows_and_other_columns_do_not_teach(spark, docs):
    labels = table(spark, "/root/testdata/sf0.001", "labels")
    first = {r["doc_id"]: r["score"] for r in mil.quality_scores(docs, labels).collect()}
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    flipped = labels.withColumn("quality", F.when(rest == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    masked = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("zz"), "n_chars": F.lit(0)})
    second = {r["doc_id"]: r["score"] for r in mil.quality_scores(masked.repartition(5), flipped).collect()}
    assert first == second


def test_odd_rows(spark, odd, clashing):
    labels = spark.createDataFrame(
        [(1, 0), (1, 1), (2, None), (4, 1), (6, 0), (6, 0), (99, 1), (None, 0), (9, 0)], "doc_id bigint, quality int"
    )
    got = mil.quality_scores(clashing, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert mil.quality_scores(odd.where("false"), labels).count() == 0
    without = mil.quality_scores(odd, labels.where("false")).collect()
    assert {r["score"] for r in without} == {0.5}
