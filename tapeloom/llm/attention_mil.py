"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words, all of them, to the end
of the text.  A passage is encoded from its own characters and words, a learned
layer maps that encoding, a gated attention weighs the passages of the bag, and the
weighted representation gives the score.  Only labels of documents teach it, so the
attention finds out by itself which passages decide.

It learns from at most ``MAX_BAGS`` labelled documents (those whose id hash is
smallest, of the ids that are not held out), from every passage of each.  The encoded
passages lie in a file of the driver, where plain numpy trains some thousand numbers in
batches of whole bags: memory holds one batch of ``BATCH_PASSAGES`` passages, or one
document that is longer.  Scores use every passage of every document.

Defined cases: a NULL or empty text is one passage without words and gets a score;
a document with several labels has their mean; labels that are NULL or without a
document teach nothing; without any label the score is 0.5; a NULL ``doc_id`` is
not held out; repeated rows each give their result; an empty table gives an empty
result; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from tapeloom.llm.common import few_files, small_batches, table, written

PASSAGE_WORDS = 100
MAX_BAGS = 4000
#: Passages of a batch of whole bags, and how often each bag teaches at least.
BATCH_PASSAGES, PASSES = 1 << 16, 20
HELD_OUT_OF = 5
THRESHOLD = 0.3
HIDDEN, GATE = 24, 12
STEPS, RATE, DECAY, SEED = 400, 0.02, 1e-4, 7


def _classes() -> np.ndarray:
    """(256, classes): letters by case, digits, white space, other bytes, and each ASCII mark by itself."""
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    groups = [
        range(97, 123), range(65, 91), range(48, 58), (32, *range(9, 14)), range(128, 256), *[(m,) for m in marks]
    ]
    table = np.zeros((256, len(groups)), dtype=np.float32)
    for column, members in enumerate(groups):
        table[list(members), column] = 1
    return table


_CLASSES = _classes()
_SHAPES = 6
FEATURES = _CLASSES.shape[1] + _SHAPES


def encode_passages(text: str | None) -> np.ndarray:
    """(passages, FEATURES): what each passage looks like, from first to last."""
    words = (text or "").split()
    starts = range(0, len(words), PASSAGE_WORDS)
    counts = np.zeros((max(1, len(starts)), 256), dtype=np.float32)
    shapes = np.zeros((max(1, len(starts)), _SHAPES), dtype=np.float32)
    for row, start in enumerate(starts):
        part = words[start : start + PASSAGE_WORDS]
        n = len(part)
        raw = " ".join(part).encode("utf-8")
        counts[row] = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        pairs = set(zip(part, part[1:], strict=False))
        shapes[row] = (
            len(raw) / n / 10,
            max(map(len, part)) / 40,
            len(set(part)) / n,
            sum(map(eq, part, part[1:])) / n,
            (len(pairs) + 1) / n,
            np.log1p(n) / 5,
        )
    shares = counts @ _CLASSES / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.hstack([np.sqrt(shares), shapes]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: The passages of some bags, how many belong to each bag, and the wanted scores.
Batch = tuple[np.ndarray, np.ndarray, np.ndarray]


class GatedAttention:
    """A scorer of bags; passages of all bags lie in one matrix, ``sizes`` says how many belong to each."""

    def __init__(self, x: np.ndarray):
        draw = np.random.default_rng(SEED).normal
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.02)
        shapes = {"w": (FEATURES, HIDDEN), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "g": (GATE,), "c": (HIDDEN,)}
        self.p = {k: draw(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()}
        self.p |= {"b": np.zeros(HIDDEN), "o": np.zeros(1)}

    def _forward(self, x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        p, begins = self.p, np.concatenate(([0], np.cumsum(sizes)[:-1]))
        bag = np.repeat(np.arange(len(sizes)), sizes)
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * s) @ p["g"]
        a = np.exp(e - np.maximum.reduceat(e, begins)[bag])
        a /= np.add.reduceat(a, begins)[bag]
        z = np.add.reduceat(a[:, None] * h, begins)
        return {"bag": bag, "begins": begins, "h": h, "t": t, "s": s, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["o"])}

    def _gradients(self, x: np.ndarray, f: dict[str, np.ndarray], wanted: np.ndarray) -> dict[str, np.ndarray]:
        p, h, a, bag = self.p, f["h"], f["a"], f["bag"]
        d_out = (f["y"] - wanted) / len(wanted)
        d_z = d_out[:, None] * p["c"]
        d_a = (d_z[bag] * h).sum(axis=1)
        d_e = a * (d_a - np.add.reduceat(a * d_a, f["begins"])[bag])
        d_gate = d_e[:, None] * p["g"]
        d_t, d_s = d_gate * f["s"] * (1 - f["t"] ** 2), d_gate * f["t"] * f["s"] * (1 - f["s"])
        d_h = (a[:, None] * d_z[bag] + d_t @ p["v"].T + d_s @ p["u"].T) * (1 - h**2)
        return {
            "w": x.T @ d_h, "b": d_h.sum(axis=0), "v": h.T @ d_t, "u": h.T @ d_s,
            "g": (f["t"] * f["s"]).T @ d_e, "c": f["z"].T @ d_out, "o": d_out.sum(keepdims=True),
        }

    def train(self, x: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> GatedAttention:
        """Adam on all bags at once."""
        x = (x - self.mean) / self.scale
        return self._train(lambda _: (x, sizes, wanted), 1, len(sizes))

    def train_batches(self, batch: Callable[[int], Batch], n_batches: int, n_bags: int) -> GatedAttention:
        """Adam on batches of whole bags, in turn; normalised by the passages of all of them."""
        n = sum(len(batch(i)[0]) for i in range(n_batches))
        self.mean = sum(batch(i)[0].sum(axis=0) for i in range(n_batches)) / n
        variance = sum(((batch(i)[0] - self.mean) ** 2).sum(axis=0) for i in range(n_batches)) / n
        self.scale = np.maximum(np.sqrt(variance), 0.02)

        def normal(i: int) -> Batch:
            x, sizes, wanted = batch(i)
            return (x - self.mean) / self.scale, sizes, wanted

        return self._train(normal, n_batches, n_bags)

    def _train(self, batch: Callable[[int], Batch], n_batches: int, n_bags: int) -> GatedAttention:
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, max(STEPS, PASSES * n_batches if n_batches > 1 else 0) + 1):
            x, sizes, wanted = batch((step - 1) % n_batches)
            gradients = self._gradients(x, self._forward(x, sizes), wanted)
            # Each bag weighs the same, in a batch of few bags too.
            share = len(sizes) * n_batches / n_bags
            for k, g in gradients.items():
                g = share * g + DECAY * self.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                corrected = np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                self.p[k] -= RATE * first[k] / (1 - 0.9**step) / corrected
        return self

    def score(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale, sizes)["y"]


def held_out(doc_id: Column) -> Column:
    """Documents that never teach: the crc32 of the id as text is a multiple of ``HELD_OUT_OF``."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF
    return F.coalesce(rest == 0, F.lit(False))


@F.pandas_udf(BinaryType())
def _bag(texts: pd.Series) -> pd.Series:
    return pd.Series([encode_passages(text).tobytes() for text in texts], dtype=object)


def _batches(sizes: np.ndarray) -> list[np.ndarray]:
    """The bags of each batch, ascending: drawn in a fixed order, none is cut."""
    batches: list[list[int]] = []
    room = 0
    for bag in np.random.default_rng(SEED).permutation(len(sizes)):
        if not batches or sizes[bag] > room:
            batches.append([])
            room = BATCH_PASSAGES
        batches[-1].append(bag)
        room -= sizes[bag]
    return [np.sort(batch) for batch in batches]


def fit(docs: DataFrame, labels: DataFrame, max_bags: int = MAX_BAGS) -> GatedAttention | None:
    """A trained scorer, or None if there is no labelled document."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("wanted"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_bags)
    bags = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_bags rows of 16 bytes
    small_batches(docs.sparkSession)
    # A repeated id teaches once: of its texts the one with the smallest hash.
    bags = bags.groupBy("doc_id", "wanted").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = written(few_files(bags.select("doc_id", "wanted", _bag("text").alias("bag"))), "bags")
    width = FEATURES * np.dtype(np.float32).itemsize
    # The driver holds one batch of whole bags at a time; all others stay in the shared table.
    found = rows.select("doc_id", "wanted", F.octet_length("bag").alias("bytes")).orderBy("doc_id").collect()
    if not found:
        return None
    wanted = np.array([f["wanted"] for f in found], dtype=np.float64)
    sizes = np.array([f["bytes"] // width for f in found])
    groups = _batches(sizes)

    def batch(i: int) -> Batch:
        ids = [found[bag]["doc_id"] for bag in groups[i]]
        held = {r["doc_id"]: r["bag"] for r in rows.where(F.col("doc_id").isin(ids)).select("doc_id", "bag").collect()}
        x = np.concatenate([np.frombuffer(held[k], dtype=np.float32) for k in ids]).reshape(-1, FEATURES)
        return x.astype(np.float64), sizes[groups[i]], wanted[groups[i]]

    x, *rest = batch(0)
    model = GatedAttention(x)
    return model.train(x, *rest) if len(groups) == 1 else model.train_batches(batch, len(groups), len(sizes))


def scored(text: Column, model: GatedAttention | None) -> Column:
    """Score of each whole text, from 0 to 1."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            bags = [encode_passages(t) for t in batch]
            if model is None or not bags:
                yield pd.Series(np.full(len(bags), 0.5))
                continue
            yield pd.Series(model.score(np.concatenate(bags), np.array([len(b) for b in bags])))

    return F.pandas_udf(run, DoubleType())(text)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op6_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
