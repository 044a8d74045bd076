"""Quality rules: base rules, then robust multivariate outliers per language and source.

Everything is DataFrame expressions.  Each document gives a vector of transformed
statistics in whole ten-thousandths, so sums and cross products are exact and a
lost task that runs again gives the same estimates.  The estimates are the minimum
covariance determinant ones, found by concentration steps from a start of medians
and absolute deviations: distances to the present centre and scatter, the nearest
``H_SHARE`` of each group, their mean and covariance, and again.  A squared
measuring precision on the diagonal (``PRECISION``) keeps the scatter regular where
most documents of a group have the same value.

Every document belongs to one group: its (language, source) when that has at least
``MIN_GROUP`` documents, else the small sources of its language taken together,
else all that is still small.  Groups are only keys of partial aggregations: one
row per group and distance bin reaches the windows, whatever the group's size.

Defined cases: a NULL or empty text has no words and fails the base rules; a NULL
language or source is a value of its own; repeated rows count as often as they
come; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import (
    SPACE_CLASS,
    few_files,
    field,
    let,
    packed,
    table,
    unpacked,
    window_hashes,
    words_of,
    written,
)

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW_WORDS = 8
SYMBOLS = r"[#*$%&|<>]"

#: Parts that a statistic is rounded to.
SCALE = 10_000
#: Words (or lines) of a usual text added to every rate: short texts say less.
PRIOR_WORDS, PRIOR_WORD_CHARS, PRIOR_LINES = 20, 5, 5
#: Measuring precision of each statistic, in its own unit.
PRECISION = {
    "word_length": 0.06,  # log of mean word length
    "symbols": 0.04,  # log of 1 + symbols per word
    "echoes": 0.03,  # share of words equal to the word before
    "dup_lines": 0.08,  # share of lines seen before
    "capitals": 0.02,  # capital letters per word character
}
DIMS = len(PRECISION)
MIN_GROUP = 100
H_SHARE = 0.6
C_STEPS = 8
#: 0.6 / P(chi2 with 7 degrees <= 60 % point of chi2 with 5): makes the scatter of the nearest 60 % consistent.
CONSISTENCY = 1.6848
#: 99.999 % point of chi2 with 5 degrees of freedom.
CUTOFF = 30.856
_BINS = 64


def _repeated_words(words: Column) -> Column:
    """Words covered by windows that occur at least twice in the text."""

    def covered(hashes: Column) -> Column:
        at = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda xs, i, j: F.coalesce(F.get(xs, i)["h"] == F.get(xs, j)["h"], F.lit(False))
        twice = let(at, lambda xs: F.filter(xs, lambda x, i: same(xs, i, i - 1) | same(xs, i, i + 1)))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        span = F.lit(WINDOW_WORDS)
        new = let(
            starts,
            lambda ps: F.transform(ps, lambda p, i: F.least(span, F.coalesce(F.get(ps, i + 1) - p, span))),
        )
        return F.aggregate(new, F.lit(0).cast("bigint"), lambda total, n: total + n)

    hashes = window_hashes(F.transform(words, lambda w: F.xxhash64(w)), WINDOW_WORDS)
    return let(
        hashes,
        lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("bigint")).otherwise(covered(hs)),
    )


def statistics(df: DataFrame, text: Column, name: str = "stats") -> DataFrame:
    """Add a struct of the base counts, the base verdict and the statistic vector ``x``."""
    body = F.coalesce(text, F.lit(""))
    total = lambda items, value: F.aggregate(items, F.lit(0).cast("bigint"), lambda n, x: n + value(x))
    words = F.col("__words")
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike(rf"[^{SPACE_CLASS[1:-1]}]"))
    echoes = let(
        words,
        lambda ws: F.size(F.filter(ws, lambda w, i: F.coalesce(w == F.get(ws, i - 1), F.lit(False)))),
    )
    counts = F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        total(words, lambda w: F.length(w)).alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        let(
            lines,
            lambda ls: F.struct(
                F.size(ls).cast("bigint").alias("n"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("dup"),
            ),
        ).alias("lines"),
        _repeated_words(words).alias("n_repeat_words"),
        echoes.alias("echoes"),
        F.regexp_count(body, F.lit(r"\p{Lu}")).alias("capitals"),
    )
    counted = df.withColumn("__words", words_of(text)).withColumn("__counts", counts).drop("__words")
    c = F.col("__counts")
    n = c["n_words"] + PRIOR_WORDS
    vector = [
        F.log((c["word_chars"] + PRIOR_WORDS * PRIOR_WORD_CHARS) / n),
        F.log1p(c["n_symbols"] / n),
        c["echoes"] / n,
        c["lines"]["dup"] / (c["lines"]["n"] + PRIOR_LINES),
        c["capitals"] / (c["word_chars"] + PRIOR_WORDS * PRIOR_WORD_CHARS),
    ]
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    stats = F.struct(
        *[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols")],
        c["lines"]["dup"].alias("n_dup_lines"),
        c["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.array(*[F.round(SCALE * v).cast("bigint") for v in vector]).alias("x"),
    )
    return counted.withColumn(name, stats).drop("__counts")


def _groups(vectors: DataFrame, min_group: int) -> DataFrame:
    """(lang, source, grp): the group that estimates each language and source."""
    sizes = vectors.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < min_group).groupBy("lang").agg(F.sum("n").alias("pool"))
    joined = sizes.join(small.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left")
    level = F.when(F.col("n") >= min_group, 2).when(F.col("pool") >= min_group, 1).otherwise(0)
    parts = [level.alias("level"), F.when(level >= 1, F.col("lang")).alias("lang")]
    key = F.to_json(F.struct(*parts, F.when(level == 2, F.col("source")).alias("source")))
    return joined.select("lang", "source", key.alias("grp"))


def _same_origin(left: DataFrame, right: DataFrame, lang: Column, source: Column) -> DataFrame:
    right = right.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    on = lang.eqNullSafe(F.col("__lang")) & source.eqNullSafe(F.col("__source"))
    return left.join(right, on, "left").drop("__lang", "__source")


def _median(histogram: DataFrame, value: str, name: str) -> DataFrame:
    """Lower median per (grp, dim) of a (grp, dim, value, n) table."""
    counted = histogram.groupBy("grp", "dim", value).agg(F.sum("n").alias("n"))
    key = Window.partitionBy("grp", "dim")
    upto = F.sum("n").over(key.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("upto", upto).withColumn("all", F.sum("n").over(key))
    return placed.where(2 * F.col("upto") >= F.col("all")).groupBy("grp", "dim").agg(F.min(value).alias(name))


def _start(rows: DataFrame) -> DataFrame:
    """Medians and absolute deviations as the first centre and (diagonal) scatter."""
    histogram = rows.select("grp", F.posexplode("x").alias("dim", "value"))
    histogram = histogram.groupBy("grp", "dim", "value").agg(F.count("*").alias("n"))
    centre = _median(histogram, "value", "median")
    away = histogram.join(centre, ["grp", "dim"]).withColumn("away", F.abs(F.col("value") - F.col("median")))
    spread = centre.join(_median(away, "away", "mad"), ["grp", "dim"])
    precise = F.array(*[F.lit(SCALE * p) for p in PRECISION.values()])
    scale = F.sqrt(F.pow(1.4826 * F.col("mad"), 2) + F.pow(F.get(precise, F.col("dim")), 2))
    item = F.struct("dim", F.col("median").cast("double").alias("m"), scale.alias("s"))
    gathered = spread.groupBy("grp").agg(F.sort_array(F.collect_list(item)).alias("items"))  # DIMS items
    lower = [
        F.when(F.lit(i == j), F.get(F.col("items"), F.lit(i))["s"]).otherwise(F.lit(0.0))
        for i in range(DIMS)
        for j in range(i + 1)
    ]
    return gathered.select("grp", F.transform("items", lambda x: x["m"]).alias("centre"), F.array(*lower).alias("root"))


def _at(i: int, j: int) -> int:
    return i * (i + 1) // 2 + j


def _with_distance(rows: DataFrame, x: Column, name: str) -> DataFrame:
    """Add the squared Mahalanobis distance to (centre, root): forward substitution in the lower root."""
    for i in range(DIMS):
        before = [F.get(F.col("root"), F.lit(_at(i, k))) * F.col(f"__y{k}") for k in range(i)]
        rest = functools.reduce(operator.sub, before, F.get(x, F.lit(i)) - F.get(F.col("centre"), F.lit(i)))
        rows = rows.withColumn(f"__y{i}", rest / F.get(F.col("root"), F.lit(_at(i, i))))
    squares = [F.col(f"__y{i}") * F.col(f"__y{i}") for i in range(DIMS)]
    return rows.withColumn(name, functools.reduce(operator.add, squares)).drop(*[f"__y{i}" for i in range(DIMS)])


def _concentrated(rows: DataFrame, estimates: DataFrame, h_share: float) -> DataFrame:
    """One concentration step: centre and scatter root of the nearest share of each group."""
    pairs = [(i, j) for i in range(DIMS) for j in range(i + 1)]
    part = lambda i: F.get(F.col("x"), F.lit(i)).cast("decimal(18,0)")
    sums = {f"s{i}": F.sum(part(i)) for i in range(DIMS)}
    sums |= {f"p{i}_{j}": F.sum((part(i) * part(j)).cast("decimal(28,0)")) for i, j in pairs}
    near = _with_distance(rows.join(estimates, "grp"), F.col("x"), "d2")
    near = near.withColumn("bin", F.floor(_BINS * F.log1p("d2")))
    binned = near.groupBy("grp", "bin").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in sums.items()])
    key = Window.partitionBy("grp")
    before = F.sum("n").over(key.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    placed = binned.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("all", F.sum("n").over(key))
    inside = placed.where(F.col("before") < h_share * F.col("all")).groupBy("grp")
    taken = inside.agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in sums])
    n = F.col("n").cast("double")
    centre = [(F.col(f"s{i}").cast("double") / n).alias(f"m{i}") for i in range(DIMS)]
    taken = taken.select("*", *centre)
    scatter = {
        (i, j): CONSISTENCY * (F.col(f"p{i}_{j}").cast("double") / n - F.col(f"m{i}") * F.col(f"m{j}"))
        + (F.lit((SCALE * list(PRECISION.values())[i]) ** 2) if i == j else F.lit(0.0))
        for i, j in pairs
    }
    root = taken.select("grp", *[f"m{i}" for i in range(DIMS)], *[v.alias(f"c{i}_{j}") for (i, j), v in scatter.items()])
    low = lambda i, j: F.col(f"l{i}_{j}")
    for j in range(DIMS):
        square = functools.reduce(operator.sub, [low(j, k) * low(j, k) for k in range(j)], F.col(f"c{j}_{j}"))
        root = root.withColumn(f"l{j}_{j}", F.sqrt(square))
        for i in range(j + 1, DIMS):
            rest = functools.reduce(operator.sub, [low(i, k) * low(j, k) for k in range(j)], F.col(f"c{i}_{j}"))
            root = root.withColumn(f"l{i}_{j}", rest / low(j, j))
    return root.select(
        "grp",
        F.array(*[F.col(f"m{i}") for i in range(DIMS)]).alias("centre"),
        F.array(*[low(i, j) for i, j in pairs]).alias("root"),
    )


def fit(
    vectors: DataFrame, min_group: int = MIN_GROUP, h_share: float = H_SHARE, steps: int = C_STEPS
) -> DataFrame:
    """(lang, source, centre, root) from a (lang, source, x) table of all documents with words.

    ``centre`` and the lower triangular ``root`` of the scatter are in parts of ``SCALE``.
    """
    groups = written(few_files(_groups(vectors, min_group)), "mcd-groups")
    rows = _same_origin(vectors, groups, F.col("lang"), F.col("source")).select("grp", "x")
    rows = written(rows, "mcd-rows")
    estimates = written(few_files(_start(rows)), "mcd")
    for _ in range(steps):
        estimates = written(few_files(_concentrated(rows, estimates, h_share)), "mcd")
    return groups.join(estimates, "grp").select("lang", "source", "centre", "root")


def judged(
    df: DataFrame, estimates: DataFrame, lang: Column, source: Column, stats: str = "stats", cutoff: float = CUTOFF
) -> DataFrame:
    """Add ``distance`` (squared) and ``kept`` to rows with a ``stats`` struct."""
    near = _with_distance(_same_origin(df, estimates, lang, source), F.col(stats)["x"], "distance")
    kept = ~F.col(stats)["base_failed"] & F.coalesce(F.col("distance") <= cutoff, F.lit(False))
    return near.drop("centre", "root").withColumn("kept", kept)


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.where("stats.n_words > 0").select("lang", "source", "stats.x")


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept, and the squared distance."""
    rows = statistics(docs.select("doc_id", "lang", "source", "text"), F.col("text")).drop("text")
    rows = written(rows, "quality")
    verdicts = judged(rows, fit(_vectors(rows)), F.col("lang"), F.col("source"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return few_files(verdicts.select("doc_id", *[f"stats.{k}" for k in counts], "kept", "distance"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass the base rules and are no outliers, all columns as they were."""
    # Each text is looked at once: rows and statistics are written together, the fit reads the narrow part.
    rows = written(statistics(packed(docs), field("text")), "quality")
    narrow = rows.select(field("lang").alias("lang"), field("source").alias("source"), "stats")
    estimates = fit(_vectors(narrow))
    return unpacked(judged(rows, estimates, field("lang"), field("source")).where("kept"), docs.columns)


def op10_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))
