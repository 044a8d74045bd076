"""Mixing sources to target weights by systematic sampling.

Each source has a weight and a target size; its documents have the same expected
number of copies, target over source size.  The documents of a source stand in a
line by size (equal sizes in an order of their own), their expected copies are
summed up along the line, one random offset per source is added, and a document is
emitted once for every integer that its piece of the line crosses.  Neighbours in
the line have nearly the same size, so the words taken keep close to the target
whatever the sizes are.

No line is ever gathered.  A place in it comes from counts: documents of smaller size
(one row per size), documents of the same size in lower blocks of the order, documents before it in its
own block, and of rows that cannot be told apart those before it in the table.  Sources are names: the
windows over them hold one row for each.

The order and the offset are hashes, and the table is written before its rows are
numbered: reruns and repeated tasks agree.

Defined cases: a NULL or empty text has size 0, is never worth copies by its words
but takes its turns like others; very long texts are counted whole; NULL is a source of its own, after all others;
rows that repeat a ``doc_id`` each have their own place, repeated rows stand side by side; a table without words has targets 0 and
nothing is taken; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import ROW, SPACE_CLASS, few_files, field, packed, table, unpacked, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source (and a document) is taken at most so many times.
MOST = 3
SEED = "mix-1"
#: Hex digits of the order hash that name a block; 16 to that power blocks.
BLOCK_DIGITS = 3
#: Rows of one tie that a window task numbers.
PART_ROWS = 4096


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE_CLASS[1:-1]}]+")).cast("bigint")


def _order_hash(doc_id: Column, source: Column, extra: Column | None = None) -> Column:
    parts = [F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(source, F.lit(""))]
    return F.md5(F.concat_ws("|", *parts, *([extra] if extra is not None else [])))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, rate) from a (source, source_size) table.

    All sizes are shared out by weight; a source above ``MOST`` times its size stops
    there and the rest goes to the others by weight.  Sources are sorted by the level
    at which they stop, so the shared level is found with running sums instead of
    rounds.  One row per source meets in one task, never one per document.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    rows = sizes.withColumn(
        "weight", F.get(weights, (F.row_number().over(by_name) - 1) % len(WEIGHTS)).cast("bigint")
    )
    everything = Window.partitionBy(F.lit(0))
    stops = F.col("source_size") * MOST / F.col("weight")
    line = everything.orderBy(stops, F.asc_nulls_last("source"))
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        rows.withColumn("stops", stops)
        .withColumn("all_sizes", F.sum("source_size").over(everything))
        .withColumn("stopped_size", MOST * (F.sum("source_size").over(upto) - F.col("source_size")))
        .withColumn(
            "open_weight", F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight")
        )
    )
    # The level if this source and all after it are open; the first such level that this source can take holds.
    level = (F.col("all_sizes") - F.col("stopped_size")) / F.col("open_weight")
    rows = rows.withColumn("level", F.when(level <= F.col("stops"), level))
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", F.first("level", ignorenulls=True).over(whole))
    cap = (F.col("source_size") * MOST).cast("double")
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), cap), cap)
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return rows.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def _with_same(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which NULL equals NULL."""
    other = other.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(other, on).drop(*[f"__{k}" for k in keys])


def copies(items: DataFrame) -> DataFrame:
    """Add source_size, target and ``copies`` to (source, size, h, uid, ...) rows.

    ``h`` orders equal sizes and the unique ``uid`` equal ``h``: rows without an id, or repeated ones.  Such a tie
    is one row of the counts, whatever its length, and its rows are numbered in blocks of ``uid``.
    ``items`` is read several times: give a written table.
    """
    before = Window.unboundedPreceding, -1
    none = F.lit(0).cast("bigint")
    block = F.substring("h", 1, BLOCK_DIGITS).alias("block")
    ties = items.groupBy("source", "size", "h").agg(F.count("*").alias("n"))
    per_block = ties.groupBy("source", "size", block).agg(F.sum("n").alias("n"))
    per_size = per_block.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = targets(per_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    smaller = F.sum("n").over(Window.partitionBy("source").orderBy("size").rowsBetween(*before))
    offsets = per_size.select("source", "size", F.coalesce(smaller, none).alias("smaller"))
    lower = F.sum("n").over(Window.partitionBy("source", "size").orderBy("block").rowsBetween(*before))
    per_block = per_block.select("source", "size", "block", F.coalesce(lower, none).alias("lower"))

    places = _with_same(per_block, offsets, ["source", "size"])
    places = _with_same(places, sources, ["source"]).withColumn("base", F.col("smaller") + F.col("lower"))
    places = places.drop("smaller", "lower")
    inside = F.sum("n").over(Window.partitionBy("source", "size", "block").orderBy("h").rowsBetween(*before))
    ties = ties.withColumn("block", block).withColumn("inside", F.coalesce(inside, none))
    ties = _with_same(ties, places, ["source", "size", "block"])
    ties = ties.withColumn("base", F.col("base") + F.col("inside")).drop("block", "inside")

    # Rows of one tie: those of lower blocks of uid, then those before a row in its own block.
    key = ["source", "size", "h"]
    rows = _with_same(items, ties, key)
    tied = rows.where("n > 1").withColumn("part", F.expr(f"uid div {PART_ROWS}"))
    parts = tied.groupBy(*key, "part").agg(F.count("*").alias("in_part"))
    ahead = F.sum("in_part").over(Window.partitionBy(*key).orderBy("part").rowsBetween(*before))
    parts = parts.select(*key, "part", F.coalesce(ahead, none).alias("ahead"))
    number = F.row_number().over(Window.partitionBy(*key, "part").orderBy("uid"))
    tied = _with_same(tied.withColumn("number", number), parts, [*key, "part"])
    tied = tied.withColumn("rank", F.col("number") + F.col("ahead")).drop("part", "number", "ahead")
    rows = rows.where("n = 1").withColumn("rank", none + 1).unionByName(tied)
    # One offset per source, from 0 to 1.
    first = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce("source", F.lit("")))), 1, 8), 16, 10)
    offset = first.cast("double") / F.lit(float(1 << 32))
    end = F.col("base") + F.col("rank")
    crossed = F.floor(end * F.col("rate") + offset) - F.floor((end - 1) * F.col("rate") + offset)
    return rows.withColumn("copies", crossed.cast("bigint")).drop("n", "rank", "base", "rate")


def mix(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target of its source, and the words taken."""
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))
    rows = rows.withColumn("h", _order_hash(F.col("doc_id"), F.col("source")))
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "mix")
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return few_files(copies(rows).select("doc_id", "size", "source_size", "target", taken))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, all columns as they were."""
    h = _order_hash(field("doc_id"), field("source"), F.xxhash64(field("text")).cast("string"))
    rows = packed(docs).withColumns({"source": field("source"), "size": size_of(field("text")), "h": h})
    # Written whole with a number for each row: places are found on the narrow columns.
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "mix")
    taken = copies(rows.select("source", "size", "h", "uid")).where("copies > 0").select("uid", "copies")
    emitted = rows.select(ROW, "uid").join(taken, "uid")
    return unpacked(emitted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs.columns)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


_WORD = f"[^{SPACE_CLASS[1:-1]}]+"
ORACLE = f"""WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
    md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || coalesce(source, '')) AS h FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighted AS (SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1)
  % {len(WEIGHTS)} + 1] AS BIGINT) AS weight FROM sizes),
line AS (SELECT *, source_size * {MOST} / weight AS stops, sum(source_size) OVER () AS all_sizes,
  sum(weight) OVER () AS all_weight FROM weighted),
levels AS (SELECT *,
  {MOST} * coalesce(sum(source_size) OVER (ORDER BY stops, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped_size,
  all_weight - coalesce(sum(weight) OVER (ORDER BY stops, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_weight FROM line),
level AS (SELECT min_by(lvl, stops_rank) AS level FROM (
  SELECT CAST(CAST(all_sizes - stopped_size AS BIGINT) / CAST(open_weight AS BIGINT) AS DOUBLE) AS lvl, stops,
    row_number() OVER (ORDER BY stops, source NULLS LAST) AS stops_rank FROM levels) WHERE lvl <= stops),
targets AS (SELECT source, source_size,
  CAST(least(coalesce(level * weight, source_size * {MOST}), source_size * {MOST}) AS DOUBLE) AS target
  FROM weighted, level),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
  CAST('0x' || substr(md5('{SEED}|' || coalesce(source, '')), 1, 8) AS BIGINT) / 4294967296.0 AS shift FROM targets),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, h) AS place FROM docs)
SELECT doc_id, size, source_size, target,
  size * CAST(floor(place * rate + shift) - floor((place - 1) * rate + shift) AS BIGINT) AS taken
FROM placed JOIN rates ON placed.source IS NOT DISTINCT FROM rates.source"""
