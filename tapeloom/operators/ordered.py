"""Running values and ordered concatenation that survive a hot key.

A window over ``(session, channel)`` puts all rows of one key into one task.
Here the order column is cut into blocks: a window runs inside each block, one
small row per block carries the block's total, and the totals are folded over
the key.  A key holding a third of all rows is spread over its blocks, and only
its block totals (one row per ``BLOCK_ROWS``) meet in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key that a single window task may hold.
BLOCK_ROWS = 4096
#: Ordered pieces that are joined into one text value.
PAGE_ROWS = 4096

_BLOCK = "__block"


@dataclass(frozen=True)
class Fold:
    """One running value: ``sum``, ``max``, ``first`` or ``last`` (non-NULL)."""

    op: str
    value: Column
    inclusive: bool = True


def block_of(order: str, rows: int = BLOCK_ROWS) -> Column:
    return F.expr(f"`{order}` div {rows}")


def _total(fold: Fold, order: Column) -> Column:
    if fold.op == "sum":
        return F.sum(fold.value)
    if fold.op == "max":
        return F.max(fold.value)
    seen = F.when(fold.value.isNotNull(), order)
    return F.min_by(fold.value, seen) if fold.op == "first" else F.max_by(fold.value, seen)


def _over(fold: Fold, value: Column, window) -> Column:
    if fold.op == "sum":
        return F.sum(value).over(window)
    if fold.op == "max":
        return F.max(value).over(window)
    pick = F.first if fold.op == "first" else F.last
    return pick(value, ignorenulls=True).over(window)


def _combine(fold: Fold, carried: Column, local: Column) -> Column:
    if fold.op == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if fold.op == "max":
        return F.greatest(carried, local)
    return F.coalesce(carried, local) if fold.op == "first" else F.coalesce(local, carried)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    folds: Mapping[str, Fold],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add one running column per fold, in ``order`` inside ``keys``.

    ``order`` is a BIGINT, unique inside a key, so a block holds at most
    ``block_rows`` rows; keys are non-NULL, as the table schemas declare.
    """
    keys = list(keys)
    block = block_of(order, block_rows).alias(_BLOCK)
    totals = df.groupBy(*keys, block).agg(
        *[_total(f, F.col(order)).alias(f"__t_{n}") for n, f in folds.items()]
    )
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, _BLOCK, *[_over(f, F.col(f"__t_{n}"), before).alias(f"__c_{n}") for n, f in folds.items()]
    )
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn(_BLOCK, block).select(
        "*",
        *[_over(f, f.value, upto if f.inclusive else prior).alias(f"__l_{n}") for n, f in folds.items()],
    )
    joined = local.join(carried, [*keys, _BLOCK])
    return joined.select(
        *df.columns,
        *[_combine(f, F.col(f"__c_{n}"), F.col(f"__l_{n}")).alias(n) for n, f in folds.items()],
    )


def windowed(df: DataFrame, keys: Sequence[str], order: str, folds: Mapping[str, Fold]) -> DataFrame:
    """As ``running``, in one window per key: for keys that are short by nature, such as one host's listing."""
    inside = Window.partitionBy(*keys).orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    none = {"sum": F.lit(0).cast("bigint")}
    return df.select(
        "*",
        *[
            F.coalesce(_over(f, f.value, upto if f.inclusive else prior), none.get(f.op, F.lit(None))).alias(n)
            for n, f in folds.items()
        ],
    )


def ordinal(
    df: DataFrame, keys: Sequence[str], order: str, name: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Dense position of each row inside its key, from 0."""
    counted = {name: Fold("sum", F.lit(1).cast("bigint"), inclusive=False)}
    return running(df, keys, order, counted, block_rows)


def in_order(items: Column, field: str) -> Column:
    """Values of ``field`` from collected ``struct(order, …)`` items, in order."""
    return F.transform(F.sort_array(items), lambda item: item[field])


def joined_pages(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    text: Column,
    separator: str,
    name: str,
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """Join texts in ``position`` order, one row per key and page.

    ``part`` is 0 for every key of up to ``page_rows`` pieces.  A longer key
    goes on in parts 1, 2, …: nothing is dropped and no task holds more than a
    page.  The whole text is the parts in order, joined by ``separator``.
    """
    part = block_of(position, page_rows).alias("part")
    piece = F.struct(F.col(position).alias("p"), F.coalesce(text, F.lit("")).alias("t"))
    return df.groupBy(*keys, part).agg(
        F.array_join(in_order(F.collect_list(piece), "t"), separator).alias(name)
    )
