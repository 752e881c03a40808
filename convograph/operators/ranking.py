"""Numbering rows within groups of any size."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "__slice"


def on_keys(keys: Sequence[str], prefix: str = "__b_") -> Column:
    """Join condition of ``keys`` with their prefixed copies; nulls match nulls."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(prefix + k))
    return out


def prefixed(df: DataFrame, keys: Sequence[str], prefix: str = "__b_") -> DataFrame:
    return df.withColumnsRenamed({k: prefix + k for k in keys})


def slice_hot(df: DataFrame, keys: Sequence[str], lead: str, hot_rows: int) -> tuple[DataFrame, bool]:
    """Adds ``__slice``, 0 in groups of at most ``hot_rows`` rows; larger groups are cut at
    approximate quantiles of the numeric column ``lead`` into slices of about a quarter of that, as many as the largest group needs, so that
    work on (keys, slice) never puts a whole hot group into one task. Also tells if any group is hot."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot = prefixed(sizes.where(F.col("__n") > hot_rows), keys)
    largest = hot.agg(F.max("__n")).first()[0]
    if largest is None:
        return df.withColumn(SLICE, F.lit(0)), False
    parts = max(2, -(-4 * largest // hot_rows))
    bounds = (
        df.join(hot, on_keys(keys), "left_semi").groupBy(*keys)
        .agg(F.percentile_approx(lead, [i / parts for i in range(1, parts)], max(1000, 10 * parts)).alias("__bounds"))
    )
    sliced = (
        df.join(prefixed(bounds, keys), on_keys(keys), "left")
        .withColumn(SLICE, F.coalesce(F.size(F.filter("__bounds", lambda x: x < F.col(lead))), F.lit(0)))
        .drop("__bounds", *[f"__b_{k}" for k in keys])
    )
    return sliced, True


def running_before(df: DataFrame, keys: Sequence[str], amount: Column, out: str) -> DataFrame:
    """Of each (keys, slice), the sum of ``amount`` over the slices before it."""
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, SLICE).agg(F.sum(amount).alias("__n"))
    sums = sums.select(*keys, SLICE, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(out))
    return prefixed(sums, [*keys, SLICE])


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], lead: str, out: str,
                hot_rows: int = 500_000) -> DataFrame:
    """``out`` counts the rows of each group of ``keys`` from 1 in ``order``, whose first
    item must be the numeric column ``lead`` ascending.

    Groups of at most ``hot_rows`` rows are numbered by one window. A larger group is numbered
    in slices of ``lead``, each moved up by the rows of the slices before it. A slice only
    exceeds its share where rows have one ``lead`` value; those stay together. The order must
    be total for a repeatable result. Null keys form a group."""
    sliced, hot = slice_hot(df, keys, lead, hot_rows)
    n = F.row_number().over(Window.partitionBy(*keys, SLICE).orderBy(*order)).cast("long")
    if not hot:
        return sliced.withColumn(out, n).drop(SLICE)
    before = running_before(sliced, keys, F.lit(1), "__before")
    return (
        sliced.withColumn(out, n).join(before, on_keys([*keys, SLICE]))
        .withColumn(out, F.col(out) + F.col("__before"))
        .drop(SLICE, f"__b_{SLICE}", "__before", *[f"__b_{k}" for k in keys])
    )


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], lead: str, amount: Column, out: str,
                hot_rows: int = 500_000) -> DataFrame:
    """``out`` is the sum of ``amount`` over a row's group from its first row to this one, in ``order``, which starts
    with the numeric column ``lead`` ascending and is total. Hot groups are summed slice by slice as in
    ``number_rows``."""
    sliced, hot = slice_hot(df, keys, lead, hot_rows)
    w = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not hot:
        return sliced.withColumn(out, F.sum(amount).over(w)).drop(SLICE)
    before = running_before(sliced, keys, amount, "__before")
    return (
        sliced.withColumn(out, F.sum(amount).over(w)).join(before, on_keys([*keys, SLICE]))
        .withColumn(out, F.col(out) + F.col("__before"))
        .drop(SLICE, f"__b_{SLICE}", "__before", *[f"__b_{k}" for k in keys])
    )


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[Column], lead: str, columns: Sequence[str], hot_rows: int = 500_000) -> DataFrame:
    """Adds ``previous``, a struct of ``columns`` of the row before in its group (null for the first), in a total
    ``order`` that starts with the numeric column ``lead``. Rows meet their neighbour by number, so no task holds a hot group."""
    n = number_rows(df, keys, order, lead, "__at", hot_rows)
    before = n.select(*[F.col(k).alias(f"__b_{k}") for k in keys], (F.col("__at") + 1).alias("__b___at"), F.struct(*columns).alias("previous"))
    return n.join(before, on_keys([*keys, "__at"]), "left").drop("__at", "__b___at", *[f"__b_{k}" for k in keys])
