"""Ordered operators that stay parallel when one key holds a large share of the rows.

A plain window sends every row of a key to one task. Here the order column is cut into
blocks by a monotone expression the caller supplies; each (key, block) is one window
partition, and only one summary row per block is ordered across the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed one time per row.

    A predicate on a plain derived column is pushed below the projection and repeats the
    expression there. Regular-expression ladders are too dear for that; a one-element generator
    keeps them where they are.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def first_n(df: DataFrame, keys: list[str], order: list, n: int | None, rank: str = "rank_no") -> DataFrame:
    """The first ``n`` rows of each key with their rank; without ``n``, all rows as they are.

    The filter on ``row_number`` lets Spark keep at most ``n`` rows per key and input
    partition before the shuffle, so a hot key never reaches one task whole.
    """
    if n is None:
        return df
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])


def _join_blocks(df: DataFrame, blocks: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    on = [*keys, "_block"]
    return (df.alias("l").join(blocks.alias("r"), _same(df, blocks, on), "left")
            .select("l.*", *[F.col(f"r.{c}").alias(c) for c in extra]))


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, block: Column, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows of the key up to and including this one."""
    df = df.withColumn("_v", value).withColumn("_block", block)
    totals = df.groupBy(*keys, "_block").agg(F.sum("_v").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    local = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_local", F.sum("_v").over(local))
    return (_join_blocks(df, totals, keys, ["_before"])
            .withColumn(out, F.col("_before") + F.coalesce(F.col("_local"), F.lit(0)))
            .drop("_v", "_block", "_local", "_before"))


def number_rows(df: DataFrame, keys: list[str], order: list[str], block: Column, out: str) -> DataFrame:
    """``row_number`` per key in blocks."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), block, out)


def previous(df: DataFrame, keys: list[str], order: list[str], value: Column, block: Column, out: str) -> DataFrame:
    """Adds the value of the row before this one in the key (null for the first)."""
    df = df.withColumn("_v", F.struct(value.alias("v"))).withColumn("_block", block)
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])
    last = df.groupBy(*keys, "_block").agg(F.max_by("_v", position).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_block")
    last = last.withColumn("_carry", F.lag("_last").over(across)).drop("_last")
    local = Window.partitionBy(*keys, "_block").orderBy(*order)
    df = df.withColumn("_prev", F.lag("_v").over(local))
    return (_join_blocks(df, last, keys, ["_carry"])
            .withColumn(out, F.coalesce("_prev", "_carry")["v"])
            .drop("_v", "_block", "_prev", "_carry"))
