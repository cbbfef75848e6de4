"""Ranks, percentile thresholds and levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graphs import cut


def rank_share(value: str, within: list[str] | None = None) -> Column:
    """Share of rows that are not above this one; ties share, the largest is 1."""
    return F.cume_dist().over(Window.partitionBy(*[F.col(c) for c in within or []]).orderBy(value))


def top_share(value: str) -> Column:
    """The top per cent a row belongs to, at least 1."""
    return F.greatest(F.lit(1), F.ceil(100 * F.cume_dist().over(Window.orderBy(F.desc(value))))).cast("long")


def at_share(rows: DataFrame, value: str, share: float, least: int) -> DataFrame:
    """One row ``threshold``: the value at 0-based index int(n * share) of the sorted values, or ``least`` if that is more.

    Counts per value come first, so the running sum is over distinct values.
    """
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    running = counts.withColumn("upto", F.sum("c").over(Window.orderBy("v"))).crossJoin(F.broadcast(counts.agg(F.sum("c").alias("n"))))
    return running.where(F.col("upto") > F.floor(F.col("n") * share)).agg(F.greatest(F.lit(least).cast("long"), F.min("v").cast("long")).alias("threshold"))


def hotspot_level(top: Column) -> Column:
    return F.when(top.isNull(), 0).when(top <= 5, 4).when(top <= 10, 3).when(top <= 25, 2).otherwise(1).cast("long")


def ownership_level(share: Column) -> Column:
    return F.when(share >= 0.9, 4).when(share >= 0.75, 3).when(share >= 0.5, 2).otherwise(1).cast("long")


def log_share(n: Column, full: int) -> Column:
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.log2(1 + n) / F.log2(F.lit(1.0 + full))))


def spread(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """At most ``limit`` evenly spaced rows, first and last among them; for short series (its window is over all rows)."""
    w = Window.orderBy(*order)
    numbered = rows.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy()))
    picks = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda k: F.bround(k * (F.col("__n") - 1) / F.lit(limit - 1.0)).cast("int"))
    return numbered.where((F.col("__n") <= limit) | F.array_contains(picks, F.col("__i"))).drop("__i", "__n")


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their number in ``order`` (from 1) within groups of ``by`` of any size; without ``by`` over all rows.

    Rows are dealt by ranges, numbered within each, and moved on by what the
    ranges before hold of the group: a group that fills a third of the table
    spreads over as many tasks. Only a row for each range and group that has rows
    there meets in a window.
    """
    spread = cut(rows.repartitionByRange(*[F.col(c) for c in [*by, *order]]).withColumn("__range", F.spark_partition_id()))
    local = spread.withColumn("__local", F.row_number().over(Window.partitionBy("__range", *by).orderBy(*order)))
    sizes = spread.groupBy("__range", *by).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    keys = ["__range", *by]
    right = before.select("__before", *[F.col(k).alias(f"{k}__of") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__of")) for k in keys])
    return local.join(right, same).withColumn(name, (F.col("__local") + F.col("__before")).cast("long")).select(*rows.columns, name)
