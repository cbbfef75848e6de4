"""Comparing two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare(base: DataFrame, target: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join on ``keys``: status added, removed, modified or unchanged, and the values before and after."""
    b = base.select(*keys, *[F.col(v).alias(f"{v}_before") for v in values], F.lit(True).alias("__b"))
    t = target.select(*keys, *[F.col(v).alias(f"{v}_after") for v in values], F.lit(True).alias("__t"))
    return b.join(t, keys, "full_outer").withColumn("status", _status(values, F.col("__b").isNotNull(), F.col("__t").isNotNull())).drop("__b", "__t")


def _status(values: list[str], before: Column, after: Column) -> Column:
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"{v}_before").eqNullSafe(F.col(f"{v}_after"))
    return F.when(~before, "added").when(~after, "removed").when(same, "unchanged").otherwise("modified")


def compare_sides(both: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``compare`` of two snapshots that are one row for each key already: ``both`` (keys…, v_before, v_after…, in_before, in_after), without a join.

    Keys that hold a null equal none, as in a join: such a row is two, one removed and one added.
    """
    unequal = F.lit(False)
    for k in keys:
        unequal = unequal | F.col(k).isNull()
    def row(before: Column, after: Column) -> Column:
        own = [F.when(held, F.col(f"{v}_{side}")).alias(f"{v}_{side}") for side, held in (("before", before), ("after", after)) for v in values]
        return F.struct(*keys, *own, _status(values, before, after).alias("status"))

    b, t = F.col("in_before"), F.col("in_after")
    return both.select(F.inline(F.when(unequal & b & t, F.array(row(b, ~b), row(~t, t))).otherwise(F.array(row(b, t)))))


def summary(changes: DataFrame, by: str) -> DataFrame:
    """Counts by status, and by status and ``by``, in one pass over grouping sets; ``by`` is null in the former."""
    return changes.groupingSets([["status"], ["status", by]], "status", by).agg(F.count(F.lit(1)).alias("n"))


def innermost(changed: DataFrame, containment: DataFrame) -> DataFrame:
    """Rows of ``changed (id)`` that no changed child explains."""
    parents = changed.join(containment, "id").select(F.col("parent").alias("id")).distinct()
    return changed.join(parents, "id", "left_anti")


def value_changes(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose ``value`` differs from the one before of the same ``key``, with before and after."""
    from pyspark.sql import Window

    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("before", before).where(F.col("before").isNotNull() & ~F.col("before").eqNullSafe(F.col(value))).withColumnRenamed(value, "after")
