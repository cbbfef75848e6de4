"""Lookups and rankings: longest prefixes, sampling of points, eviction, mount trees, dependency changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graphs import ancestors
from loomgraph.operators.texts import version_key


def longest_prefix(names: DataFrame, packages: DataFrame, separator: str = ".") -> DataFrame:
    """(name, package): the longest declared prefix (prefix, package) by whole segments; two packages of it are a tie and give none."""
    parts = F.split("name", F.lit("\\" + separator))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))
    p = packages.groupBy("prefix").agg(F.count_distinct("package").alias("k"), F.min("package").alias("package"))
    found = names.select("name").distinct().select("name", F.explode(prefixes).alias("prefix")).join(p, "prefix")
    best = found.groupBy("name").agg(F.max_by(F.struct("k", "package"), F.length("prefix")).alias("m"))
    return best.where("m.k = 1").select("name", F.col("m.package").alias("package"))


def spaced_points(points: DataFrame, key: str, at: str, step: int) -> DataFrame:
    """(key, at): from the newest back, each point at least ``step`` before the one kept last; a key's points are one array."""
    newest = F.sort_array(F.collect_set(at), asc=False)
    keep = lambda acc, x: F.when((F.size(acc) == 0) | (x <= F.element_at(F.when(F.size(acc) > 0, acc), -1) - step), F.concat(acc, F.array(x))).otherwise(acc)
    return points.groupBy(key).agg(newest.alias("a")).select(key, F.explode(F.reduce("a", F.array().cast("array<bigint>"), keep)).alias(at))


def evict(entries: DataFrame, by: str, used: str, key: str, size: str, free: float = 0.1) -> DataFrame:
    """Entries to drop of each cache, least recently used first, until a share of its bytes is free."""
    w = Window.partitionBy(by)
    before = F.sum(size).over(w.orderBy(used, key).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    return entries.withColumn("__before", before).withColumn("__all", F.sum(size).over(w)).where(F.col("__before") < free * F.col("__all")).drop("__before", "__all")


def mounted(containment: DataFrame, segments: DataFrame, max_depth: int = 6) -> DataFrame:
    """(id, route): the segments (id, segment) of a node's ancestors and its own, outermost first."""
    own = containment.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("depth"))
    chain = ancestors(containment, max_depth).unionByName(own).join(segments.withColumnRenamed("id", "ancestor"), "ancestor")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "segment"))), lambda x: x["segment"])
    return chain.groupBy("id").agg(F.concat(F.lit("/"), F.array_join(ordered, "/")).alias("route"))


def version_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, before, after, change) of (keys…, spec): added, removed, upgraded, downgraded or changed; equal ones are left out."""
    j = before.withColumnRenamed("spec", "before").withColumn("__b", F.lit(True)).join(after.withColumnRenamed("spec", "after").withColumn("__a", F.lit(True)), keys, "full_outer")
    b, a = version_key(F.col("before")), version_key(F.col("after"))
    change = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(b < a, "upgraded").when(b > a, "downgraded").otherwise("changed")
    return j.withColumn("change", change).where(F.col("change").isin("added", "removed") | ~F.col("before").eqNullSafe(F.col("after"))).drop("__b", "__a")


def top_and_rest(rows: DataFrame, order: list, limit: int, by: list[str]) -> DataFrame:
    """The first ``limit`` rows of each group with ``more``: how many rows of the group are left out."""
    w = Window.partitionBy(*by)
    ranked = rows.withColumn("position", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("more", F.greatest(F.lit(0).cast("long"), F.count(F.lit(1)).over(w) - limit))
    return ranked.where(F.col("position") <= limit)
