"""Checkpoints of sessions: how many are kept, what becomes of the changes of dropped ones, and content that nothing refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graphs import cut
from loomgraph.operators.reviews import merged_status

#: Seconds in which content without a reference may still be about to get one.
GRACE_SECONDS = 600


def _folded(steps: Column) -> Column:
    """The changes of a path, in order, as one; null if it came and went. Lines add up as long as both are known."""
    none = F.lit(None).cast("struct<status:string,added:bigint,removed:bigint>")
    total = lambda a, b, c: (a[c] + b[c]).alias(c)

    def both(a: Column, b: Column) -> Column:
        status = merged_status(a["status"], b["status"])
        gone = (a["status"] == "added") & (b["status"] == "removed")
        return F.when(a.isNull(), b).when(gone, none).otherwise(F.struct(status.alias("status"), total(a, b, "added"), total(a, b, "removed")))

    each = F.transform(F.array_sort(steps), lambda x: F.struct(x["status"].alias("status"), x["added"].cast("bigint").alias("added"), x["removed"].cast("bigint").alias("removed")))
    return F.reduce(each, none, both)


def _into_next(checkpoints: DataFrame, changes: DataFrame, dropped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checkpoints without ``dropped (session, n)``, whose changes go to the next one that stays."""
    marked = checkpoints.join(dropped.withColumn("gone", F.lit(True)), ["session", "n"], "left")
    after = F.min(F.when(F.col("gone").isNull(), F.col("n"))).over(Window.partitionBy("session").orderBy("n").rowsBetween(0, Window.unboundedFollowing))
    to = cut(marked.withColumn("to", after))
    kept = to.groupBy("session", "to").agg(F.max_by("auto", "n").alias("auto"), F.sum(F.col("merged") + F.when(F.col("gone"), 1).otherwise(0)).cast("long").alias("merged"))
    moved = changes.join(to.select("session", "n", "to"), ["session", "n"])
    one = moved.groupBy("session", "to", "path").agg(_folded(F.collect_list(F.struct("n", "status", "added", "removed"))).alias("c")).where("c is not null")
    return kept.withColumnRenamed("to", "n"), one.select("session", F.col("to").alias("n"), "path", "c.status", "c.added", "c.removed")


def pruned(checkpoints: DataFrame, changes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """((session, n, auto, merged), (session, n, path, status, added, removed)): at most ``limit`` (1 or more) checkpoints of each session.

    ``checkpoints (session, n, auto)``, ``changes (session, n, path, status,
    added, removed)``. The oldest automatic ones go first, then the oldest; the last
    of a session always stays. What a dropped one changed is folded into the next one that is there then, so automatic
    ones are folded before the others: the timeline's statuses still add up. ``merged`` counts the dropped ones in each.
    """
    rows = cut(checkpoints.select("session", "n", F.coalesce("auto", F.lit(False)).alias("auto")).withColumn("merged", F.lit(0).cast("long")))
    w = Window.partitionBy("session")
    over = rows.withColumn("over", F.count(F.lit(1)).over(w) - limit).withColumn("last", F.max("n").over(w)).where("over > 0 and n < last")
    order = over.withColumn("k", F.row_number().over(w.orderBy(F.desc("auto"), "n"))).where("k <= over").select("session", "n", "auto")
    order = cut(order)
    rows, changes = _into_next(rows, changes.select("session", "n", "path", "status", "added", "removed"), order.where("auto").select("session", "n"))
    return _into_next(cut(rows), cut(changes), order.where("not auto").select("session", "n"))


def unreferenced(files: DataFrame, references: DataFrame, now: Column, grace: int = GRACE_SECONDS) -> DataFrame:
    """``files (name, modified, …)``, ``modified`` in seconds, that no row of ``references (name)`` names and that weren't touched within ``grace`` seconds of ``now``."""
    used = references.where("name is not null").select("name").distinct()
    return files.join(used, "name", "left_anti").where(now - F.col("modified") > grace)
