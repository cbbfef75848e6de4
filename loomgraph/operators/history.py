"""History mining: change coupling, churn, ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def co_change(files: DataFrame, max_files: int = 30, min_shared: int = 3, min_revs: int = 5, min_degree: float = 0.5) -> DataFrame:
    """(path, partner, shared, revs, degree), each direction, of files that change together.

    ``files`` holds distinct (commit, path); commits of more than ``max_files``
    files are left out, also of revs. A commit's pairs number at most
    max_files squared, so the self-join grows with the commits only.
    """
    size = files.groupBy("commit").agg(F.count(F.lit(1)).alias("size"))
    small = files.join(size.where(F.col("size") <= max_files), "commit").select("commit", "path")
    revs = small.groupBy("path").agg(F.count(F.lit(1)).alias("revs"))
    # one pass over commits instead of a self-join: the sets are bounded
    sets = small.groupBy("commit").agg(F.collect_list("path").alias("paths"))
    pairs = sets.select(F.explode("paths").alias("path"), "paths").select("path", F.explode("paths").alias("partner")).where("path <> partner")
    shared = pairs.groupBy("path", "partner").agg(F.count(F.lit(1)).alias("shared"))
    out = shared.where(F.col("shared") >= min_shared).join(revs.where(F.col("revs") >= min_revs), "path")
    return out.withColumn("degree", F.col("shared") / F.col("revs")).where(F.col("degree") >= min_degree)


def top_partners(coupling: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("path").orderBy(F.desc("degree"), F.desc("shared"), "partner")
    return coupling.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def pairs_once(coupling: DataFrame) -> DataFrame:
    """(a, b, shared, degree_a, degree_b) with a < b; a degree is null where that direction fell below the threshold."""
    a, b = F.least("path", "partner").alias("a"), F.greatest("path", "partner").alias("b")
    first = F.col("path") < F.col("partner")
    return coupling.groupBy(a, b).agg(F.max("shared").alias("shared"), F.max(F.when(first, F.col("degree"))).alias("degree_a"), F.max(F.when(~first, F.col("degree"))).alias("degree_b"))


def churn(files: DataFrame, commits: DataFrame) -> DataFrame:
    """(path, commits, authors, last_ts)."""
    return files.join(commits, "commit").groupBy("path").agg(F.count(F.lit(1)).alias("commits"), F.count_distinct("author").alias("authors"), F.max("ts").alias("last_ts"))


def ownership(changes: DataFrame) -> DataFrame:
    """(path, authors, commits, owner_share) of rows (path, author)."""
    per = changes.groupBy("path", "author").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("path").agg(F.count(F.lit(1)).alias("authors"), F.sum("c").alias("commits"), (F.max("c") / F.sum("c")).alias("owner_share"))


def top_owners(changes: DataFrame, k: int = 3) -> DataFrame:
    per = changes.groupBy("path", "author").agg(F.count(F.lit(1)).alias("commits"))
    w = Window.partitionBy("path").orderBy(F.desc("commits"), "author")
    return per.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def sparkline(changes: DataFrame, buckets: int = 12) -> DataFrame:
    """(path, bucket, n) on ``buckets`` equal slices of the whole time span (column ``us``); empty buckets have 0."""
    ends = changes.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    slot = F.least(F.lit(buckets - 1), F.expr(f"((us - lo) * {buckets}) div greatest(1, hi - lo)"))
    counted = changes.crossJoin(F.broadcast(ends)).groupBy("path", slot.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    spine = changes.select("path").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    return spine.join(counted, ["path", "bucket"], "left").select("path", "bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
