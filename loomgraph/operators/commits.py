"""Two tips of a commit graph: their merge bases, and how far each is ahead."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graphs import cut, together

#: Marks of a commit: reached from the first tip, from the second.
FIRST, SECOND, BOTH = 1, 2, 3


def generations(parents: DataFrame, commits: DataFrame) -> DataFrame:
    """(commit, generation) of ``commits (commit)``: 1 for one without parents, else one more than its parents' largest; ``parents (commit, parent)``.

    A round for each generation; histories that bring such numbers along (or any
    that are larger than those of all ancestors) needn't be numbered again.
    """
    left = cut(parents.select("commit", "parent").distinct())
    rest, out = cut(commits.select("commit").distinct()), []
    for k in itertools.count(1):
        free = cut(rest.join(left.select("commit"), "commit", "left_anti").withColumn("generation", F.lit(k).cast("long")))
        if free.isEmpty():
            break
        out = [cut(together([*out, free]))] if len(out) == 10 else [*out, free]
        rest = cut(rest.join(free, "commit", "left_anti"))
        left = cut(left.join(free.select(F.col("commit").alias("parent")), "parent", "left_anti").select("commit", "parent"))
    return together(out) if out else rest.withColumn("generation", F.lit(0).cast("long"))


def marks(parents: DataFrame, numbered: DataFrame, pairs: DataFrame, whole: bool = False) -> DataFrame:
    """(pair, commit, generation, mark) of ``pairs (pair, a, b)``: what is reached from the tips, as far down as it matters.

    Frontiers of both marks go down together, all pairs at once. A commit that has
    one mark goes on while one of the other mark alone stands or moves below it, where they may still meet;
    one that has both while a commit of the pair stands below it that its marks may
    have to change. So two tips that parted lately don't walk the whole history.
    ``whole``: a commit of one mark goes on in any case, so all that one tip alone reaches is there.
    """
    up = cut(parents.select("commit", "parent").distinct().join(numbered.select(F.col("commit").alias("parent"), F.col("generation").alias("parent_generation")), "parent"))
    tips = pairs.select("pair", F.col("a").alias("commit"), F.lit(FIRST).alias("mark")).unionByName(pairs.select("pair", F.col("b").alias("commit"), F.lit(SECOND).alias("mark")))
    tips = tips.groupBy("pair", "commit").agg(F.bit_or("mark").alias("mark")).join(numbered, "commit").select("pair", "commit", "generation", "mark")
    known = front = cut(tips)
    while True:
        # the lowest commit of either mark alone, moving or not
        low = known.groupBy("pair").agg(*[F.min(F.when(F.col("mark") == m, F.col("generation"))).alias(f"low{m}") for m in (FIRST, SECOND)])
        other = F.when(F.col("mark") == FIRST, F.col("low2")).when(F.col("mark") == SECOND, F.col("low1")).otherwise(F.least("low1", "low2"))
        moving_other = front.groupBy("pair").agg(*[F.max(F.when(F.col("mark") == m, F.lit(1))).alias(f"moves{m}") for m in (FIRST, SECOND)])
        moves = F.when(F.col("mark") == FIRST, F.col("moves2")).when(F.col("mark") == SECOND, F.col("moves1")).otherwise(F.coalesce("moves1", "moves2"))
        always = (F.col("mark") != BOTH) & F.lit(whole)
        go = front.join(low, "pair").join(moving_other, "pair").where((F.col("generation") > other) | moves.isNotNull() | always).select("pair", "commit", "mark")
        step = go.join(up, "commit").groupBy("pair", F.col("parent").alias("commit"), F.col("parent_generation").alias("generation")).agg(F.bit_or("mark").alias("new"))
        old = known.select("pair", "commit", F.col("mark").alias("had"))
        front = cut(step.join(old, ["pair", "commit"], "left").withColumn("mark", F.col("new").bitwiseOR(F.coalesce("had", F.lit(0)))).where(F.col("had").isNull() | (F.col("mark") != F.col("had"))).select("pair", "commit", "generation", "mark"))
        if front.isEmpty():
            return known
        known = cut(known.join(front.select("pair", "commit"), ["pair", "commit"], "left_anti").unionByName(front))


def merge_bases(parents: DataFrame, numbered: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, base): all best common ancestors; several after merges that cross.

    Whatever is reached from a common ancestor is common too, so one is best if none of its children is.
    """
    common = cut(marks(parents, numbered, pairs).where(F.col("mark") == BOTH).select("pair", "commit"))
    covered = common.join(parents.select("commit", "parent").distinct(), "commit").select("pair", F.col("parent").alias("commit"))
    return common.join(covered, ["pair", "commit"], "left_anti").select("pair", F.col("commit").alias("base"))


def ahead_behind(parents: DataFrame, numbered: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, ahead, behind, a_in_b, b_in_a): commits of ``b`` alone and of ``a`` alone, and whether a tip is the other or one of its ancestors."""
    m = marks(parents, numbered, pairs, whole=True)
    n = m.groupBy("pair").agg(F.count_if(F.col("mark") == SECOND).alias("ahead"), F.count_if(F.col("mark") == FIRST).alias("behind"))
    return n.select("pair", "ahead", "behind", (F.col("behind") == 0).alias("a_in_b"), (F.col("ahead") == 0).alias("b_in_a"))
