"""Graph loops: closure, reachability, shortest paths, strong components, layers.

Each round is one join of the frontier with the edges; rounds are written to the
checkpoint folder, so a lost executor costs a round and plans stay short.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table of the session's checkpoint folder and read back; where that is unset, a local session gets a temporary one and a cluster one in its warehouse.

    Not ``checkpoint()``: that carries the plan's estimated size on, a product for each join, so loops come to numbers of
    millions of digits in the driver; and its rows are written wide and uncompressed.
    """
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        own = tempfile.mkdtemp(prefix="checkpoints-") if sc.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    path = f"{sc.getCheckpointDir()}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# rows of one task that sorts or hashes them by key
ROWS_A_TASK = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of at most about ``rows`` rows, dealt by ``keys`` in as many parts as leave a task ``ROWS_A_TASK``: what one task holds doesn't grow with the table.

    Grouping and joins by these keys, or more, then need no further shuffle; adaptive execution would put parts together up to a size in bytes, of packed rows.
    """
    return df.repartition(max(1, -(-rows // ROWS_A_TASK)), *keys)


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ancestors(containment: DataFrame, max_depth: int = 64) -> DataFrame:
    """(id, ancestor, depth) of a tree (id, parent); the parent has depth 1. Raises where chains are longer than ``max_depth``, as on a cycle."""
    level = containment.select("id", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("depth"))
    out = level
    up = containment.select(F.col("id").alias("ancestor"), F.col("parent").alias("above"))
    for _ in range(max_depth):
        level = cut(level.join(up, "ancestor").select("id", F.col("above").alias("ancestor"), (F.col("depth") + 1).alias("depth")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    else:
        raise ValueError(f"a chain of more than {max_depth} parents: a cycle, or a larger max_depth is needed")
    return out


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, node, distance) over edges (src, dst), as far as they lead or ``max_depth`` of them; a start is at 0 from itself.

    Each round writes what is new alone; rounds are put together by tens, so plans stay short.
    """
    front = starts.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("distance"))
    seen = [front]
    edges = edges.select("src", "dst").distinct()
    for d in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        step = front.join(edges, front.node == edges.src).select("start", F.col("dst").alias("node")).distinct()
        front = cut(step.join(together(seen), ["start", "node"], "left_anti").withColumn("distance", F.lit(d).cast("long")))
        if front.isEmpty():
            break
        seen = [cut(together([*seen, front]))] if len(seen) == 10 else [*seen, front]
    return together(seen)


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that reaches a node and is reached from it.

    Nodes that nothing enters or leaves are components by themselves and go
    first. Of the rest each takes as its colour the smallest node that reaches
    it; the nodes of a colour that reach the node it is named for are that node's
    component. What is left begins anew. Tables have a row for each node or
    edge, never for a pair that merely reaches.
    """
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst"))).distinct())
    edges = cut(edges.where("src <> dst").select("src", "dst").distinct())
    done: list[DataFrame] = []

    def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
        return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")

    while not nodes.isEmpty():
        entered, left = edges.select(F.col("dst").alias("node")).distinct(), edges.select(F.col("src").alias("node")).distinct()
        core = cut(nodes.join(entered, "node", "left_semi").join(left, "node", "left_semi"))
        single = cut(nodes.join(core, "node", "left_anti"))
        if not single.isEmpty():
            done.append(single.select("node", F.col("node").alias("component")))
            nodes, edges = core, cut(inside(edges, core))
            continue
        colour = front = nodes.select("node", F.col("node").alias("colour"))
        while True:
            step = front.join(edges, front.node == edges.src).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("new"))
            front = cut(step.join(colour, "node").where("new < colour").select("node", F.col("new").alias("colour")))
            if front.isEmpty():
                break
            colour = cut(colour.join(front.withColumnRenamed("colour", "new"), "node", "left").select("node", F.coalesce("new", "colour").alias("colour")))
        by = colour.select(F.col("node").alias("dst"), F.col("colour").alias("to"))
        same = cut(edges.join(colour.withColumnRenamed("node", "src"), "src").join(by, "dst").where("colour = to").select("src", "dst"))
        front = colour.where("node = colour")
        found = [front]
        while True:
            step = front.join(same, front.node == same.dst).select(F.col("src").alias("node"), "colour").distinct()
            front = cut(step.join(together(found), "node", "left_anti"))
            if front.isEmpty():
                break
            found = [cut(together([*found, front]))] if len(found) == 10 else [*found, front]
        own = cut(together(found))
        done.append(own.select("node", F.col("colour").alias("component")))
        nodes = cut(nodes.join(own, "node", "left_anti"))
        edges = cut(inside(edges, nodes))
    return together(done) if done else nodes.select("node", F.col("node").alias("component"))


def shortest_paths(edges: DataFrame, start: int, goal: int, max_paths: int = 5, max_depth: int = 8) -> DataFrame:
    """(path) arrays of the shortest chains from ``start`` to ``goal``, at most ``max_paths`` in order."""
    spark = edges.sparkSession
    edges = edges.select("src", "dst").distinct()
    # only edges that lie on some shortest chain: distance from the start plus one is the distance of the end
    dist = reachable(edges, spark.createDataFrame([(start,)], "start long"), max_depth).select("node", "distance")
    on = edges.join(dist.select(F.col("node").alias("src"), F.col("distance").alias("a")), "src").join(dist.select(F.col("node").alias("dst"), F.col("distance").alias("b")), "dst").where("b = a + 1").select("src", "dst")
    row = dist.where(F.col("node") == goal).first()
    if row is None or row.distance == 0:
        return spark.createDataFrame([], "path array<bigint>")
    # edges from which the goal can still be reached, so every prefix ends at the goal
    back = on.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    useful = reachable(back, spark.createDataFrame([(goal,)], "start long"), max_depth).select(F.col("node").alias("dst"))
    on = cut(on.join(useful, "dst", "left_semi").select("src", "dst"))
    paths = spark.createDataFrame([([start],)], "path array<bigint>")
    for _ in range(row.distance):
        # the first k prefixes in order hold the prefixes of the first k chains
        paths = cut(paths.join(on, F.element_at("path", -1) == F.col("src")).select(F.concat("path", F.array("dst")).alias("path")).orderBy("path").limit(max_paths))
    return paths.orderBy("path")


def shortest_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, path): for each strong component (node, component) a shortest cycle through its smallest node.

    Of equally short ones the first in node order; components without an inner edge have none.
    """
    c = components.select("node", "component")
    inner = edges.join(c.withColumnRenamed("node", "src"), "src").join(c.select(F.col("node").alias("dst"), F.col("component").alias("__c")), "dst").where("component = __c")
    inner = cut(inner.select("component", "src", "dst").distinct())
    front = inner.select("component").distinct().select("component", F.col("component").alias("node"), F.array("component").alias("path"))
    seen, found = None, None
    while True:  # every round reaches nodes not seen before
        step = front.withColumnRenamed("node", "src").join(inner, ["component", "src"]).select("component", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("component", "node").agg(F.min("path").alias("path"))
        front = cut(step if seen is None else step.join(seen, ["component", "node"], "left_anti"))
        if front.isEmpty():
            break
        closed = front.where("node = component").select("component", "path")
        found = closed if found is None else found.unionByName(closed)
        front = cut(front.join(found, "component", "left_anti"))
        seen = cut(front.select("component", "node") if seen is None else seen.unionByName(front.select("component", "node")))
    return front.select("component", "path") if found is None else found


def layers(edges: DataFrame) -> DataFrame:
    """(node, layer) of an acyclic graph by peeling nodes without incoming edges; nodes on cycles are left out."""
    edges = edges.where("src <> dst").select("src", "dst").distinct()
    left = cut(edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst"))).distinct())
    out = None
    for k in itertools.count():
        free = cut(left.join(edges.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("layer", F.lit(k).cast("long")))
        if free.isEmpty():
            break
        out = free if out is None else out.unionByName(free)
        left = cut(left.join(free, "node", "left_anti"))
        edges = cut(edges.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
    return out if out is not None else left.withColumn("layer", F.lit(0).cast("long")).limit(0)
