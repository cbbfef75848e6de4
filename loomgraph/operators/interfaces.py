"""HTTP interfaces: prefixes of routers that are mounted in several places, and calls to the routes they reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.labels import join_paths, method_matches
from loomgraph.operators.graphs import cut

# fixed values: mounts of mounts that are followed, prefixes of a router, routes that one call may reach, and what a call of several is worth
MOUNT_DEPTH, PREFIXES, MATCHES, SHARED = 6, 4, 3, 0.8


def mount_prefixes(routers: DataFrame, mounts: DataFrame, max_depth: int = MOUNT_DEPTH, most: int = PREFIXES) -> DataFrame:
    """(router, place, prefix, mounted): under what prefixes each router answers, the first ``most`` in the order of its mounts, theirs, and so on.

    ``routers (router, kind, prefix, app)``, ``mounts (router, place, owner,
    prefix)``: where ``owner`` puts it. Prefixes multiply over all ways of mounts up to an app, which counts as
    mounted, to a router without mounts or one that isn't known. A way ends where it
    meets a router again or is deeper than ``max_depth``. A blueprint's own prefix gives way to the mount's.

    Each round follows all ways one mount on. Every way ends somewhere, so of a router's
    ways only the first ``most`` are ever kept, whatever the number of mounts.
    """
    known = cut(routers.select(F.col("router").alias("at"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("prefix", F.lit("")).alias("own"), F.coalesce("app", F.lit(False)).alias("app"), F.lit(True).alias("known")))
    by = cut(mounts.groupBy(F.col("router").alias("at")).agg(F.array_sort(F.collect_list(F.struct("place", "owner", F.coalesce("prefix", F.lit("")).alias("prefix")))).alias("mounts")))
    state = ["router", "at", "suffix", "path", "rank", "ended", "mounted"]
    none = F.array().cast("array<string>")
    rows = cut(routers.select("router", F.col("router").alias("at"), F.lit("").alias("suffix"), none.alias("path"), F.array().cast("array<int>").alias("rank"), F.lit(False).alias("ended"), F.lit(False).alias("mounted")))
    first = F.row_number().over(Window.partitionBy("router").orderBy("rank"))
    while True:
        moving = rows.where(~F.col("ended"))
        if moving.isEmpty():
            break
        met = moving.join(known, "at", "left").join(by, "at", "left")
        stop = F.col("known").isNull() | F.col("app") | (F.size("path") > max_depth) | F.array_contains("path", F.col("at"))
        start = F.size("path") == 0
        bare = F.when(start, F.col("own")).otherwise(join_paths(F.col("own"), F.col("suffix")))

        def to(**columns: Column) -> Column:
            return F.struct(*[columns.get(c, F.col(c)).alias(c) for c in state])

        def through(m: Column) -> Column:
            mine = F.when((F.col("kind") == "Blueprint") & (m["prefix"] != ""), m["prefix"]).otherwise(join_paths(m["prefix"], F.col("own")))
            return to(at=m["owner"], suffix=join_paths(mine, F.col("suffix")), path=F.concat("path", F.array("at")), rank=F.concat("rank", F.array(m["place"])))

        next_ = F.when(stop, F.array(to(ended=F.lit(True), mounted=F.coalesce("app", F.lit(False))))).when(F.col("mounts").isNull(), F.array(to(ended=F.lit(True), suffix=bare))).otherwise(F.transform("mounts", through))
        step = met.select(F.inline(next_)).unionByName(rows.where("ended"))
        rows = cut(step.withColumn("k", first).where(F.col("k") <= most).drop("k"))
    return rows.select("router", (first - 1).alias("place"), F.col("suffix").alias("prefix"), "mounted")


def _segments(template: Column) -> Column:
    return F.split(template, "/")


def fits(consumer: Column, route: Column) -> Column:
    """Whether a consumer's segment is a route's: equal, any for ``{}``, and for a segment with ``{}`` inside one that has text there."""
    pattern = F.concat(F.lit(r"^\Q"), F.replace(route, F.lit("{}"), F.lit(r"\E[^/]+\Q")), F.lit(r"\E$"))
    return (consumer == route) | (route == "{}") | (F.contains(route, F.lit("{}")) & ~F.contains(consumer, F.lit("{}")) & F.rlike(consumer, pattern))


def route_calls(consumers: DataFrame, routes: DataFrame, most: int = MATCHES) -> DataFrame:
    """(consumer, route, confidence): the first ``most`` routes, by ``place``, whose method and template each call fits, but for those of its own file.

    ``consumers (consumer, path, method, template, confidence)``: a null method is any; ``routes
    (route, path, method, template, place)``. A call that fits several is less sure. A route is looked up
    by that of its literal segments that the fewest routes have at its place, so templates that
    begin alike don't meet every call; those without one by their number of segments.
    """
    r = cut(routes.select("route", F.col("path").alias("route_path"), F.col("method").alias("route_method"), "place", _segments(F.col("template")).alias("rs")).withColumn("n", F.size("rs")))
    literal = r.select("route", "n", F.posexplode("rs").alias("at", "segment")).where((F.col("segment") != "") & ~F.contains("segment", F.lit("{}")))
    common = literal.groupBy("n", "at", "segment").agg(F.count(F.lit(1)).alias("routes"))
    rare = literal.join(common, ["n", "at", "segment"]).groupBy("route").agg(F.min(F.struct("routes", "at", "segment")).alias("key"))
    keyed = r.join(rare, "route", "left").select("route", "route_path", "route_method", "place", "rs", "n", F.coalesce("key.at", F.lit(-1)).alias("at"), F.coalesce("key.segment", F.lit("")).alias("segment"))
    c = consumers.select("consumer", "path", "method", "confidence", _segments(F.col("template")).alias("cs")).withColumn("n", F.size("cs"))
    places = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit("").alias("segment"))), F.transform("cs", lambda s, i: F.struct(i.alias("at"), s.alias("segment"))))
    met = c.select("*", F.inline(places)).join(keyed, ["n", "at", "segment"])
    alike = F.forall(F.arrays_zip("cs", "rs"), lambda x: fits(x["cs"], x["rs"]))
    hits = met.where(method_matches(F.col("method"), F.col("route_method")) & alike)
    w = Window.partitionBy("consumer")
    ranked = hits.withColumn("hits", F.count(F.lit(1)).over(w)).withColumn("k", F.row_number().over(w.orderBy("place", "route"))).where(F.col("k") <= most)
    sure = F.round(F.col("confidence") * F.when(F.col("hits") == 1, 1.0).otherwise(SHARED), 2)
    return ranked.where(~F.col("path").eqNullSafe(F.col("route_path"))).select("consumer", "route", sure.alias("confidence"))
