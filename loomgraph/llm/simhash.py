"""SimHash near-duplicates by a generalised pigeonhole search.

A fingerprint has a bit for each bit position that is set in more than half of
the hashes of a text's word shingles. Fingerprints within ``max_distance`` bits
are linked; a group is a connected component of links.

Search: the bits are grouped into partitions of correlated bits; each partition
gets its own threshold, found by dynamic programming on the candidate counts
that a sample predicts. Two fingerprints within ``max_distance`` must meet one
partition's threshold when the thresholds add up to
``max_distance - partitions + 1``, so probing each partition within its
threshold and verifying the whole fingerprints loses nothing.

Near copies by similarity (``drop_near_copies``) lie too far apart in their 256
bits for that sum. There the same dynamic programming picks thresholds so that
a pair of the wanted similarity is met with a given chance, from partitions of
several divisions of the bits and of a width that suits the number of
fingerprints; what is met and near is verified by the similarity itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, add_columns, broadcast_if_small, components, free_names, gathered, hot_lookup, map_batches, materialize, table, text_of

#: Fingerprints that the cost model looks at. In the search within ``max_distance`` it steers the work alone; in the wide search, which meets a pair with
#: a chance of ``RECALL`` or more, also which of the pairs are the ones that aren't met.
SAMPLE = 2000
#: Open pairs of a node that a bucket hands on in the first round after the forests; sixteen times as many in each further one, so that
#: the third has all of a pair of blocks.
NEAREST = 16
#: Members of one bucket that a task compares at once; larger buckets are dealt out in pairs of blocks.
BLOCK = 2048
#: Pairs whose fingerprints a task compares at once.
PAIRS = 1 << 19
#: Chance that the wide search meets a pair of just the wanted similarity whose bits are a standard deviation further apart than such pairs' mean.
RECALL = 0.95


def shingle_hashes(text: str, words_each: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words_each`` words, repeats included; of the whole sequence if there are fewer."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > words_each:
        starts, ends = starts[: len(words) - words_each + 1], ends[words_each - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent 64 bits of a hash; the 0th are the hash."""
    if k == 0:
        return h
    h = h + np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str, words_each: int = 3, lanes: int = 1, distinct: bool = False) -> list[int]:
    """``lanes`` times 64 bits as signed integers; all zero without words. ``distinct``: each shingle counts once."""
    h = shingle_hashes(text, words_each)
    if distinct:
        h = np.unique(h)
    out = []
    for k in range(lanes):
        votes = np.zeros(64, np.int64)
        for at in range(0, len(h), 65536):
            bits = np.unpackbits(_mix(h[at : at + 65536], k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += bits.sum(0, dtype=np.int64)
        packed = np.packbits((2 * votes > len(h)).astype(np.uint8), bitorder="little")
        out.append(int(packed.view(np.int64)[0]))
    return out


def fingerprints(docs: DataFrame, words_each: int = 3, lanes: int = 1, distinct: bool = False) -> DataFrame:
    """(doc_id, text_hash, f0 .. f<lanes-1>) of whole texts, without a shuffle."""
    fields = [T.StructField(f"f{k}", T.LongType()) for k in range(lanes)]
    slim = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), "text")
    return add_columns(slim, fields, lambda texts: (tuple(fingerprint(t, words_each, lanes, distinct)) for t in texts), keep=["doc_id", "text_hash"])


def bit_matrix(fps: np.ndarray) -> np.ndarray:
    """0/1 rows of fingerprints of shape (n, lanes)."""
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")


def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Partition the bit positions evenly, putting correlated bits together."""
    n = bits.shape[1]
    x = bits - bits.mean(0)
    sd = np.sqrt((x**2).mean(0)) + 1e-9
    corr = np.abs((x.T @ x) / max(1, len(bits)) / np.outer(sd, sd))
    free, out = np.ones(n, bool), []
    for k in range(parts):
        size = (int(free.sum())) // (parts - k)
        # of equal sums the first position
        total = np.where(free, corr[:, free].sum(1), -np.inf)
        own = [int(np.argmax(total))]
        free[own[0]] = False
        near = corr[:, own[0]].copy()
        while len(own) < size:
            own.append(int(np.argmax(np.where(free, near, -np.inf))))
            free[own[-1]] = False
            near += corr[:, own[-1]]
        out.append(sorted(own))
    return out


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds t_i >= -1 with sum ``total`` and the least sum of ``costs[i][t_i + 1]``, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (cost, picks) in best.items():
            for t, c in enumerate(row):
                s = have + t - 1
                if s not in step or cost + c < step[s][0]:
                    step[s] = (cost + c, [*picks, t - 1])
        best = step
    return best[total][1]


def plan_search(sample: np.ndarray, n: int, max_distance: int, bits_wide: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, for ``n`` fingerprints."""
    bits = bit_matrix(sample) if len(sample) else np.zeros((1, bits_wide), np.uint8)
    scale = (n / max(1, len(bits))) ** 2
    best = None
    for parts in range(1, max_distance + 2):
        groups = group_bits(bits.astype(np.float64), parts)
        total = max_distance - parts + 1
        costs = []
        for g in groups:
            x = bits[:, g].astype(np.float32)
            ones = x.sum(1)
            apart = np.rint(ones[:, None] + ones[None, :] - 2 * (x @ x.T)).astype(np.int64)
            # smoothed by what random bits would give, so an empty cell of the sample isn't free
            seen = np.bincount(apart.ravel(), minlength=len(g) + 1)[: len(g) + 1].astype(float)
            seen[0] -= len(bits)
            chance = np.array([math.comb(len(g), r) / 2.0 ** len(g) for r in range(len(g) + 1)])
            pairs = np.cumsum(np.maximum(seen * scale, chance * n * n)) / 2
            probes = np.cumsum([math.comb(len(g), r) for r in range(len(g) + 1)], dtype=float) * n
            costs.append([0.0] + [20 * probes[t] + pairs[t] for t in range(min(total + parts - 1, len(g)) + 1)])
        picks = allocate(costs, total)
        cost = sum(c[t + 1] for c, t in zip(costs, picks))
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, picks) if t >= 0])
    return best[1]


def spanning_forest(l: np.ndarray, r: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the edges (l, r) of weight d between ``n`` nodes that make a spanning forest of the least weight, by rounds of nearest edges of all trees at once."""
    label, out = np.arange(n), []
    edge = np.lexsort((r, l, d))
    while len(edge):
        a, b = label[l[edge]], label[r[edge]]
        apart = a != b
        edge, a, b = edge[apart], a[apart], b[apart]
        if not len(edge):
            break
        # the first edge, in one order for all, of each tree
        first = np.full(n, len(edge))
        np.minimum.at(first, a, np.arange(len(edge)))
        np.minimum.at(first, b, np.arange(len(edge)))
        trees = np.flatnonzero(first < len(edge))
        pick = first[trees]
        out.append(edge[np.unique(pick)])
        parent = np.arange(n)
        parent[trees] = np.where(a[pick] == trees, b[pick], a[pick])
        # two trees that pick the same edge: the smaller is the root
        back = (parent[parent[trees]] == trees) & (trees < parent[trees])
        parent[trees[back]] = trees[back]
        while (parent != parent[parent]).any():
            parent = parent[parent]
        label = parent[label]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def nearest_open(i: np.ndarray, j: np.ndarray, d: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, bool]:
    """(numbers of the pairs (i, j) of distance d between groups that are among the ``most`` nearest such pairs of one of their ends, whether there are others)."""
    open_ = np.flatnonzero(group[i] != group[j])
    k = len(open_)
    ends = np.concatenate((i[open_], j[open_]))
    order = np.lexsort((np.concatenate((d[open_], d[open_])), ends))
    ends = ends[order]
    begin = np.flatnonzero(np.append(True, ends[1:] != ends[:-1])) if k else np.empty(0, np.int64)
    place = np.arange(2 * k) - np.repeat(begin, np.diff(np.append(begin, 2 * k)))
    near = np.zeros(2 * k, bool)
    near[order] = place < most
    near = near[:k] | near[k:]
    return open_[near], not near.all()


def near_pairs(fps: np.ndarray, bucket: np.ndarray, probe: np.ndarray, max_distance: int, group: np.ndarray | None = None, most: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(i, j, distance, whether there are more) of near pairs within each bucket; ``bucket`` is sorted.

    Without ``group`` a spanning forest of them, at most one pair fewer than
    members; else the ``most`` nearest of each member that lead to another group.
    """
    n = len(bucket)
    ends = np.searchsorted(bucket, bucket, side="right")
    after = ends - np.arange(n) - 1
    begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    upto = np.concatenate(([0], np.cumsum(np.add.reduceat(after, begins))))
    at = 0
    while at < len(begins):
        # whole buckets of so many pairs together
        last = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, side="right")) - 1)
        lo, hi = begins[at], begins[last] if last < len(begins) else n
        each = after[lo:hi]
        i = np.repeat(np.arange(lo, hi), each)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each)
        some = ~(probe[i] & probe[j])
        i, j = i[some], j[some]
        d = np.zeros(len(i), np.int64)
        for k in range(fps.shape[1]):
            d += np.bitwise_count(fps[i, k] ^ fps[j, k])
        near = d <= max_distance
        i, j, d = i[near], j[near], d[near]
        kept, more = (spanning_forest(i - lo, j - lo, d, hi - lo), False) if group is None else nearest_open(i, j, d, group, most)
        yield i[kept], j[kept], d[kept], more
        at = last


def links_within(nodes: DataFrame, parts: list[tuple[list[int], int]], max_distance: int, lanes: int, most: int = 0) -> DataFrame:
    """Links (a, b) between ``nodes (node, f0 ..)`` that span each bucket's components of pairs within ``max_distance``, the nearest pairs first.

    With ``most``: of ``nodes (node, f0 .., group)`` the pairs between groups that are among the
    ``most`` nearest of one of their ends; a row of nulls says that a bucket has more.
    """
    # as few signatures a fingerprint as the thresholds need, in slices that fit a batch
    masks = [[sum(1 << i for i in c) for r in range(t + 1) for c in combinations(range(len(g)), r)] for g, t in parts]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                groups = [part.column(1 + lanes)] if most else []
                fps = np.stack([part.column(1 + k).to_numpy(zero_copy_only=False) for k in range(lanes)], 1)
                bits = bit_matrix(fps).astype(np.int64)
                for j, (g, _) in enumerate(parts):
                    value = bits[:, g] @ (1 << np.arange(len(g), dtype=np.int64))
                    for m in masks[j]:
                        key = (np.int64(j) << np.int64(48)) ^ ((value ^ m) if len(g) <= 48 else ((value ^ m) * np.int64(0x1E3779B97F4A7C15) >> np.int64(16)))
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), *[pa.array(fps[:, k]) for k in range(lanes)], pa.array(np.full(len(ids), m != 0)), *groups], names=wide.names)

    wide = T.StructType([T.StructField("key", T.LongType()), T.StructField("node", T.LongType()), *[T.StructField(f"f{k}", T.LongType()) for k in range(lanes)], T.StructField("probe", T.BooleanType()), *[T.StructField("group", T.LongType())] * bool(most)])
    slim = nodes.select("node", *[f"f{k}" for k in range(lanes)], *["group"] * bool(most))
    keyed = map_batches(slim, keys, wide)
    # a bucket above BLOCK is dealt in pairs of blocks, whatever the input
    large = materialize(keyed.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    n_large = large.count()
    if n_large:
        marked = keyed.join(broadcast_if_small(large, 32), "key", "left").withColumn("own", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).otherwise(F.lit(0)))
        dealt = marked.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
        dealt = dealt.withColumn("pair", F.least("own", "other").cast("long") * F.lit(1 << 31) + F.greatest("own", "other")).drop("blocks", "own", "other")
    else:
        dealt = keyed.withColumn("pair", F.lit(0).cast("long"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        at = 2 + lanes

        def send(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            bucket = np.cumsum(np.append(False, (x[1:, 0] != x[:-1, 0]) | (x[1:, -1] != x[:-1, -1])))
            for i, j, _, more in near_pairs(x[:, 2:at].view(np.uint64), bucket, x[:, at].astype(bool), max_distance, x[:, at + 1] if most else None, most):
                a, b = x[i, 1], x[j, 1]
                apart = a != b
                a, b = a[apart], b[apart]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
                if more:
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 2, names=["a", "b"])

        for batch in gathered(batches, lambda b: b.num_rows, 1 << 14):
            x = np.stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            x = x if rest is None else np.concatenate((rest, x))
            if not len(x):
                continue
            other = np.flatnonzero((x[:, 0] != x[-1, 0]) | (x[:, -1] != x[-1, -1]))
            last = int(other[-1]) + 1 if len(other) else 0
            rest = x[last:]
            if last:
                yield from send(np.ascontiguousarray(x[:last]))
        if rest is not None and len(rest):
            yield from send(np.ascontiguousarray(rest))

    dealt = dealt.repartition("key", "pair").sortWithinPartitions("key", "pair")
    return map_batches(dealt, verify, "a long, b long").distinct()


def distinct_prints(prints: DataFrame, lanes: int) -> tuple[DataFrame, int, np.ndarray]:
    """(the distinct fingerprints as a table (f0 .., node), their number, a sample of them)."""
    f = [f"f{k}" for k in range(lanes)]
    distinct = materialize(prints.select(*f).distinct().withColumn("node", F.col("f0") if lanes == 1 else F.xxhash64(*f)))
    sample = distinct.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select(*f).collect()
    return distinct, distinct.count(), np.array([tuple(r) for r in sample], np.int64).reshape(-1, lanes)


def near_groups(prints: DataFrame, max_distance: int = 3) -> DataFrame:
    """(node, root) for each distinct fingerprint ``f0`` of ``prints`` that has links; ``node`` is the fingerprint."""
    distinct, n, sample = distinct_prints(prints, 1)
    return components(links_within(distinct, plan_search(sample, n, max_distance, 64), max_distance, 1))


def allocate_gains(options: list[list[tuple[float, int]]], total: int) -> tuple[float, list[int]]:
    """(cost, one option of each list) of the least cost whose gains add up to ``total`` or more, by dynamic programming; options are (cost, gain)."""
    best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for row in options:
        step: dict[int, tuple[float, tuple | None]] = {}
        for have, (cost, picks) in best.items():
            for k, (c, gain) in enumerate(row):
                s = min(total, have + gain)
                if s not in step or cost + c < step[s][0]:
                    step[s] = (cost + c, (k, picks))
        best = step
    cost, picks = best.get(total, (math.inf, None))
    out = []
    while picks is not None:
        out.append(picks[0])
        picks = picks[1]
    return cost, out[::-1]


def plan_wide(sample: np.ndarray, n: int, similarity: float, lanes: int, recall: float = RECALL, divisions: int = 8) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed among ``n`` wide fingerprints.

    Partitions come from several divisions of the bits, one that groups
    correlated bits and fixed shuffles of them. Of a pair of the wanted
    similarity the share ``p`` of the bits differs; a partition of threshold t
    misses it with the chance that more than t of its bits differ, and the
    logarithms of these chances add up. Dynamic programming finds the thresholds
    of the least cost (as in ``plan_search``) that leave a chance of at most
    ``1 - recall``; of several widths near log2(n) the cheapest is taken.
    """
    wide, steps = 64 * lanes, 300
    bits = bit_matrix(sample) if len(sample) else np.zeros((1, wide), np.uint8)
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    p += math.sqrt(p * (1 - p) / wide)
    rng = np.random.default_rng(7)
    orders = [rng.permutation(wide) for _ in range(divisions - 1)]
    each_step = -math.log(1 - recall) / steps
    # bits that differ in random pairs of the sample
    one, other = rng.integers(0, len(bits), (2, 20 * len(bits)))
    apart = (bits[one] != bits[other])[one != other]
    scale = n * n / max(1, len(apart))
    # a partition of no bits meets every pair: the cheapest for few fingerprints
    best: tuple[float, list[tuple[list[int], int]]] = (20 * n + n * n / 2, [([], 0)])
    for width in sorted({int(min(40, max(6, math.log2(max(2, n)) + k))) for k in (-5, -3, -1, 1)}):
        count = wide // width
        groups = group_bits(bits.astype(np.float64), count)
        for order in orders:
            groups += [sorted(order[k * wide // count : (k + 1) * wide // count].tolist()) for k in range(count)]
        options = []
        for g in groups:
            w = len(g)
            seen = np.bincount(apart[:, g].sum(1), minlength=w + 1)
            row, keys, pairs, met = [(0.0, 0)], 0.0, 0.0, 0.0
            for t in range(3):
                keys += math.comb(w, t) * n
                pairs += max(seen[t] * scale, math.comb(w, t) / 2.0**w * n * n) / 2
                met += math.comb(w, t) * p**t * (1 - p) ** (w - t)
                row.append((20 * keys + pairs, int(-math.log1p(-met) / each_step)))
            options.append(row)
        cost, picks = allocate_gains(options, steps)
        if cost < best[0]:
            best = (cost, [(g, k - 1) for g, k in zip(groups, picks) if k])
    return best[1]


def shingle_sets(docs: DataFrame, wanted: DataFrame, words_each: int) -> DataFrame:
    """(node, shingles) for ``wanted (node, doc_id, text_hash)``: the distinct shingles of that document as 32-bit hashes. ``wanted`` is a written table."""
    slim = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    small = broadcast_if_small(wanted.select("node", F.col("doc_id").alias("id"), "text_hash"), 48)
    own = slim.join(small, (slim["text_hash"] == small["text_hash"]) & slim["doc_id"].eqNullSafe(small["id"])).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [np.unique((shingle_hashes(t, words_each) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["node", "shingles"])

    # rows that repeat id and text give their set again
    return materialize(map_batches(own, run, "node long, shingles array<int>").dropDuplicates(["node"]))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float, n_pairs: int) -> DataFrame:
    """The links (a, b) of ``pairs`` whose shingle sets have a Jaccard similarity of ``similarity`` or more."""
    left = hot_lookup(pairs, sets.select(F.col("node").alias("a"), F.col("shingles").alias("own")), "a", n_pairs, share=1 / 500, how="inner")
    both = hot_lookup(left, sets.select(F.col("node").alias("b"), F.col("shingles").alias("other")), "b", n_pairs, share=1 / 500, how="inner", hot=hot_nodes(pairs, "b", n_pairs))
    common = F.size(F.array_intersect("own", "other"))
    return both.where(common >= F.lit(similarity) * (F.size("own") + F.size("other") - common)).select("a", "b")


def settled_links(docs: DataFrame, nodes: DataFrame, who: DataFrame, parts: list[tuple[list[int], int]], max_distance: int, lanes: int, words_each: int, similarity: float) -> DataFrame:
    """Links (a, b) whose components are those of all pairs that the search meets within ``max_distance`` and whose similarity is ``similarity`` or more.

    First each bucket's forest of near pairs is verified; a refused pair may
    have stood for one that would hold. So where verified links leave nodes apart that
    near pairs connect, buckets hand on the nearest pairs between
    those groups, more in each round, until none is left untried. ``who (node, doc_id, text_hash)`` names each node's document.
    """
    tried = materialize(links_within(nodes, parts, max_distance, lanes))
    whole = components(tried)
    wanted = materialize(who.join(whole.select("node"), "node", "left_semi"))
    sets = shingle_sets(docs, wanted, words_each)
    near = materialize(whole.select("node", F.col("root").alias("near")))
    links = materialize(verified(tried, sets, similarity, tried.count()))
    most = NEAREST
    while True:
        # nodes that near pairs connect and links don't
        held = links.join(near.select(F.col("node").alias("a")), "a", "left_semi")
        grouped = materialize(near.join(components(held), "node", "left").select("node", "near", F.coalesce("root", "node").alias("group")))
        split = grouped.groupBy("near").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("near")
        near = materialize(grouped.join(split, "near", "left_semi"))
        if near.isEmpty():
            return links
        open_ = materialize(nodes.join(near.select("node", "group"), "node"))
        near = near.select("node", "near")
        met = materialize(links_within(open_, parts, max_distance, lanes, most))
        more = not met.where("a is null").isEmpty()
        fresh = materialize(met.where("a is not null").join(tried, ["a", "b"], "left_anti"))
        n = fresh.count()
        if n:
            tried = tried.unionByName(fresh)
            links = materialize(links.unionByName(verified(fresh, sets, similarity, n)))
        if not more:
            return links
        most *= 16


def hot_nodes(pairs: DataFrame, side: str, n: int, share: float = 1 / 500) -> list:
    return [r[0] for r in pairs.groupBy(side).count().where(F.col("count") > max(64, int(n * share))).select(side).collect()]


def components_of(docs: DataFrame, words_each: int = 3, max_distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs``.

    Null and empty texts have fingerprint zero and link like others. A null
    ``doc_id`` stays null and never names a component unless all its ids are
    null. Repeated rows give repeated results.
    """
    prints = materialize(fingerprints(docs, words_each).select("doc_id", "f0"))
    least = prints.groupBy(F.col("f0").alias("node")).agg(F.min("doc_id").alias("least"))
    rooted = least.join(near_groups(prints, max_distance), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(rooted)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = hot_lookup(rooted.select("node", "root"), named, "root", rooted.count()).select(F.col("node").alias("f0"), "component_id")
    out = hot_lookup(prints, by_node, "f0", prints.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, words_each: int = 5, similarity: float = 0.8, lanes: int = 4) -> DataFrame:
    """(doc_id, text_hash, n, stays) of each distinct document that has copies: ``n`` rows repeat it, one of its group ``stays``.

    Links: pairs that the wide search meets, whose fingerprints differ by at
    most the mean of such pairs and three standard deviations, and whose sets of
    shingles have a Jaccard similarity of ``similarity`` or more. Texts of one
    fingerprint are one node; texts without words are one.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    max_distance = math.ceil(64 * lanes * p + 3 * math.sqrt(64 * lanes * p * (1 - p)))
    f = [f"f{k}" for k in range(lanes)]
    prints = materialize(fingerprints(docs, words_each, lanes, distinct=True).withColumn("node", F.xxhash64(*f)))
    nodes, n, sample = distinct_prints(prints, lanes)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    least = materialize(prints.groupBy("node").agg(F.min(key).alias("least")))
    who = least.select("node", "least.doc_id", "least.text_hash")
    links = settled_links(docs, nodes, who, plan_wide(sample, n, similarity, lanes), max_distance, lanes, words_each, similarity)
    rooted = materialize(least.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")))
    kept = rooted.groupBy("root").agg(F.min("least").alias("kept"))
    by_node = materialize(hot_lookup(rooted.select("node", "root"), materialize(kept), "root", rooted.count()).select("node", "kept"))
    each = materialize(prints.groupBy("node", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")))
    fate = hot_lookup(each, by_node, "node", each.count()).withColumn("stays", key.eqNullSafe(F.col("kept")))
    return materialize(fate.where("n > 1 or not stays").select("doc_id", "text_hash", "n", "stays"))


def drop_near_copies(docs: DataFrame, words_each: int = 5, similarity: float = 0.8, lanes: int = 4) -> DataFrame:
    """``docs`` without near copies: of each group the row with the smallest (doc_id, text hash) stays.

    Groups are the components of links of ``near_copies``. Empty texts form
    one group. Rows that repeat id and text are one document, of which one row
    stays. Only rows of documents with copies are joined or compared again.
    """
    own, other, id_, n, stays, tie = free_names(docs.columns, "own", "other", "id", "n", "stays", "tie")
    fate = near_copies(docs, words_each, similarity, lanes).toDF(id_, other, n, stays)
    left = docs.withColumn(own, F.xxhash64(text_of()))
    joined = left.join(broadcast_if_small(fate, 48), (F.col(own) == F.col(other)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left")
    names = [F.col(f"`{c}`") for c in docs.columns]
    single = joined.where(F.col(stays).isNull()).select(*names)
    # of rows that repeat a document one is kept, whatever types the other columns have
    again = materialize(joined.where(F.col(stays)).select(*names, own, F.monotonically_increasing_id().alias(tie)))
    first = again.groupBy("doc_id", own).agg(F.min(tie).alias(tie)).select(tie)
    return single.unionByName(again.join(first, tie, "left_semi").select(*names))


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "documents"))
