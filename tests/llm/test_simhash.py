import random
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import simhash
from loomgraph.llm.common import components, table


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_against_brute_force(spark, sf):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2_simhash_components(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    prints = {d: simhash.fingerprint(t or "")[0] & (2**64 - 1) for d, t in docs.items()}
    ids = sorted(prints)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = groups(links, ids)
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in ids}


def test_search_finds_every_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63, 60)
    fps = set(int(x) for x in base)
    for x in base:
        for _ in range(30):
            y = int(x)
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                y ^= 1 << int(b) if b < 63 else -(1 << 63)
            fps.add(y)
    fps = sorted(fps)
    prints = spark.createDataFrame([(f,) for f in fps], "f0 long")
    got = {r.node: r.root for r in simhash.near_groups(prints).collect()}
    u = np.array(fps, np.int64).view(np.uint64)
    links = [(fps[i], fps[j + i + 1]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 3)]
    want = groups(links, fps)
    assert {f: got.get(f, f) for f in fps} == want


def test_allocation_is_best():
    costs = [[0, 5, 9, 20], [0, 1, 2, 3], [0, 7, 8, 9]]
    picks = simhash.allocate(costs, 1)
    assert sum(picks) == 1
    from itertools import product

    best = min(sum(c[t + 1] for c, t in zip(costs, p)) for p in product(range(-1, 3), repeat=3) if sum(p) == 1)
    assert sum(c[t + 1] for c, t in zip(costs, picks)) == best


def test_one_star_and_chains(spark):
    links = [(i, i + 1) for i in range(50)] + [(1000, 1000 + k) for k in range(1, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[1000 + k] == 1000 for k in range(200))


def test_odd_rows(spark, odd, empty):
    rows = simhash.components_of(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[2].component_id == 1
    assert by[3].fingerprint == by[4].fingerprint == by[8].fingerprint == "0" * 16 and by[4].component_id == 3
    assert simhash.components_of(empty).count() == 0
    left = simhash.drop_near_copies(odd)
    assert left.columns == odd.columns
    kept = [r.doc_id for r in left.collect()]
    assert sorted(k for k in kept if k is not None) == [1, 3, 5, 6, 7] and None in kept
    assert simhash.drop_near_copies(empty).count() == 0


@pytest.mark.parametrize("changed, together", [(3, True), (150, False)])
def test_near_copies(spark, changed, together):
    rng = np.random.default_rng(changed)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 300)]
    other = list(words)
    for i in rng.choice(300, changed, replace=False):
        other[i] = "changed"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    assert simhash.drop_near_copies(docs).count() == (1 if together else 2)


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_copies_of_similarity_above_the_threshold_go(spark):
    rng = np.random.default_rng(21)
    rows, similar = [], {}
    for i in range(300):
        words = [f"w{x}" for x in rng.integers(0, 10**6, rng.integers(80, 600))]
        copy = list(words)
        for j in rng.choice(len(words), int(len(words) * rng.uniform(0.001, 0.04)), replace=False):
            copy[j] = f"c{rng.integers(0, 10**6)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        similar[i] = jaccard(rows[-2][1], rows[-1][1])
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).select("doc_id").collect()}
    assert all(2 * i in kept for i in similar)
    near = [i for i, s in similar.items() if s >= 0.8]
    assert len(near) > 100 and sum(2 * i + 1 not in kept for i in near) >= 0.97 * len(near)
    assert all(2 * i + 1 in kept for i, s in similar.items() if s < 0.8)


def test_forest_of_least_weight():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n, m = 12, 25
        l, r, d = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 6, m)
        got = simhash.spanning_forest(l, r, d, n)
        label, weight, size = list(range(n)), 0, 0
        for i in np.lexsort((r, l, d)):
            a, b = label[l[i]], label[r[i]]
            if a != b:
                label, weight, size = [a if x == b else x for x in label], weight + d[i], size + 1
        assert len(got) == size and d[got].sum() == weight


def test_gains_against_all_choices():
    from itertools import product

    options = [[(0, 0), (3, 2), (5, 4)], [(0, 0), (2, 1), (9, 6)], [(0, 0), (4, 3)]]
    cost, picks = simhash.allocate_gains(options, 5)
    want = min(sum(o[k][0] for o, k in zip(options, ks)) for ks in product(range(3), range(3), range(2)) if sum(o[k][1] for o, k in zip(options, ks)) >= 5)
    assert cost == want == sum(o[k][0] for o, k in zip(options, picks))


def test_large_buckets_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(2)
    fps = sorted({int(x) for x in np.int64(12345) ^ (np.int64(1) << rng.integers(0, 60, (400, 3))).sum(1)})
    got = {r.node: r.root for r in simhash.near_groups(spark.createDataFrame([(f,) for f in fps], "f0 long")).collect()}
    links = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3]
    want = groups(links, fps)
    assert {f: got.get(f, f) for f in fps} == want


def test_lines_said_often_are_no_similarity(spark):
    line = "the same line is said again and again here. " * 400
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(i, line + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 100))) for i in range(2)], "doc_id long, text string")
    assert simhash.drop_near_copies(docs).count() == 2


def family_texts(seed, families, least, most):
    """Edited copies of a text of 200 words each: pairs of them lie on either side of 0.8."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=7))
    out = []
    for _ in range(families):
        base = [word() for _ in range(200)]
        for _ in range(r.randint(least, most)):
            own = list(base)
            for _ in range(r.choice([0, 1, 2, 2, 3, 3])):
                own[r.randrange(200)] = word()
            out.append(" ".join(own))
    r.shuffle(out)
    return out


def plain_groups(texts):
    """The place of each text's group, by all pairs of shingle sets of a family."""
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in where[x] if j < i)
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("families,least,most", [(6, 50, 90), (60, 4, 14)])
def test_dense_families_lose_no_links(spark, families, least, most):
    """At two sizes of the corpus, for large and for small families: of the documents that should go at least 95 % do, and no other."""
    texts = family_texts(families, families, least, most)
    group = plain_groups(texts)
    should_go = {i for i, g in enumerate(group) if g != i}
    others = [(10_000 + k, " ".join(f"w{k}x{j}" for j in range(40))) for k in range(3000 if families == 6 else 0)]
    df = spark.createDataFrame([*enumerate(texts), *others], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_copies(df).select("doc_id").collect()}
    gone = set(range(len(texts))) - kept
    assert not gone - should_go and kept >= {d for d, _ in others}
    assert len(gone) >= 0.95 * len(should_go) and len(should_go) > 100


def test_nearest_open_pairs():
    r = np.random.default_rng(6)
    n = 40
    i, j = np.triu_indices(n, 1)
    d, group = r.integers(0, 9, len(i)), r.integers(0, 6, n)
    for most in (1, 3, 100):
        kept, more = simhash.nearest_open(i, j, d, group, most)
        open_ = [k for k in range(len(i)) if group[i[k]] != group[j[k]]]
        assert set(kept) <= set(open_) and more == (len(kept) < len(open_))
        for x in range(n):
            own = sorted(d[k] for k in open_ if x in (i[k], j[k]))
            got = sorted(d[k] for k in kept if x in (i[k], j[k]))
            # the nearest are among them
            assert got[: min(most, len(own))] == own[: min(most, len(own))]
    assert len(simhash.nearest_open(i[:0], j[:0], d[:0], group, 3)[0]) == 0
