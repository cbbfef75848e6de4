import math
from fractions import Fraction

import numpy as np
import pytest

from loomgraph.llm import whitening
from loomgraph.llm.common import table


def plain(vectors, k=16):
    """{place: (deviation, whitened)}, eigenvalue shares; all by formulas, with integers and one dense decomposition."""
    whole = {}
    for i, v in enumerate(vectors):
        if v and all(c is not None and math.isfinite(c) for c in v):
            whole[i] = tuple(math.floor(64 * c) + 1_000_000 for c in v)
    sizes = [len(x) for x in set(whole.values())]
    if not sizes:
        return {}, [], 0
    d = min(set(sizes), key=lambda s: (-sizes.count(s), s))
    whole = {i: x for i, x in whole.items() if len(x) == d}
    distinct = sorted(set(whole.values()))
    n = len(distinct)
    sums = [sum(col) for col in zip(*distinct)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in distinct])
    e, p = np.linalg.eigh(centred.T @ centred / n)
    e, p = e[::-1][:k], p[:, ::-1][:, :k]
    rank = int((e > 1e-12 * e[0]).sum()) if e[0] > 0 else 0
    e, p = e[:rank], p[:, :rank]
    out = {}
    for i, x in whole.items():
        y = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        out[i] = (sum((n * a - s) ** 2 for a, s in zip(x, sums)), y @ p / np.sqrt(e))
    total = sum(out[i][0] for i in {x: i for i, x in whole.items()}.values())
    return out, [float(v / float(Fraction(total, n**3))) for v in e], n


def hold(rows, vectors, rel=1e-8):
    want, shares, n = plain(vectors)
    got = {}
    for r in rows:
        assert r.n == n and r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)
        assert r.deviation == want[r.vec_id][0] and 0 <= r.identity_error < 1e-9
        got.setdefault(r.vec_id, {})[r.component] = r.whitened
    assert set(got) == (set(want) if shares else set()) and all(sorted(g) == list(range(1, len(shares) + 1)) for g in got.values())
    if got:
        a = np.array([[got[i][c + 1] for c in range(len(shares))] for i in sorted(got)])
        b = np.array([want[i][1] for i in sorted(got)])
        sign = np.sign((a * b).sum(0))
        assert np.abs(a - b * sign).max() < rel * np.abs(b).max()


def query(spark, monkeypatch, vectors):
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    monkeypatch.setattr(whitening, "table", lambda *_: df)
    return whitening.op11_lanczos_whitening(spark, "").collect()


def test_query_against_dense_decomposition(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding").collect()
    assert [r.vec_id for r in rows] == list(range(len(rows)))
    hold(whitening.op11_lanczos_whitening(spark, sf).collect(), [r.embedding for r in rows])


def test_odd_vectors(spark, monkeypatch):
    """Nulls, nulls and non-finite entries within, other lengths, entries beyond a long, copies (also such that differ by less than a step), and ties."""
    rng = np.random.default_rng(1)
    vectors = [v.tolist() for v in rng.normal(size=(60, 5)) * [5, 3, 2, 1, 0.5]]
    vectors += [None, [], [1.0, None, 2.0, 3.0, 4.0], [math.nan] * 5, [math.inf, 0, 0, 0, 0], [1.0, 2.0], [1e300, 0, 0, 0, 0]]
    vectors += vectors[:3] * 50 + [[0.001] * 5, [0.002] * 5, [-0.001] * 5]
    vectors = [v if v is None else [None if c is None else float(c) for c in v] for v in vectors]
    far = vectors.index([1e300, 0.0, 0.0, 0.0, 0.0])
    rows = query(spark, monkeypatch, vectors)
    assert far not in {r.vec_id for r in rows}
    # an entry whose integer no long holds counts as not finite
    hold(rows, [[math.inf] if i == far else v for i, v in enumerate(vectors)])


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [[float(i), 2.0 * i, 7.0] for i in range(9)], [[float(i % 2), float(i // 2)] for i in range(4)]], ids=["empty", "null", "one", "copies", "rank one", "equal eigenvalues"])
def test_few_vectors(spark, monkeypatch, vectors):
    rows = query(spark, monkeypatch, vectors)
    if len(vectors) == 4:
        assert len(rows) == 8 and all(r.explained == pytest.approx(0.5) and r.deviation == 8 * 32**2 * 4 for r in rows)
    else:
        hold(rows, vectors)


def test_extra_columns_and_types(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i)], "a", 1.0, {"k": i}) for i in range(20)], "id int, v array<float>, deviation string, Whitened double, m map<string,int>")
    out = whitening.whiten(df, whitening.fit_whitening(df, "v"), "v")
    assert out.columns == ["id", "v", "m", "deviation", "whitened"] and all(len(r.whitened) == 2 and r.m == {"k": r.id} for r in out.collect())


def test_lanczos_on_many_dimensions():
    """Fewer passes than dimensions, against a dense decomposition; equal eigenvalues and a space closed after the first block."""
    rng = np.random.default_rng(2)
    p = np.linalg.qr(rng.normal(size=(300, 300)))[0]
    passes = []
    for values in (2.0 ** -np.arange(300) * 1e3, np.r_[np.repeat(5.0, 8), np.linspace(1, 2, 292)], np.r_[np.repeat(3.0, 4), np.zeros(296)], np.zeros(300), np.r_[np.linspace(9, 10, 40), np.zeros(260)]):
        a = (p * values) @ p.T
        n = [0]

        def apply(b, a=a, n=n):
            n[0] += 1
            return a @ b

        theta, vectors = whitening.block_lanczos(apply, 300, 16)
        passes.append(n[0])
        assert np.allclose(theta, np.sort(values)[::-1][:16], rtol=0, atol=1e-12 * max(values.max(), 1))
        assert np.allclose(vectors.T @ vectors, np.eye(16), atol=1e-12) and np.abs(a @ vectors - vectors * theta).max() <= 1e-11 * max(values.max(), 1)
    assert passes[0] <= 8 and passes[2] <= 4


def test_square_sums_of_any_size():
    rng = np.random.default_rng(3)
    for bits in (10, 30, 45, 51, 55, 62):
        y = rng.integers(-(2**bits), 2**bits, (20, 64))
        assert whitening.square_sums(y) == [sum(int(v) ** 2 for v in row) for row in y]
    big = np.array([[2**80, -(2**70)]], object)
    assert whitening.square_sums(big) == [2**160 + 2**140]


def test_deviations_beyond_a_long(spark):
    fit = whitening.Whitening(10**9, np.array([10**15 + 7, 10**15]), np.empty((2, 0)), np.empty(0), 0.0, 0.0)
    x = np.array([[10**6 + 300, 10**6 - 5], [2**50, 0]])
    assert fit.deviations(x) == [sum((10**9 * int(a) - s) ** 2 for a, s in zip(row, fit.sums.tolist())) for row in x]
