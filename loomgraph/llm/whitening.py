"""Embedding whitening by matrix-free block Lanczos.

Entries become integers (``floor(64 * c) + 1000000``). The fit list is each
distinct integer vector once. Its covariance V is never formed: a pass over the
written fit list centres the vectors and multiplies them with a block of
directions, ``Xᵀ(X B) / n``, one partial product for each task, summed by Spark.
The driver holds directions and products only, at most as many as there are
dimensions, whatever the number of rows.

The basis is orthogonalised in full, twice, against all former blocks. Where a
new block has lost rank (a breakdown: the space so far is closed under V) the
lost columns restart from random directions outside of it. Ritz pairs count
as converged by their residuals. The trace of V comes from the rows' squared
deviations, not from eigenvalues.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, materialize, table

COMPONENTS, BLOCK = 16, 16
SCALE, SHIFT = 64, 1_000_000
#: Residuals in terms of the largest eigenvalue: enough; and enough where a further pass no longer halves them.
CONVERGED, STALLED = 1e-14, 1e-10
#: Columns of a new block that keep less than this share of their length are taken for lost.
BREAKDOWN = 1e-10
#: Eigenvalues below this share of the largest count as zero: doubles can't tell their directions from rounding.
ZERO = 1e-12


def integer_rows(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, integer vectors as rows) for each length of vectors in a batch.

    Null and empty vectors and those with null or non-finite entries are left
    out, as are entries whose integer a long can't hold.
    """
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        # nulls become NaN
        entries = np.asarray(pc.cast(vectors.take(pa.array(at)).flatten(), pa.float64()).to_numpy(zero_copy_only=False)).reshape(-1, d)
        whole = np.floor(SCALE * entries)
        good = (np.abs(whole) < 2.0**62).all(1)
        yield at[good], whole[good].astype(np.int64) + SHIFT


def _lists(rows: np.ndarray) -> pa.ListArray:
    k, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * d), pa.array(rows.ravel()))


def distinct_vectors(df: DataFrame, vector: str) -> DataFrame:
    """``x``: each distinct integer vector once. Copies are put together before the shuffle, so a vector that fills a third of all rows is no hot key."""

    def run(batches):
        for batch in batches:
            for _, x in integer_rows(batch.column(0)):
                yield pa.RecordBatch.from_arrays([_lists(x)], names=["x"])

    return map_batches(df.select(F.col(vector).cast("array<double>")), run, "x array<long>").distinct()


def _sums(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all rows of the fit list of ``part(rows)``, an array of one shape: a task adds up its own, Spark adds up the tasks' by cell."""

    def run(batches):
        total = None
        for batch in batches:
            x = batch.column(0)
            if len(x):
                own = part(x.flatten().to_numpy().reshape(len(x), -1)).ravel()
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["cell", "value"])

    cells = map_batches(fit.select("x"), run, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.empty(len(cells), np.int64 if kind == "long" else np.float64)
    out[[r.cell for r in cells]] = [r.value for r in cells]
    return out


def square_sums(y: np.ndarray) -> list[int]:
    """For each row the exact sum of its squared integers, of any size."""
    most = int(np.abs(y).max(initial=0))
    if y.dtype != object and most * most * y.shape[1] < 2**63:
        return np.einsum("ij,ij->i", y, y).tolist()
    if y.dtype != object and most < 2**52 and y.shape[1] <= 1024:
        a, b = y >> 26, y & (2**26 - 1)
        return [(p << 52) + (q << 27) + r for p, q, r in zip(*(np.einsum("ij,ij->i", u, v).tolist() for u, v in ((a, a), (a, b), (b, b))))]
    return [sum(v * v for v in row) for row in y.tolist()]


@dataclass
class Whitening:
    """``n`` vectors of the fit list and their ``sums`` by dimension; ``directions`` as columns, with eigenvalues ``values``; ``trace`` of V; ``identity_error`` of the whitened fit list."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    def __post_init__(self) -> None:
        # sums = n * mean + rest, so that x - mean and rest / n, which is under 1, take no large number from another
        self.mean, self.rest = np.divmod(self.sums, self.n)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums over dimensions of (n x - S)²."""
        off = x - self.mean
        if (int(np.abs(off).max(initial=0)) + 1) * self.n >= 2**63:
            off = off.astype(object)
        return square_sums(off * self.n - self.rest)


def block_lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix of size ``d``, falling, and their unit vectors as columns; ``apply`` multiplies it with a block of columns."""
    rng = np.random.default_rng(seed)
    q, aq = np.empty((d, 0)), np.empty((d, 0))
    fresh = np.linalg.qr(rng.normal(size=(d, min(block, d))))[0]
    before = np.inf
    while True:
        w = apply(fresh)
        q, aq = np.hstack((q, fresh)), np.hstack((aq, w))
        t = q.T @ aq
        theta, s = np.linalg.eigh((t + t.T) / 2)
        top = np.argsort(-theta)[:k]
        theta, vectors = theta[top], q @ s[:, top]
        if q.shape[1] == d:
            break
        residual = np.linalg.norm(aq @ s[:, top] - vectors * theta, axis=0).max() / max(theta[0], np.finfo(float).tiny)
        if len(top) == k and (residual <= CONVERGED or before / 2 < residual <= STALLED):
            break
        before = residual
        size = np.linalg.norm(w, axis=0).max()
        for _ in range(2):
            w = w - q @ (q.T @ w)
        u, kept, _ = np.linalg.svd(w, full_matrices=False)
        width = min(block, d - q.shape[1])
        fresh = u[:, kept > BREAKDOWN * size][:, :width] if size > 0 else u[:, :0]
        # a breakdown: the columns that are lost start anew
        fresh = np.hstack((fresh, rng.normal(size=(d, width - fresh.shape[1]))))
        for _ in range(2):
            fresh = np.linalg.qr(fresh - q @ (q.T @ fresh))[0]
    vectors /= np.linalg.norm(vectors, axis=0)
    return theta, vectors


def fit_whitening(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fits on the distinct integer vectors of ``df[vector]``; None where there is none.

    Vectors of another length than most distinct ones have (ties: the shorter)
    are left out. Components are at most the rank of V, so none where all
    vectors are equal.
    """
    every = materialize(distinct_vectors(df, vector))
    sizes = every.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return None
    d, n = sizes
    fit = every.where(F.size("x") == d)
    start = Whitening(n, _sums(fit, lambda x: x.sum(0), "long"), np.empty((d, 0)), np.empty(0), 0.0, 0.0)
    trace = _sums(fit, lambda x: np.array([sum(start.deviations(x)) / n / n]))[0] / n

    def apply(b: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = start.centred(x)
            return y.T @ (y @ b)

        return _sums(fit, part).reshape(b.shape) / n

    if trace == 0:
        return start
    theta, vectors = block_lanczos(apply, d, min(components, d))
    vectors = vectors[:, theta > ZERO * theta[0]]
    # the sign whose largest entry is positive
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    k = vectors.shape[1]

    def moments(x: np.ndarray) -> np.ndarray:
        y = start.centred(x) @ vectors
        return np.concatenate(((y.T @ y).ravel(), y.sum(0)))

    sums = _sums(fit, moments) / n
    # variances along the directions: as eigenvalues they are more exact than Ritz values where small
    covariance = sums[: k * k].reshape(k, k) - np.outer(sums[k * k :], sums[k * k :])
    values = np.diag(covariance).copy()
    error = np.abs(covariance / np.sqrt(np.outer(values, values)) - np.eye(k)).max()
    return Whitening(n, start.sums, vectors, values, trace, float(error))


FIELDS = [T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))]


def whiten(df: DataFrame, fit: Whitening | None, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``deviation`` and ``whitened``, one entry for each component, of all rows whose vector has finite entries and the fit's length.

    Copies of a row are whitened each. Other rows are left out; without a fit
    all are. Columns of these names are replaced.
    """
    added = {f.name for f in FIELDS}
    names = [c for c in (keep if keep is not None else df.columns) if c.lower() not in added]
    source = df.select(*[F.col(f"`{c}`") for c in names], F.col(vector).cast("array<double>").alias("__vector"))
    schema = T.StructType(source.schema.fields[:-1] + FIELDS)
    if fit is None:
        return source.where("false").select(*names, *[F.lit(None).cast(f.dataType).alias(f.name) for f in FIELDS])
    scaled = fit.directions / np.sqrt(fit.values)

    def run(batches):
        for batch in batches:
            k = batch.num_columns - 1
            for at, x in integer_rows(batch.column(k)):
                if x.shape[1] != len(fit.sums):
                    continue
                rows = batch.take(pa.array(at))
                deviations = pa.array([Decimal(v) for v in fit.deviations(x)], pa.decimal128(38, 0))
                w = fit.centred(x) @ scaled
                yield pa.RecordBatch.from_arrays([*rows.columns[:k], deviations, _lists(w)], names=[*batch.schema.names[:k], "deviation", "whitened"])

    return map_batches(source, run, schema)


def op11_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component. ``deviation`` is null where a long can't hold it; ``whiten`` gives it as a decimal."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fit = fit_whitening(vectors)
    rows = whiten(vectors, fit, keep=["vec_id"]).select("vec_id", F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(v / fit.trace)) for v in fit.values]) if fit is not None and len(fit.values) else F.array(F.lit(None).cast("double"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(fit.n if fit else None).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(fit.identity_error if fit else None).cast("double").alias("identity_error"),
    )
