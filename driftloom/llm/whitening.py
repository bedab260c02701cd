"""Whitening of embeddings by matrix-free block Lanczos.

Entries become whole numbers x = floor(64 c) + 1000000; sums of them, and so the deviations and the trace, are exact. The covariance V is
never formed: a pass over the vectors gives V B for a block B of a few columns, as the sum over tasks of Xc' (Xc B) with
Xc the centred vectors. Each step multiplies the newest block, takes out what lies along the whole basis (twice: full reorthogonalisation),
and keeps the projection of V on the basis, whose eigenpairs (Ritz pairs) approach V's largest.

* breakdown   where nothing is left of a column, the space that the block spans is invariant; a random column that is orthogonal to the basis
              takes its place, so that eigenvalues of any multiplicity are found.
* convergence a Ritz pair's residual is the norm of what V adds to it outside the basis. When those of all wanted components are below
              `tolerance` of the largest, one more random block is taken in (a start may miss copies of an eigenvalue); if the wanted
              values then stay, or the basis is the whole space, it ends.

The driver holds basis and projection, of d rows and at most d columns, whatever the number of vectors; each task returns d times
block numbers for a pass, which Spark adds up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

SCALE, SHIFT = 64, 1_000_000


def scaled(rows: DataFrame) -> DataFrame:
    """vec_id, x (array<long>: floor(64 c); the shift is left out, as centring takes it away): rows without null or non-finite entries."""
    c = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(fine).select("vec_id", F.transform(c, lambda v: F.floor(v * SCALE)).alias("x"))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def added(x: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum over all vectors of part(rows), a matrix of `shape` for any rows: each task adds its own up, Spark adds the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for piece in slices([batch], 4096, 16 << 20):
                total += part(matrix(piece))
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(total.size), pa.int32()), "v": pa.array(total.ravel())})

    got = x.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(shape)
    for r in got:
        out.flat[r["i"]] = r["v"]
    return out


def orthogonal(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal columns for the block beside the basis, and the norms of what its columns had left. Columns of which nothing is
    left are random ones, as far as the space has room."""
    out, left = basis, []
    for k in range(block.shape[1]):
        if out.shape[1] == out.shape[0]:
            break
        v = block[:, k]
        for _ in range(2):
            v = v - out @ (out.T @ v)
        norm = float(np.linalg.norm(v))
        left.append(norm)
        if norm <= 1e-12 * scale:
            v = rng.normal(size=len(v))
            for _ in range(3):
                v = v - out @ (out.T @ v)
            norm = float(np.linalg.norm(v))
        out = np.column_stack((out, v / norm))
        out[:, -1] -= out[:, :-1] @ (out[:, :-1].T @ out[:, -1])
        out[:, -1] /= np.linalg.norm(out[:, -1])
    return out[:, basis.shape[1] :], np.array(left)


def leading(multiply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int = 16, tolerance: float = 1e-13, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """The largest `wanted` eigenvalues of a symmetric non-negative d by d matrix, falling, their unit eigenvectors (columns),
    and the number of passes. multiply(B) is the matrix times B."""
    rng, wanted = np.random.default_rng(seed), min(wanted, d)
    basis, image, passes, settled = np.zeros((d, 0)), np.zeros((d, 0)), 0, None
    new, _ = orthogonal(rng.normal(size=(d, min(block, d))), basis, 1.0, rng)
    while True:
        basis = np.column_stack((basis, new))
        image = np.column_stack((image, multiply(new)))
        passes += 1
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        scale = max(abs(values[0]), np.finfo(float).tiny)
        if basis.shape[1] == d:
            break
        residual = np.linalg.norm((image - basis @ small) @ turn[:, :wanted], axis=0)
        if basis.shape[1] >= wanted and (residual <= tolerance * scale).all():
            if settled is not None and np.abs(values[:wanted] - settled).max() <= 1e-12 * scale:
                break
            settled = values[:wanted].copy()
            new, _ = orthogonal(rng.normal(size=(d, min(block, d - basis.shape[1]))), basis, 1.0, rng)
        else:
            new, _ = orthogonal(image[:, -new.shape[1] :], basis, scale, rng)
    vectors = basis @ turn[:, :wanted]
    return values[:wanted], vectors / np.linalg.norm(vectors, axis=0), passes


WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, components: int = 32, block: int = 16) -> DataFrame:
    """Returns for each remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or empty, or holds a null or non-finite entry, go; so do those whose length isn't the one that most rows
    have (the larger of equals). All others are the fit list and count each, whether they repeat a vec_id or lack it (null). Components whose eigenvalue is below 1e-12 of the
    largest have no whitened value: there are fewer than `components` then, or fewer dimensions; where all
    vectors are equal, or there are none, no rows come out. deviation is exact; one that doesn't fit a long is an error. Columns other than vec_id and embedding
    play no part."""
    every = scaled(rows).withColumn("dim", F.size("x"))
    lengths = every.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    empty = rows.sparkSession.createDataFrame([], WHITE)
    if not lengths:
        return empty
    d, n = lengths[0]["dim"], lengths[0]["count"]
    # each pass reads the whole numbers only, from a table in the shared folder
    x = materialise(every.filter(F.col("dim") == d).select("vec_id", "x"), "scaled")
    sums = x.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")).orderBy("i").collect()
    s = [int(r["s"]) for r in sums]
    # n x - S, in whole numbers
    far = F.zip_with("x", F.array(*[F.lit(v).cast("long") for v in s]), lambda a, b: a * F.lit(n).cast("long") - b)
    x = materialise(x.select("vec_id", "x", F.aggregate(far, F.lit(0).cast("long"), lambda t, v: t + v * v).alias("deviation")), "deviations")
    trace = float(int(x.agg(F.sum(F.col("deviation").cast("decimal(38,0)")).alias("t")).first()["t"])) / n / n / n
    if not trace:
        return empty
    mean = np.array([v / n for v in s])
    e, u, _ = leading(lambda b: added(x, lambda m: (m - mean).T @ ((m - mean) @ b), (d, b.shape[1])) / n, d, components, block)
    fit = e > 1e-12 * e[0]
    e, u = e[fit], u[:, fit]
    k, turn = len(e), u / np.sqrt(e)
    project = lambda m: (m - mean) @ turn
    centre = added(x, lambda m: project(m).sum(0, keepdims=True), (1, k)) / n
    error = float(np.abs(added(x, lambda m: (project(m) - centre).T @ (project(m) - centre), (k, k)) / n - np.eye(k)).max())
    explained = e / trace

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices([batch], 4096, 16 << 20):
                m, w = piece.num_rows, project(matrix(piece))
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([piece.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()), piece.column("deviation").take(each), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(give, WHITE)
