"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The rows x - S/n form a matrix X of n rows that nothing ever holds whole. Short blocks of right
vectors V live on the driver, long left ones U stay distributed: a column of U is X p for a
short p, so a worker makes its part of U from its rows and p whenever it needs it. A step
is one pass: every task multiplies its rows by the new vectors (Xv), takes the inner products
with all earlier columns of U and with each other, and multiplies back (Xᵀu). Only these small
sums leave a task. Both sides are orthogonalised against all earlier vectors. The singular
values of the small bidiagonal matrix give deviations, its right vectors the components.

V and U grow by blocks of `WIDTH` vectors, so the matrix is bidiagonal in blocks; a width of 1
is the plain form. Blocks cut the number of passes by their width, and they find eigenvalues
that occur several times, which a single start vector cannot. Passes end when the wanted
components have converged to rounding, at the latest once V spans the whole space.

Defined results
* rows whose vector is null, empty, holds null or non-finite entries, or has another length
  than most (ties: the least) take no part and give no rows. Zero vectors take part.
* rows of one id each count and each give their rows; a null id is kept. Empty table: no rows.
* components of no deviation (fewer rows or dimensions than components, constant columns) are
  left out, as nothing can be divided by their deviation; a single row gives no rows.
* numbers that do not fit a long (x, n x - S, deviation) raise an error instead of wrapping.
* extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skeinworks.llm.vectors import dimension
from skeinworks.session import reach_workers, stored

#: Components, vectors of a block, and what counts as converged or as no deviation at all.
COMPONENTS, WIDTH, DONE, NOTHING = 8, 8, 1e-14, 1e-12
SCALE, SHIFT = 1024, 100_000
LIMIT = 2.0**63


def scaled(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """key, x (array of long) of the rows that take part, stored; and their length."""
    ok = rows.select(F.col(key).alias("key"), F.col(vector).alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    dim = dimension(ok, "v")
    whole = F.transform("v", lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    fits = F.forall("v", lambda c: F.abs(c.cast("double") * SCALE) < LIMIT / 2)
    checked = F.when(fits, whole).otherwise(F.raise_error(F.lit("an entry is too large for a long")))
    return stored(ok.where(F.size("v") == dim).select("key", checked.alias("x")), "whitening"), dim


def blocks(batches, dim: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about a million numbers."""
    rows = max(1, (1 << 20) // dim)
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def summed(rows: DataFrame, dim: int, work: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all tasks of what `work` makes of each batch's x, a flat array of a length
    that is the same for all: no more than that leaves a task, and no more reaches the driver."""

    def run(batches):
        total = None
        for b in blocks(batches, dim):
            got = work(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "value"])

    parts = rows.select("x").mapInArrow(run, f"at int, value {kind}")
    got = parts.groupBy("at").agg(F.sum("value").alias("value")).toPandas().sort_values("at")
    return got["value"].to_numpy()


def totals(rows: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """The number of rows and the exact sum of every dimension."""

    def work(x: np.ndarray) -> np.ndarray:
        if np.abs(x).astype(float).sum(0).max() >= LIMIT:
            raise OverflowError("a sum is too large for a long")
        return np.concatenate([[len(x)], x.sum(0)])

    got = summed(rows, dim, work, "long")
    return (int(got[0]), got[1:].astype(np.int64)) if len(got) else (0, np.zeros(dim, np.int64))


class Centred:
    """Rows about their mean; n x - S in whole numbers, so that no digit of a mean is lost."""

    def __init__(self, n: int, total: np.ndarray) -> None:
        self.n, self.total = n, total

    def whole(self, x: np.ndarray) -> np.ndarray:
        if len(x) and self.n * max(float(x.max()), -float(x.min())) >= LIMIT / 2:
            raise OverflowError("n x - S is too large for a long")
        return self.n * x - self.total

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.whole(x) / self.n


def orthonormal(y: np.ndarray, against: np.ndarray, width: int, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """q, r: orthonormal columns, orthogonal to those of `against`, with y - against (againstᵀ y)
    = q r up to rounding. Directions of y that vanish give way to random ones, with zero rows in
    r, as long as the space has room for them."""
    for _ in range(2):
        y = y - against @ (against.T @ y)
    left, s, right = np.linalg.svd(y, full_matrices=False)
    keep = s > NOTHING * scale
    q, r = left[:, keep], s[keep, None] * right[keep]
    for _ in range(2):
        q = q - against @ (against.T @ q)
        q, change = np.linalg.qr(q)
        r = change @ r
    more = min(width, len(y) - against.shape[1]) - q.shape[1]
    if more > 0:
        known = np.hstack([against, q])
        z = rng.normal(size=(len(y), more))
        for _ in range(2):
            z = np.linalg.qr(z - known @ (known.T @ z))[0]
        q, r = np.hstack([q, z]), np.vstack([r, np.zeros((more, r.shape[1]))])
    return q, r


def bidiagonalise(rows: DataFrame, dim: int, centred: Centred, wanted: int = COMPONENTS, width: int = WIDTH, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The greatest singular values of the centred rows and their right vectors, as columns:
    `wanted` at most, fewer where the others are nothing beside the first."""
    rng = np.random.default_rng(seed)
    width, none = max(1, min(width, dim)), np.zeros((dim, 0))
    v, beta = orthonormal(none, none, width, 1.0, rng)  # beta: what couples v with the U before it
    v_all, p_all, z_all, upper, scale = none, none, none, np.zeros((0, 0)), 0.0  # U = X p, z = Xᵀ U
    while True:
        v_all = np.hstack([v_all, v])
        # X v without what earlier columns of U hold of it
        y, z, gain = _left(rows, dim, centred, v - p_all[:, p_all.shape[1] - beta.shape[1] :] @ beta.T, p_all, z_all, scale)
        scale = max(scale, np.linalg.norm(gain, 2) if gain.size else 0.0)
        r, c = upper.shape
        upper = np.pad(upper, ((0, len(gain)), (0, v.shape[1])))
        upper[r - beta.shape[1] : r, c:], upper[r:, c:] = beta.T, gain
        p_all, z_all = np.hstack([p_all, y]), np.hstack([z_all, z])
        # Xᵀ u without what earlier columns of V hold of it
        v, beta = orthonormal(z, v_all, width, scale, rng)
        left, s, right = np.linalg.svd(upper, full_matrices=False)
        rest = beta @ left[r:, :wanted]
        full = len(s) >= wanted and len(gain) == width
        if not v.shape[1] or full and np.abs(rest).max() <= DONE * scale:
            some = np.flatnonzero(s[:wanted] > NOTHING * scale)
            return s[some], v_all @ right.T[:, some]


def _left(rows: DataFrame, dim: int, centred: Centred, y: np.ndarray, p: np.ndarray, z_of_p: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, z, gain: X y with orthonormal columns, orthogonal to those of X p, z = Xᵀ X y, and
    X (y as it was) = X y gain but for what X p held of it. A further pass where a block's
    columns are nearly dependent: inner products alone keep half of their digits then."""
    gain = np.eye(y.shape[1])
    for again in range(4):
        k, held = y.shape[1], p.shape[1]

        def step(x, y=y):
            c = centred.rows(x)
            u = c @ y
            return np.concatenate([(u.T @ u).ravel(), (c.T @ u).ravel(), ((c @ p).T @ u).ravel()])

        got = summed(rows, dim, step)
        gram, z, across = (a.reshape(-1, k) for a in np.split(got, [k * k, k * k + dim * k]))
        y, z, gram = y - p @ across, z - z_of_p @ across, gram - across.T @ across
        e, q = np.linalg.eigh((gram + gram.T) / 2)
        top = max(e[-1], 0.0)
        scale = scale if again else max(scale, np.sqrt(top))
        size = np.sqrt(np.maximum(e, max(1e-13 * top, 1e-300)))
        y, z, gain = y @ (q / size), z @ (q / size), size[:, None] * (q.T @ gain)
        some = np.linalg.norm(gain, axis=1) > NOTHING * scale
        y, z, gain = y[:, some], z[:, some], gain[some]
        near = held and np.abs(across).max() > 1e-6 * np.sqrt(top)
        if not some.any() or not near and e[some].min() > 1e-4 * top:
            break
    return y, z, gain


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS, width: int = WIDTH) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error: every row on
    every component, as a multiple of the component's deviation."""
    reach_workers(rows.sparkSession)
    x, dim = scaled(rows, key, vector)
    n, total = totals(x, dim) if dim else (0, np.zeros(0, np.int64))
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    centred = Centred(n, total)
    s, axes = bidiagonalise(x, dim, centred, wanted, width)
    k, turn = len(s), axes / (s / np.sqrt(n))

    def moments(block: np.ndarray) -> np.ndarray:
        c = centred.rows(block)
        w = c @ turn
        return np.concatenate([(w.T @ w).ravel(), [(c * c).sum()]])

    got = summed(x, dim, moments)
    # Rows are centred in whole numbers, so what they make has no mean to take away.
    off = float(np.abs(got[:-1].reshape(k, k) / n - np.eye(k)).max()) if k else 0.0
    explained = s**2 / got[-1] if k else s

    def run(batches):
        for b in blocks(batches, dim):
            whole = centred.whole(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            if (whole.astype(float) ** 2).sum(1).max() >= LIMIT:
                raise OverflowError("a deviation is too large for a long")
            rows = len(whole)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("key").take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)),
                    pa.array(np.repeat((whole * whole).sum(1), k)), pa.array((whole / n @ turn).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, off)),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(run, schema)
