"""Whitening of embeddings by an incremental eigendecomposition.

Vectors are put on an integer grid, and each distinct one counts once. Every task keeps the spectrum of
the scatter of its vectors and changes it by one centred rank-one update per vector: the new
eigenvalues are the roots of a secular equation, entries that cannot change are deflated, and the new
eigenvectors follow from the roots (Gu and Eisenstat). Spectra of tasks are combined in a tree, one
spectrum entering the other by successive rank-one updates: one per direction and one for the
distance of the means. At last a Rayleigh-Ritz step, whose small matrix all tasks sum up from exactly
centred vectors, takes away what rounding has left; it is repeated until the matrix is diagonal.
What a task holds, and what reaches the driver, is a few matrices of dimension by dimension.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryscore.llm.scratch import kept

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Vectors whose spectrum one task builds; combining two spectra costs as much as one update per dimension.
TASK_VECTORS = 4096
#: Spectra, or matrices, that one task combines.
FAN = 8
#: A direction with less of the largest variance than this has none.
RANK = 1e-12
#: Rayleigh-Ritz steps end when whitened components are this close to uncorrelated.
DIAGONAL, STEPS = 1e-10, 5
_EPS = np.finfo(float).eps


# --- rank-one updates ---------------------------------------------------------------------


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """(origin, offset) of the roots of 1 + rho * sum(z2 / (d - x)), one right of every pole.

    ``d`` ascends strictly and ``z2`` is positive. A root is its offset from the nearer pole, so that its
    distance to every pole is known to full precision. All roots are refined at once, by a model of
    the function with the two poles around each root, and by bisection where that leaves its bracket.
    """
    k = len(d)
    at = np.arange(k)
    gap = np.append(np.diff(d), rho * z2.sum())
    middle = gap / 2
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        f = 1 + rho * (z2 / ((d[None, :] - d[:, None]) - middle[:, None])).sum(1)
    left = (f >= 0) | (at == k - 1)
    origin = np.where(left, at, np.minimum(at + 1, k - 1))
    delta = d[None, :] - d[origin][:, None]
    low = np.where(left, 0.0, -middle)
    high = np.where(left, middle, 0.0)
    if f[-1] < 0:
        low[-1], high[-1] = middle[-1], gap[-1]
    t = np.where(left, middle, -middle)
    below = (at[None, :] <= at[:, None]).astype(float)
    first, second = delta[at, at], delta[at, np.minimum(at + 1, k - 1)]
    before = np.full(k, np.inf)
    open_ = at
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        for _ in range(100):
            gone = delta[open_] - t[open_, None]
            term = rho * z2 / gone
            f = 1 + term.sum(1)
            todo = (np.abs(f) > 4 * k * _EPS * (1 + np.abs(term).sum(1))) & (high[open_] - low[open_] > 2 * _EPS * np.abs(t[open_]))
            if not todo.any():
                break
            open_, f, term, gone = open_[todo], f[todo], term[todo], gone[todo]
            slope = term / gone
            psi = np.einsum("ij,ij->i", slope, below[open_])
            phi = slope.sum(1) - psi
            now = t[open_]
            low[open_], high[open_] = np.where(f < 0, now, low[open_]), np.where(f < 0, high[open_], now)
            one, two = first[open_] - now, second[open_] - now
            a = (one + two) * f - one * two * (psi + phi)
            b = one * two * f
            c = f - one * psi - two * phi
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            # right of the last pole there is only one pole to model
            step = np.where(open_ == k - 1, f * one / (f - psi * one), step)
            new = now + step
            fine = (new > low[open_]) & (new < high[open_]) & (np.abs(f) <= before[open_] / 2)
            # where the model has not halved the function, the bracket is halved: the end is sure
            t[open_] = np.where(fine, new, (low[open_] + high[open_]) / 2)
            before[open_] = np.abs(f)
    return origin, t


def _merge_equal(values, vectors, z, live, tol) -> np.ndarray:
    """Rotates pairs of directions with practically equal values until one of each carries all of z."""
    kept_, last = [], -1
    for i in live:
        if last >= 0:
            both = math.hypot(z[last], z[i])
            c, s = z[i] / both, z[last] / both
            if abs((values[i] - values[last]) * c * s) <= tol:
                z[i], z[last] = both, 0.0
                one, two = vectors[:, last].copy(), vectors[:, i].copy()
                vectors[:, last], vectors[:, i] = c * one - s * two, s * one + c * two
                low, high = values[last], values[i]
                values[last], values[i] = low * c * c + high * s * s, low * s * s + high * c * c
                kept_.pop()
        kept_.append(i)
        last = i
    return np.array(kept_, np.int64)


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues, and eigenvectors, of ``vectors @ diag(values) @ vectors.T + rho * outer(v, v)``."""
    z = vectors.T @ v
    size = float(z @ z)
    if not rho * size > 0:
        return values, vectors
    z, rho = z / math.sqrt(size), rho * size
    tol = 8 * _EPS * max(abs(values[-1]), abs(values[0]), rho)
    live = np.flatnonzero(rho * np.abs(z) > tol)
    if not len(live):  # less than rounding can show
        return values, vectors
    zl = z[live]
    close = np.diff(values[live]) * np.abs(zl[1:] * zl[:-1]) <= tol * (zl[1:] ** 2 + zl[:-1] ** 2)
    if close.any():
        values, vectors = values.copy(), vectors.copy()
        live = _merge_equal(values, vectors, z, live, tol)
    d, zl = values[live], z[live]
    order = np.argsort(d, kind="stable")
    live, d, zl = live[order], d[order], zl[order]
    origin, offset = secular_roots(d, zl * zl, rho)
    gone = (d[None, :] - d[origin][:, None]) - offset[:, None]
    k = len(d)
    apart = d[:, None] - d[None, :]
    np.fill_diagonal(apart, 1.0)
    # the z that has exactly these roots: its eigenvectors are orthogonal to working precision
    exact = np.sqrt(np.abs(np.prod(-gone / apart, axis=0)) / rho) * np.where(zl < 0, -1.0, 1.0)
    turn = exact[:, None] / gone.T
    turn /= np.sqrt((turn * turn).sum(0))
    out_values, out_vectors = values.copy(), vectors.copy()
    out_values[live] = d[origin] + offset
    out_vectors[:, live] = vectors[:, live] @ turn
    order = np.argsort(out_values, kind="stable")
    return out_values[order], out_vectors[:, order]


@dataclass
class Spectrum:
    """Count and mean of some vectors, and the spectrum of their scatter around it."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim), np.zeros(dim), np.eye(dim))

    def add(self, x: np.ndarray) -> None:
        gap = x - self.mean
        self.n += 1
        self.mean = self.mean + gap / self.n
        self.values, self.vectors = rank_one(self.values, self.vectors, gap, (self.n - 1) / self.n)

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        gap, n = other.mean - self.mean, self.n + other.n
        values, vectors = rank_one(self.values, self.vectors, gap, self.n * other.n / n)
        for value, vector in zip(other.values, other.vectors.T):
            values, vectors = rank_one(values, vectors, vector, float(value))
        self.n, self.mean, self.values, self.vectors = n, self.mean + gap * (other.n / n), values, vectors


# --- vectors on the grid --------------------------------------------------------------------


def _exact(entry: Column) -> Column:
    """Whether an entry is there, finite, and small enough to be exact on the grid; nan is larger than any number."""
    return F.coalesce(F.abs(entry.cast("double") * SCALE) < F.lit(2.0**53), F.lit(False))


def on_grid(vectors: DataFrame, vector: str, carry: list[str]) -> DataFrame:
    """(_doc, x) of the rows that can be used: their columns ``carry``, and the vector on the grid."""
    x = F.transform(vectors[vector], lambda c: F.when(_exact(c), F.floor(c.cast("double") * SCALE).cast("bigint") + SHIFT))
    doc = F.struct(F.lit(0).alias("_"), *[vectors[c] for c in carry]).alias("_doc")
    return vectors.where(F.coalesce(F.forall(vectors[vector], _exact), F.lit(False))).select(doc, x.alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@dataclass(frozen=True)
class Model:
    """Count, sums and principal directions of distinct vectors; directions by falling variance."""

    n: int
    sums: tuple[int, ...]
    variances: np.ndarray
    directions: np.ndarray
    total: float
    identity_error: float

    @property
    def rank(self) -> int:
        return int((self.variances > RANK * max(self.variances[0], 0)).sum()) if len(self.variances) else 0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: integers of the machine where they are sure to fit."""
        sums = np.array(self.sums, object)
        largest = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums)))
        if 2 * largest < 2**62:
            return x * np.int64(self.n) - sums.astype(np.int64)
        return x.astype(object) * self.n - sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n


# --- fitting ---------------------------------------------------------------------------------


_SPECTRUM = "n long, sums array<string>, mean binary, values binary, vectors binary"


def _packed(spectrum: Spectrum, sums: list[int]) -> pa.RecordBatch:
    row = {
        "n": spectrum.n, "sums": [str(s) for s in sums], "mean": spectrum.mean.tobytes(),
        "values": spectrum.values.tobytes(), "vectors": np.ascontiguousarray(spectrum.vectors).tobytes(),
    }
    schema = pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.string())), ("mean", pa.binary()), ("values", pa.binary()), ("vectors", pa.binary())])
    return pa.RecordBatch.from_pylist([row], schema=schema)


def _unpacked(row: dict) -> tuple[Spectrum, list[int]]:
    mean = np.frombuffer(row["mean"])
    vectors = np.frombuffer(row["vectors"]).reshape(len(mean), len(mean))
    return Spectrum(row["n"], mean, np.frombuffer(row["values"]), vectors), [int(s) for s in row["sums"]]


def _spectra(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, sums = Spectrum.empty(dim), [0] * dim
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            high, low = (x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0)
            sums = [s + (int(h) << 26) + int(w) for s, h, w in zip(sums, high, low)]
            for row in (x - SHIFT).astype(np.float64):
                found.add(row)
        if found.n:
            yield _packed(found, sums)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, sums = None, []
    for batch in batches:
        for row in batch.to_pylist():
            spectrum, own = _unpacked(row)
            if found is None:
                found, sums = spectrum, own
            else:
                found.merge(spectrum)
                sums = [a + b for a, b in zip(sums, own)]
    if found is not None:
        yield _packed(found, sums)


def _tree(rows: DataFrame, tasks: int, combine, schema: str) -> list:
    """What is left of ``rows``, one row per task, when ``combine`` has joined them in a tree: at most ``FAN`` rows."""
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        rows = rows.repartition(tasks).mapInArrow(combine, schema)
    return rows.collect()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for value in batch.column("matrix").to_pylist():
            value = np.frombuffer(value)
            total = value if total is None else total + value
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["matrix"])


def _projected(fitted: DataFrame, tasks: int, model: Model) -> np.ndarray:
    """The covariance of the vectors in the directions of ``model``, summed up by all tasks."""
    dim = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            along = model.centred(_matrix(batch.column("x"), dim)) @ model.directions
            total += along.T @ along
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["matrix"])

    parts = _tree(fitted.mapInArrow(run, "matrix binary"), tasks, _added, "matrix binary")
    return sum(np.frombuffer(p.matrix).reshape(dim, dim) for p in parts) / model.n


def _refined(fitted: DataFrame, tasks: int, model: Model, components: int) -> Model:
    for step in range(STEPS):
        small = _projected(fitted, tasks, model)
        order = np.argsort(-np.diag(small), kind="stable")
        small = small[np.ix_(order, order)]
        model = replace(
            model, directions=model.directions[:, order], variances=np.diag(small).copy(), total=float(np.trace(small)))
        k = min(components, model.rank)
        scale = 1 / np.sqrt(model.variances[:k])
        off = np.abs(small[:k, :k] * np.outer(scale, scale) - np.eye(k)).max(initial=0.0)
        rest = np.abs(small[:k, k:]).max(initial=0.0) / max(model.variances[0], 1e-300)
        model = replace(model, identity_error=float(off))
        if not k or max(off, rest) <= DIAGONAL and step or step == STEPS - 1:
            return model
        _, turn = np.linalg.eigh((small + small.T) / 2)
        directions, _ = np.linalg.qr(model.directions @ turn[:, ::-1])
        model = replace(model, directions=directions)
    return model


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS, task_vectors: int = TASK_VECTORS) -> Model | None:
    """The principal directions of the distinct usable vectors; None if there are none.

    Vectors that are null or empty, or hold null, non-finite or huge entries (from 2^53/64 on), do not
    count, and neither do those of another length than most have (the shorter of equally frequent ones).
    """
    grid = on_grid(vectors, vector, []).where("size(x) > 0")
    sizes = grid.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return None
    dim = sizes.dim
    fitted = kept(grid.where(F.size("x") == dim).groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x"), "vectors")
    tasks = -(-fitted.count() // task_vectors)
    fitted = kept(fitted.repartition(tasks), "spread")
    spectra = kept(fitted.repartition(tasks).mapInArrow(_spectra(dim), _SPECTRUM), "spectra")
    whole, sums = None, []
    for row in _tree(spectra, tasks, _merged, _SPECTRUM):
        spectrum, own = _unpacked(row.asDict())
        if whole is None:
            whole, sums = spectrum, own
        else:
            whole.merge(spectrum)
            sums = [a + b for a, b in zip(sums, own)]
    basis, _ = np.linalg.qr(whole.vectors[:, ::-1])
    start = Model(whole.n, tuple(sums), whole.values[::-1] / whole.n, basis, 0.0, 0.0)
    return _refined(fitted, tasks, start, components)


# --- applying --------------------------------------------------------------------------------


def whiten(vectors: DataFrame, model: Model, vector: str = "embedding", carry: list[str] | None = None, components: int = COMPONENTS) -> DataFrame:
    """The columns ``carry`` (default: all) plus deviation and whitened of every row with a usable vector.

    whitened holds the first ``components`` components, or as many as have variance; deviation is the
    sum of the squares of n * x - sums, null where a long cannot hold it. Columns of these names give way.
    """
    carry = [c for c in (vectors.columns if carry is None else carry) if c not in ("deviation", "whitened")]
    dim, k = len(model.sums), min(components, model.rank)
    turn = model.directions[:, :k] / np.sqrt(model.variances[:k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            off = model.deviations(x)
            if off.dtype == object or np.abs(off).max(initial=0) >= math.isqrt(2**62 // dim):
                squares = [sum(v * v for v in map(int, row)) for row in off]
                deviation = pa.array([s if s < 2**63 else None for s in squares], pa.int64())
            else:
                deviation = pa.array((off * off).sum(1))
            flat = (off.astype(np.float64) / model.n) @ turn
            ends = pa.array(np.arange(len(x) + 1) * k, pa.int32())
            white = pa.ListArray.from_arrays(ends, pa.array(flat.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), deviation, white], names=["_doc", "deviation", "whitened"])

    grid = on_grid(vectors, vector, carry).where(F.size("x") == dim)
    schema = T.StructType([grid.schema["_doc"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return grid.mapInArrow(run, schema).select(*[F.col("_doc")[c].alias(c) for c in carry], "deviation", "whitened")


def components_of(vectors: DataFrame, vector: str = "embedding", carry: list[str] | None = None, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: ``carry``, component (from 1), n, deviation, whitened, explained, identity_error.

    Components without variance are left out: they cannot be whitened. A table without usable
    vectors, or with a single distinct one, gives no rows. Columns of the names added give way.
    """
    added = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    carry = [c for c in (vectors.columns if carry is None else carry) if c not in added]
    model = fit(vectors, vector, components)
    if model is None:
        model = Model(1, (0,), np.zeros(0), np.zeros((1, 0)), 1.0, 0.0)
    k = min(components, model.rank)
    explained = F.array(*[F.lit(float(v / model.total)) for v in model.variances[:k]]) if k else F.lit(None).cast("array<double>")
    rows = whiten(vectors, model, vector, carry, components)
    each = rows.select(F.struct(F.lit(0).alias("_"), *carry).alias("_doc"), F.col("deviation").alias("_deviation"), F.posexplode("whitened").alias("_at", "_white"))
    return each.select(
        *[F.col("_doc")[c].alias(c) for c in carry], (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("bigint").alias("n"), F.col("_deviation").alias("deviation"), F.col("_white").alias("whitened"),
        explained[F.col("_at")].alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
