r"""Embedding whitening by incremental eigendecomposition.

Entries become integers floor(``scale`` * c) + ``offset``.  One pass sums them exactly.  In a second pass each partition keeps
the eigendecomposition of its scatter matrix about its running mean and updates it with each vector: the
centred vector is split into its part in the basis, z, and a new direction; the secular equation
1 + rho * sum z_j^2 / (d_j - x) = 0 gives the new eigenvalues and the interlaced differences to the old ones the
eigenvectors, after components of no weight and equal eigenvalues are deflated.  Spectra are combined in a tree: into
the larger one go the other's eigenpairs and the difference of the means, as rank-one updates again.
Last, distributed passes V Q over all vectors, centred before they are multiplied, refine the basis by Rayleigh-Ritz until the
residual is that of double precision; with a basis of all dimensions that is one pass.

A task holds one basis (dimensions x ``rank``) and one batch; a basis, one for each ``FAN_IN`` partitions, is what is
shuffled, and one goes to the driver and back.

Vectors that are null, empty or hold null, NaN or infinite entries (or one of 2^52 or more after scaling) are dropped, and so are vectors of another length than the
most frequent one (the longest of equally frequent ones): they are of no common space.  Repeated rows count each.
Null ids are kept.  Components whose eigenvalue is zero in double precision (fewer vectors than components, constant dimensions)
cannot be whitened and are left out, so one vector, equal vectors or an empty table give no rows.  ``deviation`` is
null where it needs more than 63 bits.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from ..session import shared_path
from ._arrow import fresh, quoted

#: Spectra that one task combines.
FAN_IN = 16
EPS = float(np.finfo(float).eps)


# --- rank-one updates ---------------------------------------------------------------------------
def _roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2_j / (d_j - x) = 0 for rising d and positive z2, as the nearer pole's index and the
    distance from it: differences to the poles then keep their digits."""
    k = len(d)
    poles = np.append(d, d[-1] + z2.sum())      # the last root lies before this one
    gap = np.diff(poles)
    middle = d + 0.5 * gap
    f_mid = 1 + (z2 / (d - middle[:, None])).sum(1)
    left = f_mid >= 0
    origin = np.where(left, np.arange(k), np.arange(k) + 1)
    base = poles[origin]
    delta = d - base[:, None]                      # poles seen from each root's origin
    near, far = poles[:k] - base, poles[1:] - base
    low, high = np.where(left, 0.0, -0.5 * gap), np.where(left, 0.5 * gap, 0.0)
    x = 0.5 * (low + high)
    before = np.tri(k) * z2
    for _ in range(60):
        inverse = 1 / (delta - x[:, None])
        f = 1 + inverse @ z2
        done = np.abs(f) <= 4 * EPS * (1 + np.abs(inverse) @ z2)
        inverse *= inverse
        up = np.einsum("ij,ij->i", inverse, before)
        down = inverse @ z2 - up
        low, high = np.where(f < 0, x, low), np.where(f >= 0, x, high)
        if done.all() or (high - low <= 2 * EPS * np.abs(x)).all():
            break
        # a rational step with the two poles next to the root
        p, q = near - x, far - x
        c = f - p * up - q * down
        a = (p + q) * f - p * q * (up + down)
        b = p * q * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = x + step
        bad = ~np.isfinite(new) | (new <= low) | (new >= high)
        x = np.where(done, x, np.where(bad, 0.5 * (low + high), new))
    return base, x


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The eigenpairs of q diag(d) q' + v v', for rising ``d``; at most ``rank`` of them, the largest."""
    z = v @ q
    rest = v - q @ z
    again = rest @ q                               # a second time, so that the new direction is orthogonal
    z, rest = z + again, rest - q @ again
    length, whole = float(np.linalg.norm(rest)), float(np.linalg.norm(v))
    if not whole:
        return d, q
    if q.shape[1] < q.shape[0] and length > 8 * EPS * whole * math.sqrt(len(v)):
        d, z, q = np.append(0.0, d), np.append(length, z), np.column_stack([rest / length, q])
    scale = max(float(d[-1]) if len(d) else 0.0, float(z @ z))
    tiny = 8 * EPS * scale
    # deflation: rotate the weight of equal eigenvalues into one of them ...
    for i in np.flatnonzero(np.diff(d) <= tiny):
        r = math.hypot(z[i], z[i + 1])
        if z[i] and r:
            c, s = z[i + 1] / r, z[i] / r
            q[:, [i, i + 1]] = q[:, [i, i + 1]] @ np.array([[c, s], [-s, c]])
            z[i], z[i + 1] = 0.0, r
    # ... and leave alone those without weight
    live = np.flatnonzero(z * z > tiny * EPS * 8)
    live = live[np.append(np.diff(d[live]) > tiny, True)] if len(live) else live
    if not len(live):
        return d, q
    dl, zl = d[live], z[live]
    base, x = _roots(dl, zl * zl)
    gaps = dl - base[:, None] - x[:, None]         # old minus new eigenvalues
    # weights for which these roots are exact; the eigenvectors are then orthogonal
    k = len(dl)
    between = dl[None, :] - dl[:, None]
    np.fill_diagonal(between, 1.0)
    ratio = -gaps / np.where(np.eye(k, dtype=bool), 1.0, -between)
    weights = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.where(zl < 0, -1.0, 1.0)
    vectors = weights / gaps
    vectors /= np.sqrt((vectors * vectors).sum(1))[:, None]
    q[:, live] = q[:, live] @ vectors.T
    d = d.copy()
    d[live] = base + x
    order = np.argsort(d, kind="stable")[-rank:]
    return np.maximum(d[order], 0.0), q[:, order]


class Spectrum:
    """The eigendecomposition of the scatter of ``n`` vectors about their ``mean``."""

    def __init__(self, dims: int, rank: int, n: int = 0, mean=None, d=None, q=None) -> None:
        self.rank, self.n = rank, n
        self.mean = np.zeros(dims) if mean is None else mean
        self.d, self.q = (np.zeros(0) if d is None else d), (np.zeros((dims, 0)) if q is None else q)

    def add(self, x: np.ndarray) -> None:
        off = x - self.mean
        if self.n:
            self.d, self.q = rank_one(self.d, self.q, off * math.sqrt(self.n / (self.n + 1)), self.rank)
        self.n += 1
        self.mean = self.mean + off / self.n

    def combine(self, other: "Spectrum") -> "Spectrum":
        big, small = (self, other) if self.n >= other.n else (other, self)
        if not small.n:
            return big
        for value, vector in zip(small.d, small.q.T):
            if value > 0:
                big.d, big.q = rank_one(big.d, big.q, vector * math.sqrt(value), big.rank)
        off, n = small.mean - big.mean, big.n + small.n
        big.d, big.q = rank_one(big.d, big.q, off * math.sqrt(big.n * small.n / n), big.rank)
        big.mean, big.n = big.mean + off * (small.n / n), n
        return big


SPECTRUM = StructType().add("n", LongType()).add("mean", ArrayType(DoubleType())).add("d", ArrayType(DoubleType())).add("q", ArrayType(DoubleType()))


def _pack(s: Spectrum) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s.n]), *[pa.array([x.ravel()], pa.list_(pa.float64())) for x in (s.mean, s.d, s.q)]], names=SPECTRUM.names)


# --- tables of vectors ---------------------------------------------------------------------------
def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, dims)


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """``(id, x)``: the vectors without bad entries, as integers, stored in the shared folder."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < float(1 << 52))
    entries = quoted(vector).cast("array<double>")
    rows = vectors.select(quoted(key).alias("id"), entries.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", fine))
    whole = rows.select("id", F.transform("v", lambda c: (F.floor(c * scale) + offset).cast("long")).alias("x"))
    path = shared_path(vectors.sparkSession, f"whiten-{uuid.uuid4().hex}")
    whole.write.parquet(path)
    stored = vectors.sparkSession.read.parquet(path)
    lengths = stored.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return stored.filter(F.size("x") == (lengths["dims"] if lengths else 0))


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""
    n = rows.count()
    if not n:
        return 0, []
    by = rows.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return n, [int(r["s"]) for r in by]


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S/n: the whole part of the mean is taken off exactly."""
    whole = np.array([s // n for s in total], np.int64)
    part = np.array([(s % n) / n for s in total])
    return (x - whole).astype(float) - part


def spectrum(rows: DataFrame, origin: np.ndarray, rank: int) -> Spectrum:
    """The spectrum of all vectors, up to ``rank`` pairs; integers are taken from ``origin``, near their mean."""
    dims = len(origin)

    def update(batches):
        s = Spectrum(dims, rank)
        for batch in batches:
            for x in (_matrix(batch.column(0), dims) - origin).astype(float):
                s.add(x)
        if s.n:
            yield _pack(s)

    def combine(batches):
        s = Spectrum(dims, rank)
        for batch in batches:
            for n, mean, d, q in zip(*(c.to_pylist() for c in batch.columns)):
                s = s.combine(Spectrum(dims, rank, n, np.array(mean), np.array(d), np.array(q).reshape(dims, len(d))))
        if s.n:
            yield _pack(s)

    now = _kept(rows.select("x").mapInArrow(update, SPECTRUM))
    while (parts := now.count()) > 1:
        now = _kept(now.repartition(-(-parts // FAN_IN)).mapInArrow(combine, SPECTRUM))
    r = now.first()
    return Spectrum(dims, rank, r["n"], np.array(r["mean"]), np.array(r["d"]), np.array(r["q"]).reshape(dims, len(r["d"])))


def _kept(df: DataFrame) -> DataFrame:
    path = shared_path(df.sparkSession, f"whiten-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _summed(rows: DataFrame, per_batch, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all vectors of the matrices ``per_batch(x)``, combined in a tree."""
    schema = StructType().add("m", ArrayType(DoubleType()))
    dims = shape[0]

    def first(batches):
        out = np.zeros(shape)
        for batch in batches:
            out += per_batch(_matrix(batch.column(0), dims))
        yield pa.RecordBatch.from_arrays([pa.array([out.ravel()], pa.list_(pa.float64()))], names=["m"])

    def add(batches):
        out = np.zeros(shape[0] * shape[1])
        for batch in batches:
            out += np.asarray(batch.column(0).flatten()).reshape(-1, len(out)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], names=["m"])

    now = _kept(rows.select("x").mapInArrow(first, schema))
    while (parts := now.count()) > 1:
        now = _kept(now.repartition(-(-parts // FAN_IN)).mapInArrow(add, schema))
    return np.array(now.first()["m"]).reshape(shape)


class Whitening:
    """``vectors`` (dimensions x components, unit length), falling ``values``, exact ``total`` of ``n`` vectors, ``trace`` of
    the covariance."""

    def __init__(self, n, total, values, vectors, trace) -> None:
        self.n, self.total, self.values, self.vectors, self.trace = n, total, values, vectors, trace


def fit(rows: DataFrame, components: int = 32, extra: int = 32) -> Whitening:
    """Fits all vectors of ``integers``.  The spectrum has ``components + extra`` pairs, or as many as there are dimensions.

    A pass gives V times an orthonormal basis: the Ritz vectors so far, their residuals and their last step.  Passes end
    when the residuals of the components are those of double precision; a basis of all dimensions needs one pass."""
    n, total = sums(rows)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    dims = len(total)
    rank = min(dims, components + extra)
    found = spectrum(rows, np.array([s // n for s in total], np.int64), rank).q[:, ::-1]
    basis = np.linalg.qr(np.column_stack([found, np.eye(dims)]))[0][:, :rank]   # directions without weight so far come last
    ritz, previous = basis, math.inf
    while True:
        q = basis

        def times(x, q=q):
            y = _centred(x, n, total)
            return np.column_stack([y.T @ (y @ q), (y * y).sum(0)])

        product = _summed(rows, times, (dims, q.shape[1] + 1)) / n
        trace, product = float(product[:, -1].sum()), product[:, :-1]
        small = q.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:rank], turn[:, ::-1][:, :rank]
        step, ritz = ritz, q @ turn
        off = product @ turn - ritz * values
        residual, unit = float(np.abs(off[:, :components]).max()), EPS * max(values[0], 0.0)
        if q.shape[1] == dims or residual <= 64 * unit or residual >= previous and residual <= 1e4 * unit:
            break
        previous = residual
        step = step - ritz @ (ritz.T @ step)
        basis = np.linalg.qr(np.column_stack([ritz, off, step]))[0][:, :dims]
    ritz = ritz / np.linalg.norm(ritz, axis=0)
    good = int((values[:components] > 1e-12 * values[0]).sum()) if values[0] > 0 else 0
    return Whitening(n, total, values[:good], ritz[:, :good], trace)


def _whitened(x: np.ndarray, w: Whitening) -> np.ndarray:
    return _centred(x, w.n, w.total) @ w.vectors / np.sqrt(w.values)


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, from a pass over them."""
    k, dims = len(w.values), len(w.total)

    def moments(x):
        y = _whitened(x, w)
        out = np.zeros((dims, k + 1))
        out[:k, :k] = y.T @ y
        out[:k, k] = y.sum(0)
        return out

    m = _summed(rows, moments, (dims, k + 1)) / w.n
    mean = m[:k, k]
    return float(np.abs(m[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, total: list[int]) -> pa.Array:
    """The exact sum over dimensions of (n * x - S)^2."""
    whole = np.array([s // n for s in total], np.int64)
    part = np.array([s % n for s in total], np.int64)
    reach = n * (float(np.abs(x - whole).max()) + 1)
    if reach * reach * len(total) < 2.0**62:
        off = n * (x - whole) - part
        return pa.array((off * off).sum(1))
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, total)) for row in x]
    return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())


def whiten(rows: DataFrame, w: Whitening, key: str = "vec_id", vectors_per_batch: int = 1024) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` of every vector and component."""
    k, dims = len(w.values), len(w.total)
    schema = StructType([f for f in rows.select(F.col("id").alias(key)).schema.fields])
    for name, kind in (("component", IntegerType()), ("n", LongType()), ("deviation", LongType()), ("whitened", DoubleType()),
                       ("explained", DoubleType()), ("identity_error", DoubleType())):
        schema = schema.add(fresh(name, [key]), kind)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, w)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, vectors_per_batch):
                part = batch.slice(start, vectors_per_batch)
                m, x = part.num_rows, _matrix(part.column(1), dims)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n, np.int64)),
                    _deviations(x, w.n, w.total).take(each), pa.array(_whitened(x, w).ravel()), pa.array(np.tile(w.values / w.trace, m)),
                    pa.array(np.full(m * k, error))], names=schema.names)

    return rows.select("id", "x").mapInArrow(run, schema)
