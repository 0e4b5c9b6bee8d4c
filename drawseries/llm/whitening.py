"""Embedding whitening: principal components found by spectrum slicing.

Entries become whole numbers x = floor(64 c) + 1000000, so counts, sums and products
are exact and the same however rows are dealt.  Sums come first; products are then
taken of x minus the whole part of its mean, and what the part after the point adds
is corrected in whole numbers.  Tasks send one number for each pair of dimensions,
which Spark adds; the driver holds the covariance, whose size depends on the
dimensions alone.

Eigenvalues.  The number of eigenvalues above a shift s is the number of positive
pivots of the LDL^T factors of V - sI (Sylvester's law of inertia).  Bisection by
such counts isolates each leading eigenvalue in an interval of its own; Rayleigh
quotient iteration from there converges cubically; the eigenvalue found is accepted
only if counts just below and just above it give its number.  Eigenvalues too close
for counts to part are found as a group: inverse iteration on several vectors, kept
at right angles to all found before, and the small problem inside their span.

Defined cases: a row whose vector is null, or holds a null or non-finite entry, is
dropped; so is an empty vector, and one whose length is not the most common (ties:
the shorter).  Entries beyond +-2^40 count as that.  Components without variance
(eigenvalue under 1e-12 of the trace) cannot be whitened and are not returned, so
one vector, or equal ones, give no rows.  ``deviation`` beyond a long is null.
Repeated rows and ids are rows of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, staged

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
BOUND = 2.0 ** 40
NO_VARIANCE = 1e-12
#: Bisection ends, and a group of eigenvalues is taken together, at this share of the spectrum's width.
CLOSE = 1e-11
#: Products of numbers of so many bits are exact in double precision, also added over so many rows.
LIMB, ROWS = 20, 4096


def whole_numbers(lists: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that remain, their x as int64 matrix); without ``dim`` only the rows, whatever their length."""
    values, offsets = lists.values, np.asarray(lists.offsets)
    flat = np.asarray(values.cast(pa.float64()).fill_null(np.nan))
    size = np.diff(offsets)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = np.asarray(lists.is_valid()) & (size > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    if dim is None:
        return np.nonzero(good)[0], np.zeros((0, 0), np.int64)
    rows = np.nonzero(good & (size == dim))[0]
    c = flat[offsets[rows][:, None] + np.arange(dim)]
    return rows, np.floor(np.clip(c, -BOUND, BOUND) * SCALE).astype(np.int64) + SHIFT


def exact_products(z: np.ndarray) -> list[int]:
    """Upper triangle of z^T z in whole numbers, by matrix products of limbs that doubles hold exactly."""
    if len(z) > ROWS:
        parts = [exact_products(z[i:i + ROWS]) for i in range(0, len(z), ROWS)]
        return [sum(p) for p in zip(*parts)]
    most = int(np.abs(z).max()) if z.size else 0
    limbs = []
    sign, rest = np.sign(z), np.abs(z)
    while True:
        limbs.append((sign * (rest & ((1 << LIMB) - 1))).astype(np.float64))
        rest >>= LIMB
        most >>= LIMB
        if not most:
            break
    at = np.triu_indices(z.shape[1])
    total = None
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            part = (a.T @ b)[at].astype(np.int64)
            if len(limbs) == 1:
                return part.tolist()
            part = [int(v) << (LIMB * (i + j)) for v in part]
            total = part if total is None else [p + q for p, q in zip(total, part)]
    return total


@dataclass
class Moments:
    dim: int
    n: int
    sums: list[int]
    covariance: np.ndarray


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, dtype=object)
        for b in batches:
            rows, x = whole_numbers(b.column(0), dim)
            n += len(rows)
            total = total + (x.sum(0).astype(object) if np.abs(x).max(initial=0) < 1 << 50 else x.astype(object).sum(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([str(v) for v in [n, *total]])],
                                             names=["d", "v"])
    return run


def _products(dim: int, middle: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            rows, x = whole_numbers(b.column(0), dim)
            if len(rows):
                part = exact_products(x - middle)
                total = part if total is None else [p + q for p, q in zip(total, part)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(v) for v in total])],
                                             names=["d", "v"])
    return run


def _added(parts: DataFrame) -> dict[int, int]:
    """Sums of whole numbers by place: one row for each place reaches the driver."""
    got = parts.groupBy("d").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    return {r.d: int(r.v) for r in got}


def moments(vectors: DataFrame, vec: str = "embedding") -> Moments | None:
    """Exact counts and sums, and the covariance (divisor n) of the fit list."""
    short_batches(vectors.sparkSession)
    lists = vectors.select(vectors[vec].cast("array<double>").alias("v"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, _ = whole_numbers(b.column(0), None)
            size, n = np.unique(np.diff(np.asarray(b.column(0).offsets))[rows], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(n, pa.int64())], names=["d", "n"])
    common = lists.mapInArrow(lengths, "d int, n long").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return None
    dim = common.d
    sums = _added(lists.mapInArrow(_sums(dim), "d int, v string"))
    n, s = sums[-1], [sums[i] for i in range(dim)]
    middle = np.array([v // n for v in s], dtype=np.int64)
    products = _added(lists.mapInArrow(_products(dim, middle), "d int, v string"))
    rest = [v - n * int(m) for v, m in zip(s, middle)]
    v = np.zeros((dim, dim))
    for k, (i, j) in enumerate(zip(*np.triu_indices(dim))):
        v[i, j] = v[j, i] = float(Fraction(n * products[k] - rest[i] * rest[j], n * n))
    return Moments(dim, n, s, v)


def inertia(a: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix, from the pivots of LDL^T (Bunch-Kaufman)."""
    a = np.array(a, dtype=np.float64)
    n, k, positive = len(a), 0, 0
    alpha = (1 + 17 ** 0.5) / 8
    while k < n:
        col = np.abs(a[k + 1:, k])
        r = k + 1 + int(np.argmax(col)) if len(col) else k
        big = col[r - k - 1] if len(col) else 0.0
        two, swap = False, None
        if abs(a[k, k]) < alpha * big:
            row = np.abs(a[r, k:])
            row[r - k] = 0.0
            sigma = row.max()
            if abs(a[k, k]) * sigma < alpha * big * big:
                if abs(a[r, r]) >= alpha * sigma:
                    swap = (k, r)
                else:
                    two, swap = True, (k + 1, r)
        if swap and swap[0] != swap[1]:
            i, j = swap
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
        if two:
            d, c = a[k:k + 2, k:k + 2].copy(), a[k + 2:, k:k + 2].copy()
            a[k + 2:, k + 2:] -= c @ np.linalg.solve(d, c.T)
            positive += 1                               # such a block has one eigenvalue of each sign
            k += 2
        else:
            d, c = a[k, k], a[k + 1:, k].copy()
            if d != 0:
                a[k + 1:, k + 1:] -= np.outer(c, c / d)
            positive += d > 0
            k += 1
    return int(positive)


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors in columns) of the ``k`` leading ones that have variance."""
    dim, trace = len(v), float(np.trace(v))
    none = np.zeros(0), np.zeros((dim, 0))
    if not trace > 0:
        return none
    scale = trace / dim
    a = v / scale                                        # eigenvalues between 0 and dim
    eye = np.eye(dim)
    known: dict[float, int] = {}

    def above(s: float) -> int:
        if s not in known:
            known[s] = inertia(a - s * eye)
        return known[s]

    top = float(np.abs(a).sum(1).max()) * (1 + 1e-12)    # no eigenvalue lies above (Gershgorin)
    floor = NO_VARIANCE * dim
    k = min(k, above(floor))
    tolerance = CLOSE * top
    known[top] = 0
    values, columns = [], np.zeros((dim, 0))
    while len(values) < k:
        done = len(values)
        # the interval that holds eigenvalue done + 1, cut until nothing else is in it
        low = max(s for s, c in [*known.items(), (0.0, dim)] if c > done)
        high = min(s for s, c in known.items() if c <= done)
        while above(low) - above(high) > 1 and high - low > tolerance:
            cut = (low + high) / 2
            low, high = (cut, high) if above(cut) > done else (low, cut)
        n = above(low) - above(high)
        lam, x = _eigenvectors(a, low, high, n, columns)
        values += lam
        columns = np.concatenate([columns, x], axis=1)
        for i, one in enumerate(lam):                    # counts certify the numbering
            margin = max(tolerance, 1e-9 * abs(one))
            if not (above(one + margin) <= done + i < above(one - margin)):
                raise ArithmeticError(f"eigenvalue {done + i + 1} is not certified by its counts")
    return np.array(values[:k]) * scale, columns[:, :k]


def _eigenvectors(a: np.ndarray, low: float, high: float, n: int, found: np.ndarray) -> tuple[list[float], np.ndarray]:
    """The ``n`` eigenpairs between low and high: one by Rayleigh quotients, a close group by inverse iteration."""
    dim = len(a)
    x = np.random.default_rng(dim + found.shape[1]).standard_normal((dim, n))
    shift, eye = (low + high) / 2, np.eye(dim)

    def apart(y: np.ndarray) -> np.ndarray:
        for _ in range(2):
            y = y - found @ (found.T @ y)
        return np.linalg.qr(y)[0]

    def solve(s: float, y: np.ndarray) -> np.ndarray:
        try:
            return np.linalg.solve(a - s * eye, y)
        except np.linalg.LinAlgError:                    # the shift is an eigenvalue to the last digit
            return np.linalg.solve(a - (s + 1e-14 * max(1.0, abs(s))) * eye, y)
    x = apart(x)
    for _ in range(4 if n == 1 else 12):                 # at the middle, until the quotient stays in the interval
        x = apart(solve(shift, x))
    if n == 1:
        lam, last = float(x[:, 0] @ a @ x[:, 0]), None
        for _ in range(60):
            if not low <= lam <= high:                   # another eigenvalue draws it: cut the interval and go on
                half = (low + high) / 2
                low, high = (half, high) if inertia(a - half * eye) > found.shape[1] else (low, half)
                lam = (low + high) / 2
            x = apart(solve(lam, x))
            now = float(x[:, 0] @ a @ x[:, 0])
            if last is not None and low <= now <= high and abs(now - last) <= 4e-16 * max(1.0, abs(now)):
                lam = now
                break
            last, lam = now, now
        return [lam], x
    small = x.T @ a @ x                                  # a close group: the problem inside its span
    w, q = _jacobi((small + small.T) / 2)
    return w.tolist(), x @ q


def _jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and vectors of a small symmetric matrix by plane rotations."""
    n, q = len(a), np.eye(len(a))
    a = a.copy()
    for _ in range(60):
        off = np.abs(a - np.diag(np.diag(a))).max() if n > 1 else 0.0
        if off <= 1e-17 * np.abs(np.diag(a)).max():
            break
        for i in range(n - 1):
            for j in range(i + 1, n):
                if abs(a[i, j]) <= 1e-18 * (abs(a[i, i]) + abs(a[j, j])):
                    a[i, j] = a[j, i] = 0.0
                    continue
                theta = (a[j, j] - a[i, i]) / (2 * a[i, j])
                t = (1 if theta >= 0 else -1) / (abs(theta) + np.hypot(theta, 1))
                c = 1 / np.hypot(t, 1)
                g = np.array([[c, t * c], [-t * c, c]])
                a[[i, j]] = g.T @ a[[i, j]]
                a[:, [i, j]] = a[:, [i, j]] @ g
                q[:, [i, j]] = q[:, [i, j]] @ g
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], q[:, order]


@dataclass
class Whitening:
    moments: Moments
    values: np.ndarray
    vectors: np.ndarray

    def project(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """(whitened rows, exact deviation of each) of rows of whole numbers."""
        m = self.moments
        middle = np.array([s // m.n for s in m.sums], dtype=np.int64)
        rest = np.array([s - m.n * (s // m.n) for s in m.sums], dtype=np.int64)
        z = x - middle
        white = (z - rest / m.n) @ (self.vectors / np.sqrt(self.values))
        most = float(np.abs(z).max(initial=0) + 1) * m.n
        if most * most * m.dim < 2 ** 62:
            dev = m.n * z - rest
            return white, (dev * dev).sum(1).tolist()
        dev = [sum((m.n * int(a) - int(r)) ** 2 for a, r in zip(row, rest)) for row in z]
        return white, [d if d < 1 << 63 else None for d in dev]


def fit(vectors: DataFrame, vec: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    m = moments(vectors, vec)
    return Whitening(m, *leading(m.covariance, components)) if m else None


def identity_error(vectors: DataFrame, w: Whitening, vec: str = "embedding") -> float:
    """Largest entry of the whitened rows' covariance minus the identity, measured over all rows."""
    k, dim = len(w.values), w.moments.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, p = np.zeros(k), np.zeros((k, k))
        for b in batches:
            y, _ = w.project(whole_numbers(b.column(0), dim)[1])
            s, p = s + y.sum(0), p + y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array([*s, *p.reshape(-1)], pa.float64())],
                                         names=["d", "v"])
    if not k:
        return 0.0
    got = vectors.select(vectors[vec].cast("array<double>").alias("v")).mapInArrow(run, "d int, v double").groupBy("d").sum("v").collect()
    flat = np.zeros(k + k * k)
    for d, v in got:
        flat[d] = v
    mean = flat[:k] / w.moments.n
    return float(np.abs(flat[k:].reshape(k, k) / w.moments.n - np.outer(mean, mean) - np.eye(k)).max())


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, w: Whitening | None = None, vec: str = "embedding", key: str = "vec_id",
           components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each remaining row and component."""
    spark = vectors.sparkSession
    short_batches(spark)
    light = staged(vectors.select(vectors[vec].cast("array<double>").alias("v"), vectors[key].cast("long").alias("k")), "vectors")
    w = w or fit(light, "v", components)
    if w is None:
        return spark.createDataFrame([], f"{key} long, {OUT}")
    error = identity_error(light, w, "v")
    k, m = len(w.values), w.moments
    trace = float(np.trace(m.covariance))
    share = w.values / trace if k else w.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = whole_numbers(b.column(0), m.dim)
            white, dev = w.project(x)
            r = len(rows)
            at = pa.array(np.repeat(np.arange(r), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(1).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1), r), pa.int32()),
                 pa.array(np.full(r * k, m.n), pa.int64()), pa.array(dev, pa.int64()).take(at),
                 pa.array(white.reshape(-1), pa.float64()), pa.array(np.tile(share, r), pa.float64()),
                 pa.array(np.full(r * k, error), pa.float64())], names=["k", *[c.split()[0] for c in OUT.split(", ")]])
    return light.mapInArrow(run, f"k long, {OUT}").withColumnRenamed("k", key)
