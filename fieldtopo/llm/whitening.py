"""Whitening of embeddings: the leading principal components, each found by slicing the covariance's spectrum.

Counts. For a shift s, V - sI = L D L' has as many positive pivots as V has eigenvalues above s (Sylvester's law of inertia).
`positives` factors with symmetric pivoting (Bunch and Kaufman's 1x1 and 2x2 pivots), so counts are safe at any shift. Bisection
on counts isolates the k-th largest eigenvalue in an interval of its own; Rayleigh quotient iteration from there converges cubically; and
counts a little below and above the value certify that it is number k. Values that bisection cannot part (equal to rounding) form a
cluster, whose vectors are made orthogonal to one another.

Passes over the rows, in Arrow batches; tasks give back sums of the size of the dimension (or its square), which Spark adds up:
1. n and the sums of the integers x = floor(SCALE c) + SHIFT, exactly; 2. the covariance of x - S/n, centred before multiplying;
3. the covariance of the whitened rows, whose distance from the identity is reported; and the rows themselves.
Only the summed d x d matrix reaches the driver; d is the length of a vector (at most MOST_DIMENSIONS).

Edge cases: vectors null or with null or non-finite entries take no part. Shorter vectors count as padded with zeros. Scaled entries
beyond 2^40 count as 2^40, so that sums stay exact. Components without variance (one row, equal rows, more components than ranks) give 0
for `whitened` and `explained`, and are left out of `identity_error`. A deviation beyond 64 bits is null. Repeated rows
are rows of their own; null ids are kept. An empty table gives no rows. Other columns are kept by `transform`, which replaces
`whitened` and `deviation`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
_MOST, MOST_DIMENSIONS = 1 << 40, 8192
_EPS = float(np.finfo(float).eps)
_ALPHA = (1 + 17**0.5) / 8


def positives(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix lie above the shift: the positive pivots of a - shift I = L D L'."""
    a = a - shift * np.eye(len(a))
    tiny = _EPS * max(float(np.abs(a).max(initial=0)), np.finfo(float).tiny)
    count = 0
    while (n := len(a)) > 0:
        below = np.abs(a[1:, 0])
        r = int(below.argmax()) + 1 if n > 1 else 0
        most = below[r - 1] if n > 1 else 0.0
        two = False
        if abs(a[0, 0]) < _ALPHA * most:
            row = np.abs(a[r])
            row[r] = 0
            at_r = row.max()
            if abs(a[0, 0]) * at_r >= _ALPHA * most * most:
                pass
            elif abs(a[r, r]) >= _ALPHA * at_r:
                a[[0, r]] = a[[r, 0]]
                a[:, [0, r]] = a[:, [r, 0]]
            else:
                two = True
                a[[1, r]] = a[[r, 1]]
                a[:, [1, r]] = a[:, [r, 1]]
        if two:  # a pivot of two has one eigenvalue of either sign
            count += 1
            c = a[2:, :2]
            a = a[2:, 2:] - c @ np.linalg.solve(a[:2, :2], c.T)
        else:
            pivot = float(a[0, 0])
            if abs(pivot) <= tiny:
                pivot = -tiny  # a value at the shift is not above it
            count += pivot > 0
            c = a[1:, 0]
            a = a[1:, 1:] - np.outer(c, c / pivot)
    return int(count)


def _refined(a: np.ndarray, start: float, low: float, high: float, basis: list[np.ndarray]) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from a shift; None where it leaves the interval."""
    n, slack = len(a), 64 * _EPS * max(float(np.abs(a).sum(axis=1).max()), np.finfo(float).tiny)
    v = np.random.default_rng(n * 1000 + len(basis)).standard_normal(n)
    value = start
    for step in range(60):
        for u in basis * 2:
            v = v - (u @ v) * u
        v /= np.linalg.norm(v)
        if step > 2:  # a few steps of inverse iteration at the fixed shift come first
            value = float(v @ (a @ v))
            if np.linalg.norm(a @ v - value * v) <= slack / 8:
                break
        try:
            w = np.linalg.solve(a - value * np.eye(n), v)
        except np.linalg.LinAlgError:
            w = np.linalg.solve(a - (value + slack) * np.eye(n), v)
        if not np.isfinite(w).all() or not np.linalg.norm(w) > 0:
            break
        v = w / np.linalg.norm(w)
    for u in basis * 2:
        v = v - (u @ v) * u
    v /= np.linalg.norm(v)
    value = float(v @ (a @ v))
    return (value, v) if low - slack <= value <= high + slack and np.linalg.norm(a @ v - value * v) <= 16 * slack else None


def leading(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leading eigenvalues (falling), their unit vectors as rows, and for each whether counts on either side certify its number."""
    d = len(a)
    reach = float(np.abs(a).sum(axis=1).max(initial=0))  # every eigenvalue lies within this
    gap = 64 * _EPS * max(reach, np.finfo(float).tiny)
    known = {-reach - gap: d, reach + gap: 0}  # counts at the shifts tried so far

    def count(s: float) -> int:
        if s not in known:
            known[s] = positives(a, s)
        return known[s]

    values, vectors, sure = [], [], []
    for k in range(1, min(most, d) + 1):
        low = max(s for s, c in known.items() if c >= k)
        high = min(s for s, c in known.items() if c < k)
        while True:
            # Isolated: exactly one eigenvalue between. Not to be parted: the interval is as narrow as rounding allows.
            if (count(low) == k and count(high) == k - 1) or high - low <= gap:
                found = _refined(a, (low + high) / 2, low, high, vectors)
                if found:
                    break
                if high - low <= gap:  # within a cluster: the best vector that is orthogonal to those found
                    found = _in_cluster(a, (low + high) / 2, vectors)
                    break
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) >= k else (low, middle)
        value, vector = found
        values.append(value)
        vectors.append(vector)
        sure.append(count(value - 4 * gap) >= k and count(value + 4 * gap) < k)
    return np.array(values), np.array(vectors).reshape(-1, d), np.array(sure, bool)


def _in_cluster(a: np.ndarray, shift: float, basis: list[np.ndarray]) -> tuple[float, np.ndarray]:
    d = len(a)
    rest = np.eye(d) - sum((np.outer(u, u) for u in basis), np.zeros((d, d)))
    v = rest[:, int(np.argmax(np.diag(rest)))]
    bump = max(64 * _EPS * float(np.abs(a).max()), np.finfo(float).tiny)
    for _ in range(12):
        v = rest @ (rest @ (v / np.linalg.norm(v)))
        v = np.linalg.solve(a - (shift + bump) * np.eye(d), v / np.linalg.norm(v))
    v = rest @ (rest @ (v / np.linalg.norm(v)))
    v /= np.linalg.norm(v)
    return float(v @ (a @ v)), v


@dataclass
class Whitening:
    """n and S of the fit list, the trace of the covariance, and of each component its eigenvalue, unit vector and certificate."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    certified: np.ndarray

    def varies(self) -> np.ndarray:
        """Components whose variance is more than rounding."""
        return self.values > 1e-12 * max(self.trace, np.finfo(float).tiny)

    def scaled(self) -> np.ndarray:
        """(d, components): a centred row times this is whitened."""
        varies = self.varies()
        return self.vectors.T * np.where(varies, 1 / np.sqrt(np.where(varies, self.values, 1)), 0.0)

    def explained(self) -> np.ndarray:
        return np.where(self.varies(), self.values / (self.trace or 1.0), 0.0)


def taking_part(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """The rows whose vector is there and has only finite entries."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return df.where(F.col(vec_col).isNotNull() & ~bad)


def _integers(lists: pa.Array, d: int | None = None) -> np.ndarray:
    """Rows of x, padded with those of zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(lists.value_lengths(), np.int64)
    flat = np.asarray(lists.flatten(), np.float64)
    width = int(sizes.max(initial=0)) if d is None else d
    c = np.zeros((len(sizes), width))
    c[np.arange(width) < sizes[:, None]] = flat
    return np.clip(np.floor(c * SCALE), -_MOST, _MOST).astype(np.int64) + SHIFT


def _summed(df: DataFrame, vec_col: str, work) -> dict[int, float]:
    """Sums by position of what a kernel gives for each batch of vectors; kernels return an array, Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = work(batch.column(0))
                if total is None:
                    total = made
                else:
                    if len(made) > len(total):  # a longer vector than before
                        total, made = made, total
                    total[: len(made)] += made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "value"])

    kind = "long" if work.__name__ == "sums" else "double"
    added = df.select(vec_col).mapInArrow(run, f"at long, value {kind}").groupBy("at").agg(F.sum("value").alias("value"))
    return {r["at"]: r["value"] for r in added.collect()}  # of the size of the dimension or its square


def fit(df: DataFrame, components: int = COMPONENTS, vec_col: str = "embedding") -> Whitening | None:
    """The whitening of all rows that take part; None without any."""
    rows = taking_part(df, vec_col)

    def sums(lists: pa.Array) -> np.ndarray:
        x = _integers(lists)
        # Offsets from SHIFT, so that shorter vectors add nothing; the number of rows first.
        return np.concatenate(([len(x)], (x - SHIFT).sum(axis=0)))

    found = _summed(rows, vec_col, sums)
    if not found:
        return None
    n, d = int(found[0]), len(found) - 1
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; the covariance of more than {MOST_DIMENSIONS} is not held in one place")
    total = np.array([found[i + 1] + n * SHIFT for i in range(d)], object)
    mean = np.array([int(s) / n for s in total], float)

    def scatter(lists: pa.Array) -> np.ndarray:
        y = _integers(lists, d) - mean
        return (y.T @ y)[np.triu_indices(d)]

    found = _summed(rows, vec_col, scatter)
    v = np.zeros((d, d))
    v[np.triu_indices(d)] = [found[i] / n for i in range(d * (d + 1) // 2)]
    v = v + np.triu(v, 1).T
    values, vectors, certified = leading(v, components)
    return Whitening(n, total, float(np.trace(v)), values, vectors, certified)


def identity_error(df: DataFrame, model: Whitening, vec_col: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, over components with variance, by a pass over the rows."""
    mean, scaled, d, varies = np.array([int(s) / model.n for s in model.sums], float), model.scaled(), len(model.sums), model.varies()
    m = len(varies)

    def moments(lists: pa.Array) -> np.ndarray:
        w = (_integers(lists, d) - mean) @ scaled
        return np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))

    found = _summed(taking_part(df, vec_col), vec_col, moments)
    first = np.array([found[i] for i in range(m)]) / model.n
    second = np.array([found[m + i] for i in range(m * m)]).reshape(m, m) / model.n
    off = np.abs(second - np.outer(first, first) - np.eye(m))[np.ix_(varies, varies)]
    return float(off.max(initial=0.0))


def transform(df: DataFrame, model: Whitening, vec_col: str = "embedding") -> DataFrame:
    """The rows that take part with `whitened` (array<double>, a number for each component) and `deviation` (long)."""
    rows = taking_part(df, vec_col).drop("whitened", "deviation")
    at = rows.columns.index(vec_col)
    schema = T.StructType([*rows.schema.fields, T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())])
    n, total, scaled, d = model.n, model.sums, model.scaled(), len(model.sums)
    mean = np.array([int(s) / n for s in total], float)
    largest = max((abs(int(s)) for s in total), default=0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch.column(at), d)
            w = (x - mean) @ scaled
            most = n * int(np.abs(x).max(initial=0)) + largest  # bounds every difference
            if most < 2**62:
                far = n * x - total.astype(np.int64)
                most = int(np.abs(far).max(initial=0))
            if most**2 * max(d, 1) < 2**62:
                deviation = (far * far).sum(axis=1).tolist()
            else:
                exact = (n * x.astype(object) - total) ** 2
                deviation = [s if (s := int(r)) < 2**63 else None for r in exact.sum(axis=1)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * scaled.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(deviation, pa.int64())], [f.name for f in schema])

    return rows.mapInArrow(work, schema)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit(vectors)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, certified boolean")
    error = identity_error(vectors, model)
    shares = F.array(*[F.lit(float(e)) for e in model.explained()])
    certified = F.array(*[F.lit(bool(c)) for c in model.certified])
    rows = transform(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, "at").alias("explained"), F.lit(error).alias("identity_error"), F.get(certified, "at").alias("certified"))
