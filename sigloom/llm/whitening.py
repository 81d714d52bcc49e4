"""Whitening of embeddings by an incremental eigendecomposition.

Every partition follows the spectrum of its own vectors: a vector changes their scatter by a centred rank-one matrix, so the
new eigenvalues are the roots of a secular equation and the new eigenvectors follow from them; what an update does not
move is deflated. Spectra are combined in a tree, the eigenpairs of one and the difference of the means going into the
other as rank-one updates. A last pass over the vectors projects their exact covariance on the combined basis and solves
the small projected problem (Rayleigh-Ritz), which makes up for what thousands of updates have lost in digits. Vectors
never move: tasks return sums of the size of the dimension squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.scratch import mark, release, table

#: Steps and shift of the whole numbers that stand for entries, and the size at which these end.
STEPS, SHIFT, LARGEST = 64, 1_000_000, 2**60
#: Spectra that one task combines, components returned, tries for a root, and passes of refinement at most.
FAN, COMPONENTS, TRIES, PASSES = 8, 32, 80, 3
#: Relative size beneath which an update counts as nothing, and eigenvalues as none.
EPS = np.finfo(float).eps
#: Largest entry of the whitened covariance minus the identity that needs no further pass.
CLOSE = 1e-9


class Spectrum(NamedTuple):
    """Of ``n`` vectors with this mean: eigenvalues of their scatter (rising) and its eigenvectors, as columns."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def roots(poles: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, poles minus eigenvalues with a row for each eigenvalue) of diag(poles) + z z', for rising distinct poles.

    The k-th root lies between the k-th pole and the next. It is told from the nearer of the two, so that its distance to
    both keeps its digits. All roots are sought at once: the secular function is replaced by one with the two poles beside
    a root and the same value and slopes, whose root is the next try; a try that leaves the bracket is its middle.
    """
    n = len(poles)
    squares, k = z * z, np.arange(n)
    total = squares.sum()
    gap = np.append(np.diff(poles), total)
    with np.errstate(divide="ignore", invalid="ignore"):  # a gap too small to be halved
        above = 1 + (squares / (poles - (poles + gap / 2)[:, None])).sum(1) < 0  # the root is in the upper half
    upper = above & (k < n - 1)  # there the next pole is the nearer
    apart = poles - poles[k + upper][:, None]
    lo, hi = np.where(upper, -gap / 2, np.where(above, gap / 2, 0)), np.where(upper, 0, np.where(above, gap, gap / 2))
    below = np.tri(n)
    left, right = apart[k, k], np.append(apart[k[:-1], k[1:]], 0.0)
    right[-1] = left[-1] + total  # behind the last pole a place that no root reaches
    at = (lo + hi) / 2
    for _ in range(TRIES):
        part = 1 / (apart - at[:, None])
        terms = squares * part
        under = terms * below
        f_under, f = under.sum(1), 1 + terms.sum(1)
        low = f < 0
        lo, hi = np.where(low, at, lo), np.where(low, hi, at)
        done = (np.abs(f) <= 16 * EPS * (f - 2 * f_under)) | (hi - lo <= 2 * EPS * np.abs(at))
        if done.all():
            break
        slope, slope_under = np.einsum("ij,ij->i", terms, part), np.einsum("ij,ij->i", under, part)
        d, e = left - at, right - at
        a = (d + e) * f - d * e * slope
        b, c = d * e * f, f - d * slope_under - e * (slope - slope_under)
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            tried = at + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        tried = np.where((tried > lo) & (tried < hi), tried, (lo + hi) / 2)
        at = np.where(done, at, tried)
    return poles[k + upper] + at, apart - at[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of V diag(values) V' + x x'.

    Deflated are directions in which ``x`` has next to no part, and, of eigenvalues next to equal, all but one, after a
    reflection that turns their space so that one vector takes the whole part.
    """
    z = x @ vectors
    size = float(z @ z)
    small = 8 * EPS * max(float(values[-1]), size)
    if size <= small * EPS:
        return values, vectors
    vectors = vectors.copy()
    cuts = np.flatnonzero(np.diff(values) > small) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]):
        part = z[lo:hi]
        whole = float(np.sqrt(part @ part))
        if hi - lo > 1 and whole > 0:
            mirror = part.copy()
            mirror[-1] += np.copysign(whole, part[-1])
            turned = -np.copysign(whole, part[-1])
            own = vectors[:, lo:hi]
            vectors[:, lo:hi] = own - np.outer(own @ mirror, mirror) * (2 / (mirror @ mirror))
            z[lo:hi] = 0
            z[hi - 1] = turned
    moved = np.flatnonzero(np.abs(z) * np.sqrt(size) > small)
    if not len(moved):
        return values, vectors
    poles = values[moved]
    new, apart = roots(poles, z[moved])
    # The z for which these roots are exact (Loewner): its eigenvectors are orthogonal however the roots were rounded.
    steps = poles - poles[:, None]
    np.fill_diagonal(steps, 1)
    exact = np.exp((np.log(np.abs(apart)).sum(0) - np.log(np.abs(steps)).sum(0)) / 2) * np.sign(z[moved])
    mix = exact / apart
    mix /= np.linalg.norm(mix, axis=1, keepdims=True)
    values = values.copy()
    values[moved], vectors[:, moved] = new, vectors[:, moved] @ mix.T
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def empty(size: int) -> Spectrum:
    return Spectrum(0, np.zeros(size), np.zeros(size), np.eye(size))


def add(s: Spectrum, x: np.ndarray) -> Spectrum:
    """``s`` with one more vector: the scatter gains n / (n + 1) times the square of its distance to the mean."""
    apart = x - s.mean
    return Spectrum(s.n + 1, s.mean + apart / (s.n + 1), *rank_one(s.values, s.vectors, apart * np.sqrt(s.n / (s.n + 1))))


def combine(s: Spectrum, t: Spectrum) -> Spectrum:
    """The spectrum of both: a rank-one update for each eigenpair of ``t``, the largest first, and one for the means."""
    if not s.n or not t.n:
        return t if not s.n else s
    n, apart = s.n + t.n, t.mean - s.mean
    values, vectors = s.values, s.vectors
    for k in np.argsort(-t.values):
        if t.values[k] > 0:
            values, vectors = rank_one(values, vectors, t.vectors[:, k] * np.sqrt(t.values[k]))
    values, vectors = rank_one(values, vectors, apart * np.sqrt(s.n * t.n / n))
    return Spectrum(n, s.mean + apart * (t.n / n), values, vectors)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): of each vector without null and non-finite entries floor(64 c) + 1,000,000 for its entries c as doubles.

    Vectors of another length than the commonest have no part in a common covariance and are left out, empty ones too;
    entries beyond 2^54 count as that.
    """
    c = F.col("v")
    x = F.transform(c, lambda e: F.floor(F.greatest(F.least(e * STEPS, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))) + SHIFT)
    sound = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    found = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(c.isNotNull() & sound)
    size = found.where(F.size("v") > 0).groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return found.where(F.size("v") == (size["size"] if size else -1)).select("vec_id", x.alias("x"))


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and each dimension's sum, exact: high and low halves are summed apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), np.int64)
                some = [int(h) * 2**32 + int(lo) for h, lo in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))]
                n, totals = n + len(x), some if totals is None else [a + b for a, b in zip(totals, some)]
        if totals:
            values = [n, *totals]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([str(v) for v in values])], ["place", "total"])

    total = F.sum(F.col("total").cast("decimal(38,0)"))
    got = rows.select("x").mapInArrow(run, "place int, total string").groupBy("place").agg(total.alias("total")).collect()  # a row a dimension
    values = [int(r.total) for r in sorted(got, key=lambda r: r.place)]
    return (values[0], values[1:]) if values else (0, [])


def _spectra(rows: DataFrame, centre: np.ndarray) -> DataFrame:
    """(part, n, mean, axes): the spectrum of each partition's vectors less ``centre``; axes has the eigenvalues first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s = empty(len(centre))
        for batch in batches:
            for x in _matrix(batch.column(0), np.int64) - centre:
                s = add(s, x.astype(float))
        if s.n:
            yield _packed(TaskContext.get().partitionId(), s)

    return rows.select("x").mapInArrow(run, "part long, n long, mean array<double>, axes array<double>")


def _packed(part: int, s: Spectrum) -> pa.RecordBatch:
    axes = np.concatenate((s.values, s.vectors.ravel()))
    columns = [pa.array([part], pa.int64()), pa.array([s.n], pa.int64()), pa.array([s.mean.tolist()], pa.list_(pa.float64())), pa.array([axes.tolist()], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, ["part", "n", "mean", "axes"])


def _unpacked(n: int, mean: list[float], axes: list[float]) -> Spectrum:
    d = len(mean)
    return Spectrum(n, np.array(mean), np.array(axes[:d]), np.array(axes[d:]).reshape(d, d))


def combined(rows: DataFrame, centre: np.ndarray, fan: int = FAN) -> Spectrum:
    """The spectrum of all ``rows``, ``fan`` partitions' spectra becoming one in a task, round after round."""

    def fold(got: pa.Table) -> pa.Table:
        s = empty(len(centre))
        for r in sorted(got.to_pylist(), key=lambda r: r["part"]):
            s = combine(s, _unpacked(r["n"], r["mean"], r["axes"]))
        return pa.Table.from_batches([_packed(got["part"][0].as_py() // fan, s)])

    spectra = table(_spectra(rows, centre))
    while (most := spectra.agg(F.max("part")).first()[0]) > 0:
        spectra = table(spectra.groupBy(F.floor(F.col("part") / fan).alias("_group")).applyInArrow(fold, "part long, n long, mean array<double>, axes array<double>"))
        if most < fan:
            break
    r = spectra.first()  # one row, of the dimension squared
    return _unpacked(r.n, r.mean, r.axes)


def moments(rows: DataFrame, centre: np.ndarray, rest: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, mean of products) of the vectors less ``centre`` and ``rest`` along the columns of ``basis``: a small matrix a
    task, summed entry by entry."""
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k + 1, k)), 0
        for batch in batches:
            y = (_matrix(batch.column(0), np.int64) - centre - rest) @ basis
            total[:k] += y.T @ y
            total[k] += y.sum(0)
            n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size + 1)), pa.array(np.append(total.ravel(), n))], ["place", "value"])

    got = rows.select("x").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    flat = np.zeros(k * (k + 1) + 1)
    flat[np.asarray(got["place"])] = np.asarray(got["value"])
    total = flat[:-1].reshape(k + 1, k) / flat[-1]
    return total[k], total[:k]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2 of each row, exact; null beyond what a long holds."""
    base = [s // n for s in sums]
    near, rest = x - np.array(base, np.int64), [s - n * b for s, b in zip(sums, base)]
    if n * (float(np.abs(near).max(initial=0)) + 1) < np.sqrt(2.0**63 / max(1, x.shape[1])):
        y = near * n - np.array(rest, np.int64)
        return (y * y).sum(1).tolist()
    exact = (sum((n * int(e) - r) ** 2 for e, r in zip(row, rest)) for row in near.tolist())
    return [v if v < 2**63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector: str = "embedding", fan: int = FAN) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable vector and each component.

    ``whitened`` is the vector less the mean along a unit eigenvector of the covariance (divisor n) over the root of its
    eigenvalue, ``explained`` that eigenvalue's share of the trace, ``identity_error`` the largest entry of the whitened
    covariance minus the identity. Entries are whole numbers as in ``whole_numbers``, which says which vectors have no
    part. A null id stays null, repeated rows count and return as often as they come, other columns are ignored. Equal
    eigenvalues are in any order, their vectors orthogonal. There are as many components as dimensions at most, and
    none for an eigenvalue of zero: equal vectors alone, or an empty table, give no rows. A deviation that no long
    holds is null. The work is the dimension cubed for each vector.
    """
    spark, schema = vectors.sparkSession, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_numbers(vectors, id_col, vector)
    n, sums = exact_sums(rows)
    if not n:
        return spark.createDataFrame([], schema)
    centre = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])  # the mean is centre + rest
    since = mark(spark)
    basis, values = combined(rows, centre, fan).vectors, np.zeros(0)
    release(spark, since)
    for _ in range(PASSES):
        mean, products = moments(rows, centre, rest, basis)
        covariance = products - np.outer(mean, mean)
        trace = float(np.trace(covariance))
        values, turn = np.linalg.eigh(covariance)
        values, basis = values[::-1], np.linalg.qr(basis @ turn[:, ::-1])[0]
        k = min(components, int((values > len(values) * EPS * max(values[0], 0)).sum()))
        if not k:
            return spark.createDataFrame([], schema)
        scaled = basis[:, :k] / np.sqrt(values[:k])
        mean, products = moments(rows, centre, rest, scaled)
        error = float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())
        if error < CLOSE:
            break
    explained = values[:k] / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                x, m = _matrix(some.column(1), np.int64), some.num_rows
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [some.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(deviations(x, n, sums), pa.int64()).take(each), pa.array(((x - centre - rest) @ scaled).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
