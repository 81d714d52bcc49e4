"""Directed connectivity of channels in windows: nearest-neighbour transfer entropy and lagged regression.

A window is one row with an array, of bounded length, so its distances and its small system are solved in one place, those of
many windows of one shape together; windows, pairs of channels and sums over them are Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators.arrays import keys, listed, repeated

EULER = 0.5772156649015329
#: Destinations of a row, and squared distances that are held of a channel at once.
TOGETHER, HELD = 8, 1 << 16
#: Windows that are taken apart at once.
WINDOWS = 1_024


def _gathered(windows: DataFrame, by: list[str]) -> DataFrame:
    """(by, entries): the values of each window as one array."""
    return windows.groupBy(*by).agg(F.collect_list(F.struct("channel", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))).alias("entries"))


def _shapes(column: pa.Array) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """(rows, channels, values of (row, channel, place)) of a column of windows' entries: the channels of one length in a window,
    for all rows in which these are the same. Values are in order of place, null ones NaN."""
    row, (channel, pos, value) = listed(column)
    if not len(row):
        return
    names, code = np.unique(np.asarray(channel.to_numpy(zero_copy_only=False), str), return_inverse=True)
    order = np.lexsort((np.asarray(pos), code, row))
    row, code, x = row[order], code[order], np.asarray(value.to_numpy(zero_copy_only=False), float)[order]
    start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])])
    size = np.diff(np.r_[start, len(row)])
    series = np.lexsort((code[start], size, row[start]))  # of a row and length side by side
    start, size = start[series], size[series]
    first = np.flatnonzero(np.r_[True, (row[start][1:] != row[start][:-1]) | (size[1:] != size[:-1])])
    shapes: dict[tuple, list[int]] = {}
    for lo, hi in zip(first, np.r_[first[1:], len(start)]):
        shapes.setdefault((int(size[lo]), *code[start[lo:hi]].tolist()), []).append(lo)
    for (length, *codes), at in shapes.items():
        places = start[np.array(at)[:, None] + np.arange(len(codes))]
        yield row[places[:, 0]], [str(names[c]) for c in codes], x[places[:, :, None] + np.arange(length)]


def squared(x: np.ndarray, at: slice, n: int, dim: int, tau: int) -> np.ndarray:
    """Squared distances of the delay vectors of the places ``at`` to those of the first ``n`` places, from the series itself, or
    from each of an array of series."""
    out = np.zeros((*x.shape[:-1], at.stop - at.start, n))
    for i in range(dim):
        d = x[..., at.start + i * tau : at.stop + i * tau, None] - x[..., None, i * tau : i * tau + n]
        out += d * d
    return out


def _parts(n: int) -> Iterator[slice]:
    """Stretches of places whose distances to all ``n`` are held at once."""
    step = max(1, HELD // max(1, n))
    return (slice(at, min(n, at + step)) for at in range(0, n, step))


def kth_of(squares: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th other distance in rows of squared distances that have a place's own zero among them; infinite if there is
    none."""
    return np.sqrt(np.partition(squares, k, axis=-1)[..., k]) if squares.shape[-1] > k else np.full(squares.shape[:-1], np.inf)


def _some(count: int, n: int) -> Iterator[slice]:
    """Of ``count`` windows those whose squared distances, of ``n`` places each, are held at once: one at least."""
    step = max(1, HELD // max(1, n * n))
    return (slice(at, min(count, at + step)) for at in range(0, count, step))


def entropy(dim: int, logs: np.ndarray, n: int) -> np.ndarray:
    """The nearest-neighbour estimate from the sum of the logarithms of ``n`` points' distances."""
    return dim * (logs / n) + float(np.log(n)) + EULER


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, WINDOWS) for batch in batches for at in range(0, batch.num_rows, WINDOWS))


def kth_distance(windows: DataFrame, by: list[str], k: int = 4, dim: int = 3, tau: int = 10) -> DataFrame:
    """(by, channel, t, r): of every delay vector and its next value in a window, the distance to the ``k``-th nearest other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            for row, names, x in _shapes(batch.column(len(by))):
                n = max(0, x.shape[2] - (dim - 1) * tau - 1)
                if not n:
                    continue
                for some in _some(len(row), n):
                    held = x[some]
                    r = np.concatenate([kth_of(squared(held, at, n, dim, tau) + squared(held[..., (dim - 1) * tau + 1 :], at, n, 1, 1), k) for at in _parts(n)], axis=2)
                    each = len(names) * n
                    yield repeated(batch, len(by), np.repeat(row[some], each), [np.tile(np.repeat(np.array(names, object), n), len(r)), np.tile(np.arange(n, dtype=np.int32), len(r) * len(names)), r.ravel()], [*by, "channel", "t", "r"])

    return _gathered(windows, by).mapInArrow(run, keys(windows, by, "channel string, t int, r double"))


def transfer_entropy(windows: DataFrame, by: list[str], k: int = 4, dim: int = 3, tau: int = 10, together: int = TOGETHER) -> DataFrame:
    """(by, src, dst, value): max(0, H(y, next y) - H(y, x, next y)) for every ordered pair of channels of a window.

    Entropy is by the distance to the ``k``-th other point. Windows too short for ``k`` others give no rows. A row has all
    channels of a window as sources and about ``together`` of them as destinations. Squared distances of joint points are
    the sums of the channels' own, so a channel's are made once and serve all destinations; a stretch of places is held at
    once, so memory grows with a window, not with its square.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            part, every = np.asarray(batch.column(len(by))), batch.column(len(by) + 1)
            # A channel's number among all of its window, of any length.
            place = [{c: i for i, c in enumerate(sorted(set(e)))} for e in _channels(every)] if part.any() else None
            for row, names, x in _shapes(every):
                n = x.shape[2] - (dim - 1) * tau - 1
                if n <= k:
                    continue
                mine = np.array([[place is None or place[r][c] // together == part[r] for c in names] for r in row]) if place is not None else np.ones((len(row), len(names)), bool)
                for some in _some(len(row), n):
                    held, own_of = x[some], mine[some]
                    dsts = np.flatnonzero(own_of.any(0))
                    sums = {(d, s): np.zeros(len(held)) for d in dsts for s in (-1, *range(len(names))) if s != d}
                    for at in _parts(n):
                        near = [squared(held[:, s], at, n, dim, tau) for s in range(len(names))]
                        for d in dsts:
                            own = near[d] + squared(held[:, d, (dim - 1) * tau + 1 :], at, n, 1, 1)
                            for s in (-1, *range(len(names))):
                                if s != d:
                                    sums[d, s] += np.log(kth_of(own if s < 0 else own + near[s], k) + 1e-10).sum(1)
                    for (d, s), total in sums.items():
                        if s >= 0:
                            told = np.flatnonzero(own_of[:, d])
                            value = np.fmax(0.0, entropy(dim + 1, sums[d, -1], n) - entropy(2 * dim + 1, total, n))[told]
                            yield repeated(batch, len(by), row[some][told], [np.full(len(told), names[s], object), np.full(len(told), names[d], object), value], [*by, "src", "dst", "value"])

    parts = F.ceil(F.size(F.array_distinct("entries.channel")) / together).cast("int")
    rows = _gathered(windows, by).select(*by, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"), "entries")
    return rows.mapInArrow(run, keys(windows, by, "src string, dst string, value double"))


def _channels(column: pa.Array) -> list[list[str]]:
    """The channels of each window's entries."""
    return [[e["channel"] for e in window] for window in column.to_pylist()]


def lagged_ols(windows: DataFrame, by: list[str], lags: int = 10) -> DataFrame:
    """(by, src, dst, value): in each window, each channel regressed on ``lags`` values of all channels and a constant; the
    absolute coefficients of a source, summed over its lags.

    A window without a unique solution has the absolute correlation of its channels instead; a constant channel gives null.
    """

    def solved(names: list[str], series: list[np.ndarray]) -> np.ndarray:
        n = min(map(len, series))
        m = np.stack([x[:n] for x in series], 1)
        design = np.column_stack([np.ones(max(0, n - lags))] + [m[lags - k : n - k, c] for c in range(len(names)) for k in range(1, lags + 1)])
        beta, _, rank, _ = np.linalg.lstsq(design, m[lags:], rcond=None) if len(design) else (None, None, -1, None)
        if rank == design.shape[1]:
            return np.abs(beta[1:]).reshape(len(names), lags, len(names)).sum(1)
        with np.errstate(all="ignore"):
            return np.abs(np.atleast_2d(np.corrcoef(m.T)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            held: dict[int, dict[str, np.ndarray]] = {}
            for row, names, x in _shapes(batch.column(len(by))):
                for r, window in zip(row.tolist(), x):
                    held.setdefault(r, {}).update(zip(names, window))
            rows, src, dst, value = [], [], [], []
            for r, series in held.items():
                names = sorted(series)
                edge = solved(names, [series[c] for c in names])
                for i, j in zip(*np.nonzero(~np.eye(len(names), dtype=bool))):
                    rows.append(r), src.append(names[i]), dst.append(names[j]), value.append(None if np.isnan(edge[i, j]) else float(edge[i, j]))
            yield repeated(batch, len(by), np.array(rows, np.int64), [pa.array(src, pa.string()), pa.array(dst, pa.string()), pa.array(value, pa.float64())], [*by, "src", "dst", "value"])

    return _gathered(windows, by).mapInArrow(run, keys(windows, by, "src string, dst string, value double"))


def connectivity_set(parts: dict[str, DataFrame]) -> DataFrame:
    """One edge table of several measures, by name."""
    named = [df.withColumn("measure", F.lit(name)) for name, df in parts.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df)
    return out


def connectivity_grids(edges: DataFrame, by: list[str], channels: list[str]) -> DataFrame:
    """(by, measure, grid): each measure of a window as a matrix, a row for each destination and a column for each source in
    the order of ``channels``; the diagonal and missing edges are 0."""
    held = edges.groupBy(*by, "measure").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\t", "dst", "src"), "value"))).alias("_m"))
    cell = lambda d, s: F.coalesce(F.col("_m")[f"{d}\t{s}"], F.lit(0.0)) if d != s else F.lit(0.0)
    return held.select(*by, "measure", F.array(*[F.array(*[cell(d, s) for s in channels]) for d in channels]).alias("grid"))
