"""Original against augmented data: amplitude, correlation, spectrum, distribution and kernel distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.operators.windows import ecdf
from sigloom.scratch import table

#: Vectors of a tile of kernels.
TILE = 4_096


def amplitude_check(pairs: DataFrame, by: list[str], limit: float = 3.0) -> DataFrame:
    """(by, ratio, passed): deviation of ``b`` over that of ``a``."""
    ratio = F.stddev_pop("b") / F.stddev_pop("a")
    return pairs.groupBy(*by).agg(ratio.alias("ratio")).withColumn("passed", F.abs(F.col("ratio") - 1) < limit)


def pair_correlation(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by).agg(F.corr("a", "b").alias("r"), F.abs(F.avg("a") - F.avg("b")).alias("mean_shift"))


# Bands in Hz whose power is compared.
RATIO_BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0)}


def _by_sample(pairs: DataFrame, run, columns: str) -> DataFrame:
    """``run`` of each sample's pairs, in order of channel and place. A sample is one group of bounded length."""
    kind = pairs.schema["sample_id"].dataType.simpleString()

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        code, names = pd.factorize(pdf["channel"], sort=True)
        pdf = pdf.take(np.lexsort((pdf["idx"].to_numpy(), np.where(code < 0, len(names), code))))
        return pd.DataFrame([{"sample_id": pdf["sample_id"].iloc[0], **run(pdf)}])

    return pairs.select("sample_id", "channel", "idx", "a", "b").groupBy("sample_id").applyInPandas(group, f"sample_id {kind}, {columns}")


def _spectra(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Fourier magnitudes of both sides of a whole sample, channel by channel, and their correlation."""
    a, b = (np.abs(np.fft.rfft(pdf[c].to_numpy(float))) for c in ("a", "b"))
    with np.errstate(all="ignore"):
        return a, b, float(np.corrcoef(a, b)[0, 1])


def spectral_similarity(pairs: DataFrame, fs: float = 128.0, limit: float = 0.7) -> DataFrame:
    """(sample_id, r, passed, one ratio for each band) of ``pairs`` (sample_id, channel, idx, a, b).

    Both sides are whole samples, channel by channel; r is the correlation of their Fourier magnitudes, a ratio is the
    power of b over that of a in a band. Samples have unlike lengths and transforms of thousands of values, so a sample is
    one group.
    """

    def run(pdf: pd.DataFrame) -> dict:
        a, b, r = _spectra(pdf)
        freq = np.fft.rfftfreq(len(pdf), 1 / fs)
        at = {name: (freq >= low) & (freq < high) for name, (low, high) in RATIO_BANDS.items()}
        return {"r": r, "passed": r >= limit} | {name: (b[k] ** 2).sum() / ((a[k] ** 2).sum() + 1e-10) for name, k in at.items()}

    return _by_sample(pairs, run, "r double, passed boolean, " + ", ".join(f"{b} double" for b in RATIO_BANDS))


def _ks_passes(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two samples of one size may have one distribution, by the asymptotic p-value of ``kolmogorov_p``."""
    every, n = np.concatenate((a, b)), len(a)
    d = np.abs(np.searchsorted(np.sort(a), every, "right") - np.searchsorted(np.sort(b), every, "right")).max() / n
    en, k = np.sqrt(n / 2), np.arange(1, 101)
    x = (en + 0.12 + 0.11 / en) * d
    return bool(x < 0.2 or 2 * (np.where(k % 2, 1.0, -1.0) * np.exp(-2 * k * k * x * x)).sum() > 0.05)


def _kernel_distance(a: np.ndarray, b: np.ndarray, gamma: float = 1.0) -> float:
    """Kernel distance of the rows of two matrices."""
    mean = lambda x, y: float(np.mean([np.exp(-gamma * ((y - r) ** 2).sum(1)) for r in x]))
    return float(np.sqrt(max(0.0, mean(a, a) + mean(b, b) - 2 * mean(a, b))))


def sample_checks(pairs: DataFrame, limit: float = 3.0, similar: float = 0.7, channels: int = 100) -> DataFrame:
    """(sample_id, amplitude, spectral, distribution, kernel, mmd): the four checks of each original and its copy, over all
    channels and the whole of both, in one pass.

    The kernel check takes channels as vectors, the first ``channels`` of them as the rule has it, and passes under 0.5.
    """

    def run(pdf: pd.DataFrame) -> dict:
        a, b = pdf["a"].to_numpy(float), pdf["b"].to_numpy(float)
        rows = np.array_split(np.stack((a, b)), np.flatnonzero(np.diff(pd.factorize(pdf["channel"])[0])) + 1, axis=1)[:channels]
        mmd = _kernel_distance(*(np.stack([r[k] for r in rows]) for k in (0, 1)))
        with np.errstate(all="ignore"):
            amplitude = abs(b.std() / a.std() - 1) < limit
        return {"amplitude": bool(amplitude), "spectral": _spectra(pdf)[2] >= similar, "distribution": _ks_passes(a, b), "kernel": mmd < 0.5, "mmd": mmd}

    return _by_sample(pairs, run, "amplitude boolean, spectral boolean, distribution boolean, kernel boolean, mmd double")


CHECKS = ["amplitude", "spectral", "distribution", "kernel"]


def kolmogorov_p(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """The asymptotic p-value of a two-sample distance."""
    en = F.sqrt(n1 * n2 / (n1 + n2))
    x = (en + 0.12 + 0.11 / en) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0)))


def ks_two_sample(both: DataFrame, by: list[str]) -> DataFrame:
    """(by, d, p, passed, mean1, mean2, var_ratio) of sides 1 and 2."""
    d = ecdf(both, by).groupBy(*by).agg(F.max(F.abs(F.col("f1") - F.col("f2"))).alias("d"))
    one, two = F.when(F.col("side") == 1, F.col("value")), F.when(F.col("side") == 2, F.col("value"))
    m = both.groupBy(*by).agg(F.count(one).alias("n1"), F.count(two).alias("n2"), F.avg(one).alias("mean1"), F.avg(two).alias("mean2"), (F.var_pop(two) / F.var_pop(one)).alias("var_ratio"))
    out = d.join(m, by) if by else d.crossJoin(m)
    return out.withColumn("p", kolmogorov_p(F.col("d"), F.col("n1"), F.col("n2"))).withColumn("passed", F.col("p") > 0.05)


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d)


def _first_vectors(vectors: DataFrame, by: list[str], limit: int | None) -> DataFrame:
    if limit is None:
        return vectors
    order = W.partitionBy(*by, "side").orderBy("sample_id")
    return vectors.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")


def kernel_sum(x: np.ndarray, y: np.ndarray, gamma: float, rows: int = 512) -> float:
    """The sum of the kernels of all rows of one matrix with all of another, by products of matrices."""
    size, total = (y * y).sum(1), 0.0
    for at in range(0, len(x), rows):
        some = x[at : at + rows]
        d = (some * some).sum(1)[:, None] + size - 2 * (some @ y.T)
        total += float(np.exp(-gamma * np.maximum(d, 0)).sum())
    return total


def kernel_means(vectors: DataFrame, by: list[str], gamma: float = 1.0, limit: int | None = 100, tile: int = TILE) -> DataFrame:
    """(by, s, t, n, k): the number and the mean of the kernels of all pairs within and between sides 1 and 2.

    The rule compares the first ``limit`` vectors of each side by id. Without a limit all pairs are compared: each side is
    dealt in tiles of about ``tile`` vectors, two tiles meet in a group as matrices, and one number comes back. The work is
    the square of a group of ``by``, what is shuffled that square over ``tile``, and no task holds more than two tiles.
    """
    some = _first_vectors(vectors, by, limit).select(*by, F.col("side").cast("int").alias("side"), F.col("x").cast("array<double>").alias("x"))
    some = table(some.withColumn("_h", F.xxhash64("x", F.monotonically_increasing_id())))
    count = lambda k: F.ceil(F.count(F.when(F.col("side") == k, 1)) / tile).cast("int")
    parts = some.groupBy(*by).agg(count(1).alias("_p1"), count(2).alias("_p2")) if by else some.agg(count(1).alias("_p1"), count(2).alias("_p2"))
    dealt = some.join(parts, by) if by else some.crossJoin(F.broadcast(parts))
    own = F.pmod("_h", F.when(F.col("side") == 1, F.col("_p1")).otherwise(F.col("_p2"))).cast("int")
    dealt = dealt.withColumn("_i", own)
    span = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    tiles = lambda t, lo, hi: F.transform(span(lo, hi), lambda j: F.struct(F.lit(t).alias("t"), j.alias("j")))
    zero, i = F.lit(0), F.col("_i")
    # A tile meets itself, the later ones of its side, and, from side 1, all of side 2: each pair of tiles once.
    ahead = F.when(F.col("side") == 1, F.concat(tiles(1, i, F.col("_p1") - 1), tiles(2, zero, F.col("_p2") - 1))).otherwise(tiles(2, i, F.col("_p2") - 1))
    behind = F.when(F.col("side") == 2, F.concat(tiles(1, zero, F.col("_p1") - 1), tiles(2, zero, i))).otherwise(tiles(1, zero, i))
    keys = [*by, "s", "i", "t", "j"]
    one = dealt.withColumn("_e", F.explode(ahead)).select(*by, F.col("side").alias("s"), F.col("_i").alias("i"), F.col("_e.t").alias("t"), F.col("_e.j").alias("j"), "x")
    again = dealt.select(*[F.col(c).alias(c) for c in dealt.columns])  # columns of their own, as both sides come from one table
    two = again.withColumn("_e", F.explode(behind)).select(*by, F.col("_e.t").alias("s"), F.col("_e.j").alias("i"), F.col("side").alias("t"), F.col("_i").alias("j"), "x")

    def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        s, i, t, j = key[-4:]
        total = kernel_sum(np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy()), gamma) if len(a) and len(b) else 0.0
        twice = 2 if s == t and i != j else 1
        return pd.DataFrame([[*key[:-4], s, t, len(a) * len(b) * twice, total * twice]], columns=[*by, "s", "t", "n", "total"])

    kinds = "".join(f"{b} {some.schema[b].dataType.simpleString()}, " for b in by)
    met = one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInPandas(meet, f"{kinds}s int, t int, n long, total double")
    sums = met.groupBy(*by, "s", "t").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("k")).where("n > 0")
    mirrored = F.when(F.col("s") == F.col("t"), F.array(F.struct("s", "t"))).otherwise(F.array(F.struct("s", "t"), F.struct(F.col("t").alias("s"), F.col("s").alias("t"))))
    return sums.withColumn("_e", F.explode(mirrored)).select(*by, "_e.s", "_e.t", "n", "k")


def mmd_rbf(vectors: DataFrame, gamma: float = 1.0, limit: int | None = 100, by: list[str] | None = None) -> DataFrame:
    """(by, mmd): kernel distance of sides 1 and 2; the rule has the cap of ``limit`` vectors a side, None lifts it."""
    total = F.sum(F.when(F.col("s") == F.col("t"), F.col("k")).otherwise(-F.col("k")))
    return kernel_means(vectors, by or [], gamma, limit).groupBy(*(by or [])).agg(F.sqrt(F.greatest(total, F.lit(0.0))).alias("mmd"))


def mmd_linear(vectors: DataFrame) -> DataFrame:
    """Distance of the two sides' mean vectors, over all rows and without pairs."""
    each = vectors.select("side", F.posexplode("x").alias("i", "v")).groupBy("i").agg((F.avg(F.when(F.col("side") == 1, F.col("v"))) - F.avg(F.when(F.col("side") == 2, F.col("v")))).alias("d"))
    return each.agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("mmd"))


def quality_score(checks: DataFrame, names: list[str]) -> DataFrame:
    """``score``: a quarter for each passed check; ``accepted`` from one half."""
    total = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in names), F.lit(0)) * 0.25
    return checks.withColumn("score", total).withColumn("accepted", F.col("score") >= 0.5)


def pass_rates(scored: DataFrame, names: list[str]) -> DataFrame:
    """(n, pass_rate, mean_score, mean_mmd, <check>_rate...) over all samples."""
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("accepted").cast("double")).alias("pass_rate"), F.avg("score").alias("mean_score"), F.avg("mmd").alias("mean_mmd"), *[F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in names])
