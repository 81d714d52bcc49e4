"""Statistics of series and windows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.operators.ranges import quantiles


def stat_features(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean, variance, deviation, skewness, excess kurtosis (population), root mean square, differential entropy."""
    v = F.col("value")
    var = F.var_pop(v)
    return rows.groupBy(*by).agg(F.avg(v).alias("mean"), var.alias("var"), F.stddev_pop(v).alias("std"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt"), F.sqrt(F.avg(v * v)).alias("rms"), differential_entropy(var).alias("entropy"))


def differential_entropy(var: Column) -> Column:
    return 0.5 * F.log(2 * F.pi() * F.e() * F.when(var == 0, 1e-10).otherwise(var))


def hjorth(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """Activity, mobility and complexity; mobility and complexity are 0 where undefined."""
    w = W.partitionBy(*by).orderBy(at)
    first = rows.withColumn("_d", F.col("value") - F.lag("value").over(w))
    second = first.withColumn("_dd", F.col("_d") - F.lag("_d").over(w))
    v = second.groupBy(*by).agg(F.var_pop("value").alias("activity"), F.var_pop("_d").alias("_v1"), F.var_pop("_dd").alias("_v2"))
    mobility = F.when(F.col("activity") > 0, F.sqrt(F.col("_v1") / F.col("activity"))).otherwise(0.0)
    complexity = F.when((F.col("_v1") > 0) & (F.col("mobility") > 0), F.sqrt(F.col("_v2") / F.col("_v1")) / F.col("mobility")).otherwise(0.0)
    return v.withColumn("mobility", mobility).withColumn("complexity", complexity).drop("_v1", "_v2")


def box_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """Quartiles, mean, and whiskers: the extreme values within 1.5 interquartile ranges of the box."""
    q = quantiles(rows, by, [0.25, 0.5, 0.75]).select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.when(F.col("value").between(F.col("q1") - reach, F.col("q3") + reach), F.col("value"))
    ends = rows.join(q, by).groupBy(*by).agg(F.avg("value").alias("mean"), F.min(inside).alias("low"), F.max(inside).alias("high"))
    return q.join(ends, by)


def correlation_matrix(rows: DataFrame, by: list[str], at: str = "idx") -> DataFrame:
    """(by, src, dst, value): absolute Pearson correlation of every ordered pair of different channels. It is symmetric, so
    each pair is made once and its one number is mirrored."""
    half = channel_pairs(rows, by, at, "src < dst").groupBy(*by, "src", "dst").agg(F.abs(F.corr("x", "y")).alias("value"))
    both = F.explode(F.array(F.struct(F.col("src").alias("s"), F.col("dst").alias("d")), F.struct(F.col("dst").alias("s"), F.col("src").alias("d"))))
    return half.withColumn("_e", both).select(*by, F.col("_e.s").alias("src"), F.col("_e.d").alias("dst"), "value")


def channel_pairs(rows: DataFrame, by: list[str], at: str = "idx", which: str = "src <> dst") -> DataFrame:
    """(by, at, src, dst, x, y): values of all ordered pairs of different channels, or of those in ``which``, at the same place.
    The channels of a place are one array, so rows that lie together by ``by`` are not shuffled, and others once."""
    known = reduce(and_, [F.col(c).isNotNull() for c in (*by, at)])
    held = rows.where(known).groupBy(*by, at).agg(F.collect_list(F.struct("channel", "value")).alias("_all"))
    one = held.select(*by, at, F.explode("_all").alias("_a"), "_all")
    both = one.select(*by, at, "_a", F.explode("_all").alias("_b"))
    return both.select(*by, at, F.col("_a.channel").alias("src"), F.col("_a.value").alias("x"), F.col("_b.channel").alias("dst"), F.col("_b.value").alias("y")).where(which)


# The order of the bands in a feature vector.
BAND_ORDER = ("delta", "theta", "alpha", "beta", "gamma")


def feature_vector(stats: DataFrame, hjorth_: DataFrame, entropy: DataFrame, bands: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, x): the features of a window in their fixed order, from tables that have a row for each window, but for ``bands``,
    with one for each band, and ``nodes``, with one for each wavelet node. A band that a window lacks counts 0."""
    power = bands.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("band", "power"))).alias("_bands"))
    packet = nodes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("node", "mean", "std", "energy"))).alias("_nodes"))
    every = stats.drop("entropy").join(hjorth_, by).join(entropy.select(*by, "entropy"), by).join(power, by).join(packet, by)
    named = [F.col(c) for c in ("mean", "var", "std", "skew", "kurt", "activity", "mobility", "complexity", "entropy", "rms")]
    each = [F.coalesce(F.col("_bands")[b], F.lit(0.0)) for b in BAND_ORDER]
    packed = F.flatten(F.transform("_nodes", lambda n: F.array(n["mean"], n["std"], n["energy"])))
    return every.select(*by, F.concat(F.array(*named, *each), packed).alias("x"))
