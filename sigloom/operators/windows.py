"""Windows and sequence operators over long signals (recording_id, channel, idx, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.operators.ranges import ranged, running

SERIES = ("recording_id", "channel")


def sliding_windows(signal: DataFrame, size: int, step: int, length: str | None = None) -> DataFrame:
    """Rows with window_id and pos for every full window that holds them; a partial tail is dropped. A sample is in
    at most ceil(size / step) windows, so rows grow by that factor.

    ``length`` names a column with the series' number of samples, which goes: whoever numbers samples knows it, and then
    nothing is shuffled here. Without it the number is an aggregate that is joined back.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - size + 1) / step)).cast("int")
    last = F.least(F.floor(F.col("idx") / step), F.floor((F.col("_n") - size) / step)).cast("int")
    if length:
        each, kept = signal.withColumnRenamed(length, "_n"), [c for c in signal.columns if c != length]
    else:
        each, kept = signal.join(signal.groupBy(*SERIES).agg((F.max("idx") + 1).alias("_n")), list(SERIES)), signal.columns
    each = each.withColumn("window_id", F.explode(F.when(first <= last, F.sequence(first, last))))
    return each.withColumn("pos", F.col("idx") - F.col("window_id") * step).select(*kept, "window_id", "pos")


def tumbling_windows(signal: DataFrame, size: int, length: str | None = None) -> DataFrame:
    return sliding_windows(signal, size, size, length)


def difference(signal: DataFrame, order: int = 1, by: tuple[str, ...] = SERIES, at: str = "idx") -> DataFrame:
    """``value`` replaced by its difference of the given order; the first rows, which have none, go."""
    w = W.partitionBy(*by).orderBy(at)
    for _ in range(order):
        signal = signal.withColumn("value", F.col("value") - F.lag("value").over(w)).where(F.col("value").isNotNull())
    return signal


def delay_embedding(signal: DataFrame, dim: int = 3, tau: int = 10) -> DataFrame:
    """(..., x0 .. x{dim-1}, target): values tau apart and the one after; rows without all delays are dropped."""
    w = W.partitionBy(*SERIES).orderBy("idx")
    names = [f"x{i}" for i in range(dim)]
    found = signal.withColumns({c: F.lead("value", i * tau).over(w) for i, c in enumerate(names)} | {"target": F.lead("value", (dim - 1) * tau + 1).over(w)})
    return found.where(F.col(names[-1]).isNotNull()).drop("value")


def consecutive_blocks(windows: DataFrame, k: int, by: tuple[str, ...] = SERIES) -> DataFrame:
    """Rows of each run of ``k`` windows in a row (window_id), with block_id and place; short runs are dropped."""
    last = F.max("window_id").over(W.partitionBy(*by))
    each = windows.withColumn("_last", last).withColumn("block_id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("window_id") - k + 1), F.col("window_id"))))
    return each.where(F.col("block_id") + k - 1 <= F.col("_last")).withColumn("place", F.col("window_id") - F.col("block_id")).drop("_last")


def crop_range(signal: DataFrame, start: int, stop: int) -> DataFrame:
    return signal.where((F.col("idx") >= start) & (F.col("idx") < stop)).withColumn("idx", F.col("idx") - start)


def min_length(signal: DataFrame, least: int = 30) -> DataFrame:
    """Series of ``least`` samples or more."""
    n = F.count(F.lit(1)).over(W.partitionBy(*SERIES))
    return signal.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def running_mean(history: DataFrame, by: list[str], at: str, value: str, weight: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    return history.withColumn("running", F.sum(F.col(value) * F.col(weight)).over(w) / F.sum(weight).over(w))


def running_best(history: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """``is_best``: strictly lower than everything before it."""
    before = F.min(value).over(W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, -1))
    return history.withColumn("is_best", before.isNull() | (F.col(value) < before))


def latest(history: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    return history.groupBy(*by).agg(F.max_by(value, at).alias("latest"))


def patience_stop(history: DataFrame, by: list[str], at: str, value: str, patience: int, min_delta: float = 0.0, mode: str = "min") -> DataFrame:
    """(by, stop_at, best): the first place whose count of steps without enough gain reaches ``patience``; null if none.

    A step gains if it betters the best by more than ``min_delta``; only then does the best move and the count restart.
    """
    sign = 1.0 if mode == "min" else -1.0
    steps = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), (F.col(value) * sign).alias("v"))))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("count"), F.lit(None).cast("long").alias("stop"))

    def step(s: Column, x: Column) -> Column:
        gain = s["best"].isNull() | (x["v"] < s["best"] - min_delta)
        count = F.when(gain, F.lit(0)).otherwise(s["count"] + 1)
        stop = F.when(s["stop"].isNull() & (count >= patience), x["at"].cast("long")).otherwise(s["stop"])
        return F.struct(F.when(gain, x["v"]).otherwise(s["best"]).alias("best"), count.alias("count"), stop.alias("stop"))

    return history.groupBy(*by).agg(F.aggregate(steps, start, step).alias("s")).select(*by, F.col("s.stop").alias("stop_at"), (F.col("s.best") * sign).alias("best"))


def ecdf(both: DataFrame, by: list[str], parts: int | None = None) -> DataFrame:
    """(by, value, f1, f2): the distribution functions of two samples (side 1 and 2) at each of their values.

    Counts of distinct values are summed within ranges of values and shifted by the ranges' totals. Ranges hold nearly
    equal numbers of distinct values, so no task orders a whole group, wherever its values lie.
    """
    each = both.groupBy(*by, "value").agg(F.sum((F.col("side") == 1).cast("long")).alias("n1"), F.sum((F.col("side") == 2).cast("long")).alias("n2"))
    run = running(ranged(each, by, ["value"], parts), by, [F.col("value")], {"c1": "n1", "c2": "n2"})
    return run.select(*by, "value", (F.col("c1") / F.col("c1_all")).alias("f1"), (F.col("c2") / F.col("c2_all")).alias("f2"))
