"""Shapes of signals: padding, cropping, resampling, grids and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.operators.windows import SERIES


def _lengths(signal: DataFrame) -> DataFrame:
    return signal.groupBy(*SERIES).agg((F.max("idx") + 1).alias("_n"))


def pad_channels(signal: DataFrame, channels: list[str]) -> DataFrame:
    """Every recording with all ``channels``, missing ones zero at each place it has."""
    spots = signal.select("recording_id", "idx").distinct().withColumn("channel", F.explode(F.array(*map(F.lit, channels))))
    return spots.join(signal, ["recording_id", "idx", "channel"], "left").withColumn("value", F.coalesce("value", F.lit(0.0))).select("recording_id", "channel", "idx", "value")


def fit_length(signal: DataFrame, n: int) -> DataFrame:
    """Series of ``n`` values: longer ones cropped in the middle, shorter ones with zeros at their end."""
    total = F.max("idx").over(W.partitionBy(*SERIES)) + 1
    start = F.when(total > n, F.floor((total - n) / 2)).otherwise(0)
    kept = signal.withColumn("_n", total).withColumn("idx", (F.col("idx") - start).cast("int")).where(F.col("idx").between(0, n - 1))
    short = kept.where((F.col("idx") == 0) & (F.col("_n") < n))
    zeros = short.select(*SERIES, F.explode(F.sequence(F.col("_n").cast("int"), F.lit(n - 1))).alias("idx"), F.lit(0.0).alias("value"))
    return kept.select(*SERIES, "idx", "value").unionByName(zeros)


def resample_linear(signal: DataFrame, n: int, length: str | None = None, following: str | None = None) -> DataFrame:
    """``n`` values at equal steps from the first to the last, linearly between neighbours.

    A segment between two neighbours makes the values within it, so a series is never gathered or joined. ``length`` and
    ``following`` name columns with the series' number of samples and its next value (null for the last): whoever numbers
    samples knows them, and then series are neither sorted nor shuffled here.
    """
    w = W.partitionBy(*SERIES)
    total = F.col(length) if length else F.max("idx").over(w) + 1
    step = (F.col("_n") - 1) / F.lit(float(n - 1))
    each = signal.withColumns({"_n": total, "_next": F.col(following) if following else F.lead("value").over(w.orderBy("idx"))})
    low, high = F.ceil(F.col("idx") / step), F.ceil((F.col("idx") + 1) / step) - 1
    spots = F.when(F.col("_next").isNull(), F.array(F.lit(n - 1))).when(low <= high, F.sequence(low.cast("int"), high.cast("int")))
    out = each.withColumn("_at", F.explode(spots)).withColumn("_p", F.col("_at") * step - F.col("idx"))
    value = F.when(F.col("_next").isNull(), F.col("value")).otherwise(F.col("value") * (1 - F.col("_p")) + F.col("_next") * F.col("_p"))
    return out.where(F.col("_next").isNull() | (F.col("_at") < n - 1)).select(*SERIES, F.col("_at").alias("idx"), value.alias("value"))


def center_crop(signal: DataFrame, n: int) -> DataFrame:
    """The middle ``n`` values; a shorter series is an error."""
    total = F.max("idx").over(W.partitionBy(*SERIES)) + 1
    start = F.when(total < n, F.raise_error(F.lit("series shorter than the crop"))).otherwise(F.floor((total - n) / 2)).cast("int")
    return signal.withColumn("idx", F.col("idx") - start).where(F.col("idx").between(0, n - 1))


def edge_pad(signal: DataFrame, n: int) -> DataFrame:
    """``n`` values, the first and last repeated around the series; a longer series is an error."""
    total = F.max("idx").over(W.partitionBy(*SERIES)) + 1
    each = signal.withColumn("_n", F.when(total > n, F.raise_error(F.lit("series longer than the padding"))).otherwise(total).cast("int"))
    left = F.floor((n - F.col("_n")) / 2).cast("int")
    low = F.when(F.col("idx") == 0, F.lit(0)).otherwise(F.col("idx") + left)
    high = F.when(F.col("idx") == F.col("_n") - 1, F.lit(n - 1)).otherwise(F.col("idx") + left)
    return each.withColumn("_at", F.explode(F.sequence(low, high))).select(*SERIES, F.col("_at").alias("idx"), "value")


def circular_shift(signal: DataFrame, k: Column) -> DataFrame:
    n = F.max("idx").over(W.partitionBy(*SERIES)) + 1
    return signal.withColumn("idx", F.pmod(F.col("idx") + k, n).cast("int"))


def segment_of(idx: Column, n: Column, segments: int) -> Column:
    """The segment of a place: equal lengths, the last takes the rest."""
    return F.least(F.floor(idx / F.floor(n / segments)), F.lit(segments - 1)).cast("int")


def flatten_vector(signal: DataFrame) -> DataFrame:
    """(recording_id, pos, value): channels one after the other, in order of name."""
    lengths = _lengths(signal)
    before = F.coalesce(F.sum("_n").over(W.partitionBy("recording_id").orderBy("channel").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = lengths.withColumn("_start", before).drop("_n")
    return signal.join(starts, list(SERIES)).select("recording_id", (F.col("_start") + F.col("idx")).alias("pos"), "value")


def orient(rows: DataFrame, channels: int) -> DataFrame:
    """(recording_id, r, c, value) with the axis of ``channels`` entries as rows: others are transposed."""
    w = W.partitionBy("recording_id")
    turn = (F.max("r").over(w) + 1 != channels) & (F.max("c").over(w) + 1 == channels)
    each = rows.withColumn("_turn", turn)
    return each.select("recording_id", F.when(F.col("_turn"), F.col("c")).otherwise(F.col("r")).alias("r"), F.when(F.col("_turn"), F.col("r")).otherwise(F.col("c")).alias("c"), "value")


def resize_grid(grid: DataFrame, by: list[str], rows_in: int, cols_in: int, rows_out: int, cols_out: int) -> DataFrame:
    """(by, r, c, value): bilinear resize. Each cell adds its weighted value to the outputs it neighbours; the table
    of weights depends on the shapes alone and is broadcast."""
    spark = grid.sparkSession

    def axis(n_in: int, n_out: int, name: str) -> DataFrame:
        at = F.col("id") * ((n_in - 1) / (n_out - 1))
        low = F.least(F.floor(at), F.lit(n_in - 1)).cast("int")
        part = at - low
        two = F.array(F.struct(low.alias("i"), (1 - part).alias("w")), F.struct(F.least(low + 1, F.lit(n_in - 1)).alias("i"), part.alias("w")))
        return spark.range(n_out).select(F.col("id").cast("int").alias(f"{name}_out"), F.explode(two).alias("x")).where("x.w > 0").select(f"{name}_out", F.col("x.i").alias(name), F.col("x.w").alias(f"{name}_w"))

    some = grid.join(F.broadcast(axis(rows_in, rows_out, "r")), "r").join(F.broadcast(axis(cols_in, cols_out, "c")), "c")
    return some.groupBy(*by, F.col("r_out").alias("r"), F.col("c_out").alias("c")).agg(F.sum(F.col("value") * F.col("r_w") * F.col("c_w")).alias("value"))


def to_pixels(grid: DataFrame, by: list[str]) -> DataFrame:
    """Values scaled to whole numbers of 0 to 255 between the least and largest of each matrix; all 0 if equal."""
    w = W.partitionBy(*by)
    low, high = F.min("value").over(w), F.max("value").over(w)
    return grid.withColumn("pixel", F.when(high > low, F.floor((F.col("value") - low) / (high - low) * 255)).otherwise(0).cast("int"))


def fused_image(edges: DataFrame, by: list[str], side: int, measures: list[str]) -> DataFrame:
    """(by, block_id, row, col, pixel): measures below each other, the places of a block of windows side by side."""
    at = F.array_position(F.array(*map(F.lit, measures)), F.col("measure")) - 1
    return edges.select(*by, "block_id", (F.col("r") + side * at).cast("int").alias("row"), (F.col("c") + side * F.col("place")).cast("int").alias("col"), "pixel")


# The scalp grid, 8 rows of 9 places; an empty place has no channel.
GRID = (
    "- - Fp1 - - - Fp2 - -", "- - AF3 - - - AF4 - -", "F7 - F3 - Fz - F4 - F8", "- FC5 - FC1 - FC2 - FC6 -",
    "T7 - C3 - Cz - C4 - T8", "- CP5 - CP1 - CP2 - CP6 -", "P7 - P3 - Pz - P4 - P8", "- PO3 O1 - Oz - O2 PO4 -",
)


def grid_map(values: DataFrame, by: list[str]) -> DataFrame:
    """(by, row, col, value): channel values on the scalp grid, 0 where a place has none."""
    cells = [(r, c, None if name == "-" else name) for r, line in enumerate(GRID) for c, name in enumerate(line.split())]
    places = values.sparkSession.createDataFrame(cells, "row int, col int, channel string")
    every = values.select(*by).distinct().crossJoin(F.broadcast(places))
    return every.join(values, [*by, "channel"], "left").select(*by, "row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))
