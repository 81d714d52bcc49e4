"""Label and score expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def binarize(c: Column, threshold: float = 5.0) -> Column:
    return (c >= threshold).cast("int")


def quadrant(valence: Column, arousal: Column, cut: float = 4.5) -> Column:
    """0 to 3, counted from both high against the clock: high arousal first."""
    return (F.when((valence >= cut) & (arousal >= cut), 0).when((valence < cut) & (arousal >= cut), 1)
            .when((valence < cut) & (arousal < cut), 2).otherwise(3))


def remap(c: Column, mapping: dict[int, int]) -> Column:
    """Recoded labels; those not in ``mapping`` stay."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[c], c)


def code_to_label(rows: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    """Join a small table (code, label, ...); unknown codes get null."""
    return rows.join(F.broadcast(codes), code, "left")


def class_to_axes(c: Column) -> tuple[Column, Column]:
    """(arousal, valence) of a four-class label: 2 and 3 are aroused; 1 and 2 are of low valence."""
    return c.isin(2, 3).cast("int"), (~c.isin(1, 2)).cast("int")


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def one_hot(c: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == c).cast("int"))


def invalid(c: Column) -> Column:
    """Null, NaN or infinite."""
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def reason(c: Column) -> Column:
    """Why a value is rejected: null, nan or infinite; null for a valid one."""
    return F.when(c.isNull(), "null").when(F.isnan(c), "nan").when(F.abs(c) == float("inf"), "infinite")


def validate_signal(rows: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): the rows whose value may be used, and the others with the ``reason``."""
    told = rows.withColumn("reason", reason(F.col(value)))
    return told.where(F.col("reason").isNull()).drop("reason"), told.where(F.col("reason").isNotNull())


def clean(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def trial_number(key: Column) -> Column:
    """The number that ends a trial's key, so that keys sort as numbers."""
    return F.regexp_extract(key, r"(\d+)$", 1).cast("int")
