"""Normalizers: statistics fitted on some rows as a small table, applied to any rows by a join that leaves these where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators.ranges import FEW, quantiles
from sigloom.scratch import table

TINY = 1e-8


def fit(rows: DataFrame, by: list[str], method: str = "zscore") -> DataFrame:
    """(by, center, scale) of ``value``: zscore, minmax or robust; a scale under 1e-8 becomes 1. Quartiles are exact, and of
    bounded memory for groups of any size."""
    v = F.col("value")
    if method == "zscore":
        center, scale = F.avg(v), F.stddev_pop(v)
    elif method == "minmax":
        center, scale = F.min(v), F.max(v) - F.min(v)
    elif method == "robust":
        rows = quantiles(rows, by, [0.25, 0.5, 0.75])
        center, scale = F.first("q")[1], F.first("q")[2] - F.first("q")[0]  # one row a group
    else:
        raise ValueError(f"unknown method {method!r}")
    return rows.groupBy(*by).agg(center.alias("center"), scale.alias("scale")).withColumn("scale", F.when(F.col("scale") < TINY, 1.0).otherwise(F.col("scale")))


def apply(rows: DataFrame, fitted: DataFrame, by: list[str]) -> DataFrame:
    """``value`` normalized; NaN and infinity become 0. Without ``by`` the one fitted row is broadcast, and so are the rows of
    up to ``FEW`` groups: a join by a few keys would put all rows of a key into one task."""
    if by:
        fitted = table(fitted)
        both = rows.join(F.broadcast(fitted) if fitted.count() <= FEW else fitted, by)
    else:
        both = rows.crossJoin(F.broadcast(fitted))
    v = (F.col("value") - F.col("center")) / F.col("scale")
    return both.withColumn("value", F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)).drop("center", "scale")
