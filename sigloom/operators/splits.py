"""Exact, reproducible splits. Order is by a keyed draw; ranks over all rows are made in two phases, by the leading
bits of the draw and then within them, so no task orders the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.functions.draws import uniform
from sigloom.operators.ranges import ranged, running


def ordinals(rows: DataFrame, draw: Column, key: str, by: list[str] | None = None, buckets: int = 4096, name: str = "rank") -> DataFrame:
    """Rows with their 0-based rank by (draw in [0, 1), key), within ``by``, and ``n``, the rows ranked together.

    ``buckets`` x groups counts give each bucket its offset; ties in the draw go to the smaller key.
    """
    by = by or []
    drawn = rows.withColumn("_u", draw).withColumn("_b", F.floor(F.col("_u") * buckets).cast("int"))
    counts = drawn.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    offsets = counts.withColumn("_before", F.sum("_c").over(w.orderBy("_b")) - F.col("_c")).withColumn("n", F.sum("_c").over(w)).drop("_c")
    inside = drawn.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_b").orderBy("_u", key)) - 1)
    return inside.join(offsets, [*by, "_b"]).withColumn(name, (F.col("_before") + F.col("_r")).cast("long")).drop("_u", "_b", "_r", "_before")


def random_split(rows: DataFrame, key: str, shares: tuple[float, float], seed: int = 42) -> DataFrame:
    """``split``: int(n x share) rows each of train and val, the rest test."""
    r = ordinals(rows, uniform(seed, "split", F.col(key)), key)
    a, b = F.floor(F.col("n") * shares[0]), F.floor(F.col("n") * shares[1])
    return r.withColumn("split", F.when(F.col("rank") < a, "train").when(F.col("rank") < a + b, "val").otherwise("test")).drop("rank", "n")


def stratified_split(rows: DataFrame, key: str, label: str, share: float, seed: int = 42) -> DataFrame:
    r = ordinals(rows, uniform(seed, "strata", F.col(key)), key, [label])
    return r.withColumn("split", F.when(F.col("rank") < F.floor(F.col("n") * share), "train").otherwise("val")).drop("rank", "n")


def k_fold(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """``fold``: n // k rows each, the first n % k folds one more."""
    r = ordinals(rows, uniform(seed, "fold", F.col(key)), key)
    size, more = F.floor(F.col("n") / k), F.col("n") % k
    edge = more * (size + 1)
    return r.withColumn("fold", F.when(F.col("rank") < edge, F.floor(F.col("rank") / (size + 1))).otherwise(more + F.floor((F.col("rank") - edge) / size)).cast("int")).drop("rank", "n")


def leave_one_group_out(rows: DataFrame, key: str, group: str, held: int, val_share: float, test_share: float, seed: int = 42) -> DataFrame:
    """Test: the held group. Val: int(n x val / (1 - test)) drawn from the rest."""
    rest = ordinals(rows.where(F.col(group) != held), uniform(seed, "logo", F.col(key)), key)
    named = rest.withColumn("split", F.when(F.col("rank") < F.floor(F.col("n") * (val_share / (1 - test_share))), "val").otherwise("train")).drop("rank", "n")
    return named.unionByName(rows.where(F.col(group) == held).withColumn("split", F.lit("test")))


def all_folds(rows: DataFrame, group: str) -> DataFrame:
    """Every row in every group's fold: ``fold`` and whether it is held out there."""
    folds = rows.select(F.col(group).alias("fold")).distinct()
    return rows.crossJoin(folds).withColumn("is_test", F.col(group) == F.col("fold"))


def tail_validation(rows: DataFrame, key: str, share: float = 0.2, parts: int | None = None) -> DataFrame:
    """The last ``share`` of rows, in order of ``key``, as validation. Rows are dealt by ranges of nearly equal size; rows of
    one key are in any order."""
    some = ranged(rows, [], [key], parts).withColumn("_one", F.lit(1))
    r = running(some, [], [F.col(key)], {"_at": "_one"})
    return r.withColumn("split", F.when(F.col("_at") > F.col("_at_all") - F.floor(F.col("_at_all") * share), "val").otherwise("train")).drop("_at", "_at_all", "_one")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """``weight``: one over the class's count."""
    counts = rows.groupBy(label).agg((1.0 / F.count(F.lit(1))).alias("weight"))
    return rows.join(counts, label)


def balanced_resample(rows: DataFrame, key: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """(draw, key, label): ``n`` draws with replacement, each class equally likely and each row in it.

    Weights of one over the class's count make a draw a class, then a rank in it: an equi join, not a range join.
    """
    spark = rows.sparkSession
    ranked = ordinals(rows.select(key, label), uniform(seed, "balance", F.col(key)), key, [label])
    names = ranked.select(label, "n").distinct().withColumn("_class", F.row_number().over(W.orderBy(label)) - 1)  # one row for each class
    k = names.count()
    draws = spark.range(n).withColumnRenamed("id", "draw").withColumn("_class", F.floor(uniform(seed, "class", F.col("draw")) * k).cast("int"))
    picked = draws.join(names, "_class").withColumn("rank", F.floor(uniform(seed, "row", F.col("draw")) * F.col("n")).cast("long"))
    return picked.select("draw", label, "rank").join(ranked.select(label, "rank", key), [label, "rank"]).select("draw", key, label)


def random_pairs(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """(draw, first, second): two independent uniform draws with replacement for each of ``n`` outputs."""
    ranked = ordinals(rows.select(key), uniform(seed, "order", F.col(key)), key)
    total = rows.count()
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(uniform(seed, "first", F.col("id")) * total).cast("long").alias("a"), F.floor(uniform(seed, "second", F.col("id")) * total).cast("long").alias("b"))
    one, two = ranked.select(F.col("rank").alias("a"), F.col(key).alias("first")), ranked.select(F.col("rank").alias("b"), F.col(key).alias("second"))
    return draws.join(one, "a").join(two, "b").select("draw", "first", "second")
