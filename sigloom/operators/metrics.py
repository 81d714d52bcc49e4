"""Classification metrics over scored tables (row_id, y_true, y_pred, score or proba)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.operators.ranges import ranged, running


def confusion_matrix(scored: DataFrame, n_classes: int) -> DataFrame:
    """(y_true, y_pred, n, share): every cell, share of its true class."""
    spark = scored.sparkSession
    cells = spark.range(n_classes * n_classes).select(F.floor(F.col("id") / n_classes).cast("int").alias("y_true"), (F.col("id") % n_classes).cast("int").alias("y_pred"))
    counts = scored.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    full = cells.join(counts, ["y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = F.sum("n").over(W.partitionBy("y_true"))
    return full.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def per_class_prf(matrix: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) from a confusion matrix; 0 where a denominator is 0."""
    true = matrix.groupBy(F.col("y_true").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("hit"))
    pred = matrix.groupBy(F.col("y_pred").alias("class")).agg(F.sum("n").alias("said"))
    p = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    both = true.join(pred, "class").withColumns({"precision": p, "recall": r})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return both.withColumn("f1", f1).select("class", "precision", "recall", "f1", "support")


def averaged_prf(per_class: DataFrame, positive: int = 1) -> DataFrame:
    """(average, precision, recall, f1): macro, weighted by support, and of the positive class."""
    names = ("precision", "recall", "f1")
    macro = per_class.agg(*[F.avg(c).alias(c) for c in names]).withColumn("average", F.lit("macro"))
    weighted = per_class.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names]).withColumn("average", F.lit("weighted"))
    binary = per_class.where(F.col("class") == positive).select(*names).withColumn("average", F.lit("binary"))
    return macro.unionByName(weighted).unionByName(binary)


def threshold_counts(scored: DataFrame, by: list[str], parts: int | None = None) -> DataFrame:
    """(by, score, dp, dn, tp, fp, p, n): positives and negatives at each distinct score, and at or above it.

    Scores are first counted, then summed in two phases over ranges of nearly equal numbers of scores, so no task holds all
    scores, however they crowd.
    """
    each = scored.groupBy(*by, "score").agg(F.sum("positive").alias("dp"), F.sum(1 - F.col("positive")).alias("dn"))
    run = running(ranged(each, by, ["score"], parts), by, [F.desc("score")], {"tp": "dp", "fp": "dn"}, down=True)
    return run.select(*by, "score", "dp", "dn", "tp", "fp", F.col("tp_all").alias("p"), F.col("fp_all").alias("n"))


def roc_curve(scored: DataFrame, by: list[str]) -> DataFrame:
    return threshold_counts(scored, by).select(*by, "score", (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"))


def roc_auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, auc, support): by the rank sum, ties averaged: each score's negatives count below it, its ties half."""
    below = F.col("n") - F.col("fp") + F.col("dn") / 2
    return threshold_counts(scored, by).groupBy(*by).agg((F.sum(F.col("dp") * below) / (F.max("p") * F.max("n"))).alias("auc"), F.max("p").alias("support"))


def pr_curve(scored: DataFrame, by: list[str]) -> DataFrame:
    return threshold_counts(scored, by).select(*by, "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("p")).alias("recall"))


def average_precision(scored: DataFrame, by: list[str]) -> DataFrame:
    step = F.col("dp") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return threshold_counts(scored, by).groupBy(*by).agg(F.sum(step).alias("ap"))


def confidence_stats(scored: DataFrame) -> DataFrame:
    right = F.col("y_true") == F.col("y_pred")
    return scored.agg(F.avg("confidence").alias("mean"), F.stddev_pop("confidence").alias("std"), F.avg(F.when(right, F.col("confidence"))).alias("correct"), F.avg(F.when(~right, F.col("confidence"))).alias("incorrect"))


def confidence_histogram(scored: DataFrame, bins: int = 30) -> DataFrame:
    """(correct, bin, n): equal bins between the least and largest confidence of each group, the last closed."""
    rows = scored.withColumn("correct", F.col("y_true") == F.col("y_pred"))
    ends = F.broadcast(rows.groupBy("correct").agg(F.min("confidence").alias("_lo"), F.max("confidence").alias("_hi")))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("confidence") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return rows.join(ends, "correct").groupBy("correct", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_k_accuracy(rows: DataFrame, k: int) -> DataFrame:
    """(accuracy): the true class is among the ``k`` highest; fewer than ``k`` entries are larger."""
    own = F.get("logits", F.col("y_true"))
    larger = F.size(F.filter("logits", lambda x: x > F.get("logits", F.col("y_true"))))
    return rows.where(own.isNotNull()).agg(F.avg((larger < k).cast("double")).alias("accuracy"))


def accuracy_loss(rows: DataFrame, batch: int) -> DataFrame:
    """Accuracy and mean cross-entropy of logits, over rows and as the mean of the means of batches of row_id."""
    top = F.array_max("logits")
    sums = F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("logits")))
    each = rows.select(F.floor(F.col("row_id") / batch).alias("batch"), (F.array_position("logits", top) - 1 == F.col("y_true")).cast("double").alias("hit"), (F.log(sums) + top - F.get("logits", F.col("y_true"))).alias("loss"))
    by_batch = each.groupBy("batch").agg(F.avg("loss").alias("b"), F.sum("loss").alias("s"), F.sum("hit").alias("h"), F.count(F.lit(1)).alias("n"))
    return by_batch.agg((F.sum("h") / F.sum("n")).alias("accuracy"), (F.sum("s") / F.sum("n")).alias("loss"), F.avg("b").alias("batch_loss"))
