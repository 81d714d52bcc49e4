"""Metrics of scored tables and reports of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.functions import labels as lb
from sigloom.operators import metrics as mt
from sigloom.plans.registry import classes, query, r6, read, recordings, scored

_CM = "cells AS (SELECT CAST(a.range AS INT) AS y_true, CAST(b.range AS INT) AS y_pred FROM range(0, 2) a, range(0, 2) b), cm AS (SELECT c.y_true, c.y_pred, count(s.row_id) AS n FROM cells c LEFT JOIN scored s ON s.y_true = c.y_true AND s.y_pred = c.y_pred GROUP BY ALL)"
_PRF = _CM + ", t AS (SELECT y_true AS class, sum(n) AS support, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS hit FROM cm GROUP BY ALL), p AS (SELECT y_pred AS class, sum(n) AS said FROM cm GROUP BY ALL), pr AS (SELECT class, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall, support FROM t JOIN p USING (class)), prf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"


@query(f"WITH {_CM} SELECT y_true, y_pred, n, round(n / sum(n) OVER (PARTITION BY y_true), 6) + 0.0 AS share FROM cm")
def confusion_matrix(spark, sf_dir):
    return mt.confusion_matrix(scored(spark, sf_dir), 2).withColumn("share", r6("share"))


@query(f"WITH {_PRF} SELECT class, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1, CAST(support AS BIGINT) AS support FROM prf")
def per_class_prf(spark, sf_dir):
    p = mt.per_class_prf(mt.confusion_matrix(scored(spark, sf_dir), 2))
    return p.select("class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH {_PRF} SELECT 'macro' AS average, round(avg(precision), 6) + 0.0 AS precision, round(avg(recall), 6) + 0.0 AS recall, round(avg(f1), 6) + 0.0 AS f1 FROM prf UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 6) + 0.0, round(sum(recall * support) / sum(support), 6) + 0.0, round(sum(f1 * support) / sum(support), 6) + 0.0 FROM prf UNION ALL SELECT 'binary', round(precision, 6) + 0.0, round(recall, 6) + 0.0, round(f1, 6) + 0.0 FROM prf WHERE class = 1")
def averaged_prf(spark, sf_dir):
    a = mt.averaged_prf(mt.per_class_prf(mt.confusion_matrix(scored(spark, sf_dir), 2)))
    return a.select("average", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


def positives(spark, sf_dir):
    return scored(spark, sf_dir).select("score", F.col("y_true").cast("long").alias("positive"))


_TC = "e AS (SELECT score, sum(y_true) AS dp, sum(1 - y_true) AS dn FROM scored GROUP BY score), c AS (SELECT score, dp, dn, sum(dp) OVER (ORDER BY score DESC) AS tp, sum(dn) OVER (ORDER BY score DESC) AS fp, sum(dp) OVER () AS p, sum(dn) OVER () AS n FROM e)"


@query(f"WITH {_TC} SELECT score, round(fp / n, 6) + 0.0 AS fpr, round(tp / p, 6) + 0.0 AS tpr FROM c")
def roc_curve(spark, sf_dir):
    return mt.roc_curve(positives(spark, sf_dir), []).select("score", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query(f"WITH {_TC} SELECT score, round(tp / (tp + fp), 6) + 0.0 AS precision, round(tp / p, 6) + 0.0 AS recall FROM c")
def pr_curve(spark, sf_dir):
    return mt.pr_curve(positives(spark, sf_dir), []).select("score", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query(f"WITH {_TC} SELECT round(sum(dp / p * tp / (tp + fp)), 6) + 0.0 AS ap FROM c")
def average_precision(spark, sf_dir):
    return mt.average_precision(positives(spark, sf_dir), []).select(r6("ap").alias("ap"))


def one_vs_rest(spark, sf_dir):
    """Each class of the samples against the rest, scored by its probability."""
    c = classes(spark, sf_dir).select("y_true", F.posexplode(lb.softmax(F.col("logits"))).alias("class", "score"))
    return c.select("class", F.round("score", 5).alias("score"), (F.col("y_true") == F.col("class")).cast("long").alias("positive"))


_OVR = """e AS (SELECT row_id, y_true, list_transform(logits, lambda v: exp(v - list_max(logits))) AS e FROM classes), o AS (SELECT CAST(i - 1 AS INT) AS class, round(e[i] / list_sum(e), 5) AS score, CAST(y_true = i - 1 AS INT) AS positive FROM e, range(1, 11) t(i)),
pairs AS (SELECT class, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS u FROM (SELECT * FROM o WHERE positive = 1) a JOIN (SELECT * FROM o WHERE positive = 0) b USING (class) GROUP BY class),
auc AS (SELECT class, u / (sum(positive) * sum(1 - positive)) AS auc, sum(positive) AS support FROM o JOIN pairs USING (class) GROUP BY class, u)"""


@query(f"WITH {_OVR} SELECT class, round(auc, 6) + 0.0 AS auc, CAST(support AS BIGINT) AS support FROM auc UNION ALL SELECT -1, round(sum(auc * support) / sum(support), 6) + 0.0, CAST(sum(support) AS BIGINT) FROM auc")
def roc_auc(spark, sf_dir):
    """Area for each class against the rest, and their mean by support as class -1."""
    a = mt.roc_auc(one_vs_rest(spark, sf_dir), ["class"])
    mean = a.agg((F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("auc"), F.sum("support").alias("support")).withColumn("class", F.lit(-1))
    return a.unionByName(mean).select("class", r6("auc").alias("auc"), "support")


_CONF = "conf AS (SELECT y_true, y_pred, CASE WHEN y_pred = 1 THEN score ELSE 1 - score END AS confidence FROM scored)"


def confident(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("confidence", F.when(F.col("y_pred") == 1, F.col("score")).otherwise(1 - F.col("score")))


@query(f"WITH {_CONF} SELECT round(avg(confidence), 6) + 0.0 AS mean, round(stddev_pop(confidence), 6) + 0.0 AS std, round(avg(confidence) FILTER (y_true = y_pred), 6) + 0.0 AS correct, round(avg(confidence) FILTER (y_true <> y_pred), 6) + 0.0 AS incorrect FROM conf")
def confidence_stats(spark, sf_dir):
    return mt.confidence_stats(confident(spark, sf_dir)).select(*[r6(c).alias(c) for c in ("mean", "std", "correct", "incorrect")])


@query(f"WITH {_CONF}, g AS (SELECT y_true = y_pred AS correct, confidence, min(confidence) OVER (PARTITION BY y_true = y_pred) AS lo, max(confidence) OVER (PARTITION BY y_true = y_pred) AS hi FROM conf) SELECT correct, CAST(CASE WHEN hi > lo THEN least(floor((confidence - lo) / (hi - lo) * 30), 29) ELSE 0 END AS INT) AS bin, count(*) AS n FROM g GROUP BY ALL")
def confidence_histogram(spark, sf_dir):
    return mt.confidence_histogram(confident(spark, sf_dir))


@query("SELECT coalesce(t.class, p.class) AS class, coalesce(t.n, 0) AS n_true, coalesce(p.n, 0) AS n_pred FROM (SELECT y_true AS class, count(*) AS n FROM scored GROUP BY ALL) t FULL JOIN (SELECT y_pred AS class, count(*) AS n FROM scored GROUP BY ALL) p ON t.class = p.class")
def true_vs_pred_counts(spark, sf_dir):
    s = scored(spark, sf_dir)
    t = s.groupBy(F.col("y_true").alias("class")).agg(F.count(F.lit(1)).alias("n_true"))
    p = s.groupBy(F.col("y_pred").alias("class")).agg(F.count(F.lit(1)).alias("n_pred"))
    return t.join(p, "class", "full").select("class", F.coalesce("n_true", F.lit(0)).alias("n_true"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"))


@query("WITH f AS (SELECT row_id % 5 AS fold, avg(CAST(y_true = y_pred AS DOUBLE)) AS accuracy FROM scored GROUP BY ALL) SELECT round(avg(accuracy), 6) + 0.0 AS mean, round(stddev_pop(accuracy), 6) + 0.0 AS std, round(min(accuracy), 6) + 0.0 AS low, round(max(accuracy), 6) + 0.0 AS high FROM f")
def fold_summary(spark, sf_dir):
    f = scored(spark, sf_dir).groupBy((F.col("row_id") % 5).alias("fold")).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))
    return f.agg(r6(F.avg("accuracy")).alias("mean"), r6(F.stddev_pop("accuracy")).alias("std"), r6(F.min("accuracy")).alias("low"), r6(F.max("accuracy")).alias("high"))


@query("WITH f AS (SELECT row_id % 5 AS fold, y_true, y_pred, count(*) AS n FROM scored GROUP BY ALL) SELECT y_true, y_pred, round(sum(n) / 5.0, 6) + 0.0 AS mean FROM f GROUP BY ALL")
def mean_confusion(spark, sf_dir):
    """Cells of the folds' confusion matrices, on average; a missing cell counts 0."""
    f = scored(spark, sf_dir).groupBy((F.col("row_id") % 5).alias("fold"), "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return f.groupBy("y_true", "y_pred").agg(r6(F.sum("n") / F.lit(5.0)).alias("mean"))


@query("SELECT round(avg(CAST(len(list_filter(logits, lambda v: v > logits[y_true + 1])) < 2 AS DOUBLE)), 6) + 0.0 AS accuracy FROM classes")
def top_k_accuracy(spark, sf_dir):
    return mt.top_k_accuracy(classes(spark, sf_dir), 2).select(r6("accuracy").alias("accuracy"))


@query("WITH l AS (SELECT row_id // 32 AS batch, CAST(list_position(logits, list_max(logits)) - 1 = y_true AS DOUBLE) AS hit, ln(list_sum(list_transform(logits, lambda v: exp(v - list_max(logits))))) + list_max(logits) - logits[y_true + 1] AS loss FROM classes), b AS (SELECT batch, avg(loss) AS b FROM l GROUP BY batch) SELECT round(avg(hit), 6) + 0.0 AS accuracy, round(avg(loss), 6) + 0.0 AS loss, round((SELECT avg(b) FROM b), 6) + 0.0 AS batch_loss FROM l")
def accuracy_loss(spark, sf_dir):
    return mt.accuracy_loss(classes(spark, sf_dir), 32).select(*[r6(c).alias(c) for c in ("accuracy", "loss", "batch_loss")])


_RUNS = "runs AS (SELECT p_brand AS model, p_type AS metric, round(avg(p_retailprice), 4) AS value FROM part GROUP BY ALL)"


def runs(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("model"), F.col("p_type").alias("metric")).agg(F.round(F.avg("p_retailprice"), 4).alias("value"))


@query(f"WITH {_RUNS} SELECT metric, arg_max(model, (value, model)) AS best, max(value) AS value FROM runs GROUP BY metric")
def best_per_group(spark, sf_dir):
    """The model of the largest value for each metric; ties go to the later name."""
    return runs(spark, sf_dir).groupBy("metric").agg(F.max_by("model", F.struct("value", "model")).alias("best"), F.max("value").alias("value"))


@query(f"WITH {_RUNS} SELECT model, coalesce(max(value) FILTER (metric = (SELECT min(metric) FROM runs)), 0) AS first_metric, count(*) AS metrics FROM runs GROUP BY model ORDER BY model")
def ordered_results_table(spark, sf_dir):
    """Models by name with one metric, 0 where it is missing."""
    r = runs(spark, sf_dir)
    first = r.agg(F.min("metric").alias("first"))
    return r.crossJoin(F.broadcast(first)).groupBy("model").agg(F.coalesce(F.max(F.when(F.col("metric") == F.col("first"), F.col("value"))), F.lit(0.0)).alias("first_metric"), F.count(F.lit(1)).alias("metrics")).orderBy("model")


@query(f"WITH {_RUNS} SELECT model, max(value) FILTER (metric = 'SMALL PLATED') AS a, max(value) FILTER (metric LIKE 'LARGE%') AS b FROM runs GROUP BY model")
def metric_pivot(spark, sf_dir):
    """Models by chosen metrics, one column each."""
    r = runs(spark, sf_dir).withColumn("c", F.when(F.col("metric") == "SMALL PLATED", "a").when(F.col("metric").startswith("LARGE"), "b"))
    return r.groupBy("model").pivot("c", ["a", "b"]).agg(F.max("value"))


@query(f"WITH {_RUNS}, p(model, published) AS (SELECT p_brand, round(avg(p_retailprice) + 1, 4) FROM part WHERE p_brand <> (SELECT min(p_brand) FROM part) GROUP BY ALL) SELECT r.model, r.metric, r.value, p.published, abs(r.value - p.published) < 100 AS agrees FROM runs r LEFT JOIN p ON r.model = p.model")
def compare_to_reference_scores(spark, sf_dir):
    """Our values beside published ones, which may be missing."""
    part = read(spark, sf_dir, "part")
    least = part.agg(F.min("p_brand").alias("least"))
    p = part.join(F.broadcast(least), F.col("p_brand") != F.col("least")).groupBy(F.col("p_brand").alias("model")).agg(F.round(F.avg("p_retailprice") + 1, 4).alias("published"))
    return runs(spark, sf_dir).join(p, "model", "left").select("model", "metric", "value", "published", (F.abs(F.col("value") - F.col("published")) < 100).alias("agrees"))


@query("SELECT recording_id, subject_id, rating FROM recording ORDER BY rating, recording_id LIMIT 20")
def head_subset(spark, sf_dir):
    """The first twenty rows by a total order."""
    return recordings(spark, sf_dir).orderBy("rating", "recording_id").limit(20).select("recording_id", "subject_id", "rating")
