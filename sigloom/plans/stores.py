"""Readers and writers over data that Spark derives from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.operators import metrics as mt
from sigloom.plans.metrics import _CONF, _PRF, confident
from sigloom.plans.registry import CHANNELS, events, query, r6, recordings, scored, signal, wide_signal
from sigloom.scratch import new_folder
from sigloom.sources import files


@query("SELECT 'gameemo' AS dataset, subject_id, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM signal s JOIN recording r ON r.recording_id = s.recording_id WHERE subject_id IN (1, 5, 9) AND s.recording_id % 2 = 0 GROUP BY ALL")
def read_partitioned(spark, sf_dir):
    """Three subjects of one dataset, the other folders pruned."""
    path = new_folder(spark)
    rows = signal(spark, sf_dir).join(recordings(spark, sf_dir).select("recording_id", "subject_id"), "recording_id")
    rows.withColumn("dataset", F.when(F.col("recording_id") % 2 == 0, "gameemo").otherwise("deap")).repartition("dataset", "subject_id").write.partitionBy("dataset", "subject_id").parquet(path)
    some = files.read_partitioned(spark, path, "GAMEEMO", ("deap", "gameemo", "seed"), [1, 5, 9])
    return some.groupBy("dataset", "subject_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 4).alias("total"))


@query("SELECT CAST(recording_id AS INT) AS subject_id, 1 AS game, idx, round(price, 6) + 0.0 AS price, round(tax, 6) + 0.0 AS tax FROM wide")
def read_wide_csv(spark, sf_dir):
    """Recordings written as one CSV file each and read back with two of their channels."""
    path = new_folder(spark)
    files.write_wide_csv(wide_signal(spark, sf_dir), path, "recording_id", "idx", F.col("recording_id"), F.lit(1), list(CHANNELS))
    return files.read_wide_csv(spark, f"{path}/S*.csv", ["price", "tax"]).select("subject_id", "game", "idx", r6("price").alias("price"), r6("tax").alias("tax"))


@query("SELECT CASE WHEN recording_id % 2 = 0 THEN 'a' ELSE 'b' END AS dataset, channel AS technique, count(*) AS n FROM irregular GROUP BY ALL")
def write_dataset(spark, sf_dir):
    """Rows in a folder for each dataset and technique, and their counts."""
    rows = events(spark, sf_dir).withColumn("dataset", F.when(F.col("recording_id") % 2 == 0, "a").otherwise("b")).withColumnRenamed("channel", "technique")
    return files.write_dataset(rows, new_folder(spark))


@query("SELECT CAST(recording_id % 25 AS INT) AS subject_id, count(*) AS n FROM irregular GROUP BY ALL")
def write_by_subject(spark, sf_dir):
    path = new_folder(spark)
    files.write_by_subject(events(spark, sf_dir).withColumn("subject_id", (F.col("recording_id") % 25).cast("int")), path)
    return spark.read.parquet(path).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT recording_id, channel, round(avg(value), 6) + 0.0 AS mean FROM signal GROUP BY ALL")
def feature_cache(spark, sf_dir):
    """Features made once and read the second time."""
    root = new_folder(spark)
    make = lambda: signal(spark, sf_dir).groupBy("recording_id", "channel").agg(r6(F.avg("value")).alias("mean"))
    files.feature_cache(spark, root, {"features": ["mean"]}, make)
    return files.feature_cache(spark, root, {"features": ["mean"]}, lambda: make().limit(0))


@query("SELECT 'm' || (row_id % 5) AS model_name, 'binary' AS classification_type, round(avg(CAST(y_true = y_pred AS DOUBLE)), 6) + 0.0 AS accuracy, round(avg(score), 6) + 0.0 AS roc_auc FROM scored GROUP BY ALL")
def read_results_json(spark, sf_dir):
    """A result file for each of five models, written and read."""
    path = new_folder(spark)
    m = scored(spark, sf_dir).groupBy(F.concat(F.lit("m"), (F.col("row_id") % 5).cast("string")).alias("model_name")).agg(r6(F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))).alias("accuracy"), r6(F.avg("score")).alias("roc_auc"))
    m.select("model_name", F.lit("binary").alias("classification_type"), F.struct("accuracy", "roc_auc").alias("metrics"), F.col("model_name").alias("p")).repartition(5, "p").write.partitionBy("p").json(path)
    fs = spark._jvm.org.apache.hadoop.fs
    store = fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for d in store.globStatus(fs.Path(f"{path}/p=*/part-*")):
        store.rename(d.getPath(), fs.Path(f"{path}/{d.getPath().getParent().getName()[2:]}_results.json"))
    return files.read_results_json(spark, path).select("model_name", "classification_type", "accuracy", "roc_auc")


@query("SELECT CASE WHEN recording_id % 2 = 0 THEN 'train' ELSE 'val' END AS phase, 'loss' AS metric, CAST(idx + 1 AS INT) AS epoch, round(avg(value), 6) + 0.0 AS value FROM irregular GROUP BY ALL")
def read_history_json(spark, sf_dir):
    """A training history written as one document and read as rows."""
    path = new_folder(spark)
    h = events(spark, sf_dir).groupBy(F.when(F.col("recording_id") % 2 == 0, "train").otherwise("val").alias("phase"), "idx").agg(r6(F.avg("value")).alias("v"))
    lists = h.groupBy("phase").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "v"))), lambda x: x["v"]).alias("loss"))
    lists.groupBy().pivot("phase", ["train", "val"]).agg(F.first(F.struct("loss"))).coalesce(1).write.json(path)
    return files.read_history_json(spark, path).select("phase", "metric", F.col("epoch").cast("int").alias("epoch"), "value")


_F = ("precision", "recall", "f1")
_AVERAGED = " UNION ALL ".join([f"SELECT 'overall' AS part, 'macro:{c}' AS name, avg({c}) AS value FROM prf UNION ALL SELECT 'overall', 'weighted:{c}', sum({c} * support) / sum(support) FROM prf UNION ALL SELECT 'overall', 'binary:{c}', {c} FROM prf WHERE class = 1" for c in _F])
_CLASSES = " UNION ALL ".join([f"SELECT 'class', class || ':{c}', {c} FROM prf" for c in (*_F, "support")])


@query(f"""WITH {_PRF}, {_CONF}, s AS ({_AVERAGED} UNION ALL {_CLASSES} UNION ALL SELECT 'matrix', y_true || ':' || y_pred, n FROM cm
UNION ALL SELECT 'confidence', 'mean', avg(confidence) FROM conf UNION ALL SELECT 'confidence', 'std', stddev_pop(confidence) FROM conf
UNION ALL SELECT 'confidence', 'correct', avg(confidence) FILTER (y_true = y_pred) FROM conf UNION ALL SELECT 'confidence', 'incorrect', avg(confidence) FILTER (y_true <> y_pred) FROM conf)
SELECT part, name, round(value, 6) + 0.0 AS value FROM s""")
def write_metrics_summary(spark, sf_dir):
    """All figures of a scored table written as one document, read back and listed."""
    path = new_folder(spark)
    s = scored(spark, sf_dir)
    matrix = mt.confusion_matrix(s, 2)
    per_class = mt.per_class_prf(matrix)
    files.metrics_summary(mt.averaged_prf(per_class), per_class, mt.confidence_stats(confident(spark, sf_dir)), matrix).coalesce(1).write.json(path)
    return files.read_metrics_summary(spark, path).select("part", "name", r6("value").alias("value"))
