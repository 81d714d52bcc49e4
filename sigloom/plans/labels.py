"""Labels, validation and joins of labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.functions import labels as lb
from sigloom.plans.registry import classes, events, query, r6, read, recordings, samples, signal

# Classes of 24 trials in three sessions.
TRIALS = {
    1: [1, 2, 3, 0, 2, 0, 0, 1, 0, 1, 2, 1, 1, 1, 2, 3, 2, 2, 3, 3, 0, 3, 0, 3],
    2: [2, 1, 3, 0, 0, 2, 0, 2, 3, 3, 2, 3, 2, 0, 1, 1, 2, 1, 0, 3, 0, 1, 3, 1],
    3: [1, 2, 2, 1, 3, 3, 3, 1, 1, 2, 1, 0, 2, 3, 3, 0, 2, 3, 0, 0, 2, 0, 1, 0],
}
_TRIALS = " UNION ALL ".join(f"SELECT {s} AS session_id, i AS trial_id, {xs}[i] AS label FROM range(1, 25) t(i)" for s, xs in TRIALS.items())


def trial_labels(spark):
    rows = ", ".join(f"({s}, {i + 1}, {x})" for s, xs in TRIALS.items() for i, x in enumerate(xs))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(session_id, trial_id, label)")


@query("SELECT recording_id, CAST(rating >= 5.0 AS INT) AS high_valence, CAST(arousal >= 5.0 AS INT) AS high_arousal FROM recording")
def binarize(spark, sf_dir):
    return recordings(spark, sf_dir).select("recording_id", lb.binarize(F.col("rating")).alias("high_valence"), lb.binarize(F.col("arousal")).alias("high_arousal"))


_Q = "CASE WHEN rating >= 4.5 AND arousal >= 4.5 THEN 0 WHEN rating < 4.5 AND arousal >= 4.5 THEN 1 WHEN rating < 4.5 AND arousal < 4.5 THEN 2 ELSE 3 END"


@query(f"SELECT recording_id, {_Q} AS quadrant, CASE {_Q} WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 1 END AS binary_label, CAST({_Q} IN (2, 3) AS INT) AS arousal, CAST({_Q} NOT IN (1, 2) AS INT) AS valence FROM recording")
def quadrant_label(spark, sf_dir):
    """Quadrant, its recoding to two classes, and its axes."""
    q = recordings(spark, sf_dir).withColumn("quadrant", lb.quadrant(F.col("rating"), F.col("arousal")))
    arousal, valence = lb.class_to_axes(F.col("quadrant"))
    return q.select("recording_id", "quadrant", lb.remap(F.col("quadrant"), {0: 0, 1: 1, 2: 0, 3: 1}).alias("binary_label"), arousal.alias("arousal"), valence.alias("valence"))


@query("SELECT sample_id, CASE label WHEN 3 THEN 0 WHEN 7 THEN 1 ELSE label END AS label FROM sample")
def remap_labels(spark, sf_dir):
    return samples(spark, sf_dir).select("sample_id", lb.remap(F.col("label"), {3: 0, 7: 1}).alias("label"))


_CODE = "CAST(recording_id % 5 + 1 AS INT)"


@query(f"SELECT recording_id, 'G' || {_CODE} AS code, CASE WHEN {_CODE} <= 2 THEN 0 WHEN {_CODE} <= 4 THEN 1 END AS label, CASE WHEN {_CODE} <= 4 THEN CAST({_CODE} >= 3 AS INT) END AS arousal, CASE WHEN {_CODE} <= 4 THEN CAST({_CODE} IN (2, 4) AS INT) END AS valence FROM recording")
def code_to_label(spark, sf_dir):
    """Session codes G1 to G4 to classes by a small table; another code has none."""
    codes = spark.sql("SELECT * FROM VALUES ('G1', 0, 0, 0), ('G2', 0, 0, 1), ('G3', 1, 1, 0), ('G4', 1, 1, 1) AS t(code, label, arousal, valence)")
    rows = recordings(spark, sf_dir).select("recording_id", F.concat(F.lit("G"), (F.col("recording_id") % 5 + 1).cast("string")).alias("code"))
    return lb.code_to_label(rows, codes, "code").select("recording_id", "code", "label", "arousal", "valence")


@query("""WITH v AS (SELECT CASE WHEN recording_id % 7 <> 0 THEN value WHEN idx = 0 THEN NULL WHEN idx = 1 THEN CAST('NaN' AS DOUBLE) WHEN idx = 2 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS v FROM irregular),
t AS (SELECT v, CASE WHEN v IS NULL THEN 'null' WHEN isnan(v) THEN 'nan' WHEN isinf(v) THEN 'infinite' ELSE 'valid' END AS reason FROM v)
SELECT reason, count(*) AS n, round(sum(CASE WHEN reason = 'valid' THEN v END), 3) + 0.0 AS total FROM t GROUP BY reason""")
def validate_signal(spark, sf_dir):
    """Values that may be used, and the others by the reason for which they are rejected."""
    v = F.when(F.col("recording_id") % 7 == 0, F.when(F.col("idx") == 0, None).when(F.col("idx") == 1, float("nan")).when(F.col("idx") == 2, float("inf")).otherwise(F.col("value"))).otherwise(F.col("value"))
    valid, quarantine = lb.validate_signal(events(spark, sf_dir).select(v.alias("value")))
    return valid.select(F.lit("valid").alias("reason"), "value").unionByName(quarantine.select("reason", F.lit(None).cast("double").alias("value"))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 3).alias("total"))


@query("SELECT recording_id, channel, idx, round(CASE WHEN isnan(v) OR isinf(v) THEN 0 ELSE v END, 6) + 0.0 AS value, CAST(isnan(v) OR isinf(v) AS INT) AS cleaned FROM (SELECT *, CASE WHEN idx = 1 THEN CAST('NaN' AS DOUBLE) WHEN idx = 2 THEN CAST('-Infinity' AS DOUBLE) ELSE value END AS v FROM irregular)")
def clean_invalid(spark, sf_dir):
    v = F.when(F.col("idx") == 1, float("nan")).when(F.col("idx") == 2, float("-inf")).otherwise(F.col("value"))
    rows = events(spark, sf_dir).withColumn("v", v)
    return rows.select("recording_id", "channel", "idx", r6(lb.clean(F.col("v"))).alias("value"), lb.invalid(F.col("v")).cast("int").alias("cleaned"))


@query("""WITH e AS (SELECT row_id, y_true, logits, list_transform(logits, lambda v: exp(v - list_max(logits))) AS e FROM classes)
SELECT row_id, CAST(list_position(logits, list_max(logits)) - 1 AS INT) AS y_pred, round(list_max(e) / list_sum(e), 6) + 0.0 AS confidence, round(e[y_true + 1] / list_sum(e), 6) + 0.0 AS p_true FROM e""")
def softmax_argmax(spark, sf_dir):
    c = classes(spark, sf_dir).withColumn("p", lb.softmax(F.col("logits")))
    return c.select("row_id", lb.argmax(F.col("logits")).alias("y_pred"), r6(F.array_max("p")).alias("confidence"), r6(F.get("p", F.col("y_true"))).alias("p_true"))


@query("SELECT sample_id, i - 1 AS k, CAST(label = i - 1 AS INT) AS hot FROM sample, range(1, 11) t(i)")
def one_hot(spark, sf_dir):
    return samples(spark, sf_dir).select("sample_id", F.posexplode(lb.one_hot(F.col("label"), 10)).alias("k", "hot")).withColumn("k", F.col("k").cast("long"))


@query("SELECT row_id, y_true FROM classes WHERE y_true < 6")
def filter_known_classes(spark, sf_dir):
    return classes(spark, sf_dir).where(F.col("y_true") < 6).select("row_id", "y_true")


@query(f"WITH trials AS ({_TRIALS}) SELECT recording_id, session_id, trial_id, label FROM (SELECT recording_id, CAST(recording_id % 3 + 1 AS INT) AS session_id, CAST(recording_id % 24 + 1 AS INT) AS trial_id FROM recording) r JOIN trials t USING (session_id, trial_id)")
def trial_label_join(spark, sf_dir):
    """Labels by session and trial number."""
    r = recordings(spark, sf_dir).select("recording_id", (F.col("recording_id") % 3 + 1).cast("int").alias("session_id"), (F.col("recording_id") % 24 + 1).cast("int").alias("trial_id"))
    return r.join(F.broadcast(trial_labels(spark)), ["session_id", "trial_id"]).select("recording_id", "session_id", "trial_id", "label")


@query("SELECT s.recording_id, s.channel, CAST(floor(idx / 64) AS BIGINT) AS window_id, CAST(rating >= 5.0 AS INT) AS label, count(*) AS n FROM signal s JOIN recording r ON s.recording_id = r.recording_id GROUP BY ALL")
def replicate_trial_label(spark, sf_dir):
    """A recording's label on each of its windows."""
    w = signal(spark, sf_dir).groupBy("recording_id", "channel", F.floor(F.col("idx") / 64).alias("window_id")).agg(F.count(F.lit(1)).alias("n"))
    label = recordings(spark, sf_dir).select("recording_id", lb.binarize(F.col("rating")).alias("label"))
    return w.join(label, "recording_id").select("recording_id", "channel", "window_id", "label", "n")


@query("SELECT recording_id, dataset, fs, nperseg, hop, CAST(floor(0.5 / (fs * 1.0 / nperseg)) AS INT) AS lo_bin, CAST(floor(50 / (fs * 1.0 / nperseg)) AS INT) AS hi_bin FROM (SELECT recording_id, CASE recording_id % 3 WHEN 0 THEN 'deap' WHEN 1 THEN 'gameemo' ELSE 'seed' END AS dataset FROM recording) JOIN (VALUES ('deap', 128, 256, 128), ('gameemo', 128, 128, 64), ('seed', 200, 400, 200)) t(dataset, fs, nperseg, hop) USING (dataset)")
def dataset_params_join(spark, sf_dir):
    """Sampling rate, frame and hop by dataset, and the bins of 0.5 to 50 Hz."""
    params = spark.sql("SELECT * FROM VALUES ('deap', 128, 256, 128), ('gameemo', 128, 128, 64), ('seed', 200, 400, 200) AS t(dataset, fs, nperseg, hop)")
    name = F.when(F.col("recording_id") % 3 == 0, "deap").when(F.col("recording_id") % 3 == 1, "gameemo").otherwise("seed")
    step = F.col("fs") / F.col("nperseg")
    return recordings(spark, sf_dir).select("recording_id", name.alias("dataset")).join(F.broadcast(params), "dataset").select("recording_id", "dataset", "fs", "nperseg", "hop", F.floor(0.5 / step).cast("int").alias("lo_bin"), F.floor(50 / step).cast("int").alias("hi_bin"))


@query("SELECT p_name AS key, CAST(regexp_extract('trial_eeg' || p_partkey, '([0-9]+)$', 1) AS INT) AS number, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM part")
def natural_trial_order(spark, sf_dir):
    """Keys ordered by the number that ends them, not as text."""
    from pyspark.sql import Window as W

    p = read(spark, sf_dir, "part").withColumn("number", lb.trial_number(F.concat(F.lit("trial_eeg"), F.col("p_partkey"))))
    return p.select(F.col("p_name").alias("key"), "number", F.row_number().over(W.partitionBy("p_brand").orderBy("number")).cast("long").alias("place"))


@query("SELECT 'signal' AS dataset, CAST(rating >= 5.0 AS INT) AS label, count(*) AS n, count(DISTINCT subject_id) AS subjects FROM recording GROUP BY ALL UNION ALL SELECT 'sample', label, count(*), 0 FROM sample GROUP BY ALL")
def label_distribution(spark, sf_dir):
    """Labels and subjects counted over two datasets put together."""
    a = recordings(spark, sf_dir).select(F.lit("signal").alias("dataset"), lb.binarize(F.col("rating")).alias("label"), "subject_id")
    b = samples(spark, sf_dir).select(F.lit("sample").alias("dataset"), "label")
    return a.unionByName(b, allowMissingColumns=True).groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject_id").alias("subjects"))


@query("SELECT recording_id, channel, idx, round(value, 6) + 0.0 AS value FROM signal WHERE channel IN ('price', 'quantity')")
def select_channels(spark, sf_dir):
    return signal(spark, sf_dir).where(F.col("channel").isin("price", "quantity")).select("recording_id", "channel", "idx", r6("value").alias("value"))


@query("SELECT sample_id, CAST(label % 4 AS INT) AS label, CAST(label % 4 IN (2, 3) AS INT) AS arousal, CAST(label % 4 NOT IN (1, 2) AS INT) AS valence FROM sample")
def class_to_axes(spark, sf_dir):
    s = samples(spark, sf_dir).select("sample_id", (F.col("label") % 4).cast("int").alias("label"))
    arousal, valence = lb.class_to_axes(F.col("label"))
    return s.select("sample_id", "label", arousal.alias("arousal"), valence.alias("valence"))


@query("SELECT 'regular' AS dataset, recording_id, channel, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, NULL AS late FROM signal GROUP BY ALL UNION ALL SELECT 'irregular', recording_id, channel, count(*), round(avg(value), 6) + 0.0, count(*) FILTER (idx > 5) FROM irregular GROUP BY ALL")
def union_datasets(spark, sf_dir):
    """Two datasets with different channels put together, a column of one missing in the other."""
    a = signal(spark, sf_dir).groupBy("recording_id", "channel").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean")).withColumn("dataset", F.lit("regular"))
    b = events(spark, sf_dir).groupBy("recording_id", "channel").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"), F.count_if(F.col("idx") > 5).alias("late")).withColumn("dataset", F.lit("irregular"))
    return a.unionByName(b, allowMissingColumns=True).select("dataset", "recording_id", "channel", "n", "mean", "late")
