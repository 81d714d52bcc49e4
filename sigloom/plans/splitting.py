"""Splits, folds and resampling of the samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.functions.draws import uniform, uniform_sql
from sigloom.operators import splits as sl
from sigloom.operators.ranges import weighted_draws
from sigloom.plans.registry import query, r6, read, recordings, samples

_RANK = f"SELECT *, row_number() OVER (ORDER BY {{u}}, sample_id) - 1 AS rank, count(*) OVER () AS n FROM sample"


@query(f"WITH r AS ({_RANK.format(u=uniform_sql(42, 'split', 'sample_id'))}) SELECT sample_id, CASE WHEN rank < floor(n * 0.7) THEN 'train' WHEN rank < floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM r")
def random_split(spark, sf_dir):
    return sl.random_split(samples(spark, sf_dir), "sample_id", (0.7, 0.15)).select("sample_id", "split")


@query(f"SELECT sample_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {uniform_sql(42, 'strata', 'sample_id')}, sample_id) - 1 < floor(count(*) OVER (PARTITION BY label) * 0.8) THEN 'train' ELSE 'val' END AS split FROM sample")
def stratified_split(spark, sf_dir):
    return sl.stratified_split(samples(spark, sf_dir), "sample_id", "label", 0.8).select("sample_id", "label", "split")


@query(f"WITH r AS ({_RANK.format(u=uniform_sql(42, 'fold', 'sample_id'))}) SELECT sample_id, CAST(CASE WHEN rank < (n % 7) * (n // 7 + 1) THEN rank // (n // 7 + 1) ELSE n % 7 + (rank - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INT) AS fold FROM r")
def k_fold(spark, sf_dir):
    return sl.k_fold(samples(spark, sf_dir), "sample_id", 7).select("sample_id", "fold")


@query(f"WITH r AS (SELECT *, row_number() OVER (ORDER BY {uniform_sql(42, 'logo', 'recording_id')}, recording_id) - 1 AS rank, count(*) OVER () AS n FROM recording WHERE subject_id <> 3) SELECT recording_id, subject_id, CASE WHEN rank < floor(n * (0.15 / (1 - 0.1))) THEN 'val' ELSE 'train' END AS split FROM r UNION ALL SELECT recording_id, subject_id, 'test' FROM recording WHERE subject_id = 3")
def leave_one_group_out(spark, sf_dir):
    return sl.leave_one_group_out(recordings(spark, sf_dir), "recording_id", "subject_id", 3, 0.15, 0.1).select("recording_id", "subject_id", "split")


@query("SELECT f.subject_id AS fold, recording_id, r.subject_id = f.subject_id AS is_test FROM recording r CROSS JOIN (SELECT DISTINCT subject_id FROM recording) f")
def logo_all_folds(spark, sf_dir):
    return sl.all_folds(recordings(spark, sf_dir), "subject_id").select("fold", "recording_id", "is_test")


@query("SELECT sample_id, CASE WHEN row_number() OVER (ORDER BY sample_id) - 1 >= count(*) OVER () - floor(count(*) OVER () * 0.2) THEN 'val' ELSE 'train' END AS split FROM sample")
def tail_validation(spark, sf_dir):
    return sl.tail_validation(samples(spark, sf_dir), "sample_id").select("sample_id", "split")


@query("SELECT recording_id, 'train' AS part FROM recording WHERE subject_id NOT IN (1, 2) UNION ALL SELECT recording_id, 'test' FROM recording WHERE subject_id IN (1, 2)")
def split_complement(spark, sf_dir):
    """Held-out subjects by a semi join, the rest by an anti join."""
    r = recordings(spark, sf_dir)
    held = r.where(F.col("subject_id").isin(1, 2)).select("subject_id").distinct()
    return r.join(held, "subject_id", "left_anti").select("recording_id", F.lit("train").alias("part")).unionByName(r.join(held, "subject_id", "left_semi").select("recording_id", F.lit("test").alias("part")))


@query("SELECT sample_id, label, round(1.0 / count(*) OVER (PARTITION BY label), 8) + 0.0 AS weight FROM sample")
def class_weights(spark, sf_dir):
    return sl.class_weights(samples(spark, sf_dir), "label").select("sample_id", "label", r6("weight", 8).alias("weight"))


@query(f"""WITH r AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY {uniform_sql(42, 'balance', 'sample_id')}, sample_id) - 1 AS rank, count(*) OVER (PARTITION BY label) AS n FROM sample),
c AS (SELECT label, n, row_number() OVER (ORDER BY label) - 1 AS class, count(*) OVER () AS k FROM (SELECT DISTINCT label, n FROM r)),
d AS (SELECT range AS draw, {uniform_sql(42, 'class', 'range')} AS u, {uniform_sql(42, 'row', 'range')} AS v FROM range(0, 10000000) WHERE range < (SELECT count(*) FROM sample))
SELECT draw, sample_id, r.label FROM d JOIN c ON c.class = floor(u * k) JOIN r ON r.label = c.label AND r.rank = floor(v * c.n)""")
def balanced_resample(spark, sf_dir):
    """As many draws as there are samples, classes being equally likely."""
    s = samples(spark, sf_dir)
    return sl.balanced_resample(s, "sample_id", "label", s.count()).select("draw", "sample_id", "label")


@query(f"""WITH w AS (SELECT label, count(*) AS n FROM sample GROUP BY label), c AS (SELECT *, sum(n) OVER (ORDER BY label) - n AS lo, sum(n) OVER (ORDER BY label) AS hi, sum(n) OVER () AS total FROM w)
SELECT range AS draw, label FROM (SELECT range FROM range(0, 10000000) WHERE range < (SELECT count(*) FROM sample)) d JOIN c ON {uniform_sql(42, 'pick', 'range')} * total >= lo AND {uniform_sql(42, 'pick', 'range')} * total < hi""")
def weighted_pick(spark, sf_dir):
    """Draws with replacement in proportion to weights: the label counts, by their cumulative sum."""
    from pyspark.sql import Window as W

    w = samples(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    cum = w.withColumn("hi", F.sum("n").over(W.orderBy("label"))).withColumn("lo", F.col("hi") - F.col("n"))  # one row for each label
    total = samples(spark, sf_dir).count()
    draws = spark.range(total).select(F.col("id").alias("draw"), (uniform(42, "pick", F.col("id")) * total).alias("u"))
    return draws.join(F.broadcast(cum), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", "label")


@query(f"""WITH c AS MATERIALIZED (SELECT o_orderkey, sum(w) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - w AS lo, sum(w) OVER () AS total FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS w FROM orders WHERE o_totalprice > 0)),
d AS (SELECT range AS draw, {uniform_sql(42, 'weighted', 'range')} * (SELECT max(total) FROM c) AS u FROM range(0, 10000000) WHERE range < (SELECT count(*) FROM orders))
SELECT draw, o_orderkey FROM d ASOF JOIN c ON d.u >= c.lo""")
def weighted_rows(spark, sf_dir):
    """As many draws with replacement as there are orders, each order as likely as its price has it."""
    orders = read(spark, sf_dir, "orders")
    draws = spark.range(orders.count()).select(F.col("id").alias("draw"), uniform(42, "weighted", F.col("id")).alias("u"))
    return weighted_draws(orders, "o_orderkey", "o_totalprice", draws).select("draw", "o_orderkey")


@query(f"""WITH r AS (SELECT sample_id, row_number() OVER (ORDER BY {uniform_sql(42, 'order', 'sample_id')}, sample_id) - 1 AS rank, count(*) OVER () AS n FROM sample)
SELECT range AS draw, a.sample_id AS first, b.sample_id AS second FROM (SELECT range FROM range(0, 10000000) WHERE range < (SELECT count(*) FROM sample)) d JOIN r a ON a.rank = floor({uniform_sql(42, 'first', 'range')} * a.n) JOIN r b ON b.rank = floor({uniform_sql(42, 'second', 'range')} * b.n)""")
def random_pairs(spark, sf_dir):
    """As many pairs as there are samples."""
    s = samples(spark, sf_dir)
    return sl.random_pairs(s, "sample_id", s.count())


@query(f"SELECT sample_id, round({uniform_sql(7, 'op', 'sample_id', '3')}, 9) + 0.0 AS u FROM sample")
def keyed_draws(spark, sf_dir):
    return samples(spark, sf_dir).select("sample_id", r6(uniform(7, "op", F.col("sample_id"), 3), 9).alias("u"))
