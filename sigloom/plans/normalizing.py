"""Normalizers fitted and applied."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.functions.draws import uniform_sql
from sigloom.operators import normalize as nm
from sigloom.operators import splits as sl
from sigloom.plans.registry import query, r6, samples, signal

_Z = "SELECT channel, avg(value) AS center, CASE WHEN stddev_pop(value) < 1e-8 THEN 1 ELSE stddev_pop(value) END AS scale FROM signal GROUP BY channel"
_M = "SELECT channel, min(value) AS center, CASE WHEN max(value) - min(value) < 1e-8 THEN 1 ELSE max(value) - min(value) END AS scale FROM signal GROUP BY channel"
_R = "SELECT channel, quantile_cont(value, 0.5) AS center, CASE WHEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) < 1e-8 THEN 1 ELSE quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END AS scale FROM signal GROUP BY channel"


@query(f"SELECT 'zscore' AS method, channel, round(center, 6) + 0.0 AS center, round(scale, 6) + 0.0 AS scale FROM ({_Z}) UNION ALL SELECT 'minmax', channel, round(center, 6) + 0.0, round(scale, 6) + 0.0 FROM ({_M}) UNION ALL SELECT 'robust', channel, round(center, 6) + 0.0, round(scale, 6) + 0.0 FROM ({_R})")
def fit_normalizer(spark, sf_dir):
    """Three methods fitted for each channel."""
    s = signal(spark, sf_dir)
    parts = [nm.fit(s, ["channel"], m).select(F.lit(m).alias("method"), "channel", r6("center").alias("center"), r6("scale").alias("scale")) for m in ("zscore", "minmax", "robust")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT recording_id, channel, idx, round((value - center) / scale, 5) + 0.0 AS value FROM signal JOIN ({_R}) USING (channel)")
def apply_normalizer(spark, sf_dir):
    """The robust method applied."""
    s = signal(spark, sf_dir)
    return nm.apply(s, nm.fit(s, ["channel"], "robust"), ["channel"]).select("recording_id", "channel", "idx", r6("value", 5).alias("value"))


@query(f"""WITH r AS (SELECT sample_id, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {uniform_sql(42, 'strata', 'sample_id')}, sample_id) - 1 < floor(count(*) OVER (PARTITION BY label) * 0.8) THEN 'train' ELSE 'val' END AS split FROM sample),
t AS (SELECT i, avg(v) AS m, CASE WHEN stddev_pop(v) < 1e-8 THEN 1 ELSE stddev_pop(v) END AS s FROM flat JOIN r USING (sample_id) WHERE split = 'train' GROUP BY i)
SELECT sample_id, split, i, round((v - m) / s, 5) + 0.0 AS value FROM flat JOIN r USING (sample_id) JOIN t USING (i)""")
def standard_scaler(spark, sf_dir):
    """Fitted on the training part alone and applied to both."""
    s = samples(spark, sf_dir)
    parts = sl.stratified_split(s, "sample_id", "label", 0.8).select("sample_id", "split")
    rows = s.select("sample_id", F.posexplode("x").alias("i", "value")).join(parts, "sample_id")
    done = nm.apply(rows, nm.fit(rows.where("split = 'train'"), ["i"]), ["i"])
    return done.select("sample_id", "split", F.col("i").cast("long").alias("i"), r6("value", 5).alias("value"))
