"""Windows, differences and statistics over the signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.operators import statistics as st
from sigloom.operators import windows as wn
from sigloom.plans.registry import events, query, r6, signal, wide_signal

_WINDOWS = """framed AS (SELECT s.recording_id, s.channel, w.window_id, s.idx - w.window_id * 64 AS pos, s.value
  FROM signal s JOIN (SELECT recording_id, channel, max(idx) + 1 AS n FROM signal GROUP BY ALL) l USING (recording_id, channel)
  JOIN (SELECT CAST(range AS BIGINT) AS window_id FROM range(0, 200)) w ON s.idx >= w.window_id * 64 AND s.idx < w.window_id * 64 + 128 AND w.window_id * 64 + 128 <= l.n)"""
_STATS = """round(avg(value), 6) + 0.0 AS mean, round(var_pop(value), 6) + 0.0 AS var, round(stddev_pop(value), 6) + 0.0 AS std,
  round(avg((value - m) * (value - m) * (value - m)) / pow(stddev_pop(value), 3), 5) + 0.0 AS skew, round(kurtosis_pop(value), 5) + 0.0 AS kurt,
  round(sqrt(avg(value * value)), 6) + 0.0 AS rms, round(0.5 * ln(2 * pi() * exp(1.0) * CASE WHEN var_pop(value) = 0 THEN 1e-10 ELSE var_pop(value) END), 6) + 0.0 AS entropy"""


@query(f"""WITH {_WINDOWS}, centred AS (SELECT *, avg(value) OVER (PARTITION BY recording_id, channel, window_id) AS m FROM framed)
SELECT recording_id, channel, window_id, {_STATS} FROM centred GROUP BY ALL""")
def window_features(spark, sf_dir):
    """Sliding windows of 128 by 64 with the statistics of each."""
    by = ["recording_id", "channel", "window_id"]
    f = st.stat_features(wn.sliding_windows(signal(spark, sf_dir, "n"), 128, 64, "n"), by)
    return f.select("recording_id", "channel", F.col("window_id").cast("long").alias("window_id"), *[r6(c, 5 if c in ("skew", "kurt") else 6).alias(c) for c in f.columns[3:]])


@query(f"""WITH {_WINDOWS}, d AS (SELECT *, value - lag(value) OVER w AS d1 FROM framed WINDOW w AS (PARTITION BY recording_id, channel, window_id ORDER BY pos)),
dd AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY recording_id, channel, window_id ORDER BY pos) AS d2 FROM d),
v AS (SELECT recording_id, channel, window_id, var_pop(value) AS activity, var_pop(d1) AS v1, var_pop(d2) AS v2 FROM dd GROUP BY ALL)
SELECT recording_id, channel, window_id, round(activity, 6) + 0.0 AS activity, round(CASE WHEN activity > 0 THEN sqrt(v1 / activity) ELSE 0 END, 6) + 0.0 AS mobility,
  round(CASE WHEN v1 > 0 AND activity > 0 THEN sqrt(v2 / v1) / sqrt(v1 / activity) ELSE 0 END, 6) + 0.0 AS complexity FROM v""")
def hjorth(spark, sf_dir):
    """Hjorth parameters of sliding windows."""
    h = st.hjorth(wn.sliding_windows(signal(spark, sf_dir, "n"), 128, 64, "n"), ["recording_id", "channel", "window_id"], "pos")
    return h.select("recording_id", "channel", F.col("window_id").cast("long").alias("window_id"), *[r6(c).alias(c) for c in ("activity", "mobility", "complexity")])


@query("""SELECT recording_id, channel, CAST(floor(idx / 64) AS BIGINT) AS window_id, round(avg(value), 6) + 0.0 AS mean, round(sqrt(avg(value * value)), 6) + 0.0 AS rms
FROM signal GROUP BY ALL HAVING count(*) = 64""")
def tumbling_rms(spark, sf_dir):
    """Tumbling windows of 64: mean and root mean square."""
    w = wn.tumbling_windows(signal(spark, sf_dir, "n"), 64, "n").groupBy("recording_id", "channel", "window_id").agg(F.avg("value").alias("mean"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    return w.select("recording_id", "channel", F.col("window_id").cast("long").alias("window_id"), r6("mean").alias("mean"), r6("rms").alias("rms"))


@query("""WITH a AS (SELECT *, value - lag(value) OVER (PARTITION BY recording_id, channel ORDER BY idx) AS d FROM irregular),
b AS (SELECT *, d - lag(d) OVER (PARTITION BY recording_id, channel ORDER BY idx) AS dd FROM a WHERE d IS NOT NULL)
SELECT recording_id, channel, idx, round(dd, 6) + 0.0 AS value FROM b WHERE dd IS NOT NULL""")
def difference(spark, sf_dir):
    """Second difference of the irregular signal."""
    return wn.difference(events(spark, sf_dir), 2).select("recording_id", "channel", "idx", r6("value").alias("value"))


@query("""SELECT recording_id, channel, idx, round(value, 6) + 0.0 AS x0, round(x1, 6) + 0.0 AS x1, round(x2, 6) + 0.0 AS x2, round(target, 6) + 0.0 AS target FROM (
SELECT *, lead(value, 10) OVER w AS x1, lead(value, 20) OVER w AS x2, lead(value, 21) OVER w AS target FROM signal WINDOW w AS (PARTITION BY recording_id, channel ORDER BY idx)) WHERE x2 IS NOT NULL""")
def delay_embedding(spark, sf_dir):
    """Three values ten samples apart, and the next one."""
    d = wn.delay_embedding(signal(spark, sf_dir))
    return d.select("recording_id", "channel", "idx", *[r6(c).alias(c) for c in ("x0", "x1", "x2", "target")])


@query("""WITH t AS (SELECT recording_id, channel, CAST(floor(idx / 64) AS BIGINT) AS window_id, avg(value) AS m FROM signal GROUP BY ALL HAVING count(*) = 64),
l AS (SELECT *, max(window_id) OVER (PARTITION BY recording_id, channel) AS last FROM t)
SELECT recording_id, channel, window_id - p AS block_id, round(avg(m), 6) + 0.0 AS mean, count(*) AS n FROM l, range(0, 3) r(p) WHERE window_id - p >= 0 AND window_id - p + 2 <= last GROUP BY ALL""")
def consecutive_blocks(spark, sf_dir):
    """Runs of three tumbling windows."""
    t = wn.tumbling_windows(signal(spark, sf_dir, "n"), 64, "n").groupBy("recording_id", "channel", "window_id").agg(F.avg("value").alias("m"))
    b = wn.consecutive_blocks(t, 3).groupBy("recording_id", "channel", "block_id").agg(F.avg("m").alias("mean"), F.count(F.lit(1)).alias("n"))
    return b.select("recording_id", "channel", F.col("block_id").cast("long").alias("block_id"), r6("mean").alias("mean"), "n")


@query("SELECT recording_id, channel, CAST(idx - 96 AS INT) AS idx, round(value, 6) + 0.0 AS value FROM signal WHERE idx >= 96 AND idx < 352")
def crop_range(spark, sf_dir):
    """A baseline dropped and the range after it kept."""
    return wn.crop_range(signal(spark, sf_dir), 96, 352).select("recording_id", "channel", "idx", r6("value").alias("value"))


@query("""SELECT recording_id, channel, idx, round(value, 6) + 0.0 AS value FROM (SELECT *, count(*) OVER (PARTITION BY recording_id, channel) AS n FROM irregular) WHERE n >= 12""")
def min_length_filter(spark, sf_dir):
    """Series of the irregular signal with at least 12 samples."""
    return wn.min_length(events(spark, sf_dir), 12).select("recording_id", "channel", "idx", r6("value").alias("value"))


_HISTORY = "history AS (SELECT recording_id AS run, channel AS metric, idx AS epoch, value, 1 + idx % 3 AS n FROM irregular)"


def history(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("recording_id").alias("run"), F.col("channel").alias("metric"), F.col("idx").alias("epoch"), "value", (1 + F.col("idx") % 3).alias("n"))


@query(f"WITH {_HISTORY} SELECT run, metric, epoch, round(sum(value * n) OVER w / sum(n) OVER w, 6) + 0.0 AS running FROM history WINDOW w AS (PARTITION BY run, metric ORDER BY epoch ROWS UNBOUNDED PRECEDING)")
def running_weighted_mean(spark, sf_dir):
    return wn.running_mean(history(spark, sf_dir), ["run", "metric"], "epoch", "value", "n").select("run", "metric", "epoch", r6("running").alias("running"))


@query(f"WITH {_HISTORY} SELECT run, metric, round(arg_max(value, epoch), 6) + 0.0 AS latest FROM history GROUP BY ALL")
def latest_value(spark, sf_dir):
    return wn.latest(history(spark, sf_dir), ["run", "metric"], "epoch", "value").select("run", "metric", r6("latest").alias("latest"))


@query(f"WITH {_HISTORY} SELECT run, metric, epoch, coalesce(value < min(value) OVER (PARTITION BY run, metric ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM history")
def running_best(spark, sf_dir):
    return wn.running_best(history(spark, sf_dir), ["run", "metric"], "epoch", "value").select("run", "metric", "epoch", "is_best")


@query()
def patience_stop(spark, sf_dir):
    """Early stopping over the histories; sequential state, so tested against a loop."""
    return wn.patience_stop(history(spark, sf_dir), ["run", "metric"], "epoch", "value", 3, 0.01)


@query("""SELECT channel, value, round(sum(n1) OVER w / sum(n1) OVER (PARTITION BY channel), 6) + 0.0 AS f1, round(sum(n2) OVER w / sum(n2) OVER (PARTITION BY channel), 6) + 0.0 AS f2
FROM (SELECT channel, value, count(*) FILTER (recording_id % 2 = 1) AS n1, count(*) FILTER (recording_id % 2 = 0) AS n2 FROM irregular GROUP BY ALL)
WINDOW w AS (PARTITION BY channel ORDER BY value ROWS UNBOUNDED PRECEDING)""")
def cumulative_ecdf(spark, sf_dir):
    """Distribution functions of odd and even users' values by type of event."""
    both = events(spark, sf_dir).select("channel", "value", F.when(F.col("recording_id") % 2 == 1, 1).otherwise(2).alias("side"))
    return wn.ecdf(both, ["channel"]).select("channel", "value", r6("f1").alias("f1"), r6("f2").alias("f2"))


@query("""SELECT channel, round(q1, 6) + 0.0 AS q1, round(median, 6) + 0.0 AS median, round(q3, 6) + 0.0 AS q3, round(mean, 6) + 0.0 AS mean, round(min(value), 6) + 0.0 AS low, round(max(value), 6) + 0.0 AS high
FROM irregular JOIN (SELECT channel, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, avg(value) AS mean FROM irregular GROUP BY channel) USING (channel)
WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""")
def box_stats(spark, sf_dir):
    b = st.box_stats(events(spark, sf_dir), ["channel"])
    return b.select("channel", *[r6(c).alias(c) for c in ("q1", "median", "q3", "mean", "low", "high")])


@query("""WITH p AS (SELECT a.recording_id, a.channel AS src, b.channel AS dst, CAST(floor(a.idx / 64) AS BIGINT) AS window_id, a.value AS x, b.value AS y FROM signal a JOIN signal b USING (recording_id, idx) WHERE a.channel <> b.channel)
SELECT recording_id, window_id, src, dst, round(abs(corr(x, y)), 5) + 0.0 AS value FROM p GROUP BY ALL HAVING count(*) = 64""")
def correlation_matrix(spark, sf_dir):
    """Absolute correlation of every pair of channels in tumbling windows."""
    w = wn.tumbling_windows(signal(spark, sf_dir, "n"), 64, "n")
    c = st.correlation_matrix(w, ["recording_id", "window_id"], "pos")
    return c.select("recording_id", F.col("window_id").cast("long").alias("window_id"), "src", "dst", r6("value", 5).alias("value"))


@query("""SELECT recording_id, src, dst, round(sum(x * y), 4) + 0.0 AS xy, count(*) AS n FROM (SELECT a.recording_id, a.channel AS src, b.channel AS dst, a.value AS x, b.value AS y FROM signal a JOIN signal b USING (recording_id, idx) WHERE a.channel <> b.channel) GROUP BY ALL""")
def channel_pairs(spark, sf_dir):
    p = st.channel_pairs(signal(spark, sf_dir), ["recording_id"])
    return p.groupBy("recording_id", "src", "dst").agg(r6(F.sum(F.col("x") * F.col("y")), 4).alias("xy"), F.count(F.lit(1)).alias("n"))


@query("""SELECT recording_id, idx, channel, round(value, 6) + 0.0 AS value FROM signal""")
def wide_to_long(spark, sf_dir):
    w = wide_signal(spark, sf_dir)
    return w.unpivot(["recording_id", "idx"], [c for c in w.columns if c not in ("recording_id", "idx")], "channel", "value").select("recording_id", "idx", "channel", r6("value").alias("value"))
