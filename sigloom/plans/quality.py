"""Quality of augmented data against its originals, and connectivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.functions.draws import normal_sql
from sigloom.operators import augment as ag
from sigloom.operators import connectivity as cn
from sigloom.operators import quality as ql
from sigloom.operators import statistics as st
from sigloom.operators import windows as wn
from sigloom.plans.augmentation import _KEY3, _LONG, _span, long
from sigloom.plans.registry import events, query, r6, samples, signal

_NOISY = f"noisy AS (SELECT sample_id, channel, idx, value AS a, value + {normal_sql(1, 'noise', _KEY3)} * stddev_pop(value) OVER (PARTITION BY sample_id) * {_span('level', 'sample_id', 0.001, 0.05)} AS b FROM long)"


def paired(spark, sf_dir):
    """(sample_id, channel, idx, a, b): originals and their noisy copies, side by side."""
    return long(spark, sf_dir).withColumn("b", F.col("value") + ag.noise()).withColumnRenamed("value", "a")


@query(f"WITH {_LONG}, {_NOISY} SELECT sample_id, round(stddev_pop(b) / stddev_pop(a), 5) + 0.0 AS ratio, abs(stddev_pop(b) / stddev_pop(a) - 1) < 3 AS passed FROM noisy GROUP BY ALL")
def amplitude_check(spark, sf_dir):
    return ql.amplitude_check(paired(spark, sf_dir), ["sample_id"]).withColumn("ratio", r6("ratio", 5))


@query(f"WITH {_LONG}, {_NOISY} SELECT sample_id, round(corr(a, b), 5) + 0.0 AS r, round(abs(avg(a) - avg(b)), 6) + 0.0 AS mean_shift FROM noisy GROUP BY ALL")
def pair_correlation(spark, sf_dir):
    return ql.pair_correlation(paired(spark, sf_dir), ["sample_id"]).select("sample_id", r6("r", 5).alias("r"), r6("mean_shift").alias("mean_shift"))


@query(f"WITH {_LONG}, {_NOISY} SELECT sample_id, channel, count(*) AS n, round(sum(a * b), 4) + 0.0 AS ab FROM noisy GROUP BY ALL")
def pair_original_augmented(spark, sf_dir):
    return paired(spark, sf_dir).groupBy("sample_id", "channel").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("a") * F.col("b")), 4).alias("ab"))


_SPEC = """flatp AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY channel, idx) - 1 AS pos, count(*) OVER (PARTITION BY sample_id) AS n, a, b FROM noisy),
mags AS (SELECT sample_id, n, k AS bin, sqrt(pow(sum(a * cos(2 * pi() * ((pos * k) % n) / n)), 2) + pow(sum(a * sin(2 * pi() * ((pos * k) % n) / n)), 2)) AS ma, sqrt(pow(sum(b * cos(2 * pi() * ((pos * k) % n) / n)), 2) + pow(sum(b * sin(2 * pi() * ((pos * k) % n) / n)), 2)) AS mb
  FROM flatp JOIN range(0, 20000) r(k) ON k <= n // 2 GROUP BY ALL)"""


@query(f"WITH {_LONG}, {_NOISY}, {_SPEC} SELECT sample_id, round(corr(ma, mb), 5) + 0.0 AS r, corr(ma, mb) >= 0.7 AS passed FROM mags GROUP BY ALL")
def spectral_similarity(spark, sf_dir):
    """Fourier magnitudes of whole samples, all channels."""
    return ql.spectral_similarity(paired(spark, sf_dir)).select("sample_id", r6("r", 5).alias("r"), "passed")


@query(f"WITH {_LONG}, {_NOISY}, {_SPEC}, b AS (SELECT *, CASE WHEN bin * 128.0 / n < 0.5 THEN NULL WHEN bin * 128.0 / n < 4 THEN 'delta' WHEN bin * 128.0 / n < 8 THEN 'theta' WHEN bin * 128.0 / n < 13 THEN 'alpha' WHEN bin * 128.0 / n < 30 THEN 'beta' END AS band FROM mags) SELECT sample_id, band, round(sum(mb * mb) / (sum(ma * ma) + 1e-10), 5) + 0.0 AS ratio FROM b WHERE band IS NOT NULL GROUP BY ALL")
def band_power_ratio(spark, sf_dir):
    wide = ql.spectral_similarity(paired(spark, sf_dir))
    return wide.unpivot("sample_id", list(ql.RATIO_BANDS), "band", "ratio").select("sample_id", "band", r6("ratio", 5).alias("ratio"))


_KS = """u AS (SELECT channel, value, count(*) FILTER (recording_id % 2 = 1) AS c1, count(*) FILTER (recording_id % 2 = 0) AS c2 FROM irregular GROUP BY ALL),
f AS (SELECT channel, abs(sum(c1) OVER w / sum(c1) OVER (PARTITION BY channel) - sum(c2) OVER w / sum(c2) OVER (PARTITION BY channel)) AS gap FROM u WINDOW w AS (PARTITION BY channel ORDER BY value ROWS UNBOUNDED PRECEDING)),
d AS (SELECT channel, max(gap) AS d FROM f GROUP BY channel),
m AS (SELECT channel, count(*) FILTER (recording_id % 2 = 1) AS n1, count(*) FILTER (recording_id % 2 = 0) AS n2, avg(value) FILTER (recording_id % 2 = 1) AS mean1, avg(value) FILTER (recording_id % 2 = 0) AS mean2, var_pop(value) FILTER (recording_id % 2 = 0) / var_pop(value) FILTER (recording_id % 2 = 1) AS var_ratio FROM irregular GROUP BY channel),
x AS (SELECT *, (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * d AS x FROM d JOIN m USING (channel)),
p AS (SELECT channel, d, mean1, mean2, var_ratio, CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest(2 * sum(CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2 * k * k * x * x)), 0), 1) END AS p FROM x, range(1, 101) t(k) GROUP BY channel, d, mean1, mean2, var_ratio, x)"""


@query(f"WITH {_KS} SELECT channel, round(d, 6) + 0.0 AS d, round(p, 5) + 0.0 AS p, p > 0.05 AS passed, round(mean1, 5) + 0.0 AS mean1, round(mean2, 5) + 0.0 AS mean2, round(var_ratio, 5) + 0.0 AS var_ratio FROM p")
def ks_two_sample(spark, sf_dir):
    """Odd against even users, by type of event."""
    both = events(spark, sf_dir).select("channel", "value", F.when(F.col("recording_id") % 2 == 1, 1).otherwise(2).alias("side"))
    k = ql.ks_two_sample(both, ["channel"])
    return k.select("channel", r6("d").alias("d"), r6("p", 5).alias("p"), "passed", *[r6(c, 5).alias(c) for c in ("mean1", "mean2", "var_ratio")])


_SIDE = "CASE WHEN sample_id % 2 = 1 THEN 1 ELSE 2 END"
_SOME = f"few AS (SELECT side, sample_id, x FROM (SELECT {_SIDE} AS side, sample_id, x, row_number() OVER (PARTITION BY {_SIDE} ORDER BY sample_id) AS r FROM sample) WHERE r <= 100), k AS (SELECT a.side AS s, b.side AS t, avg(exp(-list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))) AS k, count(*) AS n FROM few a, few b GROUP BY ALL)"


def sides(spark, sf_dir):
    return samples(spark, sf_dir).withColumn("side", F.when(F.col("sample_id") % 2 == 1, 1).otherwise(2))


@query(f"WITH {_SOME} SELECT round(sqrt(greatest(sum(CASE WHEN s = t THEN k ELSE -k END), 0)), 5) + 0.0 AS mmd FROM k")
def mmd_rbf(spark, sf_dir):
    """Kernel distance of the first hundred odd and even vectors; the rule has that cap."""
    return ql.mmd_rbf(sides(spark, sf_dir)).select(r6("mmd", 5).alias("mmd"))


@query(f"WITH every AS (SELECT {_SIDE} AS side, x FROM sample), k AS (SELECT a.side AS s, b.side AS t, avg(exp(-list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))) AS k FROM every a, every b GROUP BY ALL) SELECT round(sqrt(greatest(sum(CASE WHEN s = t THEN k ELSE -k END), 0)), 5) + 0.0 AS mmd FROM k")
def mmd_rbf_all(spark, sf_dir):
    """Kernel distance of all odd and even vectors, tile by tile."""
    return ql.mmd_rbf(sides(spark, sf_dir), limit=None).select(r6("mmd", 5).alias("mmd"))


@query(f"WITH d AS (SELECT i, avg(v) FILTER (sample_id % 2 = 1) - avg(v) FILTER (sample_id % 2 = 0) AS d FROM flat GROUP BY i) SELECT round(sqrt(sum(d * d)), 6) + 0.0 AS mmd FROM d")
def mmd_linear(spark, sf_dir):
    return ql.mmd_linear(sides(spark, sf_dir)).select(r6("mmd").alias("mmd"))


@query(f"WITH {_SOME} SELECT s, t, n, round(k, 6) + 0.0 AS k FROM k")
def kernel_pairs(spark, sf_dir):
    """Mean kernels within and between the sides' first hundred vectors."""
    return ql.kernel_means(sides(spark, sf_dir), []).select("s", "t", "n", r6("k").alias("k"))


_SIDED = "vec AS (SELECT sample_id, 1 AS side, channel, idx, a AS v FROM noisy UNION ALL SELECT sample_id, 2, channel, idx, b FROM noisy)"
_KS2 = """u AS (SELECT sample_id, v, count(*) FILTER (side = 1) AS c1, count(*) FILTER (side = 2) AS c2 FROM vec GROUP BY ALL),
g AS (SELECT sample_id, abs(sum(c1) OVER w / sum(c1) OVER (PARTITION BY sample_id) - sum(c2) OVER w / sum(c2) OVER (PARTITION BY sample_id)) AS gap, sum(c1) OVER (PARTITION BY sample_id) AS n1 FROM u WINDOW w AS (PARTITION BY sample_id ORDER BY v ROWS UNBOUNDED PRECEDING)),
x AS (SELECT sample_id, (sqrt(n1 / 2) + 0.12 + 0.11 / sqrt(n1 / 2)) * max(gap) AS x FROM g GROUP BY sample_id, n1),
ks AS (SELECT sample_id, CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest(2 * sum(CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2 * k * k * x * x)), 0), 1) END > 0.05 AS distribution FROM x, range(1, 101) t(k) GROUP BY sample_id, x)"""
_MMD2 = """kk AS (SELECT p.sample_id, p.side AS s, q.side AS t, p.channel AS c, q.channel AS e, exp(-sum((p.v - q.v) * (p.v - q.v))) AS k FROM vec p JOIN vec q ON q.sample_id = p.sample_id AND q.idx = p.idx GROUP BY ALL),
km AS (SELECT sample_id, s, t, avg(k) AS k FROM kk GROUP BY ALL), mm AS (SELECT sample_id, sqrt(greatest(sum(CASE WHEN s = t THEN k ELSE -k END), 0)) AS mmd FROM km GROUP BY sample_id)"""
_CHECKS = f"""{_LONG}, {_NOISY}, {_SPEC}, {_SIDED}, {_KS2}, {_MMD2}, amp AS (SELECT sample_id, abs(stddev_pop(b) / stddev_pop(a) - 1) < 3 AS amplitude FROM noisy GROUP BY ALL), spc AS (SELECT sample_id, corr(ma, mb) >= 0.7 AS spectral FROM mags GROUP BY ALL),
s AS (SELECT *, mmd < 0.5 AS kernel, (amplitude::INT + spectral::INT + distribution::INT + (mmd < 0.5)::INT) * 0.25 AS score FROM amp JOIN spc USING (sample_id) JOIN ks USING (sample_id) JOIN mm USING (sample_id))"""


def scores(spark, sf_dir):
    return ql.quality_score(ql.sample_checks(paired(spark, sf_dir)), ql.CHECKS)


@query(f"WITH {_CHECKS} SELECT sample_id, amplitude, spectral, distribution, kernel, round(mmd, 5) + 0.0 AS mmd, CAST(score AS DOUBLE) AS score, score >= 0.5 AS accepted FROM s")
def quality_score(spark, sf_dir):
    """Four checks of each sample and its noisy copy: amplitude, spectrum, distribution and kernel distance."""
    return scores(spark, sf_dir).select("sample_id", *ql.CHECKS, r6("mmd", 5).alias("mmd"), F.col("score").cast("double").alias("score"), "accepted")


@query(f"WITH {_CHECKS} SELECT count(*) AS n, avg(CAST(score >= 0.5 AS DOUBLE)) AS pass_rate, round(avg(CAST(score AS DOUBLE)), 6) + 0.0 AS mean_score, round(avg(mmd), 5) + 0.0 AS mean_mmd, round(avg(CAST(amplitude AS DOUBLE)), 6) + 0.0 AS amplitude_rate, round(avg(CAST(spectral AS DOUBLE)), 6) + 0.0 AS spectral_rate, round(avg(CAST(distribution AS DOUBLE)), 6) + 0.0 AS distribution_rate, round(avg(CAST(kernel AS DOUBLE)), 6) + 0.0 AS kernel_rate FROM s")
def quality_pass_rates(spark, sf_dir):
    rates = ql.pass_rates(scores(spark, sf_dir), ql.CHECKS)
    return rates.select("n", "pass_rate", r6("mean_score").alias("mean_score"), r6("mean_mmd", 5).alias("mean_mmd"), *[r6(f"{c}_rate").alias(f"{c}_rate") for c in ql.CHECKS])


_POINTS = """w AS (SELECT recording_id, channel, CAST(idx // 64 AS BIGINT) AS window_id, idx % 64 AS t, value, count(*) OVER (PARTITION BY recording_id, channel, idx // 64) AS n FROM signal),
e AS (SELECT recording_id, channel, window_id, t, value AS v0, lead(value, 10) OVER o AS v1, lead(value, 20) OVER o AS v2, lead(value, 21) OVER o AS nxt FROM w WHERE n = 64 WINDOW o AS (PARTITION BY recording_id, channel, window_id ORDER BY t)),
l AS MATERIALIZED (SELECT * FROM e WHERE nxt IS NOT NULL),
oy AS (SELECT a.recording_id, a.window_id, a.channel, a.t, min(sqrt(pow(a.v0 - b.v0, 2) + pow(a.v1 - b.v1, 2) + pow(a.v2 - b.v2, 2) + pow(a.nxt - b.nxt, 2)), 4)[4] AS r FROM l a JOIN l b ON a.recording_id = b.recording_id AND a.window_id = b.window_id AND a.channel = b.channel AND a.t <> b.t GROUP BY ALL)"""
_TE = _POINTS + """,
hy AS (SELECT recording_id, window_id, channel, 4 * avg(ln(r + 1e-10)) + ln(count(*)) + 0.5772156649015329 AS h FROM oy GROUP BY ALL),
j AS MATERIALIZED (SELECT y.recording_id, y.window_id, x.channel AS src, y.channel AS dst, y.t, y.v0, y.v1, y.v2, y.nxt, x.v0 AS x0, x.v1 AS x1, x.v2 AS x2 FROM l y JOIN l x ON y.recording_id = x.recording_id AND y.window_id = x.window_id AND y.t = x.t AND x.channel <> y.channel),
jr AS (SELECT a.recording_id, a.window_id, a.src, a.dst, a.t, min(sqrt(pow(a.v0 - b.v0, 2) + pow(a.v1 - b.v1, 2) + pow(a.v2 - b.v2, 2) + pow(a.x0 - b.x0, 2) + pow(a.x1 - b.x1, 2) + pow(a.x2 - b.x2, 2) + pow(a.nxt - b.nxt, 2)), 4)[4] AS r FROM j a JOIN j b ON a.recording_id = b.recording_id AND a.window_id = b.window_id AND a.src = b.src AND a.dst = b.dst AND a.t <> b.t GROUP BY ALL),
hj AS (SELECT recording_id, window_id, src, dst, 7 * avg(ln(r + 1e-10)) + ln(count(*)) + 0.5772156649015329 AS hj FROM jr GROUP BY ALL)"""
_BY = ["recording_id", "window_id"]


def windows(spark, sf_dir, size):
    w = wn.tumbling_windows(signal(spark, sf_dir, "n"), size, "n")
    return w.select("recording_id", "channel", F.col("window_id").cast("long").alias("window_id"), "pos", "value")


@query(f"WITH {_TE} SELECT hj.recording_id, hj.window_id, src, dst, round(greatest(h - hj, 0), 5) + 0.0 AS value FROM hj JOIN hy ON hy.recording_id = hj.recording_id AND hy.window_id = hj.window_id AND hy.channel = hj.dst")
def transfer_entropy(spark, sf_dir):
    """Between all channels in every tumbling window of 64."""
    return cn.transfer_entropy(windows(spark, sf_dir, 64), _BY).select(*_BY, "src", "dst", r6("value", 5).alias("value"))


@query(f"WITH {_POINTS} SELECT recording_id, window_id, channel, t, round(r, 6) + 0.0 AS r FROM oy")
def kth_distance(spark, sf_dir):
    """Distance of each delay vector and its next value to the fourth nearest other one, in every window of 64."""
    return cn.kth_distance(windows(spark, sf_dir, 64), _BY).select(*_BY, "channel", "t", r6("r").alias("r"))


@query()
def lagged_ols(spark, sf_dir):
    """Ten lags of all channels in every window of 128; small systems, tested against a direct solution."""
    return cn.lagged_ols(windows(spark, sf_dir, 128), _BY)


def measures(spark, sf_dir):
    w = windows(spark, sf_dir, 128)
    return cn.connectivity_set({"te": cn.transfer_entropy(w, _BY), "corr": st.correlation_matrix(w, _BY, "pos"), "ols": cn.lagged_ols(w, _BY)})


@query()
def connectivity_set(spark, sf_dir):
    """Transfer entropy, correlation and regression edges of every window of 128 in one table; tested by its parts."""
    return measures(spark, sf_dir)


@query()
def connectivity_grids(spark, sf_dir):
    """Each measure of every window of 128 as a matrix of channels; tested against its edges."""
    return cn.connectivity_grids(measures(spark, sf_dir), _BY, ["discount", "price", "quantity", "tax"])
