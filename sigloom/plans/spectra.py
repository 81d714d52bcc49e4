"""Spectra of the signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.operators import filters as fl
from sigloom.operators import spectral as sp
from sigloom.operators import vectors as vc
from sigloom.operators import windows as wn
from sigloom.plans.registry import CHANNELS, query, r6, signal, wide_signal

FRAMES = """framed AS (SELECT s.recording_id, s.channel, f.frame, s.idx + 32 - f.frame * 32 AS pos, s.value FROM signal s
  JOIN (SELECT recording_id, channel, max(idx) + 1 AS n FROM signal GROUP BY ALL) l USING (recording_id, channel)
  JOIN (SELECT CAST(range AS INT) AS frame FROM range(0, 400)) f ON s.idx + 32 >= f.frame * 32 AND s.idx + 32 < f.frame * 32 + 64 AND f.frame <= ceil(n / 32.0)),
basis AS (SELECT p.range AS pos, CAST(b.range AS INT) AS bin, (0.5 - 0.5 * cos(2 * pi() * p.range / 64)) * cos(2 * pi() * ((p.range * b.range) % 64) / 64) / 32.0 AS c, -(0.5 - 0.5 * cos(2 * pi() * p.range / 64)) * sin(2 * pi() * ((p.range * b.range) % 64) / 64) / 32.0 AS s FROM range(0, 64) p, range(0, 33) b),
spectrum AS (SELECT recording_id, channel, frame, bin, sum(value * c) AS re, sum(value * s) AS im FROM framed JOIN basis USING (pos) GROUP BY ALL)"""


@query(f"WITH {FRAMES} SELECT recording_id, channel, frame, bin, round(sqrt(re * re + im * im), 6) + 0.0 AS mag FROM spectrum")
def stft_magnitude(spark, sf_dir):
    """Short-time spectra of frames of 64 by 32."""
    return sp.stft(signal(spark, sf_dir), 64, 32).select("recording_id", "channel", "frame", "bin", r6("mag").alias("mag"))


@query(f"WITH {FRAMES} SELECT recording_id, channel, frame, count(*) AS bins, round(sum(sqrt(re * re + im * im)), 5) + 0.0 AS mag FROM spectrum WHERE bin BETWEEN 2 AND 25 GROUP BY ALL")
def freq_crop(spark, sf_dir):
    """Bins of 4 to 50 Hz at 128 Hz."""
    s = sp.stft(signal(spark, sf_dir), 64, 32, bins=sp.bins_between(128, 64, 4, 50))
    return s.groupBy("recording_id", "channel", "frame").agg(F.count(F.lit(1)).alias("bins"), r6(F.sum("mag"), 5).alias("mag"))


_PSD = """w AS (SELECT recording_id, channel, CAST(floor(idx / 64) AS BIGINT) AS window_id, idx % 64 AS pos, value, count(*) OVER p AS n, avg(value) OVER p AS m FROM signal WINDOW p AS (PARTITION BY recording_id, channel, floor(idx / 64))),
turn AS (SELECT p.range AS pos, CAST(b.range AS INT) AS bin, cos(2 * pi() * ((p.range * b.range) % 64) / 64) AS c, -sin(2 * pi() * ((p.range * b.range) % 64) / 64) AS s FROM range(0, 64) p, range(0, 33) b),
psd AS (SELECT recording_id, channel, window_id, bin, CASE WHEN bin IN (0, 32) THEN 1.0 ELSE 2.0 END * (pow(sum((value - m) * c), 2) + pow(sum((value - m) * s), 2)) / (128.0 * 64) AS psd FROM w JOIN turn USING (pos) WHERE n = 64 GROUP BY recording_id, channel, window_id, bin)"""


def psd(spark, sf_dir):
    w = wn.tumbling_windows(signal(spark, sf_dir, "n"), 64, "n")
    return sp.periodogram(w.withColumn("window_id", F.col("window_id").cast("long")), ["recording_id", "channel", "window_id"], 64, 128.0)


@query(f"WITH {_PSD} SELECT recording_id, channel, window_id, bin, round(psd, 7) + 0.0 AS psd FROM psd WHERE bin > 0")
def periodogram(spark, sf_dir):
    return psd(spark, sf_dir).where("bin > 0").select("recording_id", "channel", "window_id", "bin", r6("psd", 7).alias("psd"))


@query(f"WITH {_PSD}, q AS (SELECT *, psd / sum(psd) OVER (PARTITION BY recording_id, channel, window_id) AS p FROM psd) SELECT recording_id, channel, window_id, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END), 5) + 0.0 AS entropy FROM q GROUP BY ALL")
def spectral_entropy(spark, sf_dir):
    return sp.spectral_entropy(psd(spark, sf_dir), ["recording_id", "channel", "window_id"]).select("recording_id", "channel", "window_id", r6("entropy", 5).alias("entropy"))


@query(f"""WITH {_PSD}, b AS (SELECT *, CASE WHEN bin * 2 < 0.5 THEN NULL WHEN bin * 2 < 4 THEN 'delta' WHEN bin * 2 < 8 THEN 'theta' WHEN bin * 2 < 13 THEN 'alpha' WHEN bin * 2 < 30 THEN 'beta' WHEN bin * 2 < 64 THEN 'gamma' END AS band FROM psd)
SELECT recording_id, channel, window_id, band, round(sum(t), 7) + 0.0 AS power FROM (SELECT *, coalesce((psd + lag(psd) OVER (PARTITION BY recording_id, channel, window_id, band ORDER BY bin)) / 2 * 2.0, 0) AS t FROM b WHERE band IS NOT NULL) GROUP BY ALL""")
def band_power_trapz(spark, sf_dir):
    return sp.band_power(psd(spark, sf_dir), ["recording_id", "channel", "window_id"], 2.0).select("recording_id", "channel", "window_id", "band", r6("power", 7).alias("power"))


@query("""WITH x AS (SELECT sample_id, i AS pos, v FROM flat),
turn AS (SELECT p.range AS pos, CAST(b.range AS INT) AS bin, cos(2 * pi() * ((p.range * b.range) % 64) / 64) AS c, -sin(2 * pi() * ((p.range * b.range) % 64) / 64) AS s FROM range(0, 64) p, range(0, 33) b)
SELECT sample_id, bin, round(sqrt(pow(sum(v * c), 2) + pow(sum(v * s), 2)), 6) + 0.0 AS mag FROM x JOIN turn USING (pos) GROUP BY ALL""")
def rfft_magnitude(spark, sf_dir):
    """Spectra of whole vectors."""
    from sigloom.plans.registry import samples

    rows = samples(spark, sf_dir).select("sample_id", F.posexplode("x").alias("pos", "value"))
    return sp.rfft_magnitude(rows, ["sample_id"], 64).select("sample_id", "bin", r6("mag").alias("mag"))


@query("SELECT recording_id, channel, idx, round(value, 5) + 0.0 AS value FROM signal")
def istft(spark, sf_dir):
    """The signal again, after its short-time spectra and their inverse."""
    return sp.stft_inverted(signal(spark, sf_dir), 64, 32).select("recording_id", "channel", "idx", r6("value", 5).alias("value"))


@query(f"WITH {FRAMES} SELECT recording_id, channel, frame, bin, round(re * k, 6) + 0.0 AS re, round(im * k, 6) + 0.0 AS im FROM (SELECT *, CASE WHEN frame BETWEEN 4 AND 5 THEN 0.1 ELSE 1.0 END * CASE WHEN bin BETWEEN 10 AND 12 THEN 0.1 ELSE 1.0 END AS k FROM spectrum)")
def tf_mask(spark, sf_dir):
    """Two frames and three bins damped."""
    m = sp.tf_mask(sp.stft(signal(spark, sf_dir), 64, 32), (F.lit(4), F.lit(5)), (F.lit(10), F.lit(12)))
    return m.select("recording_id", "channel", "frame", "bin", r6("re").alias("re"), r6("im").alias("im"))


@query()
def bandpass_zero_phase(spark, sf_dir):
    """4 to 45 Hz, order 5, forward and backward; a recursion, so tested against one written out."""
    return fl.bandpass(signal(spark, sf_dir), 5, 4.0, 45.0, 128.0)


@query()
def bandpass_causal(spark, sf_dir):
    return fl.bandpass(signal(spark, sf_dir), 4, 8.0, 13.0, 128.0, causal=True)


def _level(k: int, n: int) -> str:
    """SQL of one level of the packet: windows of ``n`` values become (n + 7) // 2 low and as many high ones."""
    taps = ", ".join(f"({t}, {sp.DB4[t]}, {sp.DB4[7 - t] * (1 if t % 2 else -1)})" for t in range(8))
    return f"""t{k} AS (SELECT o.range AS o, (2 * o.range + 1 - t + {4 * n}) % {2 * n} AS m, lo, hi FROM range(0, {(n + 7) // 2}) o, (VALUES {taps}) w(t, lo, hi)),
f{k} AS (SELECT o, CASE WHEN m < {n} THEN m ELSE {2 * n - 1} - m END AS spot, sum(lo) AS lo, sum(hi) AS hi FROM t{k} GROUP BY ALL),
g{k} AS (SELECT recording_id, channel, window_id, node, o AS k, sum(c * lo) AS lo, sum(c * hi) AS hi FROM l{k - 1} p JOIN f{k} ON spot = p.k GROUP BY ALL),
l{k} AS (SELECT recording_id, channel, window_id, node * 2 + CASE WHEN node % 2 = 0 THEN 0 ELSE 1 END AS node, k, lo AS c FROM g{k} UNION ALL SELECT recording_id, channel, window_id, node * 2 + CASE WHEN node % 2 = 0 THEN 1 ELSE 0 END, k, hi FROM g{k})"""


WAVELET = "l0 AS (SELECT recording_id, channel, CAST(idx // 64 AS BIGINT) AS window_id, 0 AS node, idx % 64 AS k, value AS c FROM (SELECT *, count(*) OVER (PARTITION BY recording_id, channel, idx // 64) AS n FROM signal) WHERE n = 64),\n" + ",\n".join(_level(k, n) for k, n in ((1, 64), (2, 35), (3, 21), (4, 14))) + ",\nwp AS (SELECT recording_id, channel, window_id, node, avg(c) AS mean, stddev_pop(c) AS std, sum(c * c) AS energy FROM l4 GROUP BY ALL)"
_BY = ["recording_id", "channel", "window_id"]


def tumbling(spark, sf_dir):
    w = wn.tumbling_windows(signal(spark, sf_dir, "n"), 64, "n")
    return w.withColumn("window_id", F.col("window_id").cast("long"))


def packet(spark, sf_dir):
    return sp.window_packets(tumbling(spark, sf_dir), _BY, 64)


@query(f"WITH {WAVELET} SELECT recording_id, channel, window_id, node, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, round(energy, 5) + 0.0 AS energy FROM wp")
def wavelet_packet(spark, sf_dir):
    """Mean, deviation and energy of the 16 nodes of each tumbling window."""
    return packet(spark, sf_dir).select(*_BY, "node", r6("mean").alias("mean"), r6("std").alias("std"), r6("energy", 5).alias("energy"))


_VECTOR = f"""{_PSD}, {WAVELET},
st AS (SELECT recording_id, channel, window_id, pos, value, avg(value) OVER p AS mu, value - lag(value) OVER o AS d1 FROM w WHERE n = 64 WINDOW p AS (PARTITION BY recording_id, channel, window_id), o AS (PARTITION BY recording_id, channel, window_id ORDER BY pos)),
st2 AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY recording_id, channel, window_id ORDER BY pos) AS d2 FROM st),
base AS (SELECT recording_id, channel, window_id, avg(value) AS mean, var_pop(value) AS var, stddev_pop(value) AS std, avg(pow(value - mu, 3)) / pow(stddev_pop(value), 3) AS skew, avg(pow(value - mu, 4)) / pow(var_pop(value), 2) - 3 AS kurt, sqrt(var_pop(d1) / var_pop(value)) AS mobility, sqrt(var_pop(d2) / var_pop(d1)) / sqrt(var_pop(d1) / var_pop(value)) AS complexity, sqrt(avg(value * value)) AS rms FROM st2 GROUP BY ALL),
share AS (SELECT *, psd / sum(psd) OVER (PARTITION BY recording_id, channel, window_id) AS p FROM psd),
ent AS (SELECT recording_id, channel, window_id, -sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) AS entropy FROM share GROUP BY ALL),
bp AS (SELECT *, CASE WHEN bin * 2 < 0.5 THEN NULL WHEN bin * 2 < 4 THEN 10 WHEN bin * 2 < 8 THEN 11 WHEN bin * 2 < 13 THEN 12 WHEN bin * 2 < 30 THEN 13 WHEN bin * 2 < 64 THEN 14 END AS band FROM psd),
pw AS (SELECT recording_id, channel, window_id, band, sum(t) AS power FROM (SELECT *, coalesce((psd + lag(psd) OVER (PARTITION BY recording_id, channel, window_id, band ORDER BY bin)) / 2 * 2.0, 0) AS t FROM bp WHERE band IS NOT NULL) GROUP BY ALL)"""


@query(f"""WITH {_VECTOR}, long AS (
SELECT recording_id, channel, window_id, unnest([0, 1, 2, 3, 4, 5, 6, 7, 9]) AS pos, unnest([mean, var, std, skew, kurt, var, mobility, complexity, rms]) AS value FROM base
UNION ALL SELECT recording_id, channel, window_id, 8, entropy FROM ent UNION ALL SELECT recording_id, channel, window_id, band, power FROM pw
UNION ALL SELECT recording_id, channel, window_id, 15 + node * 3 + unnest([0, 1, 2]), unnest([mean, std, energy]) FROM wp)
SELECT recording_id, channel, window_id, CAST(pos AS BIGINT) AS pos, round(value, 5) + 0.0 AS value FROM long""")
def feature_vector(spark, sf_dir):
    """The 63 features of each window and channel as a vector, listed by place: five statistics, three of Hjorth, spectral
    entropy, root mean square, five band powers, and three of each of 16 wavelet nodes."""
    held = vc.channel_windows(wide_signal(spark, sf_dir, "n"), ["recording_id"], list(CHANNELS), 64, "n")
    v = vc.feature_vectors(held, ["recording_id", "window_id"], list(CHANNELS), 64, 128.0)
    return v.select(*_BY, F.posexplode("x").alias("pos", "value")).select(*_BY, F.col("pos").cast("long").alias("pos"), r6("value", 5).alias("value"))
