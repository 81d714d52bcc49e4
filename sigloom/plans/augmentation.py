"""Augmented signals and samples, with their draws repeated in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.functions.draws import normal_sql, uniform_sql
from sigloom.operators import augment as ag
from sigloom.operators import splits as sl
from sigloom.operators import vectors as vc
from sigloom.plans.registry import CHANNELS, query, r6, read, recordings, samples, signal, wide_signal
from sigloom.plans.spectra import FRAMES
from sigloom.scratch import table

_LONG = "long AS (SELECT recording_id AS sample_id, channel, idx, value, max(idx) OVER (PARTITION BY recording_id) + 1 AS n FROM signal)"
_KEY3 = "concat_ws(':', sample_id, channel, idx)"


def long(spark, sf_dir):
    return signal(spark, sf_dir).withColumnRenamed("recording_id", "sample_id")


def shown(df, places=6):
    return df.select("sample_id", "channel", F.col("idx").cast("int").alias("idx"), r6("value", places).alias("value"))


def _span(op, key, low, high):
    return f"({low} + {high - low} * {uniform_sql(1, op, key)})"


@query(f"WITH {_LONG} SELECT sample_id, channel, idx, round(value + {normal_sql(1, 'noise', _KEY3)} * stddev_pop(value) OVER (PARTITION BY sample_id) * {_span('level', 'sample_id', 0.001, 0.05)}, 6) + 0.0 AS value FROM long")
def gaussian_noise(spark, sf_dir):
    return shown(ag.gaussian_noise(long(spark, sf_dir)))


_SHIFT = f"CAST(trunc(n * {_span('shift', 'sample_id', 0.05, 0.2)} * CASE WHEN {uniform_sql(1, 'sign', 'sample_id')} < 0.5 THEN -1 ELSE 1 END) AS INT)"


@query(f"WITH {_LONG} SELECT sample_id, channel, CAST((idx + {_SHIFT} + n) % n AS INT) AS idx, round(value, 6) + 0.0 AS value FROM long")
def time_shift(spark, sf_dir):
    return shown(ag.time_shift(long(spark, sf_dir)))


@query(f"WITH {_LONG}, s AS (SELECT *, floor(n * {_span('keep', 'sample_id', 0.8, 0.95)}) AS size FROM long), t AS (SELECT *, floor({uniform_sql(1, 'start', 'sample_id')} * (n - size + 1)) AS start FROM s) SELECT sample_id, channel, CAST(idx - start AS INT) AS idx, round(value, 6) + 0.0 AS value FROM t WHERE idx >= start AND idx < start + size")
def window_slice(spark, sf_dir):
    return shown(ag.window_slice(long(spark, sf_dir)))


@query(f"""WITH {_LONG}, s AS (SELECT *, floor(n * {_span('keep', 'sample_id', 0.8, 0.95)}) AS size FROM long), t AS (SELECT *, floor({uniform_sql(1, 'start', 'sample_id')} * (n - size + 1)) AS start FROM s),
c AS (SELECT sample_id, channel, CAST(idx - start AS INT) AS at, value, size, n FROM t WHERE idx >= start AND idx < start + size),
j AS (SELECT DISTINCT sample_id, channel, CAST(k AS INT) AS idx, k * (size - 1) / (n - 1) AS x, size FROM c JOIN range(0, 20000) r(k) ON k < n),
p AS (SELECT *, CAST(least(floor(x + 1e-9), size - 2) AS INT) AS lo FROM j)
SELECT p.sample_id, p.channel, p.idx, round(a.value + (p.x - p.lo) * (b.value - a.value), 6) + 0.0 AS value FROM p JOIN c a ON a.sample_id = p.sample_id AND a.channel = p.channel AND a.at = p.lo JOIN c b ON b.sample_id = p.sample_id AND b.channel = p.channel AND b.at = p.lo + 1""")
def window_slice_resampled(spark, sf_dir):
    """The slice stretched to the old length."""
    return shown(ag.window_slice(long(spark, sf_dir), resample=True))


@query(f"WITH {_LONG} SELECT sample_id, channel, idx, round(value * {_span('scale', chr(39).join(['concat_ws(', ':', ', sample_id, channel)']), 0.9, 1.1)}, 6) + 0.0 AS value FROM long")
def amplitude_scale(spark, sf_dir):
    return shown(ag.amplitude_scale(long(spark, sf_dir), per_channel=True))


_DROP = f"c AS (SELECT DISTINCT sample_id, channel FROM long), g AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {uniform_sql(1, 'drop', chr(39).join(['concat_ws(', ':', ', sample_id, channel)']))}, channel) <= greatest(1, floor(count(*) OVER (PARTITION BY sample_id) * {_span('rate', 'sample_id', 0.05, 0.2)})) AS gone FROM c)"


@query(f"WITH {_LONG}, {_DROP}, m AS (SELECT *, avg(value) OVER (PARTITION BY sample_id, idx) AS put FROM long) SELECT sample_id, channel, idx, round(CASE WHEN gone THEN put ELSE value END, 6) + 0.0 AS value FROM m JOIN g USING (sample_id, channel)")
def channel_dropout(spark, sf_dir):
    """Dropped channels replaced by the mean over channels."""
    return shown(ag.channel_dropout(long(spark, sf_dir), fill="mean"))


@query(f"WITH {_LONG}, {_DROP}, m AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM long WINDOW w AS (PARTITION BY sample_id, idx ORDER BY channel)) SELECT sample_id, channel, idx, round(CASE WHEN gone THEN coalesce((a + b) / 2, a, b, 0) ELSE value END, 6) + 0.0 AS value FROM m JOIN g USING (sample_id, channel)")
def channel_dropout_neighbour(spark, sf_dir):
    return shown(ag.channel_dropout(long(spark, sf_dir), fill="neighbour"))


@query(f"WITH {_LONG}, z AS (SELECT *, {normal_sql(1, 'direction', _KEY3)} AS z FROM long) SELECT sample_id, channel, idx, round(value + z / sqrt(sum(z * z) OVER w) * 0.01 * stddev_pop(value) OVER w, 6) + 0.0 AS value FROM z WINDOW w AS (PARTITION BY sample_id)")
def bounded_perturbation(spark, sf_dir):
    return shown(ag.bounded_perturbation(long(spark, sf_dir)))


_SEGKEY = "concat_ws(':', sample_id, seg)"


@query(f"WITH {_LONG}, s AS (SELECT *, CAST(least(idx // (n // 4), 3) AS BIGINT) AS seg FROM long), p AS (SELECT sample_id, seg, min(idx) AS first, max(idx) - min(idx) + 1 AS size FROM s GROUP BY ALL), o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY sample_id ORDER BY {uniform_sql(1, 'segment', _SEGKEY)}, seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p) SELECT s.sample_id, channel, CAST(start + idx - first AS INT) AS idx, round(value, 6) + 0.0 AS value FROM s JOIN o ON s.sample_id = o.sample_id AND s.seg = o.seg")
def segment_permutation(spark, sf_dir):
    return shown(ag.segment_permutation(long(spark, sf_dir)))


_PAIRS = f"""r AS MATERIALIZED (SELECT sample_id, row_number() OVER (ORDER BY {uniform_sql(42, 'order', 'sample_id')}, sample_id) - 1 AS rank, count(*) OVER () AS n FROM sample),
dd AS (SELECT range AS draw, CAST(floor({uniform_sql(42, 'first', 'range')} * (SELECT count(*) FROM sample)) AS BIGINT) AS ra, CAST(floor({uniform_sql(42, 'second', 'range')} * (SELECT count(*) FROM sample)) AS BIGINT) AS rb FROM range(0, 1000000) WHERE range < floor((SELECT count(*) FROM sample) * 0.3 * 2.0 / 2.4 + 1e-9)),
pairs AS MATERIALIZED (SELECT draw, a.sample_id AS first, b.sample_id AS second FROM dd JOIN r a ON a.rank = ra JOIN r b ON b.rank = rb)"""
_ZIP = "SELECT p.*, x.i AS idx, x.v AS a, y.v AS b, x.label AS l1, y.label AS l2 FROM pairs p JOIN flat x ON x.sample_id = p.first JOIN flat y ON y.sample_id = p.second AND y.i = x.i"


def sample_rows(spark, sf_dir):
    return samples(spark, sf_dir).select("sample_id", F.lit("x").alias("channel"), F.posexplode("x").alias("idx", "value"))


def sample_pairs(spark, sf_dir):
    """As many pairs of samples as the quota of mixing."""
    s = samples(spark, sf_dir)
    return sl.random_pairs(s, "sample_id", ag.quotas(s.count())["mixup"])


def mixed(df, spark, sf_dir):
    told = ag.soft_label(df, samples(spark, sf_dir).select("sample_id", "label"))
    return told.select("draw", "first", "second", F.col("idx").cast("int").alias("idx"), r6("value").alias("value"), r6("weight").alias("weight"), "hard1", "hard2", r6("blend").alias("blend"))


@query(f"""WITH {_PAIRS}, c AS (SELECT draw, t.range AS i, pow({uniform_sql(1, 'mixup:a', 'draw', 't.range')}, 5.0) AS a, pow({uniform_sql(1, 'mixup:b', 'draw', 't.range')}, 5.0) AS b FROM pairs, range(0, 32) t),
l AS MATERIALIZED (SELECT draw, arg_min(a / (a + b), i) AS weight FROM c WHERE a + b <= 1 AND a + b > 0 GROUP BY draw)
SELECT draw, first, second, CAST(idx AS INT) AS idx, round(w * a + (1 - w) * b, 6) + 0.0 AS value, round(w, 6) + 0.0 AS weight, l1 AS hard1, l2 AS hard2, round(w * l1 + (1 - w) * l2, 6) + 0.0 AS blend FROM (SELECT z.*, coalesce(weight, 0.5) AS w FROM ({_ZIP}) z LEFT JOIN l USING (draw))""")
def mixup(spark, sf_dir):
    """Blends of drawn pairs, and of their labels."""
    return mixed(ag.mixup(sample_rows(spark, sf_dir), sample_pairs(spark, sf_dir)), spark, sf_dir)


@query(f"""WITH {_PAIRS}, k AS (SELECT draw, floor(64 * (1 - {uniform_sql(1, 'cut', 'draw')})) AS cut FROM pairs), s AS MATERIALIZED (SELECT draw, cut, floor({uniform_sql(1, 'at', 'draw')} * (64 - cut + 1)) AS start FROM k)
SELECT draw, first, second, CAST(idx AS INT) AS idx, round(CASE WHEN idx >= start AND idx < start + cut THEN b ELSE a END, 6) + 0.0 AS value, round(1 - cut / 64, 6) + 0.0 AS weight, l1 AS hard1, l2 AS hard2, round((1 - cut / 64) * l1 + cut / 64 * l2, 6) + 0.0 AS blend FROM ({_ZIP}) JOIN s USING (draw)""")
def cutmix(spark, sf_dir):
    """Runs of the second pasted into the first, and blends of their labels."""
    return mixed(ag.cutmix(sample_rows(spark, sf_dir), sample_pairs(spark, sf_dir), 64), spark, sf_dir)


_KNN = "knn AS MATERIALIZED (SELECT sample_id, neighbour, row_number() OVER (PARTITION BY sample_id ORDER BY d, neighbour) AS rank FROM (SELECT a.sample_id, b.sample_id AS neighbour, list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM sample a JOIN sample b ON a.label = b.label AND a.sample_id <> b.sample_id) QUALIFY rank <= 5)"


@query(f"WITH {_KNN} SELECT sample_id, neighbour, rank FROM knn WHERE rank <= 5")
def knn_same_class(spark, sf_dir):
    return ag.knn_same_class(samples(spark, sf_dir)).select("sample_id", "neighbour", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_KNN}, n AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n FROM knn WHERE rank <= 5), c AS (SELECT sample_id, neighbour FROM n WHERE rank = floor({uniform_sql(1, 'pick', 'sample_id')} * n) + 1)
SELECT a.sample_id, b.sample_id AS neighbour, a.i AS i, round(a.v + coalesce({uniform_sql(1, 'step', 'a.sample_id')} * (b.v - a.v), 0), 6) + 0.0 AS value FROM flat a LEFT JOIN c ON c.sample_id = a.sample_id LEFT JOIN flat b ON b.sample_id = c.neighbour AND b.i = a.i""")
def smote(spark, sf_dir):
    s = ag.smote(samples(spark, sf_dir)).select("sample_id", "neighbour", F.posexplode("x").alias("i", "value"))
    return s.select("sample_id", "neighbour", F.col("i").cast("long").alias("i"), r6("value").alias("value"))


@query("SELECT technique, CAST(floor(n * share * 2.0 / 2.4 + 1e-9) AS BIGINT) AS quota FROM (SELECT count(*) AS n FROM sample) CROSS JOIN (VALUES ('gaussian_noise', 0.5), ('time_shift', 0.3), ('window_slice', 0.3), ('amplitude_scale', 0.2), ('channel_dropout', 0.2), ('band_jitter_filter', 0.16), ('tf_mask', 0.24), ('mixup', 0.3), ('cutmix', 0.0), ('smote', 0.2)) t(technique, share)")
def augmentation_quota(spark, sf_dir):
    counts = ag.quotas(samples(spark, sf_dir).count())
    return spark.createDataFrame(list(counts.items()), "technique string, quota long")


#: The shares of the techniques, with one for cutmix too, so that all ten are made.
SHARES = ag.SHARES | {"cutmix": 0.1}
_VALUES = ", ".join(f"('{t}', {x})" for t, x in SHARES.items())
_FIXED = "fixed AS MATERIALIZED (SELECT recording_id * 1000000000 + idx // 64 AS sample_id, channel, CAST(idx % 64 AS INT) AS idx, value FROM (SELECT *, count(*) OVER (PARTITION BY recording_id, channel, idx // 64) AS c FROM signal) WHERE c = 64), told AS MATERIALIZED (SELECT DISTINCT f.sample_id, CAST(rating >= 5 AS INT) AS label FROM fixed f JOIN recording r ON r.recording_id = f.sample_id // 1000000000)"
_SRC = "concat_ws(':', technique, draw_no)"
_DRAWS = f"""{_FIXED}, q AS (SELECT technique, CAST(floor((SELECT count(*) FROM told) * share * 2.0 / 2.5 + 1e-9) AS BIGINT) AS quota FROM (VALUES {_VALUES}) t(technique, share)),
k AS MATERIALIZED (SELECT sample_id, row_number() OVER (ORDER BY {uniform_sql(1, 'source', 'sample_id')}, sample_id) - 1 AS rank, count(*) OVER () AS n FROM told),
d AS (SELECT technique, range AS draw_no FROM q JOIN range(1, 1000000) ON range <= quota),
dr AS MATERIALIZED (SELECT technique, draw_no, {_SRC} AS draw, CAST(floor({uniform_sql(1, 'draw', _SRC)} * (SELECT count(*) FROM told)) AS BIGINT) AS r1, CASE WHEN technique IN ('mixup', 'cutmix') THEN CAST(floor({uniform_sql(1, 'draw2', _SRC)} * (SELECT count(*) FROM told)) AS BIGINT) END AS r2 FROM d),
draws AS MATERIALIZED (SELECT technique, draw_no, draw, a.sample_id AS source_id, b.sample_id AS source2_id FROM dr JOIN k a ON a.rank = r1 LEFT JOIN k b ON b.rank = r2)"""
_MADE = f"""{_DRAWS}, v AS MATERIALIZED (SELECT sample_id, label, list(value ORDER BY channel, idx) AS x FROM fixed JOIN told USING (sample_id) GROUP BY ALL),
near AS MATERIALIZED (SELECT a.sample_id, b.sample_id AS neighbour, row_number() OVER (PARTITION BY a.sample_id ORDER BY list_distance(a.x, b.x), b.sample_id) AS rank FROM v a JOIN v b ON a.label = b.label AND a.sample_id <> b.sample_id WHERE a.sample_id IN (SELECT source_id FROM draws WHERE technique = 'smote') QUALIFY rank <= 5),
nn AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS c FROM near),
bw AS (SELECT draw, t.range AS i, pow({uniform_sql(1, 'mixup:a', 'draw', 't.range')}, 5.0) AS a, pow({uniform_sql(1, 'mixup:b', 'draw', 't.range')}, 5.0) AS b FROM draws, range(0, 32) t WHERE technique = 'mixup'),
mw AS (SELECT draw, arg_min(a / (a + b), i) AS weight FROM bw WHERE a + b <= 1 AND a + b > 0 GROUP BY draw),
lin AS MATERIALIZED (SELECT technique, draw_no, draw, source_id, source2_id, coalesce(weight, 0.5) AS weight FROM draws LEFT JOIN mw USING (draw) WHERE technique = 'mixup'
  UNION ALL SELECT technique, draw_no, draw, source_id, source2_id, 1 - floor(64 * (1 - {uniform_sql(1, 'cut', 'draw')})) / 64 FROM draws WHERE technique = 'cutmix'
  UNION ALL SELECT technique, draw_no, draw, source_id, neighbour, CASE WHEN neighbour IS NULL THEN 1.0 ELSE 1 - {uniform_sql(1, 'step', 'draw')} END FROM draws LEFT JOIN nn ON nn.sample_id = source_id AND nn.rank = floor({uniform_sql(1, 'pick', 'draw')} * c) + 1 WHERE technique = 'smote'
  UNION ALL SELECT technique, draw_no, draw, source_id, NULL, 1.0 FROM draws WHERE technique NOT IN ('mixup', 'cutmix', 'smote'))"""
#: A recursion whose values SQL does not have; a test has them.
_OWN = "band_jitter_filter"
_SLICED = f"""wsz AS (SELECT *, floor(64 * {_span('keep', 'sample_id', 0.8, 0.95)}) AS size FROM base WHERE technique = 'window_slice'),
wst AS (SELECT *, floor({uniform_sql(1, 'start', 'sample_id')} * (64 - size + 1)) AS start FROM wsz),
wsc AS MATERIALIZED (SELECT technique, draw_no, channel, CAST(idx - start AS INT) AS at, value, size FROM wst WHERE idx >= start AND idx < start + size),
wsx AS (SELECT technique, draw_no, channel, k.range * (size - 1) / 63 AS x, CAST(least(floor(k.range * (size - 1) / 63 + 1e-9), size - 2) AS INT) AS lo FROM (SELECT DISTINCT technique, draw_no, channel, size FROM wsc), range(0, 64) k),
wsv AS (SELECT x.technique, x.draw_no, a.value + (x - lo) * (b.value - a.value) AS v FROM wsx x JOIN wsc a ON a.draw_no = x.draw_no AND a.channel = x.channel AND a.at = x.lo JOIN wsc b ON b.draw_no = x.draw_no AND b.channel = x.channel AND b.at = x.lo + 1)"""
_TFKEY = "concat_ws(':', sample_id, channel)"
_MASKED = f"""tfw AS (SELECT p.range AS pos, 0.5 - 0.5 * cos(2 * pi() * p.range / 64) AS w FROM range(0, 64) p),
tfb AS (SELECT pos, w, CAST(b.range AS INT) AS bin, cos(2 * pi() * ((pos * b.range) % 64) / 64) AS c, sin(2 * pi() * ((pos * b.range) % 64) / 64) AS s, CASE WHEN b.range IN (0, 32) THEN 1.0 ELSE 2.0 END AS d FROM tfw, range(0, 33) b),
tfr AS (SELECT *, CASE WHEN {uniform_sql(1, 'frames:hit', _TFKEY)} < 0.1 THEN floor({uniform_sql(1, 'frames', _TFKEY)} * 2) END AS f0, CASE WHEN {uniform_sql(1, 'bins:hit', _TFKEY)} < 0.1 THEN floor({uniform_sql(1, 'bins', _TFKEY)} * 30) END AS b0 FROM (SELECT DISTINCT technique, draw_no, sample_id, channel FROM base WHERE technique = 'tf_mask')),
tff AS (SELECT draw_no, channel, f.range AS frame, idx + 32 - f.range * 32 AS pos, value FROM base JOIN range(0, 3) f ON idx + 32 >= f.range * 32 AND idx + 32 < f.range * 32 + 64 WHERE technique = 'tf_mask'),
tfs AS (SELECT draw_no, channel, frame, bin, sum(value * w * c) / 32 AS re, -sum(value * w * s) / 32 AS im FROM tff JOIN tfb USING (pos) GROUP BY ALL),
tfm AS (SELECT t.draw_no, t.channel, frame, bin, re * k AS re, im * k AS im FROM (SELECT s.*, CASE WHEN frame = f0 THEN 0.1 ELSE 1.0 END * CASE WHEN bin >= b0 AND bin < b0 + 3 THEN 0.1 ELSE 1.0 END AS k FROM tfs s JOIN tfr r ON r.draw_no = s.draw_no AND r.channel = s.channel) t),
tfx AS (SELECT draw_no, channel, frame, pos, w, sum(d * (re * c - im * s)) / 64 AS x FROM tfm JOIN tfb USING (bin) GROUP BY ALL),
tfv AS (SELECT 'tf_mask' AS technique, draw_no, frame * 32 + pos - 32 AS idx, sum(x * w) * 32 / nullif(sum(w * w), 0) AS v FROM tfx GROUP BY draw_no, channel, frame * 32 + pos)"""


def fixed_arrays(spark, sf_dir):
    """(sample_id, channel, idx, value): the tumbling windows of 64 of all recordings as samples of one length, each one row of
    three arrays, in order."""
    held = vc.channel_windows(wide_signal(spark, sf_dir, "n"), ["recording_id"], list(CHANNELS), 64, "n")
    each = held.select((F.col("recording_id") * 1_000_000_000 + F.col("window_id")).alias("sample_id"), F.array_sort("entries").alias("_e"))
    names = sorted(CHANNELS)
    channel = F.flatten(F.array(*[F.array_repeat(F.lit(c), F.size("_e")) for c in names]))
    idx = F.flatten(F.array_repeat(F.col("_e")["pos"].cast("array<int>"), len(names)))
    return each.select("sample_id", channel.alias("channel"), idx.alias("idx"), F.concat(*[F.col("_e")[c] for c in names]).alias("value"))


def fixed_labels(spark, sf_dir):
    """(sample_id, label): whether the recording's rating is high. A recording's length tells its windows, so no sample is made."""
    rated = recordings(spark, sf_dir).select("recording_id", (F.col("rating") >= 5).cast("int").alias("label"))
    full = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("recording_id")).agg(F.floor(F.count(F.lit(1)) / 64).alias("_w")).where("_w > 0")
    window = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_w") - 1))
    return full.join(rated, "recording_id").select("recording_id", "label", window.alias("_w")).select((F.col("recording_id") * 1_000_000_000 + F.col("_w")).alias("sample_id"), "label")


def fixed_draws(spark, sf_dir):
    labels = fixed_labels(spark, sf_dir)
    return ag.source_draws(labels, "sample_id", ag.quotas(labels.count(), SHARES))


@query(f"""WITH {_MADE}, base AS MATERIALIZED (SELECT technique, draw_no, draw AS sample_id, channel, idx, value FROM draws JOIN fixed f ON f.sample_id = source_id WHERE technique NOT IN ('mixup', 'cutmix', 'smote')),
gone AS (SELECT sample_id, channel, row_number() OVER (PARTITION BY sample_id ORDER BY {uniform_sql(1, 'drop', "concat_ws(':', sample_id, channel)")}, channel) <= greatest(1, floor(4 * {_span('rate', 'sample_id', 0.05, 0.2)})) AS gone FROM (SELECT DISTINCT sample_id, channel FROM base WHERE technique = 'channel_dropout')),
cut AS (SELECT draw, floor(64 * (1 - {uniform_sql(1, 'cut', 'draw')})) AS cut, floor({uniform_sql(1, 'at', 'draw')} * (64 - floor(64 * (1 - {uniform_sql(1, 'cut', 'draw')})) + 1)) AS start FROM draws WHERE technique = 'cutmix'),
two AS (SELECT technique, draw_no, CASE WHEN technique = 'cutmix' THEN CASE WHEN a.idx >= start AND a.idx < start + cut THEN b.value ELSE a.value END ELSE weight * a.value + (1 - weight) * b.value END AS v
  FROM lin LEFT JOIN cut USING (draw) JOIN fixed a ON a.sample_id = source_id JOIN fixed b ON b.sample_id = coalesce(source2_id, source_id) AND b.channel = a.channel AND b.idx = a.idx WHERE technique IN ('mixup', 'cutmix', 'smote')),
{_SLICED},
{_MASKED},
vals AS (SELECT technique, draw_no, value + {normal_sql(1, 'noise', _KEY3)} * stddev_pop(value) OVER (PARTITION BY sample_id) * {_span('level', 'sample_id', 0.001, 0.05)} AS v FROM base WHERE technique = 'gaussian_noise'
  UNION ALL SELECT technique, draw_no, value * {_span('scale', 'sample_id', 0.9, 1.1)} FROM base WHERE technique = 'amplitude_scale'
  UNION ALL SELECT technique, draw_no, CASE WHEN gone THEN 0 ELSE value END FROM base JOIN gone USING (sample_id, channel) WHERE technique = 'channel_dropout'
  UNION ALL SELECT technique, draw_no, value FROM base WHERE technique = 'time_shift'
  UNION ALL SELECT technique, draw_no, NULL FROM base WHERE technique = '{_OWN}'
  UNION ALL SELECT technique, draw_no, v FROM wsv UNION ALL SELECT technique, draw_no, v FROM tfv WHERE idx BETWEEN 0 AND 63
  UNION ALL SELECT * FROM two),
sums AS (SELECT technique, draw_no, count(*) AS n, round(sum(v), 4) + 0.0 AS total FROM vals GROUP BY ALL)
SELECT technique, draw_no, source_id, source2_id, round(weight, 6) + 0.0 AS weight, x.label AS hard1, coalesce(y.label, x.label) AS hard2, round(weight * x.label + (1 - weight) * coalesce(y.label, x.label), 6) + 0.0 AS blend, n, total
FROM lin JOIN sums USING (technique, draw_no) JOIN told x ON x.sample_id = source_id LEFT JOIN told y ON y.sample_id = source2_id
UNION ALL SELECT 'original', 0, sample_id, NULL, 1.0, label, label, CAST(label AS DOUBLE), count(*), round(sum(value), 4) + 0.0 FROM fixed JOIN told USING (sample_id) GROUP BY sample_id, label""")
def augment_dataset(spark, sf_dir):
    """All ten techniques on samples of one length, each quota in full, with sources and labels, and the originals."""
    rows, labels = fixed_arrays(spark, sf_dir), table(fixed_labels(spark, sf_dir))
    values, made = ag.augment_dataset(rows, labels, ag.quotas(labels.count(), SHARES), 64)
    sums = values.groupBy("technique", "draw_no", "source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    told = made.select("technique", "draw_no", "source2_id", "weight", "hard1", "hard2", "blend")
    both = sums.join(told, ["technique", "draw_no"], "left").join(labels.withColumnRenamed("sample_id", "source_id"), "source_id")
    kept = F.when(F.col("technique") != _OWN, r6("total", 4))
    return both.select("technique", "draw_no", "source_id", "source2_id", r6(F.coalesce("weight", F.lit(1.0))).alias("weight"), F.coalesce("hard1", "label").alias("hard1"), F.coalesce("hard2", "label").alias("hard2"), r6(F.coalesce("blend", F.col("label").cast("double"))).alias("blend"), "n", kept.alias("total"))


@query(f"WITH {_DRAWS} SELECT technique, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share FROM draws GROUP BY technique")
def technique_counts(spark, sf_dir):
    c = fixed_draws(spark, sf_dir).groupBy("technique").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(F.broadcast(total)).select("technique", "n", r6(F.col("n") / F.col("total")).alias("share"))


@query(f"""WITH {_DRAWS}, grp AS MATERIALIZED (SELECT sample_id, subject_id, row_number() OVER (ORDER BY {uniform_sql(1, 'group', 'sample_id')}, sample_id) - 1 AS rank FROM told JOIN recording ON recording_id = sample_id // 1000000000),
g AS (SELECT *, CAST(floor({uniform_sql(1, 'group_of', 'draw')} * (SELECT count(*) FROM told)) AS BIGINT) AS spot FROM draws)
SELECT technique, draw_no, source_id, a.subject_id AS subject_id, b.subject_id AS drawn_subject FROM g JOIN grp a ON a.sample_id = source_id JOIN grp b ON b.rank = spot""")
def assign_groups(spark, sf_dir):
    """Augmented rows take their source's subject, or one drawn at random."""
    subjects = recordings(spark, sf_dir).select("recording_id", "subject_id")
    groups = fixed_labels(spark, sf_dir).withColumn("recording_id", F.expr("sample_id DIV 1000000000")).join(subjects, "recording_id").select("sample_id", "subject_id")
    made = fixed_draws(spark, sf_dir).drop("source2_id")
    drawn = ag.assign_groups(made, groups, random=True).withColumnRenamed("subject_id", "drawn_subject")
    return ag.assign_groups(drawn, groups).select("technique", "draw_no", "source_id", "subject_id", "drawn_subject")


@query(f"""WITH {_DRAWS} SELECT technique, source_id IS NOT NULL AS augmented, count(*) AS n FROM (SELECT technique, source_id FROM draws UNION ALL SELECT 'original', NULL FROM told) GROUP BY ALL""")
def union_augmented(spark, sf_dir):
    """Originals and augmented rows by technique."""
    both = fixed_draws(spark, sf_dir).select("technique", "source_id").unionByName(fixed_labels(spark, sf_dir).select(F.lit("original").alias("technique")), allowMissingColumns=True)
    return both.groupBy("technique", F.col("source_id").isNotNull().alias("augmented")).agg(F.count(F.lit(1)).alias("n"))


@query()
def band_jitter_filter(spark, sf_dir):
    """A broad band whose edges a draw moves for each recording, one pass of an order-4 filter; a recursion, so tested
    against one written out."""
    return ag.band_jitter_filter(long(spark, sf_dir))


_RUN = lambda op, n: f"CASE WHEN {uniform_sql(1, op + ':hit', '_key')} < 0.1 THEN floor({uniform_sql(1, op, '_key')} * greatest(1, {n} - greatest(1, floor({n} * 0.1)))) END"


@query(f"""WITH {FRAMES}, ser AS (SELECT recording_id, channel, concat_ws(':', recording_id, channel) AS _key, ceil(count(*) / 32.0) + 1 AS frames FROM signal GROUP BY ALL),
runs AS MATERIALIZED (SELECT recording_id, channel, greatest(1, floor(frames * 0.1)) AS wf, {_RUN('frames', 'frames')} AS f0, {_RUN('bins', '33')} AS b0 FROM ser),
masked AS (SELECT s.recording_id, s.channel, s.frame, s.bin, re * k AS re, im * k AS im FROM (SELECT s.*, CASE WHEN frame >= f0 AND frame < f0 + wf THEN 0.1 ELSE 1.0 END * CASE WHEN bin >= b0 AND bin < b0 + 3 THEN 0.1 ELSE 1.0 END AS k FROM spectrum s JOIN runs r ON r.recording_id = s.recording_id AND r.channel = s.channel) s),
turn AS (SELECT p.range AS pos, CAST(b.range AS INT) AS bin, CASE WHEN b.range IN (0, 32) THEN 1.0 ELSE 2.0 END * cos(2 * pi() * ((p.range * b.range) % 64) / 64) / 64 AS c, -CASE WHEN b.range IN (0, 32) THEN 1.0 ELSE 2.0 END * sin(2 * pi() * ((p.range * b.range) % 64) / 64) / 64 AS s FROM range(0, 64) p, range(0, 33) b),
back AS (SELECT recording_id, channel, frame, pos, sum(re * c + im * s) AS x, 0.5 - 0.5 * cos(2 * pi() * pos / 64) AS w FROM masked JOIN turn USING (bin) GROUP BY ALL),
added AS (SELECT recording_id, channel, CAST(frame * 32 + pos - 32 AS INT) AS idx, sum(x * w) * 32 / nullif(sum(w * w), 0) AS value FROM back GROUP BY ALL)
SELECT s.recording_id AS sample_id, s.channel, s.idx, round(a.value, 5) + 0.0 AS value FROM signal s JOIN added a ON a.recording_id = s.recording_id AND a.channel = s.channel AND a.idx = s.idx""")
def tf_mask_augment(spark, sf_dir):
    """Short-time spectra with drawn runs of frames and bins damped, and back."""
    return shown(ag.tf_mask(long(spark, sf_dir)), 5)
