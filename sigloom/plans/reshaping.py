"""Shapes of the signals."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.operators import reshaping as rs
from sigloom.operators import statistics as st
from sigloom.operators import windows as wn
from sigloom.plans.registry import query, r6, samples, signal

_N = "n AS (SELECT recording_id, channel, CAST(max(idx) + 1 AS INT) AS n FROM signal GROUP BY ALL)"


def _out(df, places=6):
    return df.select("recording_id", "channel", F.col("idx").cast("int").alias("idx"), r6("value", places).alias("value"))


@query("SELECT r.recording_id, c.channel, r.idx, round(coalesce(value, 0), 6) + 0.0 AS value FROM (SELECT DISTINCT recording_id, idx FROM signal) r CROSS JOIN (VALUES ('discount'), ('extra'), ('price'), ('quantity'), ('tax')) c(channel) LEFT JOIN (SELECT * FROM signal WHERE NOT (recording_id % 2 = 0 AND channel = 'tax')) s ON s.recording_id = r.recording_id AND s.idx = r.idx AND s.channel = c.channel")
def pad_channels(spark, sf_dir):
    s = signal(spark, sf_dir).where("NOT (recording_id % 2 = 0 AND channel = 'tax')")
    return _out(rs.pad_channels(s, ["discount", "extra", "price", "quantity", "tax"]))


@query(f"WITH {_N} SELECT l.recording_id, l.channel, CAST(t.range AS INT) AS idx, round(coalesce(value, 0), 6) + 0.0 AS value FROM n l CROSS JOIN range(0, 600) t LEFT JOIN signal s ON s.recording_id = l.recording_id AND s.channel = l.channel AND s.idx = t.range + CASE WHEN l.n > 600 THEN (l.n - 600) // 2 ELSE 0 END")
def fit_length(spark, sf_dir):
    return _out(rs.fit_length(signal(spark, sf_dir), 600))


@query(f"WITH {_N}, t AS (SELECT recording_id, channel, n, CAST(range AS INT) AS idx, range * ((n - 1) / 255.0) AS p FROM n, range(0, 256)) SELECT t.recording_id, t.channel, t.idx, round(a.value * (1 - (p - floor(p))) + coalesce(b.value, 0) * (p - floor(p)), 5) + 0.0 AS value FROM t JOIN signal a ON a.recording_id = t.recording_id AND a.channel = t.channel AND a.idx = CAST(floor(p) AS INT) LEFT JOIN signal b ON b.recording_id = t.recording_id AND b.channel = t.channel AND b.idx = CAST(floor(p) AS INT) + 1")
def resample_linear(spark, sf_dir):
    return _out(rs.resample_linear(signal(spark, sf_dir, "_length", "_following"), 256, "_length", "_following"), 5)


@query(f"WITH {_N} SELECT s.recording_id, s.channel, CAST(s.idx - (n - 256) // 2 AS INT) AS idx, round(value, 6) + 0.0 AS value FROM signal s JOIN n USING (recording_id, channel) WHERE s.idx >= (n - 256) // 2 AND s.idx < (n - 256) // 2 + 256")
def center_crop(spark, sf_dir):
    return _out(rs.center_crop(signal(spark, sf_dir), 256))


@query(f"WITH {_N} SELECT l.recording_id, l.channel, CAST(t.range AS INT) AS idx, round(value, 6) + 0.0 AS value FROM n l CROSS JOIN range(0, 800) t JOIN signal s ON s.recording_id = l.recording_id AND s.channel = l.channel AND s.idx = greatest(0, least(l.n - 1, t.range - (800 - l.n) // 2))")
def edge_pad(spark, sf_dir):
    return _out(rs.edge_pad(signal(spark, sf_dir), 800))


@query(f"WITH {_N} SELECT s.recording_id, s.channel, CAST((s.idx + 37) % n AS INT) AS idx, round(value, 6) + 0.0 AS value FROM signal s JOIN n USING (recording_id, channel)")
def circular_shift(spark, sf_dir):
    return _out(rs.circular_shift(signal(spark, sf_dir), F.lit(37)))


@query(f"WITH {_N} SELECT s.recording_id, s.channel, CAST(least(s.idx // (n // 4), 3) AS INT) AS segment, count(*) AS n, round(sum(value), 5) + 0.0 AS total FROM signal s JOIN n l USING (recording_id, channel) GROUP BY ALL".replace("(n // 4)", "(l.n // 4)"))
def segment_bounds(spark, sf_dir):
    """Four segments of each series, the last with the rest."""
    n = F.max("idx").over(W.partitionBy("recording_id", "channel")) + 1
    s = signal(spark, sf_dir).withColumn("segment", rs.segment_of(F.col("idx"), n, 4))
    return s.groupBy("recording_id", "channel", "segment").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 5).alias("total"))


@query(f"WITH {_N}, o AS (SELECT recording_id, channel, coalesce(sum(n) OVER (PARTITION BY recording_id ORDER BY channel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM n) SELECT s.recording_id, CAST(start + idx AS BIGINT) AS pos, round(value, 6) + 0.0 AS value FROM signal s JOIN o USING (recording_id, channel)")
def flatten_vector(spark, sf_dir):
    return rs.flatten_vector(signal(spark, sf_dir)).select("recording_id", F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


@query("SELECT sample_id AS recording_id, CASE WHEN sample_id % 2 = 0 THEN i // 16 ELSE i % 4 END AS r, CASE WHEN sample_id % 2 = 0 THEN i % 16 ELSE i // 4 END AS c, round(v, 6) + 0.0 AS value FROM flat")
def orient_channels(spark, sf_dir):
    """Matrices of 4 channels, half of them stored the other way round, all with channels as rows."""
    p = F.posexplode("x").alias("i", "value")
    rows = samples(spark, sf_dir).select(F.col("sample_id").alias("recording_id"), p)
    even = F.col("recording_id") % 2 == 0
    grid = rows.select("recording_id", F.when(even, F.floor(F.col("i") / 16)).otherwise(F.floor(F.col("i") / 4)).alias("r"), F.when(even, F.col("i") % 16).otherwise(F.col("i") % 4).cast("long").alias("c"), "value")
    return rs.orient(grid, 4).select("recording_id", "r", "c", r6("value").alias("value"))


@query("""WITH g AS (SELECT sample_id, i // 8 AS r, i % 8 AS c, v FROM flat), t AS (SELECT range AS o, range * (7 / 11.0) AS p FROM range(0, 12)), w AS (SELECT o, CAST(floor(p) AS BIGINT) AS i, 1 - (p - floor(p)) AS w FROM t UNION ALL SELECT o, least(CAST(floor(p) AS BIGINT) + 1, 7), p - floor(p) FROM t)
SELECT sample_id, a.o AS r, b.o AS c, round(sum(v * a.w * b.w), 5) + 0.0 AS value FROM g JOIN w a ON g.r = a.i JOIN w b ON g.c = b.i GROUP BY ALL""")
def resize_grid(spark, sf_dir):
    """Grids of 8 by 8 to 12 by 12."""
    g = samples(spark, sf_dir).select("sample_id", F.posexplode("x").alias("i", "value")).select("sample_id", F.floor(F.col("i") / 8).cast("int").alias("r"), (F.col("i") % 8).alias("c"), "value")
    return rs.resize_grid(g, ["sample_id"], 8, 8, 12, 12).select("sample_id", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), r6("value", 5).alias("value"))


@query("SELECT sample_id, i, CAST(CASE WHEN max(v) OVER w > min(v) OVER w THEN floor((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 255) ELSE 0 END AS INT) AS pixel FROM flat WINDOW w AS (PARTITION BY sample_id)")
def matrix_to_pixels(spark, sf_dir):
    g = samples(spark, sf_dir).select("sample_id", F.posexplode("x").alias("i", "value"))
    return rs.to_pixels(g, ["sample_id"]).select("sample_id", F.col("i").cast("long").alias("i"), "pixel")


@query("""WITH v AS (SELECT recording_id, CAST(floor(idx / 64) AS BIGINT) AS window_id, CASE channel WHEN 'price' THEN 'Fp1' WHEN 'quantity' THEN 'O2' WHEN 'tax' THEN 'Cz' ELSE 'T7' END AS channel, avg(value) AS value FROM signal GROUP BY ALL HAVING count(*) = 64),
g AS (SELECT * FROM (SELECT DISTINCT recording_id, window_id FROM v), range(0, 8) a(row), range(0, 9) b(col))
SELECT g.recording_id, g.window_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col, round(coalesce(value, 0), 6) + 0.0 AS value FROM g LEFT JOIN v ON v.recording_id = g.recording_id AND v.window_id = g.window_id AND (channel, row, col) IN (('Fp1', 0, 2), ('O2', 7, 6), ('Cz', 4, 4), ('T7', 4, 0))""")
def grid_map(spark, sf_dir):
    """Window means of four channels on the scalp grid."""
    name = F.when(F.col("channel") == "price", "Fp1").when(F.col("channel") == "quantity", "O2").when(F.col("channel") == "tax", "Cz").otherwise("T7")
    v = wn.tumbling_windows(signal(spark, sf_dir, "n"), 64, "n").groupBy("recording_id", "window_id", name.alias("channel")).agg(F.avg("value").alias("value"))
    return rs.grid_map(v, ["recording_id", "window_id"]).select("recording_id", F.col("window_id").cast("long").alias("window_id"), "row", "col", r6("value").alias("value"))


_STACK = """WITH v AS (SELECT recording_id, CAST(floor(idx / 64) AS BIGINT) AS window_id, channel, 0.5 * ln(2 * pi() * exp(1.0) * CASE WHEN var_pop(value) = 0 THEN 1e-10 ELSE var_pop(value) END) AS de FROM signal GROUP BY ALL HAVING count(*) = 64),
l AS (SELECT *, max(window_id) OVER (PARTITION BY recording_id) AS last FROM v)
SELECT recording_id, window_id - t AS block_id, t AS place, channel, round(de, 5) + 0.0 AS value FROM l, range(0, 8) r(t) WHERE window_id - t >= 0 AND window_id - t + 7 <= last"""


@query(_STACK)
def stack_4d(spark, sf_dir):
    """Blocks of eight windows of differential entropy for each channel."""
    v = st.stat_features(wn.tumbling_windows(signal(spark, sf_dir, "n"), 64, "n"), ["recording_id", "window_id", "channel"]).select("recording_id", "window_id", "channel", F.col("entropy").alias("value"))
    b = wn.consecutive_blocks(v, 8, ("recording_id",))
    return b.select("recording_id", F.col("block_id").cast("long").alias("block_id"), F.col("place").cast("long").alias("place"), "channel", r6("value", 5).alias("value"))


_IMG = """WITH p AS (SELECT a.recording_id, CAST(floor(a.idx / 64) AS BIGINT) AS window_id, CAST(a.k AS INT) AS r, CAST(b.k AS INT) AS c, round(abs(corr(a.value, b.value)), 9) AS corr, round(abs(avg(a.value - b.value)), 9) AS gap FROM (SELECT *, dense_rank() OVER (ORDER BY channel) - 1 AS k FROM signal) a JOIN (SELECT *, dense_rank() OVER (ORDER BY channel) - 1 AS k FROM signal) b ON a.recording_id = b.recording_id AND a.idx = b.idx AND a.channel <> b.channel GROUP BY ALL HAVING count(*) = 64),
m AS (SELECT recording_id, window_id, 'corr' AS measure, 0 AS nth, r, c, corr AS value FROM p UNION ALL SELECT recording_id, window_id, 'gap', 1, r, c, gap FROM p),
x AS (SELECT *, CAST(CASE WHEN max(value) OVER w > min(value) OVER w THEN floor((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 255) ELSE 0 END AS INT) AS pixel, max(window_id) OVER (PARTITION BY recording_id) AS last FROM m WINDOW w AS (PARTITION BY recording_id, window_id, measure))
SELECT recording_id, window_id - t AS block_id, CAST(r + 4 * nth AS INT) AS row, CAST(c + 4 * t AS INT) AS col, pixel FROM x, range(0, 3) q(t) WHERE window_id - t >= 0 AND window_id - t + 2 <= last"""


@query(_IMG)
def fused_image(spark, sf_dir):
    """Two measures of channel pairs below each other, three windows side by side, as pixels."""
    names = F.array(*[F.lit(c) for c in ("discount", "price", "quantity", "tax")])
    p = st.channel_pairs(wn.tumbling_windows(signal(spark, sf_dir, "n"), 64, "n"), ["recording_id", "window_id"], "pos")
    e = p.groupBy("recording_id", "window_id", "src", "dst").agg(F.round(F.abs(F.corr("x", "y")), 9).alias("corr"), F.round(F.abs(F.avg(F.col("x") - F.col("y"))), 9).alias("gap"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in ("corr", "gap")]))
    m = e.select("recording_id", "window_id", "src", "dst", each.alias("_m")).select("recording_id", "window_id", "_m.measure", (F.array_position(names, F.col("src")) - 1).alias("r"), (F.array_position(names, F.col("dst")) - 1).alias("c"), "_m.value")
    b = wn.consecutive_blocks(rs.to_pixels(m, ["recording_id", "window_id", "measure"]), 3, ("recording_id",))
    return rs.fused_image(b, ["recording_id"], 4, ["corr", "gap"]).withColumn("block_id", F.col("block_id").cast("long"))
