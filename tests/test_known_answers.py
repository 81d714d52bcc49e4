"""Known answers and properties of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import augment as ag
from sigloom.operators import connectivity as cn
from sigloom.operators import filters as fl
from sigloom.operators import metrics as mt
from sigloom.operators import reshaping as rs
from sigloom.operators import spectral as sp
from sigloom.operators import splits as sl
from sigloom.operators import statistics as st
from sigloom.operators import windows as wn
from sigloom.scratch import table


def series(spark, values, channel="a", recording=1):
    return spark.createDataFrame([(recording, channel, i, float(v)) for i, v in enumerate(values)], "recording_id long, channel string, idx int, value double")


def test_sine_has_one_bin_and_no_entropy(spark):
    w = wn.tumbling_windows(series(spark, np.sin(2 * np.pi * 5 * np.arange(128) / 128)), 128)
    by = ["recording_id", "channel", "window_id"]
    psd = sp.periodogram(w, by, 128, 128.0)
    got = {r.bin: r.psd for r in psd.collect()}
    assert max(got, key=got.get) == 5 and all(v < 1e-12 for k, v in got.items() if k != 5)
    assert abs(sp.spectral_entropy(psd, by).first().entropy) < 1e-9


def test_constant_series(spark):
    w = wn.tumbling_windows(series(spark, [3.0] * 64), 64)
    by = ["recording_id", "channel", "window_id"]
    h = st.hjorth(w, by, "pos").first()
    assert (h.activity, h.mobility, h.complexity) == (0, 0, 0)
    assert st.stat_features(w, by).first().entropy == pytest.approx(0.5 * math.log(2 * math.pi * math.e * 1e-10))


@pytest.mark.parametrize("n,size,overlap,frames", [(8064, 256, 128, 64), (640, 128, 64, 11), (28000, 400, 200, 141)])
def test_frame_counts(spark, n, size, overlap, frames):
    assert sp.stft(series(spark, np.ones(n)), size, overlap).select("frame").distinct().count() == frames


def test_windows(spark):
    assert wn.sliding_windows(series(spark, range(1536)), 512, 256).select("window_id").distinct().count() == 5


def test_istft_inverts_stft(spark):
    x = np.random.default_rng(0).normal(size=300)
    back = {r.idx: r.value for r in sp.istft(sp.stft(series(spark, x), 64, 32), 64, 32).collect()}
    assert all(back[i] == pytest.approx(x[i], abs=1e-9) for i in range(300))


def test_wavelet_packet_keeps_energy_inside(spark):
    x = np.zeros(64)
    x[20:44] = np.random.default_rng(1).normal(size=24)
    w = wn.tumbling_windows(series(spark, x), 64)
    one = sp.wavelet_packet(w, ["recording_id", "channel", "window_id"], 64, levels=1)
    assert one.agg(F.sum(F.col("c") * F.col("c"))).first()[0] == pytest.approx((x**2).sum(), rel=1e-9)
    assert sp.wavelet_packet(w, ["recording_id", "channel", "window_id"], 64).select("node").distinct().count() == 16


def test_butterworth_passes_its_band_and_zero_phase_keeps_place(spark):
    b, a = fl.butterworth(4, 8.0, 13.0, 128.0)
    gain = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / 128)) / np.polyval(a, np.exp(2j * np.pi * f / 128)))
    assert gain(10.2) == pytest.approx(1, abs=1e-3) and gain(2) < 1e-2 and gain(30) < 1e-2 and gain(8) == pytest.approx(2**-0.5, abs=1e-6)
    t = np.arange(512) / 128
    y, short = fl.zero_phase(b, a, [np.sin(2 * np.pi * 10 * t), np.ones(5)])
    assert np.corrcoef(y[100:400], np.sin(2 * np.pi * 10 * t)[100:400])[0, 1] > 0.999
    assert list(short) == [1] * 5


def one_pass(b, a, x, z=None):
    """The difference equation written out."""
    z, out = list(np.zeros(len(b) - 1) if z is None else z), []
    for v in x:
        y = b[0] * v + z[0]
        z = [b[k] * v - a[k] * y + (z[k] if k < len(z) else 0.0) for k in range(1, len(b))]
        out.append(y)
    return np.array(out)


def forth_and_back(b, a, x):
    pad = 3 * max(len(a), len(b))
    if len(x) <= pad:
        return x
    ext = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    z = fl.steady(b, a)
    y = one_pass(b, a, ext, z * ext[0])[::-1]
    return one_pass(b, a, y, z * y[0])[::-1][pad:-pad]


def many_series(spark, sizes=(200, 90, 20, 133, 34)):
    rng = np.random.default_rng(11)
    made = {(k, c): rng.normal(size=n) for k, n in enumerate(sizes) for c in "ab"}
    rows = [(k, c, i, float(v)) for (k, c), x in made.items() for i, v in enumerate(x)]
    return made, spark.createDataFrame(rows, "recording_id long, channel string, idx int, value double").repartition(3)


def values_of(df, by=("recording_id", "channel")):
    out = {}
    for r in df.orderBy(*by, "idx").collect():
        out.setdefault(tuple(r[c] for c in by), []).append(r["value"])
    return {k: np.array(v) for k, v in out.items()}


@pytest.mark.parametrize("causal", [True, False])
def test_filters_of_many_series_match_one_written_out(spark, causal):
    made, df = many_series(spark)
    b, a = fl.butterworth(4, 8.0, 13.0, 128.0)
    got = values_of(fl.bandpass(df, 4, 8.0, 13.0, 128.0, causal))
    assert set(got) == set(made)
    for key, x in made.items():
        assert got[key] == pytest.approx(one_pass(b, a, x) if causal else forth_and_back(b, a, x), abs=1e-9)


def test_jittered_band_matches_one_written_out(spark):
    import hashlib

    made, df = many_series(spark)
    draw = lambda op, key: int(hashlib.md5(f"1#{op}#{key}#0".encode()).hexdigest()[:13], 16) / 2**52
    got, by_sample = values_of(fl.jittered(df)), values_of(ag.band_jitter_filter(df.withColumnRenamed("recording_id", "sample_id")), ("sample_id", "channel"))
    for (k, c), x in made.items():
        for key, found in ((f"{k}:{c}", got[k, c]), (str(k), by_sample[k, c])):
            move = (1 + draw("edge", key)) * (-1 if draw("edge:sign", key) < 0.5 else 1)
            low, high = max(0.1, 0.5 + move) / 64, min(63.0, 45 + move) / 64
            low = min(max(low, 0.01), 0.99)
            b, a = fl.butterworth(4, low * 64, max(low + 0.01, min(high, 0.99)) * 64, 128.0)
            assert found == pytest.approx(one_pass(b, a, x), abs=1e-7)


def test_published_confusion_matrix(spark):
    rows = [(0, 0, 3274), (0, 1, 102), (1, 0, 146), (1, 1, 3045)]
    m = spark.createDataFrame(rows, "y_true int, y_pred int, n long")
    p = {r["class"]: r for r in mt.per_class_prf(m).collect()}
    assert p[0].precision == pytest.approx(0.95731, abs=1e-5) and p[1].recall == pytest.approx(0.95425, abs=1e-5) and p[0].f1 == pytest.approx(0.96351, abs=1e-5)
    a = {r.average: r for r in mt.averaged_prf(mt.per_class_prf(m)).collect()}
    assert a["macro"].f1 == pytest.approx(0.96219, abs=1e-5) and a["weighted"].precision == pytest.approx(0.96230, abs=1e-5)


def test_small_confusion(spark):
    s = spark.createDataFrame(list(zip(range(6), [0, 1, 0, 1, 0, 1], [0, 1, 1, 1, 0, 0])), "row_id long, y_true int, y_pred int")
    got = {(r.y_true, r.y_pred): r.n for r in mt.confusion_matrix(s, 2).collect()}
    assert got == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 2}


def test_patience(spark):
    h = spark.createDataFrame([("r", i, v) for i, v in enumerate([1.0, 0.9, 0.85, 0.84, 0.83, 0.82])], "run string, epoch long, value double")
    assert wn.patience_stop(h, ["run"], "epoch", "value", 3, 0.01).first().stop_at is None
    flat = spark.createDataFrame([("r", i, 1.0) for i in range(6)], "run string, epoch long, value double")
    assert wn.patience_stop(flat, ["run"], "epoch", "value", 3, 0.01).first().stop_at == 3


def test_quotas_and_folds(spark):
    q = ag.quotas(600)
    assert q["gaussian_noise"] == 250 and q["time_shift"] == 150
    rows = spark.range(103).withColumnRenamed("id", "k")
    sizes = [r["count"] for r in sl.k_fold(rows, "k", 5).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [21, 21, 21, 20, 20]
    one = sorted(map(tuple, sl.random_split(rows.repartition(1), "k", (0.7, 0.15)).collect()))
    assert one == sorted(map(tuple, sl.random_split(rows.repartition(8), "k", (0.7, 0.15)).collect()))


def test_full_shift_is_identity(spark):
    s = series(spark, range(10))
    assert sorted(map(tuple, rs.circular_shift(s, F.lit(10)).collect())) == sorted(map(tuple, s.collect()))


def windowed(spark, x, size, names="abc"):
    rows = [(1, c, i, float(v)) for k, c in enumerate(names) for i, v in enumerate(x[:, k])]
    return wn.tumbling_windows(spark.createDataFrame(rows, "recording_id long, channel string, idx int, value double"), size)


def test_lagged_ols_matches_a_direct_solution(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(256, 3))
    for t in range(1, 256):
        x[t, 1] += 0.8 * x[t - 1, 0]
    x[128:, 2] = 1.0  # constant in its second window: no unique solution there
    got = {(r.window_id, r.src, r.dst): r.value for r in cn.lagged_ols(windowed(spark, x, 128), ["recording_id", "window_id"]).collect()}
    assert len(got) == 12
    first = x[:128]
    design = np.column_stack([np.ones(118)] + [first[10 - k : 128 - k, c] for c in range(3) for k in range(1, 11)])
    beta = np.linalg.lstsq(design, first[10:], rcond=None)[0]
    for i, src in enumerate("abc"):
        for j, dst in enumerate("abc"):
            if i != j:
                assert got[0, src, dst] == pytest.approx(np.abs(beta[1 + 10 * i : 11 + 10 * i, j]).sum(), rel=1e-6)
    assert got[0, "a", "b"] > 2 * got[0, "b", "a"]
    assert got[1, "a", "b"] == pytest.approx(abs(np.corrcoef(x[128:, 0], x[128:, 1])[0, 1])) and got[1, "a", "c"] is None


def test_connectivity_measures_and_grids_match_brute_force(spark):
    x = np.random.default_rng(3).normal(size=(140, 3))
    by, w = ["recording_id", "window_id"], windowed(spark, x, 64)
    edges = cn.connectivity_set({"te": cn.transfer_entropy(w, by), "corr": st.correlation_matrix(w, by, "pos"), "ols": cn.lagged_ols(w, by, 2)})
    edges = table(edges)  # made once: sums of another run may differ in their last digit
    got = {(r.window_id, r.measure, r.src, r.dst): r.value for r in edges.collect()}
    assert len(got) == 2 * 3 * 6

    def kth(points, k=4):
        return [sorted(math.dist(p, q) for j, q in enumerate(points) if j != i)[k - 1] for i, p in enumerate(points)]

    def entropy(points):
        return len(points[0]) * sum(math.log(r + 1e-10) for r in kth(points)) / len(points) + math.log(len(points)) + cn.EULER

    dist = {(r.window_id, r.channel, r.t): r.r for r in cn.kth_distance(w, by).collect()}
    for n in (0, 1):
        part = x[64 * n : 64 * n + 64]
        delay = lambda c: [[part[t, c], part[t + 10, c], part[t + 20, c]] for t in range(43)]  # noqa: B023, E731
        for j, dst in enumerate("abc"):
            own = [y + [part[t + 21, j]] for t, y in enumerate(delay(j))]
            assert [dist[n, dst, t] for t in range(43)] == pytest.approx(kth(own))
            for i, src in enumerate("abc"):
                if i != j:
                    both = [y + z + [part[t + 21, j]] for t, (y, z) in enumerate(zip(delay(j), delay(i)))]
                    assert got[n, "te", src, dst] == pytest.approx(max(0, entropy(own) - entropy(both)), abs=1e-9)
                    assert got[n, "corr", src, dst] == pytest.approx(abs(np.corrcoef(part[:, i], part[:, j])[0, 1]))
    for r in cn.connectivity_grids(edges, by, ["a", "b", "c"]).collect():
        assert r.grid == [[got[r.window_id, r.measure, s, d] if s != d else 0.0 for s in "abc"] for d in "abc"]


def test_identical_samples_pass_every_check(spark):
    from sigloom.operators import quality as ql

    rng = np.random.default_rng(4)
    rows = [(s, c, i, float(v), float(v if s == 1 else 3 + 9 * rng.normal())) for s in (1, 2) for c in "ab" for i, v in enumerate(rng.normal(size=60))]
    got = {r.sample_id: r for r in ql.quality_score(ql.sample_checks(spark.createDataFrame(rows, "sample_id long, channel string, idx int, a double, b double")), ql.CHECKS).collect()}
    assert got[1].score == 1 and got[1].mmd == 0 and got[1].accepted
    assert not got[2].distribution and not got[2].amplitude and not got[2].accepted


def test_kernel_distance_without_a_limit(spark):
    from sigloom.operators import quality as ql

    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(130, 3)) * 0.5, rng.normal(size=(150, 3)) * 0.5 + 0.3
    df = spark.createDataFrame([(1, k, [float(v) for v in r]) for k, r in enumerate(x)] + [(2, k, [float(v) for v in r]) for k, r in enumerate(y)], "side int, sample_id long, x array<double>")

    def want(p, q):
        k = lambda u, v: np.exp(-((u[:, None] - v[None]) ** 2).sum(2)).mean()
        return math.sqrt(k(p, p) + k(q, q) - 2 * k(p, q))

    assert ql.mmd_rbf(df, limit=None).first().mmd == pytest.approx(want(x, y))
    assert ql.mmd_rbf(df).first().mmd == pytest.approx(want(x[:100], y[:100]))


def test_every_quota_is_met_and_labels_are_blended(spark):
    rng = np.random.default_rng(6)
    n = 12
    rows = spark.createDataFrame([(s, c, i, float(v)) for s in range(n) for c in "abc" for i, v in enumerate(rng.normal(size=64))], "sample_id long, channel string, idx int, value double")
    labels = spark.createDataFrame([(s, s % 2) for s in range(n)], "sample_id long, label int")
    counts = ag.quotas(n, ag.SHARES | {"cutmix": 0.1})
    values, made = ag.augment_dataset(rows, labels, counts, 64)
    size = {(r.technique, r.draw_no): r["count"] for r in values.where("technique <> 'original'").groupBy("technique", "draw_no").count().collect()}
    assert len(size) == sum(counts.values()) == made.count() and set(size.values()) == {3 * 64}
    for r in made.collect():
        assert (r.source2_id is None) == (r.technique not in ag.PAIRED) and r.hard1 == r.source_id % 2
        assert r.soft == pytest.approx([r.weight, 1 - r.weight]) and r.blend == pytest.approx(r.weight * r.hard1 + (1 - r.weight) * r.hard2)
        assert r.technique != "smote" or (r.hard1 == r.hard2 and r.source2_id != r.source_id)
    with pytest.raises(ValueError):
        ag.augment_dataset(rows, labels, {"no such": 1}, 64)


def test_stretched_slices_keep_their_ends(spark):
    x = np.random.default_rng(7).normal(size=40)
    cut = spark.createDataFrame([(1, "a", i, float(v), 33, 40) for i, v in enumerate(x[:33])], "sample_id long, channel string, idx int, value double, _size int, _n int")
    got = [r.value for r in ag.stretched(cut).orderBy("idx").collect()]
    assert got == pytest.approx(np.interp(np.linspace(0, 32, 40), np.arange(33), x[:33]))


def test_draws_tell_apart_more_rows_than_32_bits(spark):
    from sigloom.functions.draws import uniform

    low = spark.range(200_000).select((uniform(1, "x", F.col("id")) * 2.0**52).cast("long").alias("u"))
    assert low.select((F.col("u") % (1 << 20)).alias("l")).distinct().count() > 150_000


def test_patience_matches_a_loop(spark):
    rng, rows, want = np.random.default_rng(8), [], {}
    for k in range(30):
        best, count, stop = None, 0, None
        for i, v in enumerate(rng.normal(size=25).cumsum() * 0.05):
            rows.append((f"r{k}", i, float(v)))
            if best is None or v < best - 0.01:
                best, count = float(v), 0
            else:
                count += 1
                stop = i if stop is None and count >= 3 else stop
        want[f"r{k}"] = (stop, best)
    got = wn.patience_stop(spark.createDataFrame(rows, "run string, epoch long, value double"), ["run"], "epoch", "value", 3, 0.01).collect()
    assert {r.run: (r.stop_at, r.best) for r in got} == want


def test_scratch_goes(spark):
    from sigloom.scratch import exists, mark, new_folder, release, table

    since = mark(spark)
    kept, path = table(spark.range(3)), new_folder(spark)
    spark.range(5).write.parquet(path)
    assert exists(spark, path) and kept.count() == 3
    last = table(spark.range(7))
    release(spark, since, keep=1)
    assert not exists(spark, path) and last.count() == 7 and mark(spark) == since + 1
    release(spark, since)
    assert mark(spark) == since


def test_shuffle_files_go_with_the_table_that_they_served(spark):
    from sigloom.scratch import CLEANUP, table

    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    known = lambda: tracker.shuffleStatuses().size()
    before = known()
    counts = table(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert counts.count() == 7 and spark.conf.get(CLEANUP) == "false"
    sums = table(spark.range(1000).repartition(3).groupBy((F.col("id") % 5).alias("k")).count().join(counts.withColumnRenamed("count", "n"), "k"))
    assert sums.count() == 5
    assert known() <= before + 2  # those of the two counts; the tables' own are gone


def test_threads_that_overlap_leave_the_shuffle_setting_as_it_was(spark):
    from sigloom.scratch import CLEANUP, shuffles_go

    before, one, two = spark.conf.get(CLEANUP), shuffles_go(spark), shuffles_go(spark)
    spark.conf.set(CLEANUP, "false")
    one.__enter__()
    two.__enter__()
    one.__exit__(None, None, None)
    assert spark.conf.get(CLEANUP) == "true"
    two.__exit__(None, None, None)
    assert spark.conf.get(CLEANUP) == "false"
    spark.conf.set(CLEANUP, before)


def test_stream_windows(spark, tmp_path):
    from sigloom.streaming.windows import window_stats

    rows = spark.createDataFrame([(f"2024-01-01 00:00:{s:02d}", "a", float(s)) for s in range(0, 60, 5)] + [("2024-01-01 01:00:00", "a", 0.0)], "t string, channel string, value double").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = window_stats(stream, "t", "30 seconds", "1 minute", ["channel"]).writeStream.format("memory").queryName("stats").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert [(r.n, r["mean"]) for r in spark.sql("SELECT * FROM stats ORDER BY start").collect()] == [(6, 12.5), (6, 42.5)]


def test_entry_without_the_optional_subpackage(monkeypatch):
    import __spark_entry__ as entry

    real = entry.find_spec
    monkeypatch.setattr(entry, "find_spec", lambda name: None if name in ("sigloom.llm", "corpus_pipeline") else real(name))
    assert not any(q.startswith("op") or q == "pipeline" for q in entry.queries()) and "window_features" in entry.queries()
