"""What holds beyond small tables: blocks, cells, ranges, tiles and splits, with small constants against brute force."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from sigloom.operators import augment as ag
from sigloom.operators import connectivity as cn
from sigloom.operators import filters as fl
from sigloom.operators import neighbours as nb
from sigloom.operators import quality as ql
from sigloom.operators import ranges as rg
from sigloom.operators import reshaping as rs
from sigloom.operators import spectral as sp
from sigloom.operators import splits as sl
from sigloom.operators import metrics as mt
from sigloom.operators import windows as wn
from sigloom.sources import files

SIGNAL = "recording_id long, channel string, idx int, value double"


def long(spark, made):
    return spark.createDataFrame([(k, c, i, float(v)) for (k, c), x in made.items() for i, v in enumerate(x)], SIGNAL).repartition(5)


def rows_by(df, by=("recording_id", "channel")):
    out = {}
    for r in df.orderBy(*by, "idx").collect():
        out.setdefault(tuple(r[c] for c in by), []).append(r["value"])
    return {k: np.array(v) for k, v in out.items()}


def plain_pass(b, a, x, z):
    out = []
    for v in x:
        y = b[0] * v + z[0]
        z = [b[k] * v - a[k] * y + (z[k] if k < len(z) else 0.0) for k in range(1, len(b))]
        out.append(y)
    return np.array(out)


def plain_both_ways(b, a, x):
    pad = 3 * len(a)
    if len(x) <= pad:
        return x
    ext = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    z = fl.steady(b, a)
    y = plain_pass(b, a, ext, z * ext[0])[::-1]
    return plain_pass(b, a, y, z * y[0])[::-1][pad:-pad]


@pytest.mark.parametrize("both_ways", [False, True])
def test_filters_over_many_blocks_match_a_loop(spark, both_ways):
    rng = np.random.default_rng(1)
    made = {(k, c): rng.normal(size=n).cumsum() for k, n in enumerate((1000, 64, 65, 20, 191, 128, 1)) for c in "ab"}
    b, a = fl.butterworth(4, 8.0, 13.0, 128.0)
    got = rows_by(fl.bandpass(long(spark, made), 4, 8.0, 13.0, 128.0, causal=not both_ways, block=64, span=3))
    assert set(got) == set(made)
    for key, x in made.items():
        want = plain_both_ways(b, a, x) if both_ways else plain_pass(b, a, x, np.zeros(8))
        np.testing.assert_allclose(got[key], want, atol=1e-9 * np.abs(x).max())


def test_jittered_blocks_match_whole_series(spark):
    rng = np.random.default_rng(2)
    df = long(spark, {(k, "a"): rng.normal(size=n) for k, n in enumerate((700, 130, 40))})
    one, many = rows_by(fl.jittered(df)), rows_by(fl.jittered(df, block=64, span=2))
    for key, x in one.items():
        np.testing.assert_allclose(many[key], x, atol=1e-8)


def test_a_long_series_is_filtered_by_many_tasks(spark):
    n = 2_000_000
    df = spark.range(n, numPartitions=8).select(F.lit(1).cast("long").alias("recording_id"), F.lit("a").alias("channel"), F.col("id").cast("int").alias("idx"), (F.sin(F.col("id") * 0.5) + F.sin(F.col("id") * 0.01)).alias("value"))
    found = fl.bandpass(df, 4, 8.0, 13.0, 128.0, causal=True).where(F.col("idx") % 997 == 3).select("idx", "value").collect()
    i = np.arange(n)
    b, a = fl.butterworth(4, 8.0, 13.0, 128.0)
    want = fl.recursive(b, a, [np.sin(i * 0.5) + np.sin(i * 0.01)])[0][0]
    assert len(found) == len(range(3, n, 997)) and max(abs(r.value - want[r.idx]) for r in found) < 1e-9


@pytest.mark.parametrize("size,overlap,chunk", [(64, 32, 4), (64, 48, 3), (48, 12, 2), (64, 32, 64), (33, 16, 5)])
def test_frames_of_chunks_match_a_direct_transform(spark, size, overlap, chunk):
    rng = np.random.default_rng(3)
    made = {(k, "a"): rng.normal(size=n) for k, n in enumerate((1, 31, 64, 500, 777))}
    hop, half = size - overlap, size // 2
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    want = {}
    for (k, _), x in made.items():
        last = max(0, math.ceil((len(x) + 2 * half - size) / hop))
        ext = np.concatenate((np.zeros(half), x, np.zeros(half + size + hop)))
        for f in range(last + 1):
            part = ext[f * hop : f * hop + size]
            for b, v in enumerate(np.fft.rfft(part * window) / (size / 2)):
                want[k, f, b] = v
    spectrum = sp.stft(long(spark, made), size, overlap, chunk=chunk)
    got = {(r.recording_id, r.frame, r.bin): complex(r.re, r.im) for r in spectrum.collect()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-12
    some = {(r.recording_id, r.frame, r.bin): r.mag for r in sp.stft(long(spark, made), size, overlap, bins=(2, 5), chunk=chunk).collect()}
    assert some.keys() == {k for k in want if 2 <= k[2] <= 5} and all(some[k] == pytest.approx(abs(want[k]), abs=1e-12) for k in some)
    if size % 2 == 0 and hop <= half:
        back = rows_by(sp.istft(spectrum, size, overlap, chunk=chunk))
        for key, x in made.items():
            np.testing.assert_allclose(back[key][: len(x)], x, atol=1e-9)


def knn_plain(rows, k):
    out = {}
    for i, c, x in rows:
        near = sorted((((np.array(y) - np.array(x)) ** 2).sum(), j) for j, d, y in rows if d == c and j != i)[:k]
        for r, (_, j) in enumerate(near):
            out[i, r + 1] = j
    return out


@pytest.mark.parametrize("kind", ["clusters", "spread", "ties"])
def test_neighbours_over_cells_match_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    if kind == "clusters":
        x = rng.normal(size=(12, 5))[rng.integers(0, 12, 420)] * 20 + rng.normal(size=(420, 5))
    elif kind == "spread":
        x = rng.normal(size=(420, 5))
    else:
        x = rng.integers(0, 3, (420, 3)).astype(float)
    labels = rng.choice(["a", "b", "c"], 420, p=[0.6, 0.38, 0.02])
    labels[:1] = "alone"
    rows = [(k, str(c), [float(v) for v in r]) for k, (c, r) in enumerate(zip(labels, x))]
    df = spark.createDataFrame(rows, "sample_id long, label string, x array<double>")
    got = nb.knn_same_class(df, 4, cell=10, pivots=40, most=50).collect()
    assert {(r.sample_id, r["rank"]): r.neighbour for r in got} == knn_plain(rows, 4)


def test_wanted_neighbours_match_brute_force_and_travel_once_to_a_block(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 16))  # no bound tells these apart
    x[7] = x[3]
    df = spark.createDataFrame([(k, str(k % 2), [float(v) for v in r]) for k, r in enumerate(x)], "sample_id long, label string, x array<double>")
    some = [0, 3, 7, 500, 899]
    made = []
    monkeypatch.setattr(nb, "table", lambda d: made.append(rg.table(d)) or made[-1])
    got = nb.knn_same_class(df, 3, cell=10, pivots=200, most=100, wanted=spark.createDataFrame([(k,) for k in some + some], "sample_id long")).collect()
    plain = {r: j for r, j in knn_plain([(k, k % 2, v) for k, v in enumerate(x)], 3).items() if r[0] in some}
    assert {(r.sample_id, r["rank"]): r.neighbour for r in got} == plain
    nb.knn_same_class(df, 3, cell=10, pivots=200, most=100).count()
    visits = max(d.count() for d in made if d.columns == ["label", "block", "id", "x", "bound"])
    assert visits <= 900 * 5  # 450 vectors of a class in five blocks or fewer, not in 44 cells


def test_visits_stay_near_linear_in_clusters():
    rng = np.random.default_rng(5)
    share = []
    for n in (4_000, 40_000):
        centres = rng.normal(size=(n // 200, 8)) * 50
        x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, 8))
        cells = nb.Cells({"a": x[rng.permutation(n)[: n // 100]]})
        home, away = cells.home("a", x)
        radius = {("a", int(c)): float(away[home == c].max()) for c in np.unique(home)}
        cells = nb.Cells(cells.pivots, radius)
        some = rng.permutation(n)[:500]
        row, _ = cells.reached("a", x[some], home[some], np.full(500, 4.0))
        share.append(len(row) / 500)
    assert share[1] < 2 * share[0] + 1


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_by_selection_match_numpy(spark, by):
    rng = np.random.default_rng(6)
    parts = {0: np.concatenate((rng.normal(size=900), [1e12, -1e300, 0.0, -0.0, 5e-324])), 1: rng.integers(-5, 5, 777).astype(float), 2: np.array([3.0]), 3: rng.normal(size=40)}
    rows = [(g, float(v)) for g, x in parts.items() for v in x] + [(0, None), (4, None)]
    df = spark.createDataFrame(rows, "g int, value double").repartition(4)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = rg.quantiles(df, by, shares, small=100, bits=16).collect()
    wanted = {(): np.concatenate(list(parts.values()))} if not by else {(g,): x for g, x in parts.items()}
    assert len(got) == len(wanted)
    for r in got:
        x = wanted[tuple(r[c] for c in by)]
        assert r.n == len(x) and r.q == pytest.approx(np.quantile(x, shares), rel=1e-12, abs=1e-300)


def test_one_outlier_and_crowded_scores_leave_ranges_even(spark):
    n = 120_000
    rows = spark.range(n).select((F.col("id") / 7.0).alias("value")).union(spark.createDataFrame([(1e12,)], "value double"))
    sizes = [r["count"] for r in rg.ranged(rows, [], ["value"], 256).groupBy("_b").count().collect()]
    assert max(sizes) < 0.01 * n and sum(sizes) == n + 1
    crowded = spark.range(n).select((1 - F.col("id") / 1e12).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("positive"))
    assert max(r["count"] for r in rg.ranged(crowded, [], ["score"], 256).groupBy("_b").count().collect()) < 0.01 * n
    tail = {r["split"]: r["count"] for r in sl.tail_validation(rows.withColumn("value", F.col("value")), "value", 0.25, parts=64).groupBy("split").count().collect()}
    assert tail == {"val": (n + 1) // 4, "train": n + 1 - (n + 1) // 4}


def test_curves_and_distributions_over_many_ranges(spark):
    rng = np.random.default_rng(7)
    rows = [(g, int(rng.integers(1, 3)), float(np.round(rng.normal(), 1))) for g in "ab" for _ in range(400)] + [("a", 1, 1e12)]
    df = spark.createDataFrame(rows, "g string, side int, value double")
    for r in wn.ecdf(df, ["g"], parts=9).collect():
        for side, f in ((1, r.f1), (2, r.f2)):
            own = [v for g, s, v in rows if g == r.g and s == side]
            assert f == pytest.approx(sum(v <= r.value for v in own) / len(own))
    scored = spark.createDataFrame([(g, v, s - 1) for g, s, v in rows], "g string, score double, positive int")
    for r in mt.threshold_counts(scored, ["g"], parts=9).collect():
        own = [(v, s - 1) for g, s, v in rows if g == r.g]
        assert (r.tp, r.fp) == (sum(p for v, p in own if v >= r.score), sum(1 - p for v, p in own if v >= r.score)) and r.p == sum(p for _, p in own)


@pytest.mark.parametrize("parts", [1, 7])
def test_weighted_draws_match_a_cumulative_search(spark, parts):
    rng = np.random.default_rng(8)
    weights = np.concatenate((rng.random(300), [500.0, 0.0, -1.0], rng.random(200) * 1e-6))
    u = rng.random(5_000)
    rows = spark.createDataFrame([(k, float(w)) for k, w in enumerate(weights)] + [(900, None)], "k long, w double")
    draws = spark.createDataFrame([(k, float(v)) for k, v in enumerate(u)], "draw long, u double")
    got = {r.draw: r.k for r in rg.weighted_draws(rows, "k", "w", draws, parts).collect()}
    kept = np.flatnonzero(weights > 0)
    ends = np.cumsum(weights[kept])
    assert got == {k: int(kept[np.searchsorted(ends, v * ends[-1], "right")]) for k, v in enumerate(u)}
    assert rg.weighted_draws(rows.where("w < 0"), "k", "w", draws).count() == 0


def test_a_million_weights_are_drawn_in_proportion(spark):
    n, m = 1_000_000, 200_000
    rows = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 10 + 1).cast("double").alias("w"))
    draws = spark.range(m).select(F.col("id").alias("draw"), (F.rand(3)).alias("u"))
    hit = rg.weighted_draws(rows, "k", "w", draws)
    assert "NestedLoop" not in hit._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in hit._jdf.queryExecution().executedPlan().toString()
    seen = np.zeros(10)
    for r in hit.groupBy((F.col("k") % 10).alias("d")).count().collect():
        seen[r.d] = r["count"]
    want = np.arange(1, 11) / 55 * m
    assert seen.sum() == m and ((seen - want) ** 2 / want).sum() < 27.9  # chi-square of 9, one in a thousand


def test_kernels_in_tiles_match_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(g, int(rng.integers(1, 3)), k, [float(v) for v in rng.normal(size=3)]) for g in "ab" for k in range(120)] + [("one", 1, 1, [0.0] * 3)]
    df = spark.createDataFrame(rows, "g string, side int, sample_id long, x array<double>")
    found = ql.kernel_means(df, ["g"], 0.7, limit=None, tile=13)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.g, r.s, r.t): (r.n, r.k) for r in found.collect()}
    for g in ("a", "b", "one"):
        sides = {s: np.array([x for h, t, _, x in rows if h == g and t == s]).reshape(-1, 3) for s in (1, 2)}
        for s in (1, 2):
            for t in (1, 2):
                n = len(sides[s]) * len(sides[t])
                assert ((g, s, t) in got) == (n > 0)
                if n:
                    k = np.exp(-0.7 * ((sides[s][:, None] - sides[t][None]) ** 2).sum(2)).mean()
                    assert got[g, s, t] == (n, pytest.approx(k, rel=1e-12))


def test_entropy_groups_by_destination_hold_no_square(spark, monkeypatch):
    rng = np.random.default_rng(10)
    rows = [(1, c, i, float(v)) for c in "abcde" for i, v in enumerate(rng.normal(size=90))]
    w, by = wn.tumbling_windows(spark.createDataFrame(rows, SIGNAL), 90), ["recording_id", "window_id"]
    whole = {(r.src, r.dst): r.value for r in cn.transfer_entropy(w, by).collect()}
    monkeypatch.setattr(cn, "HELD", 500)  # a few places at once
    parts = {(r.src, r.dst): r.value for r in cn.transfer_entropy(w, by, together=2).collect()}
    assert len(whole) == 20 and parts == pytest.approx(whole, abs=1e-12)


def test_a_large_csv_is_read_in_parts_with_exact_places(spark, tmp_path):
    n = 20_000
    for s in (1, 2, 13):
        (tmp_path / f"S{s:02d}G2AllChannels.csv").write_text("x,AF3,AF4\n" + "".join(f"{i},{s * 1000 + i}.5,-{i}\n" for i in range(n + s)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        raw = spark.read.csv(str(tmp_path / "*.csv"), header=True)
        assert raw.rdd.getNumPartitions() > 20
        got = files.read_wide_csv(spark, str(tmp_path / "S*.csv"), ["AF4", "AF3"])
        rows = got.collect()
        some = files.read_wide_csv(spark, str(tmp_path), ["AF3"], subjects=[2, 13, 40])
        assert {r.subject_id: r["count"] for r in some.groupBy("subject_id").count().collect()} == {2: n + 2, 13: n + 13}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert got.columns == ["subject_id", "game", "idx", "AF4", "AF3"] and len(rows) == 3 * n + 16
    assert all(r.game == 2 and r.AF3 == r.subject_id * 1000 + r.idx + 0.5 and r.AF4 == -r.idx for r in rows)


def test_recordings_are_written_a_file_each_by_tasks_and_read_from_one_listing_without_a_shuffle_of_rows(spark, tmp_path):
    size = lambda r: 5000 if r == 7 else 11
    rows = [(r, i, r + i / 7, None if i % 5 else -1e-7 * i) for r in range(1, 121) for i in range(size(r))]
    signal = spark.createDataFrame(rows, "rec long, at int, AF3 double, AF4 double").repartition(5)
    small = {"spark.sql.files.maxPartitionBytes": "40000", "spark.sql.execution.arrow.maxRecordsPerBatch": "100"}
    held = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        files.write_wide_csv(signal, str(tmp_path), "rec", "at", F.col("rec"), F.lit(3), ["AF4", "AF3"])
        (tmp_path / "_left").write_text("what a lost task began")
        assert {p.name for p in tmp_path.glob("*.csv")} == {f"S{r:02d}G3AllChannels.csv" for r in range(1, 121)}
        assert (tmp_path / "S01G3AllChannels.csv").read_text().splitlines()[:3] == ["AF4,AF3", "-0.0,1.0", ",1.1428571428571428"]
        got = files.read_wide_csv(spark, f"{tmp_path}/S*.csv", ["AF3", "AF4"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryFileIndex(1 paths)" in plan and "120 paths" not in plan and "SortMergeJoin" not in plan
        assert sorted((r.subject_id, r.idx, r.AF3, r.AF4) for r in got.collect()) == sorted(rows)
        assert files.read_wide_csv(spark, str(tmp_path), ["AF3"], subjects=[130]).collect() == []
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


@udtf(returnType="sample_id string, channel string, idx int, value double")
class Reversed:
    """A table function: each channel of a sample backwards, plus the seed."""

    def __init__(self):
        self.rows = []

    def eval(self, row, seed):
        self.rows.append((row["sample_id"], row["channel"], row["idx"], row["value"], seed))

    def terminate(self):
        for c in {r[1] for r in self.rows}:
            own = [r for r in self.rows if r[1] == c]
            assert [r[2] for r in own] == sorted(r[2] for r in own)
            for (s, _, i, _, seed), (_, _, _, v, _) in zip(own, own[::-1]):
                yield s, c, i, v + seed


def test_users_own_techniques_meet_their_quotas(spark):
    rng = np.random.default_rng(11)
    made = {(s, c): rng.normal(size=16) for s in range(6) for c in "ab"}
    rows = spark.createDataFrame([(s, c, i, float(v)) for (s, c), x in made.items() for i, v in enumerate(x)], "sample_id long, channel string, idx int, value double")
    labels = spark.createDataFrame([(s, s % 2) for s in range(6)], "sample_id long, label int")
    own = ag.BUILT_IN.with_technique("negated", lambda df, seed: df.withColumn("value", -F.col("value")), 0.5).with_technique("reversed", Reversed, 0.5)
    assert "negated" not in ag.BUILT_IN and own.shares["reversed"] == 0.5 and own.quotas(600)["negated"] == own.quotas(600)["gaussian_noise"]
    values, lineage = ag.augment_dataset(rows, labels, {"negated": 4, "reversed": 5, "time_shift": 2}, 16, seed=3, return_original=False, techniques=own)
    got = {}
    for r in values.orderBy("idx").collect():
        got.setdefault((r.technique, r.draw_no, r.source_id, r.channel), []).append(r.value)
    assert {(t, d) for t, d, *_ in got} == {("negated", k) for k in range(1, 5)} | {("reversed", k) for k in range(1, 6)} | {("time_shift", 1), ("time_shift", 2)}
    for (t, _, s, c), x in got.items():
        if t != "time_shift":
            assert x == pytest.approx(-made[s, c] if t == "negated" else made[s, c][::-1] + 3)
    assert lineage.count() == 11
    with pytest.raises(ValueError):
        ag.BUILT_IN.with_technique("mixup", lambda df, seed: df)


def test_band_jitter_through_the_dataset_matches_a_loop(spark):
    import hashlib

    rng = np.random.default_rng(12)
    made = {(s, c): rng.normal(size=64) for s in range(5) for c in "ab"}
    rows = spark.createDataFrame([(s, c, i, float(v)) for (s, c), x in made.items() for i, v in enumerate(x)], "sample_id long, channel string, idx int, value double")
    labels = spark.createDataFrame([(s, 0) for s in range(5)], "sample_id long, label int")
    values, _ = ag.augment_dataset(rows, labels, {"band_jitter_filter": 6}, 64, return_original=False)
    draw = lambda op, key: int(hashlib.md5(f"1#{op}#{key}#0".encode()).hexdigest()[:13], 16) / 2**52
    got = {}
    for r in values.orderBy("idx").collect():
        got.setdefault((r.draw_no, r.source_id, r.channel), []).append(r.value)
    assert len(got) == 12
    for (k, s, c), x in got.items():
        key = f"band_jitter_filter:{k}"
        move = (1 + draw("edge", key)) * (-1 if draw("edge:sign", key) < 0.5 else 1)
        low, high = max(0.1, 0.5 + move) / 64, min(63.0, 45 + move) / 64
        low = min(max(low, 0.01), 0.99)
        b, a = fl.butterworth(4, low * 64, max(low + 0.01, min(high, 0.99)) * 64, 128.0)
        assert x == pytest.approx(plain_pass(b, a, made[s, c], np.zeros(8)), abs=1e-7)


def test_one_pass_checks_agree_with_the_built_in_ones(spark):
    """The checks of whole samples in one group against amplitude, distribution and kernels as DataFrame operators."""
    rng = np.random.default_rng(13)
    rows = []
    for s in range(12):
        for c in "abc":
            x = rng.normal(size=50)
            y = x + rng.normal(size=50) * (0.05, 0.5, 5)[s % 3] if s % 4 else np.round(x, 1)
            rows += [(s, c, i, float(p), float(q)) for i, (p, q) in enumerate(zip(np.round(x, 2), y))]
    pairs = spark.createDataFrame(rows, "sample_id long, channel string, idx int, a double, b double")
    got = {r.sample_id: r for r in ql.sample_checks(pairs).collect()}
    amplitude = {r.sample_id: r.passed for r in ql.amplitude_check(pairs, ["sample_id"]).collect()}
    sided = pairs.select("sample_id", "channel", "idx", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("a").alias("value")), F.struct(F.lit(2).alias("side"), F.col("b").alias("value")))).alias("e")).select("sample_id", "channel", "idx", "e.*")
    ks = {r.sample_id: r.passed for r in ql.ks_two_sample(sided, ["sample_id"]).collect()}
    vectors = sided.groupBy("sample_id", "side", "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda e: e["value"]).alias("x"))
    mmd = {r.sample_id: r.mmd for r in ql.mmd_rbf(vectors.withColumnsRenamed({"sample_id": "own", "channel": "sample_id"}), by=["own"]).withColumnRenamed("own", "sample_id").collect()}
    assert len({r.distribution for r in got.values()}) == 2
    for s, r in got.items():
        assert (r.amplitude, r.distribution) == (amplitude[s], ks[s]) and r.mmd == pytest.approx(mmd[s], abs=1e-7)


def shuffles(df):
    """How often the plan of ``df`` shuffles, at first."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_wavelets_shuffle_a_signal_once(spark):
    from sigloom import plans

    df = plans.queries()["wavelet_packet"](spark, "/root/testdata/sf0.001")
    assert shuffles(df) == 1
    rows = [(1, "a", w, p, float(v)) for w in range(2) for p, v in enumerate(np.random.default_rng(w).normal(size=64))]
    windows, by = spark.createDataFrame(rows, "recording_id long, channel string, window_id long, pos int, value double"), ["recording_id", "channel", "window_id"]
    slow = {(r.window_id, r.node): (r["mean"], r["std"], r.energy) for r in sp.packet_statistics(sp.wavelet_packet(windows, by, 64), by).collect()}
    assert len(slow) == 32
    for r in sp.window_packets(windows, by, 64).collect():
        assert (r["mean"], r["std"], r.energy) == pytest.approx(slow[r.window_id, r.node], abs=1e-12)


def test_entropy_of_windows_of_other_shapes_and_in_one_shuffle(spark):
    from sigloom import plans

    for name in ("transfer_entropy", "kth_distance", "lagged_ols"):
        plan = plans.queries()[name](spark, "/root/testdata/sf0.001")
        assert shuffles(plan) == 1 and "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().executedPlan().toString()
    rng, size = np.random.default_rng(12), {1: {"a": 40, "b": 40, "c": 33}, 2: {"a": 40, "b": 40}, 3: {"b": 33, "c": 33}, 4: {"a": 20}}
    made = {(w, c): rng.normal(size=n) for w, own in size.items() for c, n in own.items()}
    rows = [(w, c, i, float(v)) for (w, c), x in made.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "w long, channel string, pos int, value double")
    for together in (8, 1):
        got = {(r.w, r.src, r.dst) for r in cn.transfer_entropy(df, ["w"], together=together).collect()}
        assert got == {(w, s, d) for w in (1, 2) for s, d in ("ab", "ba")} | {(3, "b", "c"), (3, "c", "b")}
    got = {(r.w, r.channel, r.t): r.r for r in cn.kth_distance(df, ["w"]).collect()}
    want = {}
    for (w, c), x in made.items():
        points = np.array([[*x[i : i + 21 : 10], x[i + 21]] for i in range(max(0, len(x) - 21))]).reshape(-1, 4)
        for t, p in enumerate(points):
            want[w, c, t] = np.sort(np.sqrt(((points - p) ** 2).sum(1)))[4]
    assert got.keys() == want.keys() and all(got[key] == pytest.approx(want[key], abs=1e-12) for key in want)


def test_channel_pairs_and_normalizers_leave_rows_where_they_are(spark):
    from sigloom import plans

    assert shuffles(plans.queries()["correlation_matrix"](spark, "/root/testdata/sf0.001")) == 1
    assert shuffles(plans.queries()["fused_image"](spark, "/root/testdata/sf0.001")) == 1
    plan = plans.queries()["apply_normalizer"](spark, "/root/testdata/sf0.001")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert shuffles(plan) == 1 and "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_a_feature_vector_moves_windows_not_values(spark):
    from sigloom import plans

    # One shuffle of the table for each of its branches, and those of joins of rows of whole windows.
    text = plans.queries()["feature_vector"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in text and "node" not in "".join(line for line in text.split("\n") if "Exchange hashpartitioning" in line)


def test_feature_vectors_are_those_of_their_parts_and_need_one_shuffle(spark):
    from sigloom import plans
    from sigloom.operators import statistics as st
    from sigloom.operators import vectors as vc

    plan = plans.queries()["feature_vector"](spark, "/root/testdata/sf0.001")
    assert shuffles(plan) == 1 and "Join" not in plan._jdf.queryExecution().executedPlan().toString()
    rng = np.random.default_rng(14)
    made = {(k, c): rng.normal(size=n).cumsum().tolist() for k, n in enumerate((130, 64, 63)) for c in "ab"}
    made[0, "b"][:64] = [0.1] * 64
    made[0, "a"][5:9] = [None] * 4
    made[1, "b"] = [None] * 64
    made[1, "a"] = [None if i not in (3, 40) else float(i) for i in range(64)]
    rows = [(k, i, made[k, "a"][i], made[k, "b"][i], len(made[k, "a"])) for k in range(3) for i in range(len(made[k, "a"]))]
    wide = spark.createDataFrame(rows, "recording_id long, idx int, a double, b double, n int").repartition(5)
    got = vc.feature_vectors(vc.channel_windows(wide, ["recording_id"], ["a", "b"], 64, "n"), ["recording_id", "window_id"], ["a", "b"], 64, 128.0)
    w = wn.tumbling_windows(wide.unpivot(["recording_id", "idx", "n"], ["a", "b"], "channel", "value"), 64, "n").withColumn("window_id", F.col("window_id").cast("long"))
    by = ["recording_id", "window_id", "channel"]
    density = sp.periodogram(w, by, 64, 128.0)
    want = st.feature_vector(st.stat_features(w, by), st.hjorth(w, by, "pos"), sp.spectral_entropy(density, by), sp.band_power(density, by, 2.0), sp.window_packets(w, by, 64), by)
    told = lambda df: {tuple(r[c] for c in by): r.x for r in df.collect()}
    got, want = told(got), told(want)
    assert got.keys() == want.keys() and len(got) == 6
    for key, x in want.items():
        assert len(x) == len(got[key]) == 63
        assert all((p is None) == (q is None) and (p is None or p == pytest.approx(q, rel=1e-9, abs=1e-9)) for p, q in zip(got[key], x)), (key, got[key], x)


def test_masked_spectra_are_made_and_inverted_in_one_place(spark):
    from sigloom import plans

    assert shuffles(plans.queries()["tf_mask_augment"](spark, "/root/testdata/sf0.001")) == 1
    rng = np.random.default_rng(15)
    made = {(k, c): rng.normal(size=n) for k, n in enumerate((300, 64, 33, 1, 127, 128)) for c in "ab"}
    df = long(spark, made)
    spec = sp.tf_mask(sp.stft(df, 16, 8), (F.lit(2), F.lit(3)), (F.lit(1), F.lit(4)))
    want = rows_by(sp.istft(spec, 16, 8).join(df.select("recording_id", "channel", "idx"), ["recording_id", "channel", "idx"]))
    for chunk in (64, 2):
        got = rows_by(sp.stft_masked(df, lambda n: [F.when(n > 0, 2), F.lit(2), F.lit(1), F.lit(4)], 16, 8, chunk=chunk))
        assert got.keys() == want.keys() and all(np.allclose(got[key], want[key], atol=1e-12) for key in want)


def test_a_signal_is_inverted_where_its_spectra_are(spark):
    from sigloom import plans

    assert shuffles(plans.queries()["istft"](spark, "/root/testdata/sf0.001")) == 1
    rng = np.random.default_rng(16)
    made = {(k, c): rng.normal(size=n) for k, n in enumerate((300, 64, 33, 1, 127, 128)) for c in "ab"}
    df = long(spark, made).withColumn("value", F.when(F.col("idx") != 5, F.col("value")))
    want = rows_by(sp.istft(sp.stft(df, 16, 8), 16, 8).join(df.select("recording_id", "channel", "idx"), ["recording_id", "channel", "idx"]))
    for chunk in (64, 2):
        got = rows_by(sp.stft_inverted(df, 16, 8, chunk=chunk))
        assert got.keys() == want.keys() and all(np.allclose(got[key], want[key], atol=1e-12) for key in want)
    assert all(np.allclose(got[key], np.where(np.arange(len(x)) == 5, 0, x), atol=1e-9) for key, x in made.items())


def test_groups_and_samples_travel_as_rows(spark):
    from sigloom import plans
    from sigloom.plans import augmentation as pa_

    # Samples are told from the lengths of recordings: no signal is numbered or exploded for their labels.
    text = pa_.fixed_labels(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "l_discount" not in text
    assert plans.queries()["technique_counts"](spark, "/root/testdata/sf0.001").count() == 10
    rows = spark.createDataFrame([(s, c, i, float(100 * s + i)) for s in (1, 2, 3) for c in "ab" for i in range(4) if (s, c) != (3, "b")], "sample_id long, channel string, idx int, value double")
    pairs = spark.createDataFrame([(0, 1, 2), (1, 3, 1), (2, 2, 2)], "draw long, first long, second long")
    got = {(r.draw, r.channel, r.idx): (r.a, r.b) for r in ag.pairs_of(ag.gathered(rows), pairs).collect()}
    want = {(d, c, i): (100.0 * p + i, 100.0 * q + i) for d, p, q in ((0, 1, 2), (1, 3, 1), (2, 2, 2)) for c in "ab" for i in range(4) if not (p == 3 and c == "b")}
    assert got == want


def test_samples_are_dealt_out_once_for_all_techniques(spark):
    rng = np.random.default_rng(17)
    rows = spark.createDataFrame([(s, c, i, float(v)) for s in range(8) for c in "ab" for i, v in enumerate(rng.normal(size=64))], "sample_id long, channel string, idx int, value double")
    labels = spark.createDataFrame([(s, s % 2) for s in range(8)], "sample_id long, label int")
    values, _ = ag.augment_dataset(rows, labels, dict.fromkeys(ag.SHARES, 3), 64)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # with it, what is reused is found as the plan runs
    try:
        text = values.groupBy("technique").agg(F.sum("value"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    dealt = [line for line in text.split("\n") if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    keys = [re.search(r"hashpartitioning\((\w+?)#", line).group(1) for line in dealt]
    # Six techniques' draws, both ends of pairs, the samples, and the sums; the filter's blocks are in a scratch table.
    assert sorted(keys) == ["first", "sample_id", "second", *["source_id"] * 6, "technique"]


def test_filtered_samples_keep_further_columns(spark):
    made = {(k, c): np.random.default_rng(k).normal(size=n) for k, n in enumerate((5000, 70)) for c in "ab"}
    rows = long(spark, made).withColumnRenamed("recording_id", "sample_id")
    plain = {(r.sample_id, r.channel, r.idx): r.value for r in ag.band_jitter_filter(rows).collect()}
    more = ag.band_jitter_filter(rows.withColumns({"source_id": F.col("sample_id") * 7, "tag": F.concat(F.lit("t"), "sample_id")}))
    assert not any("Join" in line and "idx" in line for line in more._jdf.queryExecution().executedPlan().toString().split("\n"))
    got = {(r.sample_id, r.channel, r.idx): (r.value, r.source_id, r.tag) for r in more.collect()}
    assert got.keys() == plain.keys() and all(v == (pytest.approx(plain[key], abs=1e-12), key[0] * 7, f"t{key[0]}") for key, v in got.items())


def test_visits_in_rounds_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(18)
    x = rng.normal(size=(900, 16))  # no bound tells these apart
    df = spark.createDataFrame([(k, str(k % 2), [float(v) for v in r]) for k, r in enumerate(x)], "sample_id long, label string, x array<double>")
    seen = []

    def table(d):
        out = rg.table(d)
        seen.extend([out.count()] if out.columns == ["label", "block", "id", "x", "bound"] else [])
        return out

    monkeypatch.setattr(nb, "table", table)
    got = nb.knn_same_class(df, 3, cell=10, pivots=200, most=100, room=1500).collect()
    assert {(r.sample_id, r["rank"]): r.neighbour for r in got} == knn_plain([(k, k % 2, v) for k, v in enumerate(x)], 3)
    assert len(seen) > 2 and max(seen) <= 1500 < sum(seen)
    assert nb._rounds([("a", 0, 10), ("b", 0, 250), ("a", 1, 30)], {("a", 0): 5, ("a", 1): 5, ("b", 0): 100}, 100, 60) == [[("a", 0, 1), ("a", 1, 1)], [("b", 0, 3)]]


def test_slices_are_drawn_once_a_sample(spark):
    rows = spark.createDataFrame([(s, c, i, float(i)) for s in range(5) for c in "ab" for i in range(s == 4, 50)], "sample_id long, channel string, idx int, value double")
    cut = ag.window_slice(rows)
    # The draws stand under the window as well, where but one place of a sample makes them.
    inner = [line for line in cut._jdf.queryExecution().optimizedPlan().toString().split("\n") if "md5" in line]
    assert len(inner) >= 2 and any("= 0)" in line for line in inner)
    got = {}
    for r in cut.collect():
        got.setdefault((r.sample_id, r.channel), []).append((r.idx, r.value))
    assert len(got) == 10
    for (s, _), own in got.items():
        own.sort()
        assert 39 <= len(own) <= 47 and len({v - i for i, v in own}) == 1 and (s == 4 or own[0][0] == 0)
        assert sorted(got[s, "a"]) == sorted(got[s, "b"])


def test_shifts_are_drawn_once_a_sample(spark):
    rows = spark.createDataFrame([(s, c, i, float(i)) for s in range(4) for c in "ab" for i in range(s == 3, 20)], "sample_id long, channel string, idx int, value double")
    for op, made in (("shift", ag.time_shift(rows)), ("rate", ag.channel_dropout(rows, fill="mean"))):
        lines = [line for line in made._jdf.queryExecution().optimizedPlan().toString().split("\n") if op in line and "md5" in line]
        assert any("= 0)" in line for line in lines), op
    sign = F.when(ag.uniform(1, "sign", F.col("sample_id")) < 0.5, -1).otherwise(1)
    want = {r.sample_id: r.t for r in rows.select("sample_id", (20 * ag.between(1, "shift", F.col("sample_id"), 0.05, 0.2) * sign).cast("int").alias("t")).distinct().collect()}
    got = ag.time_shift(rows).collect()
    assert len(got) == 158 and all(r.idx == (int(r.value) + want[r.sample_id]) % 20 for r in got)


def test_noise_levels_are_drawn_once_a_sample(spark):
    rows = spark.createDataFrame([(s, c, i, float(i)) for s in range(3) for c in "ab" for i in range(s == 2, 20)], "sample_id long, channel string, idx int, value double")
    noisy = ag.gaussian_noise(rows)
    assert any("level" in line and "= 0)" in line for line in noisy._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    level = ag.between(1, "level", F.col("sample_id"), 0.001, 0.05)
    plain = rows.withColumn("want", F.col("value") + ag.normal(1, "noise", F.concat_ws(":", "sample_id", "channel", "idx")) * F.stddev_pop("value").over(ag.per_sample()) * level)
    both = noisy.join(plain.drop("value"), ["sample_id", "channel", "idx"])
    assert both.count() == 118 and both.where(F.abs(F.col("value") - F.col("want")) > 1e-12).isEmpty()


def test_resampling_sorts_no_exploded_series(spark):
    from sigloom.plans import queries

    ready = queries()["resample_linear"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert ready.count("Sort [") == 1
    rows = [(r, c, i, float(i * i + r)) for r, n in ((1, 1), (2, 2), (3, 300), (4, 7)) for c in "ab" for i in range(n)]
    own = W.partitionBy("recording_id", "channel")
    df = spark.createDataFrame(rows, SIGNAL)
    told = df.withColumns({"_l": F.count("*").over(own).cast("int"), "_f": F.lead("value").over(own.orderBy("idx"))})
    as_rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert as_rows(rs.resample_linear(told, 16, "_l", "_f")) == as_rows(rs.resample_linear(df, 16))


def test_jittered_rows_without_more_columns_are_not_joined_back(spark):
    rng = np.random.default_rng(4)
    rows = long(spark, {(k, c): rng.normal(size=60) for k in (1, 2) for c in "abc"}).withColumnRenamed("recording_id", "sample_id")
    got = ag.band_jitter_filter(rows)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    more = ag.band_jitter_filter(rows.withColumn("draw", F.concat(F.lit("d"), "sample_id")))
    as_rows = lambda d: sorted(tuple(r) for r in d.select("sample_id", "channel", "idx", "value").collect())
    assert more.columns == ["sample_id", "channel", "idx", "value", "draw"] and as_rows(more) == as_rows(got) and len(as_rows(got)) == 360
