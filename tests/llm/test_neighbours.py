import numpy as np
from pyspark.sql import functions as F

from sigloom.llm import neighbours


def found(df, **options):
    got = {}
    rows = neighbours.nearest(neighbours.usable(df, "vec_id", "embedding"), F.col("id") % 20 == 0, **options)
    for r in rows.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return got


def vectors(seed=6, n=1500, d=24):
    rng = np.random.default_rng(seed)
    x = np.float32(rng.normal(size=(n, d)) * rng.uniform(0.5, 2, size=(n, 1)))
    x[700:760] = x[40]
    return x


def recall(got, x, k=20):
    v, hits = x.astype(float), 0
    for q, rows in got.items():
        s = v @ v[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(v)), -np.round(s, 12)))[:k]
        assert [r for r, _, _ in rows] == list(range(1, k + 1)) and all(abs(s[i] - z) < 1e-9 for _, i, z in rows)
        assert [z for _, _, z in rows] == sorted((z for _, _, z in rows), reverse=True)
        hits += len({i for _, i, _ in rows} & set(best.tolist()))
    return hits / (k * len(got))


def test_recall_scores_and_odd_vectors(spark):
    x = vectors()
    rows = [(i, [float(v) for v in r], 0.0) for i, r in enumerate(x)]
    rows += [(2000, None, 0.0), (2020, [0.0] * 24, 0.0), (2040, [float("nan")] * 24, 0.0), (2060, [float("inf")] + [1.0] * 23, 0.0), (2080, [1.0], 0.0), (2100, [None] + [1.0] * 23, 0.0), (None, [1.0] * 24, 0.0), rows[3], rows[40]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    got = {q: [tuple(r) for r in rows] for q, rows in found(df).items()}
    assert sorted(got) == list(range(0, 1500, 20)) and recall(got, x) >= 0.9
    copies = [i for _, i, _ in got[40] if 700 <= i < 760]  # ties go to the smaller id
    assert copies == list(range(700, 716))
    assert sorted((r.query_id, r.rank, r.vec_id) for r in neighbours.neighbour_report(df).collect()) == sorted((q, a, b) for q, rows in got.items() for a, b, _ in rows)


def test_many_shards_and_blocks(spark):
    x = vectors(seed=8, n=1600)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    one, many = found(df), found(df, shard=400, block=40)
    assert recall(many, x) >= 0.9 and abs(recall(many, x) - recall(one, x)) < 0.05


def test_probes_find_every_code_within_the_radius_and_stop_early():
    rng = np.random.default_rng(7)
    have = rng.integers(0, 65536, (5000, 8)).astype(np.uint16)
    have[:50] = have[0] ^ rng.integers(0, 3, (50, 8)).astype(np.uint16)
    index, far = neighbours.Index(have), np.bitwise_count(have ^ have[0]).sum(1)
    for want in (1, 10, 50, 51, 400, 5000, 9000):
        rows, d, radius = index.nearest(have[0], want)
        reach = np.sort(far)[min(want, 5000) - 1]
        assert sorted(rows.tolist()) == np.flatnonzero(far <= reach).tolist() and (d == far[rows]).all()
        assert want > 50 or radius <= 2  # near codes: a few buckets were probed, and the others never
    assert len(index.probe(have[0], 0)) < 8 * 60


def test_small_odd_and_large_components(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (21, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert {q: [i for _, i, _ in rows] for q, rows in found(df).items()} == {0: [20, 21], 20: [0, 21]} or {q: [i for _, i, _ in rows] for q, rows in found(df).items()} == {0: [20, 21], 20: [21, 0]}
    assert found(df.limit(0)) == {} and neighbours.neighbour_report(df.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [1e200, 1.0]), (20, [1e200, -1e200]), (21, [1e308, 1e308]), (22, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {q: [(i, z) for _, i, z in rows] for q, rows in found(big).items()}
    assert got[0] == [(20, float("inf")), (21, float("inf")), (22, 1e200)] and [i for i, _ in got[20]][:1] == [0] and len(got[20]) == 3


def test_shards_asked_again_give_what_one_shard_gives(spark, monkeypatch):
    """Codes crowd in one shard for some queries, and a first answer without a margin is too short: the second is exact."""
    rng = np.random.default_rng(9)
    have = rng.integers(0, 65536, (3_000, 4)).astype(np.uint16)
    have[:400] = have[0] ^ rng.integers(0, 4, (400, 4)).astype(np.uint16)
    df = spark.createDataFrame([(k, bytearray(c.tobytes()), bytearray(c.tobytes()) if k % 30 == 0 else None) for k, c in enumerate(have)], "id long, code binary, ask binary").repartition(3)
    monkeypatch.setattr(neighbours, "MARGIN", 0.0)
    one, many = ({(r.query_id, r.vec_id) for r in neighbours.candidates(df, 40, shard=size, block=30).collect()} for size in (5_000, 300))
    assert one == many and len({q for q, _ in one}) == 100
    for q in (0, 30, 600):
        far = np.bitwise_count(have ^ have[q]).sum(1)
        assert {v for a, v in one if a == q} == set(np.flatnonzero(far <= np.sort(far)[39]).tolist())
