import zlib

import pytest
from pyspark.sql import functions as F

from sigloom.llm import sharding


def test_rows(spark):
    rows = [(k, "é" * (k % 97)) for k in range(3000)] + [(5000, None), (5001, ""), (5001, ""), (None, "n")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, slot int")
    got = sharding.shard_documents(df, 8, 1024).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    size = {}
    for s in {r.shard for r in got}:
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        size[s] = sum(r.size for r in own)
    assert sorted(size) == list(range(8)) and max(size.values()) - min(size.values()) <= 0.02 * sum(size.values()) / 8
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    known = df.where("doc_id IS NOT NULL")
    one, two = (sorted(map(tuple, sharding.shard_documents(x, 8, 1024).collect())) for x in (known, known.repartition(7)))
    assert one == two and {r.map_version for r in got} == {1}
    assert sharding.shard_documents(df.limit(0), 8).count() == 0


def test_slots_match_brute_force(spark):
    """Places within a slot are by id; a slot's first place follows the slots before it in its shard."""
    df = spark.createDataFrame([(k, "t" * (k % 13)) for k in range(500)], "doc_id long, text string")
    got = sharding.shard_documents(df, 4, 64).collect()
    owner, at, want = {r.virtual_slot: r.shard for r in got}, dict.fromkeys(range(4), 0), {}
    assert len(got) == len({(r.shard, r.slot) for r in got}) == 500
    for s in sorted(owner):
        for r in sorted((r for r in got if r.virtual_slot == s), key=lambda r: r.doc_id):
            assert r.shard == owner[s]
            want[r.doc_id] = at[owner[s]]
            at[owner[s]] += 1
    assert {r.doc_id: r.slot for r in got} == want


def test_null_ids_are_dealt_among_all_slots(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.shard_documents(df, 8, 256).collect()
    assert len({r.virtual_slot for r in got}) > 200 and len({(r.shard, r.slot) for r in got}) == 4000


def test_the_map_lasts_and_is_edited_as_bytes_move(spark, tmp_path):
    path = str(tmp_path / "map")
    small = spark.createDataFrame([(k, "x" * (k % 50)) for k in range(2000)], "doc_id long, text string")
    run = lambda df, shards: {r.virtual_slot: (r.shard, r.map_version) for r in sharding.shard_documents(df, shards, 256, path).collect()}
    first, again = run(small, 4), run(small, 4)
    assert first == again and {v for _, v in first.values()} == {1}
    more = run(small.unionByName(spark.createDataFrame([(k, "y" * 300) for k in range(5000, 5100)], "doc_id long, text string")), 5)
    assert {v for _, v in more.values()} == {2} and {s for s, _ in more.values()} == set(range(5))
    moved = [s for s in first if first[s][0] != more[s][0]]
    assert 0 < len(moved) < len(first) / 2
    held = {v: {r.slot: r.shard for r in sharding.load_map(spark, path, v).collect()} for v in (0, 1, 2)}
    assert held[0] == {s: s % 4 for s in range(256)} and all(held[1][s] == k for s, (k, _) in first.items()) and len(held[2]) == 256
    with pytest.raises(ValueError):
        sharding.shard_documents(small, 4, 128, path)


def test_maps_are_versioned_and_rebalancing_moves_whole_slots(spark, tmp_path):
    loads = [(s, 100 + s % 7, 1) for s in range(500)]
    first = sharding.rebalance({s: s % 5 for s in range(500)}, loads, 5)
    more = sharding.rebalance(first, loads, 6)
    held = {k: sum(b for s, b, _ in loads if more[s] == k) for k in range(6)}
    assert max(held.values()) - min(held.values()) < 0.05 * sum(held.values()) / 6
    moved = [s for s in first if first[s] != more[s]]
    assert len(moved) < 0.3 * len(first) and sum(more[s] == 5 for s in moved) > 0.6 * len(moved)
    fewer = sharding.rebalance(first, loads, 4)
    assert set(fewer.values()) == {0, 1, 2, 3} and sum(fewer[s] != first[s] for s in first if first[s] < 4) < 20
    path = str(tmp_path / "map")
    assert sharding.save_map(sharding.map_table(spark, first, loads, 1), path, 1)
    assert sharding.save_map(sharding.map_table(spark, more, loads, 2), path, 2)
    assert {r.slot: r.shard for r in sharding.load_map(spark, path).collect()} == more
    assert {r.slot: r.shard for r in sharding.load_map(spark, path, 1).collect()} == first


def test_a_version_is_published_once_and_whole(spark, tmp_path):
    path, loads = str(tmp_path / "map"), [(s, 10, 1) for s in range(64)]
    one, two = {s: s % 4 for s in range(64)}, {s: s % 3 for s in range(64)}
    assert sharding.save_map(sharding.map_table(spark, one, loads, 0), path, 0)
    assert not sharding.save_map(sharding.map_table(spark, two, loads, 0), path, 0)
    assert sharding.owners_of(spark, path, None, 64) == (0, one) and sharding.versions(spark, path) == [0]
    half = sharding.map_table(spark, one, loads, 1).where("slot < 32")
    assert sharding.save_map(half, path, 1)
    with pytest.raises(ValueError):
        sharding.owners_of(spark, path, 1, 64)
    with pytest.raises(ValueError):
        sharding.load_map(spark, path, 7)


def test_two_runs_at_once_share_one_map(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "map")
    df = spark.createDataFrame([(k, "x" * (k % 50)) for k in range(2000)], "doc_id long, text string")
    with ThreadPoolExecutor(3) as pool:
        runs = list(pool.map(lambda _: sorted(map(tuple, sharding.shard_documents(df, 4, 256, path).collect())), range(3)))
    assert runs[0] == runs[1] == runs[2] and sharding.versions(spark, path) == [0, 1]


def test_a_named_version_holds_and_the_query_repeats(spark, tmp_path):
    from sigloom.llm.queries import op9_sharding

    path = str(tmp_path / "map")
    df = spark.createDataFrame([(k, "x" * (k % 50)) for k in range(2000)], "doc_id long, text string")
    run = lambda rows, **more: sorted(map(tuple, sharding.shard_documents(rows, 4, 256, path, **more).collect()))
    first = run(df)
    assert run(df.where("doc_id % 2 = 0 AND doc_id < 900")) and sharding.versions(spark, path)[-1] > 1
    assert run(df, version=1) == first
    with pytest.raises(ValueError):
        sharding.shard_documents(df, 3, 256, path, version=1)
    with pytest.raises(ValueError):
        sharding.shard_documents(df, 4, 256, path, version=99)
    data = "/root/testdata/sf0.001"
    one, two = (sorted(map(tuple, op9_sharding(spark, data).collect())) for _ in range(2))
    assert one == two


def test_a_hot_id_is_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 10)
    df = spark.createDataFrame([(7, "same")] * 900 + [(k, "t") for k in range(1000, 1600)], "doc_id long, text string")
    got = sharding.shard_documents(df, 4, 64).collect()
    assert len(got) == 1500
    for s in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
