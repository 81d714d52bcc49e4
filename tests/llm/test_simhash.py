import random
import re

import numpy as np

from sigloom.llm import simhash
from sigloom.llm.common import components, ranks


def plain(text, shingle=3):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + shingle]).encode(), 42) for k in range(max(1, len(words) - shingle + 1))] if words else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints():
    for t in [None, "", " \t", "One", "a b", "A\x0bb\x1cc d", "ÀÉ x y z", "é e f g", " ".join(map(str, range(5000)))]:
        assert simhash.fingerprint(t) == plain(t)


def test_links_match_brute_force_in_small_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 8)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    near = base[:120] ^ np.uint64(5)
    chain = [np.uint64(2**63 - 1)]
    for k in range(40):
        chain.append(chain[-1] ^ np.uint64(3 << k))
    fps = np.unique(np.concatenate((base, near, np.array(chain, np.uint64), np.array([0, 1], np.uint64))))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash.fingerprint_links(df, 2, sample=100, shard=16)  # most of the tree grows in the shards
    roots = {r.node: r.root for r in components(links).collect()}
    seen = []
    grow = simhash.grow
    monkeypatch.setattr(simhash, "grow", lambda points, depth, seed=1: seen.append(len(points)) or grow(points, depth, seed))
    monkeypatch.setattr(simhash, "LEAST", 4)
    deeper = simhash.fingerprint_links(df, 2, sample=30, shard=4, most=40, rounds=3)  # shards are dealt again and again
    assert {r.node: r.root for r in components(deeper).collect()} == roots and len(seen) > 4
    up = {int(x): int(x) for x in fps.view(np.int64)}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    signed = fps.view(np.int64)
    for k in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[k + 1 :] ^ fps[k]) <= 2):
            a, b = find(int(signed[k])), find(int(signed[k + 1 + j]))
            up[max(a, b)] = min(a, b)
    assert all(roots.get(x, x) == find(x) for x in up)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(5, text), (3, text.upper()), (9, None), (8, ""), (7, " \n"), (1, "something else entirely here"), (1, "something else entirely here"), (None, text + " but different words follow now and then")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = simhash.simhash_report(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component_id for r in got}
    assert by[5] == 3 and by[9] == by[8] == by[7] == 7 and by[1] == 1
    assert simhash.simhash_report(df.limit(0)).count() == 0


def test_ids_stay_exact_beside_nulls(spark):
    big = 9007199254740993
    rows = [(None, "one two three four"), (big, "one two three four"), (big + 2, "five six seven eight"), (big + 2, "five six seven eight")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in simhash.simhash_report(df).collect())
    assert got == [(False, big, big), (False, big + 2, big + 2), (False, big + 2, big + 2), (True, None, big)]


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join("w%d" % (k % 97) for k in range(1000))
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "WORDS_AT_ONCE", 64)
    assert simhash.fingerprint(text) == want == plain(text) and simhash.fingerprint("a b") == plain("a b")


def test_hot_fingerprints_are_joined_apart(spark):
    """A third of all rows with one fingerprint: its rows are not shuffled by it."""
    rows = [(k, "the same words again") for k in range(700)] + [(1000 + k, f"text number w{k} of w{k * 7} many") for k in range(1400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.simhash_report(df).collect()}
    assert len(got) == len(rows) and {got[k] for k in range(700)} == {0}


def test_ranks_are_whole(spark):
    df = spark.createDataFrame([(k % 3, k // 2) for k in range(1000)], "g int, v long")
    got = ranks(df, ["g"], ["v"], "r", parts=7).collect()
    for g in range(3):
        own = sorted(r.r for r in got if r.g == g)
        assert own == list(range(len(own)))


def test_shards_stay_bounded_as_fingerprints_grow(spark, monkeypatch):
    """With a small first sample a single tree leaves thousands in a shard; dealt again, none holds more than a few hundred."""
    monkeypatch.setattr(simhash, "AGAIN", 400)
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(int(x),) for x in np.unique(rng.integers(0, 2**63, 12_000)).astype(np.int64)], "fp long").repartition(4)
    largest = lambda **more: max(r.n for r in spread(**more).collect())

    def spread(**more):
        from pyspark.sql import functions as F

        held = []
        monkeypatch.setattr(simhash, "_dealt", lambda *a, f=dealt: held.append(f(*a)) or held[-1])
        simhash.fingerprint_links(df, 2, sample=64, shard=128, **more)
        return held[-1].groupBy("shard").agg(F.count("fp").alias("n"))

    dealt = simhash._dealt
    once, again = largest(rounds=0), largest(most=800, rounds=3)
    assert once > 3_000 and again < 1_500
