"""SimHash near-duplicates: fingerprints of word shingles, linked exactly through a vantage-point tree of shards.

The tree is grown on the driver from a bounded sample of fingerprints: a node holds a vantage point and a radius,
and sends a fingerprint inside or outside by its Hamming distance. A fingerprint has one home shard; as a query it
also visits every shard that the triangle bound cannot rule out, so each pair within the radius meets in the home
shard of one of its two. A shard grows the tree on from its own points. Only distinct fingerprints travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import components, join_counted, map_slices, small_batches
from sigloom.scratch import mark, release, table

#: Fingerprints in the sample that the tree is grown from, those of it that each leaf should have at least, fingerprints
#: a shard should hold, and fingerprints of a shard that are compared without growing the tree on.
SAMPLE, LEAST, SHARD, LEAF = 20_000, 16, 2_048, 512
#: Fingerprints, visitors among them, from which a shard is dealt again, sampled ones of each such shard, and times that
#: this is done at most: after two, some ten million shards.
MOST, AGAIN, ROUNDS = 65_536, 2_048, 2
#: Words hashed at once: what a long text holds besides itself.
WORDS_AT_ONCE = 65_536


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Unsigned XXH64 hashes of the lower-cased (A-Z) text's word shingles in turn, repeats included, in arrays of bounded
    size; a text of fewer words is one shingle; a text without words has none."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: splits at space and 0x09 to 0x0D
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    for at in range(0, n if words else 0, WORDS_AT_ONCE):
        some = words[at : min(at + WORDS_AT_ONCE, n) + shingle - 1]
        line = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: min(WORDS_AT_ONCE, n - at)]
        last = ends[min(shingle, len(some)) - 1 :]
        yield np.fromiter((digest(line[a:b], 42) for a, b in zip(starts.tolist(), last.tolist())), np.uint64, len(starts))


def simhash(hashes: Iterator[np.ndarray]) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if it is set in over half the hashes; of none: 0."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    return simhash(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_key, fp): fp the fingerprint as a signed long, text_key a hash of the text. Null and empty texts give 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], ["doc_id", "text_key", "fp"])

    return map_slices(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text"), run, "doc_id long, text_key long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def vantage(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int]:
    """Of some of the points, the one whose distances spread most, and their median."""
    tried = rng.choice(points, min(16, len(points)), replace=False)
    some = points if len(points) <= 2048 else rng.choice(points, 2048, replace=False)
    d = [distance(some, v) for v in tried]
    best = int(np.argmax([x.std() for x in d]))
    return tried[best], int(np.median(d[best]))


def grow(sample: np.ndarray, depth: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """A heap of vantage points and radii. ``depth`` is at most what leaves each leaf ``LEAST`` sampled points on average."""
    rng = np.random.default_rng(seed)
    depth = max(0, min(depth, int(np.log2(max(1, len(sample) / LEAST)))))
    points, radii, sets = [], [], [sample]
    for _ in range(depth):
        below = []
        for part in sets:
            v, radius = vantage(part if len(part) else sample, rng)
            points.append(v)
            radii.append(radius)
            d = distance(part, v)
            below += [part[d <= radius], part[d > radius]]
        sets = below
    return np.array(points, np.uint64), np.array(radii, np.int16)


def shards(fp: np.ndarray, nodes: tuple[np.ndarray, np.ndarray], within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``fp``, shard, whether it is its home) for every shard a fingerprint must visit."""
    row, at, home = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
    points, radii = nodes
    levels = (len(points) + 1).bit_length() - 1
    for _ in range(levels):
        d, r = distance(fp[row], points[at]), radii[at]
        inner, outer = d - within <= r, d + within > r
        inside = d <= r
        row = np.concatenate((row[inner], row[outer]))
        at, home = np.concatenate((2 * at[inner] + 1, 2 * at[outer] + 2)), np.concatenate((home[inner] & inside[inner], home[outer] & ~inside[outer]))
    return row, at, home


class Sets:
    """Disjoint sets over 0..n-1; a set's label is its smallest member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up


def links_in_shard(fp: np.ndarray, home: np.ndarray, within: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Links that span each connected set of the shard, no more of them than fingerprints.

    The tree grows on inside: own points part at a vantage point, visitors go wherever the triangle bound lets them, and
    few points or points that no longer part are compared.
    """
    sets, rng, todo = Sets(len(fp)), np.random.default_rng(1), [(np.arange(len(fp)), np.flatnonzero(home))]
    while todo:
        asks, own = todo.pop()
        if not len(own):
            continue
        if len(own) > leaf:
            v, radius = vantage(fp[own], rng)
            d = distance(fp[own], v)
            inside = own[d <= radius]
            if 0 < len(inside) < len(own):
                far = distance(fp[asks], v)
                todo += [(asks[far - within <= radius], inside), (asks[far + within > radius], own[d > radius])]
                continue
        for k in range(0, len(own), leaf):
            near = own[k : k + leaf]
            for lo in range(0, len(asks), 4096):
                some = asks[lo : lo + 4096]
                x, y = np.nonzero(np.bitwise_count(fp[some][:, None] ^ fp[near][None, :]) <= within)
                sets.link(some[x], near[y])
    moved = np.flatnonzero(sets.label != np.arange(len(fp)))
    return fp[moved], fp[sets.label[moved]]


def _dealt(rows: DataFrame, trees: dict[int | None, tuple[np.ndarray, np.ndarray]], within: int, last: int) -> DataFrame:
    """``rows`` (shard, fp, home) sent on by the tree of their shard: a home has one new home, a visitor none. ``last`` is more
    than any place in a tree. Shards without a tree stay."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shard = pdf["shard"].to_numpy()
            for own, places in pdf.groupby("shard", sort=False).indices.items():
                fp, home = pdf["fp"].to_numpy()[places], pdf["home"].to_numpy()[places]
                if int(own) not in trees:
                    yield pd.DataFrame({"shard": shard[places], "fp": fp, "home": home})
                    continue
                row, at, mine = shards(fp.view(np.uint64), trees[int(own)], within)
                yield pd.DataFrame({"shard": (int(own) + 1) * last + at, "fp": fp[row], "home": home[row] & mine})

    return rows.mapInPandas(deal, "shard long, fp long, home boolean")


def _largest(points: np.ndarray, trees: dict, place: dict[int, np.ndarray], within: int) -> dict[tuple[int, int], int]:
    """Of the sampled ``place``s of each shard, how many its tree sends to each of its leaves, visitors among them."""
    found = {}
    for own, tree in trees.items():
        _, at, _ = shards(points[place[own]], tree, within)
        for leaf, n in zip(*np.unique(at, return_counts=True)):
            found[own, int(leaf)] = int(n)
    return found


def fingerprint_links(distinct: DataFrame, within: int = 2, sample: int = SAMPLE, shard: int = SHARD, most: int = MOST, rounds: int = ROUNDS) -> DataFrame:
    """(a, b): links among distinct fingerprints ``fp``, with the same connected sets as all pairs within ``within`` bits.

    A sample bounds how deep a tree can grow. Where it says that a shard will hold more than ``most`` fingerprints, these are
    dealt once more, each such shard by a tree grown from a sample of its own, and so on for ``rounds``: a task's group
    stays bounded as fingerprints grow in number.
    """
    n = distinct.count()
    held = distinct.orderBy(F.xxhash64("fp")).limit(sample)
    points = np.array([r.fp for r in held.collect()], np.int64).view(np.uint64)  # ``sample`` rows at most
    trees = {0: grow(points, int(np.ceil(np.log2(max(1, n / shard)))))}
    last = 1 << 15
    dealt = _dealt(distinct.select(F.lit(0).cast("long").alias("shard"), "fp", F.lit(True).alias("home")), trees, within, last)
    expected = {(own + 1) * last + leaf: k * n / max(1, len(points)) for (own, leaf), k in _largest(points, trees, {0: np.arange(len(points))}, within).items()}
    for _ in range(rounds):
        large = {s: k for s, k in expected.items() if k > most}
        if not large:
            break
        dealt = table(dealt)
        chance = min(1.0, AGAIN * len(large) / sum(large.values()))
        drawn = dealt.where("home").where(F.col("shard").isin(*large)).where(F.pmod(F.xxhash64(F.lit(3), "fp"), F.lit(1 << 30)) < int(chance * (1 << 30)))
        rows = drawn.select("shard", "fp").toArrow()  # about ``AGAIN`` for each large shard
        own, points = np.asarray(rows["shard"]), np.asarray(rows["fp"]).view(np.uint64)
        place = {s: np.flatnonzero(own == s) for s in large}
        trees = {s: grow(points[place[s]], int(np.ceil(np.log2(max(1, large[s] / shard))))) for s in large if len(place[s])}
        dealt = _dealt(dealt, trees, within, last)
        expected = {(s + 1) * last + leaf: k * large[s] / len(place[s]) for (s, leaf), k in _largest(points, trees, place, within).items()}

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = links_in_shard(pdf["fp"].to_numpy().view(np.uint64), pdf["home"].to_numpy(), within)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("shard").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, within: int = 2) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id) for each row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable over links of at most ``within`` differing bits, ``root`` the
    smallest fingerprint. Null, empty and wordless texts have fingerprint 0 and are linked like any other; repeated
    rows return as often as they come; null ids never name a component that has another id; other columns are
    ignored; an empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        prints = table(fingerprints(docs, shingle))
    since = mark(docs.sparkSession)
    distinct = table(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = table(components(fingerprint_links(distinct, within)))
    linked = distinct.join(roots, distinct.fp == roots.node).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.join(least, "root").select("fp", "root", "least")
    every = table(distinct.join(named, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component_id")))
    release(docs.sparkSession, since, keep=1)
    return join_counted(prints, every, ["fp"], "n").select("doc_id", "text_key", "fp", "root", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` as in ``near_duplicates``, with its handling of nulls,
    empty texts, ties, repeated rows and clashing names."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
