"""Deterministic augmentation: every technique is a function of (rows, draws) to rows, its randomness keyed by row.

Rows are samples in long form (sample_id, channel, idx, value). Nothing depends on partitioning, so a lost executor
gives the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType
from pyspark.sql.udtf import UserDefinedTableFunction

from sigloom.functions.draws import beta, between, normal, uniform
from sigloom.operators import filters, spectral
from sigloom.operators.neighbours import hashes, knn_same_class
from sigloom.operators.splits import ordinals
from sigloom.scratch import mark, release, table


def sample_keys(rows: DataFrame | None = None) -> list[str]:
    """What tells samples apart: sample_id, and in front of it source_id, if ``rows`` have it, as that is where draws of a source lie
    together: what is grouped by both shuffles none of them."""
    return [c for c in ("source_id",) if rows is not None and c in rows.columns] + ["sample_id"]


def per_sample(rows: DataFrame | None = None):
    return W.partitionBy(*sample_keys(rows))


def noise(seed: int = 1, low: float = 0.001, high: float = 0.05, rows: DataFrame | None = None) -> Column:
    """Noise of a drawn level times the sample's deviation over all its channels. The level is drawn at a sample's first places
    and told to its other rows."""
    drawn, own = between(seed, "level", F.col("sample_id"), low, high), per_sample(rows)
    level = F.coalesce(F.max(F.when(F.col("idx") == 0, drawn)).over(own), drawn)
    key = F.concat_ws(":", "sample_id", "channel", "idx")
    return normal(seed, "noise", key) * F.stddev_pop("value").over(own) * level


def gaussian_noise(rows: DataFrame, seed: int = 1, low: float = 0.001, high: float = 0.05) -> DataFrame:
    return rows.withColumn("value", F.col("value") + noise(seed, low, high, rows))


def time_shift(rows: DataFrame, seed: int = 1, low: float = 0.05, high: float = 0.2) -> DataFrame:
    """The series turned round by a drawn share of its length, either way; drawn at a sample's first places and told to its others."""
    own = per_sample(rows)
    n = F.max("idx").over(own) + 1
    share = between(seed, "shift", F.col("sample_id"), low, high) * F.when(uniform(seed, "sign", F.col("sample_id")) < 0.5, -1).otherwise(1)
    shift = (n * F.coalesce(F.max(F.when(F.col("idx") == 0, share)).over(own), share)).cast("int")
    return rows.withColumn("idx", F.pmod(F.col("idx") + shift, n).cast("int"))


def window_slice(rows: DataFrame, seed: int = 1, low: float = 0.8, high: float = 0.95, resample: bool = False) -> DataFrame:
    """A drawn share of the series from a drawn start, its places counted anew, or stretched to the old length. Draws are made
    at a sample's first places and told to its other rows, as a digest costs more than all else that is done to a row."""
    draws = {"_keep": between(seed, "keep", F.col("sample_id"), low, high), "_start": uniform(seed, "start", F.col("sample_id"))}
    told = F.max(F.when(F.col("idx") == 0, F.struct(*[d.alias(c) for c, d in draws.items()]))).over(per_sample(rows))
    each = rows.withColumns({"_n": F.max("idx").over(per_sample(rows)) + 1, "_told": told})
    each = each.withColumns({c: F.coalesce(F.col("_told")[c], d) for c, d in draws.items()})
    size = F.floor(F.col("_n") * F.col("_keep"))
    start = F.floor(F.col("_start") * (F.col("_n") - size + 1))
    cut = each.withColumns({"_at": F.col("idx") - start, "_size": size}).where(F.col("_at").between(0, F.col("_size") - 1)).withColumn("idx", F.col("_at").cast("int"))
    if not resample:
        return cut.select(*rows.columns)
    return stretched(cut).select(*rows.columns)


def stretched(cut: DataFrame) -> DataFrame:
    """Series of ``_size`` values stretched to ``_n`` by linear interpolation, both ends kept. A value stands at the places
    between its neighbours, so each new place is made from the pair around it and nothing is gathered."""
    w = W.partitionBy(*sample_keys(cut), "channel").orderBy("idx")
    step = (F.col("_size") - 1) / (F.col("_n") - 1)
    first = F.when(F.col("idx") == 0, 0).otherwise(F.floor(F.col("idx") / step - 1e-9) + 1)
    last = F.when(F.col("idx") == F.col("_size") - 1, F.col("_n") - 1).otherwise(F.floor((F.col("idx") + 1) / step - 1e-9))
    spots = F.when(F.col("_size") == 1, F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).when(first <= last, F.sequence(first.cast("int"), last.cast("int")))
    each = cut.withColumn("_next", F.coalesce(F.lead("value").over(w), F.col("value"))).withColumn("_to", F.explode(spots))
    share = F.when(F.col("_size") == 1, 0.0).otherwise(F.col("_to") * step - F.col("idx"))
    return each.withColumn("value", F.col("value") + share * (F.col("_next") - F.col("value"))).withColumn("idx", F.col("_to").cast("int"))


def amplitude_scale(rows: DataFrame, seed: int = 1, low: float = 0.9, high: float = 1.1, per_channel: bool = False) -> DataFrame:
    key = F.concat_ws(":", "sample_id", "channel") if per_channel else F.col("sample_id")
    return rows.withColumn("value", F.col("value") * between(seed, "scale", key, low, high))


def channel_dropout(rows: DataFrame, seed: int = 1, low: float = 0.05, high: float = 0.2, fill: str = "zero") -> DataFrame:
    """max(1, int(channels x rate)) drawn channels replaced by zero, by the mean over channels, or by their neighbours'. Channels
    are ranked and counted where a sample's rows are, so none is joined."""
    own = per_sample(rows)
    rank = F.dense_rank().over(own.orderBy(uniform(seed, "drop", F.concat_ws(":", "sample_id", "channel")), "channel"))
    at = W.partitionBy(*sample_keys(rows), "idx")
    before, after = F.lag("value").over(at.orderBy("channel")), F.lead("value").over(at.orderBy("channel"))
    put = {"zero": F.lit(0.0), "mean": F.avg("value").over(at), "neighbour": F.coalesce((before + after) / 2, before, after, F.lit(0.0))}[fill]
    each = rows.withColumn("_put", put).withColumn("_rank", rank)
    rate = between(seed, "rate", F.col("sample_id"), low, high)
    most = F.greatest(F.lit(1), F.floor(F.max("_rank").over(own) * F.coalesce(F.max(F.when(F.col("idx") == 0, rate)).over(own), rate)))
    return each.withColumn("value", F.when(F.col("_rank") <= most, F.col("_put")).otherwise(F.col("value"))).select(*rows.columns)


def bounded_perturbation(rows: DataFrame, seed: int = 1, eps: float = 0.01) -> DataFrame:
    """A random direction of unit length over the sample, times ``eps`` deviations."""
    z = rows.withColumn("_z", normal(seed, "direction", F.concat_ws(":", "sample_id", "channel", "idx")))
    return z.withColumn("value", F.col("value") + F.col("_z") / F.sqrt(F.sum(F.col("_z") * F.col("_z")).over(per_sample(rows))) * eps * F.stddev_pop("value").over(per_sample(rows))).drop("_z")


def segment_permutation(rows: DataFrame, seed: int = 1, segments: int = 4) -> DataFrame:
    """Equal segments in a drawn order, the same for all channels; the last holds the rest."""
    each = rows.withColumn("_n", F.max("idx").over(per_sample(rows)) + 1).withColumn("_len", F.floor(F.col("_n") / segments)).withColumn("_seg", F.least(F.floor(F.col("idx") / F.col("_len")), F.lit(segments - 1)))
    parts = each.groupBy("sample_id", "_seg").agg(F.min("idx").alias("_first"), (F.max("idx") - F.min("idx") + 1).alias("_size"))
    order = W.partitionBy("sample_id").orderBy(uniform(seed, "segment", F.concat_ws(":", "sample_id", "_seg")), "_seg").rowsBetween(W.unboundedPreceding, -1)
    placed = parts.withColumn("_start", F.coalesce(F.sum("_size").over(order), F.lit(0)))
    return each.join(placed, ["sample_id", "_seg"]).withColumn("idx", (F.col("_start") + F.col("idx") - F.col("_first")).cast("int")).select(*rows.columns)


#: What a sample's places are told by, each an array where a sample is one row.
PLACES = ("channel", "idx", "value")


def gathered(rows: DataFrame) -> DataFrame:
    """(sample_id, channel, idx, value): samples of bounded length as one row each, three arrays in order of channel and idx;
    rows that are so already stay. Arrays of plain values take a fourth of what an array of entries takes, and their channels and
    places, much the same in all samples, next to nothing once they are compressed."""
    if isinstance(rows.schema["value"].dataType, ArrayType):
        return rows.select("sample_id", *PLACES)
    each = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(*PLACES))).alias("_e"))
    return each.select("sample_id", *[F.col("_e")[c].alias(c) for c in PLACES])


def spread(held: DataFrame) -> DataFrame:
    """``held`` with a row for each of its places. All arrays are always read, and no filter is inferred, so that the same samples are
    dealt out for whatever is made of them."""
    others = [c for c in held.columns if c not in PLACES]
    each = held.select(*others, "channel", "idx", F.posexplode_outer("value").alias("_k", "_v")).where((F.col("_k") < F.size("channel")) & (F.col("_k") < F.size("idx")))
    return each.select(*others, F.col("channel")[F.col("_k")].alias("channel"), F.col("idx")[F.col("_k")].alias("idx"), F.col("_v").alias("value"))


def at_sample(df: DataFrame, column: str, held: DataFrame, prefix: str) -> DataFrame:
    """``df`` with the places of the sample that ``column`` names, under names with ``prefix``. The few columns of ``df`` are hashed and
    the samples stream by, not ordered; every such join deals ``held`` out by sample_id, which Spark then does once for all."""
    there = df.hint("shuffle_hash").alias("_l").join(held.alias("_r"), F.col(f"_l.{column}") == F.col("_r.sample_id"))
    return there.select("_l.*", *[F.col(f"_r.{c}").alias(prefix + c) for c in PLACES])


def pairs_of(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """(draw, first, second, channel, idx, a, b): both samples of each pair, value by value. ``held`` is ``gathered``, so that a
    sample travels as one row; samples of unlike places meet in those that both have."""
    both = at_sample(at_sample(pairs, "first", held, "_a"), "second", held, "_b")
    place = lambda k: F.zip_with(f"_{k}channel", f"_{k}idx", lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    same = (F.col("_achannel") == F.col("_bchannel")) & (F.col("_aidx") == F.col("_bidx"))
    spots = F.when(same, F.transform("_aidx", lambda _, k: k)).otherwise(F.transform(place("a"), lambda p: (F.array_position(place("b"), p) - 1).cast("int")))
    each = both.select(*pairs.columns, "_achannel", "_aidx", "_avalue", "_bvalue", F.posexplode(spots).alias("_k", "_at")).where("_at >= 0")
    return each.select(*pairs.columns, *[F.col(f"_a{c}")[F.col("_k")].alias(c) for c in ("channel", "idx")], F.col("_avalue")[F.col("_k")].alias("a"), F.col("_bvalue")[F.col("_at")].alias("b"))


def soft_label(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` (first, second, weight, ...) with the labels' blend: ``hard1``, ``hard2``, ``soft`` [weight, 1 - weight] and, for
    numbers, ``blend``. ``labels`` is (sample_id, label)."""
    one, two = labels.select(F.col("sample_id").alias("first"), F.col("label").alias("hard1")), labels.select(F.col("sample_id").alias("second"), F.col("label").alias("hard2"))
    both = pairs.join(one, "first", "left").join(two, "second", "left")
    return both.withColumns({"soft": F.array(F.col("weight"), 1 - F.col("weight")), "blend": F.col("weight") * F.col("hard1") + (1 - F.col("weight")) * F.col("hard2")})


def mixup_weights(pairs: DataFrame, seed: int = 1, alpha: float = 0.2) -> DataFrame:
    """``pairs`` with the drawn ``weight`` of the first."""
    return pairs.withColumn("weight", beta(seed, "mixup", F.col("draw"), alpha))


def mixup(rows: DataFrame, pairs: DataFrame, seed: int = 1, alpha: float = 0.2) -> DataFrame:
    """(draw, first, second, channel, idx, value, weight): blends by a drawn weight of the first."""
    drawn = mixup_weights(pairs, seed, alpha)
    return pairs_of(gathered(rows), drawn).withColumn("value", F.col("weight") * F.col("a") + (1 - F.col("weight")) * F.col("b")).drop("a", "b")


def cutmix_weights(pairs: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """``pairs`` with the run of the second that is pasted (``_cut``, ``_start``) and the ``weight`` that the first keeps."""
    share = uniform(seed, "cut", F.col("draw"))
    cut = F.floor(n * (1 - share))
    start = F.floor(uniform(seed, "at", F.col("draw")) * (n - cut + 1))
    return pairs.withColumns({"_cut": cut, "_start": start, "weight": 1 - cut / n})


def cutmix(rows: DataFrame, pairs: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """A drawn run of the second pasted into the first; weight is the share that the first keeps."""
    drawn = cutmix_weights(pairs, n, seed)
    inside = (F.col("idx") >= F.col("_start")) & (F.col("idx") < F.col("_start") + F.col("_cut"))
    return pairs_of(gathered(rows), drawn).withColumn("value", F.when(inside, F.col("b")).otherwise(F.col("a"))).drop("a", "b", "_cut", "_start")


def band_jitter_filter(rows: DataFrame, seed: int = 1, fs: float = 128.0) -> DataFrame:
    """One pass of a broad band whose edges move by a draw of the sample. Further columns go along as a part of the series' name, so
    that no value is joined back to them."""
    told = [c for c in rows.columns if c not in PLACES]
    series = rows.withColumn("recording_id", F.struct(*told) if len(told) > 1 else F.col("sample_id"))
    done = filters.jittered(series, fs=fs, seed=seed, key="sample_id")
    names = [F.col("recording_id")[c].alias(c) for c in told] if len(told) > 1 else [F.col("recording_id").alias("sample_id")]
    return done.select(*names, *PLACES).select(*rows.columns)


def tf_mask(rows: DataFrame, seed: int = 1, size: int = 64, chance: float = 0.1) -> DataFrame:
    """Short-time spectra in which a run of frames and a run of bins, each a tenth of all and each with a drawn ``chance``,
    is damped, and back. Frames overlap by half. Spectra are made and inverted in one place, so no bin travels."""
    key, bins = F.concat_ws(":", "recording_id", "channel"), size // 2 + 1
    wide = lambda n: F.greatest(F.lit(1), F.floor(n * 0.1))
    run = lambda op, n: F.when(uniform(seed, op + ":hit", key) < chance, F.floor(uniform(seed, op, key) * F.greatest(F.lit(1), n - wide(n))))
    series = rows.withColumnRenamed("sample_id", "recording_id")
    others = [c for c in series.columns if c not in ("recording_id", "channel", "idx", "value")]
    runs = lambda frames: [run("frames", frames), wide(frames), run("bins", F.lit(bins)), wide(F.lit(bins))]
    return spectral.stft_masked(series, runs, size, size // 2, others).withColumnRenamed("recording_id", "sample_id").select(*rows.columns)


def smote(vectors: DataFrame, k: int = 5, seed: int = 1) -> DataFrame:
    """(sample_id, neighbour, x): a point on the way to a drawn near neighbour; without one, a copy."""
    other = vectors.select(F.col("sample_id").alias("neighbour"), F.col("x").alias("_y"))
    near = drawn_neighbour(knn_same_class(vectors, k), vectors.select("sample_id"), "sample_id", seed)
    both = vectors.join(near, "sample_id", "left").join(other, "neighbour", "left")
    step = uniform(seed, "step", F.col("sample_id"))
    moved = F.zip_with("x", "_y", lambda p, q: p + step * (q - p))
    return both.select("sample_id", "label", "neighbour", F.coalesce(moved, F.col("x")).alias("x"))


def drawn_neighbour(near: DataFrame, wanted: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """(key, neighbour): for each row of ``wanted`` (sample_id, and ``key`` if that is another) one of its sample's
    neighbours, drawn by ``key``; samples without neighbours have no row."""
    counted = near.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("sample_id")))
    pick = F.floor(uniform(seed, "pick", F.col(key)) * F.col("_n")) + 1
    return wanted.join(counted, "sample_id").where(F.col("rank") == pick).select(key, "neighbour")


# Techniques and their shares of the originals.
SHARES = {
    "gaussian_noise": 0.5, "time_shift": 0.3, "window_slice": 0.3, "amplitude_scale": 0.2, "channel_dropout": 0.2, "band_jitter_filter": 0.16,
    "tf_mask": 0.24, "mixup": 0.3, "cutmix": 0.0, "smote": 0.2,
}
#: Techniques of two samples.
PAIRED = ("mixup", "cutmix", "smote")


def quotas(n: int, shares: dict[str, float] = SHARES, target: float = 2.0) -> dict[str, int]:
    """Rows of each technique; shares whose sum is off the target by 0.1 or more are scaled to it first."""
    total = sum(shares.values())
    scale = target / total if abs(total - target) >= 0.1 else 1.0
    return {name: int(n * share * scale + 1e-9) for name, share in shares.items()}


class Techniques:
    """Techniques of one sample each, by name, with their shares of the originals.

    A technique is a function of (rows, seed) that returns the rows with other values or places, all columns kept; or a
    Python table function, which gets the rows of each sample (sample_id, channel, idx, value), ordered by channel and idx, as
    one partition of its table argument, and the seed, and yields (channel, idx, value).
    """

    def __init__(self, techniques: dict[str, Callable | UserDefinedTableFunction], shares: dict[str, float]):
        self.techniques, self.shares = dict(techniques), dict(shares)

    def with_technique(self, name: str, technique: Callable | UserDefinedTableFunction, share: float = 0.0) -> Techniques:
        """These techniques and one more, or another one of a known name; the original set stays as it is."""
        if name in PAIRED:
            raise ValueError(f"{name!r} is a technique of two samples")
        return Techniques(self.techniques | {name: technique}, self.shares | {name: share})

    def quotas(self, n: int, target: float = 2.0) -> dict[str, int]:
        return quotas(n, self.shares, target)

    def __contains__(self, name: str) -> bool:
        return name in self.techniques

    def apply(self, name: str, rows: DataFrame, seed: int) -> DataFrame:
        """``rows`` (sample_id, channel, idx, value and others that are the same all over a sample) after the technique."""
        made = self.techniques[name]
        if not isinstance(made, UserDefinedTableFunction):
            return made(rows, seed)
        table_of = rows.select("sample_id", "channel", "idx", "value").asTable().partitionBy("sample_id").orderBy("channel", "idx")
        told = [c for c in rows.columns if c not in ("channel", "idx", "value")]
        found = made(table_of, F.lit(seed)).select("sample_id", "channel", "idx", "value")
        return found.join(rows.select(*told).distinct(), "sample_id").select(*rows.columns)


def source_draws(rows: DataFrame, key: str, counts: dict[str, int], seed: int = 1) -> DataFrame:
    """(technique, draw_no, source_id, source2_id): rows drawn with replacement for each technique, and a second one for the
    techniques of ``PAIRED``."""
    spark = rows.sparkSession
    ranked = ordinals(rows.select(key), uniform(seed, "source", F.col(key)), key)
    total = rows.count()
    wanted = spark.createDataFrame([(t, n) for t, n in counts.items() if n], "technique string, quota long")
    draws = wanted.withColumn("draw_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota"))))
    at = lambda op: F.floor(uniform(seed, op, F.concat_ws(":", "technique", "draw_no")) * total).cast("long")
    one = draws.withColumn("rank", at("draw")).join(ranked.select("rank", F.col(key).alias("source_id")), "rank").drop("rank")
    two = one.withColumn("rank", F.when(F.col("technique").isin(*PAIRED), at("draw2"))).join(ranked.select("rank", F.col(key).alias("source2_id")), "rank", "left")
    return two.select("technique", "draw_no", "source_id", "source2_id")


#: The techniques that come with the library.
BUILT_IN = Techniques(
    {
        "gaussian_noise": gaussian_noise, "time_shift": time_shift, "window_slice": lambda rows, seed: window_slice(rows, seed, resample=True), "amplitude_scale": amplitude_scale, "channel_dropout": channel_dropout,
        "band_jitter_filter": band_jitter_filter, "tf_mask": tf_mask, "bounded_perturbation": bounded_perturbation, "segment_permutation": segment_permutation,
    },
    SHARES,
)


def sample_vectors(held: DataFrame, labels: DataFrame) -> DataFrame:
    """(sample_id, label, x): a ``gathered`` sample's values, channel by channel, as one vector of bounded length; and its hashes,
    which are then known without it."""
    x = held.select("sample_id", F.col("value").cast("array<double>").alias("x"))
    return x.withColumns(hashes("x")).join(labels.select("sample_id", "label"), "sample_id")


def lineage(rows: DataFrame, labels: DataFrame, counts: dict[str, int], n: int, seed: int = 1, techniques: Techniques = BUILT_IN) -> DataFrame:
    """(technique, draw_no, source_id, source2_id, weight, hard1, hard2, soft, blend) of every augmented sample.

    ``n`` is the samples' length. The second source of ``smote`` is a drawn near neighbour of the first, of its label, and
    it moves a drawn step towards it, so the first's weight is one less the step; samples of one source have weight 1.
    """
    unknown = set(counts) - set(techniques.techniques) - set(PAIRED)
    if unknown:
        raise ValueError(f"no such technique: {', '.join(sorted(unknown))}")
    draws = table(source_draws(labels, "sample_id", counts, seed).withColumn("draw", F.concat_ws(":", "technique", "draw_no")))
    kind = lambda *names: draws.where(F.col("technique").isin(*names))
    parts = [kind(*techniques.techniques).withColumn("weight", F.lit(1.0)), mixup_weights(kind("mixup"), seed), cutmix_weights(kind("cutmix"), n, seed).drop("_cut", "_start")]
    if counts.get("smote"):
        moved = kind("smote").drop("source2_id")
        near = drawn_neighbour(knn_same_class(sample_vectors(gathered(rows), labels), wanted=moved.select(F.col("source_id").alias("sample_id"))), moved.withColumnRenamed("source_id", "sample_id"), "draw", seed)
        parts.append(moved.join(near.withColumnRenamed("neighbour", "source2_id"), "draw", "left").withColumn("weight", F.when(F.col("source2_id").isNull(), 1.0).otherwise(1 - uniform(seed, "step", F.col("draw")))))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    told = soft_label(every.withColumnsRenamed({"source_id": "first", "source2_id": "second"}), labels).withColumnsRenamed({"first": "source_id", "second": "source2_id"})
    alone = F.col("source2_id").isNull()
    return told.withColumns({"hard2": F.coalesce("hard2", "hard1"), "blend": F.when(alone, F.col("hard1").cast("double")).otherwise(F.col("blend"))}).drop("draw")


def augment_dataset(rows: DataFrame, labels: DataFrame, counts: dict[str, int], n: int, seed: int = 1, return_original: bool = True, techniques: Techniques = BUILT_IN) -> tuple[DataFrame, DataFrame]:
    """(values, lineage): (technique, draw_no, source_id, channel, idx, value) of all augmented samples and, unless declined,
    of the originals, and the ``lineage`` of the augmented ones.

    ``rows`` are samples of ``n`` places, long or ``gathered``, ``labels`` (sample_id, label). Each output is a sample of its
    own, keyed by technique and draw number, so repeated sources differ; every quota of ``counts`` is met in full. Users' own
    techniques come with ``techniques``. Samples are gathered once and dealt out once, as one row each, to where their source's
    draws are. A draw is spread where its source is, and the built-in techniques leave its values there.
    """
    spark = rows.sparkSession
    held = table(gathered(rows))
    since = mark(spark)
    made = table(lineage(held, labels, counts, n, seed, techniques))  # each technique reads its own part of it
    release(spark, since, keep=1)  # neighbours and draws are in it
    keyed = made.withColumn("sample_id", F.concat_ws(":", "technique", "draw_no"))
    out = ["technique", "draw_no", "source_id", "channel", "idx", "value"]

    def own(t: str) -> DataFrame:
        there = at_sample(keyed.where(F.col("technique") == t).select("draw_no", "source_id", "sample_id"), "source_id", held, "_")
        return spread(there.withColumnsRenamed({"_" + c: c for c in PLACES}))

    parts = [techniques.apply(t, own(t), seed).withColumn("technique", F.lit(t)).select(*out) for t in counts if t in techniques and counts[t]]
    if any(counts.get(t) for t in PAIRED):
        two = keyed.where(F.col("technique").isin(*PAIRED)).withColumns({"draw": F.col("sample_id"), "first": F.col("source_id"), "second": F.coalesce("source2_id", "source_id")})
        both = pairs_of(held, cutmix_weights(two.withColumnRenamed("weight", "_w"), n, seed).drop("weight"))
        inside = (F.col("idx") >= F.col("_start")) & (F.col("idx") < F.col("_start") + F.col("_cut"))
        value = F.when(F.col("technique") == "cutmix", F.when(inside, F.col("b")).otherwise(F.col("a"))).otherwise(F.col("_w") * F.col("a") + (1 - F.col("_w")) * F.col("b"))
        parts.append(both.withColumn("value", value).select(*out))
    if return_original:
        parts.append(spread(held).select(F.lit("original").alias("technique"), F.lit(0).cast("long").alias("draw_no"), F.col("sample_id").alias("source_id"), "channel", "idx", "value"))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union, made


def assign_groups(made: DataFrame, groups: DataFrame, random: bool = False, seed: int = 1) -> DataFrame:
    """``made`` (technique, draw_no, source_id, ...) with the group of each source, or of a sample drawn anew. ``groups`` is
    (sample_id, group)."""
    if not random:
        return made.join(groups.withColumnRenamed("sample_id", "source_id"), "source_id")
    ranked = ordinals(groups, uniform(seed, "group", F.col("sample_id")), "sample_id").drop("sample_id", "n")
    at = F.floor(uniform(seed, "group_of", F.concat_ws(":", "technique", "draw_no")) * groups.count()).cast("long")
    return made.withColumn("rank", at).join(ranked, "rank").drop("rank")
