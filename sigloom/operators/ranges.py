"""Orders over whole tables without a task that orders one: balanced ranges, exact quantiles and weighted draws.

Ranges are cut at splitters that Spark takes from a sample of the rows, so an outlier or a crowd of values makes no range
larger. Rows come with distinct values, so a heavy value is one row. Quantiles of large groups are found by radix
selection: a value's bits are an order-preserving number, and rounds of counting fix 16 of them after the other.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, LongType

from sigloom.scratch import table

#: Rows of a range, about, and ranges at most.
ROWS, PARTS = 100_000, 4_096
#: Values of a group whose quantiles are taken in one buffer, and the bits that a round of counting fixes.
SMALL, BITS = 100_000, 16
#: Rows that may be broadcast.
FEW = 100_000


def ranged(rows: DataFrame, by: list[str], order: list[str], parts: int | None = None, name: str = "_b") -> DataFrame:
    """``rows``, written, with the number of the range of (by, order) that each is in: ranges rise with ``order`` in each
    group of ``by`` and hold nearly the same number of rows. The table is written, so that a lost task finds its rows in the
    same ranges."""
    rows = table(rows)
    parts = parts or min(PARTS, ceil(rows.count() / ROWS))
    if parts <= 1:
        return rows.withColumn(name, F.lit(0))
    return table(rows.repartitionByRange(parts, *by, *order).withColumn(name, F.spark_partition_id()))


def _window(by: list[str]) -> W:
    return W.partitionBy(*by) if by else W.partitionBy(F.lit(0))


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, str], down: bool = False, part: str = "_b") -> DataFrame:
    """``rows`` (as from ``ranged``) with running sums in ``order``, their own value included: ``sums`` names the new column
    for each of the summed ones; and ``<new>_all``, the sum over the group. ``down`` if ``order`` falls.

    Sums run within a range and are shifted by what the ranges before hold, a row for each range and group.
    """
    tops = rows.groupBy(*by, part).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums.values()])
    w = _window(by)
    over = w.orderBy(F.desc(part) if down else F.asc(part))
    tops = tops.select(*by, part, *[(F.sum(f"_t_{c}").over(over) - F.col(f"_t_{c}")).alias(f"_s_{c}") for c in sums.values()], *[F.sum(f"_t_{c}").over(w).alias(f"{new}_all") for new, c in sums.items()])
    inside = W.partitionBy(*by, part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = rows.withColumns({new: F.sum(c).over(inside) for new, c in sums.items()}).join(tops, [*by, part])
    return summed.withColumns({new: F.col(new) + F.col(f"_s_{c}") for new, c in sums.items()}).drop(part, *[f"_s_{c}" for c in sums.values()])


@F.arrow_udf(LongType())
def ordered_bits(v: pa.Array) -> pa.Array:
    """A double as a whole number of the same order; both zeros are one, NaN is the largest."""
    x = np.asarray(v.to_numpy(zero_copy_only=False), float) + 0.0
    bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))


@F.arrow_udf(DoubleType())
def of_bits(k: pa.Array) -> pa.Array:
    bits = np.asarray(k.to_numpy(zero_copy_only=False), np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view(np.float64))


def _selected(values: DataFrame, by: list[str], ranks: DataFrame, bits: int, small: int) -> DataFrame:
    """(by, at, value): of each group the values at 0-based places ``rank`` of its order. ``ranks`` is (by, at, rank), of a few
    rows for each large group.

    Rounds of counting fix ``bits`` of the values, until those that share the bits so far are ``small`` in number: these are
    ordered, or, where all bits are fixed, equal.
    """
    keyed, ranks = values.select(*by, ordered_bits("value").alias("_key")), table(ranks.withColumn("_lead", F.lit(0).cast("long")))
    few = (lambda df: F.broadcast(df)) if ranks.count() <= FEW else (lambda df: df)
    for left in range(64 - bits, -1, -bits):
        top = left + bits == 64
        # The sign comes first: negative numbers stand before the others.
        digit = F.shiftright("_key", left) + 2 ** (bits - 1) if top else F.shiftright("_key", left).bitwiseAND(2**bits - 1)
        lead = F.lit(0).cast("long") if top else F.shiftright("_key", left + bits)
        wanted = few(ranks.select(*by, "_lead").distinct())
        counts = keyed.select(*by, lead.alias("_lead"), digit.alias("_digit")).join(wanted, [*by, "_lead"]).groupBy(*by, "_lead", "_digit").agg(F.count(F.lit(1)).alias("_c"))
        up = F.sum("_c").over(W.partitionBy(*by, "_lead").orderBy("_digit"))  # 2 to the power of ``bits`` rows at most
        found = ranks.join(counts.withColumn("_to", up), [*by, "_lead"]).where((F.col("rank") < F.col("_to")) & (F.col("rank") >= F.col("_to") - F.col("_c")))
        own = F.col("_digit") - (2 ** (bits - 1) if top else 0)
        ranks = table(found.select(*by, "at", (F.col("rank") - F.col("_to") + F.col("_c")).alias("rank"), (F.shiftleft("_lead", bits) + own).alias("_lead"), "_c"))
        if left and (ranks.agg(F.max("_c")).first()[0] or 0) <= small:
            wanted = few(ranks.select(*by, "_lead").distinct())
            mine = keyed.withColumn("_lead", F.shiftright("_key", left)).join(wanted, [*by, "_lead"])
            place = F.row_number().over(W.partitionBy(*by, "_lead").orderBy("_key")) - 1  # ``small`` rows at most
            return mine.withColumn("rank", place.cast("long")).join(few(ranks.drop("_c")), [*by, "_lead", "rank"]).select(*by, "at", of_bits("_key").alias("value"))
        ranks = ranks.drop("_c")
    return ranks.select(*by, "at", of_bits("_lead").alias("value"))


def quantiles(rows: DataFrame, by: list[str], shares: list[float], small: int | None = None, bits: int = BITS) -> DataFrame:
    """(by, q, n): exact quantiles of ``value`` in each group of ``by``, between two values by linear interpolation; ``q`` has one
    for each of ``shares``, ``n`` is the number of values. Nulls are left out, groups of nulls have no row.

    A group of up to ``small`` values is one buffer. In a larger one the values at the wanted places are selected by rounds
    of counting, so memory does not grow with it.
    """
    small = SMALL if small is None else small
    held = table(rows.where(F.col("value").isNotNull()).select(*by, F.col("value").cast("double").alias("value")))
    n = F.count(F.lit(1)).alias("n")
    sizes = table(held.groupBy(*by).agg(n) if by else held.agg(n).where("n > 0"))
    large = sizes.where(F.col("n") > small)
    q = F.percentile("value", F.array(*map(F.lit, shares))).alias("q")
    if large.isEmpty():
        return held.groupBy(*by).agg(q, n) if by else held.agg(q, n).where("n > 0")
    whole = lambda df, other, how: df.join(F.broadcast(other) if other.count() <= FEW else other, by, how) if by else df
    places = F.explode(F.array(*[F.struct(F.lit(k * 2 + up).alias("at"), (F.ceil if up else F.floor)((F.col("n") - 1) * share).cast("long").alias("rank")) for k, share in enumerate(shares) for up in (0, 1)])).alias("_p")
    found = _selected(whole(held, large.select(*by), "left_semi"), by, large.select(*by, places).select(*by, "_p.*"), bits, small)
    packed = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("_v"))
    both = packed.join(large, by) if by else packed.crossJoin(large)  # one row each

    def between(k: int, share: float) -> Column:
        at = (F.col("n") - 1) * share
        part, lo, hi = at - F.floor(at), F.col("_v")[k * 2], F.col("_v")[k * 2 + 1]
        return F.when(lo == hi, lo).otherwise((1 - part) * lo + part * hi)

    selected = both.select(*by, F.array(*[between(k, s) for k, s in enumerate(shares)]).alias("q"), "n")
    if not by:
        return selected
    return whole(held, large.select(*by), "left_anti").groupBy(*by).agg(q, n).unionByName(selected)


def weighted_draws(rows: DataFrame, key: str, weight: str, draws: DataFrame, parts: int | None = None) -> DataFrame:
    """``draws`` (u in [0, 1), any others) with the ``key`` of the row that each hits, rows standing side by side in order of
    ``key``, each as wide as its ``weight``: draws with replacement in proportion to a weight for every row.

    Weights are summed in two phases. A range of rows is cut into as many equal buckets as it has rows; a row is in the
    buckets that it touches, twice as many as rows in all, and a draw is joined by its bucket alone: no nested loop and no
    range join, however the weights lie. Null, negative and zero weights are never drawn; keys are unique; without any weight
    there are no rows.
    """
    some = ranged(rows.select(F.col(key), F.col(weight).cast("double").alias("_w")).where("_w > 0"), [], [key], parts)
    summed = running(some.withColumn("_part", F.col("_b")), [], [F.col(key)], {"_hi": "_w"})
    before = F.lag("_hi").over(W.partitionBy("_part").orderBy(key))
    placed = table(summed.withColumn("_lo", F.coalesce(before, F.col("_hi") - F.col("_w"))))
    tops = table(placed.groupBy("_part").agg(F.min("_lo").alias("_from"), F.max("_hi").alias("_to"), F.count(F.lit(1)).alias("_n"), F.max("_hi_all").alias("_all")))
    known = sorted((r._from, r._part, r._all) for r in tops.collect())  # a row for each range
    if not known:
        return draws.limit(0).crossJoin(rows.select(key).limit(0))
    begins, ids = np.array([k[0] for k in known]), np.array([k[1] for k in known], np.int32)

    @F.arrow_udf("int")
    def owner(u: pa.Array) -> pa.Array:
        """The last range that starts at or before the draw."""
        return pa.array(ids[np.maximum(0, np.searchsorted(begins, u.to_numpy(zero_copy_only=False), "right") - 1)])

    bucket = lambda v: F.least(F.greatest(F.floor((v - F.col("_from")) / (F.col("_to") - F.col("_from")) * F.col("_n")), F.lit(0)), F.col("_n") - 1).cast("long")
    tops = F.broadcast(tops.drop("_all"))  # ``PARTS`` rows at most
    near = placed.select(key, "_lo", "_hi", "_part").join(tops, "_part").withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_lo")), bucket(F.col("_hi"))))).drop("_from", "_to", "_n")
    asked = draws.withColumn("_u", F.col("u") * F.lit(float(known[0][2]))).withColumn("_part", owner("_u")).join(tops, "_part").withColumn("_bucket", bucket(F.col("_u")))
    last = F.col("_u") >= F.col("_to")  # what rounding may leave behind a range's end falls to its last row
    hit = asked.join(near, ["_part", "_bucket"]).where((F.col("_u") >= F.col("_lo")) & ((F.col("_u") < F.col("_hi")) | (last & (F.col("_hi") == F.col("_to")))))
    return hit.select(*draws.columns, key)
