"""Sharding by fixed virtual slots: records hash into thousands of slots, and a versioned map sends slots to shards.

Version 0 of a map deals the slots in turn, before any record is known. Each run aggregates the bytes of each slot and,
where the shards' bytes have come apart, edits the latest version and adds it as a new one: whole slots move, records are
never hashed anew. A version is written aside and published by one rename, which fails if the version is there; so a
version is whole and final, and of two runs at once the second takes what the first has published. A run may hold on to
a version that it names. Records travel only as their id, size and checksum.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.scratch import new_folder, publish, published, table

SLOTS = 8192
#: The spread of the shards' bytes, as a share of their mean, beyond which a map is edited.
SPREAD = 0.001
#: Rows of a slot that are numbered in one task whatever the others have; a slot twice as large is numbered in parts.
PART = 10_000
MAP = "version int, slot int, shard int, bytes long, n long, base long"


def virtual_slot(key, slots: int = SLOTS):
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def slot_loads(records: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of each slot: ``SLOTS`` rows at most, whatever the corpus."""
    found = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    return sorted((r.virtual_slot, r.bytes, r.n) for r in found)


def rebalance(owner: dict[int, int], loads: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """An edited map for ``shards`` shards: slots of shards that are gone move to the emptiest, then slots move from the
    fullest shard to the emptiest, each the one nearest to half their gap, while that narrows it; all others stay."""
    size, out = {s: b for s, b, _ in loads}, dict(owner)
    held, by_shard = dict.fromkeys(range(shards), 0), {k: [] for k in range(shards)}
    for s in sorted(out):
        if out[s] < shards:
            held[out[s]] += size.get(s, 0)
            by_shard[out[s]].append((size.get(s, 0), s))
    for k in by_shard:
        by_shard[k].sort()
    for s in sorted((s for s in out if out[s] >= shards), key=lambda s: (-size.get(s, 0), s)):
        out[s] = min(held, key=lambda k: (held[k], k))
        held[out[s]] += size.get(s, 0)
        insort(by_shard[out[s]], (size.get(s, 0), s))
    while True:
        high, low = max(held, key=lambda k: (held[k], -k)), min(held, key=lambda k: (held[k], k))
        gap, slots = held[high] - held[low], by_shard[high]
        at = bisect_left(slots, (gap / 2, -1))
        fits = [x for x in slots[max(0, at - 1) : at + 1] if 0 < x[0] < gap]
        if not fits:
            return out
        best = min(fits, key=lambda x: (abs(x[0] - gap / 2), x))
        slots.remove(best)
        insort(by_shard[low], best)
        out[best[1]] = low
        held[high] -= best[0]
        held[low] += best[0]


def spread(owner: dict[int, int], loads: list[tuple[int, int, int]], shards: int) -> float:
    """The gap between the fullest and the emptiest shard, as a share of their mean."""
    held = dict.fromkeys(range(shards), 0)
    for s, b, _ in loads:
        held[owner[s]] = held.get(owner[s], 0) + b
    return (max(held.values()) - min(held[k] for k in range(shards))) / max(1, sum(held.values()) / shards)


def map_table(spark: SparkSession, owner: dict[int, int], loads: list[tuple[int, int, int]], version: int) -> DataFrame:
    """The map as rows of every slot; ``base`` is the place in the shard of the slot's first record."""
    rows, used, held = [], {}, {s: (b, n) for s, b, n in loads}
    for slot in sorted(owner):
        size, n = held.get(slot, (0, 0))
        rows.append({"version": version, "slot": slot, "shard": owner[slot], "bytes": size, "n": n, "base": used.get(owner[slot], 0)})
        used[owner[slot]] = used.get(owner[slot], 0) + n
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{MAP.replace(' ', ':')}>>".replace(",:", ","))))


def save_map(slot_map: DataFrame, path: str, version: int) -> bool:
    """Publish a version of the map, whole or not at all; false if there is one of that number already, which stays."""
    aside = new_folder(slot_map.sparkSession, "slot-map-version")
    slot_map.drop("version").coalesce(1).write.parquet(aside)
    return publish(slot_map.sparkSession, aside, f"{path}/version={version}")


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name[8:]) for name in published(spark, path) if name.startswith("version=") and name[8:].isdigit())


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The given version of the map, or the latest."""
    held = versions(spark, path)
    if not held or version is not None and version not in held:
        raise ValueError(f"no version {'at all' if version is None else version} of a map at {path}")
    version = held[-1] if version is None else version
    own = ", ".join(c for c in MAP.split(", ") if c != "version int")
    return spark.read.schema(own).parquet(f"{path}/version={version}").select(F.lit(version).alias("version"), *[c.split()[0] for c in own.split(", ")])


def owners_of(spark: SparkSession, path: str, version: int | None, slots: int) -> tuple[int, dict[int, int]]:
    """(version, slot -> shard), a row for each of the ``slots`` and no more; anything else is an error."""
    rows = load_map(spark, path, version).select("version", "slot", "shard").collect()
    if len(rows) != slots or {r.slot for r in rows} != set(range(slots)):
        raise ValueError(f"the map at {path} has {len(rows)} slots, not {slots}")
    return rows[0].version, {r.slot: r.shard for r in rows}


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot): size is the text's UTF-8 bytes plus 16, null texts having none. A null id
    says nothing of its row, so such rows are dealt one by one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slot = F.when(F.col("doc_id").isNotNull(), virtual_slot(F.col("doc_id"), slots)).otherwise(virtual_slot(F.monotonically_increasing_id(), slots))
    return docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot.alias("virtual_slot"))


def current_map(spark: SparkSession, path: str, loads: list[tuple[int, int, int]], shards: int, slots: int) -> tuple[int, dict[int, int]]:
    """The latest version, edited and published anew if it does not fit the shards or their bytes. Where another run publishes
    the same number first, that one's version is looked at in its place."""
    if not versions(spark, path):
        save_map(map_table(spark, {s: s % shards for s in range(slots)}, [], 0), path, 0)
    while True:
        version, owner = owners_of(spark, path, None, slots)
        if max(owner.values()) < shards and spread(owner, loads, shards) <= SPREAD:
            return version, owner
        edited = rebalance(owner, loads, shards)
        if edited == owner:
            return version, owner
        if save_map(map_table(spark, edited, loads, version + 1), path, version + 1):
            return version + 1, edited


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS, map_path: str | None = None, version: int | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its shard and its place in it, gapless from 0.

    Law ``bytes``: shards hold near-equal bytes. ``map_path`` keeps the map's versions from one run to the next; without
    it a map is made for these rows alone and goes with the application, so the same rows give the same shards. The latest
    version holds as long as it fits the shards and their bytes are within ``SPREAD``; else it is edited, and the edit is
    published as the next version. A named ``version`` holds whatever the bytes: a repeated job passes the one that it
    had. A map of another number of slots is an error, as is a version that is not there or needs more shards. Null ids are
    dealt among all slots; null texts have no bytes; rows of one doc_id share a slot, and each gets a place (equal rows may
    swap): places in a large slot are counted in parts, so no slot is one task; other columns are ignored; an empty table gives
    no rows. The map has ``slots`` rows, so it is broadcast.
    """
    spark = docs.sparkSession
    path = map_path or new_folder(spark, "slot-map")
    held = table(records(docs, slots).withColumn("_row", F.monotonically_increasing_id()))
    loads = slot_loads(held)
    version, owner = current_map(spark, path, loads, shards, slots) if version is None else owners_of(spark, path, version, slots)
    if max(owner.values()) >= shards:
        raise ValueError(f"version {version} of the map at {path} is for more than {shards} shards")
    each = max(PART, sum(n for _, _, n in loads) // slots)
    chosen = map_table(spark, owner, loads, version).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("n") / (2 * each))).cast("int"))
    chosen = F.broadcast(chosen.select(F.col("slot").alias("virtual_slot"), "shard", "base", "version", "parts"))  # its shards are the saved ones; the bases are of this run's rows
    dealt = held.join(chosen, "virtual_slot").withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("parts")).cast("int"))
    counts = dealt.groupBy("virtual_slot", "_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each part of a slot
    before = F.sum("_n").over(W.partitionBy("virtual_slot").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("virtual_slot", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("virtual_slot", "_part").orderBy("doc_id", "text_crc32", "_row")) - 1
    placed = dealt.withColumn("_place", inside).join(offsets, ["virtual_slot", "_part"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("_before") + F.col("_place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))
