"""Best-fit packing of token sequences: a configuration linear program over the length histogram.

The histogram has at most ``capacity`` lengths, so the program's size does not grow with the corpus. It is solved
by multiplicative weights: each length has a price, a knapsack dynamic program finds the configuration of the
largest price that fits, and the prices of the lengths it serves fall. Configurations are rounded down to whole
numbers; what is left is packed by best fit over counts. Rows then find their place by their rank in their length.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import ranks, small_batches
from sigloom.llm.tokens import token_pieces
from sigloom.scratch import table

#: Pricing rounds, and the rate at which a served length's price falls.
ROUNDS, RATE = 200, 0.5
#: Configurations taken from one pricing at most, and their price beside the best one's.
BATCH, NEARLY = 32, 0.8
#: Pieces of one length that a task ranks, about.
RANKED = 250_000
#: Shares of the configurations' use that are tried in rounding: small lengths kept back fill the rest better.
SHARES = (1.0, 0.8, 0.6, 0.4)


def best_configurations(price: np.ndarray, need: np.ndarray, capacity: int, most: int = BATCH) -> list[np.ndarray]:
    """Configurations of nearly the largest price, no length in two of them, by the unbounded knapsack's dynamic program.

    One table serves them all: a configuration is a length and the best filling of the room beside it.
    """
    lengths = np.flatnonzero(need > 0)
    value, last, worth = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64), price[lengths]
    for room in range(int(lengths[0]), capacity + 1):
        k = int(np.searchsorted(lengths, room, "right"))
        gains = value[room - lengths[:k]] + worth[:k]
        best = int(gains.argmax())
        value[room], last[room] = gains[best], lengths[best]
    whole, found, taken = worth + value[capacity - lengths], [], set()
    for k in np.argsort(-whole)[: 8 * most].tolist():
        if len(found) == most or whole[k] < NEARLY * value[capacity]:
            break
        config, room = [int(lengths[k])], capacity - int(lengths[k])
        while room >= lengths[0] and last[room]:
            config.append(int(last[room]))
            room -= config[-1]
        if taken.isdisjoint(config):
            taken.update(config)
            found.append(np.array(config))
    return found


def fractional(need: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Configurations and how often each is used, nearly covering ``need``, by multiplicative weights."""
    here = need > 0
    price, used, served = np.where(here, np.arange(len(need)) / capacity, 0.0), Counter(), np.zeros(len(need))
    for _ in range(rounds):
        for config in best_configurations(price, need, capacity):
            sizes, times = np.unique(config, return_counts=True)
            step = max(1.0, float(np.ceil((need[sizes] / times).min() / 2)))
            used[tuple(sorted(config.tolist(), reverse=True))] += step
            served[sizes] += times * step
            price[sizes] *= np.exp(-RATE * np.minimum(1.0, times * step / need[sizes]))
            price[served >= need] *= 1 - RATE / 2
        if (served[here] >= need[here]).all():
            break
    return dict(used)


def best_fit(need: np.ndarray, capacity: int) -> Counter:
    """Whole configurations for ``need`` by decreasing best fit, in counts: alike sequences are one entry."""
    open_by_room: dict[int, Counter] = {}
    for length in np.flatnonzero(need > 0)[::-1].tolist():
        left = int(need[length])
        while left:
            room = min((r for r in open_by_room if r >= length), default=None)
            if room is None:
                each = min(capacity // length, left)
                config, n, room = (), left // each, capacity
            else:
                config, have = next(iter(open_by_room[room].items()))
                each = min(room // length, left)
                n = min(have, left // each)
                open_by_room[room][config] -= n
                if not open_by_room[room][config]:
                    del open_by_room[room][config]
                if not open_by_room[room]:
                    del open_by_room[room]
            open_by_room.setdefault(room - length * each, Counter())[config + (length,) * each] += n
            left -= n * each
    return sum(open_by_room.values(), Counter())


def configurations(need: np.ndarray, capacity: int) -> Counter:
    """Whole configurations that serve ``need`` (count of each length) exactly."""
    need = need.astype(np.int64)
    if not need.any():
        return Counter()
    used = sorted(fractional(need, capacity).items(), key=lambda x: -x[1])
    plans = [rounded(used, need, capacity, share) for share in SHARES]
    return min(plans, key=lambda plan: sum(plan.values()))


def rounded(used: list[tuple[tuple[int, ...], float]], need: np.ndarray, capacity: int, share: float) -> Counter:
    """``share`` of each full configuration's use, rounded down; the lengths left are packed by best fit."""
    whole, left = Counter(), need.copy()
    for config, n in used:
        sizes, times = np.unique(config, return_counts=True)
        n = min(int(n * share + 1e-9), int((left[sizes] // times).min()))
        if n > 0 and sum(config) >= capacity - 1:
            whole[config] += n
            left[sizes] -= times * n
    return whole + best_fit(left, capacity)


def placements(plan: Counter) -> list[tuple[int, list[int], list[int], list[int]]]:
    """For each length: where its ranks begin, and the sequence and offset of the first of each run of ranks."""
    runs: dict[int, list[list[int]]] = {}
    ranks_used, sequence = Counter(), 0
    for config, n in plan.items():
        offset = 0
        for length in config:
            begin, seq, off = runs.setdefault(length, [[], [], []])
            begin.append(ranks_used[length])
            seq.append(sequence)
            off.append(offset)
            ranks_used[length] += n
            offset += length
        sequence += n
    return [(length, *lists) for length, lists in runs.items()]


def pack(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """``pieces`` (``length`` of 1 to ``capacity``, and any columns) with ``sequence_id`` and ``offset``.

    ``pieces`` should be a written table: it is read twice, for the histogram and for the rows. Equal lengths are
    interchangeable, so ties only swap places; no rows give no rows. The plan's table has at most a row for each
    length, so it is broadcast.
    """
    spark = pieces.sparkSession
    need = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        need[length] = n
    rows = placements(configurations(need, capacity))
    plan = spark.createDataFrame(rows, "length long, _begin array<long>, _seq array<long>, _off array<long>")
    parts = max(64, -(-int(need.max()) // RANKED))
    placed = ranks(pieces, ["length"], order, "_rank", parts).join(F.broadcast(plan), "length")
    run = placed.withColumn("_k", F.expr("size(filter(_begin, b -> b <= _rank))"))
    return (run.withColumn("sequence_id", F.expr("element_at(_seq, _k) + _rank - element_at(_begin, _k)"))
            .withColumn("offset", F.expr("element_at(_off, _k)")).drop("_rank", "_k", "_begin", "_seq", "_off"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Every text of ``docs`` (doc_id, text) tokenized, ended by id 0, cut and packed.

    Null and empty texts are the end id alone; long texts are cut into pieces of ``capacity``; repeated rows are
    packed as often as they come; other columns are ignored; an empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        pieces = table(token_pieces(docs, tokenizer_path, capacity))
    packed = pack(pieces, capacity, ["doc_id", "piece", "ids_crc32"])
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
