"""Audit of filters that act in turn: contractions of contingency tables.

Each document fails or passes five filters. The documents of a part are counted in a 2 x 2 x 2 x 2 x 2 table, an axis for
each filter, 0 where it passes and 1 where it fails. Whatever is asked of a filter at its place in an order is a
contraction of that table in which each axis selects those that pass, those that fail or all: one einsum over the
selectors of all orders and steps. Texts are read once; what is shuffled is a digest, a part and a few bits of each.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import map_slices, small_batches, word_blocks
from sigloom.scratch import table

#: The filters, an axis each, and the selectors of an axis.
FILTERS = "ABCDE"
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
#: Fewest words, least share of distinct words and largest share of capitals in a hundred, and marks that none may hold.
WORDS, DISTINCT, CAPITALS, MARKS = 200, 50, 3, b"#$%&*|"
#: Bytes that are no first byte of a code point, and the capitals that are counted.
_INNER, _UPPER = bytes(range(0x80, 0xC0)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Parts whose tables are contracted at once.
PARTS_AT_ONCE = 64
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(text: bytes) -> int:
    """The filters A to D that a UTF-8 text fails, A the bit of 16 and D that of 2."""
    n, seen = 0, set()
    for words in word_blocks(text):
        n += len(words)
        seen.update(words)
    capitals = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _INNER))
    fails = n < WORDS, 100 * len(seen) < DISTINCT * n, 100 * capitals > CAPITALS * points, any(m in text for m in MARKS)
    return sum(16 >> k for k, failed in enumerate(fails) if failed)


def document_facts(docs: DataFrame) -> DataFrame:
    """(id, part, digest, fails) of every row: id with null as the largest long, part the language with null as an empty
    string, digest the SHA-256 of the text, fails as in ``failures``. A null text is an empty one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in batch.column(2).to_pylist()]
        digests, fails = [hashlib.sha256(t).digest() for t in texts], [failures(t) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(fails, pa.int32())], ["id", "part", "digest", "fails"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    return map_slices(rows, run, "id long, part string, digest binary, fails int")


def contingency(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cell, n, good, toxic): documents of a part that fail the filters whose bits ``cell`` has, E the bit of 1.

    E fails where a smaller id has the same text anywhere in the table: each digest's least id is counted map-side, and
    rows are joined to it by digest and id together, so that no group of copies meets in one task.
    """
    with small_batches(docs.sparkSession):
        facts = table(document_facts(docs))
    firsts = facts.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    every = facts.join(firsts, ["digest", "id"], "left").join(told, "id", "left")
    cell = F.col("fails") + F.when(F.col("first"), 0).otherwise(1)
    counted = every.groupBy("part", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return counted


def selectors() -> tuple[list[tuple[str, int]], np.ndarray, dict[str, np.ndarray]]:
    """The steps (order, place from 1), the axis of each one's filter, and for each question an array (steps, axes, 2)."""
    steps = [("".join(order), k + 1) for order in permutations(FILTERS) for k in range(len(FILTERS))]
    own = np.array([FILTERS.index(order[k - 1]) for order, k in steps])
    asked: dict[str, list] = {"kept": [], "removed": [], "fails": [], "unique_fails": []}
    for order, k in steps:
        before, f = order[: k - 1], order[k - 1]
        asked["kept"].append([PASS if x in order[:k] else ALL for x in FILTERS])
        asked["removed"].append([PASS if x in before else FAIL if x == f else ALL for x in FILTERS])
        asked["fails"].append([FAIL if x == f else ALL for x in FILTERS])
        asked["unique_fails"].append([FAIL if x == f else PASS for x in FILTERS])
    return steps, own, {k: np.array(v, np.int64) for k, v in asked.items()}


def contract(tables: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """``tables`` (..., 2, 2, 2, 2, 2) under ``chosen`` (steps, 5, 2): counts (..., steps)."""
    return np.einsum("...abcde,qa,qb,qc,qd,qe->...q", tables, *chosen.transpose(1, 0, 2), optimize=True)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part,
    each of the 120 orders and each of its five steps, zeros included.

    ``docs`` are (doc_id, text, lang), ``labels`` (doc_id, quality, toxic). A null text is an empty one: under 200 words,
    and a copy of any other empty or null text. A null language is the part of the empty string. A null doc_id counts as
    larger than any other and has no labels. Repeated rows count as often as they come, and rows of one doc_id are no
    copies of each other; of repeated labels one with a 1 suffices, null labels are none. Other columns are ignored. An
    empty table has no parts and gives no rows.
    """
    steps, own, asked = selectors()
    cells = contingency(docs, labels).groupBy("part").agg(F.collect_list(F.struct("cell", "n", "good", "toxic")).alias("cells"))  # 32 at most
    orders, places = pa.array([order for order, _ in steps]), pa.array([k for _, k in steps], pa.int32())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = batch.column(0)
        tables = np.zeros((len(parts), 3, 2 ** len(FILTERS)), np.int64)
        for p, some in enumerate(batch.column(1).to_pylist()):
            for c in some:
                tables[p, :, c["cell"]] = c["n"], c["good"], c["toxic"]
        tables = tables.reshape(len(parts), 3, *(2,) * len(FILTERS))
        removed = contract(tables, asked["removed"])
        fails = contract(tables[:, 0], asked["fails"])
        over_orders = np.stack([removed[:, 0, own == f].sum(1) for f in range(len(FILTERS))], 1)
        found = [contract(tables[:, 0], asked["kept"]), removed[:, 0], fails - removed[:, 0], contract(tables[:, 0], asked["unique_fails"]), removed[:, 1], removed[:, 2], over_orders[:, own]]
        at = pa.array(np.repeat(np.arange(len(parts)), len(steps)))
        columns = [parts.take(at), pa.concat_arrays([orders] * len(parts)), pa.concat_arrays([places] * len(parts)), *(pa.array(x.ravel()) for x in found)]
        return pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *COUNTS])

    return map_slices(cells, run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS), PARTS_AT_ONCE)
