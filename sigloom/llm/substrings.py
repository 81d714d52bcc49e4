"""Repeated passages by seed and extend: documents meet on winnowed anchors, matches are extended both ways.

A window is ``length`` consecutive words. Of the ``SEED``-word grams in a window the one of the least hash is its anchor,
so equal windows have equal anchors at equal places, and few places of a text are anchors. Consecutive windows with the same
anchor are a run; the words that it spans are all that the anchor can be extended to within windows of its own. Documents
are joined on anchors that have a smaller document, and extended from them:

* A span that a smaller document has around the same anchor is a match as a whole, at its full extent both ways.
* The smallest document of each span, where its anchor has other spans too, is extended word by word: for each number
  of words to the left, with the words to the right that the length still needs, one key says what lies there, and the
  smallest document with that key has the match.

A document's matches that touch are one maximal repeat. Groups of copies cost what their rows cost: a hot anchor is
never expanded to pairs of its documents, but to keys whose least document is found map-side. Spans and keys are told
by 128 bits of two polynomial hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import join_counted, map_slices, small_batches, word_blocks
from sigloom.scratch import mark, release, table

#: Words of a window, those of a gram that may be its anchor, and windows that are winnowed at once.
LENGTH, SEED, AT_ONCE = 50, 10, 1 << 16
#: Rows of texts that a worker turns into objects at once.
ROWS = 64
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose high bits depend on all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: bytes) -> np.ndarray:
    """XXH64 of each word of the whole text."""
    import xxhash

    return np.concatenate([np.empty(0, _U), *(np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words)) for words in word_blocks(text))])


class Polynomial:
    """Hashes of stretches of words, modulo 2^64: the sum of each word times the base to the power of its place."""

    def __init__(self, base: int, most: int = AT_ONCE + 2 * LENGTH):
        self.base, self.most = base, 0
        self._reach(most)

    def _reach(self, most: int) -> None:
        if most > self.most:
            self.most = most
            with np.errstate(over="ignore"):
                self.up, self.down = (np.concatenate(([_U(1)], np.cumprod(np.full(most, b, _U)))) for b in (_U(self.base), _U(pow(self.base, -1, 1 << 64))))

    def sums(self, words: np.ndarray) -> np.ndarray:
        self._reach(len(words))
        return np.concatenate(([_U(0)], np.cumsum(words * self.up[: len(words)], dtype=_U)))

    def stretch(self, sums: np.ndarray, start: np.ndarray, words: np.ndarray | int) -> np.ndarray:
        """Of the ``words`` words from each ``start``."""
        return (sums[start + words] - sums[start]) * self.down[start]


_ONE, _TWO = Polynomial(0x9E3779B97F4A7C15), Polynomial(0xC2B2AE3D27D4EB4F)


def least(x: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its least, the leftmost of equal ones."""
    best, span = np.arange(len(x)), 1
    while span < width:
        step = min(span, width - span)
        a, b = best[:-step], best[step:]
        best, span = np.where(x[a] <= x[b], a, b), span + step
    return best


def runs(words: np.ndarray, length: int = LENGTH, seed: int = SEED) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, windows, anchor, one, two) of each run of windows with the same anchor: its first window, their number, the
    hash of its anchor and those of all words that it spans. Arrays of bounded size, one after the other; where they end
    a run may be in two parts."""
    for at in range(0, len(words) - length + 1, AT_ONCE):
        some = words[at : at + AT_ONCE + length - 1]
        one, two = _ONE.sums(some), _TWO.sums(mixed(some))
        grams = mixed(_ONE.stretch(one, np.arange(len(some) - seed + 1), seed))
        place = least(grams, length - seed + 1)
        start = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        windows = np.diff(np.concatenate((start, [len(place)])))
        spanned = windows + length - 1
        yield start + at, windows, grams[place[start]], _ONE.stretch(one, start, spanned) + spanned.astype(_U), _TWO.stretch(two, start, spanned)


def extensions(words: np.ndarray, start: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(first word, one, two) for every window of the given runs: where it starts and the hashes of its words."""
    out = []
    for lo, n in zip(start.tolist(), windows.tolist()):
        some = words[lo : lo + n + length - 1]
        at = np.arange(n)
        out.append((at + lo, _ONE.stretch(_ONE.sums(some), at, length), _TWO.stretch(_TWO.sums(mixed(some)), at, length)))
    kinds = np.int64, _U, _U
    return tuple(np.concatenate([np.empty(0, kind), *[o[k] for o in out]]) for k, kind in enumerate(kinds))


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, text_key, text): a null id is the largest long, a null text an empty one; rows of one id and text are alike."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64("text").alias("text_key"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _flat(batch: pa.RecordBatch, found: list[list[tuple[np.ndarray, ...]]], names: list[str]) -> pa.RecordBatch:
    """The arrays found for each row of ``batch``, one below the other, behind the row's id and key."""
    at = pa.array(np.repeat(np.arange(len(found)), [sum(len(x[0]) for x in own) for own in found]).astype(np.int64))
    parts = [x for own in found for x in own]
    columns = [_signed(np.concatenate([x[k] for x in parts])) if parts else pa.array([], pa.int64()) for k in range(len(names))]
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], ["id", "text_key", *names])


def anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, text_key, start, windows, anchor, one, two): the runs of every text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [list(runs(word_hashes(t), length)) for t in batch.column(2).to_pylist()]
        return _flat(batch, found, ["start", "windows", "anchor", "one", "two"])

    return map_slices(_keyed(docs), run, "id long, text_key long, start long, windows long, anchor long, one long, two long", ROWS)


def _matches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (a table) whose ``keys`` have several ids, with ``first``, the least of them."""
    ids = rows.groupBy(*keys).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    return join_counted(rows, table(ids.where("first < last")), keys, "n").drop("last", "n")


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, text_key, found): for each text that has any, the stretches of words (start, end) in windows of ``length``
    words that start in a document with a smaller id too; ``found`` is not yet sorted or merged.

    ``text_key`` is the text's xxhash64. Windows are of one document. See ``drop_repeats`` for nulls and repeated rows.
    """
    spark = docs.sparkSession
    since = mark(spark)
    with small_batches(spark):
        every = table(anchors(docs, length))
    ids = every.groupBy("anchor").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"), ((F.min("one") < F.max("one")) | (F.min("two") < F.max("two"))).alias("several"))
    seeds = table(ids.where("first < last").select("anchor", "n", "several"))
    joined = table(join_counted(every, seeds, ["anchor"], "n").select("id", "text_key", "start", "windows", "one", "two", "several"))
    spans = table(joined.groupBy("one", "two").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    known = table(join_counted(joined, spans, ["one", "two"], "n"))
    whole = known.where("first < id").select("id", "text_key", "start", (F.col("start") + F.col("windows") + (length - 1)).alias("end"))
    open_ = known.where("first = id AND several").groupBy("id", "text_key").agg(F.collect_set(F.struct("start", "windows")).alias("runs"))

    def extend(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text, some in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            at = np.array([(r["start"], r["windows"]) for r in some], np.int64)
            found.append([extensions(word_hashes(text), at[:, 0], at[:, 1], length)])
        return _flat(batch, found, ["start", "one", "two"])

    with small_batches(spark):
        wide = table(map_slices(_keyed(docs).join(open_, ["id", "text_key"]), extend, "id long, text_key long, start long, one long, two long", ROWS))
    grown = _matches(wide, ["one", "two"]).where("first < id").select("id", "text_key", "start", (F.col("start") + length).alias("end"))
    found = table(whole.unionByName(grown).groupBy("id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("found")))
    release(spark, since, keep=1)
    return found


def maximal(found: list[dict] | None) -> list[tuple[int, int]]:
    """Stretches in turn, those that touch or overlap merged."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((f["start"], f["end"]) for f in found or []):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def kept_words(text: bytes, cuts: list[tuple[int, int]]) -> Iterator[list[bytes]]:
    """The text's words outside of ``cuts``, block by block."""
    at, k = 0, 0
    for words in word_blocks(text):
        kept, own, end = [], at, at + len(words)
        while k < len(cuts) and cuts[k][0] < end:
            lo, hi = cuts[k]
            kept += words[own - at : max(own, lo) - at]
            own = min(max(own, hi), end)
            if hi > end:
                break
            k += 1
        kept += words[own - at :]
        at = end
        yield kept


def _with_repeats(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` with ``_sg_found``, the repeats of each row's text."""
    found = repeats(docs, length).select(F.col("id").alias("_sg_id"), F.col("text_key").alias("_sg_key"), F.col("found").alias("_sg_found"))
    keyed = docs.withColumns({"_sg_own": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "_sg_hash": F.xxhash64("text")})
    return keyed.join(found, (F.col("_sg_own") == F.col("_sg_id")) & (F.col("_sg_hash") == F.col("_sg_key")), "left").drop("_sg_id", "_sg_key", "_sg_own", "_sg_hash")


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without the words that lie in a window of ``length`` words which also starts in a document with a smaller
    doc_id; in texts that lose words the others are joined by one space. All columns and rows stay.

    A null or empty text has no words and stays as it is. A null doc_id counts as larger than any other, so such a row loses
    what another has, and no one loses anything to it. Rows of one doc_id lose nothing to each other, be they repeated or of
    different texts. Columns of any name are kept. An empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        place = batch.schema.names.index("text")
        texts = []
        for text, found in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            texts.append(b" ".join(w for words in kept_words(text.encode(), maximal(found)) for w in words).decode() if found else text)
        columns = [pa.array(texts, pa.string()) if k == place else batch.column(k) for k in range(batch.num_columns - 1)]
        return pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return map_slices(_with_repeats(docs, length), run, docs.schema, ROWS)


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs`` (doc_id, text): its words, those that
    ``drop_repeats`` removes, and the SHA-256 of the others joined by one space. Nulls, empty texts, ties, repeated rows and
    clashing names as there; null and empty texts have no words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, digests = [], [], []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            cuts = maximal(found)
            digest, kept = hashlib.sha256(), 0
            for words in kept_words(text or b"", cuts):
                if words:
                    digest.update((b" " if kept else b"") + b" ".join(words))
                    kept += len(words)
            removed = sum(hi - lo for lo, hi in cuts)
            n_words.append(kept + removed)
            n_removed.append(removed)
            digests.append(digest.hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _with_repeats(docs.select("doc_id", "text"), length).select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), "_sg_found")
    return map_slices(rows, run, "doc_id long, n_words long, n_removed long, kept_sha256 string", ROWS)
