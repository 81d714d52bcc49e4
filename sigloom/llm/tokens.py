"""Tokenizing whole texts inside tasks, by white-space chunks that a worker remembers."""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import kept, map_slices

#: Entries of a generation that a worker keeps. Two are held: what is met again moves to the younger one, the rest goes with
#: the older. So memory is bounded, and frequent words stay.
REMEMBERED = 250_000
#: Bytes of text that are split at once, about.
AT_ONCE = 2 << 20
#: Closing marks: a run of them is one piece to the tokenizer. Not the apostrophe, which begins pieces of letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space for both str.split and the tokenizer's pattern; other such characters take the whole-text path.
ODD_SPACE = re.compile("[\x1c-\x1f\x85]")
#: Latin-1 characters to those by which the tokenizer's vocabulary writes their bytes.
_HIDDEN = [b for b in range(256) if b <= 32 or 127 <= b <= 160 or b == 173]
LETTERS = {b: chr(256 + k) for k, b in enumerate(_HIDDEN)}


class ChunkEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    The tokenizer drops white space and none of its patterns or merges cross it, so a text's ids are those of
    its white-space chunks in turn. Chunks are split and numbered by Arrow; only the different ones of some texts become
    objects, and ids are gathered as arrays.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.model = self.own.model
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _rest(self, chunk: str) -> bytes:
        return array("I", self.own.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _known(self, chunk: str) -> bytes | None:
        ids = self.seen.get(chunk)
        if ids is None and (ids := self.older.pop(chunk, None)) is not None:
            self.seen[chunk] = ids
        return ids

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """A chunk of letters and closing marks is the lower-cased word and the marks; words are fewer than chunks. A lower-case
        word of letters is one piece, so it goes to the model without patterns."""
        seen, known, tokenize, out = self.seen, self._known, self.model.tokenize, []
        for w in chunks:
            core = w.rstrip(MARKS)
            low = core.lower()
            if core.isalpha() and (core.isascii() or low.isalpha() and "\u03a3" not in core and unicodedata.is_normalized("NFC", core)):
                ids = known(low) if low is not w else None
                if ids is None:
                    shown = low if low.isascii() else low.encode().decode("latin-1").translate(LETTERS)
                    ids = seen[low] = array("I", [t.id for t in tokenize(shown)]).tobytes()
                if len(core) < len(w):
                    mark = w[len(core) :]
                    end = known(mark)
                    if end is None:
                        end = seen[mark] = self._rest(mark)
                    ids += end
            else:
                ids = self._rest(w)
            seen[w] = ids
            out.append(ids)
        return out

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        if len(self.seen) > REMEMBERED:
            self.seen, self.older = {}, self.seen
        found = list(map(self.seen.get, chunks))
        for k in [k for k, ids in enumerate(found) if ids is None]:
            found[k] = self.older.pop(chunks[k], None)
            if found[k] is not None:
                self.seen[chunks[k]] = found[k]
        new = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(new, self._learn([chunks[k] for k in new])):
            found[k] = ids
        return found

    def _parts(self, texts: pa.Array) -> Iterator[pa.Array]:
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        at = np.cumsum(sizes, dtype=np.int64) // AT_ONCE
        edges = np.flatnonzero(np.diff(at, prepend=-1)).tolist() + [len(texts)]
        for lo, hi in zip(edges, edges[1:]):
            yield texts.slice(lo, hi - lo)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text; there are no null ones."""
        out: list[bytes] = []
        for part in self._parts(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())):
            lists = pc.utf8_split_whitespace(part)
            coded = lists.flatten().dictionary_encode()
            found = self._chunks(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            flat, begin, which = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes, coded.indices.to_numpy()
            n = sizes[which]
            ends = np.concatenate(([0], np.cumsum(n)))
            ids = flat[np.repeat(begin[which] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
            cuts = ends[np.cumsum(np.concatenate(([0], lists.value_lengths().to_numpy())))] * 4
            made = [ids[lo:hi] for lo, hi in zip(cuts.tolist(), cuts[1:].tolist())]
            for k in np.flatnonzero(pc.match_substring_regex(part, ODD_SPACE.pattern).to_numpy(zero_copy_only=False)).tolist():
                made[k] = self._rest(part[k].as_py())
            out += made
        return out


def encoder(path: str) -> ChunkEncoder:
    held = kept("tokens")
    if path not in held:
        held[path] = ChunkEncoder(path)
    return held[path]


def token_pieces(docs: DataFrame, path: str, size: int, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]) of every text (null: empty) and its end id 0.

    Only texts of more than ``size`` ids are cut, into pieces of ``size`` and a last shorter one. Null ids stay null;
    repeated rows each return; other columns are ignored; an empty table gives no rows.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    step = size * 4

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        every = [ids + b"\0\0\0\0" for ids in encoder(path).encode(batch.column(1))]
        row = [k for k, ids in enumerate(every) for _ in range(0, len(ids), step)]
        at = [lo for ids in every for lo in range(0, len(ids), step)]
        parts = [every[k][lo : lo + step] for k, lo in zip(row, at)]
        columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array([lo // step for lo in at], pa.int32()), pa.array([lo // 4 for lo in at], pa.int64()),
                   pa.array([len(x) // 4 for x in parts], pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64()), *[pa.array(parts, pa.binary())] * with_ids]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return map_slices(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), cut, schema)
