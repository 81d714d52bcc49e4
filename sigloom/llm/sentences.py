"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled into machines, held as arrays:

* the normaliser maps characters (the longest source first), escapes spaces and puts one in front;
* the lexicon is a trie of pieces; from any place of an input it leads to every piece that begins there, and to the
  byte fallback of the character there;
* the pair machine of a BPE model reads two pieces in turn. Its weight is 0 if no merge across their border comes before
  those that made them, and infinity otherwise.

Inputs composed with the lexicon are a lattice: arcs from place to place that carry a piece. Arcs are relaxed in the
tropical semiring, (min, +), one level of places after the other and many inputs at once. A unigram piece weighs its
negative score. In a BPE model an arc's weight is that of the pair machine in the state that the place was reached in:
exactly one path of finite weight then reaches each place, and it is what merging yields. A pair of characters that no
piece holds is a cut, so the stretches between are inputs of their own.
"""

from __future__ import annotations

import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import map_slices

SPACE = "▁"
#: Bytes of encoded chunks that a worker remembers, about, and characters that are composed at once.
REMEMBERED, AT_ONCE = 128 << 20, 1 << 21
#: Slots of the pair machine's memory, a power of two.
SLOTS = 1 << 20
# Kinds of pieces in a model file, and how much lower than the least score an unknown character is.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
NEVER = float("-inf")
_workers: dict = {}


def character_map(blob: bytes) -> dict[str, str]:
    """Sources and replacements of a normaliser's table: a double-array trie of UTF-8 bytes, then its texts."""
    if not blob:
        return {}
    size = struct.unpack("<I", blob[:4])[0]
    units, texts = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    found, sources, at = {}, [b""], np.array([offset(units[0])])
    every = np.arange(1, 256)
    while len(at):
        places = at[:, None] ^ every
        inside = places < len(units)
        unit = units[np.where(inside, places, 0)]
        row, byte = np.nonzero(inside & ((unit & 0x800000FF) == every))
        unit, place = unit[row, byte], places[row, byte]
        sources = [sources[r] + bytes([b + 1]) for r, b in zip(row.tolist(), byte.tolist())]
        at = place ^ offset(unit)
        for k in np.flatnonzero(unit >> 8 & 1).tolist():
            text = int(units[at[k]] & 0x7FFFFFFF)
            found[sources[k].decode()] = texts[text : texts.index(b"\0", text)].decode()
    return found


class Transducer:
    """The machines of a model file (a path, or its bytes)."""

    def __init__(self, model: str | bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        if isinstance(model, str):
            with open(model, "rb") as f:
                model = f.read()
        proto.ParseFromString(model)
        rule, pieces = proto.normalizer_spec, proto.pieces
        if any(p.type == UNUSED for p in pieces) or proto.trainer_spec.model_type not in (1, 2) or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("unigram and BPE models without unused pieces and with spaces in front only")
        self.bpe, self.prefix, self.squeeze, self.escape = proto.trainer_spec.model_type == 2, rule.add_dummy_prefix, rule.remove_extra_whitespaces, rule.escape_whitespaces
        self.map = character_map(rule.precompiled_charsmap)
        self.starts, self.longest = {s[0] for s in self.map}, max(map(len, self.map), default=0)
        self.unknown = next(i for i, p in enumerate(pieces) if p.type == UNKNOWN)
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(pieces) if p.type == BYTE}
        self.text = [b"" if p.type in (UNKNOWN, CONTROL) else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() for p in pieces]
        self.text[self.unknown] = proto.trainer_spec.unk_surface.encode() if not self.byte else b""
        users = sorted((p.piece for p in pieces if p.type == USER), key=len, reverse=True)
        self.user = {p.piece: struct.pack("<I", i) for i, p in enumerate(pieces) if p.type == USER}
        self.apart = re.compile("(" + "|".join(map(re.escape, users)) + ")") if users else None
        self.id = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        self._compile([p.score for p in pieces])
        whole = any(re.search(f"[^{SPACE}]{SPACE}|\n.|.\n", p) for p in self.id) or not self.escape
        self.chunks = re.compile("(?s).+" if whole else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.seen: dict[str, bytes] = {}
        self.held = 0

    # ---- compiling ----------------------------------------------------------------------------------------------

    def _compile(self, score: list[float]) -> None:
        """Symbols are piece ids, then single characters that are no pieces, then the unknown character."""
        chars = sorted(set().union(*self.id))
        symbols = dict(self.id) | {c: len(score) + k for k, c in enumerate(c for c in chars if c not in self.id)}
        self.pieces = len(score)
        self.size = max([self.pieces, *symbols.values()]) + 2
        self.stranger = self.size - 1
        self.length = np.ones(self.size, np.int64)
        least = min((score[i] for i in self.id.values()), default=0.0) - UNKNOWN_PENALTY
        self.score = np.full(self.size, least)
        self.run = np.zeros(self.size, bool)  # symbols with two spaces in turn: they share a score
        self.first, self.last = np.zeros(self.size, bool), np.zeros(self.size, bool)
        self.name = {i: p for p, i in symbols.items()}
        for p, i in symbols.items():
            self.length[i], self.run[i], self.first[i], self.last[i] = len(p), SPACE * 2 in p, p[0] == SPACE, p[-1] == SPACE
            if i < len(score):
                self.score[i] = score[i]
        self.left, self.right = np.full(self.size, -1), np.full(self.size, -1)
        if self.bpe:
            for p in [p for p in self.id if len(p) > 1]:
                parts = self._merge(p, 2)
                if len(parts) == 2 and "".join(parts) == p:
                    self.left[self.id[p]], self.right[self.id[p]] = symbols[parts[0]], symbols[parts[1]]
        joins = sorted((symbols[p[:k]] * self.size + symbols[p[k:]], i) for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        self.join_key, self.join = np.array([k for k, _ in joins], np.int64), np.array([i for _, i in joins], np.int64)
        self.known, self.fit = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        self._trie({p: i for p, i in symbols.items() if len(p) == 1 or not self.bpe or self.left[i] >= 0}, chars)

    def _trie(self, entries: dict[str, int], chars: list[str]) -> None:
        self.kind = np.zeros(0x110000, np.int32)  # of a character: 0 if no piece has it
        self.kinds = len(chars) + 1
        for k, c in enumerate(chars):
            self.kind[ord(c)] = k + 1
        kind = {c: k + 1 for k, c in enumerate(chars)}
        edges: dict[tuple[int, int], int] = {}
        ends, pairs = {}, set()
        for p, i in entries.items():
            at = 0
            for c in p:
                at = edges.setdefault((at, kind[c]), len(edges) + 1)
            ends[at] = i
        for p in self.id:
            pairs |= {kind[x] * self.kinds + kind[y] for x, y in zip(p, p[1:])}
        keys = sorted((a * self.kinds + k, b) for (a, k), b in edges.items())
        self.edge, self.target = np.array([k for k, _ in keys], np.int64), np.array([b for _, b in keys], np.int64)
        self.end = np.full(len(edges) + 1, -1)
        self.end[list(ends)] = list(ends.values())
        self.pair = np.array(sorted(pairs), np.int64)

    def _merge(self, text: str, stop: int = 1) -> list[str]:
        """The symbols of ``text`` after merging the best-scored neighbours, the leftmost of equals first."""
        parts = list(text)
        while len(parts) > stop:
            best = max(((self.score[i], -k) for k in range(len(parts) - 1) if (i := self.id.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray | None, wanted: np.ndarray) -> np.ndarray:
        """The values of sorted ``keys``, -1 where there is none; without values, whether there is one."""
        if not len(keys):
            return np.full(len(wanted), -1) if values is not None else np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        there = keys[at] == wanted
        return there if values is None else np.where(there, values[at], -1)

    # ---- the pair machine ---------------------------------------------------------------------------------------

    def pair_fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pair machine accepts each a, b: the later of the two last merges is undone, again and again, and no
        merge of what then meets at the border may come before it. At equal scores the leftmost merge comes first."""
        ok, rows, x, y = np.ones(len(a), bool), np.arange(len(a)), a.copy(), b.copy()
        left, right = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(rows):
            joined = self._find(self.join_key, self.join, x * self.size + y)
            bad = (joined >= 0) & (self.score[joined] > left) & (self.score[joined] >= right)
            ok[rows[bad]] = False
            one, two = self.right[x], self.left[y]
            on = ~bad & ((one >= 0) | (two >= 0))
            rows, x, y, left, right, one, two = rows[on], x[on], y[on], left[on], right[on], one[on], two[on]
            undo = (two < 0) | ((one >= 0) & (self.score[x] < self.score[y]))
            left, right = np.where(undo, self.score[x], left), np.where(undo, right, self.score[y])
            x, y = np.where(undo, one, x), np.where(undo, y, two)
        for k in np.flatnonzero(self.run[a] | self.run[b] | (self.last[a] & self.first[b])).tolist():
            one, two = self.name.get(int(a[k])), self.name.get(int(b[k]))
            ok[k] = one is None or two is None or self._merge(one + two) == [one, two]
        return ok

    def _remembered(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``pair_fits`` through a memory of bounded size."""
        key = a * self.size + b
        slot = ((key * np.int64(0x9E3779B97F4A7C1)) >> 32) & (SLOTS - 1)
        new = self.known[slot] != key
        out = self.fit[slot]
        if new.any():
            fresh, back = np.unique(key[new], return_inverse=True)
            fits = self.pair_fits(fresh // self.size, fresh % self.size)
            out[new] = fits[back]
            self.known[slot[new]], self.fit[slot[new]] = key[new], out[new]
        return out

    # ---- composition and shortest path --------------------------------------------------------------------------

    def arcs(self, kind: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, symbol) of every arc: a walk of the trie from all places at once. ``room`` is how far one may go."""
        place, state = np.arange(len(kind)), self._find(self.edge, self.target, kind.astype(np.int64))
        single = np.where(state >= 0, self.end[state], -1)
        places, symbols, step = [place], [np.where(single >= 0, single, self.stranger)], 1
        while True:
            on = (state >= 0) & (room[place] > step)
            place, state = place[on], state[on]
            if not len(place):
                return np.concatenate(places), np.concatenate(symbols)
            state = self._find(self.edge, self.target, state * self.kinds + kind[place + step])
            done = np.where(state >= 0, self.end[state], -1)
            places.append(place[done >= 0])
            symbols.append(done[done >= 0])
            step += 1

    def shortest(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, symbol) of the arcs on the shortest paths of the inputs that begin at ``starts``, in order."""
        kind = self.kind[codes]
        cut = ~self._find(self.pair, None, kind[:-1].astype(np.int64) * self.kinds + kind[1:])
        cut[starts[1:] - 1] = True
        starts = np.concatenate(([0], np.flatnonzero(cut) + 1))
        sizes = np.diff(np.append(starts, len(codes)))
        own = np.repeat(np.arange(len(starts)), sizes)
        level = np.arange(len(codes)) - starts[own]
        place, symbol = self.arcs(kind, sizes[own] - level)
        order = np.argsort(level[place], kind="stable")
        place, symbol = place[order], symbol[order]
        begin = place + own[place]  # an input has one more node than characters
        end, node = begin + self.length[symbol], np.full(len(codes) + len(starts), -1)
        cost = np.full(len(node), np.inf)
        cost[starts + np.arange(len(starts))] = 0
        bounds = np.searchsorted(level[place], np.arange(int(sizes.max()) + 1))
        for k, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            b, e, s = begin[lo:hi], end[lo:hi], symbol[lo:hi]
            if not self.bpe:
                through = cost[b] - self.score[s]
            elif k == 0:
                through = cost[b]
            else:
                through = np.where(self._remembered(node[b], s), cost[b], np.inf)
            better = through < cost[e]
            cost[e[better]], node[e[better]] = through[better], s[better]
        at, first, taken, symbols = starts + sizes + np.arange(len(starts)), starts + np.arange(len(starts)), [], []
        while len(at):
            s = node[at]
            at = at - self.length[s]
            taken.append(at)
            symbols.append(s)
            on = at > first
            at, first = at[on], first[on]
        taken, symbols = np.concatenate(taken), np.concatenate(symbols)
        order = np.argsort(taken, kind="stable")
        taken, symbols = taken[order], symbols[order]
        owner = np.searchsorted(starts + np.arange(len(starts)), taken, "right") - 1
        return taken - owner, symbols

    def compose(self, inputs: list[str]) -> list[bytes]:
        """Ids of each input, little-endian unsigned 32-bit."""
        out, lo = [], 0
        while lo < len(inputs):
            hi, n = lo + 1, len(inputs[lo])
            while hi < len(inputs) and n + len(inputs[hi]) <= AT_ONCE:
                n += len(inputs[hi])
                hi += 1
            part, lo = inputs[lo:hi], hi
            codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
            starts = np.concatenate(([0], np.cumsum([len(x) for x in part])))
            place, symbol = self.shortest(codes, starts[:-1])
            odd = symbol >= self.pieces
            if odd.any():  # the byte fallback of characters that are no pieces
                ids = [[s] if not o else self._fallback(chr(codes[p])) for s, o, p in zip(symbol.tolist(), odd.tolist(), place.tolist())]
                place = np.repeat(place, [len(x) for x in ids])
                symbol = np.array(list(chain.from_iterable(ids)))
            flat, bounds = symbol.astype("<u4"), np.searchsorted(place, starts).tolist()
            out += [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        return out

    def _fallback(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    # ---- texts --------------------------------------------------------------------------------------------------

    def _mapped(self, text: str) -> str:
        """``text`` with the longest source at each place replaced."""
        if self.starts.isdisjoint(text):
            return text
        out, at = [], 0
        while at < len(text):
            size = 0
            if text[at] in self.starts:
                size = next((n for n in range(min(self.longest, len(text) - at), 0, -1) if text[at : at + n] in self.map), 0)
            out.append(self.map[text[at : at + size]] if size else text[at])
            at += size or 1
        return "".join(out)

    def normalise(self, text: str) -> str:
        if self.map:
            parts = self.apart.split(text) if self.apart else [text]
            text = "".join(p if k % 2 else self._mapped(p) for k, p in enumerate(parts))
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        text = (" " if self.prefix and text else "") + text
        return text.replace(" ", SPACE) if self.escape else text

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        parts = []
        for text in texts:
            text = self.normalise(text)
            each = self.apart.split(text) if self.apart else [text]
            parts.append([x for k, p in enumerate(each) for x in ([p] if k % 2 else self.chunks.findall(p))])
        if self.held > REMEMBERED:
            self.seen.clear()
            self.held = 0
        new = list(set(chain.from_iterable(parts)).difference(self.seen, self.user))
        if new:
            found = self.compose(new)
            self.seen.update(zip(new, found))
            self.held += sum(len(c) + len(x) + 150 for c, x in zip(new, found))
        seen = self.seen | self.user if self.user else self.seen
        out = [b"".join(map(seen.__getitem__, p)) for p in parts]
        return out if self.byte else [self._one_unknown(x) for x in out]

    def _one_unknown(self, ids: bytes) -> bytes:
        """Unknown characters in turn are one id."""
        flat = np.frombuffer(ids, "<u4")
        stays = np.ones(len(flat), bool)
        stays[1:] = (flat[1:] != self.unknown) | (flat[:-1] != self.unknown)
        return flat[stays].tobytes()

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def transducer(path: str) -> Transducer:
    if path not in _workers:
        _workers[path] = Transducer(path)
    return _workers[path]


def encode_texts(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, n_bytes, decoded_crc32, round_trip[, ids]) of every whole text.

    ``ids_crc32`` is of the little-endian unsigned 32-bit ids; ``n_bytes`` counts byte-fallback ids; ``decoded_crc32``
    is of the decoded text's UTF-8; ``round_trip`` tells whether it is the text. Null and empty texts have no ids; null
    doc_ids stay null; repeated rows each return; other columns are ignored; an empty table gives no rows.
    """
    kinds = {"n_ids": ("long", pa.int64()), "ids_crc32": ("long", pa.int64()), "n_bytes": ("long", pa.int64()), "decoded_crc32": ("long", pa.int64()), "round_trip": ("boolean", pa.bool_())}
    kinds |= {"ids": ("binary", pa.binary())} if with_ids else {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t, texts, rows = transducer(model_path), batch.column(1).to_pylist(), []
        fallback = np.zeros(len(t.text), bool)
        fallback[list(t.byte.values())] = True
        for text, ids in zip(texts, t.encode(texts)):
            back = t.decode(ids)
            rows.append((len(ids) // 4, zlib.crc32(ids), int(fallback[np.frombuffer(ids, "<u4")].sum()), zlib.crc32(back.encode()), back == text, *[ids] * with_ids))
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, kind) for x, (_, kind) in zip(zip(*rows), kinds.values())]], ["doc_id", *kinds])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return map_slices(rows, run, "doc_id long, " + ", ".join(f"{c} {k}" for c, (k, _) in kinds.items()))
