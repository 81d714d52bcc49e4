import array
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from sigloom.llm import packing, tokens  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "Hello, world! it's 2024.", "Ünïcode é́ ΣΑΣ straße 日本語", "a\x1cb\x85c d", "<|endoftext|> x", "don't we'll I'd", "word " * 3000, "\n\t ", "é", "İstanbul"]


def test_chunks_encode_like_the_tokenizer():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    random.seed(1)
    texts = TEXTS + ["".join(random.choice("aB é.,;'0́\n你ſ") for _ in range(80)) for _ in range(200)]
    got = tokens.ChunkEncoder(PATH).encode(texts)
    assert got == [array.array("I", own.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_configurations_serve_the_need_and_are_close_to_best_fit(seed):
    rng = np.random.default_rng(seed)
    need = np.zeros(129, np.int64)
    for x in rng.integers(1, 129, 400):
        need[x] += 1
    plan = packing.configurations(need, 128)
    served = np.zeros(129, np.int64)
    for config, n in plan.items():
        assert sum(config) <= 128
        for x in config:
            served[x] += n
    assert (served == need).all()
    least = -(-int((need * np.arange(129)).sum()) // 128)
    assert sum(plan.values()) <= max(least, sum(packing.best_fit(need, 128).values())) + 2


def test_pack_documents(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (99, None), (None, "x y"), (9007199254740993, "x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").coalesce(1)
    got = packing.pack_documents(docs, PATH, 64).collect()
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_seq.values():
        at = 0
        for off, n in sorted(spans):
            assert off == at
            at += n
        assert at <= 64
    enc = tokens.ChunkEncoder(PATH)
    want = []
    for i, t in rows:
        ids = enc.encode([t or ""])[0] + b"\0\0\0\0"
        want += [(i, k, a // 4, len(ids[a : a + 256]) // 4, zlib.crc32(ids[a : a + 256])) for k, a in enumerate(range(0, len(ids), 256))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    assert packing.pack_documents(docs.limit(0), PATH, 64).count() == 0


def test_words_are_remembered_in_two_bounded_generations(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    enc, want = tokens.ChunkEncoder(PATH), tokens.ChunkEncoder(PATH).own
    for k in range(40):
        texts = [f"often again*** {a}{chr(97 + k % 26)}{chr(97 + k // 26)}x$$$" for a in "abcdefgh"]
        assert enc.encode(texts) == [array.array("I", want.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
        assert len(enc.seen) + len(enc.older) <= 2 * (50 + 24) and ("often" in enc.seen or "often" in enc.older)


def test_marks_behind_a_word_need_no_pattern_each():
    enc, asked = tokens.ChunkEncoder(PATH), []
    rest = enc._rest
    enc._rest = lambda chunk: asked.append(chunk) or rest(chunk)
    enc.encode(["Word### word### other### Other.*** word.***"])
    assert sorted(asked) == ["###", ".***"]
