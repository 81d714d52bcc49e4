import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
spm = pytest.importorskip("sentencepiece")

from sigloom.llm import sentences  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


def ids(t, text):
    return np.frombuffer(t.encode([text])[0], "<u4").tolist()


def unigram(seed=4, fallback=True, user=(), rule=None):
    """A small unigram model as bytes."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    rng, m = random.Random(seed), pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, fallback
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.escape_whitespaces, m.normalizer_spec.remove_extra_whitespaces = True, True, bool(rule)
    if rule:
        m.normalizer_spec.precompiled_charsmap = rule
    add = lambda piece, kind, score=0.0: m.pieces.add(piece=piece, type=kind, score=score)
    add("<unk>", 2), add("<s>", 3), add("</s>", 3)
    for u in user:
        add(u, 4)
    for p in ["▁", *"abcdefi", "ab", "abc", "bc", "cd", "▁a", "▁ab", "de", "def", "ef", "cde", "fa", "bcd", "fi"]:
        add(p, 1, -rng.uniform(2, 9) * (1 if len(p) == 1 else 1.3))
    if fallback:
        for b in range(256):
            add(f"<0x{b:02X}>", 6)
    return m.SerializeToString()


def test_encodes_and_decodes_like_the_library():
    own, t = spm.SentencePieceProcessor(model_file=PATH), sentences.Transducer(PATH)
    random.seed(2)
    texts = ["", " ", "  a  b", "\n\n x", " " * 40 + "x", "日本語 你好", "aaaaaaaa", "\x00\x01", "🙂 x", "int main() {\n    return 0;\n}", "x" * 3000, "'''...,,,;;;", "ab" * 60000]
    texts += ["".join(random.choice("the qu ickbrowns.\n$%&") for _ in range(300)) for _ in range(100)]
    for text, got in zip(texts, t.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == own.encode(text) == ids(t, text), text
        assert t.decode(got) == text


def test_the_pair_machine_agrees_with_merging():
    t, rng = sentences.Transducer(PATH), random.Random(3)
    pieces = [p for p, i in t.id.items() if len(p) == 1 or t.left[i] >= 0]
    pairs = [(rng.choice(pieces), rng.choice(pieces)) for _ in range(3000)] + [("▁▁", "▁x"), ("▁", "▁"), ("▁▁▁", "▁")]
    pairs = [(a, b) for a, b in pairs if a in t.id and b in t.id]
    a, b = (np.array([t.id[p[k]] for p in pairs]) for k in (0, 1))
    want = [t._merge(x + y) == [x, y] for x, y in pairs]
    assert t.pair_fits(a, b).tolist() == want == t._remembered(a, b).tolist() == t._remembered(a, b).tolist()


def test_shortest_paths_of_a_unigram_model():
    """Against the library, and against the least sum over all segmentations."""
    for fallback in (True, False):
        data, rng = unigram(fallback=fallback), random.Random(5)
        own, t = spm.SentencePieceProcessor(model_proto=data), sentences.Transducer(data)
        weight = {p: -t.score[i] for p, i in t.id.items()}
        for text in ["", "a", "zz", "az zb", "é", *("".join(rng.choice("abcdef z") for _ in range(rng.randrange(1, 14))) for _ in range(200))]:
            assert ids(t, text) == own.encode(text), text
            s = t.normalise(text)
            best = [0.0] + [float("inf")] * len(s)
            for end in range(1, len(s) + 1):
                best[end] = min(best[k] + weight.get(s[k:end], -t.score[t.stranger] if end - k == 1 else float("inf")) for k in range(end))
            place, symbol = t.shortest(np.frombuffer(s.encode("utf-32-le"), np.uint32), np.array([0])) if s else ([], [])
            assert sum(-t.score[x] for x in symbol) == pytest.approx(best[-1])


def test_user_pieces_and_character_maps():
    data = unigram(user=("<x>", "<xy>"))
    own, t = spm.SentencePieceProcessor(model_proto=data), sentences.Transducer(data)
    for text in ["<x>", "ab<x>cd", "a <xy><x> b", "<xyz>", "<", "x>ab<x"]:
        assert ids(t, text) == own.encode(text), text
    try:
        rule = spm.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto()
    except (AttributeError, TypeError, RuntimeError):
        pytest.skip("no normaliser rules in this build")
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(rule)
    data = unigram(rule=m.normalizer_spec.precompiled_charsmap)
    own, t = spm.SentencePieceProcessor(model_proto=data), sentences.Transducer(data)
    assert len(t.map) > 1000
    for text in ["ﬁ ａｂｃ", "  ab   cd ", "éf", "①②", "ab　cd", "plain def", "한글"]:
        assert ids(t, text) == own.encode(text), text


def test_memory_is_bounded(monkeypatch):
    own, t = spm.SentencePieceProcessor(model_file=PATH), sentences.Transducer(PATH)
    monkeypatch.setattr(sentences, "REMEMBERED", 2000)
    monkeypatch.setattr(sentences, "AT_ONCE", 50)
    for k in range(30):
        text = " ".join(f"word{k}x{j}" for j in range(40))
        assert ids(t, text) == own.encode(text)
        assert len(t.seen) < 200


def test_rows(spark):
    big = 9007199254740993
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "héllo wörld", 0), (3, "héllo wörld", 0), (big, "x", 0), (None, "x", 0)], "doc_id long, text string, n_ids int")
    got = sorted(sentences.encode_texts(docs.coalesce(1), PATH).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.n_ids > 0, r.round_trip) for r in got] == [(1, False, True), (2, False, True), (3, True, True), (3, True, True), (big, True, True), (None, True, True)]
    assert sentences.encode_texts(docs.limit(0), PATH).count() == 0
