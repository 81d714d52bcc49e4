import hashlib
import random
import re

import numpy as np
import pytest

from sigloom.llm import substrings


def plain(docs, length):
    """[(doc_id, words, removed, digest)] by every window of every document."""
    rank = lambda d: 2**63 - 1 if d is None else d
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    first = {}
    for d, words in split:
        for k in range(len(words) - length + 1):
            key = tuple(words[k : k + length])
            first[key] = min(first.get(key, rank(d)), rank(d))
    out = []
    for d, words in split:
        gone = set()
        for k in range(len(words) - length + 1):
            if first[tuple(words[k : k + length])] < rank(d):
                gone.update(range(k, k + length))
        out.append((d, len(words), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, length):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "the", "É", "x y", f"w{rng.randrange(60)}", f"w{rng.randrange(10_000)}"])
    some = lambda n: [word() for _ in range(n)]
    passages = [some(rng.randrange(length - 4, 3 * length)) for _ in range(8)] + [["la"] * (2 * length), ["a", "b"] * length]
    docs = []
    for k in range(60):
        words = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(passages)
            lo = rng.randrange(len(p) // 2)
            words += rng.choice([some(rng.randrange(30)), p, p[lo:], p[: len(p) - lo]])
        docs.append((rng.choice([None, k, k // 2, 5]), rng.choice([" ", "\n", "\t "]).join(words)))
    return docs + docs[:4] + [(None, None), (3, None), (7, ""), (8, " \n")]


def report(spark, docs, length):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, found string, start int").repartition(3)
    return sorted((tuple(r) for r in substrings.repeat_report(df, length).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_passages_match_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(substrings, "AT_ONCE", 64)  # long texts end blocks within passages
    monkeypatch.setattr(substrings, "SEED", 4)
    docs = corpus(seed, 12)
    want = plain(docs, 12)
    assert report(spark, docs, 12) == want and sum(r[2] for r in want) > 100


def test_production_length_with_copies_and_edges(spark):
    rng = random.Random(9)
    some = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    passage, other = some(80), some(49)
    docs = [(k, " ".join(some(rng.randrange(40)) + passage[k % 3 : 80 - k % 5] + some(20))) for k in range(50)]
    docs += [(100 + k, " ".join(other + some(5))) for k in range(4)] + [(200 + k, " ".join(passage[:50])) for k in range(3)]
    docs += [(300, " ".join(passage[:49])), (301, " ".join(some(100_000) + passage)), (302, "é " * 120), (303, "é " * 60)]
    docs += [(k, docs[5][1]) for k in range(400, 460)]
    want = plain(docs, 50)
    assert report(spark, docs, 50) == want and {r[0]: r[2] for r in want}[201] == 50 and {r[0]: r[2] for r in want}[300] == 0


def test_texts_are_cut(spark):
    p = " ".join(f"p{k}" for k in range(60))
    docs = [(1, f"one {p} two"), (2, f"three {p}\nfour"), (3, "kept  as\tit is"), (4, None), (5, p)]
    df = spark.createDataFrame([(*d, [k]) for k, d in enumerate(docs)], "doc_id long, text string, id array<int>")
    got = {r.doc_id: (r.text, r.id) for r in substrings.drop_repeats(df).collect()}
    assert got == {1: (docs[0][1], [0]), 2: ("three four", [1]), 3: ("kept  as\tit is", [2]), 4: (None, [3]), 5: ("", [4])}
    assert substrings.drop_repeats(df).columns == df.columns
    none = df.limit(0)
    assert substrings.drop_repeats(none).count() == 0 and substrings.repeat_report(none).count() == 0


def test_runs_hold_each_window_once_and_meet_at_equal_anchors(monkeypatch):
    monkeypatch.setattr(substrings, "AT_ONCE", 100)
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (777, 300))
    b[100:160] = a[500:560]
    found = [[np.concatenate(x) for x in zip(*substrings.runs(w))] for w in (a, b)]
    for w, (start, windows, *_) in zip((a, b), found):
        assert np.concatenate([np.arange(s, s + n) for s, n in zip(start, windows)]).tolist() == list(range(len(w) - 49))
    at = {int(k): h for s, n, h in zip(*found[0][:3]) for k in range(s, s + n)}
    for s, n, h in zip(*found[1][:3]):
        assert all(at[k + 400] == h for k in range(max(s, 100), min(s + n, 111)))
    assert list(substrings.runs(a[:49])) == [] and len(list(substrings.runs(a[:50]))) == 1


def test_leftmost_least():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, 200).astype(np.uint64)
    for width in (1, 2, 3, 5, 8, 41):
        assert substrings.least(x, width).tolist() == [k + int(np.argmin(x[k : k + width])) for k in range(len(x) - width + 1)]
