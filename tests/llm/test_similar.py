import random
from fractions import Fraction

import corpus_pipeline
from sigloom.llm import similar


def plain(text, words=5):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def firsts(rows, share=Fraction(4, 5)):
    """The ids that stay, by comparing all pairs."""
    sets = [plain(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(sets):
        for j in range(k):
            b = sets[j]
            if a == b or len(a & b) >= share * len(a | b):
                x, y = find(k), find(j)
                up[max(x, y)] = min(x, y)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return sorted(min(g) for g in groups.values())


def made(seed=3):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(3000)
    rows, passage = [], [word() for _ in range(30)]
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(3, 140))]
        if rng.random() < 0.4:
            base[rng.randrange(len(base)) :] = passage
        texts = [base]
        for _ in range(rng.randrange(0, 5)):  # copies of copies: chains
            t = list(rng.choice(texts))
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = word()
            texts.append(t + [word() for _ in range(rng.randrange(0, 8))])
        rows += [" ".join(t) for t in texts]
    large = [word() for _ in range(90)]
    for _ in range(60):
        t = list(large)
        for _ in range(rng.randrange(1, 3)):
            t[rng.randrange(len(t))] = word()
        rows.append(" ".join(t))
    rows += ["", None, " \n", "One two", "one  TWO"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_matches_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (4, similar.HOT):
        got = sorted(r.doc_id for r in similar.keep_first_alike(docs, hot=hot).collect())
        assert got == firsts(rows)


def test_stage_goes_by_similarity_alone(spark):
    """At four fifths exactly a copy goes, beyond any two bits of a fingerprint; just below it stays."""
    words = ["w%d" % k for k in range(49)]  # 45 shingles; 40 of 50 is four fifths
    at, below = words[:44] + ["x%d" % k for k in range(5)], words[:43] + ["y%d" % k for k in range(6)]
    rows = [(1, " ".join(words)), (2, " ".join(at)), (3, " ".join(["z"] * 4 + below[4:]))]
    assert len(plain(rows[0][1]) & plain(rows[1][1])) == 40 and len(plain(rows[0][1]) | plain(rows[1][1])) == 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3] == firsts(rows)
