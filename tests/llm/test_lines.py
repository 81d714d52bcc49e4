import random

import pytest
from pyspark.sql import functions as F

from sigloom.llm import lines


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_banded_distance(spark):
    rng, rows = random.Random(5), []
    for _ in range(300):
        a = "".join(rng.choice("abcé🙂") for _ in range(rng.randint(4, 20)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            p = rng.randrange(len(b) + 1)
            if rng.random() < 0.5:
                b.insert(p, rng.choice("abc"))
            elif p < len(b):
                b[p : p + 1] = rng.choice(["", "x"])
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for k in (1, 2, 3):
        for r in df.select("a", "b", lines.banded_distance(F.col("a"), F.col("b"), k).alias("d")).collect():
            e = edit(r.a, r.b)
            assert len(r.a) <= k or (r.d == e if e <= k else r.d > k)


def brute(docs, edits, shortest=16):
    spots = [(i, p, x) for i, t in docs if t is not None for p, x in enumerate(t.split("\n")) if len(x) >= shortest]
    u = sorted({x for _, _, x in spots})
    up = {x: x for x in u}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(u):
        for b in u[k + 1 :]:
            if abs(len(a) - len(b)) <= edits and edit(a, b) <= edits:
                up[find(a)] = find(b)
    first, out = {}, {}
    for i, p, x in sorted(spots, key=lambda s: s[:2]):
        c = find(x)
        if c in first:
            out.setdefault(i, []).append((p, *first[c]))
        else:
            first[c] = (i, p)
    return out


def made(n=60, seed=3):
    rng = random.Random(seed)
    base = "visitor number %s of the old town"
    docs = [(i, base % f"{i:02d}" + "\nshared line of every document") for i in range(n)]
    docs += [(100 + i, "abcdefghij" * 2 + rng.choice(["", "x", "y"]) + "klmnopqrst" + rng.choice(["", "z"])) for i in range(12)]
    return docs + [(200, None), (201, ""), (202, "short\nshort\n\n"), (203, "long line with no twin at all")]


def test_classes_match_brute_force_with_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 4)
    df = spark.createDataFrame([(*d, "k") for d in made()], "doc_id long, text string, key string")
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in lines.line_report(df).collect() if r.n_removed}
    assert got == brute(made(), 1)


def test_two_edits(spark):
    docs = made(8)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in lines.removed_lines(df, 2).collect()}
    assert got == brute(docs, 2)


def test_more_edits_refuse_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 4)
    df = spark.createDataFrame(made(30), "doc_id long, text string")
    with pytest.raises(ValueError):
        lines.removed_lines(df, 2)


def test_the_filter_before_the_distance_keeps_every_pair(spark):
    rng, rows = random.Random(9), []
    for _ in range(400):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(16, 90)))
        p, kind = rng.randrange(len(a)), rng.randrange(3)
        rows.append((a, a[:p] + ("x" if kind == 0 else a[p] + "y" if kind == 1 else "") + a[p + 1 :]))
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.where(lines.segments_agree(F.col("a"), F.col("b"), 1)).count() == len(rows)
    assert df.where(lines.segments_agree(F.col("b"), F.col("a"), 1)).count() == len(rows)


def test_dropping_keeps_rows_and_columns(spark):
    rows = [(1, "a line that is long enough\nend", 7), (2, "x\na line that is long enough", 7), (2, "x\na line that is long enough", 7), (3, None, 7), (None, "a line that is long enough", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed int")
    got = sorted(map(tuple, lines.drop_lines(df).collect()), key=repr)
    assert got == sorted([(1, "end", 7), (2, "x", 7), (2, "x", 7), (3, None, 7), (None, "a line that is long enough", 7)], key=repr)
    assert lines.drop_lines(df.limit(0)).count() == 0 and lines.line_report(df.limit(0)).count() == 0
