import random
from itertools import permutations

import duckdb
import pytest

from sigloom.llm import audit
from sigloom.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(docs, labels):
    """{(part, order, step): counts} by loops over documents, as the contract tells it."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rank = lambda d: 2**63 - 1 if d is None else d
    rows = []
    for d, text, lang in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": any((t or "") == text and rank(e) < rank(d) for e, t, _ in docs),
        }
        rows.append((lang or "", {f for f, x in fails.items() if x}, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                out[part, "".join(order), k + 1].append(shapley[f])
    return out


def told(rows):
    return {(r.part, r.filter_order, r.step): [r[c] for c in audit.COUNTS] for r in rows}


def test_hostile_documents_match_loops(spark):
    rng = random.Random(3)
    words = ["one", "two", "three", "É", "Ab", "x#y", " ", "a\x1cb", "ZZ", " "] + [f"w{k}" for k in range(400)]
    texts = [None, "", " \t\n", "A", "#", "word", "É" * 40 + "A", "\x0bword\x0c"] + [" ".join(rng.choices(words[: rng.choice([3, 10, 400])], k=rng.choice([5, 199, 200, 201, 450]))) for _ in range(40)]
    texts += ["long " * 300_000 + "end#"]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "en", "de", "é"])) for _ in range(160)]
    docs += docs[:10]
    labels = [(rng.choice([None, *range(70)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(50)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, digest string, part int")
    got = audit.audit(df.repartition(3), spark.createDataFrame([(*r, 5) for r in labels], "doc_id long, quality int, toxic int, n int")).collect()
    want = plain(docs, labels)
    assert len(got) == len(want) == 600 * len({d[2] or "" for d in docs}) and told(got) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).count() == 0
    one = audit.audit(spark.createDataFrame([(1, "some text", "en")], docs.schema), labels).collect()
    assert told(one) == plain([(1, "some text", "en")], [])


def test_words_over_block_ends():
    text = b"ab cd  ef\tgh " * 50
    from sigloom.llm.common import word_blocks

    for size in (1, 2, 3, 7, 1000):
        assert [w for words in word_blocks(text, size) for w in words] == text.split()
    assert list(word_blocks(b"")) == []


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_substring_dedup"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    by = sorted(got.columns)
    assert sorted(got[by].itertuples(index=False, name=None)) == sorted(want[by].itertuples(index=False, name=None))
