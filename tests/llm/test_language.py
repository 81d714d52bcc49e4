import math
import random
import zlib

from sigloom.llm import language

WORDS = {"en": "the of and with this that from over under house river".split(), "de": "der die und mit dieser über unter haus fluß schön".split(), "fr": "le la et avec cette où dessous maison rivière été".split()}


def docs(n=90, seed=1):
    rng, out = random.Random(seed), []
    for k in range(n):
        lang = ("en", "de", "fr")[k % 3]
        out.append((k, " ".join(rng.choice(WORDS[lang]) for _ in range(30)), lang))
    return out + [(1000, None, "en"), (1001, "", None), (1002, "123 !?", "de"), (1003, "le la " * 50000, None), (1, out[1][1], "de")]


def test_prediction(spark):
    df = spark.createDataFrame([(*d, "x") for d in docs()], "doc_id long, text string, lang string, score string")
    got = language.language_report(df).collect()
    assert len(got) == len(docs())
    true = {i: x for i, _, x in docs()}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    told = [r for r in got if r.doc_id < 90]
    assert sum(r.lang_pred == true[r.doc_id] for r in told) == len(told)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[1000] == by[1001] == by[1002] == "und" and by[1003] == "fr"
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and sorted({r.doc_id for r in kept.collect()} & {1000, 1001, 1002}) == []
    assert kept.count() == len(docs()) - 3


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.language_report(df).collect()] == [("und", 0.0)]
    assert language.language_report(df.limit(0)).count() == 0
    one = spark.createDataFrame([(k, "abc def", "en") for k in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.language_report(one).collect()} == {"en"}


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 9, 30):
        code = language.codewords(k).astype(int)
        far = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
        assert far >= (1 if k < 3 else 2)


def test_sampling_is_exact_at_any_count():
    """About the asked number of texts of the largest corpora, and never none."""
    for count in (1, 1500, 1501, 10**6, 1_499_999_999, 1_500_000_001, 10**11, 10**15, 10**18):
        share = language.share_of(count, 1500)
        assert 1 <= share <= language.DRAWS and abs(share / language.DRAWS * count - min(count, 1500)) < 1
    assert language.share_of(10**30, 1500) == 1


def test_every_language_is_learned_from(spark):
    rows = [(k, f"text of number {k}", f"l{k % 700}") for k in range(2100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = {x for k, _, x in rows if zlib.crc32(str(k).encode()) % 4 != 2}
    assert {r.lang for r in language.labelled_sample(df, 2).select("lang").distinct().collect()} <= known
    assert {r.lang for r in language.labelled_sample(df, 10).select("lang").distinct().collect()} == known and len(known) > 512


def test_null_ids_are_not_held_out(spark):
    df = spark.createDataFrame([(None, "der die und", "de"), (1, "the of and", "en"), (3, "le la et", "fr")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.language_report(df).collect()}
    assert got[None].held_out is False and got[None].lang_pred == "de"


def plainly(model, text):
    """Decoding by the definitions, one bit and one language after the other."""
    counts = {}
    for g in language.grams(text).tolist():
        counts[g] = counts.get(g, 0) + 1
    n = sum(counts.values())
    if not n:
        return "und", 0.0
    margin = [sum(c * float(model["weights"][g, b]) for g, c in counts.items()) / n for b in range(model["code"].shape[1])]
    total = sum(model["trust"])
    loss = [sum(t * math.log1p(math.exp(-4 * m * int(s) / t)) for m, s, t in zip(margin, word, model["trust"])) / total for word in model["code"]]
    like = [math.exp(-8 * (x - min(loss))) for x in loss]
    return model["langs"][loss.index(min(loss))], max(like) / sum(like)


def test_predictions_match_brute_force(spark):
    df = spark.createDataFrame(docs(), "doc_id long, text string, lang string")
    model = language.fit(language.gram_counts(language.labelled_sample(df, language.SAMPLE)))
    text = dict((i, t) for i, t, _ in docs() if i not in (1, 1003))
    for r in language.language_report(df).collect():
        if r.doc_id in text:
            lang, score = plainly(model, text[r.doc_id])
            assert r.lang_pred == lang and abs(r.score - score) < 1e-4


def test_accuracy_on_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.language_report(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
