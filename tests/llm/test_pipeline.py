import corpus_pipeline
from sigloom.scratch import mark, shared_folder


def test_stages_keep_columns_and_take_effect(spark):
    en = "the river and the house of this old town with that bridge over the water number %d"
    rows = [(k, en % k + "\n" + "all rights reserved by the town council", "en", "a", 1) for k in range(30)]
    rows += [(100, "123 456", "en", "a", 1), (101, rows[3][1], "en", "b", 1), (102, None, "en", "b", 1), (103, "the password = Zx81kkQ2aa of this house", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, "")
        path = f"{shared_folder(spark)}/stage-test-{name}"
        made.write.mode("overwrite").parquet(path)
        if name != "packing":
            assert made.columns == docs.columns
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    assert {100, 102} & {r.doc_id for r in out["language_id"]} == set() and len(out["language_id"]) == 32
    text = {r.doc_id: r.text for r in out["line_dedup"]}
    assert "council" in text[0] and "council" not in text[5] and text[101] == ""
    ids = [r.doc_id for r in out["near_dedup"]]
    assert len(ids) == len(set(ids)) and 103 in ids
    assert [r.text for r in out["secret_scan"] if r.doc_id == 103] == ["the [secret] of this house"]
    assert {r.doc_id for r in out["packing"]} == set(ids)


def test_run(spark):
    before = mark(spark)
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0 and len(corpus_pipeline.STAGES) == 5
    assert mark(spark) - before == 2  # what the last stage reads, and its pieces


def test_run_of_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_clashing_columns_repeated_rows_and_a_very_long_text(spark):
    """Extra columns named like working ones come through all stages with their rows; a text of half a million words and rows
    that repeat are handled like others."""
    en = "the river and the house of this old town with that bridge over the water number %d"
    clash = ["uid", "root", "n", "keys", "line", "value", "owner", "row", "start", "fp", "text_key", "found", "live"]
    long_text = "\n".join(en % (k * 7919) + f" and then w{k} of x{k * 31} or y{k * 17} too" for k in range(20_000))
    texts = [(k, en % k + f" while w{k} met x{k} at y{k} and z{k} then") for k in range(20)] + [(50, long_text)] + [(7, en % 7 + " while w7 met x7 at y7 and z7 then")] * 3
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}/r", len(t), *[f"{c}{i}" for c in clash]) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)).repartition(3)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{shared_folder(spark)}/clash-test-{name}"
        stage(spark, docs, "").write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        rows = docs.collect()
        assert {r.doc_id for r in rows} == {i for i, _ in texts} and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in clash)
        assert len(rows) == (21 if name in ("near_dedup", "secret_scan") else 24)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {i for i, _ in texts} and max(r.piece for r in packed if r.doc_id == 50) > 100


def test_a_worker_forgets_the_tokenizer_when_it_turns_to_languages():
    import gc
    import weakref

    import public_tokenizers

    from sigloom.llm import language, tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = tokens.encoder(path)
    assert tokens.encoder(path) is encoder
    gone = weakref.ref(encoder)
    del encoder
    assert len(language.grams("some words")) > 0
    gc.collect()
    assert gone() is None
    assert language._letter_table() is language._letter_table()
