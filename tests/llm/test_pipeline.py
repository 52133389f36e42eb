import corpus_pipeline
from sparvane.llm import neardup, pii, toxicity
from sparvane.llm.common import read

SF = "/root/testdata/sf0.001"


def test_stages_equal_their_operators_and_keep_clean_documents(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    every = {r.doc_id: r for r in docs.collect()}
    verdict = {r.doc_id: r.predicted for r in toxicity.score(docs, labels).collect()}
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    ordinary = {r.doc_id: r for r in kept.collect()}
    assert set(ordinary) == {i for i, p in verdict.items() if not p}
    assert all(ordinary[i] == every[i] for i in ordinary)
    classes = {r.doc_id: r.class_id for r in neardup.classes(kept).collect()}
    single = corpus_pipeline.drop_near_duplicates(spark, kept, SF)
    assert single.columns == docs.columns
    ids = {r.doc_id for r in single.collect()}
    assert ids == set(classes.values())
    spans = {r.doc_id: r.spans for r in pii.find(single).collect()}
    clean = corpus_pipeline.redact_personal_data(spark, single, SF)
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert (r.text != every[r.doc_id].text) == bool(spans[r.doc_id])


def test_run_returns_every_survivor_once(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "packing"]
    assert (out.groupby("sequence_id").length.sum() <= 4096).all()
    assert not out.duplicated(["doc_id", "piece"]).any()


def test_stages_take_nulls_long_texts_repeats_clashing_names_and_nothing(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, kind string, class string, spans string, length long"
    rows = [(1, None, "en", None, None, "s", "k", None, "x", 5), (2, "", None, "src1", 0, "", "", "", "", 0), (None, "no id here but words enough", "en", "a", 1, "", "", "", "", 0)]
    rows += [(3, "the same text twice, word for word", "en", "b", 2, "", "", "", "", 0)] * 2 + [(4, "long words " * 30_000 + "me@here.org", "en", "c", 3, "", "", "", "", 0)]
    docs = spark.createDataFrame(rows, schema)
    for frame, ids in ((docs, [None, 1, 3, 4]), (docs.limit(0), [])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == docs.columns, name
            frame = spark.createDataFrame(out.collect(), schema)
        kept = frame.collect()
        assert sorted((r.doc_id for r in kept), key=str) == sorted(ids, key=str)
        assert all("me@here.org" not in (r.text or "") for r in kept)
        packed = corpus_pipeline.pack(spark, frame, SF).toPandas()
        assert set(packed.doc_id.dropna().astype(int)) == {i for i in ids if i is not None}
