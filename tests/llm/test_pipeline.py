import cases
import corpus_pipeline
from pyspark.sql import functions as F


def tables(spark, tmp_path):
    rows = [r[:5] for r in cases.rows()]
    rows += [(100 + i, cases.prose(120, 100 + i), "en", "s", None) for i in range(60)]
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in cases.prose(80, 300 + i).split()), "en", "s", None) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(100 + i, 1, 0) for i in range(0, 60, 2)] + [(200 + i, 0, 0) for i in range(0, 30, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return docs


def test_stages_take_effect(spark, tmp_path, word_bpe):
    docs = tables(spark, tmp_path)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert not {6, 7, 8, 13} & set(kept["language"])
    assert {*range(100, 160)} <= set(kept["language"])
    assert not {*range(200, 230)} & set(kept["quality"])
    assert {*range(100, 160)} <= set(kept["quality"])
    assert {1, 2, 3} & set(kept["near_duplicates"]) == {1}
    assert set(kept["repeats"]) == set(kept["near_duplicates"])
    before, after = kept["near_duplicates"], kept["repeats"]
    assert len(after[5].text.split()) == 90 and after[5].n_chars == len(after[5].text)
    assert all(after[k].text == before[k].text for k in range(100, 160))


def test_no_clean_row_is_lost(spark, tmp_path, word_bpe):
    """Rows without an id, different texts of one id, and a text in three languages."""
    docs = tables(spark, tmp_path)
    parts = [cases.prose(40, 700), cases.prose(40, 701, "schen heit und der ung ver ge lich"), cases.prose(40, 702, "que les eau tion ment ais oi")]
    rows = [(None, cases.prose(90, 710)), (None, cases.prose(90, 711)), (900, cases.prose(90, 712)), (900, cases.prose(90, 713)), (901, " ".join(parts))]
    rows = [(k, t, None, "s", None) for k, t in rows]
    rows += [(910 + i, cases.prose(60, 720 + i, "que les eau tion ment ais oi"), "fr", "s", None) for i in range(20)]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{tmp_path}/more.parquet")
    docs = spark.read.parquet(f"{tmp_path}/more.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        left = {(r.doc_id, r.text) for r in docs.collect()}
        assert {(k, t) for k, t, *_ in rows[:5]} <= left, name


def test_texts_get_the_language_of_their_words(spark, tmp_path):
    """Texts without a given language, and one with a wrong one, whose right one must not be lost."""
    french = "que les eau tion ment ais oi"
    rows = [(i, cases.prose(60, 800 + i), "en", "s", None) for i in range(30)]
    rows += [(100 + i, cases.prose(60, 900 + i, french), "fr", "s", None) for i in range(30)]
    rows += [(None, cases.prose(60, 990, french), None, "s", None), (201, cases.prose(60, 991), None, "s", None)]
    rows += [(202, cases.prose(60, 992, french), "en", "s", None), (203, "12 34", "en", "s", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.language_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert len(got) == len(rows) - 1
    lang = {r.text: r.lang for r in got}
    wanted = {None: "fr", 201: "en", 202: "fr"}
    assert all(lang[t] == wanted.get(k, given) for k, t, given, *_ in rows if k != 203)


def test_the_whole_run_packs_what_is_left(spark, tmp_path, word_bpe):
    tables(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.agg(F.sum("length")).first()[0] == got.dropDuplicates(["doc_id"]).agg(F.sum("doc_tokens")).first()[0]


def test_no_documents(spark, tmp_path, word_bpe):
    docs = tables(spark, tmp_path).where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == []
