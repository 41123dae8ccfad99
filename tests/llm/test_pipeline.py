import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA)


@pytest.mark.parametrize("langs", [(None, None, None), ("en", None, None)])
def test_documents_stay_where_labels_are_missing(spark, langs):
    # crc32("15") % 4 = 2: the only label is held out
    rows = [(15, "some plain words", langs[0]), (2, "日本語", langs[1]), (3, "é", langs[2]), (4, "12 $ 34", None), (5, "", None), (6, None, None)]
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, table(spark, rows), "").collect()) == [2, 3, 15]


def test_documents_without_id_are_packed(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(40))
    table(spark, [(None, "no id here", "en"), (None, words, "en"), (1, words, "en"), (2, words, "en")]).write.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "no id here"), (0, words), (1, words)]
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [0, 0, 1]
