"""Empty tables, nulls and extra columns for the queries that read other tables than documents."""

import hashlib

from graphloom.llm import egojoin, registry


def test_conversations_with_nulls_and_none_at_all(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string, turns string, formatted string"
    rows = [(1, 0, "user", None, "x", "y"), (1, None, None, "no turn", "x", "y"), (1, 1, "assistant", "a" * 300_000 + "</s>", "x", "y"), (None, 0, "user", "q", "x", "y"), (2, 0, "assistant", "", "x", "y"), (2, 0, "assistant", "", "x", "y")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/conversations.parquet")
    got = {r["conv_id"]: r for r in registry.op5_chat_grammar(spark, f"{tmp_path}/a").collect()}
    assert set(got) == {-1, 1, 2, None} and all(r["identical"] for r in got.values())
    said = "a" * 300_000 + "</s>"
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (3, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[1]["turns_sha256"] == hashlib.sha256(f"\nno turn\nuser\n\nassistant\n{said}\n".encode()).hexdigest()
    assert (got[2]["n_turns"], got[2]["loss_chars"]) == (2, 0)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert [r["conv_id"] for r in registry.op5_chat_grammar(spark, f"{tmp_path}/b").collect()] == [-1]


def test_no_pages_and_no_vectors(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert registry.op8_zip_warc(spark, str(tmp_path)).count() == registry.op6_grid_order_join(spark, str(tmp_path)).count() == 0


def test_vectors_beside_columns_of_the_results_names(spark):
    rows = [(1, [1.0, 0.0], "x", 5, True), (2, [1.0, 0.0], "y", 6, False), (3, [0.0, 1.0], None, None, None)]
    got = egojoin.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, n_links int, kept boolean")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
