"""Documents and inventories from real folders, names that are safe for files, cleaned native documents."""

import json

from graphloom.functions import text as T
from graphloom.operators import clean
from graphloom.sources import files
from pyspark.sql import functions as F


def test_json_documents_below_a_folder(spark, tmp_path):
    for path, doc in {"a.json": {"doc_id": "1", "pages": [{"page_num": 1, "text": "x"}]}, "deep/b.json": {"doc_id": "2", "pages": []}, "ocr_pdf/c.json": {"doc_id": "3"}}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(json.dumps(doc, indent=2), encoding="utf-8")
    schema = "doc_id string, pages array<struct<page_num: int, text: string>>"
    assert {r["doc_id"] for r in files.json_documents(spark, str(tmp_path), schema).collect()} == {"1", "2", "3"}
    got = {r["doc_id"]: r["pages"] for r in files.json_documents(spark, str(tmp_path), schema, without="ocr_pdf").collect()}
    assert set(got) == {"1", "2"} and got["1"][0]["text"] == "x" and got["2"] == []


def test_inventory_of_a_folder(spark, tmp_path):
    for path, size in {"top.pdf": 10, "a/b/c/d/deep.PDF": 1_572_864, "a/no.txt": 3, "名 称.x.pdf": 1}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"x" * size)
    got = {r["relative_path"]: r for r in files.inventory(spark, str(tmp_path)).collect()}
    deep = got["a/b/c/d/deep.PDF"]
    assert len(got) == 3 and [deep[f"level_{i}_dir"] for i in (1, 2, 3)] == ["a", "b", "c"] and (deep["suffix"], deep["size_mb"], deep["file_stem"]) == (".pdf", 1.5, "deep")
    assert got["top.pdf"]["level_1_dir"] == "top.pdf" and got["top.pdf"]["level_2_dir"] == ""


def test_safe_names(spark):
    names = {'a/b\\c:d*e?"f<g>h|i': ("a_b_c_d_e__f_g_h_i", "a_b_c_d_e_f_g_h_i"), "  x \t y .pdf": ("x y .pdf", "x_y"), "..": ("..", "unknown_doc"), "z" * 200: ("z" * 180, "z" * 80)}
    rows = spark.createDataFrame([(k,) for k in names], "x string").select("x", T.safe_name(F.col("x")).alias("a"), T.safe_file_name(F.col("x")).alias("b")).collect()
    assert {r["x"]: (r["a"], r["b"]) for r in rows} == names


def test_native_documents_lose_blank_pages_and_contents(spark):
    contents = "目录\n" + "\n".join(f"{i} 章 ....... {i}" for i in range(1, 6))
    docs = spark.createDataFrame([("d", [(1, contents), (2, "  \n \n"), (3, "正文  一\n- 3 -"), (4, None)])], "doc_id string, pages array<struct<page_num: int, text: string>>")
    row = clean.clean_native_docs(docs).first()
    assert [(p["page_num"], p["is_toc_page"]) for p in row["cleaned_pages"]] == [(1, True), (3, False)] and row["cleaned_full_text"] == "正文 一"
