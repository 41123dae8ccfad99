"""From documents to packed training sequences: language, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents, whatever other columns there are. Null texts go in the first stage, null ids and
texts of any length go through all stages. An empty table goes through every stage and gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import langid, minhash, packing, suffixes
from graphloom.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WINDOW = 4096


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those of no letters (null, empty, digits and signs only) go.

    Where no row has a label to learn from, there is no model, and documents that have letters stay. The model's label and score
    reject nothing: the scores of random letters and of short clean texts overlap (README), so a bound would drop clean documents.
    """
    model = langid.train(docs)
    if model is None:
        return langid.lettered(docs).select(*COLUMNS)
    return langid.identify(docs, model).filter(F.col("lang_pred") != langid.UNDETERMINED).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): that of the smallest id.

    Of rows with one id and one text, one stays (the least by lang, source and n_chars). Rows of one id with unlike texts stay each.
    Documents without an id are nobody's duplicates and stay.
    """
    kept = minhash.near_duplicates(docs, k=5, percent=80).filter("kept").select("doc_id").distinct()
    rows = docs.join(kept.hint("merge"), "doc_id", "left_semi").withColumn("_h", F.sha2("text", 256))
    # the rows of an id are together already: no shuffle follows
    first = Window.partitionBy("doc_id", "_h").orderBy("lang", "source", "n_chars")
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return rows.select(*COLUMNS).unionByName(docs.filter(F.col("doc_id").isNull()).select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier place holds too (of a smaller id, or of the same text).

    Documents with nothing left go. n_chars follows the text. Documents without an id keep their whole text.
    """
    left = suffixes.cut(docs, suffixes.repeats(docs)).filter(F.length("text") > 0)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most WINDOW tokens."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), WINDOW), WINDOW)


STAGES = [("language_id", language), ("minhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeated_passages), ("packing", pack)]

#: No stage of models, sketches and tokenisers can be said in SQL; tests/llm hold run() against a brute-force version of a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
