"""Which texts contain which names: a dictionary join for dictionaries of any size.

A dictionary of bounded size, which is measured first, becomes one automaton for each task (Aho-Corasick: all names are walked at
once, each text is read once, character by character, however many names there are). A larger one is joined by grams: of
each name the one that the fewest texts hold must be in a text, which is then looked at as a whole. Rows grow with the texts'
lengths and with what is found, not with the names' lengths or number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest dictionary that is sent to every task: names, and bytes of them.
MOST_NAMES, MOST_BYTES = 500_000, 16 << 20
#: Characters of a gram; shorter names are their own gram.
GRAM = 4


def holding(texts: DataFrame, text: str, names: DataFrame, name: str, keep_text: bool = True, most_names: int = MOST_NAMES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows of texts with each row of names whose name their text contains; null and empty names are in none, null texts hold none.

    Both tables' columns are kept, so none may be in both; without keep_text that of the text is not, which long texts want. names is read when this is called: give it stored if it is dear.
    """
    known = names.filter(F.col(name) != "").groupBy(name).agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.octet_length(F.to_json(F.struct(*names.columns)))).alias("_bytes"))
    measured = known.limit(most_names + 1).toArrow()
    found = measured.column(0).combine_chunks()
    if len(found) > most_names or found.nbytes > most_bytes:
        found_rows = by_grams(texts, text, names, name)
        return found_rows if keep_text else found_rows.drop(text)
    rows, size = (sum(measured.column(i).to_pylist()) for i in (1, 2))
    # what is found is far more than the names: where all their rows are as few and small as names may be, they go to it
    small = rows <= most_names and size <= most_bytes
    return by_automaton(texts, text, found.to_pylist(), name, keep_text).join(F.broadcast(names) if small else names, name)


def by_automaton(texts: DataFrame, text: str, listed: list[str], name: str, keep_text: bool = True) -> DataFrame:
    """Rows of texts with each of the listed names that their text contains, as column name."""
    shared = texts.sparkSession.sparkContext.broadcast(sorted(listed))
    at = texts.columns.index(text)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # holds no name of this module: workers need not have it
        import ahocorasick

        entries, machine = shared.value, ahocorasick.Automaton()
        named = pa.array(entries, pa.string())
        for i, entry in enumerate(entries):
            machine.add_word(entry, i)
        machine.make_automaton()
        for batch in batches:
            rows, hits = [], []
            for row, value in enumerate(batch.column(at)):
                found = {i for _, i in machine.iter(value.as_py() or "")} if entries else ()
                rows += [row] * len(found)
                hits += found
                if len(hits) > 100_000:
                    yield _joined(batch, rows, hits, named)
                    rows, hits = [], []
            yield _joined(batch, rows, hits, named)

    def _joined(batch: pa.RecordBatch, rows: list[int], hits: list[int], named: pa.Array) -> pa.RecordBatch:
        kept = batch.select(columns).take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([*kept.columns, named.take(pa.array(hits, pa.int64()))], [*columns, name])

    columns = [c for c in texts.columns if keep_text or c != text]
    schema = texts.limit(0).select(*columns, F.lit("").alias(name)).schema
    return texts.mapInArrow(walk, schema)


def _grams(x: Column, n: int) -> Column:
    return F.when(F.length(x) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substring(x, i, n)))).otherwise(F.array().cast("array<string>"))


def by_grams(texts: DataFrame, text: str, names: DataFrame, name: str, gram: int = GRAM) -> DataFrame:
    """holding() by joins alone: each name meets the texts that hold its rarest gram, and those are looked at as a whole."""
    known = names.select(F.col(name).alias("_name")).filter("_name <> ''").distinct()
    own = known.select("_name", F.explode(F.when(F.length("_name") < gram, F.array("_name")).otherwise(_grams(F.col("_name"), gram))).alias("_g"))
    texts = texts.withColumn("_t", F.md5(text))
    # short names are sought among all parts of their lengths; those are looked for only if there are such names
    lengths = [gram, *(r["n"] for r in known.select(F.length("_name").alias("n")).filter(F.col("n") < gram).distinct().collect())]
    parts = F.concat(*(_grams(F.col(text), n) for n in lengths))
    held = texts.filter(F.col(text).isNotNull()).select("_t", F.explode(parts).alias("_g")).join(own.select("_g").distinct(), "_g", "left_semi").distinct()
    often = held.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    # a name with a gram that no text holds is in none
    anchors = own.join(often, "_g", "left").groupBy("_name").agg(F.min_by("_g", F.struct("_n", "_g")).alias("_g"), F.count_if(F.col("_n").isNull()).alias("_no")).filter("_no = 0").drop("_no")
    met = held.join(anchors, "_g").select("_t", "_name")
    found = texts.join(met, "_t").filter(F.col(text).contains(F.col("_name"))).drop("_t")
    return found.join(names, F.col("_name") == F.col(name)).drop("_name")
