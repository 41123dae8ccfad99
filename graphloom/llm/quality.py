"""Quality rules: base measures of every text, and a log-likelihood ratio of hashed n-grams, in DataFrame functions alone.

Words, and each word with the next, are hashed into BUCKETS. One multinomial is counted over all documents (the raw corpus), one over
a bounded set of trusted documents (the target). A bucket's weight is the logarithm of the ratio of its shares, as an integer of
SCALE-ths, so that sums do not depend on their order; the target's share is smoothed by PRIOR more n-grams that are dealt as in
the raw corpus, so that what few trusted texts do not hold weighs little. A document's score is its mean weight, compared with a fixed threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of hashed n-grams; parts of one in a weight; hundredths of one that the mean weight of a kept text reaches.
BUCKETS, SCALE, THRESHOLD_PERCENT = 10_000, 1 << 20, -10
#: N-grams of the raw corpus that smooth the target.
PRIOR = 10_000
#: Trusted documents used at most: those whose ids have the smallest hashes. Their ids are sent to all tasks (8 bytes each).
TRUSTED = 20_000
#: Words of a window that counts as repeated; least words; hundredths of the words that may lie in repeated windows.
WINDOW, LEAST_WORDS, REPEATED_PERCENT = 5, 10, 20
SPACES, SYMBOLS = "\t\n\x0b\f\r", "#*$%&|<>"


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def grams(hashes: Column) -> Column:
    """Hashes of the words and of each word with the next one (the last one with the end), from the words' hashes."""
    return _let(hashes, lambda h: F.concat(h, F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1)))))


def bucket(gram: Column) -> Column:
    return F.pmod(gram, F.lit(BUCKETS)).cast("int")


def windows(hashes: Column) -> Column:
    """The hash of each WINDOW following words, from the words' hashes."""
    return _let(hashes, lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW)))))


def symbols(text: Column) -> Column:
    """How many of SYMBOLS are in the text."""
    bare = text
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(bare)


def _let(x: Column, body) -> Column:
    return F.transform(F.array(x), body)[0]


def repeated_words(windows: Column) -> Column:
    """Words that lie in a window which the text has twice or more, from the windows' hashes in order."""

    def places(sorted_: Column) -> Column:
        same = lambda e, i: (F.get(sorted_, i - 1)["h"] == e["h"]) | (F.get(sorted_, i + 1)["h"] == e["h"])
        return F.sort_array(F.transform(F.filter(sorted_, lambda e, i: F.coalesce(same(e, i), F.lit(False))), lambda e: e["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # most texts repeat no window: then nothing is sorted
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(_let(pairs, places), covered)).otherwise(0)


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return _let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def trusted(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of documents labelled as good and not toxic, each once, TRUSTED at most: those with the smallest hashes."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED)


def weights(hashed: DataFrame, target: DataFrame) -> DataFrame:
    """One row, weights: floor(SCALE * ln(smoothed share in target / share in all)) for each bucket, 0 for those that no text has.

    hashed: doc_id, _h (the hashes of a document's words); target: doc_id.
    """
    flagged = hashed.join(F.broadcast(target.withColumn("_t", F.lit(1))), "doc_id", "left")
    each = flagged.select(F.coalesce("_t", F.lit(0)).alias("_t"), F.explode(grams(F.col("_h"))).alias("_g"))
    counted = each.groupBy(bucket(F.col("_g")).alias("bucket")).agg(F.count(F.lit(1)).alias("r"), F.sum("_t").alias("t"))
    full = hashed.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counted, "bucket", "left").na.fill(0)
    one = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "r", "t"))).alias("b"), F.sum("r").alias("_r"), F.sum("t").alias("_t"))  # BUCKETS structs
    ratio = lambda x: (x["t"].cast("double") * F.col("_r") / x["r"] + PRIOR) / (F.col("_t") + PRIOR)
    return one.select(F.transform("b", lambda x: F.when(x["r"] > 0, F.floor(SCALE * F.log(ratio(x)))).otherwise(F.lit(0)).cast("long")).alias("weights"))


def judge(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr for every row, in whole texts.

    llr: the mean weight of the text's n-grams in nats, 0 without any. kept: the base rules hold and llr reaches
    THRESHOLD_PERCENT hundredths. Null text: empty, so base_failed. Rows of a null id are judged like any other and are never
    trusted; rows of one id are judged each, and all trusted if the id is; repeated rows count as often as they come. Only
    the two named columns are read. Without any trusted document the base rules decide alone. Texts of any length are whole. An empty
    table gives no rows. Repeated windows are told by 64-bit hashes.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    hashed = read.withColumn("_w", words(F.col("text"))).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    weight = lambda h, t: F.transform(h, lambda x, i: F.get(t, bucket(x)) + F.get(t, bucket(F.xxhash64(x, F.get(h, i + 1)))))
    score = _let(F.col("_h"), lambda h: _let(F.col("_table"), lambda t: F.aggregate(weight(h, t), F.lit(0).cast("long"), lambda a, b: a + b)))
    rows = hashed.withColumn("_table", weights(hashed.select("doc_id", "_h"), target).scalar()).withColumn("_x", windows(F.col("_h"))).select(
        "doc_id", F.size("_h").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), symbols(F.col("text")).cast("long").alias("n_symbols"),
        repeated_lines(F.col("text")).cast("long").alias("n_dup_lines"), repeated_words(F.col("_x")).cast("long").alias("n_repeat_words"), score.alias("_s"),
    )
    n = 2 * F.col("n_words")
    rows = rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")))
    good = 100 * F.col("_s") >= THRESHOLD_PERCENT * SCALE * n
    return rows.withColumns({"kept": ~F.col("base_failed") & good, "llr": F.when(n > 0, F.col("_s") / (n * SCALE)).otherwise(F.lit(0.0))}).drop("_s")
