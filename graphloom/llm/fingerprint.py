"""Homomorphic multiset fingerprints of documents, in DataFrame functions alone.

A document is a multiset of paragraphs (its lines). Each is hashed to a wide vector: EXACT lanes of 32 bits from the paragraph
whole, and lanes of 0/1 from each of its words times the word's length, whatever the paragraph's length; a word without spaces for
more than WORD characters, as in scripts that have none, counts by its overlapping character grams. The fingerprint is the sum of
the paragraphs' vectors and of their lengths, the exact lanes modulo 2**32, the others modulo 2**31. Sums do not depend on order;
adding or taking away a paragraph's vector inserts or deletes it. Centred (twice a lane less the sum of lengths), the words' lanes
are sums of random signs, so the normalised inner product of two fingerprints estimates the cosine of the two multisets of
words: their likeness.

Words become rows and vectors are summed by a hash aggregate, which is compiled code; array lambdas, which are not, would
take some ten times as long for it. The rows of a document stay in the task that has its text: no shuffle follows the
one that brings neighbours together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Sums of 32 bits over whole paragraphs; 64-bit words of the rest, each with two lanes of LANE_BITS bits, 32 bits apart.
EXACT, WORDS, LANE_BITS = 4, 48, 31
ONES = 1 | 1 << 32
#: Characters of a word beyond which it counts by grams.
WORD = 24
#: Where words and paragraphs end: a word keeps the space after it.
WORD_END = r"(?<= )|\n"
#: Each character with the three after it, in one pass.
GRAM = r"(?s)(?=(.{4}))."
#: Ids per bucket, as a power of two, where neighbours by id are sought.
BUCKET_BITS = 8


def units(text: Column) -> Column:
    """The words of all paragraphs; of a longer word, its grams. White space besides the space and the line end is part of a word."""
    words = F.split(text, WORD_END, -1)

    def grams(w: Column) -> Column:
        return F.when(F.length(F.rtrim(w)) > WORD, F.regexp_extract_all(w, F.lit(GRAM), F.lit(1))).otherwise(F.array(w))

    out = F.when(text.rlike(rf"[^ \n]{{{WORD + 1},}}"), F.flatten(F.transform(words, grams))).otherwise(words)
    return F.filter(out, lambda u: u != "")


def paragraph_sum(text: Column, lane: int) -> Column:
    """Sum of the paragraphs' hashes, modulo 2**32. Empty lines are no paragraphs."""
    paragraphs = F.filter(F.split(text, "\n", -1), lambda p: p != "")
    return F.aggregate(paragraphs, F.lit(0).cast("long"), lambda s, p: (s + F.shiftrightunsigned(F.xxhash64(p, F.lit(f"exact {lane}")), 32)).bitwiseAND(F.lit((1 << 32) - 1)))


def fingerprints(rows: DataFrame, keys: list[str], text_col: str, to: str = "fp") -> DataFrame:
    """keys and the fingerprint of text_col for each row; keys must be unique.

    array<bigint>: weight, EXACT sums over whole paragraphs, WORDS words of two lanes. An empty or null text has the fingerprint
    of zeros. Texts of any length are whole. If rows are partitioned by some of the keys, nothing is shuffled.
    """
    whole = rows.select(*keys, *(paragraph_sum(F.col(text_col), i).alias(f"_p{i}") for i in range(EXACT)), units(F.col(text_col)).alias("_us"))
    each = whole.select(*keys, *(f"_p{i}" for i in range(EXACT)), F.explode_outer("_us").alias("_u"))
    each = each.select(*keys, *(f"_p{i}" for i in range(EXACT)), *(F.xxhash64("_u", F.lit(i)).alias(f"_h{i}") for i in range(-(-WORDS // 32))), F.coalesce(F.length("_u"), F.lit(0)).cast("long").alias("_w"))
    lanes = [F.sum(F.shiftright(F.col(f"_h{j // 32}"), j % 32).bitwiseAND(F.lit(ONES)) * F.col("_w")).alias(f"_{j}") for j in range(WORDS)]
    summed = each.groupBy(*keys).agg(F.sum("_w").alias("_n"), *(F.coalesce(F.max(f"_p{i}"), F.lit(0)).alias(f"_p{i}") for i in range(EXACT)), *lanes)
    # lanes are reduced once they are summed: a text of under 2**31 characters carries nothing from one lane into the next
    return summed.select(*keys, F.array("_n", *(f"_p{i}" for i in range(EXACT)), *(_joined(F.col(f"_{j}"), _high(F.col(f"_{j}"))) for j in range(WORDS))).alias(to))


def add(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets of paragraphs together (insertion)."""
    return _combined(a, b, 1)


def subtract(a: Column, b: Column) -> Column:
    """a's fingerprint without b's paragraphs (deletion)."""
    return _combined(a, b, -1)


def _combined(a: Column, b: Column, sign: int) -> Column:
    exact = F.zip_with(F.slice(a, 2, EXACT), F.slice(b, 2, EXACT), lambda x, y: (x + sign * y).bitwiseAND(F.lit((1 << 32) - 1)))
    lanes = F.zip_with(F.slice(a, 2 + EXACT, WORDS), F.slice(b, 2 + EXACT, WORDS), lambda x, y: _joined(_low(x) + sign * _low(y), _high(x) + sign * _high(y)))
    return F.concat(F.array(a[0] + sign * b[0]), exact, lanes)


def _low(w: Column) -> Column:
    return w.bitwiseAND(F.lit((1 << LANE_BITS) - 1))


def _high(w: Column) -> Column:
    return F.shiftright(w, 32)


def _joined(low: Column, high: Column) -> Column:
    return F.shiftleft(_low(high), 32).bitwiseOR(_low(low))


def as_text(fp: Column) -> Column:
    """Sixteen hexadecimal digits for the weight, each exact sum and each word."""
    return F.array_join(F.transform(fp, lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), "")


def signed_lanes(fp: Column) -> Column:
    """The centred lanes, modulo 2**31, as doubles."""

    def centred(lane: Column) -> Column:
        x = F.pmod(2 * lane - fp[0], F.lit(1 << LANE_BITS))
        return F.when(x >= 1 << (LANE_BITS - 1), x - (1 << LANE_BITS)).otherwise(x).cast("double")

    return F.flatten(F.transform(F.slice(fp, 2 + EXACT, WORDS), lambda w: F.array(centred(_low(w)), centred(_high(w)))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def likeness(a: Column, b: Column, ab: Column, aa: Column, bb: Column) -> Column:
    """0 to 1: 1 for equal fingerprints a and b; else the estimated cosine of the multisets (0 if one is empty).

    ab, aa, bb: inner products of the signed lanes.
    """
    cosine = F.when((aa > 0) & (bb > 0), F.least(F.greatest(ab / (F.sqrt(aa) * F.sqrt(bb)), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(cosine)


def with_next(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) with _b, _r, next_text and next_head: text of the next document by descending doc_id; after the last, the first.

    Ties go by a hash of the text, then the text, descending. Null ids come last. Neighbours are sought in buckets of ids, of null
    ids in buckets of text hashes; a bucket's last row gets the first of the next bucket that has rows (then next_head is true),
    found over bucket numbers only, in ranges: no window sees more than a bucket, a range of bucket numbers, or one row per
    range, however sparse ids are. _b and _r number the rows.
    """
    h = F.xxhash64("text")
    rows = rows.withColumn("_b", F.coalesce(F.shiftright("doc_id", BUCKET_BITS), F.shiftright(h, 40) - F.lit(2**62)))
    here = Window.partitionBy("_b").orderBy(F.col("doc_id").desc_nulls_last(), h.desc(), F.col("text").desc())
    heads = rows.withColumn("_r", F.row_number().over(here)).filter("_r = 1").select(F.col("_b").alias("_next"), F.col("text").alias("_head"))
    buckets = stored(rows.select("_b").distinct().repartitionByRange("_b").withColumn("_g", F.spark_partition_id()))
    tops = buckets.groupBy("_g").agg(F.max("_b").alias("_top"))
    every = Window.partitionBy(F.lit(0))  # as many rows as there are ranges
    tops = tops.select("_g", F.coalesce(F.lead("_top").over(every.orderBy(F.col("_g").desc())), F.max("_top").over(every)).alias("_lower"))
    links = buckets.withColumn("_in", F.lead("_b").over(Window.partitionBy("_g").orderBy(F.col("_b").desc()))).join(tops, "_g")
    links = links.select("_b", F.coalesce("_in", "_lower").alias("_next")).join(heads, "_next").drop("_next")
    led = rows.withColumns({"_r": F.row_number().over(here), "_lead": F.lead("text").over(here)}).join(links, "_b", "left")
    return led.withColumns({"next_text": F.coalesce("_lead", "_head"), "next_head": F.col("_lead").isNull()}).drop("_lead", "_head")


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next.

    The edited text is the text whose last third (floor, in code points) is the beginning of the next document's text.
    Null text: empty. A text of under three characters is not changed by the edit. Repeated rows, and rows of one id, are each
    other's neighbours. Null ids come last. Only the two named columns are read. Texts of any length are whole. A single document
    is its own next one. An empty table gives no rows.
    """
    rows = with_next(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    third = F.expr("cast(length(text) div 3 as int)")
    rows = rows.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.length("text") - third), F.col("next_text").substr(F.lit(1), third)))
    rows = rows.select("_b", "_r", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "text", "edited", F.when(F.col("next_head"), F.col("next_text")).alias("beyond"))
    texts = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")), F.struct(F.lit(2).alias("kind"), F.col("beyond").alias("t")))
    rows = rows.select("_b", "_r", "doc_id", "n_chars", "edited_sha256", F.explode(texts).alias("_t")).select("*", "_t.kind", "_t.t").filter("t is not null").drop("_t")
    own = ["_b", "_r", "doc_id", "n_chars", "edited_sha256"]
    fps = fingerprints(rows, [*own, "kind"], "t")
    got = fps.groupBy(*own).agg(*(F.max(F.when(F.col("kind") == k, F.col("fp"))).alias(name) for k, name in enumerate(("fp", "edited_fp", "beyond_fp"))))
    here = Window.partitionBy("_b").orderBy("_r")
    got = got.withColumn("next_fp", F.coalesce(F.lead("fp").over(here), "beyond_fp"))
    lanes = got.withColumns({"_a": signed_lanes(F.col("fp")), "_e": signed_lanes(F.col("edited_fp")), "_x": signed_lanes(F.col("next_fp"))})
    a, e, x = F.col("_a"), F.col("_e"), F.col("_x")
    dots = lanes.withColumns({"_aa": dot(a, a), "_ee": dot(e, e), "_xx": dot(x, x), "_ae": dot(a, e), "_ax": dot(a, x)})
    fp, edited, after = F.col("fp"), F.col("edited_fp"), F.col("next_fp")
    return dots.select(
        "doc_id", "n_chars", "edited_sha256", "fp", "edited_fp",
        likeness(fp, edited, F.col("_ae"), F.col("_aa"), F.col("_ee")).alias("near_edited"), likeness(fp, after, F.col("_ax"), F.col("_aa"), F.col("_xx")).alias("near_next"),
    )
