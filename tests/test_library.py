from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import chunk, clean


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_trim_takes_all_white_space(spark):
    assert one(spark, "\x1c　 a b\xa0\n", T.trim_ws) == "a b"


def test_page_numbers_and_leaders_go(spark):
    assert one(spark, "Title........9\r\n - 3 - \n\n\n\nbody  text", clean.clean_page) == "Title 9\n\nbody text"


def test_long_text_is_packed_and_cut(spark):
    assert one(spark, "aaa. bbb. " + "c" * 12, lambda x: chunk.split_long(x, 8)) == ["aaa.bbb.", "c" * 8, "c" * 4]


def test_short_units_are_grouped(spark):
    got = spark.sql("SELECT array(5, 5, 20, 3) AS n").select(chunk.group_short(F.col("n"), 10).alias("g")).first()["g"]
    assert got == [0, 0, 1, 2]
