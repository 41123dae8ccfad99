"""What the operators of this package share: the shared folder, stored tables, exact distributed ranks."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one window partition ranks, on average.
ROWS_PER_BUCKET = 2048
#: Buckets summed by one window partition of the second level.
BUCKETS_PER_GROUP = 1024

_kept: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one of our own, but only if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet into the shared folder and read back: lineage ends there and lost executors lose nothing.

    The folder is removed by release(), or when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _kept.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_stored = (spark, path)
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables that stored() returned, once what was made of them is stored itself: nothing may read them after this."""
    for table in tables:
        spark, path = table._graphloom_stored
        _kept.remove((spark, path))
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    while _kept:
        spark, path = _kept.pop()
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the JVM has gone: nothing is left to remove it with
            return


#: Bytes of an Arrow batch that a Python worker takes at once; documents are large rows.
BATCH_BYTES = "4m"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per Spark application, and bounds what their workers take at once."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if getattr(sc, "_graphloom_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    fd, path = tempfile.mkstemp(prefix="graphloom-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._graphloom_shipped = True


def buckets_for(n_rows: int) -> int:
    return max(1, -(-n_rows // ROWS_PER_BUCKET))


def exact_rank(df: DataFrame, part: list[str], bucket: str, order: list[Column], name: str, total: str | None = None) -> DataFrame:
    """df with its 0-based rank within part, ordered by (bucket, *order), as column name; total: rows of the part.

    bucket must be an int or long column that follows the wanted order. No window holds more than a bucket's rows
    or BUCKETS_PER_GROUP sums, so that a part with a third of all rows is still ranked by many tasks.
    df is read twice: give it stored. Part columns must not be null.
    """
    sums = df.groupBy(*part, bucket).agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.withColumn("_group", (F.col(bucket) / BUCKETS_PER_GROUP).cast("long"))
    groups = sums.groupBy(*part, "_group").agg(F.sum("_n").alias("_gn"))
    by = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
    groups = groups.select(
        *part,
        "_group",
        F.coalesce(F.sum("_gn").over(by.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_gbase"),
        F.sum("_gn").over(by).alias("_total"),
    )
    inner = Window.partitionBy(*part, "_group").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("_base", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(groups, [*part, "_group"])
    base = base.select(*part, bucket, (F.col("_base") + F.col("_gbase")).alias("_base"), "_total")
    within = Window.partitionBy(*part, bucket).orderBy(*order)
    out = df.withColumn("_row", F.row_number().over(within)).join(base, [*part, bucket])
    out = out.withColumn(name, F.col("_base") + F.col("_row") - 1)
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_row", "_base", "_total")
