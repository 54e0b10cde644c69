"""Tables in the folder that the driver and all executors share, and gapless numbers over ranges of rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, removed when the program ends. A local session without that setting gets a
    folder of its own; a cluster without it is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
        _made.append((spark, root))
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _made:
        try:
            drop(spark, path)
        except Exception:  # the session may have ended
            return


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that what follows starts from files that outlive executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str = "idx", weight: Column | None = None) -> DataFrame:
    """df with `name` long: how many rows are before a row in the given order, or the sum of `weight` over them.

    Rows are dealt by ranges of the order, whatever the keys look like and however many agree, and kept in the shared
    folder, so that ranges stay as they are; inside a range rows are added up in order, and each range begins with the sum of the
    ranges before it. What is ordered in one place is a row for each range. Rows that agree in the whole order are told apart by their place in the input.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in order]
    each = df.withColumn("_w", (F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))).cast("long")).withColumn("_tie", F.monotonically_increasing_id())
    dealt = kept(each.repartitionByRange(n, *order, "_tie").withColumn("_range", F.spark_partition_id()), "numbered")
    starts = range_starts(dealt)
    inside = Window.partitionBy("_range").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_own", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return own.join(F.broadcast(starts), "_range").withColumn(name, F.col("_own") + F.col("_start")).drop("_range", "_tie", "_w", "_own", "_start")


def range_starts(dealt: DataFrame) -> DataFrame:
    """_range, _start: the sum of _w in all ranges before; a row for each range that has rows."""
    sums = dealt.groupBy("_range").agg(F.sum("_w").alias("_w"))
    return sums.select("_range", F.coalesce(F.sum("_w").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
