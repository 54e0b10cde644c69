"""What the operators of this subpackage share: the shared folder, table files and word hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: No block sent to every executor may be larger than this.
MAX_BROADCAST_BYTES = 64 << 20

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Where the setting is missing, a local session gets a folder of its own; a cluster is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        _scratch.append((spark, found))
    return found if "://" in found or found.startswith("file:/") else f"file://{found}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _scratch:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone
            return


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df as a table in the shared folder, dealt and sorted by key, so that joins on key move the other side only."""
    spark = df.sparkSession
    path, own, n = scratch(spark, name), f"{name}_{uuid.uuid4().hex}", partitions(spark)
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(own)
    out = spark.table(own)
    out._shared_path, out._shared_table = path, own
    return out


def forget(*tables: DataFrame | None) -> None:
    """Removes saved or bucketed tables that no later step reads."""
    for df in tables:
        if df is not None:
            if hasattr(df, "_shared_table"):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._shared_table}")
            remove(df.sparkSession, df._shared_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(column):
    """A-Z to a-z, all other characters as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, on a uint64 array."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def seeds(n: int, salt: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def ranked(df: DataFrame, keys: list, name: str, within: list[str] = ()) -> DataFrame:
    """df with `rank_no` long: its gapless position from 0 in the order of keys, for each value of `within` on its own.

    Rows are dealt by range of (within, keys), numbered inside each range, and each range adds the number of rows
    before it; no task holds more than a range, and only one count for each range is ordered in one place. Rows that agree in
    all keys are dealt over several ranges too.
    """
    spark = df.sparkSession
    from pyspark.sql import Window

    order = [*[F.col(c).asc_nulls_first() for c in within], *keys]
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    dealt = saved(salted.repartitionByRange(partitions(spark), *order, F.col("_salt")).drop("_salt").withColumn("_part", F.spark_partition_id()), name)
    counts = dealt.groupBy(*within, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    counts = counts.select(*[F.col(c).alias(f"_{c}") for c in within], F.col("_part").alias("_p"), "_before")
    local = dealt.withColumn("_row", F.row_number().over(Window.partitionBy("_part", *within).orderBy(*keys)))
    on = F.col("_part") == F.col("_p")
    for c in within:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return local.join(counts, on).withColumn("rank_no", F.col("_before") + F.col("_row") - 1).drop("_part", "_p", "_before", "_row", *[f"_{c}" for c in within])


def trimmed() -> None:
    """Gives memory that a Python worker no longer uses back to the system; called at the end of a task."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        return
