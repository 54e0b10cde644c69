"""Jump consistent hashing (Lamping and Veach, 2014): a key and a shard count decide the shard, without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ranked


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each uint64 key; with one more shard, a key stays or moves to the new one."""
    if shards < 1:
        raise ValueError("at least one shard")
    key = keys.astype(np.uint64, copy=True)
    at = np.full(len(key), -1, dtype=np.int64)
    leap = np.zeros(len(key), dtype=np.int64)
    active = np.arange(len(key))
    while len(active):
        at[active] = leap[active]
        key[active] = key[active] * np.uint64(2862933555777941757) + np.uint64(1)
        down = ((key[active] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        leap[active] = ((at[active] + 1) * (float(1 << 31) / down)).astype(np.int64)
        active = active[leap[active] < shards]
    return at.astype(np.int32)


def shard_of(key: str, shards: int) -> Column:
    """Column of a long key's shard; a null key counts as the key of all ones."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return jump(F.coalesce(F.col(key).cast("long"), F.lit(-1).cast("long")))


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 1; text_crc32: of these bytes (of none for null); law: `key`, as doc_id and the
    shard count alone decide; slot: position from 0 in the shard, by doc_id (null first), text_crc32 and size, so that
    rows that repeat get slots of their own; grown_shard: the shard with one shard more. Null text counts as empty, a null
    doc_id as one key; texts of any length are hashed whole; other columns are ignored, whatever their names; a table
    without rows gives none.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = rows.withColumns({"law": F.lit("key"), "shard": shard_of("doc_id", shards), "grown_shard": shard_of("doc_id", shards + 1)})
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()]
    numbered = ranked(rows, order, "shards", within=["shard"]).withColumnRenamed("rank_no", "slot")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8, key: str = "doc_id") -> None:
    """docs as Parquet folders `shard=0` and so on below path; each task writes its part of any shard.

    All columns are kept but one named `shard`, which is refused. Rows without a key and repeated rows are written as they
    are; a table without rows gives a folder without shards.
    """
    if "shard" in docs.columns:
        raise ValueError("docs already has a column named shard")
    docs.withColumn("shard", shard_of(key, shards)).write.partitionBy("shard").parquet(path)
