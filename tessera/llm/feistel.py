"""Sharding by a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import mix, parallelism, staged

ROUNDS = 6


def permute(rows: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed bijection of 0..n-1, computed for each row alone.

    A balanced Feistel network permutes 0..4^h-1, the least such domain that holds n; what falls outside 0..n-1 is
    encrypted again until it is inside (fewer than four walks are expected). Any row's place needs no other row.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> h, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return (left << h) | right

    out = once(rows.astype(np.uint64))
    while (far := np.flatnonzero(out >= np.uint64(n))).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


def global_row_numbers(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """df with gapless row numbers from 0 in `order` (nulls first), without a one-task sort.

    Rows are dealt by range and sorted within their range; a count of rows a range (as many as there are partitions)
    gives each range its first number. Rows that are equal in all of `order` may change places with each other.
    """
    n = parallelism(df.sparkSession)
    cut = 1 << 33  # monotonically_increasing_id: partition above bit 33, place in it below
    held = staged(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "rows")
    held = held.withColumn("__part", F.shiftright("__at", 33)).withColumn("__place", F.col("__at") % cut)
    sizes = sorted((r["__part"], r["count"]) for r in held.groupBy("__part").count().collect())
    firsts, total = [], 0
    for part, count in sizes:
        firsts.append((int(part), total))
        total += count
    first = df.sparkSession.createDataFrame(firsts, "__part long, __first long")  # a row a partition
    return held.join(F.broadcast(first), "__part").withColumn(name, F.col("__first") + F.col("__place")).drop("__at", "__part", "__place", "__first")


def shard(docs: DataFrame, shards: int = 24, key: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, law 'rows', shard, slot, grown_shard (null), row_number, place.

    place = the permuted row number (rows numbered by doc_id, then checksum and size); shard = place mod shards and
    slot = place div shards, so shards differ by one row at most and both can be computed from a row number alone.
    size is the text's UTF-8 bytes plus 8. Null or empty texts have size 8 and checksum 0; null ids come first;
    repeated rows each get a place; an empty table gives none; other columns are ignored. Only ids, sizes and
    checksums are shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered = staged(global_row_numbers(rows, ["doc_id", "text_crc32", "size"]), "numbered")
    total = numbered.count()

    @F.pandas_udf(T.LongType())
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), total, key))

    return numbered.withColumn("place", place("row_number")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number", "place",
    )
