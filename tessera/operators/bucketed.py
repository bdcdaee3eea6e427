"""Tables written by key, so that joins and roll-ups by that key read them where they lie.

A table is shuffled once, when it is written; the join of two tables of as many buckets by the same key, and a grouping by
it, then need no exchange, however often they run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.lineage import shared_folder

#: Rows of a bucket, about; and the buckets of a table at most. Tables that are joined take the buckets of the larger.
BUCKET_ROWS, MOST_BUCKETS = 2_000_000, 8192


def buckets_for(rows: int, least: int = 8) -> int:
    """A power of two, so that the buckets of tables of unlike sizes divide each other."""
    n = least
    while n < MOST_BUCKETS and n * BUCKET_ROWS < rows:
        n *= 2
    return n


class Bucketed:
    """A table of a catalog name and a folder, by key. A key that is null has a bucket, too."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    @classmethod
    def write(cls, df: DataFrame, key: str, buckets: int | None = None, name: str | None = None, path: str | None = None) -> Bucketed:
        """df by key, sorted by it within buckets; a name and a folder of its own where none is given."""
        spark = df.sparkSession
        n = buckets or buckets_for(df.count())
        name = name or f"by_{key}_{uuid.uuid4().hex[:12]}"
        # a task a bucket, so that each is one sorted file
        rows = df.repartition(n, key)
        rows.write.bucketBy(n, key).sortBy(key).option("path", path or shared_folder(spark, name)).mode("overwrite").saveAsTable(name)
        return cls(spark, name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Forget the name; the files stay where they are."""
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")
