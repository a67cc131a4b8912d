"""Tables that stay clustered by key: bucketed and sorted files, which joins and aggregations by that key read as they lie.

A shuffle is paid once, when the table is written; whatever asks for the key's rows together afterwards
needs none. Both sides of a join must have the same number of buckets, or one a multiple of the other's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.sources.staging import shared_path


def clustered(df: DataFrame, key: str, buckets: int, name: str | None = None) -> DataFrame:
    """df as a table of `buckets` files, each with the rows of some keys, sorted by key. name: of the table in the catalog, one of its own unless given.

    Buckets are those of Spark's hash of the key, so the rows are dealt out by it once and every bucket is one file. A key with very many
    rows makes its bucket as large; `spread` is for those."""
    return _saved(df.repartition(buckets, key), key, buckets, name)


def spread(df: DataFrame, key: str, buckets: int, name: str | None = None) -> DataFrame:
    """As `clustered`, without a shuffle: every task writes a file for each bucket that it has rows of. Buckets may be many files, and are read by key
    together all the same."""
    return _saved(df, key, buckets, name)


def _saved(df: DataFrame, key: str, buckets: int, name: str | None) -> DataFrame:
    spark, name = df.sparkSession, name or f"clustered_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", shared_path(spark)).saveAsTable(name)
    return spark.table(name)


def clustered_join(r: DataFrame, s: DataFrame, key: str) -> DataFrame:
    """Sort-merge join of two clustered tables; neither is shuffled."""
    return s.join(r.hint("merge"), key)


def per_key(df: DataFrame, key: str, *sums: str) -> DataFrame:
    """(key, n, sums): an aggregation by the key of the clusters, within partitions."""
    return df.groupBy(key).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums))
