"""Tables as Parquet partitioned by a bucket of their key, which is all that a
stream needs to read and rewrite the rows of a few keys: Spark prunes the
partitions by the bucket, and overwrites them dynamically.

A bucket is a hash of the key, so neither new nor clustered keys fill one. The
number of buckets follows the rows at the first write and stays; it is kept
beside the table. Files are cut by size (a rebalance splits a bucket that a hot
key fills).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a bucket holds on average.
BUCKET_ROWS = 2_000_000


def bucket(key: str, n: int) -> Column:
    """Null keys are in bucket 0."""
    return F.coalesce(F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(n)).cast("int"), F.lit(0))


def count_for(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> int:
    """How many buckets the rows ask for."""
    return max(1, -(-rows.count() // bucket_rows))


def write(rows: DataFrame, key: str, path: str, bucket_rows: int = BUCKET_ROWS, n: int | None = None) -> int:
    """Write a table anew, in ``n`` buckets or as its rows ask for; returns
    their number. Without ``n`` the rows are written once before they are counted
    and dealt out, as they may be the result of a long plan."""
    spark = rows.sparkSession
    if not n:
        rows.write.mode("overwrite").parquet(f"{path}-rows")
        rows = spark.read.schema(rows.schema).parquet(f"{path}-rows")
        n = count_for(rows, bucket_rows)
    spark.createDataFrame([(n, rows.schema.json())], "buckets int, schema string").write.mode("overwrite").parquet(f"{path}-layout")
    by_bucket = rows.withColumn("bucket", bucket(key, n)).hint("rebalance", "bucket")
    by_bucket.write.mode("overwrite").partitionBy("bucket").parquet(path)
    return n


def _layout(spark: SparkSession, path: str) -> tuple[int, T.StructType]:
    import json

    row = spark.read.schema("buckets int, schema string").parquet(f"{path}-layout").first()
    return row["buckets"], T.StructType.fromJson(json.loads(row["schema"]))


def schema(spark: SparkSession, path: str) -> T.StructType:
    """The table's columns and its bucket."""
    return _layout(spark, path)[1].add("bucket", T.IntegerType())


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema(spark, path)).parquet(path)


def number(spark: SparkSession, path: str) -> int:
    """How many buckets the table has."""
    return _layout(spark, path)[0]


def touched(keys: DataFrame, key: str, path: str) -> list[int]:
    """The buckets that hold the keys; only their numbers come to the driver."""
    n = number(keys.sparkSession, path)
    if n == 1:
        return [0]
    return [r[0] for r in keys.select(bucket(key, n).alias("b")).distinct().collect()]


def of(keys: DataFrame, key: str, path: str) -> DataFrame:
    """The partitions that hold the keys, whole."""
    return read(keys.sparkSession, path).where(F.col("bucket").isin(touched(keys, key, path)))


def overwrite(partitions: DataFrame, path: str) -> None:
    """Replace the table's partitions that ``partitions`` has rows of."""
    (partitions.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(path))
