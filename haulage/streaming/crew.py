"""The crew limit over a stream: how many drivers each trip has.

A trip's crew so far is the number of its stored assignments and of the rows
that earlier micro-batches accepted, at most ``limit`` of them for a trip, however
many are offered. They are kept as counts by trip, in buckets (``buckets.py``): a
folder for the stored crews, and one for each micro-batch, which is only ever
written by that micro-batch. A micro-batch joins its rows with the counts of the
buckets that its trips are in. Before rows are shuffled to their
trip, each Arrow batch keeps the first ``limit`` rows of a trip and
refuses the others, none of which could be accepted: a trip that a third of
all rows name sends ``limit`` rows of each Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.streaming import buckets

KEY = "id_transportation"
#: Assignments without a trip are counted under this key.
_NO_TRIP = -(1 << 63)


def _trip() -> Column:
    return F.coalesce(F.col(KEY), F.lit(_NO_TRIP)).cast("bigint").alias("trip")


def in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """Earliest seq first, then the lowest driver; nulls last."""
    return rows.sort_values(["seq", "id_driver"], na_position="last", kind="stable")


def cap(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    """Rows with ``first``: whether they are among the first of their trip in
    this batch."""
    for rows in batches:
        nth = in_order(rows).groupby(KEY, dropna=False).cumcount()
        yield rows.assign(first=nth.reindex(rows.index) < limit)


def store(rows: DataFrame, base: str, bucket_rows: int = buckets.BUCKET_ROWS) -> None:
    """The crews that a stream starts from."""
    crews = rows.groupBy(_trip()).agg(F.count("*").alias("crew"))
    buckets.write(crews, "trip", f"{base}/stored", bucket_rows)


def add(accepted: DataFrame, batch_id: int, base: str) -> None:
    """The crews that a micro-batch accepted."""
    n = buckets.number(accepted.sparkSession, f"{base}/stored")
    crews = accepted.groupBy(_trip()).agg(F.count("*").alias("crew")).withColumn("bucket", buckets.bucket("trip", n))
    crews.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/taken/batch={batch_id}")


def so_far(keys: DataFrame, batch_id: int, base: str) -> DataFrame:
    """trip and crew before a micro-batch, for the buckets of ``keys``."""
    spark: SparkSession = keys.sparkSession
    stored = f"{base}/stored"
    touched = F.col("bucket").isin(buckets.touched(keys, "trip", stored))
    found = buckets.read(spark, stored).where(touched)
    if batch_id:
        schema = T.StructType([*found.schema.fields, T.StructField("batch", T.LongType())])
        taken = spark.read.schema(schema).option("basePath", f"{base}/taken").parquet(f"{base}/taken/batch=*")
        # a replay does not read what it wrote before
        found = found.unionByName(taken.where(touched & (F.col("batch") < batch_id)).drop("batch"))
    return found.groupBy("trip").agg(F.sum("crew").alias("crew"))


def judge(batch: DataFrame, batch_id: int, base: str, limit: int) -> DataFrame:
    """A micro-batch's rows with ``accepted``."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.schema.fields)
    marked = batch.mapInPandas(partial(cap, limit=limit), f"{columns}, first boolean")
    crews = so_far(batch.select(_trip()), batch_id, base)
    rest = [F.col(c).asc_nulls_last() for c in batch.columns if c not in ("seq", "id_driver", KEY)]
    order = Window.partitionBy("trip").orderBy(F.col("seq").asc_nulls_last(), F.col("id_driver").asc_nulls_last(), *rest)
    place = F.row_number().over(order) + F.coalesce("crew", F.lit(0))
    kept = marked.where("first").withColumn("trip", _trip()).join(crews, "trip", "left").select(
        *batch.columns, (place <= limit).alias("accepted"))
    refused = marked.where("not first").select(*batch.columns, F.lit(False).alias("accepted"))
    return kept.unionByName(refused)
