"""Running values over a whole table's order, without gathering it in one task.

``running`` is ``last(value) IGNORE NULLS`` or ``max(value)`` over all rows up
to the current one. The rows are range-partitioned by the order and each
partition computes its own; what earlier partitions end with is one row for
each partition (bounded by their number), so it is carried by a broadcast
join. The ranged rows are written to the shared folder first, so a retried task
reads the same partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulage.session import materialize


def running(rows: DataFrame, order: list[str], value: Column, name: str, how: str = "last",
            before: bool = False) -> DataFrame:
    """``rows`` and the running ``value`` as column ``name`` ('last' skips
    nulls, 'max' is the largest), with the row itself or, with ``before``,
    without it. Rows of equal order come in any order."""
    agg = {"last": lambda c: F.last(c, ignorenulls=True), "max": F.max}[how]
    ranged = materialize(rows.withColumn("_v", value).repartitionByRange(*order)
                         .withColumn("_pid", F.spark_partition_id()), "ordered")
    inside = Window.partitionBy("_pid").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    end = F.max(F.struct(F.struct(*order), "_v"))["_v"] if how == "last" else F.max("_v")
    ends = ranged.where("_v is not null").groupBy("_pid").agg(end.alias("_end"))
    pids = ranged.select("_pid").distinct().join(ends, "_pid", "left")
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = pids.select("_pid", agg(F.col("_end")).over(earlier).alias("_carried"))
    own = agg(F.col("_v")).over(upto)
    joined = ranged.withColumn("_own", own).join(F.broadcast(carried), "_pid", "left")
    value = F.coalesce("_own", "_carried") if how == "last" else F.greatest("_own", "_carried")
    return joined.withColumn(name, value).drop("_pid", "_v", "_own", "_carried")
