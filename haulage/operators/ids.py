"""New surrogate ids for inserted rows, the set-based form of
``INSERT ... RETURNING id``.

Ids continue after the table's largest id, in the order of the batch's
``order`` columns: exactly ``max(id) + row_number() OVER (ORDER BY order)``,
but without a single-partition window. The batch is range-partitioned on
the order columns and sorted within each partition, so partition i holds the
i-th range in order; each row's position inside its partition plus the row
count of all earlier partitions gives its rank. The per-partition counts are
one row per partition (bounded by the partition count), so they are
broadcast safely.

The tagged batch is written to the session's shared checkpoint folder
before its two uses (``haulage.session.materialize``): a retried task then
reads the same (partition, position) pairs and allocates the same ids. (The
range partitioner samples its input first, so the batch is read twice up to
there.) Pass only the columns that order the rows and find them again; what
is written lies in the folder until ``haulage.session.release_scratch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulage.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id(): partition index << 33 | row number


def max_id(table: DataFrame, id_col: str) -> int:
    """The largest id of ``table`` (0 for an empty table): one scalar."""
    v = table.agg(F.max(id_col)).first()[0]
    return int(v or 0)


def allocate_ids(batch: DataFrame, id_col: str, order: list[str], base: int,
                 partitions: int | None = None) -> DataFrame:
    """``batch`` with ``id_col`` set to base + 1, base + 2, ... by ``order``.

    ``order`` must be unique within the batch (a change sequence number);
    NULLs come first. Without ``partitions``, the session's setting and AQE's
    coalescing decide how many ranges there are.
    """
    body = batch.drop(id_col) if id_col in batch.columns else batch
    ranged = body.repartitionByRange(partitions, *order) if partitions else body.repartitionByRange(*order)
    tagged = materialize(ranged
                         .sortWithinPartitions(*order)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_pos", F.monotonically_increasing_id()
                                     - F.shiftleft(F.col("_pid").cast("long"), _ROW_BITS)),
                         "ids")
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (tagged.groupBy("_pid").agg(F.count("*").alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .select("_pid", "_off"))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(id_col, (F.lit(base) + F.col("_off") + F.col("_pos") + 1).cast("bigint"))
            .drop("_pid", "_pos", "_off"))
