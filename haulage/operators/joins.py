"""Join shapes that stay safe at any size.

Nothing here counts rows or chooses between plans: each shape is one plan
whose result and safety do not depend on how large a side is. Whether a side
is broadcast is left to Spark's own size checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def narrow(big: DataFrame, rows: DataFrame, keys: list[str] | str) -> DataFrame:
    """Rows of ``big`` whose ``keys`` occur in ``rows``: a semi join against
    the de-duplicated key set of ``rows``. For a small landed batch Spark
    broadcasts the key set, so the large table is scanned, not shuffled; for
    a large one it costs the shuffle that the plain join would have cost."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return big.join(rows.select(*keys).distinct(), keys, "left_semi")


#: Parts that each value of a few-valued key is dealt into.
SALTS = 64


def join_few_valued(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``table`` on a key that may have a handful
    of values (a role), so that one value holds a third of all rows. Each
    value's rows are dealt into ``SALTS`` parts by a hash of the whole row,
    and ``table`` has a copy for each part: a shuffle spreads them, and a
    broadcast of a small ``table`` works as always."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return salted.join(table.withColumn("_salt", parts), [key, "_salt"]).drop("_salt")


def left_join(rows: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join on ``key``, in which a NULL key matches nothing, without
    gathering the NULL rows: they are shuffled by a hash of ``spread``."""
    right = table.withColumnRenamed(key, "_key")
    match = (F.coalesce(F.col(key), F.xxhash64(spread)) == F.col("_key")) & F.col(key).isNotNull()
    return rows.join(right, match, "left").drop("_key")
