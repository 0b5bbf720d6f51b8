"""The seven tables read from the reference's own database over JDBC.

The reference keeps its tables in PostgreSQL. ``read_tables_jdbc`` reads
them as partitioned JDBC scans: each table is split into ``partitions``
ranges of its integer key, so the read is spread over the executors rather
than done by one connection. Types are then cast to the library's schemas.

Needs the PostgreSQL JDBC driver on the cluster's classpath. Not exercised
in this repository's tests: there is no driver jar and no database here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage import schemas
from haulage.sources.tables import TABLE_NAMES, Tables

# The reference's table names and the key each one is split on.
SOURCE_TABLES = {
    "roles": ("Roles", "id_role"),
    "users": ("Users", "id_user"),
    "user_roles": ("User_Roles", "id_user"),
    "drivers": ("Drivers", "id_driver"),
    "routes": ("Routes", "id_route"),
    "transportations": ("Transportations", "id_transportation"),
    "assignments": ("Driver_Transportations", "id_transportation"),
}


def _bounds(spark: SparkSession, url: str, props: dict, table: str, key: str) -> tuple[int, int]:
    """min/max of the key, computed by the database (one row back)."""
    row = (spark.read.jdbc(url, f"(SELECT min({key}) AS lo, max({key}) AS hi FROM {table}) b",
                           properties=props).first())
    return int(row["lo"] or 0), int(row["hi"] or 0)


def read_table_jdbc(spark: SparkSession, url: str, props: dict, name: str, partitions: int) -> DataFrame:
    table, key = SOURCE_TABLES[name]
    lo, hi = _bounds(spark, url, props, table, key)
    raw = spark.read.jdbc(url, table, column=key, lowerBound=lo, upperBound=hi + 1,
                          numPartitions=max(1, partitions), properties=props)
    cols = {c.lower(): c for c in raw.columns}
    schema = schemas.ALL[name]
    # A column the database lacks (the assignments' ``seq``, ours) reads as
    # NULL; the crew limit then orders by driver id.
    return raw.select(*[F.col(cols[f.name.lower()]).cast(f.dataType).alias(f.name) if f.name.lower() in cols
                        else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_tables_jdbc(spark: SparkSession, url: str, user: str, password: str,
                     partitions: int = 64, driver: str = "org.postgresql.Driver") -> Tables:
    """All seven tables from the database at ``url``, each read lazily on
    first use."""
    props = {"user": user, "password": password, "driver": driver}
    return Tables(**{n: (lambda n=n: read_table_jdbc(spark, url, props, n, partitions)) for n in TABLE_NAMES})
