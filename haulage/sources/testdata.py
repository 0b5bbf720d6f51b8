"""Adapter: the TPC-H-like test tables mapped onto the seven domain tables.

The mapping is fixed in FIXTURES.md §2 and mirrored, expression for
expression, by ``haulage.plans.oracle.ADAPTER`` for the DuckDB oracle.
Source keys start at 0, so every id is source key + 1 (0 means "none").

Everything is lazy: a query that needs only drivers never reads lineitem.
The two lineitem aggregates (per order, per order and supplier) are
shuffle aggregations with map-side partial aggregation, so a hot order or
supplier never reaches one task whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage import schemas
from haulage.sources.tables import Tables


# The source tables' schemas, declared so that reading them runs no
# schema-inference job (one per read otherwise; at scale, a footer scan).
SOURCE_SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
             "p_retailprice double"),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                 "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                 "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in SOURCE_SCHEMAS:
        reader = reader.schema(SOURCE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The role of an order's customer: the leading digit of the priority (1-5),
# dealt over the four roles.
_ROLE_OF_ORDER = "(try_cast(substring(o_orderpriority, 1, 1) AS BIGINT) - 1) % 4 + 1"


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles that orders give, under their fixed names."""
    used = source(spark, sf_dir, "orders").selectExpr(f"{_ROLE_OF_ORDER} AS id_role").distinct()
    return spark.createDataFrame(schemas.ROLE_ROWS, schemas.ROLES).join(used, "id_role", "left_semi")


# The builders below use SQL expression strings (``selectExpr``/``expr``):
# the same Catalyst plan as Column objects, with a fraction of the Python-JVM
# round trips when the plan is built.

def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One password per custkey % 5 class, covering each outcome
    # of the password policy (too short, no upper, no digit, no special, ok).
    return source(spark, sf_dir, "customer").selectExpr(
        "c_custkey + 1 AS id_user",
        "c_name AS login",
        """CASE c_custkey % 5 WHEN 0 THEN 'Ab1#' WHEN 1 THEN 'abcdefg#1' WHEN 2 THEN 'Abcdefgh#'
                WHEN 3 THEN 'Abcdefg12' ELSE concat(c_mktsegment, '#', CAST(c_custkey AS STRING)) END AS password""")


def user_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order links its customer to the order's role."""
    return (source(spark, sf_dir, "orders")
            .selectExpr("o_custkey + 1 AS id_user", f"{_ROLE_OF_ORDER} AS id_role")
            .where("id_role is not null")
            .distinct())


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir, "part").selectExpr(
        "p_partkey + 1 AS id_route",
        "p_name AS route_name",
        "CAST(p_size * 100 AS DECIMAL(18,2)) AS distance",
        "CAST(p_retailprice AS DECIMAL(18,2)) AS base_payment")


def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey + 1 AS id_driver",
        "CAST(CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey + 1 END AS BIGINT) AS id_user",
        "s_name AS last_name",
        "concat('F', CAST(s_suppkey % 7 AS STRING)) AS first_name",
        "CASE WHEN s_suppkey % 3 <> 0 THEN concat('M', CAST(s_suppkey % 4 AS STRING)) END AS middle_name",
        "CAST(s_nationkey AS INT) AS experience")


def transportations(spark: SparkSession, sf_dir: str) -> DataFrame:
    first_part = (source(spark, sf_dir, "lineitem")
                  .groupBy("l_orderkey").agg(F.expr("min(l_partkey) AS min_part")))
    o = source(spark, sf_dir, "orders")
    return (o.join(first_part, o.o_orderkey == first_part.l_orderkey, "left")
            .selectExpr("o_orderkey + 1 AS id_transportation",
                        "min_part + 1 AS id_route",
                        "o_orderdate AS departure_date",
                        """CASE WHEN o_orderstatus = 'F'
                                THEN timestampadd(DAY, CAST(o_orderkey % 10 + 1 AS INT), o_orderdate) END
                           AS arrival_date"""))


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignments_from_lines(source(spark, sf_dir, "lineitem"))


def assignments_from_lines(li: DataFrame) -> DataFrame:
    """One assignment per (supplier, order) of the line items.

    Pay is summed as exact integer cents of the decimal(18,2) value: the
    same total as a decimal sum, with a fixed-width (hash-aggregate) buffer.
    The smallest return flag is a string minimum, which makes the aggregate
    sort-based; it holds for any flag.
    """
    g = li.groupBy("l_suppkey", "l_orderkey").agg(
        F.expr("CAST(CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS DECIMAL(20,0))"
               " / 100 AS DECIMAL(18,2)) AS pay"),
        F.expr("CAST(max(l_discount) AS DECIMAL(4,2)) AS m"),
        F.expr("min(l_returnflag) AS flag"),
        F.expr("min(l_linenumber) AS seq"))
    return g.selectExpr(
        "l_suppkey + 1 AS id_driver",
        "l_orderkey + 1 AS id_transportation",
        "CASE WHEN l_orderkey % 4 <> 0 THEN pay END AS payment",
        "CASE WHEN m >= 0.05 THEN CAST(m * 10000 AS DECIMAL(18,2)) END AS bonus_amount",
        "CASE WHEN m >= 0.05 THEN flag END AS bonus_reason",
        "CAST(seq AS INT) AS seq")


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All seven tables over the test data in ``sf_dir``; each is built on
    first use (and all of them are lazy DataFrames)."""
    return Tables(
        roles=lambda: roles(spark, sf_dir),
        users=lambda: users(spark, sf_dir),
        user_roles=lambda: user_roles(spark, sf_dir),
        drivers=lambda: drivers(spark, sf_dir),
        routes=lambda: routes(spark, sf_dir),
        transportations=lambda: transportations(spark, sf_dir),
        assignments=lambda: assignments(spark, sf_dir),
    )
