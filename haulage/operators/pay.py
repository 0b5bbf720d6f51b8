"""Pay by experience and the crew limit.

The reference leaves both rules to server triggers whose bodies are not
- pay = round(route base pay x multiplier, 2), the multiplier found by the
  driver's experience in a band table (lo <= experience < hi);
- at most ``limit`` drivers per trip, earliest ``seq`` first (then lowest
  driver id); later ones are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.operators.joins import left_join, narrow
from haulage.operators.ordered import running
from haulage.schemas import MONEY
from haulage.sources.tables import Tables

# Our default bands (lo inclusive, hi exclusive, None = open): <5 years 1.0,
# 5-9 years 1.1, 10 and more 1.2.
DEFAULT_BANDS: tuple[tuple[int | None, int | None, str], ...] = (
    (None, 5, "1.00"),
    (5, 10, "1.10"),
    (10, None, "1.20"),
)
MULTIPLIER = T.DecimalType(6, 2)
DEFAULT_CREW_LIMIT = 2


def multiplier(experience: Column, bands=DEFAULT_BANDS) -> Column:
    """The band multiplier of ``experience`` as a CASE expression (no join).
    NULL experience or a gap between bands gives NULL. For bands kept as a
    table, of any size, see ``band_join``."""
    expr = F.lit(None).cast(MULTIPLIER) if not bands else None
    for lo, hi, m in bands:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (experience >= lo)
        if hi is not None:
            cond = cond & (experience < hi)
        value = F.lit(m).cast(MULTIPLIER)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr


def band_table(spark: SparkSession, bands=DEFAULT_BANDS) -> DataFrame:
    """The bands as a DataFrame (lo, hi, multiplier); open ends are NULL."""
    schema = T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()),
                           T.StructField("multiplier", T.StringType())])
    return (spark.createDataFrame(list(bands), schema)
            .withColumn("multiplier", F.col("multiplier").cast(MULTIPLIER)))


_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


def _band_ends(bands: DataFrame) -> DataFrame:
    """The bands that hold a value, their open ends as the least and the
    largest number; the same band twice is one."""
    return bands.select(F.coalesce(F.col("lo").cast("bigint"), F.lit(_LOWEST)).alias("_lo"),
                        F.coalesce(F.col("hi").cast("bigint"), F.lit(_HIGHEST)).alias("_hi"),
                        "lo", "hi", "multiplier").where("_lo < _hi").distinct()


def _judged_bands(bands: DataFrame) -> DataFrame:
    """Bands by lo, then hi and multiplier, with ``overlaps``: it begins
    before a band that comes earlier has ended."""
    b = _band_ends(bands)
    b = running(b, ["_lo", "_hi", "multiplier"], F.col("_hi"), "_upto", "max", before=True)
    return b.withColumn("overlaps", F.coalesce(F.col("_lo") < F.col("_upto"), F.lit(False)))


def band_rejects(bands: DataFrame) -> DataFrame:
    """(lo, hi, multiplier) of the bands that overlap one before them;
    ``band_join`` leaves them out."""
    return _judged_bands(bands).where("overlaps").select("lo", "hi", "multiplier")


def band_join(df: DataFrame, bands: DataFrame, experience: str = "experience") -> DataFrame:
    """Rows and their pay band (#24): lo <= experience < hi, as an as-of merge.

    Bands and the distinct experience values are one sequence ordered by lo
    and value; the last band before a value is its band, unless it has ended.
    The rows then meet their value's multiplier in an equi join that preserves
    them. Both tables may have any size: the sequence is range-partitioned. A
    row outside every band is kept with a NULL multiplier; so is a row of a
    band that is refused because it overlaps one before it (``band_rejects``).
    """
    at = F.col(experience).cast("bigint").alias("at")
    values = df.select(at, F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("end"),
                       F.lit(None).cast(bands.schema["multiplier"].dataType).alias("multiplier")).where("at is not null").distinct()
    good = _judged_bands(bands).where("not overlaps").select(
        F.col("_lo").alias("at"), F.lit(0).alias("kind"), F.col("_hi").alias("end"), "multiplier")
    band = F.when(F.col("kind") == 0, F.struct("end", "multiplier"))
    merged = running(values.unionByName(good), ["at", "kind"], band, "band").where("kind = 1")
    found = merged.where(F.col("at") < F.col("band.end")).select(F.col("at").alias("_value"), F.col("band.multiplier").alias("multiplier"))
    return df.join(found, F.col(experience).cast("bigint") == F.col("_value"), "left").drop("_value")


def pay_bands_by_driver(t: Tables, bands=DEFAULT_BANDS) -> DataFrame:
    """Every driver with the band multiplier of its experience."""
    spark = t.drivers.sparkSession
    return band_join(t.drivers.select("id_driver", "experience"), band_table(spark, bands))


def computed_pay(base_payment: Column, experience: Column, bands=DEFAULT_BANDS) -> Column:
    return F.round(base_payment.cast(MONEY) * multiplier(experience, bands), 2).cast(MONEY)


def needs_pricing(payment: Column) -> Column:
    """The reference stores NULL for "let the server price it" (a negative
    argument); a given payment >= 0 is kept, 0 included."""
    return payment.isNull() | (payment < 0)


def price_assignments(t: Tables, bands=DEFAULT_BANDS, split: bool = True,
                      narrow_tables: bool = False) -> DataFrame:
    """Assignments with every missing payment computed (#34).

    With ``split`` (for stored tables, where re-reading is a scan), only rows
    that need a price go through the three joins (trip -> route, driver)
    and the rest pass through without a shuffle. Without it (for an input
    that is itself an expensive plan, which a two-branch union would compute
    twice), every row goes through the joins once. An assignment whose
    trip, route or driver is missing keeps a NULL payment.

    With ``narrow_tables`` (for few rows against large tables, e.g. a
    stream micro-batch), each dimension is first cut to the keys the rows
    use by a semi join (``operators/joins.py``); for a small batch Spark
    broadcasts the key set, so the large tables are scanned but not
    shuffled, and the outer joins (whose small, preserved side cannot be
    broadcast) then run between small frames.
    """
    a = t.assignments
    trips = t.transportations.select("id_transportation", "id_route")
    routes = t.routes.select("id_route", "base_payment")
    drivers = t.drivers.select("id_driver", "experience")

    def priced(rows: DataFrame) -> DataFrame:
        tr, ro, dr = trips, routes, drivers
        if narrow_tables:
            tr = narrow(tr, rows, "id_transportation")
            ro = narrow(ro, tr, "id_route")
            dr = narrow(dr, rows, "id_driver")
        on_trips = rows.join(tr, "id_transportation", "left")
        return left_join(on_trips, ro, "id_route", "id_transportation").join(dr, "id_driver", "left")

    computed = computed_pay(F.col("base_payment"), F.col("experience"), bands)
    if not split:
        return (priced(a)
                .withColumn("payment", F.when(needs_pricing(F.col("payment")), computed)
                            .otherwise(F.col("payment")))
                .select(*a.columns))
    kept = a.where(~needs_pricing(F.col("payment")))
    todo = priced(a.where(needs_pricing(F.col("payment"))).drop("payment")).withColumn("payment", computed)
    return kept.unionByName(todo.select(*a.columns))


# --- crew limit -------------------------------------------------------------

def crew_order(order: tuple[str, ...]) -> Window:
    return Window.partitionBy("id_transportation").orderBy(*[F.col(c).asc_nulls_last() for c in order])


def crew_limit_accept(assignments: DataFrame, limit: int = DEFAULT_CREW_LIMIT,
                      order: tuple[str, ...] = ("seq", "id_driver")) -> DataFrame:
    """The first ``limit`` assignments of every trip (#31).

    ``row_number() <= limit`` plans with a partial WindowGroupLimit before
    the shuffle, so even a trip holding a third of all rows sends only
    ``limit`` rows per map partition to its task.
    """
    rn = F.row_number().over(crew_order(order))
    return assignments.withColumn("_rn", rn).where(F.col("_rn") <= limit).drop("_rn")


def crew_limit_reject(assignments: DataFrame, limit: int = DEFAULT_CREW_LIMIT,
                      order: tuple[str, ...] = ("seq", "id_driver")) -> DataFrame:
    """Everything ``crew_limit_accept`` refuses: an anti join on the
    (driver, trip) pair, which is unique, so no key is hot. NULL equals NULL
    here, so an accepted row without a driver is not refused as well."""
    accepted = crew_limit_accept(assignments, limit, order).select(
        F.col("id_driver").alias("_d"), F.col("id_transportation").alias("_t"))
    same = F.col("id_driver").eqNullSafe(F.col("_d")) & F.col("id_transportation").eqNullSafe(F.col("_t"))
    return assignments.join(accepted, same, "left_anti")


def crew_limit_overflow(assignments: DataFrame, limit: int = DEFAULT_CREW_LIMIT) -> DataFrame:
    """Trips with more than ``limit`` drivers and their crew size (#30)."""
    return (assignments.groupBy("id_transportation")
            .agg(F.count("*").alias("crew_size"))
            .where(F.col("crew_size") > limit))
