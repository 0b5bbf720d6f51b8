"""The two analytic reports (salary statement, trip cost summary) and their
captioned forms.

The reference reads both from server views whose bodies are not shown; the
- completed / under way: the trip's arrival is set / NULL (trip must exist);
- totals count every assignment of the driver, NULL pay or bonus as 0;
- total earned = payment + bonuses; drivers without trips are kept with zeros;
- a trip's ``drivers`` is the crew's full names joined by ", " in binary
  order, NULL when there is no crew; its totals are then 0.

Plan shape: the assignments meet their trip's status (or driver's name) in a
join that preserves them, a hot key split by AQE; they are then aggregated
per driver or trip with partial + final aggregation, and the one-row-per-key
result is joined to the dimension. No join here sees a hot key on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.functions.text import full_name, sorted_list
from haulage.operators.joins import left_join
from haulage.schemas import MONEY
from haulage.sources.tables import Tables


def _zero():
    return F.lit(0).cast(MONEY)

# The Russian captions the reference gives the report columns.
SALARY_CAPTIONS = {
    "id_driver": "ID Водителя",
    "driver_full_name": "ФИО Водителя",
    "experience_years": "Стаж (лет)",
    "completed_trips": "Завершенные рейсы",
    "trips_in_progress": "Рейсы в пути",
    "total_payment": "Начислено оплаты (руб)",
    "total_bonuses": "Начислено премий (руб)",
    "total_earned": "Итого выплачено (руб)",
}
SUMMARY_CAPTIONS = {
    "id_transportation": "ID Рейса",
    "route_name": "Название маршрута",
    "distance_km": "Расстояние (км)",
    "departure_date": "Дата отправления",
    "arrival_date": "Дата прибытия",
    "drivers": "Водители",
    "total_drivers_payment": "Зарплаты водителей (руб)",
    "total_drivers_bonuses": "Премии водителей (руб)",
    "total_transportation_cost": "Общая себестоимость (руб)",
}


SALARY_SUMS = ("completed_trips", "trips_in_progress", "total_payment", "total_bonuses", "total_earned")
SUMMARY_SUMS = ("total_drivers_payment", "total_drivers_bonuses", "total_transportation_cost")


def with_trip_status(assignments: DataFrame, transportations: DataFrame) -> DataFrame:
    """Assignments with ``under_way``: their trip's arrival is NULL; NULL
    when the trip does not exist."""
    status = transportations.select(
        "id_transportation", F.col("arrival_date").isNull().alias("under_way"))
    return (assignments.select("id_driver", "id_transportation", "payment", "bonus_amount")
            .join(status, "id_transportation", "left"))


def totals_by_driver(rows: DataFrame) -> DataFrame:
    """Per driver: completed and under-way trip counts, pay and bonus sums,
    over assignment rows carrying ``under_way``."""
    return (rows.groupBy("id_driver")
            .agg(F.count_if(~F.col("under_way")).alias("completed_trips"),
                 F.count_if(F.col("under_way")).alias("trips_in_progress"),
                 F.sum(F.coalesce("payment", _zero())).alias("pay"),
                 F.sum(F.coalesce("bonus_amount", _zero())).alias("bonus")))


def driver_totals(assignments: DataFrame, transportations: DataFrame) -> DataFrame:
    """Per driver: completed and under-way trip counts, pay and bonus sums."""
    return totals_by_driver(with_trip_status(assignments, transportations))


def salary_statement(t: Tables) -> DataFrame:
    """One row per driver."""
    totals = driver_totals(t.assignments, t.transportations)
    return salary_rows(t.drivers, totals)


def salary_rows(drivers: DataFrame, totals: DataFrame) -> DataFrame:
    """Join per-driver totals to the drivers and shape the report row."""
    return with_salary(drivers.select("id_driver", full_name().alias("driver_full_name"),
                                      F.col("experience").alias("experience_years")), totals)


def with_salary(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows of the salary statement with the counts and sums of ``totals`` (and
    its other columns)."""
    pay = F.coalesce("pay", _zero())
    bonus = F.coalesce("bonus", _zero())
    more = [c for c in totals.columns if c not in ("id_driver", "completed_trips", "trips_in_progress", "pay", "bonus")]
    return rows.drop(*SALARY_SUMS).join(totals, "id_driver", "left").select(
        *[c for c in rows.columns if c not in SALARY_SUMS], *more,
        F.coalesce("completed_trips", F.lit(0)).cast("bigint").alias("completed_trips"),
        F.coalesce("trips_in_progress", F.lit(0)).cast("bigint").alias("trips_in_progress"),
        pay.cast("double").alias("total_payment"),
        bonus.cast("double").alias("total_bonuses"),
        (pay + bonus).cast("double").alias("total_earned"))


def crew_totals(assignments: DataFrame, drivers: DataFrame) -> DataFrame:
    """Per trip: crew names, pay and bonus sums. A missing driver counts as
    an empty name, as on the boards; a trip's names are one value, however
    many (``boards.crew_rows`` has them as rows).

    The driver names are joined before grouping (a name list needs them);
    a hot driver in this join is split by AQE's skew-join handling, and the
    aggregation by trip is partial + final.
    """
    names = drivers.select("id_driver", full_name().alias("driver_name"))
    return (assignments.select("id_driver", "id_transportation", "payment", "bonus_amount")
            .join(names, "id_driver", "left")
            .withColumn("driver_name", F.coalesce("driver_name", F.lit("")))
            .groupBy("id_transportation")
            .agg(sorted_list("driver_name").alias("drivers"),
                 F.sum(F.coalesce("payment", _zero())).alias("pay"),
                 F.sum(F.coalesce("bonus_amount", _zero())).alias("bonus")))


def totals_by_trip(rows: DataFrame) -> DataFrame:
    """Per trip: pay and bonus sums."""
    return rows.groupBy("id_transportation").agg(F.sum(F.coalesce("payment", _zero())).alias("pay"),
                                                 F.sum(F.coalesce("bonus_amount", _zero())).alias("bonus"))


def transportation_summary(t: Tables) -> DataFrame:
    """One row per trip."""
    return summary_rows(t.transportations, t.routes, crew_totals(t.assignments, t.drivers))


def summary_rows(transportations: DataFrame, routes: DataFrame, crew: DataFrame) -> DataFrame:
    """Join trips, routes and per-trip totals and shape the report row."""
    route = routes.select("id_route", "route_name", "distance")
    rows = left_join(transportations, route, "id_route", "id_transportation").select(
        "id_transportation", "route_name", F.col("distance").cast("double").alias("distance_km"),
        "departure_date", "arrival_date")
    return with_costs(rows, crew)


def with_costs(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows of the trip summary with the sums of ``totals`` (and its other
    columns)."""
    pay = F.coalesce("pay", _zero())
    bonus = F.coalesce("bonus", _zero())
    more = [c for c in totals.columns if c not in ("id_transportation", "pay", "bonus")]
    return rows.drop(*SUMMARY_SUMS).join(totals, "id_transportation", "left").select(
        *[c for c in rows.columns if c not in SUMMARY_SUMS], *more,
        pay.cast("double").alias("total_drivers_payment"),
        bonus.cast("double").alias("total_drivers_bonuses"),
        (pay + bonus).cast("double").alias("total_transportation_cost"))


def captioned(df: DataFrame, captions: dict[str, str]) -> DataFrame:
    """Rename report columns to their on-screen captions."""
    return df.withColumnsRenamed(captions)


def salary_statement_captioned(t: Tables) -> DataFrame:
    return captioned(salary_statement(t), SALARY_CAPTIONS)


def transportation_summary_captioned(t: Tables) -> DataFrame:
    return captioned(transportation_summary(t), SUMMARY_CAPTIONS)
