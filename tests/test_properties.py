from pyspark.sql import functions as F

from haulage.operators import reports
from haulage.sources.testdata import load_tables
from conftest import SMALL_SF


def test_statement_totals_equal_assignment_totals(spark):
    t = load_tables(spark, SMALL_SF)
    s = reports.salary_statement(t).agg(F.sum("total_payment"), F.sum("total_bonuses")).first()
    a = t.assignments.agg(F.sum("payment"), F.sum("bonus_amount")).first()
    assert round(s[0], 2) == float(a[0]) and round(s[1], 2) == float(a[1])


def test_sum_over_drivers_equals_sum_over_trips(spark):
    t = load_tables(spark, SMALL_SF)
    by_driver = reports.salary_statement(t).agg(F.sum("total_earned")).first()[0]
    by_trip = reports.transportation_summary(t).agg(F.sum("total_transportation_cost")).first()[0]
    assert round(by_driver, 2) == round(by_trip, 2)


def test_trip_counts_add_up(spark):
    t = load_tables(spark, SMALL_SF)
    s = reports.salary_statement(t).agg(F.sum("completed_trips"), F.sum("trips_in_progress")).first()
    assert s[0] + s[1] == t.assignments.count()


def test_one_row_per_driver_and_trip(spark):
    t = load_tables(spark, SMALL_SF)
    assert reports.salary_statement(t).count() == t.drivers.count()
    assert reports.transportation_summary(t).count() == t.transportations.count()
