"""Physical-plan checks: the plan shapes the operators are written for."""
from haulage.operators import boards, pay, reports
from haulage.sources.testdata import load_tables
from conftest import SMALL_SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_available_accounts_use_hash_joins_only(spark):
    p = plan(boards.available_driver_users(load_tables(spark, SMALL_SF), 7))
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p


def test_crew_limit_uses_window_group_limit(spark):
    p = plan(pay.crew_limit_accept(load_tables(spark, SMALL_SF).assignments))
    assert "WindowGroupLimit" in p


def test_reports_aggregate_partially_before_the_shuffle(spark):
    p = plan(reports.salary_statement(load_tables(spark, SMALL_SF)))
    assert "partial_count" in p and "partial_sum" in p
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_scans_read_only_needed_columns(spark):
    df = reports.salary_statement(load_tables(spark, SMALL_SF))
    p = plan(df)
    assert "l_shipdate" not in p and "l_tax" not in p and "o_totalprice" not in p


def test_no_python_udf_in_batch_operators(spark):
    t = load_tables(spark, SMALL_SF)
    for df in (reports.salary_statement(t), reports.transportation_summary(t), boards.trips_in_progress(t),
               pay.price_assignments(t)):
        p = plan(df)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_small_change_batches_rewrite_tables_without_shuffle_joins(spark):
    """A small landed change batch (here a few in-memory rows) is the build
    side of the rewrite's join: Spark's size check broadcasts it and the
    table streams through, with no sort-merge join. The threshold sits
    between the landed batch files (~1 KB) and the tables (tens of KB) to
    stand in for tables too large to broadcast."""
    from decimal import Decimal
    from haulage.operators import changes
    from haulage.session import materialize
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4000")
    try:
        t = load_tables(spark, SMALL_SF)
        landed = lambda rows, schema: materialize(spark.createDataFrame(rows, schema).coalesce(1), "landed")
        bonus = landed([(2, 1, Decimal("10.00"), "x", 1)], "id_driver long, id_transportation long, "
                       "bonus_amount decimal(18,2), bonus_reason string, seq long")
        pairs = landed([(2, 1)], "id_driver long, id_transportation long")
        trips = landed([(25,)], "id_transportation long")
        for df in (changes.set_bonuses(t.assignments, bonus),
                   changes.remove_assignments(t.assignments, pairs),
                   changes.delete_transportations(t, trips).assignments):
            p = plan(df)
            assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p, p
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
