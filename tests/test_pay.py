from pyspark.sql import functions as F

from haulage.operators import pay
from conftest import D, TS


def test_band_edges(spark):
    df = spark.createDataFrame([(4,), (5,), (9,), (10,), (None,)], "experience int")
    got = {r.experience: r.m for r in df.select("experience", pay.multiplier(F.col("experience")).alias("m")).collect()}
    assert got == {4: D(1.0), 5: D(1.1), 9: D(1.1), 10: D(1.2), None: None}


def test_band_join_agrees_with_case(make_tables, spark):
    t = make_tables(drivers=[(i, None, "А", "Б", None, e) for i, e in enumerate([0, 4, 5, 9, 10, 40])])
    joined = {r.id_driver: r.multiplier for r in pay.pay_bands_by_driver(t).collect()}
    case = {r.id_driver: r.m for r in t.drivers.select("id_driver", pay.multiplier(F.col("experience")).alias("m")).collect()}
    assert joined == case


def test_pay_zero_kept_null_and_negative_computed(make_tables):
    t = make_tables(
        drivers=[(1, None, "А", "Б", None, 12)],
        routes=[(7, "r", D(10), D(1000))],
        transportations=[(3, 7, TS("2024-01-01 00:00:00"), None)],
        assignments=[(1, 3, D(0), None, None, 1), (1, 4, None, None, None, 2), (1, 3, D(-1), None, None, 3)],
    )
    # pair (1,3) twice here only to exercise both branches of the rule
    got = sorted((r.seq, r.payment) for r in pay.price_assignments(t).collect())
    assert got == [(1, D(0)), (2, None), (3, D(1200))]  # trip 4 is missing -> stays NULL


def test_third_driver_refused(make_tables):
    t = make_tables(assignments=[(1, 9, None, None, None, 3), (2, 9, None, None, None, 1), (3, 9, None, None, None, 2)])
    acc = {r.id_driver for r in pay.crew_limit_accept(t.assignments).collect()}
    rej = {r.id_driver for r in pay.crew_limit_reject(t.assignments).collect()}
    assert acc == {2, 3} and rej == {1}
    over = [tuple(r) for r in pay.crew_limit_overflow(t.assignments).collect()]
    assert over == [(9, 3)]


def test_accepted_and_rejected_partition_the_input(spark):
    from haulage.sources.testdata import load_tables
    from conftest import SMALL_SF
    a = load_tables(spark, SMALL_SF).assignments
    acc, rej = pay.crew_limit_accept(a), pay.crew_limit_reject(a)
    assert acc.count() + rej.count() == a.count()
    assert acc.unionByName(rej).exceptAll(a).count() == 0
    assert acc.groupBy("id_transportation").count().where("count > 2").count() == 0


def test_any_return_flag_is_taken(spark):
    from haulage.sources.testdata import SOURCE_SCHEMAS, assignments_from_lines
    import datetime as dt
    lines = [(1, 1, 1, n, 1.0, 10.0, disc, 0.0, flag, "F", dt.datetime(2024, 1, 1))
             for n, disc, flag in ((1, 0.07, "RX"), (2, 0.01, "Я"), (3, 0.0, "RA"))]
    r = assignments_from_lines(spark.createDataFrame(lines, SOURCE_SCHEMAS["lineitem"])).first()
    assert r.bonus_reason == "RA" and r.payment == D(30) and r.bonus_amount == D(700) and r.seq == 1


def test_any_number_of_bands(make_tables, spark):
    t = make_tables(drivers=[(i, None, "А", "Б", None, e) for i, e in enumerate([0, 4, 40, 7000, None])])
    bands = pay.band_table(spark, [(i, i + 1, f"{1 + i % 9}.00") for i in range(5000)])
    got = {r.id_driver: r.multiplier for r in pay.band_join(t.drivers.select("id_driver", "experience"), bands).collect()}
    assert got == {0: D(1), 1: D(5), 2: D(5), 3: None, 4: None}


def test_accepted_row_without_driver_is_not_refused_too(make_tables):
    t = make_tables(assignments=[(None, 9, None, None, None, 1), (2, 9, None, None, None, 2), (3, 9, None, None, None, 3)])
    assert [r.id_driver for r in pay.crew_limit_reject(t.assignments).collect()] == [3]
