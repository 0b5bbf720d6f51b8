"""Hot keys: one driver and one trip hold a third of all rows; results stay
whole and equal to a brute-force computation."""
import datetime as dt
from decimal import Decimal

import pandas as pd

from haulage import schemas
from haulage.operators import pay, reports
from haulage.sources.tables import Tables


def hot_tables(spark, n=3000):
    drivers = [(d, None, f"L{d}", f"F{d}", None, d % 15) for d in range(1, 51)]
    trips = [(t, 1, dt.datetime(2024, 1, 1), None if t % 3 else dt.datetime(2024, 1, 2)) for t in range(1, 401)]
    rows = []
    for i in range(n):
        d = 1 if i % 3 == 0 else 2 + i % 49          # driver 1: a third of all rows
        t = 1 if i % 3 == 1 else 2 + (i // 3) % 399   # trip 1: another third
        rows.append((d, t, Decimal(i % 97) + Decimal("0.25"), None if i % 5 else Decimal("10.00"), None, i))
    a = pd.DataFrame(rows, columns=[f.name for f in schemas.ASSIGNMENTS]).drop_duplicates(["id_driver", "id_transportation"])
    frames = dict(
        roles=spark.createDataFrame(schemas.ROLE_ROWS, schemas.ROLES),
        users=spark.createDataFrame([], schemas.USERS),
        user_roles=spark.createDataFrame([], schemas.USER_ROLES),
        drivers=spark.createDataFrame(drivers, schemas.DRIVERS),
        routes=spark.createDataFrame([(1, "r", Decimal("1.00"), Decimal("100.00"))], schemas.ROUTES),
        transportations=spark.createDataFrame(trips, schemas.TRANSPORTATIONS),
        assignments=spark.createDataFrame(list(a.itertuples(index=False, name=None)), schemas.ASSIGNMENTS),
    )
    return Tables(**frames), a, pd.DataFrame(trips, columns=["id_transportation", "id_route", "dep", "arr"])


def test_salary_statement_with_hot_driver(spark):
    t, a, trips = hot_tables(spark)
    got = {r.id_driver: r for r in reports.salary_statement(t).collect()}
    m = a.merge(trips, on="id_transportation", how="left")
    for d, g in m.groupby("id_driver"):
        r = got[d]
        assert r.completed_trips == int(g.arr.notna().sum())
        assert r.trips_in_progress == int(g.arr.isna().sum())
        assert abs(r.total_payment - float(sum(g.payment))) < 1e-6
        assert abs(r.total_bonuses - float(sum(x for x in g.bonus_amount if x is not None))) < 1e-6
    assert got[1].completed_trips + got[1].trips_in_progress == len(a[a.id_driver == 1])


def test_crew_limit_with_hot_trip(spark):
    t, a, _ = hot_tables(spark)
    acc = pay.crew_limit_accept(t.assignments)
    hot = sorted(r.seq for r in acc.where("id_transportation = 1").collect())
    assert hot == sorted(a[a.id_transportation == 1].seq)[:2]
    assert acc.count() + pay.crew_limit_reject(t.assignments).count() == len(a)


def test_aqe_splits_the_hot_driver_in_crew_totals(spark):
    """With broadcasts off (a large dimension), AQE's skew join splits the
    hot driver's partition of assignments ⋈ drivers across tasks."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        t, a, _ = hot_tables(spark, 120000)
        t = t.with_(assignments=t.assignments.repartition(8))  # several map tasks, as in any real scan
        df = reports.crew_totals(t.assignments, t.drivers)
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan and "AQEShuffleRead skewed" in plan
        assert sum(len(r.drivers.split(", ")) for r in rows) == len(a)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_narrowed_pricing_gives_the_same(spark):
    from haulage.sources.testdata import load_tables
    from conftest import SMALL_SF
    from pyspark.sql import functions as F
    t = load_tables(spark, SMALL_SF)
    few = t.assignments.where(F.col("id_transportation") % 500 == 1)
    narrowed = pay.price_assignments(t.with_(assignments=few), narrow_tables=True)
    plain = pay.price_assignments(t.with_(assignments=few))
    assert sorted(narrowed.collect()) == sorted(plain.collect())


def test_crew_of_a_hot_trip_as_rows_and_as_text(spark):
    from haulage.operators import boards
    t, a, _ = hot_tables(spark)
    hot = a[a.id_transportation == 1]
    rows = boards.crew_rows(t).where("id_transportation = 1").collect()
    assert sorted(r.id_driver for r in rows) == sorted(hot.id_driver)
    text = reports.transportation_summary(t).where("id_transportation = 1").first().drivers
    assert len(text.split(", ")) == len(hot)


def test_null_keys_are_spread_and_match_nothing(spark):
    """A join that a third of all rows enter with a NULL key deals them out
    by another column."""
    from haulage.operators.joins import left_join
    from pyspark.sql import functions as F
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(3000).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 10).alias("k"))
        table = spark.range(10).select(F.col("id").alias("k"), F.col("id").cast("string").alias("name"))
        out = left_join(rows, table, "k", "id")
        got = {r.id: r.name for r in out.collect()}
        assert got == {i: (str(i % 10) if i % 3 else None) for i in range(3000)}
        sizes = [r[0] for r in out.where("k is null").groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert len(sizes) == 8 and max(sizes) < 4 * min(sizes)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_few_valued_keys_are_dealt_into_parts(spark):
    from haulage.operators.joins import join_few_valued
    from pyspark.sql import functions as F
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(8000).select("id", F.lit(1).cast("long").alias("k"))
        table = spark.createDataFrame([(1, "one"), (2, "two")], "k long, name string")
        out = join_few_valued(rows, table, "k")
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(sizes) == 8000 and len(sizes) == 8 and max(sizes) < 4 * min(sizes)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
