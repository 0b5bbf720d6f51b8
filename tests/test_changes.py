from pyspark.sql import functions as F, Window

from haulage.operators import changes
from haulage.operators.ids import allocate_ids
from conftest import D, TS


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_allocate_ids_equals_row_number(spark):
    batch = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("seq"), F.lit("x").alias("v"))
    got = allocate_ids(batch, "id_route", ["seq"], base=100, partitions=7)
    want = batch.withColumn("id_route", 100 + F.row_number().over(Window.orderBy("seq")))
    assert rows(got, "seq", "id_route") == rows(want, "seq", "id_route")


def test_upsert_latest_wins_absent_key_ignored_and_inserts(make_tables, spark):
    t = make_tables(routes=[(1, "a", D(10), D(100)), (2, "b", D(20), D(200))])
    ch = spark.createDataFrame([
        (1, "a1", D(11), D(101), 5), (1, "a2", D(12), D(102), 9), (50, "zz", D(1), D(1), 1),
        (None, "new1", D(3), D(3), 4), (None, "new2", D(4), D(4), 2),
    ], "id_route long, route_name string, distance decimal(18,2), base_payment decimal(18,2), seq long")
    out = changes.upsert_routes(t.routes, ch)
    assert rows(out, "id_route", "route_name") == [(1, "a2"), (2, "b"), (3, "new2"), (4, "new1")]
    # applying the same batch of updates twice is the same as once
    upd = ch.where(F.col("id_route").isNotNull())
    once = changes.upsert_routes(t.routes, upd)
    twice = changes.upsert_routes(once, upd)
    assert rows(once, "id_route", "route_name", "base_payment") == rows(twice, "id_route", "route_name", "base_payment")


def test_driver_account_zero_becomes_null(make_tables, spark):
    t = make_tables(drivers=[(1, 5, "А", "Б", None, 3)])
    ch = spark.createDataFrame([(1, 0, "А", "Б", None, 4, 1)],
                               "id_driver long, id_user long, last_name string, first_name string, middle_name string, experience int, seq long")
    r = changes.upsert_drivers(t.drivers, ch).first()
    assert r.id_user is None and r.experience == 4


def test_unfinished_trip_has_null_arrival(make_tables, spark):
    t = make_tables(transportations=[(1, 1, TS("2024-01-01 00:00:00"), TS("2024-01-02 00:00:00"))])
    ch = spark.createDataFrame([(1, 1, TS("2024-01-01 00:00:00"), TS("2024-01-05 00:00:00"), False, 1)],
                               "id_transportation long, id_route long, departure_date timestamp_ntz, arrival_date timestamp_ntz, completed boolean, seq long")
    assert changes.upsert_transportations(t.transportations, ch).first().arrival_date is None


def test_bonus_on_absent_pair_changes_nothing(make_tables, spark):
    t = make_tables(assignments=[(1, 1, D(10), None, None, 1)])
    ch = spark.createDataFrame([(1, 2, D(5), "x", 1), (1, 1, D(7), "y", 1)],
                               "id_driver long, id_transportation long, bonus_amount decimal(18,2), bonus_reason string, seq long")
    assert rows(changes.set_bonuses(t.assignments, ch), "id_driver", "id_transportation", "bonus_amount", "bonus_reason") == [
        (1, 1, D(7), "y")]


def test_assign_drivers_respects_existing_crew(make_tables, spark):
    t = make_tables(
        drivers=[(i, None, "А", "Б", None, 12) for i in (1, 2, 3, 4)],
        routes=[(7, "r", D(10), D(1000))],
        transportations=[(9, 7, TS("2024-01-01 00:00:00"), None)],
        assignments=[(1, 9, D(5), None, None, 1)],
    )
    batch = spark.createDataFrame([(1, 9, None, 1), (2, 9, None, 3), (3, 9, D(0), 2), (4, 8, None, 4)],
                                  "id_driver long, id_transportation long, payment decimal(18,2), seq int")
    res = changes.assign_drivers(t, batch)
    assert rows(res.assignments, "id_driver", "payment") == [(1, D(5)), (3, D(0))]
    assert rows(res.rejected, "id_driver", "reason") == [(1, "duplicate"), (2, "crew_limit"), (4, "unknown_trip")]


def test_register_users_unknown_role_rejects_whole_user(make_tables, spark):
    t = make_tables(users=[(1, "a", "x")], drivers=[(5, 1, "А", "Б", None, 1)])
    batch = spark.createDataFrame([
        (10, "ok", "Abcdefg#1", ["Водитель", "Механик"], "Иванов", "Иван", None, 3),
        (11, "bad", "Abcdefg#1", ["Водитель", "X"], "Петров", "Пётр", None, 3),
        (12, "weak", "abc", ["Механик"], None, None, None, None),
    ], "reg_seq long, login string, password string, roles array<string>, last_name string, first_name string, middle_name string, experience int")
    res = changes.register_users(t, batch)
    assert rows(res.users, "id_user", "login") == [(1, "a"), (2, "ok")]
    assert rows(res.user_roles, "id_user", "id_role") == [(2, 3), (2, 4)]
    assert rows(res.drivers, "id_driver", "id_user", "last_name") == [(5, 1, "А"), (6, 2, "Иванов")]
    assert rows(res.rejected, "reg_seq", "rule") == [(11, "unknown_role:X"), (12, "password_too_short")]


def test_replace_roles_exactly(make_tables, spark):
    t = make_tables(user_roles=[(1, 1), (1, 2), (2, 1)])
    batch = spark.createDataFrame([(1, "Механик"), (2, "Механик"), (2, "X")], "id_user long, role_name string")
    res = changes.replace_user_roles(t.user_roles, t.roles, batch)
    assert rows(res.user_roles, "id_user", "id_role") == [(1, 4), (2, 1)]


def test_delete_user_keeps_driver_without_account(make_tables, spark):
    t = make_tables(users=[(1, "a", "x"), (2, "b", "y")], user_roles=[(1, 3), (2, 3)],
                    drivers=[(1, 1, "А", "Б", None, 1), (2, 2, "В", "Г", None, 1)])
    res = changes.delete_users(t, spark.createDataFrame([(1,)], "id_user long"))
    assert rows(res.users, "id_user") == [(2,)]
    assert rows(res.user_roles, "id_user") == [(2,)]
    assert rows(res.drivers, "id_driver", "id_user") == [(1, None), (2, 2)]


def test_route_in_use_refused(make_tables, spark):
    t = make_tables(routes=[(1, "a", D(1), D(1)), (2, "b", D(1), D(1))],
                    transportations=[(1, 1, TS("2024-01-01 00:00:00"), None)])
    res = changes.delete_routes(t, spark.createDataFrame([(1,), (2,)], "id_route long"))
    assert rows(res.table, "id_route") == [(1,)]
    assert rows(res.refused, "id_route") == [(1,)]


def test_delete_trip_cascades(make_tables, spark):
    t = make_tables(transportations=[(1, 1, TS("2024-01-01 00:00:00"), None), (2, 1, TS("2024-01-01 00:00:00"), None)],
                    assignments=[(1, 1, None, None, None, 1), (1, 2, None, None, None, 1)])
    res = changes.delete_transportations(t, spark.createDataFrame([(1,)], "id_transportation long"))
    assert rows(res.transportations, "id_transportation") == [(2,)]
    assert rows(res.assignments, "id_transportation") == [(2,)]


def test_assign_refuses_for_the_first_broken_rule_only(make_tables, spark):
    t = make_tables(drivers=[(1, None, "А", "Б", None, 1)],
                    transportations=[(9, 1, TS("2024-01-01 00:00:00"), None)],
                    assignments=[(1, 9, D(1), None, None, 1)])
    batch = spark.createDataFrame([(1, 9, None, 2), (5, 7, None, 3), (1, 7, None, 4)],
                                  "id_driver long, id_transportation long, payment decimal(18,2), seq int")
    res = changes.assign_drivers(t, batch)
    assert rows(res.rejected, "id_driver", "id_transportation", "reason") == [
        (1, 7, "unknown_trip"), (1, 9, "duplicate"), (5, 7, "unknown_driver")]


BONUS = "id_driver long, id_transportation long, bonus_amount decimal(18,2), bonus_reason string, seq long"


def test_change_without_seq_is_the_oldest_and_erases_nothing(make_tables, spark):
    t = make_tables(assignments=[(1, 1, D(10), D(7), "x", 1), (2, 1, D(10), D(7), "x", 1)])
    ch = spark.createDataFrame([(1, 1, D(3), "new", None), (2, 1, D(3), "new", None), (2, 1, D(4), "newer", -5)], BONUS)
    assert rows(changes.set_bonuses(t.assignments, ch), "id_driver", "bonus_amount", "bonus_reason") == [
        (1, D(3), "new"), (2, D(4), "newer")]


def test_writes_trim_and_refuse_what_the_forms_refuse(make_tables, spark):
    t = make_tables(routes=[(1, "a", D(10), D(100))], users=[(1, "a", "Old#0000"), (2, "b", "Old#0000")],
                    assignments=[(1, 1, D(10), D(7), "x", 1)], drivers=[(1, None, "А", "Б", None, 3)])
    routes = spark.createDataFrame([(1, "\t b c\u00a0", D(11), D(101), 1), (1, " \u2003", D(11), D(0), 2), (None, "n", D("0.5"), D(-1), 3)],
                                   "id_route long, route_name string, distance decimal(18,2), base_payment decimal(18,2), seq long")
    assert rows(changes.upsert_routes(t.routes, routes), "id_route", "route_name", "distance") == [(1, "b c", D(11))]
    assert rows(changes.route_rejects(routes), "seq", "rule") == [(2, "name_empty"), (3, "base_payment_range"), (3, "distance_range")]
    bonus = spark.createDataFrame([(1, 1, D(-5), "", 9), (1, 1, D(5), " y ", 1)], BONUS)
    assert rows(changes.set_bonuses(t.assignments, bonus), "bonus_amount", "bonus_reason") == [(D(5), "y")]
    assert rows(changes.bonus_rejects(bonus), "seq", "rule") == [(9, "bonus_range"), (9, "reason_empty")]
    words = spark.createDataFrame([(1, "weak", 2), (2, " New#0000 ", 1)], "id_user long, password string, seq long")
    assert rows(changes.update_user_passwords(t.users, words), "id_user", "password") == [(1, "Old#0000"), (2, " New#0000 ")]
    assert changes.password_rejects(words).columns == ["id_user", "seq", "rule"]
    assert rows(changes.password_rejects(words), "id_user", "rule") == [(1, "password_too_short")]
    drivers = spark.createDataFrame([(1, 0, "\tВ ", "Г", None, 4, 1), (1, 0, "В", "\u00a0", None, 99, 2)],
                                    "id_driver long, id_user long, last_name string, first_name string, middle_name string, experience int, seq long")
    assert rows(changes.upsert_drivers(t.drivers, drivers), "id_driver", "last_name", "experience") == [(1, "В", 4)]
    assert rows(changes.driver_rejects(drivers), "seq", "rule") == [(2, "experience_range"), (2, "first_name_empty")]


def test_assign_keeps_a_given_pay_without_seq(make_tables, spark):
    t = make_tables(drivers=[(1, None, "А", "Б", None, 1)], routes=[(7, "r", D(1), D(100))],
                    transportations=[(9, 7, TS("2024-01-01 00:00:00"), None)])
    batch = spark.createDataFrame([(1, 9, D(77), None)], "id_driver long, id_transportation long, payment decimal(18,2), seq int")
    assert rows(changes.assign_drivers(t, batch).assignments, "id_driver", "payment") == [(1, D(77))]


def test_registered_values_are_trimmed_and_no_password_is_written(make_tables, spark, monkeypatch):
    from haulage.operators import ids
    written = []
    monkeypatch.setattr(ids, "materialize", lambda df, purpose: written.append(df.columns) or df.cache())
    batch = spark.createDataFrame([(10, " ok\u00a0", "Abcdefg#1", ["Водитель"], "\tИванов", " Иван", None, 3)],
                                  "reg_seq long, login string, password string, roles array<string>, last_name string, first_name string, middle_name string, experience int")
    res = changes.register_users(make_tables(users=[(1, "a", "x")]), batch)
    assert not written  # nothing runs before an output is asked for
    assert rows(res.users, "id_user", "login") == [(1, "a"), (2, "ok")]
    assert rows(res.drivers, "last_name", "first_name") == [("Иванов", "Иван")]
    assert written and all("password" not in c and "login" not in c for c in written)


def test_hot_driver_does_not_reach_the_delete_check_whole(spark):
    """Below the shuffle the requested drivers' assignments are one row per
    driver and task."""
    from conftest import SMALL_SF
    from haulage.sources.testdata import load_tables
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = load_tables(spark, SMALL_SF)
        refused = changes.delete_drivers(t, t.drivers.select("id_driver")).refused
        top = refused._jdf.queryExecution().executedPlan().toString().splitlines()
        first = next(line for line in top if "Aggregate" in line or "Join" in line)
        assert "HashAggregate" in first
        assert refused.count() == t.assignments.select("id_driver").distinct().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
