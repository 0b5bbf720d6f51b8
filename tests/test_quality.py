from haulage.operators import quality
from conftest import D


def test_password_outcomes(spark):
    users = spark.createDataFrame([
        (1, "Ab1#"), (2, "abcdefg#1"), (3, "Abcdefgh#"), (4, "Abcdefg12"), (5, "HOUSEHOLD#4"),
        (6, "Ёабвгд1ж"), (7, "Жабвгд1Ё"), (8, None), (9, "Abcdefg 1"),
        (10, "Ab1#😀xy"),  # 7 characters, 8 UTF-16 units: long enough for the reference
    ], "id_user long, password string")
    got = {r.id_user: r.outcome for r in quality.password_policy_audit(users).collect()}
    assert got == {1: "too_short", 2: "no_upper", 3: "no_digit", 4: "no_special", 5: "ok",
                   6: "no_upper", 7: "ok", 8: "too_short", 9: "no_special", 10: "ok"}
    assert "password" not in quality.password_policy_audit(users).columns


def test_driver_rules_and_split(spark):
    d = spark.createDataFrame([
        (1, 5, "Иванов", "Иван", None, 3),
        (2, None, "\t ", "Иван", None, 3),
        (3, 7, "Петров", "", None, 81),
    ], "id_driver long, id_user long, last_name string, first_name string, middle_name string, experience int")
    fails = {(r.id_driver, r.rule) for r in quality.validate_drivers(d).collect()}
    assert fails == {(2, "last_name_empty"), (2, "no_account"), (3, "first_name_empty"), (3, "experience_range")}
    good, bad = quality.split_valid(d, quality.validate_drivers(d), ["id_driver"])
    assert [r.id_driver for r in good.collect()] == [1]
    assert sorted(r.id_driver for r in bad.collect()) == [2, 3]


def test_route_and_bonus_ranges(spark):
    r = spark.createDataFrame([(1, "a", D(1), D(0)), (2, "b", D(0.5), D(1000000)), (3, " ", D(20000.01), D(-1))],
                              "id_route long, route_name string, distance decimal(18,2), base_payment decimal(18,2)")
    assert {(x.id_route, x.rule) for x in quality.validate_routes(r).collect()} == {
        (2, "distance_range"), (3, "name_empty"), (3, "distance_range"), (3, "base_payment_range")}
    b = spark.createDataFrame([(1, 1, D(500000), "x"), (1, 2, D(0), "x"), (1, 3, D(1), "")],
                              "id_driver long, id_transportation long, bonus_amount decimal(18,2), bonus_reason string")
    assert {(x.id_transportation, x.rule) for x in quality.validate_bonuses(b).collect()} == {
        (2, "bonus_range"), (3, "reason_empty")}
