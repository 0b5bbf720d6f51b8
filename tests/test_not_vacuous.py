"""The registered inputs exercise what they are checked for (sf0.01)."""
from haulage.operators import boards, changes
from haulage.plans import registry
from haulage.sources import derived
from haulage.sources.testdata import load_tables

SF = "/root/testdata/sf0.01"


def values(df, column):
    return {r[0] for r in df.select(column).distinct().collect()}


def run(spark, name):
    return registry.build()[name](spark, SF)


def test_every_rule_and_reason_fires(spark):
    assert values(run(spark, "validate_drivers"), "rule") == {
        "last_name_empty", "first_name_empty", "experience_range", "no_account"}
    assert values(run(spark, "upsert_drivers_rejected"), "rule") == {"first_name_empty", "experience_range"}
    assert values(run(spark, "upsert_routes_rejected"), "rule") == {"name_empty", "distance_range", "base_payment_range"}
    assert values(run(spark, "set_bonuses_rejected"), "rule") == {"bonus_range", "reason_empty"}
    assert values(run(spark, "update_user_passwords_rejected"), "rule") == {"password_no_digit"}
    assert values(run(spark, "assign_drivers_rejected"), "reason") == {
        "duplicate", "unknown_driver", "unknown_trip", "crew_limit"}
    assert values(run(spark, "sign_in_check"), "outcome") == set(boards.SIGN_IN_OUTCOMES)
    assert values(run(spark, "fk_orphans"), "fk") >= {"user_roles.id_user", "user_roles.id_role", "drivers.id_user",
                                                     "assignments.id_transportation"}
    assert len(values(run(spark, "key_duplicates"), "table_name")) == 7
    assert values(run(spark, "register_users_rejected").where("rule like 'unknown_role%'"), "rule")


def test_writes_insert_change_delete_and_refuse(spark):
    t = load_tables(spark, SF)
    assert run(spark, "upsert_drivers").count() > t.drivers.count()
    trips = run(spark, "upsert_transportations")
    assert trips.count() > t.transportations.count()
    assert derived.trip_changes(t).where("not completed").count() > 0
    assert 0 < run(spark, "delete_drivers_refused").count()
    assert run(spark, "delete_drivers").count() < t.drivers.count()
    assert run(spark, "users_without_roles").count() > 0
    assert run(spark, "trips_in_progress").where("departure = ''").count() > 0
    spaced, clean = derived.spaced_drivers(t), run(spark, "normalise_names")
    assert spaced.select("last_name").exceptAll(clean.select("last_name")).count() == t.drivers.count()
    assert derived.driver_changes(t).where("seq is null").count() > 0
    assert changes.latest_per_key(derived.bonus_changes(t), changes.PAIR).where("seq is null").count() == 0
