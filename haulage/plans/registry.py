"""The registered queries: each binds an operator to the test tables.

Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole tables of ``sf_dir`` (or data Spark derives from them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from haulage.functions.text import unicode_trim
from haulage.operators import boards, changes, lookups, pay, quality, reports
from haulage.sources import derived
from haulage.streaming import ingest
from haulage.session import scratch_path
from haulage.sources.tables import Tables, read_snapshot, table_sums, write_snapshot
from haulage.sources.testdata import load_tables

Query = Callable[[SparkSession, str], DataFrame]
Loader = Callable[[SparkSession, str], Tables]


def _snapshot_roundtrip(t: Tables) -> DataFrame:
    """#6: upsert routes, publish all seven tables as a new snapshot (new
    folder on shared storage), and read it back: rows and hash sum of each."""
    spark = t.routes.sparkSession
    path = scratch_path(spark, "snapshot")
    new = t.with_(routes=changes.upsert_routes(t.routes, derived.route_changes(t)))
    return table_sums(read_snapshot(spark, write_snapshot(new, path), verify=True))


def build(loader: Loader = load_tables) -> dict[str, Query]:
    """All registered queries. ``loader`` gives the seven tables for a
    ``sf_dir``: the test-data adapter by default, or e.g. a stored snapshot
    (``haulage.sources.tables.read_snapshot``)."""

    def _on_tables(op) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return op(loader(spark, sf_dir))
        run.__name__ = getattr(op, "__name__", "query")
        return run

    q: dict[str, Query] = {}
    q["salary_statement"] = _on_tables(reports.salary_statement)
    q["transportation_summary"] = _on_tables(reports.transportation_summary)
    q["salary_statement_captioned"] = _on_tables(reports.salary_statement_captioned)
    q["transportation_summary_captioned"] = _on_tables(reports.transportation_summary_captioned)
    # scans and keyed selection
    for name in ("scan_users", "scan_roles", "scan_drivers", "scan_routes", "scan_transportations"):
        q[name] = _on_tables(getattr(lookups, name))
    for name in ("lookup_drivers_by_id", "lookup_drivers_by_user", "lookup_routes_by_id",
                 "lookup_transportations_by_id", "assignments_for_trips", "assignments_for_drivers"):
        q[name] = _on_tables(getattr(lookups, name + "_q"))
    q["trips_under_way"] = _on_tables(lookups.trips_under_way)
    # boards
    for name in ("user_role_pairs", "driver_roster", "trip_board", "route_list", "driver_trips", "crew_roster",
                 "crew_rows", "driver_labels", "trip_labels"):
        q[name] = _on_tables(getattr(boards, name))
    for name in ("user_roles_list", "users_without_roles"):
        q[name] = _on_tables(lambda t, op=getattr(boards, name): op(derived.with_revocations(t)))
    q["user_role_pairs_many"] = _on_tables(lambda t: boards.user_role_pairs(derived.many_roles(t)))
    q["trips_in_progress"] = _on_tables(lambda t: boards.trips_in_progress(derived.dateless_trips(t)))
    q["sign_in_check"] = _on_tables(lambda t: boards.sign_in_check(
        derived.sign_in_attempts(t), t.users, derived.with_revocations(t).user_roles))
    q["available_driver_users"] = _on_tables(lambda t: boards.available_driver_users(t, 0))
    q["available_driver_users_current"] = _on_tables(lambda t: boards.available_driver_users(t, 7))
    # pay and crew rules
    # the adapter's assignments are an aggregation, which two branches would run twice
    q["price_assignments"] = _on_tables(lambda t: pay.price_assignments(t, split=False))
    q["pay_bands_by_driver"] = _on_tables(pay.pay_bands_by_driver)
    q["pay_bands_many"] = _on_tables(lambda t: pay.band_join(
        t.drivers.select("id_driver", "experience"), derived.many_bands(t)))
    q["pay_bands_rejected"] = _on_tables(lambda t: pay.band_rejects(derived.overlapping_bands(t)))
    q["pay_bands_merged"] = _on_tables(lambda t: pay.band_join(
        t.drivers.select("id_driver", "experience"), derived.overlapping_bands(t)))
    q["crew_limit_accept"] = _on_tables(lambda t: pay.crew_limit_accept(t.assignments))
    q["crew_limit_reject"] = _on_tables(lambda t: pay.crew_limit_reject(t.assignments))
    q["crew_limit_overflow"] = _on_tables(lambda t: pay.crew_limit_overflow(t.assignments))
    # data quality
    q["password_policy_audit"] = _on_tables(lambda t: quality.password_policy_audit(t.users))
    q["password_policy_summary"] = _on_tables(lambda t: quality.password_policy_summary(t.users))
    q["validate_drivers"] = _on_tables(lambda t: quality.validate_drivers(derived.dirty_drivers(t)))
    q["validate_routes"] = _on_tables(lambda t: quality.validate_routes(derived.dirty_routes(t)))
    q["validate_bonuses"] = _on_tables(lambda t: quality.validate_bonuses(derived.bonus_awards(t)))
    q["validate_registrations"] = _on_tables(
        lambda t: quality.validate_registrations(derived.registrations(t)))
    q["fk_orphans"] = _on_tables(lambda t: quality.fk_orphans(derived.orphan_tables(t)))
    q["key_duplicates"] = lambda spark, sf_dir: quality.key_duplicates(
        derived.repeated_tables(loader(spark, sf_dir)), derived.raw_assignments(spark, sf_dir))
    q["normalise_names"] = _on_tables(lambda t: derived.spaced_drivers(t).select(
        "id_driver", *[unicode_trim(c).alias(c) for c in ("last_name", "first_name", "middle_name")]))
    # change batches -> new snapshot tables
    q["upsert_drivers"] = _on_tables(lambda t: changes.upsert_drivers(t.drivers, derived.driver_changes(t)))
    q["upsert_routes"] = _on_tables(lambda t: changes.upsert_routes(t.routes, derived.route_changes(t)))
    q["upsert_transportations"] = _on_tables(
        lambda t: changes.upsert_transportations(t.transportations, derived.trip_changes(t)))
    q["upsert_drivers_rejected"] = _on_tables(lambda t: changes.driver_rejects(derived.driver_changes(t)))
    q["upsert_routes_rejected"] = _on_tables(lambda t: changes.route_rejects(derived.route_changes(t)))
    q["update_user_passwords_rejected"] = _on_tables(lambda t: changes.password_rejects(derived.password_changes(t)))
    q["set_bonuses_rejected"] = _on_tables(lambda t: changes.bonus_rejects(derived.bonus_changes(t)))
    q["update_user_passwords"] = _on_tables(
        lambda t: changes.update_user_passwords(t.users, derived.password_changes(t)))
    q["set_bonuses"] = _on_tables(lambda t: changes.set_bonuses(t.assignments, derived.bonus_changes(t)))
    q["assign_drivers"] = _on_tables(
        lambda t: changes.assign_drivers(derived.assign_existing(t), derived.assign_batch(t)).assignments)
    q["assign_drivers_rejected"] = _on_tables(
        lambda t: changes.assign_drivers(derived.assign_existing(t), derived.assign_batch(t)).rejected)
    reg = lambda t: changes.register_users(t, derived.registration_batch(t))
    q["register_users"] = _on_tables(lambda t: reg(t).users)
    q["register_users_roles"] = _on_tables(lambda t: reg(t).user_roles)
    q["register_users_drivers"] = _on_tables(lambda t: reg(t).drivers)
    q["register_users_rejected"] = _on_tables(lambda t: reg(t).rejected)
    roles = lambda t: changes.replace_user_roles(t.user_roles, t.roles, derived.role_changes(t))
    q["replace_user_roles"] = _on_tables(lambda t: roles(t).user_roles)
    q["replace_user_roles_rejected"] = _on_tables(lambda t: roles(t).rejected)
    q["resolve_role_names"] = _on_tables(lambda t: boards.resolve_role_names(derived.role_changes(t), t.roles)[0])
    q["resolve_role_names_rejected"] = _on_tables(
        lambda t: boards.resolve_role_names(derived.role_changes(t), t.roles)[1])
    q["remove_assignments"] = _on_tables(
        lambda t: changes.remove_assignments(t.assignments, derived.removal_pairs(t)))
    du = lambda t: changes.delete_users(t, derived.ids_every(t.users, "id_user"))
    q["delete_users"] = _on_tables(lambda t: du(t).users)
    q["delete_users_roles"] = _on_tables(lambda t: du(t).user_roles)
    q["delete_users_drivers"] = _on_tables(lambda t: du(t).drivers)
    dt = lambda t: changes.delete_transportations(t, derived.ids_every(t.transportations, "id_transportation"))
    q["delete_transportations"] = _on_tables(lambda t: dt(t).transportations)
    q["delete_transportations_assignments"] = _on_tables(lambda t: dt(t).assignments)
    dr = lambda t: changes.delete_routes(t, derived.ids_every(t.routes, "id_route"))
    q["delete_routes"] = _on_tables(lambda t: dr(t).table)
    q["delete_routes_refused"] = _on_tables(lambda t: dr(t).refused)
    dd = lambda t: changes.delete_drivers(
        derived.without_some_crews(t), derived.ids_every(t.drivers, "id_driver"))
    q["delete_drivers"] = _on_tables(lambda t: dd(t).table)
    q["delete_drivers_refused"] = _on_tables(lambda t: dd(t).refused)
    # snapshot sink: a change batch published as a new snapshot and read back
    q["snapshot_sink"] = _on_tables(_snapshot_roundtrip)
    # streams (run to completion with availableNow; result read from the sink)
    q["stream_price_assignments"] = _on_tables(ingest.stream_price_assignments)
    def crew(verdict):
        def run(t: Tables) -> DataFrame:
            stored, deliveries = derived.crew_deliveries(t)
            return ingest.stream_crew_limit(t, deliveries, stored, verdict)
        return _on_tables(run)

    q["stream_crew_limit"], q["stream_crew_limit_rejected"] = crew("accepted"), crew("rejected")
    q["stream_refresh_reports"] = _on_tables(lambda t: ingest.stream_refresh(t, derived.report_changes(t), "salary"))
    q["stream_refresh_summary"] = _on_tables(lambda t: ingest.stream_refresh(t, derived.report_changes(t), "summary"))
    return q
