"""Screens built from joins.

The reference assembles these in client loops (one statement per row);
each is one Spark job here. Joins keep the reference's defaults: a missing
route reads as '' and a missing driver as an empty name.

Skew: lists are aggregated per key with partial aggregation; wherever a
board needs a per-key summary of a large table, the summary is built before
the join so that the join sees one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.functions import text
from haulage.operators.joins import join_few_valued, left_join, narrow
from haulage.schemas import ROLE_DRIVER
from haulage.sources.tables import Tables


def user_role_pairs(t: Tables) -> DataFrame:
    """(id_user, role_name) of every role link (#14). The role id has few
    values, so the links of one role are dealt into parts."""
    return join_few_valued(t.user_roles, t.roles, "id_role").select("id_user", "role_name")


def role_lists(user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """Per user, role names joined by ', ' (#27)."""
    return (join_few_valued(user_roles, roles, "id_role").select("id_user", "role_name")
            .groupBy("id_user").agg(text.sorted_list("role_name").alias("roles")))


def user_roles_list(t: Tables) -> DataFrame:
    """Every user with its roles; users with none get '' (#16)."""
    lists = role_lists(t.user_roles, t.roles)
    return (t.users.join(lists, "id_user", "left")
            .select("id_user", "login", F.coalesce("roles", F.lit("")).alias("roles")))


def users_without_roles(t: Tables) -> DataFrame:
    """Users that cannot sign in: no role link (#17)."""
    return t.users.join(t.user_roles, "id_user", "left_anti").select("id_user", "login")


def available_driver_users(t: Tables, current_id: int = 0) -> DataFrame:
    """Accounts with the driver role that no driver uses yet, plus the
    account ``current_id`` (#15).

    Written as semi join + left join + NULL test: only hash joins. The
    ``NOT IN (...) OR id = :current`` form of the reference would plan as a
    nested-loop existence join. NULL accounts of drivers are excluded from
    the "taken" set, as the reference's sub-select does.
    """
    driver_role = t.roles.where(F.col("role_name") == ROLE_DRIVER).select("id_role").distinct()
    with_role = join_few_valued(t.user_roles, driver_role, "id_role").select("id_user").distinct()
    candidates = t.users.join(with_role, "id_user", "left_semi").select("id_user", "login")
    taken = (t.drivers.where(F.col("id_user").isNotNull())
             .select("id_user").distinct().withColumn("taken", F.lit(True)))
    return (candidates.join(taken, "id_user", "left")
            .where(F.col("taken").isNull() | (F.col("id_user") == F.lit(current_id)))
            .select("id_user", "login").distinct())


def driver_roster(t: Tables) -> DataFrame:
    """Drivers with full name, experience, account id and login (#18).

    A driver without an account shows 'Нет' for both; an account id with no
    user shows the id and 'Нет' as login.
    """
    logins = t.users.where("id_user > 0").select("id_user", "login")
    return (left_join(t.drivers, logins, "id_user", "id_driver")
            .select("id_driver", text.full_name().alias("full_name"), "experience",
                    text.account_text("id_user").alias("account_id"),
                    F.when(F.col("id_user") > 0, F.coalesce("login", F.lit(text.NO_ACCOUNT)))
                     .otherwise(F.lit(text.NO_ACCOUNT)).alias("account_login")))


def trip_board(t: Tables) -> DataFrame:
    """Every trip with route name, departure and arrival text (#19)."""
    r = t.routes.select("id_route", "route_name")
    return (left_join(t.transportations, r, "id_route", "id_transportation")
            .select("id_transportation", F.coalesce("route_name", F.lit("")).alias("route_name"),
                    F.coalesce(text.date_text("departure_date"), F.lit("")).alias("departure"),
                    text.arrival_text("arrival_date").alias("arrival")))


def route_list(t: Tables) -> DataFrame:
    """Routes with distance and base pay as two-decimal text (#19b)."""
    return t.routes.select("id_route", F.coalesce("route_name", F.lit("")).alias("route_name"),
                           text.money_text("distance").alias("distance"),
                           text.money_text("base_payment").alias("base_payment"))


def driver_trips(t: Tables) -> DataFrame:
    """Every driver's own trips: route, dates, pay, bonus, reason (#20).

    All drivers in one job; ``id_driver`` and ``id_transportation`` are kept
    so each screen row is addressable.
    """
    trips = t.transportations.select("id_transportation", "id_route", "departure_date", "arrival_date")
    r = t.routes.select("id_route", "route_name")
    rows = (t.assignments.select("id_driver", "id_transportation", "payment", "bonus_amount", "bonus_reason")
            .join(trips, "id_transportation", "left"))
    return (left_join(rows, r, "id_route", "id_transportation")
            .select("id_driver", "id_transportation",
                    F.coalesce("route_name", F.lit("")).alias("route_name"),
                    F.coalesce(text.date_text("departure_date"), F.lit("")).alias("departure"),
                    text.arrival_text("arrival_date").alias("arrival"),
                    text.money_text("payment").alias("payment"),
                    text.money_text("bonus_amount").alias("bonus_amount"),
                    F.coalesce("bonus_reason", F.lit("")).alias("bonus_reason")))


def crew_rows(t: Tables) -> DataFrame:
    """Crews as rows: (id_transportation, id_driver, driver_name) of every
    assignment; a missing driver has an empty name. The form of the crew
    lists (#21, #26, #28) in which no row grows with a trip's crew."""
    return named_crew(t.assignments, t.drivers)


def named_crew(assignments: DataFrame, drivers: DataFrame) -> DataFrame:
    names = drivers.select("id_driver", text.full_name().alias("driver_name"))
    return (assignments.select("id_driver", "id_transportation")
            .join(names, "id_driver", "left")
            .select("id_transportation", "id_driver", F.coalesce("driver_name", F.lit("")).alias("driver_name")))


def crew_names(assignments: DataFrame, drivers: DataFrame) -> DataFrame:
    """Per trip, the crew's full names joined by ', '; a missing driver
    counts as an empty name, as in the reference. A trip's names are one
    value, however many; ``crew_rows`` is the form without that."""
    return (named_crew(assignments, drivers)
            .groupBy("id_transportation")
            .agg(text.sorted_list("driver_name").alias("drivers")))


def trips_in_progress(t: Tables) -> DataFrame:
    """Trips under way with route, departure and crew (#21, #13).

    The filter runs first; assignments are cut to those trips by a semi
    join before the driver names are joined and aggregated.
    """
    moving = t.transportations.where(F.col("arrival_date").isNull()) \
        .select("id_transportation", "id_route", "departure_date")
    on_board = t.assignments.join(moving.select("id_transportation"), "id_transportation", "left_semi")
    crew = crew_names(on_board, t.drivers)
    r = t.routes.select("id_route", "route_name")
    return (left_join(moving, r, "id_route", "id_transportation")
            .join(crew, "id_transportation", "left")
            .select("id_transportation", F.coalesce("route_name", F.lit("")).alias("route_name"),
                    F.coalesce(text.date_text("departure_date"), F.lit("")).alias("departure"),
                    F.coalesce("drivers", F.lit(text.NO_CREW)).alias("drivers")))


def crew_roster(t: Tables) -> DataFrame:
    """Every assignment of an existing trip with the driver's name, pay and
    "bonus (reason)" (#22)."""
    names = t.drivers.select("id_driver", text.full_name().alias("full_name"))
    return (t.assignments.join(t.transportations.select("id_transportation"), "id_transportation", "left_semi")
            .join(names, "id_driver", "left")
            .select("id_driver", F.coalesce("full_name", F.lit("")).alias("full_name"), "id_transportation",
                    text.money_text("payment").alias("payment"),
                    text.bonus_text("bonus_amount", "bonus_reason").alias("bonus")))


def driver_labels(t: Tables) -> DataFrame:
    """"name (стаж N лет)" per driver (#40)."""
    return t.drivers.select("id_driver", text.driver_label(text.full_name()).alias("label"))


def trip_labels(t: Tables) -> DataFrame:
    """"Рейс id: route" per trip (#41); a missing route reads as ''."""
    r = t.routes.select("id_route", "route_name")
    return (left_join(t.transportations, r, "id_route", "id_transportation")
            .select("id_transportation", text.trip_label().alias("label")))


def resolve_role_names(requests: DataFrame, roles: DataFrame,
                       name_col: str = "role_name") -> tuple[DataFrame, DataFrame]:
    """Role names -> ids for a batch of (id_user, role_name) requests (#23).

    Returns (resolved, rejected): a user with any unknown name is rejected
    whole (the reference stops at the first unknown name and leaves the
    user half-linked; a batch does not). ``rejected`` lists each unknown
    (id_user, role_name).
    """
    r = roles.select(F.col("role_name").alias(name_col), "id_role")
    unknown = requests.join(r, name_col, "left_anti").select("id_user", name_col)
    bad_users = unknown.select("id_user").distinct()
    good = requests.join(bad_users, "id_user", "left_anti")
    resolved = join_few_valued(good, r, name_col).select("id_user", "id_role").distinct()
    return resolved, unknown


SIGN_IN_OUTCOMES = ("empty_input", "unknown", "no_role", "ok")


def sign_in_check(attempts: DataFrame, users: DataFrame, user_roles: DataFrame) -> DataFrame:
    """Sign-in as a batch: (attempt, id_user, outcome) for attempts of
    (attempt, login, password).

    The login is trimmed, the password is not; either empty is
    'empty_input'. No user with that login and password is 'unknown'; a user
    without a role is refused as 'no_role'. Passwords are compared inside and
    never leave; if several users match, the lowest id is taken.
    """
    given = attempts.select("attempt", text.unicode_trim(F.coalesce("login", F.lit(""))).alias("login"),
                            F.coalesce("password", F.lit("")).alias("password"))
    empty = (F.col("login") == "") | (F.col("password") == "")
    known = (narrow(users, given.where(~empty), ["login", "password"])
             .groupBy("login", "password").agg(F.min("id_user").alias("id_user")))
    with_role = user_roles.select("id_user").distinct().withColumn("has_role", F.lit(True))
    found = given.join(known, ["login", "password"], "left").withColumn("id_user", F.when(~empty, F.col("id_user")))
    return left_join(found, with_role, "id_user", "attempt").select(
        "attempt", "id_user",
        F.when(empty, "empty_input").when(F.col("id_user").isNull(), "unknown")
        .when(F.col("has_role").isNull(), "no_role").otherwise("ok").alias("outcome"))
