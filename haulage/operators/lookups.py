"""Scans and keyed selection.

The reference fetches one row per call (``getDriverById(id)`` inside a loop);
here a lookup takes a whole frame of keys and answers all of them in one
join. A key without a row gets the reference's default row (its
default-constructed struct: ids 0, numbers 0, strings ''), and the requested
key is kept in ``key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.schemas import MONEY
from haulage.sources.tables import Tables


# --- NULL read as the reference's default (#43) -----------------------------

def user_cols() -> list[Column]:
    return [F.coalesce("id_user", F.lit(0)).cast("bigint").alias("id_user"),
            F.coalesce("login", F.lit("")).alias("login"),
            F.coalesce("password", F.lit("")).alias("password")]


def role_cols() -> list[Column]:
    return [F.coalesce("id_role", F.lit(0)).cast("bigint").alias("id_role"),
            F.coalesce("role_name", F.lit("")).alias("role_name")]


def driver_cols() -> list[Column]:
    return [F.coalesce("id_driver", F.lit(0)).cast("bigint").alias("id_driver"),
            F.coalesce("id_user", F.lit(0)).cast("bigint").alias("id_user"),
            F.coalesce("last_name", F.lit("")).alias("last_name"),
            F.coalesce("first_name", F.lit("")).alias("first_name"),
            F.coalesce("middle_name", F.lit("")).alias("middle_name"),
            F.coalesce("experience", F.lit(0)).cast("int").alias("experience")]


def route_cols() -> list[Column]:
    return [F.coalesce("id_route", F.lit(0)).cast("bigint").alias("id_route"),
            F.coalesce("route_name", F.lit("")).alias("route_name"),
            F.coalesce(F.col("distance").cast("double"), F.lit(0.0)).alias("distance"),
            F.coalesce(F.col("base_payment").cast("double"), F.lit(0.0)).alias("base_payment")]


def trip_cols() -> list[Column]:
    # Dates of an absent trip stay NULL (an invalid QDateTime).
    return [F.coalesce("id_transportation", F.lit(0)).cast("bigint").alias("id_transportation"),
            F.coalesce("id_route", F.lit(0)).cast("bigint").alias("id_route"),
            F.col("departure_date"), F.col("arrival_date")]


def assignment_cols() -> list[Column]:
    zero = F.lit(0).cast(MONEY)
    return [F.coalesce("id_driver", F.lit(0)).cast("bigint").alias("id_driver"),
            F.coalesce("id_transportation", F.lit(0)).cast("bigint").alias("id_transportation"),
            F.coalesce("payment", zero).cast("double").alias("payment"),
            F.coalesce("bonus_amount", zero).cast("double").alias("bonus_amount"),
            F.coalesce("bonus_reason", F.lit("")).alias("bonus_reason")]


# --- scans (#1-5) -----------------------------------------------------------

def scan_users(t: Tables) -> DataFrame:
    return t.users.select(*user_cols())


def scan_roles(t: Tables) -> DataFrame:
    return t.roles.select(*role_cols())


def scan_drivers(t: Tables) -> DataFrame:
    """Drivers; no account reads as 0, as in the reference."""
    return t.drivers.select(*driver_cols())


def scan_routes(t: Tables) -> DataFrame:
    return t.routes.select(*route_cols())


def scan_transportations(t: Tables) -> DataFrame:
    return t.transportations.select(*trip_cols())


# --- keyed selection (#7-12) ------------------------------------------------

def lookup(keys: DataFrame, key_col: str, table: DataFrame, table_key: str,
           cols: list[Column]) -> DataFrame:
    """For each distinct key, the row with ``table_key == key`` or the
    default row. ``table`` must be unique on ``table_key``.

    Keys are de-duplicated first (partial aggregation), so the join sees
    one row per key on both sides and no hot key.
    """
    k = keys.select(F.col(key_col).alias("key")).distinct()
    found = k.join(table, k["key"] == table[table_key], "left")
    return found.select("key", *cols)


def lookup_drivers_by_id(keys: DataFrame, drivers: DataFrame, key_col: str = "id_driver") -> DataFrame:
    return lookup(keys, key_col, drivers, "id_driver", driver_cols())


def lookup_drivers_by_user(keys: DataFrame, drivers: DataFrame, key_col: str = "id_user") -> DataFrame:
    """The driver of each account; if an account has several, the lowest
    ``id_driver`` (the reference takes its first row)."""
    first = (drivers.where(F.col("id_user").isNotNull())
             .groupBy("id_user")
             .agg(F.min_by(F.struct(*drivers.columns), F.col("id_driver")).alias("d"))
             .select("d.*"))
    return lookup(keys, key_col, first, "id_user", driver_cols())


def lookup_routes_by_id(keys: DataFrame, routes: DataFrame, key_col: str = "id_route") -> DataFrame:
    return lookup(keys, key_col, routes, "id_route", route_cols())


def lookup_transportations_by_id(keys: DataFrame, trips: DataFrame,
                                 key_col: str = "id_transportation") -> DataFrame:
    return lookup(keys, key_col, trips, "id_transportation", trip_cols())


def assignments_for_trips(keys: DataFrame, assignments: DataFrame,
                          key_col: str = "id_transportation") -> DataFrame:
    """All assignments of the given trips (semi join: no key duplication)."""
    k = keys.select(F.col(key_col).alias("id_transportation")).distinct()
    return assignments.join(k, "id_transportation", "left_semi").select(*assignment_cols())


def assignments_for_drivers(keys: DataFrame, assignments: DataFrame,
                            key_col: str = "id_driver") -> DataFrame:
    k = keys.select(F.col(key_col).alias("id_driver")).distinct()
    return assignments.join(k, "id_driver", "left_semi").select(*assignment_cols())


def under_way(trips: DataFrame) -> DataFrame:
    """Trips without an arrival (#13)."""
    return trips.where(F.col("arrival_date").isNull())


def trips_under_way(t: Tables) -> DataFrame:
    """#13 on its own: every trip still under way (defaults as in a scan)."""
    return under_way(t.transportations).select(*trip_cols())


# --- bound to the reference's own call sites --------------------------------
# Each reference loop looks up the keys held by another table; these take the
# same key sets, whole.

def lookup_drivers_by_id_q(t: Tables) -> DataFrame:
    """Crew list: a driver per assignment."""
    return lookup_drivers_by_id(t.assignments, t.drivers)


def lookup_drivers_by_user_q(t: Tables) -> DataFrame:
    """Sign-in: the driver profile of every account."""
    return lookup_drivers_by_user(t.users, t.drivers)


def lookup_routes_by_id_q(t: Tables) -> DataFrame:
    """Trip board: the route of every trip (NULL route -> default)."""
    return lookup_routes_by_id(t.transportations, t.routes)


def lookup_transportations_by_id_q(t: Tables) -> DataFrame:
    """A driver's trips: the trip of every assignment."""
    return lookup_transportations_by_id(t.assignments, t.transportations)


def assignments_for_trips_q(t: Tables) -> DataFrame:
    """Mechanic's board: the crews of trips under way."""
    return assignments_for_trips(under_way(t.transportations), t.assignments)


def assignments_for_drivers_q(t: Tables) -> DataFrame:
    """Drivers' own trips: assignments of every driver with an account."""
    return assignments_for_drivers(t.drivers.where(F.col("id_user").isNotNull()), t.assignments)
