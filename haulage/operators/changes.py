"""Writes as set-based snapshot transforms.

The reference writes one row per call. Here a write takes a whole change
batch and returns the new table(s); the caller publishes them as a new
snapshot (``haulage.sources.tables.write_snapshot``), never over the folder
being read. Change rows carry ``seq``, a change sequence number: for one key
the highest ``seq`` wins (a NULL ``seq`` is older than any, ties go to the
larger values); inserted rows get ids in ``seq`` order.

Before a write, text is trimmed and the forms' rules are applied, as the
client does. A change that breaks a rule is not applied; the ``*_rejects``
functions list such changes with the rules they break.

Shuffles: the latest change per key is a partial + final aggregation (a key
changed a million times is combined map-side); applying the changes is one
left join of the table with at most one change row per key, so neither side
has a hot key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.functions.text import unicode_trim
from haulage.operators import pay, quality
from haulage.operators.boards import resolve_role_names
from haulage.operators.ids import allocate_ids, max_id
from haulage.operators.joins import join_few_valued, left_join, narrow
from haulage.schemas import ROLE_DRIVER
from haulage.session import materialize
from haulage.sources.tables import Tables


# --- #54 generic upsert -----------------------------------------------------

def latest_per_key(changes: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The change with the highest ``seq`` for every key."""
    rest = [c for c in changes.columns if c not in keys and c != seq]
    newest = F.max(F.struct(F.col(seq).isNotNull().alias("_known"), seq, *rest))
    return (changes.groupBy(*keys).agg(newest.alias("_c"))
            .select(*keys, *[F.col("_c")[c].alias(c) for c in (seq, *rest)]))


def trimmed(changes: DataFrame, *columns: str) -> DataFrame:
    return changes.withColumns({c: unicode_trim(c) for c in columns})


def accepted(changes: DataFrame, rules: list) -> DataFrame:
    """The changes that break no rule."""
    return changes.where(F.size(quality.broken(rules)) == 0)


def rejects(changes: DataFrame, keys: list[str], rules: list, seq: str = "seq") -> DataFrame:
    """(keys, seq, rule) of every broken rule."""
    return quality.failures(changes, [*keys, seq], rules)


def apply_updates(table: DataFrame, changes: DataFrame, keys: list[str],
                  columns: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """UPDATE ... WHERE key = :key for a batch: ``columns`` of matched rows
    take the latest change; keys absent from ``table`` change nothing.

    The changes are the build (right) side of the left join: a small batch
    is broadcast by Spark's size check and the table streams through
    without a shuffle (a map-only rewrite); a large one is joined by
    shuffle."""
    cols = columns or [c for c in table.columns if c not in keys]
    latest = latest_per_key(changes.select(*keys, *cols, seq), keys, seq)
    upd = latest.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_hit"))
    joined = table.join(upd, keys, "left")
    return joined.select(*[
        F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
        for c in table.columns])


def upsert(table: DataFrame, changes: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Rows with a key update that row (if it exists); rows without one are
    inserted under new ids (#65)."""
    updated = apply_updates(table, changes.where(F.col(key).isNotNull()), [key], seq=seq)
    inserts = changes.where(F.col(key).isNull())
    rest = [c for c in table.columns if c != key]  # rows of one seq, or none, go by their values
    new_rows = allocate_ids(inserts, key, [seq, *rest], max_id(table, key))
    return updated.unionByName(new_rows.select(*table.columns))


# --- #55-59 -----------------------------------------------------------------

def _driver_form(changes: DataFrame) -> DataFrame:
    return trimmed(changes, "last_name", "first_name", "middle_name")


def upsert_drivers(drivers: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert/update drivers; an account id <= 0 is stored as NULL."""
    c = accepted(_driver_form(changes), quality.driver_rules())
    c = c.withColumn("id_user", F.when(F.col("id_user") > 0, F.col("id_user")).cast("bigint"))
    return upsert(drivers, c.select(*drivers.columns, "seq"), "id_driver")


def driver_rejects(changes: DataFrame) -> DataFrame:
    return rejects(_driver_form(changes), ["id_driver"], quality.driver_rules())


def upsert_routes(routes: DataFrame, changes: DataFrame) -> DataFrame:
    c = accepted(trimmed(changes, "route_name"), quality.route_rules())
    return upsert(routes, c.select(*routes.columns, "seq"), "id_route")


def route_rejects(changes: DataFrame) -> DataFrame:
    return rejects(trimmed(changes, "route_name"), ["id_route"], quality.route_rules())


def upsert_transportations(trips: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert/update trips; ``completed`` false stores a NULL arrival (the
    trip is under way)."""
    c = changes.withColumn("arrival_date", F.when(F.col("completed"), F.col("arrival_date")))
    return upsert(trips, c.select(*trips.columns, "seq"), "id_transportation")


def update_user_passwords(users: DataFrame, changes: DataFrame) -> DataFrame:
    """New passwords by user id, where the policy is met; other users
    unchanged (#58). Passwords are not trimmed."""
    return apply_updates(users, accepted(changes, quality.password_rules()), ["id_user"], ["password"])


def password_rejects(changes: DataFrame) -> DataFrame:
    """(id_user, seq, rule); no password leaves."""
    return rejects(changes, ["id_user"], quality.password_rules())


PAIR = ["id_driver", "id_transportation"]


def valid_bonuses(changes: DataFrame) -> DataFrame:
    """Bonus changes, trimmed, that the form would let through."""
    return accepted(trimmed(changes, "bonus_reason"), quality.bonus_rules())


def set_bonuses(assignments: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace amount and reason of existing (driver, trip) pairs (#59);
    a change for an absent pair has no effect."""
    return apply_updates(assignments, valid_bonuses(changes), PAIR, ["bonus_amount", "bonus_reason"])


def bonus_rejects(changes: DataFrame) -> DataFrame:
    return rejects(trimmed(changes, "bonus_reason"), PAIR, quality.bonus_rules())


# --- #60 assign drivers -----------------------------------------------------

_OFFER = "struct<no_seq: boolean, seq: bigint, payment: decimal(18,2)>"
_TRIP = "struct<known: boolean, id_route: bigint>"


class Assigned:
    """The outputs of ``assign_drivers``, each built when it is asked for."""

    def __init__(self, t: Tables, batch: DataFrame, limit: int, bands):
        self._t, self._batch, self._limit, self._bands = t, batch, limit, bands

    @cached_property
    def _flagged(self) -> DataFrame:
        """Every offered pair once, with its reason to be refused (but for
        the crew limit), its trip's crew so far, and what its price depends on;
        written once for all uses. The batch is written before that, as it is
        read three times."""
        t, batch = self._t, materialize(self._batch.select(*PAIR, "payment", "seq"), "assign-batch")
        trip_keys = batch.select("id_transportation").distinct()

        def tagged(rows: DataFrame, offer=F.lit(None), taken: bool = False, trip=F.lit(None)) -> DataFrame:
            """Rows of one shape; a trip's own row has no driver, is in no crew."""
            return rows.select(*PAIR, offer.cast(_OFFER).alias("offer"), F.lit(taken).alias("taken"),
                               trip.cast(_TRIP).alias("trip"))

        trips = t.transportations.select(F.lit(None).cast("bigint").alias("id_driver"), "id_transportation", "id_route")
        known = tagged(t.assignments.select(*PAIR), taken=True).unionByName(
            tagged(trips, trip=F.struct(F.lit(True), "id_route"))).join(trip_keys, "id_transportation", "left_semi")
        offered = tagged(batch, offer=F.struct(F.col("seq").isNull(), "seq", "payment"))
        pairs = offered.unionByName(known).groupBy(*PAIR).agg(
            F.min("offer").alias("offer"), F.count_if("taken").alias("crew"), F.max("trip").alias("trip"))
        pairs = materialize(pairs, "assign-pairs")
        of_trip = pairs.groupBy("id_transportation").agg(F.sum("crew").alias("crew"), F.max("trip").alias("trip"))
        drivers = narrow(t.drivers.select("id_driver", "experience"), batch, "id_driver").withColumn("_drv", F.lit(True))
        flagged = (pairs.where("offer is not null").select(*PAIR, "offer.payment", "offer.seq", (F.col("crew") > 0).alias("_dup"))
                   .join(of_trip, "id_transportation", "left").join(drivers, "id_driver", "left"))
        reason = (F.when(F.col("_dup"), "duplicate").when(F.col("_drv").isNull(), "unknown_driver")
                  .when(F.col("trip.known").isNull(), "unknown_trip"))
        return materialize(flagged.select(*PAIR, "payment", "seq", F.coalesce("crew", F.lit(0)).alias("crew"),
                                          reason.alias("reason"), "trip.id_route", "experience"), "assign")

    @cached_property
    def _accepted(self) -> DataFrame:
        valid = self._flagged.where(F.col("reason").isNull())
        ranked = valid.withColumn("_rn", F.row_number().over(pay.crew_order(("seq", "id_driver"))))
        return ranked.where(F.col("_rn") <= self._limit).where(F.col("_rn") + F.col("crew") <= self._limit)

    @cached_property
    def assignments(self) -> DataFrame:
        existing = self._t.assignments
        routes = narrow(self._t.routes.select("id_route", "base_payment"), self._flagged, "id_route")
        priced = left_join(self._accepted, routes, "id_route", "id_transportation")
        computed = pay.computed_pay(F.col("base_payment"), F.col("experience"), self._bands)
        payment = F.when(pay.needs_pricing(F.col("payment")), computed).otherwise(F.col("payment"))
        new_rows = priced.select(*PAIR, payment.alias("payment"), F.lit(None).cast("decimal(18,2)").alias("bonus_amount"),
                                 F.lit(None).cast("string").alias("bonus_reason"), F.col("seq").cast("int"))
        return existing.unionByName(new_rows.select(*existing.columns))

    @cached_property
    def rejected(self) -> DataFrame:
        taken = self._accepted.select(*PAIR, F.lit(True).alias("_in"))
        reason = F.coalesce("reason", F.when(F.col("_in").isNull(), "crew_limit"))
        return (self._flagged.join(taken, PAIR, "left").select(*PAIR, reason.alias("reason"))
                .where(F.col("reason").isNotNull()))


def assign_drivers(t: Tables, batch: DataFrame, limit: int = pay.DEFAULT_CREW_LIMIT,
                   bands=pay.DEFAULT_BANDS) -> Assigned:
    """Insert (driver, trip) assignments with the server's rules.

    ``batch``: id_driver, id_transportation, payment (NULL or < 0: compute),
    seq; a pair offered twice counts once (lowest ``seq``, a NULL one last).
    A row is refused for the first rule it breaks, in this order: the pair is
    already assigned ('duplicate'), the driver or the trip does not exist
    ('unknown_driver', 'unknown_trip'), the trip's crew is full given its
    existing crew ('crew_limit', earliest ``seq`` first). Accepted rows are
    priced (#34).

    The batch, the crews of its trips and the trips themselves are one tagged
    union, cut to the batch's trips by one semi join: one aggregate over (driver,
    trip) finds repeated offers and pairs that exist, a second over trips their
    crews. The crew limit ranks the valid new rows of a trip with
    ``row_number() <= limit`` (a partial WindowGroupLimit caps a hot trip before
    the shuffle). For a small batch Spark broadcasts the key sets, so the
    large tables are scanned but not shuffled.
    """
    return Assigned(t, batch, limit, bands)


# --- #61 register users, #62 replace roles ----------------------------------

class Registered:
    """The outputs of ``register_users``, each built when it is asked for.
    All read one staged table of verdicts; no password is written to it."""

    def __init__(self, t: Tables, batch: DataFrame):
        self._t = t
        self._batch = trimmed(batch, "login", "last_name", "first_name", "middle_name")

    @cached_property
    def _verdicts(self) -> DataFrame:
        """reg_seq, rules (that it breaks), roles (ids) and is_driver."""
        form = quality.broken(quality.registration_rules(ROLE_DRIVER))
        named = self._batch.select("reg_seq", form.alias("form"), F.array_contains("roles", ROLE_DRIVER).alias("is_driver"),
                                   F.explode_outer(F.transform("roles", lambda x: F.struct(x.alias("name")))).alias("role"))
        asked = named.where("role is not null").select("reg_seq", F.col("role.name").alias("role_name"))
        found = join_few_valued(asked, self._t.roles, "role_name").select("reg_seq", "role_name", "id_role")
        rows = named.select("reg_seq", "form", "is_driver", F.col("role.name").alias("asked"), F.col("role").isNotNull().alias("asks"),
                            F.lit(None).cast("string").alias("role_name"), F.lit(None).cast("bigint").alias("id_role")).unionByName(
            found.select("reg_seq", F.lit(None).cast("array<string>").alias("form"), F.lit(None).cast("boolean").alias("is_driver"),
                         F.lit(None).cast("string").alias("asked"), F.lit(False).alias("asks"), "role_name", "id_role"))
        names = F.collect_set(F.when(F.col("asks"), F.coalesce("asked", F.lit(""))))
        each = rows.groupBy("reg_seq").agg(
            F.max("form").alias("form"), F.max("is_driver").alias("is_driver"), names.alias("asked"),
            F.collect_set("role_name").alias("known"), F.collect_set("id_role").alias("roles"))
        unknown = F.transform(F.array_except("asked", "known"), lambda x: F.concat(F.lit("unknown_role:"), x))
        return materialize(each.select("reg_seq", F.concat("form", unknown).alias("rules"), "roles",
                                       F.coalesce("is_driver", F.lit(False)).alias("is_driver")), "registrations")

    @cached_property
    def rejected(self) -> DataFrame:
        return self._verdicts.select("reg_seq", F.explode("rules").alias("rule"))

    @cached_property
    def _ids(self) -> DataFrame:
        """reg_seq and id_user of the accepted registrations, their roles and
        whether they are drivers."""
        ok = self._verdicts.where(F.size("rules") == 0).drop("rules")
        return allocate_ids(ok, "id_user", ["reg_seq"], max_id(self._t.users, "id_user"))

    @cached_property
    def users(self) -> DataFrame:
        new = self._batch.join(self._ids.select("reg_seq", "id_user"), "reg_seq")
        return self._t.users.unionByName(new.select(*self._t.users.columns))

    @cached_property
    def user_roles(self) -> DataFrame:
        return self._t.user_roles.unionByName(self._ids.select("id_user", F.explode("roles").alias("id_role")))

    @cached_property
    def drivers(self) -> DataFrame:
        rows = self._ids.where("is_driver").select("reg_seq", "id_user")
        ids = allocate_ids(rows, "id_driver", ["reg_seq"], max_id(self._t.drivers, "id_driver"))
        return self._t.drivers.unionByName(self._batch.join(ids, "reg_seq").select(
            "id_driver", "id_user", "last_name", "first_name", "middle_name",
            F.coalesce("experience", F.lit(0)).cast("int").alias("experience")))


def register_users(t: Tables, batch: DataFrame) -> Registered:
    """Register users with roles; the driver role also creates a driver.

    ``batch``: reg_seq (unique), login, password, roles (array of names),
    last_name, first_name, middle_name, experience. Text but the password is
    trimmed. A registration breaking a form rule (#48) or naming an unknown
    role (#23) is rejected whole; the rest get new user ids (and driver ids)
    in ``reg_seq`` order and one new snapshot.
    """
    return Registered(t, batch)


@dataclass(frozen=True)
class RolesReplaced:
    user_roles: DataFrame
    rejected: DataFrame


def replace_user_roles(user_roles: DataFrame, roles: DataFrame, batch: DataFrame) -> RolesReplaced:
    """Each user in ``batch`` (id_user, role_name) gets exactly the given
    roles; a user naming an unknown role keeps the old ones (rejected)."""
    resolved, unknown = resolve_role_names(batch, roles)
    bad = unknown.select("id_user").distinct()
    touched = batch.select("id_user").distinct().join(bad, "id_user", "left_anti")
    kept = user_roles.join(touched, "id_user", "left_anti")
    return RolesReplaced(kept.unionByName(resolved), unknown)


# --- #63, #64 removals ------------------------------------------------------

def remove_assignments(assignments: DataFrame, pairs: DataFrame) -> DataFrame:
    """Take (driver, trip) pairs off their trips (a small request is
    broadcast by Spark's size check; the assignments then stream through)."""
    return assignments.join(pairs.select("id_driver", "id_transportation"),
                            ["id_driver", "id_transportation"], "left_anti")


@dataclass(frozen=True)
class UsersDeleted:
    users: DataFrame
    user_roles: DataFrame
    drivers: DataFrame


def delete_users(t: Tables, ids: DataFrame) -> UsersDeleted:
    """Delete users; their role links go, their driver stays without an
    account (id_user NULL)."""
    k = ids.select("id_user").distinct().withColumn("_gone", F.lit(True))
    drivers = (left_join(t.drivers, k, "id_user", "id_driver")
               .withColumn("id_user", F.when(F.col("_gone").isNull(), F.col("id_user")))
               .select(*t.drivers.columns))
    return UsersDeleted(t.users.join(k, "id_user", "left_anti"),
                        t.user_roles.join(k, "id_user", "left_anti"), drivers)


@dataclass(frozen=True)
class TripsDeleted:
    transportations: DataFrame
    assignments: DataFrame


def delete_transportations(t: Tables, ids: DataFrame) -> TripsDeleted:
    """Delete trips and, by cascade, their assignments."""
    k = ids.select("id_transportation")
    return TripsDeleted(t.transportations.join(k, "id_transportation", "left_anti"),
                        t.assignments.join(k, "id_transportation", "left_anti"))


@dataclass(frozen=True)
class Refusable:
    table: DataFrame
    refused: DataFrame


def delete_routes(t: Tables, ids: DataFrame) -> Refusable:
    """Delete routes no trip uses; the others are refused. The trips on the
    requested routes (a semi join) are reduced to one row per route on both
    sides of the shuffle, so a route of a third of all trips is no hot key."""
    k = ids.select("id_route").distinct()
    refused = narrow(t.transportations.select("id_route"), k, "id_route").distinct()
    gone = k.join(refused, "id_route", "left_anti")
    return Refusable(t.routes.join(gone, "id_route", "left_anti"), refused)


def delete_drivers(t: Tables, ids: DataFrame) -> Refusable:
    """Delete drivers without assignments; assigned ones are refused. Like
    ``delete_routes``, over the requested drivers' assignments."""
    k = ids.select("id_driver").distinct()
    refused = narrow(t.assignments.select("id_driver"), k, "id_driver").distinct()
    gone = k.join(refused, "id_driver", "left_anti")
    return Refusable(t.drivers.join(gone, "id_driver", "left_anti"), refused)
