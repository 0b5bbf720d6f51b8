"""Data-quality rules: the reference's form checks, re-aimed
as audits over whole tables.

Each audit yields one row per (key, broken rule); ``split_valid`` turns the
failures into a good/bad split of the input. Rules are plain column
expressions evaluated in one pass (``explode`` of the non-NULL entries of an
array of ``when``s); no UDFs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.functions.text import unicode_trim
from haulage.sources.tables import Tables

# The reference's form limits.
EXPERIENCE_RANGE = (0, 80)
DISTANCE_RANGE = (1, 20000)
BASE_PAY_RANGE = (0, 1000000)
BONUS_MAX = 500000
# The password policy, checked in this order; the first
# failure is the outcome. ``Ё``/``ё`` are outside А-Я/а-я, so they count as
# special characters, not as upper case.
PASSWORD_MIN_LENGTH = 8
PASSWORD_DIGIT = r"[0-9]"
PASSWORD_UPPER = r"[A-ZА-Я]"
PASSWORD_SPECIAL = r"[^a-zA-Z0-9а-яА-Я\s]"
PASSWORD_OUTCOMES = ("too_short", "no_digit", "no_upper", "no_special", "ok")


def blank(x) -> Column:
    """Empty after trimming white space of any kind; NULL counts as empty."""
    c = F.col(x) if isinstance(x, str) else x
    return unicode_trim(F.coalesce(c, F.lit(""))) == ""


def outside(x: str, lo, hi, lo_open: bool = False) -> Column:
    """NOT (lo <= x <= hi); NULL counts as outside."""
    c = F.col(x)
    low = (c > lo) if lo_open else (c >= lo)
    return ~F.coalesce(low & (c <= hi), F.lit(False))


def broken(rules: list) -> Column:
    """The names of the rules that a row breaks. A rule is ``(name,
    condition)`` or a Column that yields the rule's name when broken and NULL
    otherwise."""
    flags = F.array(*[r if isinstance(r, Column) else F.when(r[1], F.lit(r[0])) for r in rules])
    return F.filter(flags, lambda r: r.isNotNull())


def failures(df: DataFrame, keys: list[str], rules: list) -> DataFrame:
    """One row per key and broken rule."""
    return (df.select(*keys, broken(rules).alias("_broken"))
            .select(*keys, F.explode("_broken").alias("rule")))


def split_valid(df: DataFrame, fails: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows breaking no rule, rows breaking some rule)."""
    bad_keys = fails.select(*keys).distinct()
    return df.join(bad_keys, keys, "left_anti"), df.join(bad_keys, keys, "left_semi")


# --- #44 password policy ----------------------------------------------------

def utf16_length(x: Column) -> Column:
    """Length in UTF-16 code units, as the reference's strings count it (a
    character outside the Basic Multilingual Plane counts twice)."""
    return F.octet_length(F.encode(x, "UTF-16LE")) / 2


def password_outcome(password) -> Column:
    p = F.coalesce(F.col(password) if isinstance(password, str) else password, F.lit(""))
    return (F.when(utf16_length(p) < PASSWORD_MIN_LENGTH, F.lit("too_short"))
            .when(~p.rlike(PASSWORD_DIGIT), F.lit("no_digit"))
            .when(~p.rlike(PASSWORD_UPPER), F.lit("no_upper"))
            .when(~p.rlike(PASSWORD_SPECIAL), F.lit("no_special"))
            .otherwise(F.lit("ok")))


def password_policy_audit(users: DataFrame) -> DataFrame:
    """Per user, the first failing password rule or 'ok'. Only the id and
    the outcome leave this function, never the password."""
    return users.select("id_user", password_outcome("password").alias("outcome"))


def password_policy_summary(users: DataFrame) -> DataFrame:
    """Users per outcome (partial + final aggregation over five keys)."""
    return password_policy_audit(users).groupBy("outcome").agg(F.count("*").alias("users"))


# --- #45-48 form rules ------------------------------------------------------

def driver_rules() -> list:
    """What the driver form checks before a write."""
    return [("last_name_empty", blank("last_name")),
            ("first_name_empty", blank("first_name")),
            ("experience_range", outside("experience", *EXPERIENCE_RANGE))]


def route_rules() -> list:
    return [("name_empty", blank("route_name")),
            ("distance_range", outside("distance", *DISTANCE_RANGE)),
            ("base_payment_range", outside("base_payment", *BASE_PAY_RANGE))]


def bonus_rules() -> list:
    return [("bonus_range", outside("bonus_amount", 0, BONUS_MAX, lo_open=True)),
            ("reason_empty", blank("bonus_reason"))]


def password_rules() -> list:
    """The policy's first failing rule, as ``password_<outcome>``."""
    outcome = password_outcome("password")
    return [F.when(outcome != "ok", F.concat(F.lit("password_"), outcome))]


def validate_drivers(drivers: DataFrame) -> DataFrame:
    return failures(drivers, ["id_driver"], [
        *driver_rules(), ("no_account", ~F.coalesce(F.col("id_user") > 0, F.lit(False)))])


def validate_routes(routes: DataFrame) -> DataFrame:
    return failures(routes, ["id_route"], route_rules())


def validate_bonuses(awards: DataFrame) -> DataFrame:
    return failures(awards, ["id_driver", "id_transportation"], bonus_rules())


def registration_rules(driver_role: str = "Водитель") -> list:
    outcome = password_outcome("password")
    has_pw = F.coalesce(F.col("password") != "", F.lit(False))
    is_driver = F.coalesce(F.array_contains(F.col("roles"), driver_role), F.lit(False))
    return [
        ("login_empty", blank("login")),
        ("password_empty", ~has_pw),
        F.when(has_pw & (outcome != "ok"), F.concat(F.lit("password_"), outcome)),
        ("no_role", F.coalesce(F.size("roles"), F.lit(0)) <= 0),
        ("driver_last_name_empty", is_driver & blank("last_name")),
        ("driver_first_name_empty", is_driver & blank("first_name")),
    ]


def validate_registrations(regs: DataFrame, driver_role: str = "Водитель") -> DataFrame:
    """Login and password present; password policy; at least one role; a
    driver needs last and first name. All broken rules are listed; the
    policy contributes its first failing rule as ``password_<outcome>``."""
    return failures(regs, ["id_user"], registration_rules(driver_role))


# --- #49 orphans, #50 duplicate keys ----------------------------------------

def _children(child: DataFrame, fk: str, row_key: Column, col: str) -> DataFrame:
    """(fk, row_key, missing_id) of the rows that point somewhere."""
    return child.where(F.col(col).isNotNull()).select(
        F.lit(fk).alias("fk"), row_key.cast("string").alias("row_key"), F.col(col).cast("bigint").alias("missing_id"))


def _orphans(children: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    # An anti join needs no distinct right side: one shuffle per side.
    return children.join(parent.select(F.col(key).cast("bigint").alias("missing_id")), "missing_id", "left_anti")


def fk_orphans(t: Tables) -> DataFrame:
    """Rows whose implied foreign key points at no row, tagged by key. The
    children of one parent are one table, so that it is shuffled once; the two
    parents of an assignment are looked up from one reading of it."""
    pair = F.concat_ws("/", F.col("id_driver").cast("string"), F.col("id_transportation").cast("string"))
    link = F.concat_ws("/", F.col("id_user").cast("string"), F.col("id_role").cast("string"))
    users = _children(t.user_roles, "user_roles.id_user", link, "id_user").unionByName(
        _children(t.drivers, "drivers.id_user", F.col("id_driver"), "id_user"))
    parts = [
        _orphans(users, t.users, "id_user"),
        _orphans(_children(t.user_roles, "user_roles.id_role", link, "id_role"), t.roles, "id_role"),
        _orphans(_children(t.transportations, "transportations.id_route", F.col("id_transportation"), "id_route"),
                 t.routes, "id_route"),
        _orphans(_children(t.assignments, "assignments.id_driver", pair, "id_driver"), t.drivers, "id_driver"),
        _orphans(_children(t.assignments, "assignments.id_transportation", pair, "id_transportation"),
                 t.transportations, "id_transportation"),
    ]
    return reduce(DataFrame.unionByName, [p.select("fk", "row_key", "missing_id") for p in parts])


def duplicate_keys(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, with the number of copies.
    Counting is a partial + final aggregation; a hot key is combined
    map-side."""
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return (df.groupBy(*keys).agg(F.count("*").alias("copies"))
            .where(F.col("copies") > 1)
            .select(F.lit(table).alias("table_name"), key.alias("key"), "copies"))


def key_duplicates(t: Tables, raw_assignments: DataFrame | None = None) -> DataFrame:
    """Duplicate-key audit over every table's implied key (#50). If given,
    ``raw_assignments`` (rows before merging) is audited in place of the
    assignments table."""
    parts = [
        duplicate_keys(t.roles, "roles", ["id_role"]),
        duplicate_keys(t.users, "users", ["id_user"]),
        duplicate_keys(t.user_roles, "user_roles", ["id_user", "id_role"]),
        duplicate_keys(t.drivers, "drivers", ["id_driver"]),
        duplicate_keys(t.routes, "routes", ["id_route"]),
        duplicate_keys(t.transportations, "transportations", ["id_transportation"]),
        duplicate_keys(raw_assignments if raw_assignments is not None else t.assignments,
                       "assignments", ["id_driver", "id_transportation"]),
    ]
    return reduce(DataFrame.unionByName, parts)
