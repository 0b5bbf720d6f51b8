"""Dirty inputs and change batches derived from the seven tables.

Clean fixtures break almost no rule, so audits and writes get inputs that
Spark derives from the whole tables (FIXTURES.md §2.1). Every derivation is
a row-wise rewrite or a join over the full tables; none samples or caps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.operators.joins import join_few_valued
from haulage.schemas import MONEY
from haulage.sources.tables import Tables
from haulage.sources.testdata import source


def dirty_routes(t: Tables) -> DataFrame:
    """name '' if id % 50 = 0; distance 0.5 if id % 70 = 0; base pay -1 if id % 90 = 0."""
    r = t.routes
    k = F.col("id_route")
    return r.select("id_route",
                    F.when(k % 50 == 0, F.lit("")).otherwise(F.col("route_name")).alias("route_name"),
                    F.when(k % 70 == 0, F.lit("0.50").cast(MONEY)).otherwise(F.col("distance")).alias("distance"),
                    F.when(k % 90 == 0, F.lit("-1.00").cast(MONEY)).otherwise(F.col("base_payment")).alias("base_payment"))


def dirty_drivers(t: Tables) -> DataFrame:
    """last_name '' if id % 10 = 0; first_name blank if id % 8 = 0;
    experience 90 if id % 15 = 0."""
    k = F.col("id_driver")
    return t.drivers.select("id_driver", "id_user",
                            F.when(k % 10 == 0, F.lit("")).otherwise(F.col("last_name")).alias("last_name"),
                            F.when(k % 8 == 0, F.lit("\t")).otherwise(F.col("first_name")).alias("first_name"),
                            "middle_name",
                            F.when(k % 15 == 0, F.lit(90)).otherwise(F.col("experience")).cast("int").alias("experience"))


def bonus_awards(t: Tables) -> DataFrame:
    """Assignments carrying a bonus; amount 600000 if id_driver % 40 = 0,
    reason '' if id_transportation % 25 = 0."""
    a = t.assignments.where(F.col("bonus_amount").isNotNull())
    return a.select("id_driver", "id_transportation",
                    F.when(F.col("id_driver") % 40 == 0, F.lit(600000).cast(MONEY))
                     .otherwise(F.col("bonus_amount")).alias("bonus_amount"),
                    F.when(F.col("id_transportation") % 25 == 0, F.lit(""))
                     .otherwise(F.col("bonus_reason")).alias("bonus_reason"))


def registrations(t: Tables) -> DataFrame:
    """One registration per user: login ('' if id % 50 = 0), password, the
    user's role names, and the names of the user's driver profile (the
    lowest driver id) if any."""
    roles = (join_few_valued(t.user_roles, t.roles, "id_role")
             .groupBy("id_user").agg(F.array_sort(F.collect_list("role_name")).alias("roles")))
    names = (t.drivers.where(F.col("id_user").isNotNull())
             .groupBy("id_user")
             .agg(F.min_by(F.struct("last_name", "first_name", "middle_name", "experience"),
                           F.col("id_driver")).alias("d")))
    u = t.users
    return (u.join(roles, "id_user", "left").join(names, "id_user", "left")
            .select("id_user",
                    F.when(F.col("id_user") % 50 == 0, F.lit("")).otherwise(F.col("login")).alias("login"),
                    "password",
                    F.coalesce("roles", F.array().cast("array<string>")).alias("roles"),
                    F.col("d.last_name").alias("last_name"), F.col("d.first_name").alias("first_name"),
                    F.col("d.middle_name").alias("middle_name"), F.col("d.experience").alias("experience")))


def orphan_tables(t: Tables) -> Tables:
    """Trips with id % 100 = 0, users with id % 9 = 0 and role 4 removed,
    leaving assignments, drivers and role links that point at nothing."""
    return t.with_(transportations=t.transportations.where(F.col("id_transportation") % 100 != 0),
                   users=t.users.where(F.col("id_user") % 9 != 0),
                   roles=t.roles.where(F.col("id_role") != 4))


def repeated_tables(t: Tables) -> Tables:
    """Every table but the assignments with some rows given twice."""
    def again(df: DataFrame, key: str, n: int) -> DataFrame:
        return df.unionByName(df.where(F.col(key) % n == 0))

    return t.with_(roles=again(t.roles, "id_role", 2), users=again(t.users, "id_user", 50),
                   user_roles=again(t.user_roles, "id_user", 50), drivers=again(t.drivers, "id_driver", 20),
                   routes=again(t.routes, "id_route", 50),
                   transportations=again(t.transportations, "id_transportation", 500))


def spaced_drivers(t: Tables) -> DataFrame:
    """Drivers whose names have white space of several kinds at the ends."""
    return t.drivers.withColumns({
        "last_name": F.concat(F.lit("\t"), F.col("last_name"), F.lit("\u00a0 ")),
        "first_name": F.concat(F.lit("\u2003"), F.col("first_name"), F.lit(" x\n")),
        "middle_name": F.concat(F.lit("\u3000"), F.col("middle_name"))})


def with_revocations(t: Tables) -> Tables:
    """The role links after a revocation batch: every user with id % 7 = 0
    loses all roles."""
    revoked = t.users.where(F.col("id_user") % 7 == 0).select("id_user")
    return t.with_(user_roles=t.user_roles.join(revoked, "id_user", "left_anti"))


def many_roles(t: Tables, n: int = 20_000) -> Tables:
    """``n`` roles, and every link moved to one of them by user and role."""
    spark = t.users.sparkSession
    roles = spark.range(1, n + 1).select(F.col("id").alias("id_role"),
                                         F.concat(F.lit("role "), F.col("id").cast("string")).alias("role_name"))
    moved = ((F.col("id_user") * 4 + F.col("id_role")) % n + 1).alias("id_role")
    return t.with_(roles=roles, user_roles=t.user_roles.select("id_user", moved))


def many_bands(t: Tables, n: int = 5_000) -> DataFrame:
    """``n`` pay bands of one year each, around zero."""
    i = F.col("id")
    return t.drivers.sparkSession.range(n).select(
        (i - n // 2).cast("int").alias("lo"), (i - n // 2 + 1).cast("int").alias("hi"),
        (F.lit(1) + i.cast("decimal(6,0)") / 1000).cast("decimal(6,2)").alias("multiplier"))


def overlapping_bands(t: Tables) -> DataFrame:
    """``many_bands``, some reaching further than the next one's beginning
    (every 100th ten years, every 1000th to the end), some twice."""
    b, lo = many_bands(t), F.col("lo")
    hi = F.when(lo % 1000 == 999, F.lit(None)).when(lo % 100 == 0, lo + 10).otherwise(F.col("hi")).cast("int")
    return b.withColumn("hi", hi).unionByName(b.where(lo % 50 == 7))


def without_some_crews(t: Tables) -> Tables:
    """Drivers with id % 50 = 0 have no assignments any more, so that some of
    the drivers asked to be deleted can be."""
    return t.with_(assignments=t.assignments.where(F.col("id_driver") % 50 != 0))


def dateless_trips(t: Tables) -> Tables:
    """Trips with id % 20 = 0 have no departure."""
    k = F.col("id_transportation")
    return t.with_(transportations=t.transportations.withColumn(
        "departure_date", F.when(k % 20 != 0, F.col("departure_date"))))


def sign_in_attempts(t: Tables) -> DataFrame:
    """One attempt per user: right, with spaces around the login; wrong
    password if id % 5 = 0; unknown login if id % 11 = 0; empty if % 13."""
    k = F.col("id_user")
    return t.users.select(
        k.alias("attempt"),
        F.when(k % 13 == 0, F.lit(" \t")).when(k % 11 == 0, F.lit("nobody"))
        .otherwise(F.concat(F.lit("\u00a0"), F.col("login"), F.lit(" "))).alias("login"),
        F.when(k % 5 == 0, F.concat(F.col("password"), F.lit(" "))).otherwise(F.col("password")).alias("password"))


def raw_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignment rows one per lineitem, before the adapter merges repeated
    (supplier, order) pairs: the input for the duplicate-key audit."""
    li = source(spark, sf_dir, "lineitem")
    return li.select((F.col("l_suppkey") + 1).alias("id_driver"),
                     (F.col("l_orderkey") + 1).alias("id_transportation"),
                     F.col("l_extendedprice").cast(MONEY).alias("payment"),
                     F.col("l_linenumber").cast("int").alias("seq"))


# --- change batches (FIXTURES.md §2.1) ---------------------------------------
# Each batch carries ``seq``, the change order; rows with a NULL key insert.

def _no_seq():
    return F.lit(None).cast("bigint")


def driver_changes(t: Tables) -> DataFrame:
    """Drivers with an even id: one more year; id % 20 = 0 also lose their
    account (id 0); id % 4 = 0 come with white space around the last name;
    id % 10 = 0 with a blank first name and id % 14 = 0 with 91 years (both
    refused). id % 6 = 0 have no seq, and of those id % 12 = 0 an older change
    with one, which wins. id % 5 = 0 are inserted anew."""
    k, name = F.col("id_driver"), F.col("last_name")
    d = t.drivers
    updates = d.where(k % 2 == 0).select(
        "id_driver", F.when(k % 20 == 0, F.lit(0).cast("bigint")).otherwise(F.col("id_user")).alias("id_user"),
        F.when(k % 4 == 0, F.concat(F.lit("\t"), name, F.lit("\u00a0"))).otherwise(name).alias("last_name"),
        F.when(k % 10 == 0, F.lit(" \u2003")).otherwise(F.col("first_name")).alias("first_name"), "middle_name",
        F.when(k % 14 == 0, F.lit(91)).otherwise(F.col("experience") + 1).cast("int").alias("experience"),
        F.when(k % 6 != 0, k).alias("seq"))
    older = d.where(k % 12 == 0).select("id_driver", "id_user", "last_name", "first_name", "middle_name",
                                        F.lit(1).alias("experience"), F.lit(0).cast("bigint").alias("seq"))
    inserts = d.where(k % 5 == 0).select(
        F.lit(None).cast("bigint").alias("id_driver"), F.lit(None).cast("bigint").alias("id_user"),
        F.concat(F.lit("\u00a0Н"), k.cast("string")).alias("last_name"), F.lit("Иван\t").alias("first_name"),
        F.lit(None).cast("string").alias("middle_name"), F.lit(3).alias("experience"),
        F.when(k % 15 != 0, k + 1_000_000).alias("seq"))
    return updates.unionByName(older).unionByName(inserts)


def route_changes(t: Tables) -> DataFrame:
    """Routes with id % 10 = 0 renamed to upper case (in white space) with base
    pay x 1.1; refused: id % 70 = 0 with distance 0.50, % 90 = 0 with base pay
    -1, % 110 = 0 without a name; id % 30 = 0 have no seq. Every route with an
    even id is copied as a new route (NULL id), refused if id % 50 = 0 (blank
    name)."""
    r = t.routes
    k = F.col("id_route")
    raised = F.round(F.col("base_payment") * F.lit("1.10").cast("decimal(4,2)"), 2).cast(MONEY)
    upd = r.where(k % 10 == 0).select(
        "id_route",
        F.when(k % 110 == 0, F.lit("\u2003")).otherwise(F.concat(F.lit("\t "), F.upper("route_name"), F.lit("\u00a0")))
        .alias("route_name"),
        F.when(k % 70 == 0, F.lit("0.50").cast(MONEY)).otherwise(F.col("distance")).alias("distance"),
        F.when(k % 90 == 0, F.lit("-1.00").cast(MONEY)).otherwise(raised).alias("base_payment"),
        F.when(k % 30 != 0, k * 2).alias("seq"))
    ins = r.where(k % 2 == 0).select(
        F.lit(None).cast("bigint").alias("id_route"),
        F.when(k % 50 == 0, F.lit("\u00a0")).otherwise(F.concat(F.col("route_name"), F.lit(" 2"))).alias("route_name"),
        "distance", "base_payment", (k * 2 + 1).alias("seq"))
    return upd.unionByName(ins)


def trip_changes(t: Tables) -> DataFrame:
    """Unfinished trips with id % 3 = 0 arrive two days after departure; with
    id % 6 = 0 the form says "not completed", so the arrival is not stored.
    Trips with id % 50 = 0 are entered anew, completed if id % 100 = 0."""
    k = F.col("id_transportation")
    later = F.timestamp_add("DAY", F.lit(2), F.col("departure_date"))
    upd = (t.transportations.where(F.col("arrival_date").isNull() & (k % 3 == 0))
           .select("id_transportation", "id_route", "departure_date", later.alias("arrival_date"),
                   (k % 6 != 0).alias("completed"), k.alias("seq")))
    ins = t.transportations.where(k % 50 == 0).select(
        F.lit(None).cast("bigint").alias("id_transportation"), "id_route", "departure_date",
        later.alias("arrival_date"), (k % 100 == 0).alias("completed"), (k + 1_000_000_000).alias("seq"))
    return upd.unionByName(ins)


def password_changes(t: Tables) -> DataFrame:
    """Users with id % 10 = 0 change their password twice; the later wins,
    unless it is weak (id % 30 = 0: refused). A third change without seq
    (id % 40 = 0) is the oldest."""
    u, k = t.users.where(F.col("id_user") % 10 == 0), F.col("id_user")
    first = u.select("id_user", F.lit("Tmp#0000").alias("password"), (k * 2).alias("seq"))
    second = u.select("id_user", F.when(k % 30 == 0, F.lit("weakpass")).otherwise(F.concat(F.lit("Pw#9"), F.col("login")))
                      .alias("password"), (k * 2 + 1).alias("seq"))
    third = u.where(k % 40 == 0).select("id_user", F.lit("Null#9999").alias("password"), _no_seq().alias("seq"))
    return first.unionByName(second).unionByName(third)


def bonus_changes(t: Tables) -> DataFrame:
    """A bonus of 1000.00 for every assignment on a trip with id % 10 = 0,
    plus one change per such assignment for a pair that does not exist. Newer
    ones are refused: -5.00 (id % 30 = 0), 600000.00 (% 70), a blank reason
    (% 40). One without seq (% 20) is older than the first."""
    a, k = t.assignments.where(F.col("id_transportation") % 10 == 0), F.col("id_transportation")
    seq = F.col("seq").cast("long")

    def change(rows: DataFrame, amount: str, reason: str, seq) -> DataFrame:
        return rows.select("id_driver", "id_transportation", F.lit(amount).cast(MONEY).alias("bonus_amount"),
                           F.lit(reason).alias("bonus_reason"), seq.alias("seq"))

    absent = change(a, "5.00", "нет", seq).withColumn("id_driver", F.col("id_driver") + 1000000)
    return (change(a, "1000.00", "\tрейс\u00a0", seq).unionByName(absent)
            .unionByName(change(a.where(k % 30 == 0), "-5.00", "x", seq + 100))
            .unionByName(change(a.where(k % 70 == 0), "600000.00", "x", seq + 200))
            .unionByName(change(a.where(k % 40 == 0), "7.00", " \u2003", seq + 300))
            .unionByName(change(a.where(k % 20 == 0), "3.00", "без номера", _no_seq())))


def report_changes(t: Tables) -> list[DataFrame]:
    """Two deliveries of the report feed, bonus changes and trip arrivals:
    trips whose id // 10 is odd, then the others."""
    k = F.col("id_transportation")
    none = lambda kind: F.lit(None).cast(kind)
    bonus = bonus_changes(t).select("id_driver", k, "bonus_amount", "bonus_reason",
                                    none("timestamp_ntz").alias("arrival_date"), "seq")
    trips = trip_changes(t).where(k.isNotNull()).select(
        none("bigint").alias("id_driver"), k, none(MONEY).alias("bonus_amount"), none("string").alias("bonus_reason"),
        F.when(F.col("completed"), F.col("arrival_date")).alias("arrival_date"), "seq")
    feed = bonus.unionByName(trips)
    return [feed.where((k / 10).cast("bigint") % 2 == part) for part in (1, 0)]


def crew_deliveries(t: Tables) -> tuple[DataFrame, list[DataFrame]]:
    """(stored assignments, two deliveries of new ones): stored are those with
    seq 1 on trips with id % 5 = 0; of the others, odd seq comes first."""
    stored = (F.col("id_transportation") % 5 == 0) & (F.col("seq") == 1)
    new = t.assignments.where(~stored)
    return t.assignments.where(stored), [new.where(F.col("seq") % 2 == 1), new.where(F.col("seq") % 2 == 0)]


def assign_existing(t: Tables) -> Tables:
    """The snapshot before the assign batch: assignments of odd trips only."""
    return t.with_(assignments=t.assignments.where(F.col("id_transportation") % 2 == 1))


def assign_batch(t: Tables) -> DataFrame:
    """Every assignment offered again (payment as stored: NULL is priced; -1
    if the trip's id % 18 = 0). Trips with id % 50 = 0 also get an unknown
    driver, % 70 = 0 ask for an unknown trip, and % 22 = 0 are offered once
    more without seq, at 77.00."""
    k = F.col("id_transportation")
    a = t.assignments.select("id_driver", "id_transportation", "payment", "seq")
    offered = a.withColumn("payment", F.when(k % 18 == 0, F.lit("-1").cast(MONEY)).otherwise(F.col("payment")))
    no_driver = a.where(k % 50 == 0).withColumn("id_driver", F.col("id_driver") + 1_000_000)
    no_trip = a.where(k % 70 == 0).withColumn("id_transportation", k + 1_000_000_000)
    no_seq = a.where(k % 22 == 0).withColumns({"payment": F.lit("77.00").cast(MONEY), "seq": F.lit(None).cast("int")})
    return offered.unionByName(no_driver).unionByName(no_trip).unionByName(no_seq)


def role_changes(t: Tables) -> DataFrame:
    """Users with id % 10 = 0 become mechanics; id % 20 = 0 also drivers;
    id % 30 = 0 also ask for an unknown role (whole user refused)."""
    k = F.col("id_user")
    names = F.array(F.when(k % 10 == 0, "Механик"), F.when(k % 20 == 0, "Водитель"), F.when(k % 30 == 0, "Оператор"))
    return t.users.where(k % 10 == 0).select("id_user", F.explode(names).alias("role_name")).where("role_name is not null")


def registration_batch(t: Tables) -> DataFrame:
    """Users with id % 10 = 0 registered again as 'new_<login>', in white
    space, with their password and roles (plus an unknown role if id % 30 =
    0)."""
    roles = (join_few_valued(t.user_roles, t.roles, "id_role")
             .groupBy("id_user").agg(F.array_sort(F.collect_list("role_name")).alias("roles")))
    k = F.col("id_user")
    base = F.coalesce(F.col("roles"), F.array().cast("array<string>"))
    return (t.users.where(k % 10 == 0).join(roles, "id_user", "left")
            .select(k.alias("reg_seq"), F.concat(F.lit(" new_"), F.col("login"), F.lit("\u00a0")).alias("login"), "password",
                    F.when(k % 30 == 0, F.concat(base, F.array(F.lit("Оператор")))).otherwise(base).alias("roles"),
                    F.concat(F.lit("\tН"), k.cast("string")).alias("last_name"), F.lit("Иван ").alias("first_name"),
                    F.lit(None).cast("string").alias("middle_name"), (k % 40).cast("int").alias("experience")))


def removal_pairs(t: Tables) -> DataFrame:
    """Assignments of drivers with id % 10 = 0 are taken off their trips."""
    return t.assignments.where(F.col("id_driver") % 10 == 0).select("id_driver", "id_transportation")


def ids_every(df: DataFrame, col: str, n: int = 25) -> DataFrame:
    """Deletion requests: ids divisible by ``n``."""
    return df.where(F.col(col) % n == 0).select(col)
