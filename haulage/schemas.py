"""The seven table schemas (one StructType per reference table).

Money and distance are Decimal(18,2) inside the engine so sums do not depend
on the order rows arrive in; reports emit DOUBLE.
"""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

ROLES = T.StructType([
    T.StructField("id_role", T.LongType(), False),
    T.StructField("role_name", T.StringType(), False),
])

USERS = T.StructType([
    T.StructField("id_user", T.LongType(), True),
    T.StructField("login", T.StringType(), True),
    T.StructField("password", T.StringType(), True),
])

USER_ROLES = T.StructType([
    T.StructField("id_user", T.LongType(), True),
    T.StructField("id_role", T.LongType(), True),
])

DRIVERS = T.StructType([
    T.StructField("id_driver", T.LongType(), True),
    T.StructField("id_user", T.LongType(), True),
    T.StructField("last_name", T.StringType(), True),
    T.StructField("first_name", T.StringType(), True),
    T.StructField("middle_name", T.StringType(), True),
    T.StructField("experience", T.IntegerType(), True),
])

ROUTES = T.StructType([
    T.StructField("id_route", T.LongType(), True),
    T.StructField("route_name", T.StringType(), True),
    T.StructField("distance", MONEY, True),
    T.StructField("base_payment", MONEY, True),
])

TRANSPORTATIONS = T.StructType([
    T.StructField("id_transportation", T.LongType(), True),
    T.StructField("id_route", T.LongType(), True),
    T.StructField("departure_date", T.TimestampNTZType(), True),
    T.StructField("arrival_date", T.TimestampNTZType(), True),
])

# ``seq`` is ours: it orders arrivals of assignments for the crew limit.
ASSIGNMENTS = T.StructType([
    T.StructField("id_driver", T.LongType(), True),
    T.StructField("id_transportation", T.LongType(), True),
    T.StructField("payment", MONEY, True),
    T.StructField("bonus_amount", MONEY, True),
    T.StructField("bonus_reason", T.StringType(), True),
    T.StructField("seq", T.IntegerType(), True),
])

ALL = {
    "roles": ROLES,
    "users": USERS,
    "user_roles": USER_ROLES,
    "drivers": DRIVERS,
    "routes": ROUTES,
    "transportations": TRANSPORTATIONS,
    "assignments": ASSIGNMENTS,
}

# The four role names of the reference, by id.
ROLE_ADMIN = "Администратор"
ROLE_DISPATCHER = "Диспетчер"
ROLE_DRIVER = "Водитель"
ROLE_MECHANIC = "Механик"
ROLE_ROWS = [(1, ROLE_ADMIN), (2, ROLE_DISPATCHER), (3, ROLE_DRIVER), (4, ROLE_MECHANIC)]
