"""DuckDB oracle SQL, one statement per registered query.

Every statement starts from the pre-registered TPC-H-like views (customer,
supplier, part, orders, lineitem, ...) and rebuilds the seven tables with the
same mapping as ``haulage.sources.testdata`` (FIXTURES.md §2), written
independently in SQL. Column names and types match the Spark results.
"""

from __future__ import annotations

# --- the seven tables -------------------------------------------------------

ADAPTER: dict[str, str] = {
    "roles": """
        SELECT CAST(id_role AS BIGINT) AS id_role, role_name FROM (VALUES
          (1, 'Администратор'), (2, 'Диспетчер'), (3, 'Водитель'), (4, 'Механик')
        ) r(id_role, role_name)
        WHERE EXISTS (SELECT 1 FROM orders
                      WHERE (TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) - 1) % 4 + 1 = r.id_role)""",
    "users": """
        SELECT c_custkey + 1 AS id_user, c_name AS login,
               CASE c_custkey % 5 WHEN 0 THEN 'Ab1#' WHEN 1 THEN 'abcdefg#1'
                    WHEN 2 THEN 'Abcdefgh#' WHEN 3 THEN 'Abcdefg12'
                    ELSE c_mktsegment || '#' || CAST(c_custkey AS VARCHAR) END AS password
        FROM customer""",
    "user_roles": """
        SELECT DISTINCT o_custkey + 1 AS id_user,
               (TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) - 1) % 4 + 1 AS id_role
        FROM orders WHERE TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) IS NOT NULL""",
    "routes": """
        SELECT p_partkey + 1 AS id_route, p_name AS route_name,
               CAST(p_size * 100 AS DECIMAL(18,2)) AS distance,
               CAST(p_retailprice AS DECIMAL(18,2)) AS base_payment
        FROM part""",
    "drivers": """
        SELECT s_suppkey + 1 AS id_driver,
               CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey + 1 END AS id_user,
               s_name AS last_name,
               'F' || CAST(s_suppkey % 7 AS VARCHAR) AS first_name,
               CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'M' || CAST(s_suppkey % 4 AS VARCHAR) END AS middle_name,
               CAST(s_nationkey AS INTEGER) AS experience
        FROM supplier""",
    "transportations": """
        SELECT o.o_orderkey + 1 AS id_transportation, l.min_part + 1 AS id_route,
               o.o_orderdate AS departure_date,
               CASE WHEN o.o_orderstatus = 'F'
                    THEN o.o_orderdate + to_days(CAST(o.o_orderkey % 10 + 1 AS INTEGER)) END AS arrival_date
        FROM orders o
        LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS min_part FROM lineitem GROUP BY l_orderkey) l
          ON o.o_orderkey = l.l_orderkey""",
    "assignments": """
        SELECT l_suppkey + 1 AS id_driver, l_orderkey + 1 AS id_transportation,
               CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE CAST(pay AS DECIMAL(18,2)) END AS payment,
               CASE WHEN m >= 0.05 THEN CAST(m * 10000 AS DECIMAL(18,2)) END AS bonus_amount,
               CASE WHEN m >= 0.05 THEN flag END AS bonus_reason,
               CAST(seq AS INTEGER) AS seq
        FROM (SELECT l_suppkey, l_orderkey,
                     sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS pay,
                     CAST(max(l_discount) AS DECIMAL(4,2)) AS m,
                     min(l_returnflag) AS flag, min(l_linenumber) AS seq
              FROM lineitem GROUP BY l_suppkey, l_orderkey) g""",
}


def with_tables(body: str, extra: list[tuple[str, str]] | tuple = ()) -> str:
    """``WITH <seven tables>, <extra>`` followed by ``body``."""
    ctes = list(ADAPTER.items()) + list(extra)
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in ctes) + "\n" + body


# --- shared expressions -----------------------------------------------------

# White space in the Unicode sense (RE2's \\s is ASCII only).
SPACE = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def full_name(alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return trim(f"concat(coalesce({p}last_name, ''), ' ', coalesce({p}first_name, ''), ' ', coalesce({p}middle_name, ''))")


def money_text(x: str) -> str:
    return f"CAST(coalesce(CAST({x} AS DECIMAL(18,2)), CAST(0 AS DECIMAL(18,2))) AS VARCHAR)"


def date_text(x: str) -> str:
    return f"strftime({x}, '%d.%m.%Y %H:%M')"


def arrival_text(x: str) -> str:
    return f"coalesce({date_text(x)}, 'В пути')"


# --- reports ----------------------------------------------------------------

DRIVER_TOTALS = """
    SELECT a.id_driver,
           count(*) FILTER (WHERE t.id_transportation IS NOT NULL AND t.arrival_date IS NOT NULL) AS completed_trips,
           count(*) FILTER (WHERE t.id_transportation IS NOT NULL AND t.arrival_date IS NULL) AS trips_in_progress,
           sum(coalesce(a.payment, 0)) AS pay, sum(coalesce(a.bonus_amount, 0)) AS bonus
    FROM assignments a LEFT JOIN transportations t ON a.id_transportation = t.id_transportation
    GROUP BY a.id_driver"""

SALARY_BODY = f"""
    SELECT d.id_driver, {full_name('d')} AS driver_full_name, d.experience AS experience_years,
           CAST(coalesce(p.completed_trips, 0) AS BIGINT) AS completed_trips,
           CAST(coalesce(p.trips_in_progress, 0) AS BIGINT) AS trips_in_progress,
           CAST(coalesce(p.pay, 0) AS DOUBLE) AS total_payment,
           CAST(coalesce(p.bonus, 0) AS DOUBLE) AS total_bonuses,
           CAST(coalesce(p.pay, 0) + coalesce(p.bonus, 0) AS DOUBLE) AS total_earned
    FROM drivers d LEFT JOIN driver_totals p ON d.id_driver = p.id_driver"""

CREW_TOTALS = f"""
    SELECT a.id_transportation,
           string_agg(coalesce({full_name('d')}, ''), ', ' ORDER BY coalesce({full_name('d')}, '')) AS drivers,
           sum(coalesce(a.payment, 0)) AS pay, sum(coalesce(a.bonus_amount, 0)) AS bonus
    FROM assignments a LEFT JOIN drivers d ON a.id_driver = d.id_driver
    GROUP BY a.id_transportation"""

SUMMARY_BODY = """
    SELECT t.id_transportation, r.route_name, CAST(r.distance AS DOUBLE) AS distance_km,
           t.departure_date, t.arrival_date, c.drivers,
           CAST(coalesce(c.pay, 0) AS DOUBLE) AS total_drivers_payment,
           CAST(coalesce(c.bonus, 0) AS DOUBLE) AS total_drivers_bonuses,
           CAST(coalesce(c.pay, 0) + coalesce(c.bonus, 0) AS DOUBLE) AS total_transportation_cost
    FROM transportations t
    LEFT JOIN routes r ON t.id_route = r.id_route
    LEFT JOIN crew_totals c ON t.id_transportation = c.id_transportation"""


def _captioned(body: str, captions: dict[str, str]) -> str:
    cols = ", ".join(f'"{src}" AS "{dst}"' for src, dst in captions.items())
    return f"SELECT {cols} FROM ({body}) x"


def reports() -> dict[str, str]:
    from haulage.operators.reports import SALARY_CAPTIONS, SUMMARY_CAPTIONS

    q: dict[str, str] = {}
    q["salary_statement"] = with_tables(SALARY_BODY, [("driver_totals", DRIVER_TOTALS)])
    q["transportation_summary"] = with_tables(SUMMARY_BODY, [("crew_totals", CREW_TOTALS)])
    q["salary_statement_captioned"] = with_tables(
        _captioned(SALARY_BODY, SALARY_CAPTIONS), [("driver_totals", DRIVER_TOTALS)])
    q["transportation_summary_captioned"] = with_tables(
        _captioned(SUMMARY_BODY, SUMMARY_CAPTIONS), [("crew_totals", CREW_TOTALS)])
    return q


# --- scans and lookups ------------------------------------------------------

USER_COLS = "CAST(coalesce(id_user, 0) AS BIGINT) AS id_user, coalesce(login, '') AS login, coalesce(password, '') AS password"
ROLE_COLS = "CAST(coalesce(id_role, 0) AS BIGINT) AS id_role, coalesce(role_name, '') AS role_name"
DRIVER_COLS = ("CAST(coalesce(id_driver, 0) AS BIGINT) AS id_driver, CAST(coalesce(id_user, 0) AS BIGINT) AS id_user, "
               "coalesce(last_name, '') AS last_name, coalesce(first_name, '') AS first_name, "
               "coalesce(middle_name, '') AS middle_name, CAST(coalesce(experience, 0) AS INTEGER) AS experience")
ROUTE_COLS = ("CAST(coalesce(id_route, 0) AS BIGINT) AS id_route, coalesce(route_name, '') AS route_name, "
              "coalesce(CAST(distance AS DOUBLE), 0.0) AS distance, coalesce(CAST(base_payment AS DOUBLE), 0.0) AS base_payment")
TRIP_COLS = ("CAST(coalesce(id_transportation, 0) AS BIGINT) AS id_transportation, "
             "CAST(coalesce(id_route, 0) AS BIGINT) AS id_route, departure_date, arrival_date")
ASSIGNMENT_COLS = ("CAST(coalesce(id_driver, 0) AS BIGINT) AS id_driver, "
                   "CAST(coalesce(id_transportation, 0) AS BIGINT) AS id_transportation, "
                   "CAST(coalesce(payment, 0) AS DOUBLE) AS payment, CAST(coalesce(bonus_amount, 0) AS DOUBLE) AS bonus_amount, "
                   "coalesce(bonus_reason, '') AS bonus_reason")


def _lookup(keys_sql: str, table: str, key: str, cols: str) -> str:
    return with_tables(f"""
        SELECT k.key, {cols}
        FROM (SELECT DISTINCT {keys_sql}) k LEFT JOIN {table} x ON k.key = x.{key}""")


def lookups() -> dict[str, str]:
    q: dict[str, str] = {}
    q["scan_users"] = with_tables(f"SELECT {USER_COLS} FROM users")
    q["scan_roles"] = with_tables(f"SELECT {ROLE_COLS} FROM roles")
    q["scan_drivers"] = with_tables(f"SELECT {DRIVER_COLS} FROM drivers")
    q["scan_routes"] = with_tables(f"SELECT {ROUTE_COLS} FROM routes")
    q["scan_transportations"] = with_tables(f"SELECT {TRIP_COLS} FROM transportations")
    q["lookup_drivers_by_id"] = _lookup("id_driver AS key FROM assignments", "drivers", "id_driver", DRIVER_COLS)
    q["lookup_drivers_by_user"] = with_tables(f"""
        SELECT k.key, {DRIVER_COLS}
        FROM (SELECT DISTINCT id_user AS key FROM users) k
        LEFT JOIN (SELECT * FROM drivers WHERE id_user IS NOT NULL
                   QUALIFY row_number() OVER (PARTITION BY id_user ORDER BY id_driver) = 1) x
          ON k.key = x.id_user""")
    q["lookup_routes_by_id"] = _lookup("id_route AS key FROM transportations", "routes", "id_route", ROUTE_COLS)
    q["lookup_transportations_by_id"] = _lookup(
        "id_transportation AS key FROM assignments", "transportations", "id_transportation", TRIP_COLS)
    q["trips_under_way"] = with_tables(f"SELECT {TRIP_COLS} FROM transportations WHERE arrival_date IS NULL")
    q["assignments_for_trips"] = with_tables(f"""
        SELECT {ASSIGNMENT_COLS} FROM assignments
        WHERE id_transportation IN (SELECT id_transportation FROM transportations WHERE arrival_date IS NULL)""")
    q["assignments_for_drivers"] = with_tables(f"""
        SELECT {ASSIGNMENT_COLS} FROM assignments
        WHERE id_driver IN (SELECT id_driver FROM drivers WHERE id_user IS NOT NULL)""")
    return q


# --- boards -----------------------------------------------------------------

def _available(current_id: int) -> str:
    return with_tables(f"""
        SELECT u.id_user, u.login FROM users u
        WHERE EXISTS (SELECT 1 FROM user_roles ur WHERE ur.id_user = u.id_user AND EXISTS (
                SELECT 1 FROM roles r WHERE r.id_role = ur.id_role AND r.role_name = 'Водитель'))
          AND (NOT EXISTS (SELECT 1 FROM drivers d WHERE d.id_user = u.id_user) OR u.id_user = {current_id})""")


def boards() -> dict[str, str]:
    fn = full_name()
    q: dict[str, str] = {}
    q["user_role_pairs"] = with_tables(
        "SELECT ur.id_user, r.role_name FROM user_roles ur JOIN roles r ON ur.id_role = r.id_role")
    revoked = [("granted", "SELECT * FROM user_roles WHERE id_user % 7 <> 0 OR id_user NOT IN (SELECT id_user FROM users)")]
    q["user_role_pairs_many"] = with_tables("""
        SELECT id_user, 'role ' || CAST((id_user * 4 + id_role) % 20000 + 1 AS VARCHAR) AS role_name FROM user_roles""")
    q["sign_in_check"] = with_tables(f"""
        SELECT a.attempt, CASE WHEN a.login <> '' AND a.password <> '' THEN k.id_user END AS id_user,
               CASE WHEN a.login = '' OR a.password = '' THEN 'empty_input' WHEN k.id_user IS NULL THEN 'unknown'
                    WHEN NOT EXISTS (SELECT 1 FROM granted g WHERE g.id_user = k.id_user) THEN 'no_role'
                    ELSE 'ok' END AS outcome
        FROM (SELECT id_user AS attempt,
                     CASE WHEN id_user % 13 = 0 THEN '' WHEN id_user % 11 = 0 THEN 'nobody' ELSE {trim('login')} END AS login,
                     CASE WHEN id_user % 5 = 0 THEN password || ' ' ELSE password END AS password FROM users) a
        LEFT JOIN (SELECT login, password, min(id_user) AS id_user FROM users GROUP BY login, password) k
          ON k.login = a.login AND k.password = a.password""", revoked)
    q["crew_rows"] = with_tables(f"""
        SELECT a.id_transportation, a.id_driver, coalesce({full_name('d')}, '') AS driver_name
        FROM assignments a LEFT JOIN drivers d ON a.id_driver = d.id_driver""")
    q["user_roles_list"] = with_tables("""
        SELECT u.id_user, u.login, coalesce(l.roles, '') AS roles FROM users u
        LEFT JOIN (SELECT ur.id_user, string_agg(r.role_name, ', ' ORDER BY r.role_name) AS roles
                   FROM granted ur JOIN roles r ON ur.id_role = r.id_role GROUP BY ur.id_user) l
          ON u.id_user = l.id_user""", revoked)
    q["users_without_roles"] = with_tables("""
        SELECT u.id_user, u.login FROM users u
        WHERE NOT EXISTS (SELECT 1 FROM granted ur WHERE ur.id_user = u.id_user)""", revoked)
    q["available_driver_users"] = _available(0)
    q["available_driver_users_current"] = _available(7)
    q["driver_roster"] = with_tables(f"""
        SELECT d.id_driver, {full_name('d')} AS full_name, d.experience,
               CASE WHEN d.id_user > 0 THEN CAST(d.id_user AS VARCHAR) ELSE 'Нет' END AS account_id,
               CASE WHEN d.id_user > 0 THEN coalesce(u.login, 'Нет') ELSE 'Нет' END AS account_login
        FROM drivers d LEFT JOIN users u ON d.id_user = u.id_user AND d.id_user > 0""")
    q["trip_board"] = with_tables(f"""
        SELECT t.id_transportation, coalesce(r.route_name, '') AS route_name,
               coalesce({date_text('t.departure_date')}, '') AS departure,
               {arrival_text('t.arrival_date')} AS arrival
        FROM transportations t LEFT JOIN routes r ON t.id_route = r.id_route""")
    q["route_list"] = with_tables(f"""
        SELECT id_route, coalesce(route_name, '') AS route_name,
               {money_text('distance')} AS distance, {money_text('base_payment')} AS base_payment
        FROM routes""")
    q["driver_trips"] = with_tables(f"""
        SELECT a.id_driver, a.id_transportation, coalesce(r.route_name, '') AS route_name,
               coalesce({date_text('t.departure_date')}, '') AS departure,
               {arrival_text('t.arrival_date')} AS arrival,
               {money_text('a.payment')} AS payment, {money_text('a.bonus_amount')} AS bonus_amount,
               coalesce(a.bonus_reason, '') AS bonus_reason
        FROM assignments a
        LEFT JOIN transportations t ON a.id_transportation = t.id_transportation
        LEFT JOIN routes r ON t.id_route = r.id_route""")
    q["trips_in_progress"] = with_tables(f"""
        SELECT t.id_transportation, coalesce(r.route_name, '') AS route_name,
               CASE WHEN t.id_transportation % 20 = 0 THEN '' ELSE coalesce({date_text('t.departure_date')}, '') END AS departure,
               coalesce(c.drivers, 'Не назначены') AS drivers
        FROM transportations t
        LEFT JOIN routes r ON t.id_route = r.id_route
        LEFT JOIN (SELECT a.id_transportation,
                          string_agg(coalesce({full_name('d')}, ''), ', ' ORDER BY coalesce({full_name('d')}, '')) AS drivers
                   FROM assignments a LEFT JOIN drivers d ON a.id_driver = d.id_driver
                   GROUP BY a.id_transportation) c ON t.id_transportation = c.id_transportation
        WHERE t.arrival_date IS NULL""")
    q["crew_roster"] = with_tables(f"""
        SELECT a.id_driver, coalesce({full_name('d')}, '') AS full_name, a.id_transportation,
               {money_text('a.payment')} AS payment,
               {money_text('a.bonus_amount')} || ' (' || coalesce(a.bonus_reason, '') || ')' AS bonus
        FROM assignments a LEFT JOIN drivers d ON a.id_driver = d.id_driver
        WHERE a.id_transportation IN (SELECT id_transportation FROM transportations)""")
    q["driver_labels"] = with_tables(f"""
        SELECT id_driver, {fn} || ' (стаж ' || CAST(coalesce(experience, 0) AS VARCHAR) || ' лет)' AS label
        FROM drivers""")
    q["trip_labels"] = with_tables("""
        SELECT t.id_transportation, 'Рейс ' || CAST(t.id_transportation AS VARCHAR) || ': ' || coalesce(r.route_name, '') AS label
        FROM transportations t LEFT JOIN routes r ON t.id_route = r.id_route""")
    return q


# --- pay and crew -----------------------------------------------------------

def multiplier_sql(exp: str) -> str:
    # Our default bands: <5 -> 1.00, 5..9 -> 1.10, >=10 -> 1.20.
    return (f"CAST(CASE WHEN {exp} < 5 THEN 1.00 WHEN {exp} >= 5 AND {exp} < 10 THEN 1.10 "
            f"WHEN {exp} >= 10 THEN 1.20 END AS DECIMAL(6,2))")


PRICED = f"""
    SELECT a.id_driver, a.id_transportation,
           CASE WHEN a.payment IS NULL OR a.payment < 0
                THEN CAST(round(CAST(r.base_payment AS DECIMAL(18,2)) * {multiplier_sql('d.experience')}, 2) AS DECIMAL(18,2))
                ELSE a.payment END AS payment,
           a.bonus_amount, a.bonus_reason, a.seq
    FROM assignments a
    LEFT JOIN transportations t ON a.id_transportation = t.id_transportation
    LEFT JOIN routes r ON t.id_route = r.id_route
    LEFT JOIN drivers d ON a.id_driver = d.id_driver"""

CREW_RANK = """
    SELECT *, row_number() OVER (PARTITION BY id_transportation
                                 ORDER BY seq ASC NULLS LAST, id_driver ASC NULLS LAST) AS rn
    FROM assignments"""


def pay() -> dict[str, str]:
    cols = "id_driver, id_transportation, payment, bonus_amount, bonus_reason, seq"
    q: dict[str, str] = {}
    q["price_assignments"] = with_tables(PRICED)
    q["pay_bands_by_driver"] = with_tables(
        f"SELECT id_driver, experience, {multiplier_sql('experience')} AS multiplier FROM drivers")
    q["pay_bands_many"] = with_tables("""
        SELECT d.id_driver, d.experience, CAST(1 + b.i / 1000.0 AS DECIMAL(6,2)) AS multiplier
        FROM drivers d LEFT JOIN (SELECT range AS i FROM range(5000)) b
          ON d.experience >= b.i - 2500 AND d.experience < b.i - 2499""")
    overlapping = [("bands", """
        SELECT i - 2500 AS lo, CASE WHEN (i - 2500) % 1000 = 999 THEN NULL WHEN (i - 2500) % 100 = 0 THEN i - 2490 ELSE i - 2499 END AS hi,
               CAST(1 + (i + 5) // 10 * 0.01 AS DECIMAL(6,2)) AS multiplier FROM (SELECT range AS i FROM range(5000))
        UNION SELECT i - 2500, i - 2499, CAST(1 + (i + 5) // 10 * 0.01 AS DECIMAL(6,2)) FROM (SELECT range AS i FROM range(5000))
        WHERE (i - 2500) % 50 = 7"""),
        ("judged", """SELECT *, coalesce(lo < max(coalesce(hi, 1000000000)) OVER (ORDER BY lo, coalesce(hi, 1000000000), multiplier
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS late FROM bands""")]
    q["pay_bands_rejected"] = with_tables("SELECT lo, hi, multiplier FROM judged WHERE late", overlapping)
    q["pay_bands_merged"] = with_tables("""
        SELECT d.id_driver, d.experience, b.multiplier FROM drivers d LEFT JOIN (SELECT * FROM judged WHERE NOT late) b
          ON d.experience >= b.lo AND (b.hi IS NULL OR d.experience < b.hi)""", overlapping)
    q["crew_limit_accept"] = with_tables(f"SELECT {cols} FROM ({CREW_RANK}) x WHERE rn <= 2")
    q["crew_limit_reject"] = with_tables(f"SELECT {cols} FROM ({CREW_RANK}) x WHERE rn > 2")
    q["crew_limit_overflow"] = with_tables("""
        SELECT id_transportation, count(*) AS crew_size FROM assignments
        GROUP BY id_transportation HAVING count(*) > 2""")
    return q


# --- derived inputs and quality ---------------------------------------------

def blank(x: str) -> str:
    return f"({trim(f"coalesce({x}, '')")} = '')"


DERIVED: dict[str, str] = {
    "dirty_routes": """
        SELECT id_route,
               CASE WHEN id_route % 50 = 0 THEN '' ELSE route_name END AS route_name,
               CASE WHEN id_route % 70 = 0 THEN CAST(0.5 AS DECIMAL(18,2)) ELSE distance END AS distance,
               CASE WHEN id_route % 90 = 0 THEN CAST(-1 AS DECIMAL(18,2)) ELSE base_payment END AS base_payment
        FROM routes""",
    "dirty_drivers": """
        SELECT id_driver, id_user,
               CASE WHEN id_driver % 10 = 0 THEN '' ELSE last_name END AS last_name,
               CASE WHEN id_driver % 8 = 0 THEN ' ' ELSE first_name END AS first_name, middle_name,
               CAST(CASE WHEN id_driver % 15 = 0 THEN 90 ELSE experience END AS INTEGER) AS experience
        FROM drivers""",
    "bonus_awards": """
        SELECT id_driver, id_transportation,
               CASE WHEN id_driver % 40 = 0 THEN CAST(600000 AS DECIMAL(18,2)) ELSE bonus_amount END AS bonus_amount,
               CASE WHEN id_transportation % 25 = 0 THEN '' ELSE bonus_reason END AS bonus_reason
        FROM assignments WHERE bonus_amount IS NOT NULL""",
    "registrations": """
        SELECT u.id_user, CASE WHEN u.id_user % 50 = 0 THEN '' ELSE u.login END AS login, u.password,
               coalesce(r.roles, CAST([] AS VARCHAR[])) AS roles,
               d.last_name, d.first_name, d.middle_name, d.experience
        FROM users u
        LEFT JOIN (SELECT ur.id_user, list(ro.role_name ORDER BY ro.role_name) AS roles
                   FROM user_roles ur JOIN roles ro ON ur.id_role = ro.id_role GROUP BY ur.id_user) r
          ON u.id_user = r.id_user
        LEFT JOIN (SELECT * FROM drivers WHERE id_user IS NOT NULL
                   QUALIFY row_number() OVER (PARTITION BY id_user ORDER BY id_driver) = 1) d
          ON u.id_user = d.id_user""",
    "o_users": "SELECT * FROM users WHERE id_user % 9 <> 0",
    "o_transportations": "SELECT * FROM transportations WHERE id_transportation % 100 <> 0",
    "o_roles": "SELECT * FROM roles WHERE id_role <> 4",
    "raw_assignments": """
        SELECT l_suppkey + 1 AS id_driver, l_orderkey + 1 AS id_transportation,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS payment, CAST(l_linenumber AS INTEGER) AS seq
        FROM lineitem""",
}


def derived(*names: str) -> list[tuple[str, str]]:
    return [(n, DERIVED[n]) for n in names]


def password_outcome(p: str) -> str:
    x = f"coalesce({p}, '')"
    # UTF-16 length: characters, plus one more for each outside the BMP.
    u16 = rf"(length({x}) + length(regexp_replace({x}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"
    return (f"CASE WHEN {u16} < 8 THEN 'too_short' "
            f"WHEN NOT regexp_matches({x}, '[0-9]') THEN 'no_digit' "
            f"WHEN NOT regexp_matches({x}, '[A-ZА-Я]') THEN 'no_upper' "
            rf"WHEN NOT regexp_matches({x}, '[^a-zA-Z0-9а-яА-Я\s]') THEN 'no_special' ELSE 'ok' END")


def _rules(table: str, keys: str, rules: list[tuple[str, str]]) -> str:
    return "\nUNION ALL\n".join(f"SELECT {keys}, '{name}' AS rule FROM {table} WHERE {cond}"
                                for name, cond in rules)


def _orphan(child: str, parent: str, fk: str, key_sql: str, col: str) -> str:
    return (f"SELECT '{fk}' AS fk, {key_sql} AS row_key, CAST(c.{col} AS BIGINT) AS missing_id FROM {child} c "
            f"WHERE c.{col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{col} = c.{col})")


def _dups(table: str, name: str, keys: list[str]) -> str:
    key = " || '/' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    group = ", ".join(keys)
    return (f"SELECT '{name}' AS table_name, {key} AS key, count(*) AS copies FROM {table} "
            f"GROUP BY {group} HAVING count(*) > 1")


def quality() -> dict[str, str]:
    q: dict[str, str] = {}
    audit = f"SELECT id_user, {password_outcome('password')} AS outcome FROM users"
    q["password_policy_audit"] = with_tables(audit)
    q["password_policy_summary"] = with_tables(f"SELECT outcome, count(*) AS users FROM ({audit}) a GROUP BY outcome")
    q["validate_drivers"] = with_tables(_rules("dirty_drivers", "id_driver", [
        *DRIVER_RULES,
        ("no_account", "(id_user IS NULL OR id_user <= 0)"),
    ]), derived("dirty_drivers"))
    q["validate_routes"] = with_tables(_rules("dirty_routes", "id_route", ROUTE_RULES), derived("dirty_routes"))
    q["validate_bonuses"] = with_tables(
        _rules("bonus_awards", "id_driver, id_transportation", BONUS_RULES), derived("bonus_awards"))
    has_pw = "(password IS NOT NULL AND password <> '')"
    q["validate_registrations"] = with_tables(_rules("registrations", "id_user", [
        ("login_empty", blank("login")),
        ("password_empty", f"NOT {has_pw}"),
        ("no_role", "len(roles) = 0"),
        ("driver_last_name_empty", f"list_contains(roles, 'Водитель') AND {blank('last_name')}"),
        ("driver_first_name_empty", f"list_contains(roles, 'Водитель') AND {blank('first_name')}"),
    ]) + f"""
        UNION ALL
        SELECT id_user, 'password_' || {password_outcome('password')} AS rule FROM registrations
        WHERE {has_pw} AND {password_outcome('password')} <> 'ok'""", derived("registrations"))
    ur_key = "CAST(c.id_user AS VARCHAR) || '/' || CAST(c.id_role AS VARCHAR)"
    pair = "CAST(c.id_driver AS VARCHAR) || '/' || CAST(c.id_transportation AS VARCHAR)"
    q["fk_orphans"] = with_tables("\nUNION ALL\n".join([
        _orphan("user_roles", "o_users", "user_roles.id_user", ur_key, "id_user"),
        _orphan("user_roles", "o_roles", "user_roles.id_role", ur_key, "id_role"),
        _orphan("drivers", "o_users", "drivers.id_user", "CAST(c.id_driver AS VARCHAR)", "id_user"),
        _orphan("o_transportations", "routes", "transportations.id_route",
                "CAST(c.id_transportation AS VARCHAR)", "id_route"),
        _orphan("assignments", "drivers", "assignments.id_driver", pair, "id_driver"),
        _orphan("assignments", "o_transportations", "assignments.id_transportation", pair, "id_transportation"),
    ]), derived("o_users", "o_transportations", "o_roles"))
    q["key_duplicates"] = with_tables("\nUNION ALL\n".join([
        *[_dups(f"(SELECT * FROM {t} UNION ALL SELECT * FROM {t} WHERE {keys[0]} % {n} = 0)", t, keys) for t, keys, n in (
            ("roles", ["id_role"], 2), ("users", ["id_user"], 50), ("user_roles", ["id_user", "id_role"], 50),
            ("drivers", ["id_driver"], 20), ("routes", ["id_route"], 50), ("transportations", ["id_transportation"], 500))],
        _dups("raw_assignments", "assignments", ["id_driver", "id_transportation"]),
    ]), derived("raw_assignments"))
    q["normalise_names"] = with_tables(
        "SELECT id_driver, last_name, first_name || ' x' AS first_name, middle_name FROM drivers")
    return q


# --- change batches ---------------------------------------------------------

DERIVED.update({
    # (text is written trimmed, as it is to be stored)
    "driver_changes": """
        SELECT id_driver, CASE WHEN id_driver % 20 = 0 THEN CAST(0 AS BIGINT) ELSE id_user END AS id_user, last_name,
               CASE WHEN id_driver % 10 = 0 THEN '' ELSE first_name END AS first_name, middle_name,
               CAST(CASE WHEN id_driver % 14 = 0 THEN 91 ELSE experience + 1 END AS INTEGER) AS experience,
               CASE WHEN id_driver % 6 <> 0 THEN id_driver END AS seq
        FROM drivers WHERE id_driver % 2 = 0
        UNION ALL
        SELECT id_driver, id_user, last_name, first_name, middle_name, 1, 0 FROM drivers WHERE id_driver % 12 = 0
        UNION ALL
        SELECT NULL, NULL, 'Н' || CAST(id_driver AS VARCHAR), 'Иван', NULL, 3,
               CASE WHEN id_driver % 15 <> 0 THEN id_driver + 1000000 END
        FROM drivers WHERE id_driver % 5 = 0""",
    "route_changes": """
        SELECT id_route, CASE WHEN id_route % 110 = 0 THEN '' ELSE upper(route_name) END AS route_name,
               CASE WHEN id_route % 70 = 0 THEN 0.50 ELSE distance END AS distance,
               CASE WHEN id_route % 90 = 0 THEN -1
                    ELSE CAST(round(base_payment * CAST(1.10 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) END AS base_payment,
               CASE WHEN id_route % 30 <> 0 THEN id_route * 2 END AS seq
        FROM routes WHERE id_route % 10 = 0
        UNION ALL
        SELECT CAST(NULL AS BIGINT), CASE WHEN id_route % 50 = 0 THEN '' ELSE route_name || ' 2' END, distance,
               base_payment, id_route * 2 + 1
        FROM routes WHERE id_route % 2 = 0""",
    "trip_changes": """
        SELECT id_transportation, id_route, departure_date, departure_date + to_days(2) AS arrival_date,
               id_transportation % 6 <> 0 AS completed, id_transportation AS seq
        FROM transportations WHERE arrival_date IS NULL AND id_transportation % 3 = 0
        UNION ALL
        SELECT NULL, id_route, departure_date, departure_date + to_days(2), id_transportation % 100 = 0,
               id_transportation + 1000000000 FROM transportations WHERE id_transportation % 50 = 0""",
    "password_changes": """
        SELECT id_user, 'Tmp#0000' AS password, id_user * 2 AS seq FROM users WHERE id_user % 10 = 0
        UNION ALL
        SELECT id_user, CASE WHEN id_user % 30 = 0 THEN 'weakpass' ELSE 'Pw#9' || login END, id_user * 2 + 1
        FROM users WHERE id_user % 10 = 0
        UNION ALL
        SELECT id_user, 'Null#9999', NULL FROM users WHERE id_user % 40 = 0""",
    "bonus_changes": """
        SELECT id_driver + n.far AS id_driver, id_transportation, CAST(n.amount AS DECIMAL(18,2)) AS bonus_amount,
               n.reason AS bonus_reason, CAST(CASE WHEN n.later IS NOT NULL THEN seq + n.later END AS BIGINT) AS seq
        FROM assignments JOIN (VALUES (10, 0, 1000.0, 'рейс', 0), (10, 1000000, 5.0, 'нет', 0), (30, 0, -5.0, 'x', 100),
                                      (70, 0, 600000.0, 'x', 200), (40, 0, 7.0, '', 300), (20, 0, 3.0, 'без номера', NULL))
                         n(every, far, amount, reason, later)
          ON id_transportation % 10 = 0 AND id_transportation % n.every = 0""",
    "existing": "SELECT * FROM assignments WHERE id_transportation % 2 = 1",
    "role_changes": """
        SELECT id_user, 'Механик' AS role_name FROM users WHERE id_user % 10 = 0
        UNION ALL SELECT id_user, 'Водитель' FROM users WHERE id_user % 20 = 0
        UNION ALL SELECT id_user, 'Оператор' FROM users WHERE id_user % 30 = 0""",
    "registration_batch": """
        SELECT u.id_user AS reg_seq, 'new_' || u.login AS login, u.password,
               CASE WHEN u.id_user % 30 = 0
                    THEN list_concat(coalesce(r.roles, CAST([] AS VARCHAR[])), ['Оператор'])
                    ELSE coalesce(r.roles, CAST([] AS VARCHAR[])) END AS roles,
               'Н' || CAST(u.id_user AS VARCHAR) AS last_name, 'Иван' AS first_name,
               CAST(NULL AS VARCHAR) AS middle_name, CAST(u.id_user % 40 AS INTEGER) AS experience
        FROM users u
        LEFT JOIN (SELECT ur.id_user, list(ro.role_name ORDER BY ro.role_name) AS roles
                   FROM user_roles ur JOIN roles ro ON ur.id_role = ro.id_role GROUP BY ur.id_user) r
          ON u.id_user = r.id_user
        WHERE u.id_user % 10 = 0""",
})

DRIVER_RULES = [("last_name_empty", blank("last_name")), ("first_name_empty", blank("first_name")),
                ("experience_range", "(experience IS NULL OR experience < 0 OR experience > 80)")]
ROUTE_RULES = [("name_empty", blank("route_name")),
               ("distance_range", "(distance IS NULL OR distance < 1 OR distance > 20000)"),
               ("base_payment_range", "(base_payment IS NULL OR base_payment < 0 OR base_payment > 1000000)")]
BONUS_RULES = [("bonus_range", "(bonus_amount IS NULL OR bonus_amount <= 0 OR bonus_amount > 500000)"),
               ("reason_empty", blank("bonus_reason"))]


def _good(table: str, rules: list[tuple[str, str]]) -> str:
    return f"SELECT * FROM {table} WHERE NOT (" + " OR ".join(cond for _, cond in rules) + ")"


def _latest(ch: str, keys: str) -> str:
    return f"(SELECT * FROM {ch} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY seq DESC NULLS LAST) = 1)"


def _upsert(table: str, ch: str, key: str, cols: list[str]) -> str:
    upd = ", ".join(f"CASE WHEN u.{key} IS NOT NULL THEN u.{c} ELSE t.{c} END AS {c}" for c in cols)
    plain = ", ".join(cols)
    order = ", ".join(f"{c} NULLS FIRST" for c in ["seq", *cols])
    return f"""
        SELECT t.{key}, {upd}
        FROM {table} t LEFT JOIN {_latest(f"(SELECT * FROM {ch} WHERE {key} IS NOT NULL)", key)} u
          ON t.{key} = u.{key}
        UNION ALL
        SELECT (SELECT coalesce(max({key}), 0) FROM {table}) + row_number() OVER (ORDER BY {order}) AS {key}, {plain}
        FROM {ch} WHERE {key} IS NULL"""


def _priced(source: str) -> str:
    return PRICED.replace("FROM assignments a", f"FROM {source} a")


ASSIGN = {
    "offered": """
        SELECT id_driver, id_transportation, CASE WHEN id_transportation % 18 = 0 THEN -1 ELSE payment END AS payment, seq
        FROM assignments
        UNION ALL SELECT id_driver + 1000000, id_transportation, payment, seq FROM assignments WHERE id_transportation % 50 = 0
        UNION ALL SELECT id_driver, id_transportation + 1000000000, payment, seq FROM assignments WHERE id_transportation % 70 = 0
        UNION ALL SELECT id_driver, id_transportation, 77, NULL FROM assignments WHERE id_transportation % 22 = 0""",
    "batch": """SELECT id_driver, id_transportation, payment, seq FROM offered
                QUALIFY row_number() OVER (PARTITION BY id_driver, id_transportation
                                           ORDER BY seq NULLS LAST, payment NULLS FIRST) = 1""",
    "fresh": """SELECT b.* FROM batch b WHERE NOT EXISTS (
                  SELECT 1 FROM existing e WHERE e.id_driver = b.id_driver AND e.id_transportation = b.id_transportation)""",
    "valid": """SELECT * FROM fresh WHERE id_driver IN (SELECT id_driver FROM drivers)
                AND id_transportation IN (SELECT id_transportation FROM transportations)""",
    "accepted": """
        SELECT v.id_driver, v.id_transportation, v.payment, CAST(NULL AS DECIMAL(18,2)) AS bonus_amount,
               CAST(NULL AS VARCHAR) AS bonus_reason, CAST(v.seq AS INTEGER) AS seq
        FROM (SELECT *, row_number() OVER (PARTITION BY id_transportation
                                           ORDER BY seq ASC NULLS LAST, id_driver ASC NULLS LAST) AS rn
              FROM valid) v
        LEFT JOIN (SELECT id_transportation, count(*) AS crew FROM existing GROUP BY id_transportation) c
          ON v.id_transportation = c.id_transportation
        WHERE v.rn + coalesce(c.crew, 0) <= 2""",
}

REGISTER = {
    "reg_as_user": "SELECT reg_seq AS id_user, login, password, roles, last_name, first_name, middle_name, experience FROM registration_batch",
    "rejected": None,  # filled below from the registration rules
    "ok_regs": "SELECT * FROM registration_batch WHERE reg_seq NOT IN (SELECT reg_seq FROM rejected)",
    "new_users": """SELECT (SELECT max(id_user) FROM users) + row_number() OVER (ORDER BY reg_seq) AS id_user, *
                    FROM ok_regs""",
}


#: The seven tables' columns in order.
SNAPSHOT = {
    "roles": "id_role role_name", "users": "id_user login password", "user_roles": "id_user id_role",
    "drivers": "id_driver id_user last_name first_name middle_name experience",
    "routes": "id_route route_name distance base_payment",
    "transportations": "id_transportation id_route departure_date arrival_date",
    "assignments": "id_driver id_transportation payment bonus_amount bonus_reason seq",
}


def _row_text(columns: str) -> str:
    kinds = {"distance": "DECIMAL(18,2)::VARCHAR", "base_payment": "DECIMAL(18,2)::VARCHAR",
             "payment": "DECIMAL(18,2)::VARCHAR", "bonus_amount": "DECIMAL(18,2)::VARCHAR"}
    return "concat_ws('|', " + ", ".join(f"coalesce({c}::{kinds.get(c, 'VARCHAR')}, '\\N')" for c in columns.split()) + ")"


def changes() -> dict[str, str]:
    q: dict[str, str] = {}
    q["upsert_drivers"] = with_tables(_upsert(
        "drivers", "dch", "id_driver", ["id_user", "last_name", "first_name", "middle_name", "experience"]),
        derived("driver_changes") + [("dch", f"""
            SELECT id_driver, CASE WHEN id_user > 0 THEN id_user END AS id_user, last_name, first_name,
                   middle_name, experience, seq FROM ({_good("driver_changes", DRIVER_RULES)}) g""")])
    q["upsert_drivers_rejected"] = with_tables(
        _rules("driver_changes", "id_driver, seq", DRIVER_RULES), derived("driver_changes"))
    q["upsert_routes_rejected"] = with_tables(
        _rules("route_changes", "id_route, seq", ROUTE_RULES), derived("route_changes"))
    q["set_bonuses_rejected"] = with_tables(
        _rules("bonus_changes", "id_driver, id_transportation, seq", BONUS_RULES), derived("bonus_changes"))
    q["update_user_passwords_rejected"] = with_tables(f"""
        SELECT id_user, seq, 'password_' || {password_outcome('password')} AS rule FROM password_changes
        WHERE {password_outcome('password')} <> 'ok'""", derived("password_changes"))
    q["upsert_routes"] = with_tables(_upsert(
        "routes", "rch", "id_route", ["route_name", "distance", "base_payment"]),
        derived("route_changes") + [("rch", _good("route_changes", ROUTE_RULES))])
    q["snapshot_sink"] = with_tables("\nUNION ALL\n".join(
        f"SELECT '{name}' AS table_name, count(*) AS n_rows, coalesce(sum(('0x' || substr(md5({_row_text(cols)}), 1, 8))::BIGINT), 0)::BIGINT "
        f"AS hash_sum FROM {'new_routes' if name == 'routes' else name}" for name, cols in SNAPSHOT.items()),
        derived("route_changes") + [("rch", _good("route_changes", ROUTE_RULES)), ("new_routes", _upsert(
            "routes", "rch", "id_route", ["route_name", "distance", "base_payment"]))])
    q["upsert_transportations"] = with_tables(_upsert(
        "transportations", "tch", "id_transportation", ["id_route", "departure_date", "arrival_date"]),
        derived("trip_changes") + [("tch", """
            SELECT id_transportation, id_route, departure_date,
                   CASE WHEN completed THEN arrival_date END AS arrival_date, seq FROM trip_changes""")])
    q["update_user_passwords"] = with_tables(f"""
        SELECT t.id_user, t.login, CASE WHEN u.id_user IS NOT NULL THEN u.password ELSE t.password END AS password
        FROM users t LEFT JOIN {_latest('pch', 'id_user')} u ON t.id_user = u.id_user""",
        derived("password_changes") + [
            ("pch", f"SELECT * FROM password_changes WHERE {password_outcome('password')} = 'ok'")])
    q["set_bonuses"] = with_tables(f"""
        SELECT t.id_driver, t.id_transportation, t.payment,
               CASE WHEN u.id_driver IS NOT NULL THEN u.bonus_amount ELSE t.bonus_amount END AS bonus_amount,
               CASE WHEN u.id_driver IS NOT NULL THEN u.bonus_reason ELSE t.bonus_reason END AS bonus_reason,
               t.seq
        FROM assignments t LEFT JOIN {_latest('bch', 'id_driver, id_transportation')} u
          ON t.id_driver = u.id_driver AND t.id_transportation = u.id_transportation""",
        derived("bonus_changes") + [("bch", _good("bonus_changes", BONUS_RULES))])
    assign_ctes = derived("existing") + list(ASSIGN.items())
    q["assign_drivers"] = with_tables(
        f"SELECT * FROM existing UNION ALL SELECT * FROM ({_priced('accepted')}) p", assign_ctes)
    q["assign_drivers_rejected"] = with_tables("""
        SELECT id_driver, id_transportation, reason FROM (
          SELECT b.id_driver, b.id_transportation,
                 CASE WHEN EXISTS (SELECT 1 FROM existing e WHERE e.id_driver = b.id_driver
                                                             AND e.id_transportation = b.id_transportation)
                        THEN 'duplicate'
                      WHEN b.id_driver NOT IN (SELECT id_driver FROM drivers) THEN 'unknown_driver'
                      WHEN b.id_transportation NOT IN (SELECT id_transportation FROM transportations)
                        THEN 'unknown_trip' END AS reason
          FROM batch b) x WHERE reason IS NOT NULL
        UNION ALL SELECT v.id_driver, v.id_transportation, 'crew_limit' FROM valid v WHERE NOT EXISTS (
          SELECT 1 FROM accepted a WHERE a.id_driver = v.id_driver AND a.id_transportation = v.id_transportation)""",
        assign_ctes)
    # registration: the form rules over the batch, keyed by reg_seq
    rules = quality()["validate_registrations"]
    rules_body = rules[rules.index("SELECT id_user, 'login_empty'"):]
    rejected = (f"SELECT id_user AS reg_seq, rule FROM ({rules_body.replace('FROM registrations', 'FROM reg_as_user')}) x "
                "UNION ALL SELECT reg_seq, 'unknown_role:' || role_name FROM "
                "(SELECT reg_seq, unnest(roles) AS role_name FROM registration_batch) r "
                "WHERE role_name NOT IN (SELECT role_name FROM roles)")
    reg = dict(REGISTER, rejected=rejected)
    reg_ctes = derived("registration_batch") + list(reg.items())
    q["register_users"] = with_tables(
        "SELECT id_user, login, password FROM users UNION ALL SELECT id_user, login, password FROM new_users", reg_ctes)
    q["register_users_roles"] = with_tables("""
        SELECT id_user, id_role FROM user_roles UNION ALL
        SELECT DISTINCT n.id_user, r.id_role FROM (SELECT id_user, unnest(roles) AS role_name FROM new_users) n
        JOIN roles r ON n.role_name = r.role_name""", reg_ctes)
    q["register_users_drivers"] = with_tables("""
        SELECT * FROM drivers UNION ALL
        SELECT (SELECT max(id_driver) FROM drivers) + row_number() OVER (ORDER BY reg_seq), id_user,
               last_name, first_name, middle_name, CAST(coalesce(experience, 0) AS INTEGER)
        FROM new_users WHERE list_contains(roles, 'Водитель')""", reg_ctes)
    q["register_users_rejected"] = with_tables("SELECT reg_seq, rule FROM rejected", reg_ctes)
    role_ctes = derived("role_changes") + [
        ("unknown", """SELECT b.id_user, b.role_name FROM role_changes b
                       WHERE NOT EXISTS (SELECT 1 FROM roles r WHERE r.role_name = b.role_name)"""),
        ("good_users", "SELECT DISTINCT id_user FROM role_changes WHERE id_user NOT IN (SELECT id_user FROM unknown)"),
        ("resolved", """SELECT DISTINCT b.id_user, r.id_role FROM role_changes b JOIN roles r ON b.role_name = r.role_name
                        WHERE b.id_user IN (SELECT id_user FROM good_users)"""),
    ]
    q["replace_user_roles"] = with_tables("""
        SELECT id_user, id_role FROM user_roles WHERE id_user NOT IN (SELECT id_user FROM good_users)
        UNION ALL SELECT id_user, id_role FROM resolved""", role_ctes)
    q["replace_user_roles_rejected"] = with_tables("SELECT id_user, role_name FROM unknown", role_ctes)
    q["resolve_role_names"] = with_tables("SELECT id_user, id_role FROM resolved", role_ctes)
    q["resolve_role_names_rejected"] = with_tables("SELECT id_user, role_name FROM unknown", role_ctes)
    q["remove_assignments"] = with_tables("""
        SELECT * FROM assignments a WHERE NOT EXISTS (
          SELECT 1 FROM (SELECT id_driver, id_transportation FROM assignments WHERE id_driver % 10 = 0) r
          WHERE r.id_driver = a.id_driver AND r.id_transportation = a.id_transportation)""")
    gone_users = "(SELECT id_user FROM users WHERE id_user % 25 = 0)"
    q["delete_users"] = with_tables(f"SELECT * FROM users WHERE id_user NOT IN {gone_users}")
    q["delete_users_roles"] = with_tables(f"SELECT * FROM user_roles WHERE id_user NOT IN {gone_users}")
    q["delete_users_drivers"] = with_tables(f"""
        SELECT id_driver, CASE WHEN id_user IN {gone_users} THEN NULL ELSE id_user END AS id_user,
               last_name, first_name, middle_name, experience FROM drivers""")
    gone_trips = "(SELECT id_transportation FROM transportations WHERE id_transportation % 25 = 0)"
    q["delete_transportations"] = with_tables(
        f"SELECT * FROM transportations WHERE id_transportation NOT IN {gone_trips}")
    q["delete_transportations_assignments"] = with_tables(
        f"SELECT * FROM assignments WHERE id_transportation NOT IN {gone_trips}")
    route_req = "(SELECT id_route FROM routes WHERE id_route % 25 = 0)"
    route_refused = f"(SELECT id_route FROM {route_req} k WHERE id_route IN (SELECT id_route FROM transportations))"
    q["delete_routes"] = with_tables(f"""
        SELECT * FROM routes WHERE id_route NOT IN
          (SELECT id_route FROM {route_req} k WHERE id_route NOT IN {route_refused})""")
    q["delete_routes_refused"] = with_tables(f"SELECT id_route FROM {route_refused} r")
    drv_req = "(SELECT id_driver FROM drivers WHERE id_driver % 25 = 0)"
    drv_refused = (f"(SELECT id_driver FROM {drv_req} k WHERE id_driver % 50 <> 0 "
                   "AND id_driver IN (SELECT id_driver FROM assignments))")
    q["delete_drivers"] = with_tables(f"""
        SELECT * FROM drivers WHERE id_driver NOT IN
          (SELECT id_driver FROM {drv_req} k WHERE id_driver NOT IN {drv_refused})""")
    q["delete_drivers_refused"] = with_tables(f"SELECT id_driver FROM {drv_refused} r")
    return q


# --- streams ----------------------------------------------------------------

def streams() -> dict[str, str]:
    q: dict[str, str] = {}
    q["stream_price_assignments"] = with_tables(PRICED)
    crew = [("stored", "SELECT * FROM assignments WHERE id_transportation % 5 = 0 AND seq = 1"),
            ("placed", """
        SELECT a.*, row_number() OVER (PARTITION BY a.id_transportation ORDER BY a.seq % 2 = 0, a.seq, a.id_driver)
                    + (SELECT count(*) FROM stored s WHERE s.id_transportation = a.id_transportation) AS place
        FROM assignments a WHERE NOT (a.id_transportation % 5 = 0 AND a.seq = 1)""")]
    cols = "id_driver, id_transportation, payment, bonus_amount, bonus_reason, seq"
    q["stream_crew_limit"] = with_tables(f"SELECT {cols} FROM placed WHERE place <= 2", crew)
    q["stream_crew_limit_rejected"] = with_tables(f"SELECT {cols} FROM placed WHERE place > 2", crew)
    after = derived("bonus_changes", "trip_changes") + [
        ("bch", _good("bonus_changes", BONUS_RULES)),
        ("bonused", f"""
        SELECT t.id_driver, t.id_transportation, t.payment,
               CASE WHEN u.id_driver IS NOT NULL THEN u.bonus_amount ELSE t.bonus_amount END AS bonus_amount
        FROM assignments t LEFT JOIN {_latest('bch', 'id_driver, id_transportation')} u
          ON t.id_driver = u.id_driver AND t.id_transportation = u.id_transportation"""),
        ("moved", """
        SELECT t.id_transportation, t.id_route, t.departure_date,
               CASE WHEN c.completed THEN c.arrival_date ELSE t.arrival_date END AS arrival_date
        FROM transportations t LEFT JOIN trip_changes c ON t.id_transportation = c.id_transportation""")]
    q["stream_refresh_reports"] = with_tables(SALARY_BODY, after + [("driver_totals", DRIVER_TOTALS.replace(
        "FROM assignments a", "FROM bonused a").replace("JOIN transportations t", "JOIN moved t"))])
    q["stream_refresh_summary"] = with_tables(SUMMARY_BODY.replace("FROM transportations t", "FROM moved t"), after + [
        ("crew_totals", CREW_TOTALS.replace("FROM assignments a", "FROM bonused a"))])
    return q


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    for part in (reports, lookups, boards, pay, quality, changes, streams):
        q.update(part())
    return q
