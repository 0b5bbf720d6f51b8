from haulage.operators import boards, lookups
from conftest import D, TS


def test_roster_placeholders(make_tables):
    t = make_tables(
        users=[(1, "ivan", "x"), (2, "petr", "y")],
        drivers=[(1, None, "А", "Б", None, 3), (2, 999, "В", "Г", "Д", 4), (3, 2, "Е", "Ж", "З", 5)],
    )
    rows = {r.id_driver: r for r in boards.driver_roster(t).collect()}
    assert (rows[1].account_id, rows[1].account_login) == ("Нет", "Нет")
    assert (rows[2].account_id, rows[2].account_login) == ("999", "Нет")
    assert (rows[3].account_id, rows[3].account_login) == ("2", "petr")


def test_missing_route_and_no_crew(make_tables):
    t = make_tables(
        routes=[(1, "Москва", D(100), D(1000))],
        transportations=[(10, 999, TS("2024-01-02 15:04:00"), None), (11, 1, TS("2024-01-03 08:00:00"), None)],
        drivers=[(1, None, "Иванов", "Иван", None, 3), (2, None, "Петров", "Пётр", None, 5)],
        assignments=[(1, 11, None, None, None, 1), (2, 11, None, None, None, 2)],
    )
    rows = {r.id_transportation: r for r in boards.trips_in_progress(t).collect()}
    assert rows[10].route_name == "" and rows[10].drivers == "Не назначены"
    assert rows[10].departure == "02.01.2024 15:04"
    assert rows[11].drivers == "Иванов Иван, Петров Пётр"
    board = {r.id_transportation: r for r in boards.trip_board(t).collect()}
    assert board[10].route_name == "" and board[10].arrival == "В пути"
    labels = {r.id_transportation: r.label for r in boards.trip_labels(t).collect()}
    assert labels == {10: "Рейс 10: ", 11: "Рейс 11: Москва"}


def test_available_accounts_survive_null_accounts(make_tables):
    # A driver without an account (NULL id_user) must not empty the NOT IN set.
    t = make_tables(
        users=[(1, "a", "x"), (2, "b", "x"), (3, "c", "x")],
        user_roles=[(1, 3), (2, 3), (3, 1)],
        drivers=[(1, None, "А", "Б", None, 1), (2, 2, "В", "Г", None, 1)],
    )
    assert {r.id_user for r in boards.available_driver_users(t, 0).collect()} == {1}
    assert {r.id_user for r in boards.available_driver_users(t, 2).collect()} == {1, 2}


def test_user_role_list_and_users_without_roles(make_tables):
    t = make_tables(users=[(1, "a", "x"), (2, "b", "x")], user_roles=[(1, 3), (1, 1)])
    rows = {r.id_user: r.roles for r in boards.user_roles_list(t).collect()}
    assert rows == {1: "Администратор, Водитель", 2: ""}
    assert [r.id_user for r in boards.users_without_roles(t).collect()] == [2]


def test_lookup_defaults(make_tables, spark):
    t = make_tables(drivers=[(1, 5, "А", "Б", None, 3), (2, 5, "В", "Г", None, 4)])
    keys = spark.createDataFrame([(5,), (6,), (None,)], "id_user long")
    rows = {r.key: r for r in lookups.lookup_drivers_by_user(keys, t.drivers).collect()}
    assert rows[5].id_driver == 1  # lowest driver id of the account
    assert rows[6].id_driver == 0 and rows[6].last_name == "" and rows[6].middle_name == ""
    assert rows[None].id_driver == 0


def test_resolve_role_names_rejects_whole_user(make_tables, spark):
    t = make_tables()
    req = spark.createDataFrame([(1, "Водитель"), (1, "X"), (2, "Механик")], "id_user long, role_name string")
    resolved, unknown = boards.resolve_role_names(req, t.roles)
    assert [tuple(r) for r in resolved.collect()] == [(2, 4)]
    assert [tuple(r) for r in unknown.collect()] == [(1, "X")]
