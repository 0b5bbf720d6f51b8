from pyspark.sql import functions as F

from haulage.functions import text
from conftest import D, TS


def one(spark, expr, schema, row):
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first()["x"]


def test_full_name_keeps_inner_spaces_and_trims_ends(spark):
    s = "last_name string, first_name string, middle_name string"
    assert one(spark, text.full_name(), s, ("Иванов", "", "Петрович")) == "Иванов  Петрович"
    assert one(spark, text.full_name(), s, ("Иванов", "Иван", None)) == "Иванов Иван"
    assert one(spark, text.full_name(), s, (None, None, None)) == ""


def test_unicode_trim_drops_tabs_and_no_break_spaces(spark):
    s = "x string"
    assert one(spark, text.unicode_trim("x"), s, ("\t  Петров 　",)) == "Петров"
    assert one(spark, text.unicode_trim("x"), s, ("\t ",)) == ""
    assert one(spark, text.unicode_trim("x"), s, ("a  b",)) == "a  b"


def test_date_text_is_24_hour(spark):
    assert one(spark, text.date_text("t"), "t timestamp_ntz", (TS("2024-01-02 15:04:00"),)) == "02.01.2024 15:04"


def test_arrival_text_placeholder(spark):
    assert one(spark, text.arrival_text("t"), "t timestamp_ntz", (None,)) == "В пути"


def test_money_and_bonus_text(spark):
    s = "a decimal(18,2), r string"
    assert one(spark, text.money_text("a"), s, (D(1234.5), None)) == "1234.50"
    assert one(spark, text.money_text("a"), s, (None, None)) == "0.00"
    assert one(spark, text.bonus_text("a", "r"), s, (None, None)) == "0.00 ()"
    assert one(spark, text.bonus_text("a", "r"), s, (D(10), "A")) == "10.00 (A)"


def test_account_text(spark):
    s = "u long"
    assert one(spark, text.account_text("u"), s, (None,)) == "Нет"
    assert one(spark, text.account_text("u"), s, (0,)) == "Нет"
    assert one(spark, text.account_text("u"), s, (999,)) == "999"


def test_labels(spark):
    s = "n string, e int"
    assert one(spark, text.driver_label(F.col("n"), "e"), s, ("Иванов Иван", 7)) == "Иванов Иван (стаж 7 лет)"
    assert one(spark, text.trip_label("i", "r"), "i long, r string", (5, None)) == "Рейс 5: "
