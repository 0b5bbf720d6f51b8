"""Column expressions for names, dates, money and placeholders.

All are built-in Spark expressions (JVM side, inside whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulage.schemas import MONEY

# Texts shown by the reference screens.
IN_TRANSIT = "В пути"          # arrival of a trip under way
NO_ACCOUNT = "Нет"             # driver without a user account
NO_CREW = "Не назначены"       # trip without assigned drivers
DRIVER_LABEL = "{name} (стаж {years} лет)"
TRIP_LABEL = "Рейс {id}: {route}"
# Qt "dd.MM.yyyy hh:mm" without AM/PM is 24-hour; Spark's "hh" is 12-hour.
DATE_PATTERN = "dd.MM.yyyy HH:mm"

# Leading or trailing Unicode white space (what a Qt string's trimmed() drops).
_EDGE_SPACE = r"(?U)^\s+|\s+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unicode_trim(x) -> Column:
    """Drop white space of any kind at both ends; inner spaces stay."""
    return F.regexp_replace(_c(x), _EDGE_SPACE, "")


def full_name(last="last_name", first="first_name", middle="middle_name") -> Column:
    """"last first middle" with the ends trimmed; NULL parts read as ''.

    Not ``concat_ws``: an empty first name keeps its two spaces inside.
    """
    joined = F.concat(F.coalesce(_c(last), F.lit("")), F.lit(" "),
                      F.coalesce(_c(first), F.lit("")), F.lit(" "),
                      F.coalesce(_c(middle), F.lit("")))
    return unicode_trim(joined)


def money(x) -> Column:
    """Decimal(18,2) view of a money value."""
    return _c(x).cast(MONEY)


def money_text(x) -> Column:
    """Two decimals, no grouping; NULL reads as 0.00."""
    return F.coalesce(money(x), F.lit(0).cast(MONEY)).cast("string")


def date_text(x) -> Column:
    return F.date_format(_c(x), DATE_PATTERN)


def arrival_text(x="arrival_date") -> Column:
    return F.coalesce(date_text(x), F.lit(IN_TRANSIT))


def bonus_text(amount="bonus_amount", reason="bonus_reason") -> Column:
    """"amount (reason)", e.g. '0.00 ()' for neither."""
    return F.concat(money_text(amount), F.lit(" ("), F.coalesce(_c(reason), F.lit("")), F.lit(")"))


def account_text(id_user="id_user") -> Column:
    """Account id as text, or the placeholder for none (NULL or <= 0)."""
    c = _c(id_user)
    return F.when(c > 0, c.cast("string")).otherwise(F.lit(NO_ACCOUNT))


def driver_label(name: Column, experience="experience") -> Column:
    return F.concat(name, F.lit(" (стаж "), F.coalesce(_c(experience), F.lit(0)).cast("string"),
                    F.lit(" лет)"))


def trip_label(id_transportation="id_transportation", route_name="route_name") -> Column:
    return F.concat(F.lit("Рейс "), _c(id_transportation).cast("string"), F.lit(": "),
                    F.coalesce(_c(route_name), F.lit("")))


def sorted_list(x, sep: str = ", ") -> Column:
    """Aggregate: the non-NULL values of a group joined by ``sep`` in binary
    order; NULL for a group without any.

    ``collect_list`` + ``array_sort`` + ``array_join``: partial + final
    aggregation, measured faster here than ``listagg ... WITHIN GROUP``
    (which sorts inside the aggregation buffer). The list is the output
    itself, so its size is that of the group (bounded by the crew rule).
    """
    c = F.col(x) if isinstance(x, str) else x
    items = F.array_sort(F.collect_list(c))
    return F.when(F.size(items) > 0, F.array_join(items, sep))
