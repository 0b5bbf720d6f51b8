"""haulage — freight payroll and trip analytics as Spark DataFrame operators.

Seven tables (users, roles, user_roles, drivers, routes, transportations,
assignments) held as DataFrames; every operator is a pure function from
DataFrames to DataFrames that Catalyst plans. See README.md for the map.
"""

from haulage.sources.tables import Tables

__all__ = ["Tables"]
