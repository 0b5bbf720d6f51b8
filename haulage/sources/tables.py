"""The seven tables as one value, and the snapshot source/sink.

A snapshot is a folder with one Parquet directory per table. Writes always go
to a new folder (never over the one being read), so a failed job leaves the
previous snapshot whole and a retried task rewrites only its own files. A
manifest written last says what was published, and a reader can verify it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage import schemas

TABLE_NAMES = ("roles", "users", "user_roles", "drivers", "routes", "transportations", "assignments")


class Tables:
    """The seven tables. Each is given as a DataFrame or as a zero-argument
    function returning one; a function is called on first use only, so a
    query pays (in plan building) only for the tables it touches."""

    __slots__ = ("_sources", "_built")

    def __init__(self, **tables):
        unknown = set(tables) - set(TABLE_NAMES)
        missing = set(TABLE_NAMES) - set(tables)
        if unknown or missing:
            raise TypeError(f"Tables needs exactly {TABLE_NAMES}; unknown {unknown}, missing {missing}")
        object.__setattr__(self, "_sources", dict(tables))
        object.__setattr__(self, "_built", {})

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        built = self._built
        if name not in built:
            src = self._sources[name]
            built[name] = src if isinstance(src, DataFrame) else src()
        return built[name]

    def __setattr__(self, name, value):
        raise AttributeError("Tables is immutable; use with_()")

    def with_(self, **changed) -> "Tables":
        sources = {n: (self._built[n] if n in self._built else self._sources[n]) for n in TABLE_NAMES}
        sources.update(changed)
        return Tables(**sources)

    def items(self):
        return [(n, getattr(self, n)) for n in TABLE_NAMES]


def _row_text(df: DataFrame):
    """A row as text: its columns in order, NULL as \\N, with | between."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns])


def table_sums(tables: "Tables", names: tuple[str, ...] = TABLE_NAMES) -> DataFrame:
    """table_name, n_rows and hash_sum (the sum over rows of 32 bits of the MD5
    of the row's text) of each table: equal for equal rows in any order."""
    def sums(name: str) -> DataFrame:
        df = getattr(tables, name)
        h = F.conv(F.substring(F.md5(_row_text(df).cast("binary")), 1, 8), 16, 10).cast("bigint")
        return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).alias("hash_sum")).select(
            F.lit(name).alias("table_name"), "n_rows", "hash_sum")

    return reduce(DataFrame.unionByName, map(sums, names))


def read_snapshot(spark: SparkSession, path: str, verify: bool = False) -> Tables:
    """Read a snapshot written by ``write_snapshot`` (fixed schemas, no
    inference). With ``verify``, every table is read and compared with the
    manifest first; without, a published snapshot is told by its manifest,
    which is written last."""
    base = path.rstrip("/")
    found = Tables(**{
        name: (lambda n=name: spark.read.schema(schemas.ALL[n]).parquet(f"{base}/{n}"))
        for name in TABLE_NAMES
    })
    if verify:
        manifest = spark.read.schema(_MANIFEST).parquet(f"{base}/{MANIFEST}")
        names = tuple(r[0] for r in manifest.select("table_name").collect())  # seven at most
        wrong = manifest.exceptAll(table_sums(found, names)).select("table_name").collect()
        if wrong or not names:
            raise ValueError(f"{path} does not hold what was published: {sorted(r[0] for r in wrong) or 'no table'}")
    return found


MANIFEST = "manifest"
_MANIFEST = "table_name string, n_rows bigint, hash_sum bigint"


def write_snapshot(tables: Tables, path: str, only: tuple[str, ...] | None = None) -> str:
    """Write every table (or ``only`` some) under ``path``; returns ``path``.

    ``path`` must be a new folder on shared storage; each table is written by
    its own job with the partitioning it already has. The manifest, rows and hash
    sum of each table as they lie there, is written last: a snapshot without one
    is not published.
    """
    base, names = path.rstrip("/"), tuple(n for n in TABLE_NAMES if only is None or n in only)
    for name in names:
        getattr(tables, name).write.mode("errorifexists").parquet(f"{base}/{name}")
    sums = table_sums(read_snapshot(tables.roles.sparkSession, path), names)
    sums.coalesce(1).write.mode("errorifexists").parquet(f"{base}/{MANIFEST}")
    return path
