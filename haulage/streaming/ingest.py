"""Structured Streaming forms of the reference's per-insert triggers and its
polled report refresh (SURVEY #51-53).

All three read a file stream (parquet, fixed schema) and keep their
checkpoints, tables and sinks under the session's shared checkpoint folder, so a
restarted query, in the same process or a new one, goes on from there. Every
micro-batch can be replayed without changing a result:

- ``price_stream`` (#51) joins a micro-batch with the trips' and drivers'
  prices, tables partitioned by a bucket of their key (``buckets.py``): it
  reads the buckets that its keys are in.
- ``crew_limit_stream`` (#52) keeps the crew of each trip as counts by bucket,
  which start from the stored crews; a micro-batch adds those it accepted.
- ``refresh_reports`` (#53) keeps both reports as partitioned tables. A
  micro-batch recomputes the partitions that its changes touch and overwrites
  those alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.operators import changes, pay, reports
from haulage.operators.changes import PAIR
from haulage.session import exists, materialize, remove, scratch_path
from haulage.sources.tables import Tables
from haulage.streaming import buckets, crew


def write_feed(df: DataFrame, path: str) -> str:
    """Land a delivery: append ``df`` to the folder a file stream reads, with
    the partitions it has. Test and bench glue only; in production the feed
    lands by itself."""
    df.write.mode("append").parquet(path)
    return path


def read_feed(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A file stream; without ``files_per_batch`` a trigger takes all that
    has landed."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def _run(writer) -> None:
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def _batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """Every ``path/batch=<id>`` folder read as one table (``batch`` kept)."""
    schema = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*")


# --- #51 --------------------------------------------------------------------

def lay_out_prices(t: Tables, base: str, bucket_rows: int = buckets.BUCKET_ROWS) -> None:
    """What pricing needs, by bucket: each trip's base payment and each
    driver's experience."""
    routes = t.routes.select("id_route", "base_payment")
    trips = changes.left_join(t.transportations.select("id_transportation", "id_route"), routes, "id_route",
                              "id_transportation")
    buckets.write(trips.select("id_transportation", "base_payment"), "id_transportation", f"{base}/trips", bucket_rows)
    buckets.write(t.drivers.select("id_driver", "experience"), "id_driver", f"{base}/drivers", bucket_rows)


def price_batch(batch: DataFrame, base: str, bands=pay.DEFAULT_BANDS) -> DataFrame:
    """The rows of a batch with every missing payment computed (#34)."""
    todo = batch.where(pay.needs_pricing(F.col("payment")))
    rows = batch
    for name, key in (("trips", "id_transportation"), ("drivers", "id_driver")):
        rows = rows.join(buckets.of(todo, key, f"{base}/{name}").drop("bucket"), key, "left")
    computed = pay.computed_pay(F.col("base_payment"), F.col("experience"), bands)
    given = F.when(pay.needs_pricing(F.col("payment")), computed).otherwise(F.col("payment"))
    return rows.withColumn("payment", given).select(*batch.columns)


def price_stream(base: str, feed: DataFrame, sink: str, checkpoint: str) -> None:
    """Price every streamed assignment over ``lay_out_prices``' tables; rows
    land in ``sink/batch=<id>``."""
    def each(batch: DataFrame, batch_id: int) -> None:
        price_batch(batch, base).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    _run(feed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint))


def stream_price_assignments(t: Tables, files_per_batch: int | None = None) -> DataFrame:
    spark = t.assignments.sparkSession
    base = scratch_path(spark, "price")
    lay_out_prices(t, f"{base}/prices")
    feed_dir = write_feed(t.assignments, f"{base}/feed")
    feed = read_feed(spark, feed_dir, t.assignments.schema, files_per_batch)
    price_stream(f"{base}/prices", feed, f"{base}/sink", f"{base}/checkpoint")
    return _batches(spark, f"{base}/sink", t.assignments.schema).drop("batch")


# --- #52 --------------------------------------------------------------------

def crew_limit_stream(existing: DataFrame, feed: DataFrame, sink: str, checkpoint: str,
                      limit: int = pay.DEFAULT_CREW_LIMIT) -> None:
    """Accept at most ``limit`` drivers per trip over the stored assignments
    ``existing`` and the whole stream, earlier micro-batches first and by
    ``seq`` and driver inside one. Rows land in ``sink/accepted/batch=<id>`` or
    ``sink/rejected/batch=<id>``. ``existing`` is read by the first micro-batch
    of a checkpoint alone."""
    def each(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            crew.store(existing, f"{sink}/crews")
        # judged once for both sinks; a cached table would keep every shuffle partition as a task of its own
        judged, verdicts = f"{sink}/judged/{batch_id}", crew.judge(batch, batch_id, f"{sink}/crews", limit)
        verdicts.write.mode("overwrite").partitionBy("accepted").parquet(judged)
        judged_rows = batch.sparkSession.read.schema(verdicts.schema).parquet(judged)
        accepted = judged_rows.where("accepted")
        for verdict, rows in (("accepted", accepted), ("rejected", judged_rows.where("not accepted"))):
            rows.select(*feed.columns).write.mode("overwrite").parquet(f"{sink}/{verdict}/batch={batch_id}")
        crew.add(accepted, batch_id, f"{sink}/crews")
        remove(judged)

    _run(feed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint))


def stream_crew_limit(t: Tables, deliveries: list[DataFrame], existing: DataFrame, verdict: str = "accepted") -> DataFrame:
    """The accepted (or rejected) rows after streaming each delivery; the
    query is started anew for each, from its checkpoint."""
    spark = t.assignments.sparkSession
    base, schema = scratch_path(spark, "crew"), t.assignments.schema
    for delivery in deliveries:
        feed = read_feed(spark, write_feed(delivery, f"{base}/feed"), schema)
        crew_limit_stream(existing, feed, f"{base}/sink", f"{base}/checkpoint")
    return _batches(spark, f"{base}/sink/{verdict}", schema).drop("batch")


# --- #53 --------------------------------------------------------------------

#: The tables of a refreshed pair of reports and the key that buckets each:
#: the assignments (``crews``) and arrivals (``trips``) behind them, and the
#: reports. Arrivals carry the order of their last change, and a driver's row the
#: exact sums that a micro-batch adds its differences to.
#: Tables of one key have the same buckets, so that a report's partition needs
#: one partition of the assignments.
REPORT_TABLES = {"crews": "id_transportation", "trips": "id_transportation", "salary": "id_driver", "summary": "id_transportation"}
_ORDER = "struct<known: boolean, seq: bigint, batch: bigint>"
_SUMS = ("pay", "bonus")


def lay_out_reports(t: Tables, base: str, bucket_rows: int = buckets.BUCKET_ROWS) -> None:
    """Both reports of ``t`` and the assignments behind them, by bucket. Done
    once; a stream is then continued by any process. Assignments and trips are
    written first, as all four tables are made of them."""
    t = t.with_(assignments=materialize(t.assignments, "report-assignments"),
                transportations=materialize(t.transportations, "report-trips"))
    unset = F.lit(None).cast(_ORDER)
    totals = reports.driver_totals(t.assignments, t.transportations).withColumns({f"sum_{c}": F.col(c) for c in _SUMS})
    tables = {"crews": t.assignments.select(*PAIR, "payment", "bonus_amount", unset.alias("bonus_order")),
              "trips": t.transportations.select("id_transportation", "arrival_date", unset.alias("arrival_order")),
              "salary": reports.salary_rows(t.drivers, totals),
              "summary": reports.transportation_summary(t).withColumn("arrival_order", unset)}
    n = buckets.count_for(t.assignments, bucket_rows)
    for name, key in REPORT_TABLES.items():
        buckets.write(tables[name], key, f"{base}/{name}", n=n)


def _newer(rows: DataFrame, latest: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    """``rows`` with ``column`` changed where a change is not older than the
    last one: by seq (one without is older than any), then by micro-batch."""
    new = latest.select(*keys, F.col(column).alias("_new"), F.col("_order"))
    hit = F.col("_order").isNotNull() & (F.col(order).isNull() | (F.col("_order") >= F.col(order)))
    joined = rows.join(new, keys, "left").withColumn("_hit", hit)
    changed = {column: F.col("_new"), order: F.col("_order")}
    return joined.select(*[F.when(F.col("_hit"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
                           for c in rows.columns])


def _stage_changed(spark: SparkSession, batch: DataFrame, batch_id: int, base: str, stage: str) -> None:
    """Write every table's touched partitions, whole, after the batch's changes.
    A trip's sums are taken from the staged assignments; a driver's are those
    it had and the difference that the touched trips make, in exact decimals."""
    known, seq = F.col("seq").isNotNull(), F.coalesce("seq", F.lit(0)).cast("bigint")
    order = F.struct(known.alias("known"), seq.alias("seq"), F.lit(batch_id).cast("bigint").alias("batch")).alias("_order")

    def latest(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
        return changes.latest_per_key(rows.select(*keys, column, "seq"), keys).select(*keys, column, order)

    bonus = latest(changes.valid_bonuses(batch.where("id_driver is not null")), PAIR, "bonus_amount")
    moved = latest(batch.where("id_driver is null"), ["id_transportation"], "arrival_date")
    trips = bonus.select("id_transportation").unionByName(moved.select("id_transportation")).distinct()

    def read(name: str, keys: DataFrame) -> DataFrame:
        return buckets.of(keys, REPORT_TABLES[name], f"{base}/{name}")

    def staged(name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{stage}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{stage}/{name}")

    def changed(name: str, latest: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
        """A table's touched partitions after the changes, and ``was``, the value before."""
        return staged(name, _newer(read(name, trips).withColumn("was", F.col(column)), latest, keys, column, order))

    crews = changed("crews", bonus, PAIR, "bonus_amount", "bonus_order")
    arrivals = changed("trips", moved, ["id_transportation"], "arrival_date", "arrival_order")
    summary = _newer(read("summary", trips), moved, ["id_transportation"], "arrival_date", "arrival_order")
    staged("summary", reports.with_costs(summary, reports.totals_by_trip(crews)).select(*summary.columns))

    # the touched trips' assignments as they are and as they were
    status = arrivals.join(trips, "id_transportation", "left_semi").select(
        "id_transportation", F.col("arrival_date").isNull().alias("under_way"), F.col("was").isNull().alias("was_under_way"))
    work = staged("work", crews.join(trips, "id_transportation", "left_semi").join(status, "id_transportation", "left").select(
        "id_driver", "payment", "bonus_amount", "under_way", "was", "was_under_way"))
    before = reports.totals_by_driver(work.select("id_driver", "payment", F.col("was").alias("bonus_amount"),
                                                  F.col("was_under_way").alias("under_way")))
    salary = read("salary", work.select("id_driver").distinct())
    sums = ["completed_trips", "trips_in_progress", *_SUMS]
    kept = salary.select("id_driver", *sums[:2], *[F.coalesce(f"sum_{c}", F.lit(0)).alias(c) for c in _SUMS])
    parts = kept.dropDuplicates(["id_driver"]).unionByName(reports.totals_by_driver(work)).unionByName(
        before.select("id_driver", *[(-F.col(c)).alias(c) for c in sums]))
    totals = parts.groupBy("id_driver").agg(*[F.sum(c).alias(c) for c in sums])
    totals = totals.withColumns({f"sum_{c}": F.col(c).cast(salary.schema[f"sum_{c}"].dataType) for c in _SUMS})
    staged("salary", reports.with_salary(salary.drop(*[f"sum_{c}" for c in _SUMS]), totals).select(*salary.columns))


def refresh_batch(spark: SparkSession, batch: DataFrame, batch_id: int, base: str) -> None:
    """Bring the reports up to date with a micro-batch of changes.

    The feed has id_driver, id_transportation, bonus_amount, bonus_reason,
    arrival_date, seq. A row with a driver changes that assignment's bonus (if
    the bonus form's rules let it); a row without one sets the trip's arrival
    (NULL: under way). The highest ``seq`` of a key wins.

    The touched partitions are staged first, under the batch's id, and then
    overwrite the tables' ones (dynamic partition overwrite). A replay that
    finds them staged publishes them again, so a run that was ended between
    two partitions leaves nothing half done.
    """
    stage = f"{base}/stage/{batch_id}"
    if not exists(f"{stage}/done/_SUCCESS"):
        batch.persist()
        try:
            _stage_changed(spark, batch, batch_id, base, stage)
        finally:
            batch.unpersist()
        spark.range(1).write.mode("overwrite").parquet(f"{stage}/done")
    for name in REPORT_TABLES:
        buckets.overwrite(spark.read.schema(buckets.schema(spark, f"{base}/{name}")).parquet(f"{stage}/{name}"), f"{base}/{name}")
    remove(f"{base}/stage/{batch_id - 1}")


def refresh_reports(feed: DataFrame, base: str) -> None:
    """Run the stream of changes over the tables of ``lay_out_reports``."""
    spark = feed.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        refresh_batch(spark, batch, batch_id, base)

    _run(feed.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/checkpoint"))


def report(spark: SparkSession, base: str, name: str) -> DataFrame:
    """'salary' or 'summary', as of the last micro-batch."""
    return buckets.read(spark, f"{base}/{name}").drop("bucket", "arrival_order", *[f"sum_{c}" for c in _SUMS])


def stream_refresh(t: Tables, deliveries: list[DataFrame], name: str, bucket_rows: int = buckets.BUCKET_ROWS) -> DataFrame:
    """A report after streaming each delivery of changes."""
    spark = t.assignments.sparkSession
    base = scratch_path(spark, "reports")
    lay_out_reports(t, base, bucket_rows)
    for delivery in deliveries:
        refresh_reports(read_feed(spark, write_feed(delivery, f"{base}/feed"), delivery.schema), base)
    return report(spark, base, name)
