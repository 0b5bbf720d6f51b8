"""Streams: batch = stream, a restarted stream does no work twice, a replayed
or half-published micro-batch leaves the same tables."""
import glob
import os
import shutil
import subprocess
import sys
import textwrap

from haulage.operators import changes, pay, reports
from haulage.session import scratch_path
from haulage.sources import derived
from haulage.sources.testdata import load_tables
from haulage.streaming import buckets, ingest
from conftest import ROOT, SMALL_SF


def same(a, b):
    return a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_priced_stream_equals_batch(spark):
    t = load_tables(spark, SMALL_SF)
    assert same(ingest.stream_price_assignments(t, files_per_batch=3), pay.price_assignments(t))


def test_a_small_batch_reads_the_files_of_its_buckets(spark):
    t = load_tables(spark, SMALL_SF)
    base = scratch_path(spark, "prices-test")
    ingest.lay_out_prices(t, base, bucket_rows=20)
    todo = t.assignments.where("payment is null and id_driver is not null").orderBy("id_transportation").limit(2)
    few = buckets.of(todo, "id_transportation", f"{base}/trips")
    assert "PartitionFilters: []" not in few._jdf.queryExecution().executedPlan().toString()
    read = {r[0] for r in few.selectExpr("input_file_name()").distinct().collect()}
    assert len(read) <= 2 < len(glob.glob(f"{base.removeprefix('file:')}/trips/bucket=*"))
    want = pay.price_assignments(t).join(todo.select(*changes.PAIR), changes.PAIR, "left_semi")
    assert same(ingest.price_batch(todo, base), want)


def test_crew_stream_starts_from_the_stored_crew_and_a_restart_adds_nothing(spark):
    t = load_tables(spark, SMALL_SF)
    stored, deliveries = derived.crew_deliveries(t)
    base = scratch_path(spark, "crew-test")
    for delivery in [*deliveries, deliveries[0].limit(0)]:  # the last run finds no new rows
        feed = ingest.read_feed(spark, ingest.write_feed(delivery, f"{base}/feed"), t.assignments.schema)
        ingest.crew_limit_stream(stored, feed, f"{base}/sink", f"{base}/checkpoint")
        stored = stored.where("id_driver < 0")  # known to the state from the first run on
    stored = derived.crew_deliveries(t)[0]
    out = {v: ingest._batches(spark, f"{base}/sink/{v}", t.assignments.schema).drop("batch") for v in ("accepted", "rejected")}
    assert same(out["accepted"].unionByName(out["rejected"]).unionByName(stored), t.assignments)
    crews = out["accepted"].unionByName(stored).groupBy("id_transportation").count()
    over = crews.where("count > 2").select("id_transportation")  # stored so from the start
    assert out["accepted"].join(over, "id_transportation", "left_semi").count() == 0 and out["rejected"].count() > 0


def test_crew_stream_of_a_hot_trip_and_null_values(spark):
    from pyspark.sql import functions as F
    schema = load_tables(spark, SMALL_SF).assignments.schema
    base, empty = scratch_path(spark, "hot-test"), spark.createDataFrame([], schema)
    rows = [(i, 7, None, None, None, i) for i in range(100, 0, -1)] + [(None, 8, None, None, None, None), (3, 8, None, None, None, None)]
    rows += [(i, None, None, None, None, i) for i in (5, 4, 3)]
    for part in (rows[:60], rows[60:]):
        feed = ingest.read_feed(spark, ingest.write_feed(spark.createDataFrame(part, schema).repartition(4), f"{base}/feed"), schema)
        ingest.crew_limit_stream(empty, feed, f"{base}/sink", f"{base}/checkpoint")
    got = ingest._batches(spark, f"{base}/sink/accepted", schema).groupBy("id_transportation").agg(
        F.sort_array(F.collect_list(F.coalesce("id_driver", F.lit(-1)))).alias("x")).collect()
    assert {r[0]: r[1] for r in got} == {7: [41, 42], 8: [-1, 3], None: [3, 4]}
    assert ingest._batches(spark, f"{base}/sink/rejected", schema).count() == len(rows) - 6


def test_crew_batches_are_joins_and_a_replayed_one_gives_the_same_rows(spark):
    from pyspark.sql import functions as F
    from haulage.streaming import crew
    base = scratch_path(spark, "judge-test")
    schema = load_tables(spark, SMALL_SF).assignments.schema

    def rows(n, seq):
        trip = (F.col("id") / 3).cast("bigint")
        return spark.range(n).select(F.col("id").alias("id_driver"), trip.alias("id_transportation"), *[
            F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[2:5]], F.lit(seq).cast("int").alias("seq"))

    crew.store(rows(300, 0).where("id_driver % 3 = 0"), base, bucket_rows=20)  # one of the first 100 trips
    assert buckets.number(spark, f"{base}/stored") == 5
    for batch_id, part in enumerate([rows(600, 1).where("id_driver % 3 = 1"), rows(900, 2), rows(900, 3)]):
        judged = crew.judge(part, batch_id, base, 2)
        assert "WithState" not in judged._jdf.queryExecution().toString()
        want = {0: [200, 0], 1: [100 + 200, 600], 2: [0, 900]}[batch_id]
        for _ in range(2):
            got = crew.judge(part, batch_id, base, 2)
            assert got.where("accepted").count() == want[0] and got.where("not accepted").count() == want[1]
            crew.add(got.where("accepted"), batch_id, base)


def test_crew_stream_judges_a_batch_once_and_caches_nothing(spark, monkeypatch):
    """A cached table has a task for each shuffle partition, however few rows there are."""
    from haulage.streaming import crew
    t = load_tables(spark, SMALL_SF)
    stored, deliveries = derived.crew_deliveries(t)
    judged, judge = [], crew.judge
    monkeypatch.setattr(type(t.assignments), "persist", lambda *_: 1 / 0)
    monkeypatch.setattr(crew, "judge", lambda *args: judged.append(judge(*args)) or judged[-1])
    base = scratch_path(spark, "crew-once")
    for delivery in deliveries:
        feed = ingest.read_feed(spark, ingest.write_feed(delivery, f"{base}/feed"), t.assignments.schema)
        ingest.crew_limit_stream(stored, feed, f"{base}/sink", f"{base}/checkpoint")
    assert len(judged) == 2 and not glob.glob(f"{base.removeprefix('file:')}/sink/judged/*")
    out = [ingest._batches(spark, f"{base}/sink/{v}", t.assignments.schema).drop("batch") for v in ("accepted", "rejected")]
    assert same(out[0].unionByName(out[1]).unionByName(stored), t.assignments)


def after(t):
    """The tables with every change of the feed."""
    feed = derived.report_changes(t)
    trips = changes.apply_updates(
        t.transportations, feed[0].unionByName(feed[1]).where("id_driver is null"), ["id_transportation"], ["arrival_date"])
    return t.with_(assignments=changes.set_bonuses(t.assignments, derived.bonus_changes(t)), transportations=trips)


REPORTS = {"salary": reports.salary_statement, "summary": reports.transportation_summary}


def test_report_streams_equal_batch(spark):
    t = load_tables(spark, SMALL_SF)
    whole = derived.report_changes(t)
    parts = [whole[0], *(whole[1].where(f"id_transportation % 3 = {k}") for k in range(3))]
    assert sum(p.count() for p in parts) == sum(p.count() for p in whole) > 0
    for name, report in REPORTS.items():
        assert same(ingest.stream_refresh(t, parts, name, bucket_rows=800), report(after(t))), name
        assert not same(report(t), report(after(t)))


def test_report_tables_hold_the_assignments_once(spark):
    t = load_tables(spark, SMALL_SF)
    base = scratch_path(spark, "once-test")
    ingest.lay_out_reports(t, base, bucket_rows=800)
    n = t.assignments.count()
    assert [x for x in ingest.REPORT_TABLES if buckets.read(spark, f"{base}/{x}").count() >= n] == ["crews"]
    assert same(ingest.report(spark, base, "salary"), reports.salary_statement(t))


def test_replayed_and_half_published_batches_change_nothing(spark):
    t = load_tables(spark, SMALL_SF)
    base = scratch_path(spark, "replay-test")
    ingest.lay_out_reports(t, base, bucket_rows=800)
    deliveries = derived.report_changes(t)
    for batch_id, delivery in enumerate(deliveries):
        ingest.refresh_batch(spark, delivery, batch_id, base)
        ingest.refresh_batch(spark, delivery, batch_id, base)
    # a run that ended while it published: some partitions are gone, the stage is whole
    for name in ingest.REPORT_TABLES:
        shutil.rmtree(sorted(glob.glob(f"{base.removeprefix('file:')}/{name}/bucket=*"))[0])
    ingest.refresh_batch(spark, deliveries[-1].limit(0), len(deliveries) - 1, base)
    for name, report in REPORTS.items():
        assert same(ingest.report(spark, base, name), report(after(t))), name


RESTARTED = textwrap.dedent("""
    import sys
    sys.path.insert(0, %(root)r)
    from haulage.session import build_session
    from haulage.sources import derived
    from haulage.sources.testdata import load_tables
    from haulage.streaming import ingest
    spark = build_session(master="local[4]", shuffle_partitions=4, shared=%(base)r + "/scratch")
    t = load_tables(spark, %(sf)r)
    base, n = %(base)r, int(sys.argv[1])
    if n == 0:
        ingest.lay_out_reports(t, base + "/reports", bucket_rows=800)
    part = derived.report_changes(t)[n]
    ingest.refresh_reports(ingest.read_feed(spark, ingest.write_feed(part, base + "/feed"), part.schema), base + "/reports")
""")


def test_a_new_process_continues_the_reports(spark, tmp_path):
    script = RESTARTED % {"root": ROOT, "base": str(tmp_path), "sf": SMALL_SF}
    for n in ("0", "1"):
        out = subprocess.run([sys.executable, "-c", script, n], capture_output=True, text=True, timeout=600,
                             env=dict(os.environ, PYTHONPATH=ROOT))
        assert out.returncode == 0, out.stderr[-3000:]
    t = load_tables(spark, SMALL_SF)
    for name, report in REPORTS.items():
        assert same(ingest.report(spark, f"{tmp_path}/reports", name), report(after(t))), name
