"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Two measurements, one JSON line:
- ``queries`` (the headline ``value`` is their sum): each query end to end
  from the raw parquet tables, the adapter included, exactly as
  ``__spark_entry__.queries()`` runs it;
- ``snapshot_queries``: the same queries over the seven tables stored once
  as a parquet snapshot (``materialize_sec`` is that one-off write), the
  way a deployment keeps them.
Every query runs in full through the ``noop`` sink (nothing is collected to
the driver); the time is the median of $BENCH_RUNS runs after one warm-up
run of every query (code generation, file listing).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "salary_statement",
    "transportation_summary",
    "trips_in_progress",
    "driver_trips",
    "crew_roster",
    "price_assignments",
    "crew_limit_accept",
    "available_driver_users",
    "user_roles_list",
    "fk_orphans",
    "assign_drivers",
    "upsert_routes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from haulage.plans import registry
    import tempfile

    from haulage.session import build_session, release_scratch, scratch_path
    from haulage.sources.tables import read_snapshot, write_snapshot
    from haulage.sources.testdata import load_tables

    spark = build_session(app_name="haulage-bench", shared=tempfile.mkdtemp(prefix="haulage-bench-"))

    def timed(qs, name: str) -> float:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    def measure(qs) -> dict[str, float]:
        for name in HEADLINE:  # warm-up
            timed(qs, name)
        return {name: round(statistics.median(timed(qs, name) for _ in range(runs)), 3) for name in HEADLINE}

    raw = measure(registry.build())

    snap = scratch_path(spark, "bench-snapshot")
    t0 = time.perf_counter()
    write_snapshot(load_tables(spark, sf_dir), snap)
    materialize = round(time.perf_counter() - t0, 3)
    stored = measure(registry.build(lambda s, _: read_snapshot(s, snap)))

    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total_median_sec",
        "value": round(sum(raw.values()), 3),
        "unit": "sec",
        "queries": raw,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(os.environ.get("BENCH_CPUS", "8")),
        "runs": runs,
        "snapshot_total_sec": round(sum(stored.values()), 3),
        "snapshot_queries": stored,
        "materialize_sec": materialize,
    }))
    release_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
