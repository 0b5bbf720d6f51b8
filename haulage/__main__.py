"""Run a registered query from the command line.

    python -m haulage list
    python -m haulage salary_statement --sf /root/testdata/sf0.01 [--show 20]
    python -m haulage trip_board --snapshot PATH --out NEW_FOLDER
    python -m haulage upsert_routes --shared SCRATCH_FOLDER

``--sf`` reads the TPC-H-like test data through the adapter; ``--snapshot``
reads the seven tables from a stored snapshot. ``--out`` writes the result as
parquet to a new folder (it must not exist); otherwise rows are shown.
"""

from __future__ import annotations

import argparse
import sys


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="python -m haulage")
    ap.add_argument("query", help="registered query name, or 'list'")
    ap.add_argument("--sf", default="/root/testdata/sf0.01", help="test-data folder")
    ap.add_argument("--snapshot", help="stored snapshot folder (instead of --sf)")
    ap.add_argument("--out", help="write the result as parquet to this new folder")
    ap.add_argument("--shared", help="scratch folder that all executors share, unless spark.checkpoint.dir is set")
    ap.add_argument("--show", type=int, default=20, help="rows to show when not writing")
    a = ap.parse_args(argv)

    from haulage.plans import registry

    if a.query == "list":
        print("\n".join(sorted(registry.build())))
        return 0
    from haulage.session import build_session, release_scratch
    from haulage.sources.tables import read_snapshot

    spark = build_session(app_name=f"haulage-{a.query}", shared=a.shared)
    loader = (lambda s, _: read_snapshot(s, a.snapshot)) if a.snapshot else registry.load_tables
    queries = registry.build(loader)
    if a.query not in queries:
        print(f"unknown query {a.query!r}; try 'list'", file=sys.stderr)
        return 2
    df = queries[a.query](spark, a.sf)
    if a.out:
        df.write.mode("errorifexists").parquet(a.out)
    else:
        df.show(a.show, truncate=False)
    release_scratch(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
