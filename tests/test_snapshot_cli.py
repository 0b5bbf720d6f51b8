"""Snapshot round trip (the bench's stored mode) and the command line."""
import os
import subprocess
import sys

from haulage.operators import reports
from haulage.session import scratch_path
from haulage.sources.tables import TABLE_NAMES, read_snapshot, write_snapshot
from haulage.sources.testdata import load_tables
from conftest import SMALL_SF

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_snapshot_round_trip_gives_the_same_reports(spark):
    t = load_tables(spark, SMALL_SF)
    path = write_snapshot(t, scratch_path(spark, "snapshot-test"))
    s = read_snapshot(spark, path)
    for name in TABLE_NAMES:
        a, b = getattr(t, name), getattr(s, name)
        assert a.schema == b.schema or [f.dataType for f in a.schema] == [f.dataType for f in b.schema], name
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name
    x, y = reports.salary_statement(t), reports.salary_statement(s)
    assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def test_cli_lists_and_runs_a_query():
    env = dict(os.environ, PYTHONPATH=ROOT)
    listed = subprocess.run([sys.executable, "-m", "haulage", "list"], capture_output=True, text=True,
                            cwd=ROOT, env=env, timeout=120)
    assert "salary_statement" in listed.stdout.split()
    shown = subprocess.run([sys.executable, "-m", "haulage", "route_list", "--sf", SMALL_SF, "--show", "2"],
                           capture_output=True, text=True, cwd=ROOT, env=env, timeout=300)
    assert "id_route" in shown.stdout and "only showing top 2 rows" in shown.stdout, shown.stderr[-2000:]
