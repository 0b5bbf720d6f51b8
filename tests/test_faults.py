"""A failed task is retried and the results stay whole and identical.

Runs in its own process: a ``local[4,3]`` session (up to 3 attempts per
task; the shared test session allows 1). The first attempt of one task
fails on purpose, before and after the id allocation.
"""
import json
import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = textwrap.dedent("""
    import json, sys
    sys.path.insert(0, %(root)r)
    from pyspark import TaskContext
    from pyspark.sql import SparkSession, Window, functions as F
    spark = (SparkSession.builder.master("local[4,3]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.checkpoint.dir", %(shared)r).config("spark.sql.shuffle.partitions", "4").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    from haulage.operators.ids import allocate_ids

    def flaky(it):
        tc = TaskContext.get()
        if tc.partitionId() == 1 and tc.attemptNumber() == 0:
            raise RuntimeError("injected task failure")
        yield from it

    batch = (spark.range(0, 20000, numPartitions=4).selectExpr("id * 7 %% 20011 AS seq")
             .mapInPandas(flaky, "seq long"))                    # fails before allocation
    ids = allocate_ids(batch, "id_x", ["seq"], base=10, partitions=4)
    ids = ids.mapInPandas(flaky, ids.schema)                     # and after it
    got = sorted((r.seq, r.id_x) for r in ids.collect())
    want = [(s, 10 + i + 1) for i, s in enumerate(sorted(r.seq for r in batch.collect()))]
    print(json.dumps({"equal": got == want, "rows": len(got)}))
""")


def test_ids_survive_a_failed_task(tmp_path):
    env = dict(os.environ, PYTHONPATH=ROOT)
    out = subprocess.run([sys.executable, "-c", SCRIPT % {"root": ROOT, "shared": str(tmp_path)}], capture_output=True, text=True,
                         timeout=600, env=env)
    line = [l for l in out.stdout.splitlines() if l.startswith("{")]
    assert line, out.stderr[-3000:]
    res = json.loads(line[-1])
    assert res == {"equal": True, "rows": 20000}


SCRATCH = textwrap.dedent("""
    import os, sys
    sys.path.insert(0, %(root)r)
    from haulage.session import build_session, release_scratch
    from haulage.plans import registry
    spark = build_session(master="local[4]", shuffle_partitions=4)
    try:
        registry.build()["upsert_routes"](spark, %(sf)r)
    except RuntimeError as e:
        print("RAISED", "spark.checkpoint.dir" in str(e))
    spark.sparkContext.setCheckpointDir(%(shared)r)
    for name in ("upsert_routes", "register_users", "assign_drivers", "stream_crew_limit"):
        registry.build()[name](spark, %(sf)r).count()
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    print("FOLDERS", len(os.listdir(base)) > 0)
    release_scratch(spark)
    print("LEFT", len(os.listdir(base)))
""")


def test_library_raises_without_a_folder_and_leaves_none_behind(tmp_path):
    from conftest import SMALL_SF
    (tmp_path / "conf").mkdir()
    env = dict(os.environ, PYTHONPATH=ROOT, SPARK_CONF_DIR=str(tmp_path / "conf"))  # no defaults of the machine
    out = subprocess.run([sys.executable, "-c", SCRATCH % {"root": ROOT, "shared": str(tmp_path / "shared"), "sf": SMALL_SF}],
                         capture_output=True, text=True, timeout=600, env=env)
    assert [line.split() for line in out.stdout.splitlines()] == [["RAISED", "True"], ["FOLDERS", "True"], ["LEFT", "0"]], out.stderr[-3000:]
