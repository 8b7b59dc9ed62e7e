"""A session that names nothing: in a process of its own, since a context's settings can't be changed."""

import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


def test_plain_session():
    code = """
import sys
sys.path.insert(0, %r)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
from pressmill import session
assert e.entry(spark).count() == 20
for name, f in e.queries().items():
    if name.endswith("_found"):
        f(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        session.release()
print("done")
""" % str(REPO)
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert got.stdout.strip().endswith("done"), got.stderr[-2000:]


def test_release(spark):
    from pressmill import session

    t = session.materialize(spark.range(3), "some")
    assert t.count() == 3
    session.release(t)
    with pytest.raises(Exception):
        spark.read.parquet(t._pressmill_path).count()
    session.release(t)  # nothing is left to do


def test_temporary(spark):
    from pressmill import session

    with session.temporary() as keep:
        one, two = session.materialize(spark.range(1), "one"), session.materialize(spark.range(2), "two")
        keep(two)
    assert two.count() == 2
    with pytest.raises(Exception):
        spark.read.parquet(one._pressmill_path).count()
    session.release(two)


def test_cluster_needs_a_folder():
    from pressmill import session

    class Context:
        master = "spark://somewhere:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
