"""Session defaults and the one way this library cuts lineage: a written table."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)
FOLDER = "spark.checkpoint.dir"
_written: dict[str, SparkSession] = {}
_kept: dict[str, SparkSession] = {}
_own: list[str] = []


def build_session(app: str = "pressmill", master: str | None = None, partitions: int = 8, folder: str | None = None) -> SparkSession:
    """A session for local work; a cluster brings its own. ``folder`` is where intermediate tables go."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if folder:
        b = b.config(FOLDER, folder)
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or its context's checkpoint folder.

    A session that names none gets a temporary folder if it runs within one machine; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get(FOLDER) or spark.conf.get(FOLDER, None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError(f"{FOLDER} must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="pressmill-"))
    return f"file://{_own[0]}"


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    The result survives lost executors, is computed once, and has a known size, so that the planner's broadcast
    threshold is checked against real bytes. Files are removed by ``release``, at the latest when the driver ends; with keep only then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pressmill-{name}-{uuid.uuid4().hex}"
    (_kept if keep else _written)[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pressmill_path = path
    return out


def _delete(path: str, spark: SparkSession) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception as e:  # the session may have ended
        log.warning("could not delete %s: %s", path, e)


def release(*tables: DataFrame) -> None:
    """Delete what materialize has written: the given tables, which nothing may read any more, or all but the kept ones."""
    for path in [t._pressmill_path for t in tables] if tables else list(_written):
        if (spark := _written.pop(path, None)) is not None:
            _delete(path, spark)


@contextmanager
def temporary():
    """Deletes at the end what was written within, but for the tables that the yielded function is told to keep."""
    before, kept = set(_written), set()
    try:
        yield lambda t: kept.add(t._pressmill_path)
    finally:
        for path in set(_written) - before - kept:
            _delete(path, _written.pop(path))


def _release_all() -> None:
    release()
    while _kept:
        _delete(*_kept.popitem())


atexit.register(_release_all)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
