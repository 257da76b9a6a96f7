"""Session helper, and the one place that decides where lineage is cut."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
ROWS = 250_000  # rows of a task that groups or orders them
TASKS = 50_000  # beyond so many tasks of ROWS rows, groups and sorts spill


def get_session(app: str = "tallyframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and AQE on; everything else is left to the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # The JVM does not compile methods above 8000 bytes of bytecode; fused stages that would
        # exceed it run faster as several smaller methods.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only for unset local sessions."""
    path = spark.conf.get(CHECKPOINT_DIR, None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    path = tempfile.mkdtemp(prefix="tallyframe-")
    spark.conf.set(CHECKPOINT_DIR, path)
    return path


_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one write below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that were written below the shared folder inside it. A job that
    writes its result to a path of its own can run in it; a result that is still to be computed would
    lose what it reads."""
    start = len(_MADE)
    try:
        yield
    finally:
        mine = _MADE[start:]
        del _MADE[start:]
        for path in mine:
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that later branches read the files and a lost
    executor costs nothing. Meant for small rolled-up tables that feed several branches."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of ``rows`` rows at most, dealt by ``keys`` into tasks small enough to group or order
    their rows in memory. Partitions are sized by rows here, as AQE would merge them by their
    compressed bytes."""
    return df.repartition(min(max(1, -(-rows // ROWS)), TASKS), *keys)
