"""Session settings the operators rely on, and checkpoint handling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# working tables of this process that release_work may delete
_WORK: list[str] = []

# partitions over which a test or bench session spreads text tables that come as one small file; unset on a cluster
SPREAD = "spark.orgweave.spread"

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; sizes and partition counts stay the cluster's."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hand Python at most ``rows`` rows at a time in what runs inside: ten thousand whole pages are much for a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def local_session(cores: str = "8", app: str = "orgweave", memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config(SPREAD, cores)
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and working tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a single-machine
    session without that setting (tests, a laptop) gets a folder of its own; on
    a cluster each executor would write such a folder to its own disk, so a
    missing setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="orgweave-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name for a working table in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _WORK.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet working table and read it back: lineage ends at the shared folder."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def has_path(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, wherever it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder wherever it lies; False if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release_work(spark: SparkSession) -> int:
    """Delete the working tables made so far; call it once their results are written. Returns how many went."""
    gone = 0
    while _WORK:
        gone += delete_path(spark, _WORK.pop())
    return gone
