"""Session helpers: local test session and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every faultline job relies on.  AQE re-plans joins and coalesces
# small shuffles at run time; skew-join splits hot partitions.
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8,
                  app: str = "faultline") -> SparkSession:
    """A local session for tests and the bench (UI off, small shuffles)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in JOB_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session.  Where it is unset, a
    local master gets a scratch folder, which goes when the process ends; any
    other master must name a folder that all its machines share.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="faultline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut_lineage(df):
    """Materialise ``df`` reliably and cut its plan.

    The rows are written once as parquet under the shared checkpoint folder
    (one job; the data survives executor loss) and read back, so later plans
    start from a file scan with exact size statistics.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/faultline-{uuid.uuid4().hex}"
    for written in _scratch:
        written.append(path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


_scratch: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession):
    """Deletes at its end the tables that ``cut_lineage`` has written inside it.

    A result rests on such tables until it is read, so read or write it inside.  Without this
    they stay in the shared folder, whose owner decides when it goes.
    """
    written: list[str] = []
    _scratch.append(written)
    try:
        yield
    finally:
        _scratch.remove(written)
        for path in written:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
