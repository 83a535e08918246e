"""Session helpers.

Library code never creates its own session; these helpers are for scripts,
tests and the benchmark. ``checkpoint_dir`` reads the cluster setting and only
falls back to a scratch folder when the session has none (local tests).
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import SparkSession

_job_folder: ContextVar[str | None] = ContextVar("ordersight_job_folder", default=None)
_job_tables: ContextVar[list[str] | None] = ContextVar("ordersight_job_tables", default=None)

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ordersight", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment sets it, and it must be shared storage; a
    cluster without it is an error, because executors cannot share a scratch
    folder of the driver. In local mode a scratch folder is created.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="ordersight-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder (of the current job's, if any) for intermediate tables."""
    return os.path.join(_job_folder.get() or ensure_checkpoint_dir(spark), name)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI: one without a scheme is in the default file system of the cluster."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).makeQualified(p).toString()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def job(spark: SparkSession):
    """A folder for the intermediate tables of one job, removed at its end.

    Results that read these tables must be written out before the block ends.
    """
    path = os.path.join(ensure_checkpoint_dir(spark), f"ordersight/jobs/{uuid.uuid4().hex}")
    token, tables = _job_folder.set(path), _job_tables.set([])
    try:
        yield path
    finally:
        for name in _job_tables.get():
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        _job_folder.reset(token)
        _job_tables.reset(tables)
        remove(spark, path)


def adopt_table(name: str) -> None:
    """Let the current job, if any, drop this catalogue table at its end."""
    if _job_tables.get() is not None:
        _job_tables.get().append(name)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Batches of at most ``rows`` rows between Spark and the Python workers of jobs that run inside the block.

    For tables of wide rows: the usual 10,000 rows of several KB are held several times over, by JVM and worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df, name: str):
    """Write ``df`` as a parquet table under the shared checkpoint folder and read it back.

    Used where several branches of one plan would otherwise recompute the same
    expensive input: the branches then scan the written table (with column
    pruning), and its lineage is cut, so a lost executor recomputes from the
    table, not from the raw sources. Inside ``with job(spark)`` the table goes
    with the job; otherwise it stays until the checkpoint folder is cleared.
    """
    path = scratch_path(df.sparkSession, f"ordersight/tables/{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
