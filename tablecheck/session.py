"""Session construction and the shared scratch / checkpoint folder.

On a cluster the checkpoint folder comes from ``spark.checkpoint.dir`` (a shared
file system such as HDFS or an object store).  Only a ``local[...]`` master may
fall back to a private temporary folder, which is what the tests use.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Small shuffles feeding CPU-heavy text work should keep several partitions; large
    # shuffles are still coalesced towards the advisory partition size.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "tablecheck",
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's reliable checkpoint folder, setting one up only in local mode."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:
            configured = None
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="tablecheck-ckpt-")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tablecheck-scratch/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df, label: str, compression: str | None = None):
    """Write ``df`` to a fresh folder under the shared checkpoint folder and read it back.

    Used for intermediate results that several branches of one plan consume (each
    branch would otherwise recompute the whole lineage) and that must survive the
    loss of the executors that computed them.  ``compression``: the session's codec unless given.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # the schema is known: no job to read it from a file


def materialize_all(frames: dict, parallel: int = 4) -> dict:
    """:func:`materialize` several independent frames, their jobs submitted concurrently.

    A value is a DataFrame or a zero-argument function building one (so that the
    size checks a builder runs overlap too).  Small intermediate tables rarely fill
    the cluster on their own; submitting them together lets the scheduler run their
    tasks side by side.
    """
    from concurrent.futures import ThreadPoolExecutor

    def one(label, value):
        return materialize(value() if callable(value) else value, label)

    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(frames)))) as pool:
        done = {label: pool.submit(one, label, value) for label, value in frames.items()}
        return {label: f.result() for label, f in done.items()}

