"""SparkSession settings for tests, the bench and local runs.

On a cluster, use the cluster's session; the library never creates one.
``checkpoint_dir`` reads the shared folder from the session and makes a scratch
folder only in local mode, when none is set.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Local runs on small files: let AQE keep more, smaller post-shuffle partitions so
    # CPU-heavy stages (JSON parsing) use every core.  Cluster sessions keep their own.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "ridepulse", extra: dict | None = None) -> SparkSession:
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("RIDEPULSE_DRIVER_MEMORY", "8g")))
    for k, v in {**DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what starts in here; the former ones come back behind it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes and streams that start in here drop their shuffle files when they (a stream: each batch) end, not at the
    driver's next garbage collection.  What they wrote is read from its files, so nothing needs them again."""
    with settings(spark, {_FREED: "true"}):
        yield


_SCRATCH: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given.

    When neither is set, a session in local mode (tests, the bench) gets a
    scratch folder, once per application.  A cluster session without one is an
    error: executors and driver share no local folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _SCRATCH:
        _SCRATCH[sc.applicationId] = tempfile.mkdtemp(prefix="ridepulse-ckpt-")
        sc.setCheckpointDir(_SCRATCH[sc.applicationId])
    return _SCRATCH[sc.applicationId]
