"""Spark session settings shared by the library, tests and the bench.

The library never creates its own session inside an operator; these helpers
are for entry points (tests, bench, command-line jobs).
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every entry point wants: AQE re-plans joins and coalesces shuffle
# partitions at runtime, skew-join splits a hot key of a join-back, and all
# time arithmetic is done in UTC (test timestamps are zone-less).
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "ruleforge", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Where it is unset, a session in one process (local tests) gets a fresh
    folder of its own; a cluster is refused, since the driver's folders aren't
    the executors'.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a remote (Connect) session has no context; the conf is all there is
        sc = None
    if not current and sc is not None:
        current = sc.getCheckpointDir()
    if not current:
        if sc is None or not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="ruleforge-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def child_folders(spark: SparkSession, path: str, finished: bool = False) -> list[str]:
    """Names of the ``key=value`` folders below a path; with ``finished`` only those whose writing job ended."""
    where, store = _folder(spark, path)
    if not store.exists(where):
        return []
    found = [f.getPath() for f in store.listStatus(where) if f.isDirectory() and "=" in f.getPath().getName()]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(f.getName() for f in found if not finished or store.exists(done(f, "_SUCCESS")))


def delete_folder(spark: SparkSession, path: str) -> None:
    where, store = _folder(spark, path)
    store.delete(where, True)
