"""Session helpers shared by operators and queries."""

from __future__ import annotations

import atexit
import glob
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is missing (tests on one machine) a folder of our
    own is set; on a cluster the setting must name shared storage.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        where = tempfile.mkdtemp(prefix="locusloom-shared-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and drop its lineage.

    The copy survives the loss of executors, unlike a cached or locally
    checkpointed one.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for a table an operator writes; removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes what lies at a path or begins with it."""
    local = path.removeprefix("file://").removeprefix("file:")
    if local.startswith("/"):
        for p in glob.glob(f"{glob.escape(local)}*"):
            shutil.rmtree(p, ignore_errors=True)
        return
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path + "*")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        for s in fs.globStatus(at) or []:
            fs.delete(s.getPath(), True)
    except Exception:  # the session is gone, and with it the way to the folder
        pass


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give every executor this package, for clusters where it isn't installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    # executors may fetch the archive at any time, so it stays until the driver ends
    tmp = tempfile.mkdtemp(prefix=f"{root.name}-")
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    stage = Path(tmp) / "stage"
    shutil.copytree(root, stage / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(Path(tmp) / f"{root.name}-{sc.applicationId}"), "zip", stage))
