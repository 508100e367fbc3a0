"""Session helpers shared by tests and the benchmark."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_shipped_to: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped_to:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.join(tempfile.mkdtemp(), "millrace")
        sc.addPyFile(shutil.make_archive(name, "zip", root, "millrace"))
        _shipped_to.add(sc.applicationId)


def local_session(cores: str = "8", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the named Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if its files make fewer partitions than that.

    For work that costs far more than moving the rows once. Large inputs have
    more partitions than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which all machines
    share. Local mode has one of its own where none is set; a cluster needs it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = "/tmp/checkpoints/millrace"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
