"""Session settings and the shared scratch folder."""
from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOT: dict = {}      # made once per process, only where the session names no folder


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. On a cluster, pass the submitted session in instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("votelens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder that goes when the process ends; any other master is
    refused, because a folder of one machine would lose the rows of all others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _OWN_ROOT.get("dir")
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master!r})")
        root = _OWN_ROOT["dir"] = tempfile.mkdtemp(prefix="votelens-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def land(df: DataFrame, name: str = "landed") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and pins values that would change on recomputation
    (partition ids, floating-point sums).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
