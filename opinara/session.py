"""Session defaults for local runs, and the shared folders jobs may write to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

AT_ONCE = 12  # works of the driver side by side

Result = TypeVar("Result")

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "opinara", cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only where none is named."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="opinara-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def run_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared checkpoint folder; nothing is ever reused."""
    return f"{checkpoint_root(spark)}/opinara/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the frame to the reliable checkpoint folder and continue from there."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy per-row work when files come in fewer pieces than there are cores.

    Inputs with enough pieces, which large tables always have, pass unchanged and unshuffled. Only for
    frames read straight from files: counting the pieces of a shuffled frame would run its shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def at_once(spark: SparkSession, works: Sequence[Callable[[], Result]]) -> list[Result]:
    """What some independent works return, in their order; their Spark jobs share the cores.

    Each has many short jobs that wait for one another and leave most cores idle.
    """
    if not works:
        return []
    with ThreadPool(min(len(works), AT_ONCE)) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda work: work()), works, 1)
