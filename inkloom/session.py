"""Session helpers: builder defaults, checkpoint folder, size-checked broadcast."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only while its estimated size stays below this many bytes.
BROADCAST_LIMIT = 8 << 20


def session(cores: int | str = 8, shuffle: int = 8) -> SparkSession:
    """Local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("INKLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only
    where that is unset (tests) a folder of our own is used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="inkloom-ck-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file sizes for scans)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast if the estimated size is below ``limit``, else leave the join to Catalyst."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


#: A checkpointed side is broadcast only while it has at most this many (narrow) rows.
FEW = 100_000


def few(df: DataFrame, limit: int = FEW) -> DataFrame:
    """Hint a broadcast for a checkpointed side of at most ``limit`` rows, whose size Catalyst doesn't know."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Scans of more bytes than these have enough splits of their own; of fewer, the work isn't worth a split.
SPLIT, LEAST = 32 << 20, 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small scan evenly over the cores: text work is CPU-bound, and one file's few row groups would leave cores idle.

    Only scans of fewer files than cores and of less than `SPLIT` bytes a core
    are repartitioned; larger ones have splits enough and nothing is shuffled.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if not LEAST <= plan_bytes(df) <= want * SPLIT or len(df.inputFiles()) >= want:
        return df
    return df.repartition(want)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it anywhere."""
    from pathlib import Path

    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="inkloom-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    copy = folder / "tree" / package.name
    shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(folder / package.name), "zip", copy.parent))
    _shipped.add(application)
