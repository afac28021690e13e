"""Session defaults and the shared folder for written intermediates."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import anchorage


def build_session(app: str, master: str = "local[*]", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        if not context.getCheckpointDir():
            context.setCheckpointDir(folder)
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="anchorage-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so a lost executor does not recompute the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the tasks of a shuffle, four per core at least.

    For narrow rows that the next step turns into very many: the files they come from, or a
    shuffle that joined small partitions, may hold them all in one task.
    """
    session = df.sparkSession
    partitions = int(session.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(partitions, 4 * session.sparkContext.defaultParallelism))


def lookup_join(big: DataFrame, small: DataFrame, on, how: str = "left", max_rows: int = 100_000) -> DataFrame:
    """Join a summary back to its detail rows without shuffling the detail.

    The summary is written once and counted; only a summary proven to have at
    most ``max_rows`` rows is broadcast, a larger one takes a shuffle join.
    """
    small = written(small)
    fits = small.limit(max_rows + 1).count() <= max_rows
    return big.join(F.broadcast(small) if fits else small, on, how)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once per application,
    so that tasks find it wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(anchorage.__file__).parent
        name = f"{tempfile.mkdtemp()}/{package.name}"
        context.addPyFile(shutil.make_archive(name, "zip", package.parent, package.name))
        _SHIPPED.add(context.applicationId)


def mapped(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` whose function may use this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
