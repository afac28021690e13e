"""Helpers shared by the corpus operators: table access and staged intermediates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorage.session import mapped, scratch_path, ship

__all__ = ["discard", "joined_to_unique", "mapped", "scratch_path", "ship", "staged", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back, so a lost executor
    costs no recomputation and later steps read only the columns they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.staged_at = path
    return found


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(frame.staged_at)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def joined_to_unique(big: DataFrame, small: DataFrame, on: list[str], rows: str = "rows", heavy: int = 1_024) -> DataFrame:
    """Inner join of ``big`` with ``small``, whose keys are unique and whose column ``rows``
    counts the rows of ``big`` under each key; that column is dropped.

    Keys that hold at least one in ``heavy`` of the counted rows are at most ``heavy``, so
    they are broadcast; every other key brings less than that share to a task. Both tables
    are read twice, so pass written ones. Null keys match nothing.
    """
    total = small.agg(F.sum(rows)).scalar()
    marked = small.withColumn("_total", total)
    hot = F.broadcast(marked.filter(F.col(rows) * heavy >= F.col("_total")).drop("_total", rows))
    rest = marked.filter(F.col(rows) * heavy < F.col("_total")).drop("_total", rows)
    others = big.join(hot.select(*on), on, "left_anti").join(rest, on)
    return big.join(hot, on).unionByName(others)
