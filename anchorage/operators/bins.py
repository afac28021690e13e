"""Quantile bins and the deciles built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.operators.prefix import exact_quantiles, ranked


def quantile_edges(df: DataFrame, value: Column, q: int) -> Column:
    """Distinct quantile edges as a scalar subquery: at most q + 1 numbers, null when all are one."""
    found = exact_quantiles(df, value, [i / q for i in range(q + 1)], name="edges")
    distinct = F.array_distinct("edges")
    return found.select(F.when(F.size(distinct) > 1, distinct).alias("edges")).scalar()


def binned(df: DataFrame, col: str, edges: Column, out: str = "bin") -> DataFrame:
    """0-based right-closed bins; the first bin is closed on both sides, null stays null.

    With duplicate edges dropped there are fewer bins. The edges are read once,
    so the subquery behind them is planned once.
    """
    value = F.col(col)
    place = F.aggregate(
        "_edges",
        F.lit(0),
        lambda n, e: n + F.when(e < value, 1).otherwise(0),
        lambda n: F.greatest(n - 1, F.lit(0)),
    )
    return df.withColumn("_edges", edges).withColumn(out, F.when(value.isNotNull(), place)).drop("_edges")


def qcut(df: DataFrame, col: str, q: int, out: str = "bin") -> DataFrame:
    """Quantile bins by value, so equal values always share a bin (unlike ntile)."""
    return binned(df, col, quantile_edges(df, F.col(col), q), out)


def with_bounds(df: DataFrame, edges: Column, col: str = "bin") -> DataFrame:
    """Edges of each row's bin; apply it after aggregating when only bins are shown."""
    placed = df.withColumn("_edges", edges)
    return placed.withColumns(
        {f"{col}_low": F.get("_edges", F.col(col)), f"{col}_high": F.get("_edges", F.col(col) + 1)}
    ).drop("_edges")


def risk_deciles(df: DataFrame, score: str, out: str = "decil") -> DataFrame:
    """10 - bin, so 1 is the riskiest; with k < 10 bins labels run from 11 - k to 10."""
    return qcut(df, score, 10, "_bin").withColumn(out, (F.lit(10) - F.col("_bin")).cast("int")).drop("_bin")


def rank_deciles(df: DataFrame, score: str, key: str, out: str = "decil") -> DataFrame:
    """Ten equal bins over the rank, for scores with too many ties to bin by value.

    Ascending position p of N falls into quantile bin ceil(10 (p - 1) / (N - 1)),
    first bin closed; ``ranked`` counts from the top, so p = N + 1 - rank. Rows
    without a score rank last, are not among the N and get no decile.
    """
    steps = (F.col("_total") - F.col("_rank")) * 10
    span = F.greatest(F.col("_total") - 1, F.lit(1))
    bin0 = F.greatest(F.ceil(steps / span).cast("int") - 1, F.lit(0))
    return (
        ranked(df, score, key, "_rank")
        .withColumn("_total", df.agg(F.count(score)).scalar())
        .withColumn(out, F.when(F.col(score).isNotNull(), (F.lit(10) - bin0).cast("int")))
        .drop("_rank", "_total")
    )
