"""Model checks on a table of scores and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorage.operators.bins import risk_deciles
from anchorage.operators.prefix import ranked, running_before

SCORE = "Probabilidad"
LABEL = "Es_Fuga_Real"
KEY = "id"


def scored() -> Column:
    return F.col(SCORE).isNotNull() & ~F.isnan(F.col(SCORE).cast("double"))


def cumulate(table: DataFrame) -> DataFrame:
    """Running churners and coverage over at most ten decile rows."""
    upto = Window.orderBy("decil").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    return table.withColumns(
        {
            "fugas_acumuladas": F.sum("fugas").over(upto),
            "cobertura": F.try_divide(F.sum("fugas").over(upto) * 100.0, F.sum("fugas").over(every)),
        }
    )


def cum_capture(df: DataFrame) -> DataFrame:
    """Share of all churners caught down to each risk decile; rows without a score are left out."""
    table = risk_deciles(df.where(scored()), SCORE).groupBy("decil").agg(F.sum(F.col(LABEL).cast("bigint")).alias("fugas"))
    return cumulate(table)


def lift(df: DataFrame) -> DataFrame:
    """Score range, size, churn rate, lift and cumulative coverage per decile of the scored rows."""
    table = (
        risk_deciles(df.where(scored()), SCORE)
        .groupBy("decil")
        .agg(
            F.min(SCORE).alias("score_min"),
            F.max(SCORE).alias("score_max"),
            F.count(F.lit(1)).alias("clientes"),
            F.sum(F.col(LABEL).cast("bigint")).alias("fugas"),
        )
    )
    every = Window.partitionBy()
    base = F.sum("fugas").over(every) / F.sum("clientes").over(every)
    rated = cumulate(table).withColumn("tasa", F.col("fugas") / F.col("clientes"))
    return rated.withColumn("lift", F.try_divide(F.col("tasa"), base)).orderBy("decil")


def lift_at(df: DataFrame, *shares: float) -> DataFrame:
    """Lift and captured churn in the top share of scores, n = ceil(share * N)."""
    total = df.agg(F.count(F.lit(1))).scalar()
    marked = ranked(df.select(KEY, SCORE, LABEL), SCORE, KEY).withColumn("_total", total)
    y = F.col(LABEL).cast("bigint")
    cuts = {s: F.ceil(F.round(F.lit(s) * F.col("_total"), 6)) for s in shares}
    sums = marked.agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(y).alias("_y"),
        *[F.count(F.when(F.col("rank") <= cut, 1)).alias(f"_n{i}") for i, cut in enumerate(cuts.values())],
        *[F.sum(F.when(F.col("rank") <= cut, y)).alias(f"_y{i}") for i, cut in enumerate(cuts.values())],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(float(s)).alias("parte"), F.col(f"_n{i}").alias("n"), F.col(f"_y{i}").alias("fugas")
            )
            for i, s in enumerate(shares)
        ]
    )
    long = sums.select("_n", "_y", F.inline(rows))
    return long.select(
        "parte",
        "n",
        "fugas",
        F.try_divide(F.col("fugas") / F.col("n"), F.col("_y") / F.col("_n")).alias("lift"),
        F.try_divide("fugas", "_y").alias("captura"),
    )


def auc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve; ties between a churner and a stayer count half."""
    y = F.col(LABEL).cast("bigint")
    counts = (
        df.where(F.col(SCORE).isNotNull() & F.col(LABEL).isNotNull())
        .groupBy(SCORE)
        .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    )
    run = running_before(counts, SCORE, ["neg"], weight=F.col("pos") + F.col("neg"))
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return run.agg(F.try_divide(won, pairs).alias("auc"), F.sum("pos").alias("positivos"), F.sum("neg").alias("negativos"))


def brier(df: DataFrame) -> DataFrame:
    gap = F.col(SCORE) - F.col(LABEL)
    return df.agg(F.avg(gap * gap).alias("brier"), F.count(F.lit(1)).alias("n"))


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and observed rate per equal-width bin of [0, 1]; 1.0 is in the last bin.

    Rows without a score belong to no bin.
    """
    place = F.least(F.floor(F.round(F.col(SCORE) * bins, 9)), F.lit(bins - 1)).cast("int")
    return df.where(scored()).groupBy(place.alias("bin")).agg(
        F.avg(SCORE).alias("media"), F.avg(LABEL).alias("tasa"), F.count(F.lit(1)).alias("n")
    )
