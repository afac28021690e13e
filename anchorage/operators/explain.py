"""Summaries of a long feature-contribution table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorage.functions.columns import number_or_null, pretty_feature_name
from anchorage.operators.prefix import exact_quantiles, piece_bits

HIGH = 0.80
MIN_HIGH = 80


def tidy(df: DataFrame) -> DataFrame:
    """Text columns to their types; rows without a feature or a contribution go."""
    types = dict(df.dtypes)

    def number(name: str) -> Column:
        value = number_or_null(F.col(name)) if types[name] == "string" else F.col(name).cast("double")
        return value.alias(name)

    return df.select(
        F.col("ID").cast("string").alias("ID"),
        F.col("feature").cast("string").alias("feature"),
        number("shap_value"),
        number("feature_value"),
    ).where((F.col("feature") != "") & F.col("shap_value").isNotNull())


def linear_contributions(df: DataFrame, weights: Mapping[str, float], key: str = "ID") -> DataFrame:
    """Long table of weight * (value - mean), which is exact for a linear score."""
    means = df.agg(F.struct(*[F.avg(f).alias(f) for f in weights]).alias("m")).scalar()
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                (F.lit(float(w)) * (F.col(f) - F.col(f"_m.{f}"))).alias("shap_value"),
                F.col(f).alias("feature_value"),
            )
            for f, w in weights.items()
        ]
    )
    return df.withColumn("_m", means).select(key, F.inline(cells))


def top_contrib(df: DataFrame, k: int = 20) -> DataFrame:
    return (
        df.groupBy("feature")
        .agg(F.avg(F.abs("shap_value")).alias("mean_abs"))
        .orderBy(F.desc("mean_abs"), "feature")
        .limit(k)
    )


def keep_top(df: DataFrame, top: DataFrame) -> DataFrame:
    return df.join(top, "feature", "left_semi")


def sample_by_group(df: DataFrame, group: str, key: str, n: int = 1500, seed: int = 123) -> DataFrame:
    """At most n rows per group in md5 order of key and seed, so every run picks the same.

    A group may hold most of the table, so each group is first cut to n rows in
    every one of its slices, whose number follows the cluster's partitions; only
    slices * n rows per group go on.
    """
    order = F.md5(F.concat_ws("|", F.col(key), F.lit(str(seed))))
    last_digits = F.conv(F.substring(order, 29, 4), 16, 10).cast("int")
    drawn = df.withColumns({"_draw": order, "_slice": last_digits % 2 ** piece_bits(df)})
    first = Window.partitionBy(group, "_slice").orderBy("_draw", key)
    last = Window.partitionBy(group).orderBy("_draw", key)
    cut = drawn.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= n)
    cut = cut.withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") <= n)
    return cut.drop("_draw", "_slice", "_rn")


def scale01(df: DataFrame, missing: float | None = 0.5, group: str = "feature", value: str = "feature_value") -> DataFrame:
    """Min-max per feature as ``fv01``.

    A constant feature gives 0.5 on every row. Missing values give ``missing``,
    and so does a feature with no value at all.
    """
    bounds = df.groupBy(group).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    v = F.col(value)
    scaled = (
        F.when(F.col("_min").isNull(), F.lit(missing))
        .when(F.col("_max") == F.col("_min"), F.lit(0.5))
        .when(v.isNull(), F.lit(missing))
        .otherwise((v - F.col("_min")) / (F.col("_max") - F.col("_min")))
    )
    return df.join(bounds, group, "left").withColumn("fv01", scaled.cast("double")).drop("_min", "_max")


def contrib_points(df: DataFrame, k: int = 20, n: int = 1500) -> DataFrame:
    """Chart rows: top features, sampled, labelled, then scaled within the label."""
    chosen = sample_by_group(keep_top(df, top_contrib(df, k)), "feature", "ID", n)
    return scale01(chosen.withColumn("feature_pretty", pretty_feature_name(F.col("feature"))), 0.5, "feature_pretty")


def contrib_metrics(df: DataFrame) -> DataFrame:
    """Per feature: mean absolute contribution and its profile where the value is high.

    ``p_high`` is the share of all the feature's rows.
    """
    scaled = scale01(df, None)
    high = F.coalesce(F.col("fv01") >= HIGH, F.lit(False))
    s = F.col("shap_value")
    plain = scaled.groupBy("feature").agg(
        F.avg(F.abs(s)).alias("mean_abs"),
        F.count(F.when(high, 1)).alias("n_high"),
        F.avg(high.cast("double")).alias("p_high"),
        F.avg(F.when(high, s)).alias("shap_high_mean"),
        F.avg(F.when(high, (s > 0).cast("double"))).alias("pct_high_pos"),
    )
    spread = exact_quantiles(scaled.where(high), s, [0.5, 0.9], ["feature"])
    mean, share = F.col("shap_high_mean"), F.sqrt("p_high")
    return plain.join(spread, "feature", "left").select(
        "feature",
        pretty_feature_name(F.col("feature")).alias("feature_pretty"),
        "mean_abs",
        "n_high",
        "p_high",
        "shap_high_mean",
        F.get("q", F.lit(0)).alias("shap_high_median"),
        F.get("q", F.lit(1)).alias("shap_high_p90"),
        "pct_high_pos",
        F.when(mean > 0, mean * share).alias("score_fuga_high"),
        F.when(mean < 0, F.abs(mean) * share).alias("score_perm_high"),
    )


def strongest(metrics: DataFrame, score: str, k: int = 7) -> DataFrame:
    kept = metrics.where(F.col(score).isNotNull() & (F.col("n_high") >= MIN_HIGH))
    return kept.orderBy(F.desc(score), "feature").limit(k)


def drivers(metrics: DataFrame, k: int = 7) -> DataFrame:
    """Features whose high values push towards leaving."""
    return strongest(metrics, "score_fuga_high", k)


def anchors(metrics: DataFrame, k: int = 7) -> DataFrame:
    """Features whose high values hold customers."""
    return strongest(metrics, "score_perm_high", k)
