"""Queries over the feature-contribution table."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorage.operators import explain
from anchorage.plans.catalog import query
from anchorage.plans.tables import CONTRIB_WEIGHTS, MORE_WEIGHTS, Tables


def raw_contributions(t: Tables):
    """All cells, also the ones without a value."""
    long = explain.linear_contributions(t.wide_features, CONTRIB_WEIGHTS)
    return long.withColumn("shap_value", F.round("shap_value", 6))


def contributions_table(t: Tables):
    return explain.tidy(raw_contributions(t))


def more_contributions(t: Tables):
    """The table of twenty-three inputs."""
    long = explain.linear_contributions(t.more_features, MORE_WEIGHTS)
    return explain.tidy(long.withColumn("shap_value", F.round("shap_value", 6)))


def rounded(df, *names, digits: int = 6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("linear_contrib", "SELECT ID, feature, shap_value, feature_value FROM contrib")
def linear_contrib(t: Tables):
    return raw_contributions(t).select("ID", "feature", "shap_value", "feature_value")


TOP_FEATURES, PER_FEATURE = 20, 1500


def top_sql(table: str) -> str:
    return f"top AS (SELECT feature, avg(abs(shap_value)) AS mean_abs FROM {table} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {TOP_FEATURES})"


@query("top_features", f"WITH {top_sql('more_contrib_ok')} SELECT feature, round(mean_abs, 6) AS mean_abs FROM top")
def top_features(t: Tables):
    return rounded(explain.top_contrib(more_contributions(t), TOP_FEATURES), "mean_abs")


@query(
    "semi_top_features",
    f"""WITH {top_sql("more_contrib_ok")} SELECT feature, count(*) AS n, round(sum(shap_value), 4) AS total FROM more_contrib_ok
    WHERE feature IN (SELECT feature FROM top) GROUP BY 1""",
)
def semi_top_features(t: Tables):
    long = more_contributions(t)
    kept = explain.keep_top(long, explain.top_contrib(long, TOP_FEATURES))
    return kept.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("shap_value"), 4).alias("total"))


_SAMPLE = """(SELECT *, row_number() OVER (PARTITION BY feature ORDER BY md5(ID || '|123'), ID) AS rn FROM contrib_ok {where})"""


@query(
    "sample_per_group",
    f"SELECT feature, ID, shap_value FROM {_SAMPLE.format(where='')} s WHERE rn <= {PER_FEATURE}",
)
def sample_per_group(t: Tables):
    return explain.sample_by_group(contributions_table(t), "feature", "ID", PER_FEATURE).select("feature", "ID", "shap_value")


def scale_sql(missing: str, group: str) -> str:
    low, high = (f"{f}(feature_value) OVER (PARTITION BY {group})" for f in ("min", "max"))
    return f"""(CASE WHEN {low} IS NULL THEN {missing} WHEN {low} = {high} THEN 0.5 WHEN feature_value IS NULL THEN {missing}
      ELSE (feature_value - {low}) / ({high} - {low}) END)::double"""


@query(
    "scale01_by_feature",
    f"""SELECT ID, feature, round({scale_sql("0.5", "feature")}, 6) AS chart01, round({scale_sql("NULL", "feature")}, 6) AS fv01
    FROM contrib""",
)
def scale01_by_feature(t: Tables):
    # The chart fills what is missing, the insights keep the gaps.
    chart = explain.scale01(raw_contributions(t), 0.5).withColumnRenamed("fv01", "chart01")
    return rounded(explain.scale01(chart, None).select("ID", "feature", "chart01", "fv01"), "chart01", "fv01")



def _pretty() -> str:
    from anchorage.plans.cleaning import pretty_sql

    return pretty_sql("feature")


@query(
    "contrib_chart_data",
    f"""WITH {top_sql('contrib_ok')}, s AS (SELECT * FROM {_SAMPLE.format(where="WHERE feature IN (SELECT feature FROM top)")} x WHERE rn <= {PER_FEATURE}),
    l AS (SELECT *, {_pretty()} AS feature_pretty FROM s)
    SELECT ID, feature, feature_pretty, shap_value, feature_value, round({scale_sql("0.5", "feature_pretty")}, 6) AS fv01 FROM l""",
)
def contrib_chart_data(t: Tables):
    found = explain.contrib_points(contributions_table(t))
    return rounded(found.select("ID", "feature", "feature_pretty", "shap_value", "feature_value", "fv01"), "fv01")


def metrics_sql(table: str) -> str:
    return f"""scaled AS (SELECT *, {scale_sql("NULL", "feature")} AS v FROM {table}),
    metrics AS (SELECT *, CASE WHEN shap_high_mean > 0 THEN shap_high_mean * sqrt(p_high) END AS score_fuga_high,
      CASE WHEN shap_high_mean < 0 THEN abs(shap_high_mean) * sqrt(p_high) END AS score_perm_high,
      {_pretty()} AS feature_pretty
    FROM (SELECT feature, avg(abs(shap_value)) AS mean_abs, count(*) FILTER (v >= 0.8) AS n_high,
      (count(*) FILTER (v >= 0.8)) / count(*) AS p_high, avg(shap_value) FILTER (v >= 0.8) AS shap_high_mean,
      quantile_cont(shap_value, 0.5) FILTER (v >= 0.8) AS shap_high_median,
      quantile_cont(shap_value, 0.9) FILTER (v >= 0.8) AS shap_high_p90,
      avg((shap_value > 0)::int) FILTER (v >= 0.8) AS pct_high_pos FROM scaled GROUP BY 1) m)"""

_NUMBERS = ("mean_abs", "p_high", "shap_high_mean", "shap_high_median", "shap_high_p90", "pct_high_pos")
_NUMBERS += ("score_fuga_high", "score_perm_high")
_SHOWN = "feature, feature_pretty, n_high, " + ", ".join(f"round({n}, 5) AS {n}" for n in _NUMBERS)


def shown(df):
    return rounded(df, *_NUMBERS, digits=5)


@query("contrib_metrics", f"WITH {metrics_sql('contrib_ok')} SELECT {_SHOWN} FROM metrics")
def contrib_metrics(t: Tables):
    return shown(explain.contrib_metrics(contributions_table(t)))


def strongest_sql(score: str) -> str:
    return f"""WITH {metrics_sql("more_contrib_ok")} SELECT {_SHOWN} FROM (SELECT * FROM metrics WHERE {score} IS NOT NULL AND n_high >= 80
      ORDER BY {score} DESC, feature LIMIT 7) m"""


@query("churn_drivers", strongest_sql("score_fuga_high"))
def churn_drivers(t: Tables):
    return shown(explain.drivers(explain.contrib_metrics(more_contributions(t))))


@query("stay_drivers", strongest_sql("score_perm_high"))
def stay_drivers(t: Tables):
    return shown(explain.anchors(explain.contrib_metrics(more_contributions(t))))
