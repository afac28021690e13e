"""Money: the backtest on real churners and the expected value on predicted risk.

The two stay apart. The backtest pays the incentive on every contact, counts
real churners and truncates the saved ones; the expected value pays it only
for those saved and truncates nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorage.functions.columns import hash_percent, is_finite
from anchorage.operators.checks import KEY, LABEL, SCORE
from anchorage.operators.portfolio import active_only, apply_filters
from anchorage.operators.prefix import as_columns, at_places, count_below, piece_bits, ranked, running_before, top_n
from anchorage.session import written

ID = "AFILIADO_ID_EPS"
RISK = "risk_12m"
DEFAULT_CONTACTS = 100
CURVE_STEPS = 25
MILLION = 1e6

# The two lists of the field test.
TREATED, CONTROL = "TRATAMIENTO (Llamar)", "CONTROL (No Llamar)"


@dataclass(frozen=True)
class Campaign:
    """Parameters of one campaign; money in COP."""

    ltv: float = 7_200_000
    call_cost: float = 10_000
    incentive: float = 180_000
    success: float = 0.30
    budget: int = 10_000

    @property
    def contact_cost(self) -> float:
        return self.call_cost + self.incentive


def thresholds() -> list[float]:
    """One hundred evenly spaced cut-offs from 0.01 to 0.99."""
    return [round(0.01 + i * 0.98 / 99, 10) for i in range(100)]


def literals(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def grid(row: DataFrame, **axes: Sequence) -> DataFrame:
    """Every combination of parameter values beside a one-row summary."""
    for name, values in axes.items():
        row = row.withColumn(name, F.explode(literals(values)))
    return row


# -- backtest --------------------------------------------------------------


def _profit(n: Column, hits: Column, ltv: float, cost: Column | float, success: Column | float) -> Column:
    """Money left after truncating the saved customers to whole people."""
    cost = cost if isinstance(cost, Column) else F.lit(float(cost))
    success = success if isinstance(success, Column) else F.lit(float(success))
    return F.floor(hits * success) * F.lit(float(ltv)) - n * cost


def roi(df: DataFrame, plan: Campaign, top: int | None = None, threshold: float | None = None) -> DataFrame | None:
    """Result of contacting the top N, or everyone at or above a threshold.

    Zero counts as not given; with neither there is no result.
    """
    if top:
        chosen = top_n(df, top, SCORE, KEY)
    elif threshold:
        chosen = df.where(F.col(SCORE) >= threshold)
    else:
        return None
    sums = chosen.agg(
        F.count(F.lit(1)).alias("gestionados"),
        F.coalesce(F.sum(F.col(LABEL).cast("bigint")), F.lit(0)).alias("fugas_reales"),
    )
    n, hits = F.col("gestionados"), F.col("fugas_reales")
    out = sums.withColumns(
        {
            "salvados": F.floor(hits * F.lit(float(plan.success))),
            "inversion": n * F.lit(float(plan.contact_cost)),
            "ganancia": _profit(n, hits, plan.ltv, plan.contact_cost, plan.success),
        }
    ).withColumn("retorno", F.col("salvados") * F.lit(float(plan.ltv)))
    share = F.when(F.col("inversion") > 0, F.col("ganancia") / F.col("inversion") * 100).otherwise(0.0)
    return out.withColumn("roi_pct", share)


def threshold_curve(df: DataFrame, plan: Campaign) -> DataFrame:
    """Profit at each of the hundred thresholds, from one pass over the scores.

    A score is counted once, at the highest threshold it passes; the curve then
    cumulates those hundred counts.
    """
    cuts = thresholds()
    bits = len(cuts).bit_length()
    passed = count_below(literals(cuts), F.col(SCORE), bits, inclusive=True)
    counts = df.groupBy(passed.alias("paso")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(LABEL).cast("bigint")).alias("_y")
    )
    steps = df.sparkSession.range(len(cuts)).select(
        (F.col("id") + 1).cast("int").alias("paso"), F.get(literals(cuts), F.col("id").cast("int")).alias("umbral")
    )
    above = Window.orderBy(F.desc("paso")).rowsBetween(Window.unboundedPreceding, 0)
    curve = steps.join(counts, "paso", "left").select(
        "umbral",
        F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("gestionados"),
        F.coalesce(F.sum("_y").over(above), F.lit(0)).alias("fugas_reales"),
    )
    money = _profit(F.col("gestionados"), F.col("fugas_reales"), plan.ltv, plan.contact_cost, plan.success)
    return curve.withColumn("ganancia", money)


def best_threshold(df: DataFrame, plan: Campaign) -> DataFrame:
    """Threshold with the highest profit, the lowest one on a tie."""
    return threshold_curve(df, plan).orderBy(F.desc("ganancia"), F.asc("umbral")).limit(1)


def grid_backtest(df: DataFrame, plan: Campaign, incentives: Sequence[int], rates: Sequence[float]) -> DataFrame:
    """Profit in millions by incentive and success rate; one ranking serves the whole grid."""
    sums = top_n(df, plan.budget, SCORE, KEY).agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(F.col(LABEL).cast("bigint")), F.lit(0)).alias("_y")
    )
    cells = grid(sums, incentivo=incentives, exito=rates)
    cost = F.col("incentivo") + F.lit(float(plan.call_cost))
    money = _profit(F.col("_n"), F.col("_y"), plan.ltv, cost, F.col("exito"))
    return cells.select("incentivo", "exito", (money / MILLION).alias("ganancia_millones"))


def ab_split(df: DataFrame, n: int, share: float = 0.8) -> DataFrame:
    """Top N, each drawn into treatment with the given probability by a hash of its id."""
    treated = hash_percent(F.col(KEY)) < round(share * 100)
    return top_n(df, n, SCORE, KEY).withColumn("Grupo", F.when(treated, TREATED).otherwise(CONTROL))


def scenarios(df: DataFrame, plan: Campaign, shares: Sequence[float]) -> DataFrame:
    """Backtest and expected value at several top shares, n = ceil(share * N), from one ranking."""
    total = df.agg(F.count(F.lit(1))).scalar()
    marked = ranked(df.select(KEY, SCORE, LABEL), SCORE, KEY).withColumn("_total", total)
    found = []
    for i, s in enumerate(shares):
        inside = F.col("rank") <= F.ceil(F.round(F.lit(s) * F.col("_total"), 6))
        found += [
            F.count(F.when(inside, 1)).alias(f"_n{i}"),
            F.sum(F.when(inside, F.col(LABEL).cast("bigint"))).alias(f"_y{i}"),
            F.sum(F.when(inside, F.col(SCORE))).alias(f"_e{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(float(s)).alias("parte"),
                F.col(f"_n{i}").alias("gestionados"),
                F.col(f"_y{i}").alias("fugas_reales"),
                F.col(f"_e{i}").alias("fugas_esp"),
            )
            for i, s in enumerate(shares)
        ]
    )
    long = marked.agg(*found).select(F.inline(rows))
    n, saved = F.col("gestionados"), F.col("fugas_esp") * plan.success
    return long.withColumns(
        {
            "ganancia_real": _profit(n, F.col("fugas_reales"), plan.ltv, plan.contact_cost, plan.success),
            "ganancia_esp": saved * plan.ltv - (n * plan.call_cost + saved * plan.incentive),
        }
    )


# -- expected value --------------------------------------------------------


def impact_base(df: DataFrame, *filters: Mapping[str, str | None]) -> DataFrame:
    """Active affiliates that pass every filter set and have a usable risk."""
    df = active_only(df)
    for chosen in filters:
        df = apply_filters(df, chosen)
    return df.withColumn(RISK, F.col(RISK).try_cast("double")).where(is_finite(F.col(RISK)))


def _expected(found: DataFrame, ltv: Column, call: Column, incentive: Column, success: Column) -> DataFrame:
    """KPI columns from ``n`` contacts holding ``fugas_esp`` expected churn."""
    saved = found.withColumn("salvados_esp", F.col("fugas_esp") * success)
    costs = saved.withColumns(
        {
            "retorno_esp": F.col("salvados_esp") * ltv,
            "costo_llamadas": F.col("n") * call,
            "costo_incentivos": F.col("salvados_esp") * incentive,
        }
    ).withColumn("costo_esp", F.col("costo_llamadas") + F.col("costo_incentivos"))
    net = costs.withColumn("ganancia_neta", F.col("retorno_esp") - F.col("costo_esp"))
    return net.withColumn("roi", F.when(F.col("costo_esp") > 0, F.col("ganancia_neta") / F.col("costo_esp")))


def impact(base: DataFrame, campaigns: DataFrame) -> DataFrame:
    """KPIs of every campaign (ltv, call_cost, incentive, success, budget) on the same base.

    A missing budget becomes min(100, rows). Affiliates are counted per distinct risk;
    each distinct budget n finds the risk that covers place n among the running counts,
    and the sum above it, so no affiliate is ranked.
    """
    total = F.col("_total")
    # One column, read by every branch below: written once instead of derived again.
    base = written(base.select(RISK))
    sized = campaigns.withColumn("_total", base.agg(F.count(F.lit(1))).scalar())
    wanted = F.coalesce(F.col("budget").cast("bigint"), F.least(F.lit(DEFAULT_CONTACTS), total))
    sized = as_columns(sized.withColumn("_wanted", F.least(wanted, total)), campaigns.columns, n="_wanted")
    counts = base.groupBy(RISK).agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.col("_n") * F.col(RISK))
    run = running_before(counts, RISK, ["_n", "_s"], descending=True, pieces=True)
    places = sized.where("n > 0").select("n", (F.col("n") - 1).alias("_place")).distinct()
    placed = at_places(run, "_n_before", places, "_place", piece_bits(counts))
    expected = F.col("_s_before") + (F.col("n") - F.col("_n_before")) * F.col(RISK)
    sums = placed.select("n", expected.alias("fugas_esp"))
    found = sized.join(sums, "n", "left").withColumn("fugas_esp", F.coalesce("fugas_esp", F.lit(0.0)))
    kpis = _expected(found, F.col("ltv"), F.col("call_cost"), F.col("incentive"), F.col("success"))
    return kpis.drop("ltv", "call_cost", "incentive", "success", "budget")


def wanted(budget: int | None) -> int:
    """Contacts of a budget; the default where it is missing or not positive."""
    return budget if budget and budget > 0 else DEFAULT_CONTACTS


def contacts(base: DataFrame, budget: int | None) -> tuple[DataFrame, Column]:
    """The managed rows and, as a scalar, how many rows the base has."""
    return top_n(base, wanted(budget), RISK, ID), base.agg(F.count(F.lit(1))).scalar()


def impact_summary(base: DataFrame, plan: Campaign) -> DataFrame:
    top, total = contacts(base, plan.budget)
    sums = top.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(RISK), F.lit(0.0)).alias("fugas_esp"), F.avg(RISK).alias("prob_media")
    ).withColumn("activos", total)
    return _expected(sums, *[F.lit(float(v)) for v in (plan.ltv, plan.call_cost, plan.incentive, plan.success)])


# The metrics of the result table, in display order.
METRICS = (
    "activos",
    "n",
    "fugas_esp",
    "prob_media",
    "salvados_esp",
    "retorno_esp",
    "costo_llamadas",
    "costo_incentivos",
    "costo_esp",
    "ganancia_neta",
    "roi",
)


def impact_table(base: DataFrame, plan: Campaign) -> DataFrame:
    """The eleven metrics, one per row, as numbers."""
    row = impact_summary(base, plan)
    cells = [
        F.struct(F.lit(i + 1).alias("orden"), F.lit(m).alias("metrica"), F.col(m).cast("double").alias("valor"))
        for i, m in enumerate(METRICS)
    ]
    return row.select(F.inline(F.array(*cells)))


def curve_points(base: DataFrame, budget: int | None) -> DataFrame:
    """Numbers of contacts to evaluate: up to 25 rounded steps from 50, and the budget itself."""
    sized = base.agg(F.count(F.lit(1)).alias("filas")).withColumn("n", F.least(F.lit(wanted(budget)).cast("bigint"), "filas"))
    top = F.when(F.col("n") < 10, F.least(F.lit(100), F.col("filas"))).otherwise(F.col("n"))
    steps = F.sequence(F.lit(0), F.lit(CURVE_STEPS - 1))
    points = sized.withColumn("_top", top).select(
        "filas",
        "n",
        F.transform(
            steps, lambda i: F.bround(50 + i * (F.col("_top") - 50) / (CURVE_STEPS - 1.0)).cast("bigint")
        ).alias("ks"),
    )
    stepped = points.select("filas", F.explode("ks").alias("k")).where((F.col("k") > 0) & (F.col("k") <= F.col("filas")))
    return stepped.select("k").union(points.select(F.col("n").alias("k"))).distinct()


def profit_by_n(base: DataFrame, plan: Campaign) -> DataFrame:
    """Net expected money at each number of contacts; saved is capped by k * success.

    The running sum of risk is taken over distinct risk values; a value that
    straddles k counts for the part of its rows inside.
    """
    base = written(base.select(RISK))
    counts = base.groupBy(RISK).agg(F.count(F.lit(1)).alias("_n"))
    run = running_before(counts, RISK, ["_n"], descending=True)
    points = curve_points(base, plan.budget).agg(F.collect_list("k").alias("ks"), F.max("k").alias("last"))
    # One array of at most 26 numbers.
    reach = points.select(F.struct("ks", "last")).scalar()
    near = run.withColumn("_p", reach).where(F.col("_n_before") < F.col("_p.last"))
    cells = near.select(RISK, "_n", "_n_before", F.explode("_p.ks").alias("k"))
    taken = F.least(F.greatest(F.col("k") - F.col("_n_before"), F.lit(0)), F.col("_n"))
    sums = cells.groupBy("k").agg(F.sum(taken * F.col(RISK)).alias("fugas_esp"))
    saved = F.least(F.col("fugas_esp"), F.col("k") * plan.success)
    net = saved * plan.ltv - (F.col("k") * plan.call_cost + saved * plan.incentive)
    return sums.select("k", "fugas_esp", net.alias("ganancia_neta")).orderBy("k")


def expected_axes(plan: Campaign) -> dict[str, list[float]]:
    """Fifteen incentives from nothing to twice the plan's, sixteen success rates."""
    return {
        "incentivo": [float(round(i * 2 * plan.incentive / 14)) for i in range(15)],
        "exito": [round(0.05 * j, 2) for j in range(1, 17)],
    }


def grid_expected(base: DataFrame, plan: Campaign) -> DataFrame:
    top, _ = contacts(base, plan.budget)
    sums = top.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(RISK), F.lit(0.0)).alias("fugas_esp"))
    cells = grid(sums, **expected_axes(plan))
    money = _expected(cells, F.lit(float(plan.ltv)), F.lit(float(plan.call_cost)), F.col("incentivo"), F.col("exito"))
    return money.select("incentivo", "exito", "salvados_esp", "costo_esp", "ganancia_neta")
