"""Queries over rankings, campaigns and scenarios."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from anchorage.operators import impact
from anchorage.operators.prefix import top_n as take_top
from anchorage.operators.ranking import ranking
from anchorage.plans.catalog import query
from anchorage.plans.cleaning import CAMPAIGN_SQL, clean_campaigns
from anchorage.plans.portfolio import active_risk
from anchorage.plans.risk import rounded
from anchorage.plans.tables import Tables
from anchorage.session import scratch_path
from anchorage.sources.readers import write_lists

PLAN = impact.Campaign()
DASHBOARD = impact.Campaign(ltv=720_000)
ID = impact.ID


def base(t: Tables):
    return impact.impact_base(active_risk(t))


# -- rankings --------------------------------------------------------------


@query(
    "risk_ranking",
    """SELECT AFILIADO_ID_EPS, riesgo, printf('%.2f%%', riesgo * 100) AS probabilidad, FECHA_INICIO, TIPO_AFILIADO, PLAN
    FROM (SELECT *, risk_12m AS riesgo, row_number() OVER (ORDER BY risk_12m DESC NULLS LAST,
      ('0x' || substr(md5(AFILIADO_ID_EPS), 1, 8))::bigint, AFILIADO_ID_EPS) AS page_rank FROM active_risk) r
    WHERE page_rank > 20 AND page_rank <= 45""",
)
def risk_ranking(t: Tables):
    return ranking(active_risk(t), ["TIPO_AFILIADO", "PLAN"], limit=25, offset=20)


@query("top_n_risk", "SELECT id, Probabilidad, Es_Fuga_Real FROM scored_ranked WHERE rk <= 500")
def top_n_risk(t: Tables):
    return take_top(t.scored, 500, "Probabilidad", "id")


# -- backtest --------------------------------------------------------------

_P = f"{PLAN.contact_cost}::double"


def roi_sql(where: str) -> str:
    return f"""SELECT gestionados, fugas_reales, trunc(fugas_reales * 0.3::double)::bigint AS salvados,
      gestionados * {_P} AS inversion, trunc(fugas_reales * 0.3::double) * {PLAN.ltv} - gestionados * {_P} AS ganancia,
      trunc(fugas_reales * 0.3::double) * {PLAN.ltv} AS retorno,
      round((trunc(fugas_reales * 0.3::double) * {PLAN.ltv} - gestionados * {_P}) / (gestionados * {_P}) * 100, 6) AS roi_pct
    FROM (SELECT count(*) AS gestionados, sum(Es_Fuga_Real)::bigint AS fugas_reales FROM scored_ranked WHERE {where}) s"""


@query("roi_top_n", roi_sql("rk <= 10000"))
def roi_top_n(t: Tables):
    return rounded(impact.roi(t.scored, PLAN, top=PLAN.budget), "roi_pct")


@query("roi_top_300", roi_sql("rk <= 300"))
def roi_top_300(t: Tables):
    return rounded(impact.roi(t.scored, PLAN, top=300), "roi_pct")


@query("roi_threshold", roi_sql("Probabilidad >= 0.35"))
def roi_threshold(t: Tables):
    return rounded(impact.roi(t.scored, PLAN, threshold=0.35), "roi_pct")


_CURVE = f"""curve AS (SELECT round(u, 6) AS umbral, count(id) AS gestionados, coalesce(sum(Es_Fuga_Real), 0)::bigint AS fugas_reales,
    trunc(coalesce(sum(Es_Fuga_Real), 0) * 0.3::double) * {PLAN.ltv} - count(id) * {_P} AS ganancia
  FROM (SELECT unnest([{", ".join(f"{u!r}::double" for u in impact.thresholds())}]) AS u) t
  LEFT JOIN scored ON Probabilidad >= u GROUP BY u)"""


@query("profit_curve_threshold", f"WITH {_CURVE} SELECT * FROM curve")
def profit_curve_threshold(t: Tables):
    return rounded(impact.threshold_curve(t.scored, PLAN), "umbral")


@query("best_threshold", f"WITH {_CURVE} SELECT * FROM curve ORDER BY ganancia DESC, umbral LIMIT 1")
def best_threshold(t: Tables):
    return rounded(impact.best_threshold(t.scored, PLAN), "umbral")


# The grid of incentives and success rates.
INCENTIVES = (50_000, 100_000, 150_000, 180_000, 250_000, 300_000)
RATES = (0.10, 0.20, 0.30, 0.40, 0.50)


def grid_sql(budget: int) -> str:
    return f"""SELECT incentivo, exito, round((trunc(y * exito) * {PLAN.ltv} - n * ({PLAN.call_cost} + incentivo)::double) / 1e6, 6)
      AS ganancia_millones
    FROM (SELECT count(*) AS n, sum(Es_Fuga_Real) AS y FROM scored_ranked WHERE rk <= {budget}) s,
      (SELECT unnest({list(INCENTIVES)}) AS incentivo) a,
      (SELECT unnest([{", ".join(f"{r}::double" for r in RATES)}]) AS exito) b"""


@query("sensitivity_backtest", grid_sql(PLAN.budget))
def sensitivity_backtest(t: Tables):
    return rounded(impact.grid_backtest(t.scored, PLAN, INCENTIVES, RATES), "ganancia_millones")


@query("sensitivity_backtest_300", grid_sql(300))
def sensitivity_backtest_300(t: Tables):
    return rounded(impact.grid_backtest(t.scored, replace(PLAN, budget=300), INCENTIVES, RATES), "ganancia_millones")


@query("ab_split_300", """SELECT id, Probabilidad, Es_Fuga_Real, CASE WHEN ('0x' || substr(md5(id::varchar), 1, 8))::bigint % 100 < 80
      THEN 'TRATAMIENTO (Llamar)' ELSE 'CONTROL (No Llamar)' END AS "Grupo" FROM scored_ranked WHERE rk <= 300""")
def ab_split_300(t: Tables):
    return impact.ab_split(t.scored, 300)


_SPLIT = """SELECT id, Probabilidad, Es_Fuga_Real, CASE WHEN ('0x' || substr(md5(id::varchar), 1, 8))::bigint % 100 < 80
      THEN 'TRATAMIENTO (Llamar)' ELSE 'CONTROL (No Llamar)' END AS "Grupo" FROM scored_ranked WHERE rk <= 10000"""


@query("ab_split", _SPLIT)
def ab_split(t: Tables):
    return impact.ab_split(t.scored, PLAN.budget)


@query("ab_export", _SPLIT)
def ab_export(t: Tables):
    path = scratch_path(t.spark, "ab-lists")
    write_lists(impact.ab_split(t.scored, PLAN.budget), path)
    schema = "id BIGINT, Probabilidad DOUBLE, Es_Fuga_Real INT, Grupo STRING"
    return t.spark.read.csv(path, header=True, schema=schema)


@query(
    "intervention_scenarios",
    "\nUNION ALL ".join(
        f"""SELECT {p}::double AS parte, count(*) AS gestionados, sum(Es_Fuga_Real)::bigint AS fugas_reales,
      round(sum(Probabilidad), 4) AS fugas_esp,
      trunc(sum(Es_Fuga_Real) * 0.3::double) * {PLAN.ltv} - count(*) * {_P} AS ganancia_real,
      round(sum(Probabilidad) * 0.3 * {PLAN.ltv} - (count(*) * {PLAN.call_cost} + sum(Probabilidad) * 0.3 * {PLAN.incentive}), 4)
        AS ganancia_esp
    FROM scored_ranked WHERE rk <= ceil({p} * n_all)"""
        for p in (0.05, 0.1, 0.2)
    ),
)
def intervention_scenarios(t: Tables):
    found = impact.scenarios(t.scored, PLAN, (0.05, 0.1, 0.2))
    return found.withColumns({"fugas_esp": F.round("fugas_esp", 4), "ganancia_esp": F.round("ganancia_esp", 4)})


# -- expected value --------------------------------------------------------


@query(
    "impact_base",
    """SELECT AFILIADO_ID_EPS, spell_id, risk_12m FROM active_risk
    WHERE risk_12m IS NOT NULL AND trim(Compania) = 'PROPIO' AND trim(NIVEL_INGRESO) = 'A'""",
)
def impact_base(t: Tables):
    chosen = impact.impact_base(active_risk(t), {"Compania": "PROPIO", "PLAN": "TODOS"}, {"NIVEL_INGRESO": "A"})
    return chosen.select(ID, "spell_id", "risk_12m")


def kpi_sql(source: str, ltv: str, call: str, incentive: str, success: str, keep: str) -> str:
    """Expected-value columns over rows of (n, fugas_esp)."""
    return f"""SELECT {keep}, n, round(fugas_esp, 4) AS fugas_esp, round(fugas_esp * {success}, 5) AS salvados_esp,
      round(fugas_esp * {success} * {ltv}, 4) AS retorno_esp, (n * {call})::double AS costo_llamadas,
      round(fugas_esp * {success} * {incentive}, 4) AS costo_incentivos,
      round(n * {call} + fugas_esp * {success} * {incentive}, 4) AS costo_esp,
      round(fugas_esp * {success} * {ltv} - (n * {call} + fugas_esp * {success} * {incentive}), 4) AS ganancia_neta,
      CASE WHEN n * {call} + fugas_esp * {success} * {incentive} > 0
        THEN round((fugas_esp * {success} * {ltv} - (n * {call} + fugas_esp * {success} * {incentive}))
          / (n * {call} + fugas_esp * {success} * {incentive}), 6) END AS roi
    FROM {source}"""


def money_rounded(df):
    # The products carry four decimals, so four digits never meet an exact half.
    digits = {"fugas_esp": 4, "salvados_esp": 5, "roi": 6}
    digits |= {n: 4 for n in ("retorno_esp", "costo_incentivos", "costo_esp", "ganancia_neta")}
    return df.withColumns({n: F.round(n, d) for n, d in digits.items() if n in df.columns})


@query(
    "impact_kpis",
    f"""WITH p AS ({CAMPAIGN_SQL}), z AS (SELECT count(*) AS total FROM active_ranked),
    q AS (SELECT campaign_id, ltv, call_cost, incentive, success, least(coalesce(budget, least(100, total)), total)::bigint AS n
      FROM p, z),
    s AS (SELECT q.*, (SELECT sum(risk_12m) FROM active_ranked WHERE rk <= q.n) AS fugas_esp FROM q)
    {kpi_sql("s", "ltv", "call_cost", "incentive", "success", "campaign_id")}""",
)
def impact_kpis(t: Tables):
    return money_rounded(impact.impact(base(t), clean_campaigns(t)))


FEW = replace(DASHBOARD, budget=150)


def top_sql(plan: impact.Campaign) -> str:
    return f"""tops AS (SELECT count(*) AS n, sum(risk_12m) AS fugas_esp, avg(risk_12m) AS prob_media, max(n_all) AS activos
  FROM active_ranked WHERE rk <= {plan.budget})"""


def impact_sql(plan: impact.Campaign) -> str:
    keep = "activos, round(prob_media, 6) AS prob_media"
    metrics = "\nUNION ALL ".join(
        f"SELECT {i + 1} AS orden, '{m}' AS metrica, {m}::double AS valor FROM k" for i, m in enumerate(impact.METRICS)
    )
    return f"WITH {top_sql(plan)}, k AS ({kpi_sql('tops', str(plan.ltv), str(plan.call_cost), str(plan.incentive), '0.3', keep)})\n{metrics}"


def impact_rows(t: Tables, plan: impact.Campaign):
    exact = F.col("metrica").isin("prob_media", "roi")
    v = F.col("valor")
    return impact.impact_table(base(t), plan).withColumn("valor", F.when(exact, F.round(v, 6)).otherwise(F.round(v, 4)))


@query("impact_table", impact_sql(DASHBOARD))
def impact_table(t: Tables):
    return impact_rows(t, DASHBOARD)


@query("impact_table_150", impact_sql(FEW))
def impact_table_150(t: Tables):
    return impact_rows(t, FEW)


_POINTS = """z AS (SELECT count(*) AS filas FROM active_ranked),
    y AS (SELECT filas, least({n}, filas) AS n FROM z),
    x AS (SELECT filas, n, CASE WHEN n < 10 THEN least(100, filas) ELSE n END AS m FROM y),
    points AS (SELECT DISTINCT k FROM (
      SELECT round_even(50 + i * (m - 50) / 24.0::double, 0)::bigint AS k, filas FROM x, (SELECT unnest(range(25)) AS i) g
      UNION ALL SELECT n::bigint, filas FROM x) u WHERE k > 0 AND k <= filas)"""


@query("profit_points", f"WITH {_POINTS.format(n=PLAN.budget)} SELECT k FROM points")
def profit_points(t: Tables):
    return impact.curve_points(base(t), PLAN.budget)


@query("profit_points_300", f"WITH {_POINTS.format(n=300)} SELECT k FROM points")
def profit_points_300(t: Tables):
    return impact.curve_points(base(t), 300)


def curve_sql(plan: impact.Campaign) -> str:
    return f"""WITH {_POINTS.format(n=plan.budget)},
    s AS (SELECT k, sum(risk_12m) AS f FROM points JOIN active_ranked ON rk <= k GROUP BY k)
    SELECT k, round(f, 4) AS fugas_esp, round(least(f, k * 0.3) * {plan.ltv}
      - (k * {plan.call_cost} + least(f, k * 0.3) * {plan.incentive}), 4) AS ganancia_neta FROM s"""


@query("profit_curve_n", curve_sql(DASHBOARD))
def profit_curve_n(t: Tables):
    return money_rounded(impact.profit_by_n(base(t), DASHBOARD))


@query("profit_curve_150", curve_sql(FEW))
def profit_curve_150(t: Tables):
    return money_rounded(impact.profit_by_n(base(t), FEW))


@query("profit_curve_no_budget", curve_sql(replace(DASHBOARD, budget=impact.DEFAULT_CONTACTS)))
def profit_curve_no_budget(t: Tables):
    """A budget of zero takes the default number of contacts."""
    return money_rounded(impact.profit_by_n(base(t), replace(DASHBOARD, budget=0)))


_AXES = impact.expected_axes(DASHBOARD)


def axis_sql(name: str) -> str:
    return f"(SELECT unnest([{', '.join(f'{v}::double' for v in _AXES[name])}]) AS {name}) {name}_axis"


def expected_sql(plan: impact.Campaign) -> str:
    return f"""WITH {top_sql(plan)} SELECT incentivo, exito, round(fugas_esp * exito, 5) AS salvados_esp,
      round(n * {plan.call_cost} + fugas_esp * exito * incentivo, 5) AS costo_esp,
      round(fugas_esp * exito * {plan.ltv} - (n * {plan.call_cost} + fugas_esp * exito * incentivo), 5) AS ganancia_neta
    FROM tops, {axis_sql("incentivo")}, {axis_sql("exito")}"""


# Success rates with two decimals give products with five.
@query("sensitivity_expected", expected_sql(DASHBOARD))
def sensitivity_expected(t: Tables):
    return rounded(impact.grid_expected(base(t), DASHBOARD), "salvados_esp", "costo_esp", "ganancia_neta", digits=5)


@query("sensitivity_expected_150", expected_sql(FEW))
def sensitivity_expected_150(t: Tables):
    return rounded(impact.grid_expected(base(t), FEW), "salvados_esp", "costo_esp", "ganancia_neta", digits=5)


@query(
    "scenario_cross",
    """SELECT filas, riesgo_total, incentivo, exito FROM (SELECT count(*) AS filas, round(sum(risk_12m), 4) AS riesgo_total
      FROM active_ranked) s, (SELECT unnest([0, 90000, 180000]) AS incentivo) a,
      (SELECT unnest([0.1::double, 0.3::double, 0.5::double, 0.7::double]) AS exito) b""",
)
def scenario_cross(t: Tables):
    row = base(t).agg(F.count(F.lit(1)).alias("filas"), F.round(F.sum("risk_12m"), 4).alias("riesgo_total"))
    return impact.grid(row, incentivo=(0, 90_000, 180_000), exito=(0.1, 0.3, 0.5, 0.7))
