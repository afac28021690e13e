"""Queries over the risk views and the model checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorage.operators import bins, checks, clean, risk
from anchorage.plans.catalog import query
from anchorage.plans.cleaning import FRICTION_SQL, STAGE_SQL
from anchorage.plans.tables import AGE_STAGES, REGIONS, Tables

R = "Riesgo_Calculado"


def rounded(df, *names, digits: int = 6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def edges_sql(col: str, q: int, table: str) -> str:
    """Distinct quantile edges as a one-row, one-list relation."""
    probs = ", ".join(f"{i}/{q}::double" for i in range(q + 1))
    return f"""(SELECT list_sort(list_distinct(list_transform(quantile_cont({col}, [{probs}]), lambda e: round(e, 9)))) AS e
      FROM {table})"""


def bin_sql(col: str) -> str:
    """0-based right-closed bin of a value among the edges ``e``."""
    inner = f"len(list_filter(e[2:], lambda x: x < {col}))"
    return f"CASE WHEN {col} IS NOT NULL THEN least({inner}, len(e) - 2)::int END"


@query(
    "mean_risk_by_level",
    f"""SELECT NIVEL_INGRESO AS nivel, count(*) AS n, round(avg({R}), 6) AS riesgo,
      (SELECT round(avg({R}), 6) FROM spells) AS riesgo_global FROM spells WHERE NIVEL_INGRESO IS NOT NULL GROUP BY 1""",
)
def mean_risk_by_level(t: Tables):
    return rounded(risk.risk_by_level(t.spells, "NIVEL_INGRESO"), "riesgo", "riesgo_global")


_DRAWS = " + ".join(f"(x >= {cut})::int" for cut in risk.POISSON_CUTS)


@query(
    "risk_by_value",
    f"""WITH base AS (SELECT EDAD_FECHA_FIN AS valor, {R} AS r, spell_id AS id
      FROM spells WHERE EDAD_FECHA_FIN IS NOT NULL AND {R} IS NOT NULL),
    start AS (SELECT valor, r, rep, ('0x' || substr(md5(id || '|' || rep), 1, 8))::bigint AS x
      FROM base, (SELECT unnest(range(1, {risk.REPLICATES} + 1)) AS rep)),
    drawn AS (SELECT valor, rep, r, {_DRAWS} AS w FROM start),
    means AS (SELECT valor, rep, sum(w * r) / sum(w) AS m FROM drawn WHERE w > 0 GROUP BY 1, 2),
    band AS (SELECT valor, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM means GROUP BY 1),
    curve AS (SELECT EDAD_FECHA_FIN AS valor, round(avg({R}), 6) AS riesgo, count(*) AS n,
      round(stddev_samp({R}) / sqrt(count(*)), 6) AS error FROM spells GROUP BY 1)
    SELECT valor, riesgo, n, error, round(lo, 5) AS banda_inf, round(hi, 5) AS banda_sup FROM curve LEFT JOIN band USING (valor)""",
)
def risk_by_value(t: Tables):
    found = rounded(risk.risk_curve_with_band(t.spells, "EDAD_FECHA_FIN", "spell_id"), "riesgo", "error")
    return rounded(found, "banda_inf", "banda_sup", digits=5)


@query(
    "risk_distribution",
    "SELECT CONDICION_SALUD AS nivel, "
    + ", ".join(
        f"round(quantile_cont({R}, {p}), 6) AS {n}"
        for p, n in ((0, "minimo"), (0.25, "q1"), (0.5, "mediana"), (0.75, "q3"), (1, "maximo"))
    )
    + " FROM spells GROUP BY 1",
)
def risk_distribution(t: Tables):
    return rounded(risk.risk_quartiles(t.spells, "CONDICION_SALUD"), "minimo", "q1", "mediana", "q3", "maximo")


@query(
    "risk_by_flags",
    "\nUNION ALL ".join(
        f"SELECT '{r}' AS nivel, round(avg({R}), 6) AS riesgo FROM spells WHERE Regional_Agrupadora = '{r}'" for r in REGIONS
    ),
)
def risk_by_flags(t: Tables):
    flags = t.features.drop("Regional_Agrupadora")
    return rounded(risk.risk_by_flags(flags, "Regional_Agrupadora_"), "riesgo")


@query(
    "segment_contrast",
    f"""SELECT round(avg({R}) FILTER (SEGMENTO_EDAD = '{AGE_STAGES[0]}'), 6) AS jovenes,
      round(avg({R}) FILTER (SEGMENTO_EDAD = '{AGE_STAGES[3]}'), 6) AS mayores FROM spells""",
)
def segment_contrast(t: Tables):
    groups = {"jovenes": F.col(f"SEGMENTO_EDAD_{AGE_STAGES[0]}") == 1, "mayores": F.col(f"SEGMENTO_EDAD_{AGE_STAGES[3]}") == 1}
    return rounded(risk.contrast(t.features, groups), "jovenes", "mayores")


@query(
    "vulnerability_matrix",
    f"""SELECT rango, round(e[rango + 1], 6) AS rango_low, round(e[rango + 2], 6) AS rango_high, """
    + ", ".join(f"round(avg({R}) FILTER (etapa = '{a}'), 6) AS \"{a}\"" for a in AGE_STAGES)
    + f""" FROM (SELECT *, {STAGE_SQL} AS etapa, {bin_sql("INGRESO")} AS rango
        FROM spells, {edges_sql("INGRESO", 10, "spells")} q) b GROUP BY 1, 2, 3""",
)
def vulnerability_matrix(t: Tables):
    staged = clean.life_stage(t.features)
    found = risk.vulnerability_matrix(staged, "INGRESO", "Etapa_Vida", AGE_STAGES)
    return found.select("rango", *[F.round(f"`{n}`", 6).alias(n) for n in ("rango_low", "rango_high", *AGE_STAGES)])


@query(
    "age_income_matrix",
    "SELECT NIVEL_INGRESO, "
    + ", ".join(f"round(avg({R}) FILTER (b = {i}), 6) AS \"{n}\"" for i, n in enumerate(risk.AGE_QUINTILES))
    + f""" FROM (SELECT *, {bin_sql("EDAD_FECHA_FIN")} AS b FROM spells, {edges_sql("EDAD_FECHA_FIN", 5, "spells")} q) x
      WHERE NIVEL_INGRESO IS NOT NULL GROUP BY 1""",
)
def age_income_matrix(t: Tables):
    found = risk.age_income_matrix(t.spells, "EDAD_FECHA_FIN", "NIVEL_INGRESO")
    return rounded(found, *risk.AGE_QUINTILES)


@query(
    "friction_by_health",
    f"""SELECT CONDICION_SALUD, {FRICTION_SQL} AS "TIENE_QUEJAS", round(avg({R}), 6) AS riesgo, count(*) AS n
    FROM spells GROUP BY 1, 2""",
)
def friction_by_health(t: Tables):
    return rounded(risk.risk_interaction(clean.has_complaints(t.spells), "CONDICION_SALUD", "TIENE_QUEJAS"), "riesgo")


@query(
    "region_income_risk",
    f"""SELECT Regional_Agrupadora AS "Region_Activa", NIVEL_INGRESO, round(avg({R}), 6) AS riesgo, count(*) AS n
    FROM spells WHERE NIVEL_INGRESO IS NOT NULL GROUP BY 1, 2""",
)
def region_income_risk(t: Tables):
    named = clean.undummy(t.features.drop("Regional_Agrupadora"), "Regional_Agrupadora_", "Region_Activa")
    return rounded(risk.risk_interaction(named, "Region_Activa", "NIVEL_INGRESO"), "riesgo")


@query(
    "risk_boxplot",
    f"""SELECT count(*) AS n, round(avg(v), 6) AS media, round(q[1], 6) AS q1, round(q[2], 6) AS mediana, round(q[3], 6) AS q3,
      round(q[1] - 1.5 * (q[3] - q[1]), 6) AS cerca_inf, round(q[3] + 1.5 * (q[3] - q[1]), 6) AS cerca_sup,
      count(*) FILTER (v < q[1] - 1.5 * (q[3] - q[1]) OR v > q[3] + 1.5 * (q[3] - q[1])) AS n_fuera
    FROM (SELECT {R} * {R} * {R} * {R} AS v FROM spells) s,
      (SELECT quantile_cont({R} * {R} * {R} * {R}, [0.25, 0.5, 0.75]) AS q FROM spells) k GROUP BY q""",
)
def risk_boxplot(t: Tables):
    skewed = t.spells.select((F.col(R) * F.col(R) * F.col(R) * F.col(R)).alias("v"))
    return rounded(risk.box_stats(skewed, "v"), "media", "q1", "mediana", "q3", "cerca_inf", "cerca_sup")


@query(
    "risk_histogram",
    f"""WITH r AS (SELECT min({R}) AS lo, max({R}) AS hi FROM spells),
    c AS (SELECT least(floor(({R} - lo) / (hi - lo) * 30), 29)::int AS bin, count(*) AS n FROM spells, r GROUP BY 1)
    SELECT b::int AS bin, round(lo + b * ((hi - lo) / 30), 6) AS desde, round(lo + (b + 1) * ((hi - lo) / 30), 6) AS hasta,
      coalesce(n, 0) AS n, 0.35::double AS corte
    FROM (SELECT unnest(range(30)) AS b, lo, hi FROM r) s LEFT JOIN c ON b = bin""",
)
def risk_histogram(t: Tables):
    return rounded(risk.histogram(t.spells, R), "desde", "hasta")


_COUNTED = ("Regional_Agrupadora", "nation", "NIVEL_INGRESO", "EDAD_FECHA_FIN", "INGRESO")


@query(
    "distinct_guard",
    "\nUNION ALL ".join(
        f"""SELECT '{n}' AS variable, count(DISTINCT {n}) AS n, (count(DISTINCT {n}) < 20)::int AS barras,
          (count(DISTINCT {n}) > 20)::int AS en_rangos FROM spells"""
        for n in _COUNTED
    ),
)
def distinct_guard(t: Tables):
    return risk.n_distinct(t.spells, _COUNTED)


@query(
    "quantile_bins",
    f"""SELECT c_custkey, b AS bin, round(e[b + 1], 6) AS bin_low, round(e[b + 2], 6) AS bin_high FROM (
      SELECT *, {bin_sql("c_acctbal")} AS b FROM customer, {edges_sql("c_acctbal", 10, "customer")} q) x""",
)
def quantile_bins(t: Tables):
    rows = t.raw("customer").select("c_custkey", "c_acctbal")
    edges = bins.quantile_edges(rows, F.col("c_acctbal"), 10)
    found = bins.with_bounds(bins.binned(rows, "c_acctbal", edges), edges)
    return rounded(found.drop("c_acctbal"), "bin_low", "bin_high")


@query(
    "risk_by_quantile",
    f"""SELECT rango, round(e[rango + 1], 6) AS rango_low, round(e[rango + 2], 6) AS rango_high, count(*) AS n,
      round(avg({R}), 6) AS riesgo, (SELECT round(avg({R}), 6) FROM spells) AS riesgo_global
    FROM (SELECT *, {bin_sql("Prestaciones_PAC")} AS rango FROM spells, {edges_sql("Prestaciones_PAC", 10, "spells")} q) b
    WHERE rango IS NOT NULL GROUP BY 1, 2, 3""",
)
def risk_by_quantile(t: Tables):
    found = risk.inspect_numeric(t.spells, "Prestaciones_PAC")
    return rounded(found, "rango_low", "rango_high", "riesgo", "riesgo_global")


DECILE_SQL = f"""deciled AS (SELECT *, 10 - {bin_sql("Probabilidad")} AS decil
  FROM scored, {edges_sql("Probabilidad", 10, "scored")} q)"""


@query("risk_deciles", f"WITH {DECILE_SQL} SELECT id, Probabilidad, decil::int AS decil FROM deciled")
def risk_deciles(t: Tables):
    return bins.risk_deciles(t.scored, "Probabilidad").select("id", "Probabilidad", "decil")


@query(
    "rank_deciles",
    """SELECT id, (10 - greatest(ceil((n_all - rk) * 10 / (n_all - 1)) - 1, 0))::int AS decil FROM scored_ranked""",
)
def rank_deciles(t: Tables):
    return bins.rank_deciles(t.scored, "Probabilidad", "id").select("id", "decil")


_LIFT_SQL = f"""WITH {DECILE_SQL},
    d AS (SELECT decil::int AS decil, min(Probabilidad) AS score_min, max(Probabilidad) AS score_max, count(*) AS clientes,
      sum(Es_Fuga_Real)::bigint AS fugas FROM deciled GROUP BY 1)"""


@query(
    "cumulative_capture",
    f"""{_LIFT_SQL} SELECT decil, fugas, sum(fugas) OVER (ORDER BY decil)::bigint AS fugas_acumuladas,
      round(sum(fugas) OVER (ORDER BY decil) * 100.0::double / sum(fugas) OVER (), 6) AS cobertura FROM d""",
)
def cumulative_capture(t: Tables):
    return rounded(checks.cum_capture(t.scored), "cobertura")


@query(
    "lift_table",
    f"""{_LIFT_SQL} SELECT decil, score_min, score_max, clientes, fugas, sum(fugas) OVER (ORDER BY decil)::bigint AS fugas_acumuladas,
      round(sum(fugas) OVER (ORDER BY decil) * 100.0::double / sum(fugas) OVER (), 6) AS cobertura,
      round(fugas / clientes, 6) AS tasa,
      round((fugas / clientes) / (sum(fugas) OVER () / sum(clientes) OVER ()), 6) AS lift FROM d""",
)
def lift_table(t: Tables):
    return rounded(checks.lift(t.scored), "cobertura", "tasa", "lift")


@query(
    "lift_at_pct",
    "\nUNION ALL ".join(
        f"""SELECT {p}::double AS parte, count(*) FILTER (rk <= k) AS n, (sum(Es_Fuga_Real) FILTER (rk <= k))::bigint AS fugas,
      round((sum(Es_Fuga_Real) FILTER (rk <= k) / count(*) FILTER (rk <= k)) / (sum(Es_Fuga_Real) / count(*)), 6) AS lift,
      round(sum(Es_Fuga_Real) FILTER (rk <= k) / sum(Es_Fuga_Real), 6) AS captura
    FROM (SELECT *, ceil({p} * n_all) AS k FROM scored_ranked) s"""
        for p in (0.05, 0.1, 0.2)
    ),
)
def lift_at_pct(t: Tables):
    return rounded(checks.lift_at(t.scored, 0.05, 0.1, 0.2), "lift", "captura")


@query(
    "auc",
    """SELECT round(sum(pos * (before + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc, sum(pos)::bigint AS positivos,
      sum(neg)::bigint AS negativos
    FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY Probabilidad ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT Probabilidad, sum(Es_Fuga_Real) AS pos, sum(1 - Es_Fuga_Real) AS neg FROM scored GROUP BY 1) c) d""",
)
def auc(t: Tables):
    return rounded(checks.auc(t.scored), "auc")


@query("brier", "SELECT round(avg(pow(Probabilidad - Es_Fuga_Real, 2)), 6) AS brier, count(*) AS n FROM scored")
def brier(t: Tables):
    return rounded(checks.brier(t.scored), "brier")


@query(
    "calibration_curve",
    """SELECT least(floor(round(Probabilidad * 10, 9)), 9)::int AS bin, round(avg(Probabilidad), 6) AS media,
      round(avg(Es_Fuga_Real), 6) AS tasa, count(*) AS n FROM scored GROUP BY 1""",
)
def calibration_curve(t: Tables):
    return rounded(checks.calibration(t.scored), "media", "tasa")


@query(
    "strategy_quadrants",
    f"""SELECT CASE WHEN {R} >= 0.35 AND INGRESO >= m THEN 'EMERGENCIA' WHEN INGRESO >= m THEN 'VACAS LECHERAS'
        WHEN {R} >= 0.35 THEN 'DEJAR IR' ELSE 'RESTO' END AS cuadrante, count(*) AS n, round(avg({R}), 6) AS riesgo
    FROM spells, (SELECT quantile_cont(INGRESO, 0.5) AS m FROM spells) k GROUP BY 1""",
)
def strategy_quadrants(t: Tables):
    return rounded(risk.quadrants(t.spells, "INGRESO"), "riesgo")
