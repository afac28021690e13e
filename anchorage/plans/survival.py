"""Queries over survival curves and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorage.operators import clean, survival
from anchorage.operators.portfolio import lump
from anchorage.plans.catalog import query
from anchorage.plans.oracle import survival as survival_sql
from anchorage.plans.portfolio import LUMP_SQL, book
from anchorage.plans.risk import rounded
from anchorage.plans.tables import MONTHS, Tables

_LUMPED = f"""{LUMP_SQL}, lumped AS (SELECT *, CASE WHEN nation IN (SELECT k FROM kept) THEN nation ELSE 'OTROS' END AS grupo FROM valid)"""

_KM = f"""{_LUMPED},
    counts AS (SELECT grupo, t_m AS t, sum(event) AS d, count(*) AS m FROM lumped GROUP BY 1, 2),
    risks AS (SELECT *, sum(m) OVER (PARTITION BY grupo ORDER BY t DESC) AS n_risk, sum(m) OVER (PARTITION BY grupo) AS n FROM counts),
    curve AS (SELECT grupo, t, n, product(1 - d / n_risk) OVER (PARTITION BY grupo ORDER BY t) AS S_t FROM risks)"""


def curve(t: Tables):
    return survival.km(book(t), "nation")


@query(
    "kaplan_meier",
    f"""WITH {_KM} SELECT grupo, round(t, 6) AS t, round(S_t, 6) AS "S_t", round(1 - S_t, 6) AS risk_t, n::bigint AS n FROM curve""",
)
def kaplan_meier(t: Tables):
    return rounded(curve(t), "t", "S_t", "risk_t")


@query(
    "attach_group_n",
    f"""WITH {_LUMPED} SELECT grupo, mes, m, n FROM (SELECT grupo, floor(t_m)::int AS mes, count(*) AS m FROM lumped GROUP BY 1, 2) c
    LEFT JOIN (SELECT grupo, count(*) AS n FROM lumped GROUP BY 1) s USING (grupo)""",
)
def attach_group_n(t: Tables):
    rows = clean.valid_spells(lump(book(t), "nation")).select("grupo", F.floor("t_m").cast("int").alias("mes"))
    monthly = rows.groupBy("grupo", "mes").agg(F.count(F.lit(1)).alias("m"))
    return survival.attach_group_n(monthly, survival.group_sizes(rows, "grupo"), "grupo")


_AT = "\nUNION ALL ".join(
    f"SELECT grupo, {h} AS horizonte, 1 - coalesce(arg_max(S_t, t) FILTER (t <= {h}), 1) AS riesgo FROM curve GROUP BY grupo"
    for h in survival.HORIZONS
)


@query("survival_at", f"WITH {_KM} SELECT grupo, horizonte, round(riesgo, 6) AS riesgo FROM ({_AT}) a")
def survival_at(t: Tables):
    return rounded(survival.risk_at(curve(t)), "riesgo")


@query(
    "horizon_table",
    f"""WITH {_KM} SELECT grupo, horizonte, round(riesgo, 6) AS riesgo,
      (corte + round_even(30.4375::double * horizonte, 0)::int)::date AS fecha
    FROM ({_AT}) a, (SELECT max(FECHA_FIN) AS corte FROM last_spells) k""",
)
def horizon_table(t: Tables):
    last_day = book(t).agg(F.max("FECHA_FIN")).scalar()
    return rounded(survival.horizon_table(curve(t), last_day), "riesgo")


@query(
    "curve_long",
    f"""SELECT AFILIADO_ID_EPS, m::int AS t, round({survival_sql("m")}, 6) AS "S_t", round(1 - {survival_sql("m")}, 6) AS risk_t
    FROM perm_one, (SELECT unnest(range(1, {MONTHS + 1})) AS m) g""",
)
def curve_long(t: Tables):
    one = t.permanencia_dealt.where(F.col("dup") == 0)
    return rounded(survival.curve_long(one), "S_t", "risk_t")


@query(
    "mean_curve",
    f"""SELECT m::int AS t, round(avg({survival_sql("m")}), 6) AS "S_t"
    FROM perm_one, (SELECT unnest(range(1, {MONTHS + 1})) AS m) g GROUP BY 1""",
)
def mean_curve(t: Tables):
    return rounded(survival.mean_curve(t.permanencia.where(F.col("dup") == 0)), "S_t")


@query(
    "hazard_by_month",
    """SELECT mes, n_risk::bigint AS en_riesgo, d::bigint AS eventos, round(d / n_risk, 6) AS hazard FROM (
      SELECT *, sum(m) OVER (ORDER BY mes DESC) AS n_risk FROM (
        SELECT floor(t_m)::int AS mes, sum(event) AS d, count(*) AS m FROM valid GROUP BY 1) c) r""",
)
def hazard_by_month(t: Tables):
    return rounded(survival.life_table(clean.valid_spells(book(t))), "hazard")


@query(
    "hazard_by_window",
    "\nUNION ALL ".join(
        f"""SELECT '{label}' AS ventana, coalesce(sum(event) FILTER (t_m >= {low} AND t_m < {high or 1e9}), 0)::bigint AS eventos,
      round(sum(greatest(least(t_m, {high or 1e9}) - {low}, 0)), 4) AS meses_persona,
      round(coalesce(sum(event) FILTER (t_m >= {low} AND t_m < {high or 1e9}), 0)
        / sum(greatest(least(t_m, {high or 1e9}) - {low}, 0)), 6) AS hazard FROM valid"""
        for low, high, label in survival.WINDOWS
    ),
)
def hazard_by_window(t: Tables):
    found = survival.window_hazard(clean.valid_spells(book(t)))
    return found.withColumns({"meses_persona": F.round("meses_persona", 4), "hazard": F.round("hazard", 6)})


@query(
    "operational_group_rule",
    """SELECT AFILIADO_ID_EPS, upper(trim(grupo_operativo)) AS grupo, tiempo_gatillo_m AS mes_gatillo FROM perm_one""",
)
def operational_group_rule(t: Tables):
    return survival.assign_group(t.permanencia_dealt.where(F.col("dup") == 0))


@query(
    "c_index",
    """WITH p AS (SELECT sum(n) FILTER (r > r2) AS c, coalesce(sum(n) FILTER (r = r2), 0) AS e, sum(n) AS a FROM (
        SELECT x.r, y.r AS r2, count(*) AS n
        FROM (SELECT t_m, event, Riesgo_Calculado AS r FROM valid WHERE Riesgo_Calculado IS NOT NULL) x
        JOIN (SELECT t_m, Riesgo_Calculado AS r FROM valid WHERE Riesgo_Calculado IS NOT NULL) y ON x.t_m < y.t_m
        WHERE x.event = 1 GROUP BY 1, 2) q)
    SELECT c::double AS concordantes, e::double AS empates, a::double AS comparables, round((c + e / 2) / a, 6) AS c_index FROM p""",
)
def c_index(t: Tables):
    return rounded(survival.c_index(clean.valid_spells(book(t)), "t_m", "event", "Riesgo_Calculado"), "c_index")


_STACKED = ("PLAN", "CONDICION_SALUD")
_STRATA = "\nUNION ALL ".join(
    f"""SELECT '{v}' AS variable, {v} AS grupo, t_m AS t, sum(event) AS d, count(*) AS m FROM valid GROUP BY 1, 2, 3""" for v in _STACKED
)


@query(
    "stack_strata",
    f"""SELECT variable, grupo, round(t, 6) AS t, round(s, 6) AS "S_t", round(1 - s, 6) AS risk_t, n::bigint AS n FROM (
      SELECT *, product(1 - d / n_risk) OVER (PARTITION BY variable, grupo ORDER BY t) AS s FROM (
        SELECT *, sum(m) OVER (PARTITION BY variable, grupo ORDER BY t DESC) AS n_risk,
          sum(m) OVER (PARTITION BY variable, grupo) AS n FROM ({_STRATA}) a) b) c""",
)
def stack_strata(t: Tables):
    return rounded(survival.stack_curves(book(t), _STACKED), "t", "S_t", "risk_t")
