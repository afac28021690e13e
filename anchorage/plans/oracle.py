"""SQL twins of the derived tables, as common table expressions.

``with_tables(body)`` prefixes the expressions the body mentions, in
dependency order, so every check is one self-contained statement.
"""

from __future__ import annotations

import re

from anchorage.plans.tables import (
    AGE_STAGES,
    CONTRIB_WEIGHTS,
    CYCLES,
    INTERACTIONS,
    KINDS,
    MONTHS,
    MORE_WEIGHTS,
    REGIONS,
    RISK_CUT,
)


def pick(index: str, *levels: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in levels) + f"][({index}) + 1]"


_KIND = pick("l_suppkey % 5", *KINDS)
_PLAN = "CASE WHEN l_linestatus = 'O' THEN 'PAC' ELSE 'PBS' END"
_TAGS = ",\n    ".join(
    f"(count(*) FILTER ({_KIND} || '_' || ({_PLAN}) = '{t}'))::double AS {t}" for t in INTERACTIONS
)
_AGE = "((o_custkey * 7 + o_orderkey) % 104)"

CTE: dict[str, str] = {}

CTE["items"] = f"""
  SELECT l_orderkey, max(l_shipdate)::date AS fin, count(*) AS n_items,
    count(*) FILTER (l_returnflag = 'R') AS n_pac,
    {_TAGS}
  FROM lineitem GROUP BY l_orderkey"""

CTE["spells"] = f"""
  SELECT o_custkey::varchar AS AFILIADO_ID_EPS, o_orderkey AS spell_id,
    o_orderdate::date AS FECHA_INICIO, fin AS FECHA_FIN,
    CASE WHEN o_orderstatus = 'F' THEN 'CANCELADOS' ELSE 'ACTIVOS' END AS FALLA,
    CASE o_orderstatus WHEN 'F' THEN 'CANCELADOS' WHEN 'O' THEN 'ACTIVOS' ELSE ' activo ' END AS grupo_churn,
    r_name AS Regional_Agrupadora, n_name AS nation, c_mktsegment AS PLAN,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'A' WHEN o_orderpriority = '3-MEDIUM' THEN 'B'
         WHEN o_orderpriority = '5-LOW' THEN 'C' END AS NIVEL_INGRESO,
    {pick("o_custkey % 3", "ASEGURADO COLECTIVO", "ASEGURADO FAMILIAR", "TOMADOR FAMILIAR")} AS TIPO_AFILIADO,
    {pick("o_orderkey % 3", "DIGITAL", "PROPIO", "TERCERO")} AS Compania,
    {pick("o_orderkey % 5", "ALIADA", "CONVENIO", "EXCLUSIVA", "PROPIA", "SIN_INFORMACION")} AS TIPO_IPS,
    CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'f' ELSE 'M' END AS Sexo_Cd,
    {_AGE}::double AS EDAD_FECHA_FIN,
    CASE WHEN {_AGE} < 18 THEN '{AGE_STAGES[0]}' WHEN {_AGE} < 30 THEN '{AGE_STAGES[1]}'
         WHEN {_AGE} < 60 THEN '{AGE_STAGES[2]}' WHEN {_AGE} <= 100 THEN '{AGE_STAGES[3]}' END AS SEGMENTO_EDAD,
    CASE WHEN c_acctbal < 0 THEN 'NO' WHEN c_acctbal < 5000 THEN 'SI' ELSE 'SÍ' END AS POLIZA,
    CASE WHEN n_items >= 6 THEN 'ALTA' WHEN n_items >= 3 THEN 'MEDIA' ELSE 'BAJA' END AS CONDICION_SALUD,
    n_pac::double AS Prestaciones_PAC, (n_items - n_pac)::double AS Prestaciones_PBS,
    CASE WHEN o_orderkey % 6 < 4 THEN (o_orderkey % 6)::varchar WHEN o_orderkey % 6 = 4 THEN '-1'
         ELSE 'cluster 7' END AS cluster,
    CASE WHEN o_orderstatus = 'F' THEN {pick("o_orderkey % 4", "MORA", "NO PBS", "OTRAS CAUSAS", "PETICION DEL CLIENTE")}
         ELSE 'NO APLICA' END AS GRUPO_CAUSA_CANCELACION,
    {", ".join(INTERACTIONS)},
    c_acctbal AS INGRESO, round(least(o_totalprice / 500000, 1.0), 6) AS Riesgo_Calculado
  FROM orders LEFT JOIN items ON o_orderkey = l_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey"""

CTE["features"] = (
    "\n  SELECT *, "
    + ", ".join(
        [f"CASE WHEN Regional_Agrupadora = '{r}' THEN 1 ELSE 0 END AS \"Regional_Agrupadora_{r}\"" for r in REGIONS]
        + [f"CASE WHEN SEGMENTO_EDAD = '{a}' THEN 1 ELSE 0 END AS \"SEGMENTO_EDAD_{a}\"" for a in AGE_STAGES]
    )
    + "\n  FROM spells"
)

CTE["last_spells"] = """
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY AFILIADO_ID_EPS
      ORDER BY FECHA_FIN DESC NULLS FIRST, spell_id DESC) AS rn FROM spells) WHERE rn = 1"""

CTE["interactions"] = f"""
  SELECT o_custkey::varchar AS AFILIADO_ID_EPS, l_shipdate::date AS fecha,
    {_KIND} AS tipo, {_PLAN} AS plan
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

CTE["base_risk"] = """
  SELECT c_custkey, ((c_custkey * 7919) % 1000) / 1000.0::double AS risk_12m, c_acctbal FROM customer"""


def survival(m: str) -> str:
    return f"pow(1 - risk_12m, {m} / 12.0::double)"


CTE["permanencia"] = f"""
  SELECT c_custkey::varchar AS AFILIADO_ID_EPS, risk_12m,
    CASE WHEN round(1 - {survival("3")}, 9) >= {RISK_CUT} THEN ' critico '
         WHEN round(1 - {survival("6")}, 9) >= {RISK_CUT} THEN 'ALTO'
         WHEN round(1 - {survival("12")}, 9) >= {RISK_CUT} THEN 'ESTRATEGIA_PROACTIVA' ELSE 'BAJO' END AS grupo_operativo,
    list_min(list_filter(range(1, {MONTHS + 1}), lambda m: round(1 - {survival("m")}, 9) >= {RISK_CUT}))::int
      AS tiempo_gatillo_m,
    unnest(CASE WHEN c_acctbal < 0 THEN [0, 1] ELSE [0] END) AS dup
  FROM base_risk"""

CTE["perm_one"] = "\n  SELECT * FROM permanencia WHERE dup = 0"

CTE["scored"] = """
  SELECT c_custkey AS id, risk_12m AS Probabilidad,
    ((('0x' || substr(md5(c_custkey::varchar), 1, 8))::bigint % 1000) / 1000.0::double < risk_12m)::int AS Es_Fuga_Real,
    ('0x' || substr(md5(c_custkey::varchar), 1, 8))::bigint AS tie
  FROM base_risk"""

CTE["scored_ranked"] = """
  SELECT *, row_number() OVER (ORDER BY Probabilidad DESC NULLS LAST, tie, id) AS rk,
    count(*) OVER () AS n_all FROM scored"""

CTE["wide_features"] = """
  SELECT c_custkey::varchar AS ID, c_acctbal AS ACCT_BAL, NUM_ORDERS, NUM_ITEMS,
    n_pac AS Prestaciones_PAC, n_pbs AS Prestaciones_PBS, risk_12m, 1.0::double AS CONST_BIN
  FROM base_risk LEFT JOIN (
    SELECT o_custkey, count(*)::double AS NUM_ORDERS, sum(n_items)::double AS NUM_ITEMS,
      sum(n_pac)::double AS n_pac, sum(n_items - n_pac)::double AS n_pbs
    FROM orders LEFT JOIN items ON o_orderkey = l_orderkey GROUP BY o_custkey) u ON c_custkey = o_custkey"""

CTE["more_features"] = "\n  SELECT *, " + ", ".join(f"(ID::bigint * {step} % 97) / 10.0::double AS {n}" for n, (step, _) in CYCLES.items()) + " FROM wide_features"


def contributions(table: str, weights: dict[str, float]) -> str:
    cells = "\n  UNION ALL ".join(
        f"SELECT ID, '{f}' AS feature, \"{f}\" AS feature_value, {w}::double AS w FROM {table}" for f, w in weights.items()
    )
    return f"""
  SELECT ID, feature, feature_value,
    round(w * (feature_value - avg(feature_value) OVER (PARTITION BY feature)), 6) AS shap_value
  FROM ({cells}) u"""


CTE["contrib"] = contributions("wide_features", CONTRIB_WEIGHTS)
CTE["contrib_ok"] = "\n  SELECT * FROM contrib WHERE shap_value IS NOT NULL"
CTE["more_contrib"] = contributions("more_features", MORE_WEIGHTS)
CTE["more_contrib_ok"] = "\n  SELECT * FROM more_contrib WHERE shap_value IS NOT NULL"

CTE["complaints"] = """
  SELECT user_id::varchar AS AFILIADO_ID_EPS, ts, event_type AS tipo, value FROM events"""

CTE["campaigns"] = """
  SELECT s_suppkey AS campaign_id,
    CASE WHEN s_suppkey % 5 = 0 THEN 'sin dato' WHEN s_suppkey % 5 = 1 THEN ' ' || money ELSE money END AS ltv,
    CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (s_suppkey % 90 + 1)::varchar || ' 000' END AS call_cost,
    '$ ' || money AS incentive,
    CASE WHEN s_suppkey % 6 = 0 THEN 'NaN' ELSE '0.' || (s_suppkey % 10)::varchar END AS success,
    CASE WHEN s_suppkey % 7 = 0 THEN '-3' WHEN s_suppkey % 7 = 1 THEN 'x' ELSE ((s_suppkey + 1) * 37)::varchar END AS budget
  FROM (SELECT s_suppkey, format('{:,}', round_even(abs(s_acctbal) * 1000, 0)::bigint) AS money FROM supplier) s"""

CTE["active_risk"] = """
  SELECT s.*, p.risk_12m, upper(trim(p.grupo_operativo)) AS grupo_operativo, p.tiempo_gatillo_m
  FROM last_spells s LEFT JOIN perm_one p USING (AFILIADO_ID_EPS)
  WHERE upper(trim(s.grupo_churn)) = 'ACTIVOS'"""

CTE["active_ranked"] = """
  SELECT *, row_number() OVER (ORDER BY risk_12m DESC NULLS LAST,
      ('0x' || substr(md5(AFILIADO_ID_EPS), 1, 8))::bigint, AFILIADO_ID_EPS) AS rk,
    count(*) OVER () AS n_all
  FROM active_risk WHERE risk_12m IS NOT NULL"""

_W = "(12 * (year({e}) - year({s})) + month({e}) - month({s}) - (day({e}) < day({s}))::int)"


def whole_months(start: str, end: str) -> str:
    return _W.format(s=start, e=end)


def months_frac(start: str, end: str) -> str:
    w = whole_months(start, end)
    low = f"({start} + to_months({w}::int))::date"
    high = f"({start} + to_months(({w} + 1)::int))::date"
    return f"greatest({w} + date_diff('day', {low}, {end}) / date_diff('day', {low}, {high})::double, 0)"


CTE["valid"] = f"""
  SELECT *, {months_frac("FECHA_INICIO", "FECHA_FIN")} AS t_m,
    CASE upper(trim(grupo_churn)) WHEN 'CANCELADOS' THEN 1 WHEN 'ACTIVOS' THEN 0 END AS event
  FROM last_spells WHERE FECHA_FIN >= FECHA_INICIO
    AND upper(trim(grupo_churn)) IN ('CANCELADOS', 'ACTIVOS')"""


def with_tables(body: str) -> str:
    """Prefix the common table expressions that the body needs."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        words = set(re.findall(r"[A-Za-z_]+", pending.pop()))
        for name in words & CTE.keys() - needed:
            needed.add(name)
            pending.append(CTE[name])
    heads = [f"{name} AS ({CTE[name]})" for name in CTE if name in needed]
    body = body.strip()
    if not heads:
        return body
    own = body[4:].lstrip() if body.upper().startswith("WITH") else None
    tail = f",\n{own}" if own is not None else f"\n{body}"
    return "WITH " + ",\n".join(heads) + tail
