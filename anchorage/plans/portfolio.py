"""Queries over the portfolio views, joins and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorage.operators import clean, integrate, portfolio
from anchorage.plans.catalog import query
from anchorage.plans.cleaning import CLUSTER_SQL, GROUP_SQL, PQRS_SQL, USAGE_SQL, band_sql
from anchorage.plans.oracle import whole_months
from anchorage.plans.tables import INTERACTIONS, KINDS, PLANS, Tables
from anchorage.sources import readers
from anchorage.session import scratch_path

ID = "AFILIADO_ID_EPS"
CANCEL_SQL = "(FALLA = 'CANCELADOS')::int"


def book(t: Tables):
    """The prepared portfolio: last spell per affiliate with status, totals and bands."""
    return clean.add_metrics(clean.last_spell(t.spells))


def active_risk(t: Tables):
    perm = clean.first_per_id(t.permanencia.select(ID, "dup", *integrate.RISK_COLUMNS), ID, "dup")
    return integrate.with_risk(portfolio.active_only(clean.last_spell(t.spells)), perm)


# -- sources ---------------------------------------------------------------


def comma(col):
    return F.replace(F.format_string("%.1f", col), F.lit("."), F.lit(","))


@query(
    "read_spells_csv",
    """SELECT AFILIADO_ID_EPS, spell_id::varchar AS spell_id, FECHA_INICIO, FECHA_FIN, EDAD_FECHA_FIN + 0.5 AS EDAD_FECHA_FIN,
      Prestaciones_PAC, FALLA, NIVEL_INGRESO, 'says "hi";' || chr(10) || FALLA AS "note; free, text" FROM spells""",
)
def read_spells_csv(t: Tables):
    path = scratch_path(t.spark, "spells-csv")
    text = t.spells.select(
        F.col(ID).alias(f" {ID}"),
        "spell_id",
        F.date_format("FECHA_INICIO", "dd/MM/yy").alias("FECHA_INICIO "),
        F.date_format("FECHA_FIN", "yyyy-MM-dd").alias("FECHA_FIN"),
        comma(F.col("EDAD_FECHA_FIN") + 0.5).alias("EDAD_FECHA_FIN"),
        comma(F.col("Prestaciones_PAC")).alias("Prestaciones_PAC"),
        "FALLA",
        "NIVEL_INGRESO",
        F.concat_ws(";\n", F.lit('says "hi"'), "FALLA").alias("note; free, text"),
    )
    text.write.csv(path, sep=";", header=True, nullValue="NA", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_spells(t.spark, path, multi_line=True)


@query("read_permanence_parquet", "SELECT AFILIADO_ID_EPS, risk_12m, tiempo_gatillo_m FROM permanencia WHERE dup = 0")
def read_permanence_parquet(t: Tables):
    path = scratch_path(t.spark, "permanence")
    numbered = t.permanencia.withColumn(ID, F.col(ID).cast("bigint"))
    numbered.select(ID, "risk_12m", "tiempo_gatillo_m", "dup").write.parquet(path)
    return readers.read_permanence(t.spark, path, ["dup"]).select(ID, "risk_12m", "tiempo_gatillo_m")


@query("read_contrib", "SELECT ID, feature, shap_value, feature_value FROM contrib_ok")
def read_contrib(t: Tables):
    from anchorage.plans.explain import raw_contributions

    path = scratch_path(t.spark, "contrib-csv")
    raw_contributions(t).select("ID", "feature", "shap_value", "feature_value").write.csv(path, header=True)
    return readers.read_contrib(t.spark, f"{path}-absent", path)


@query("read_features", "SELECT Prestaciones_PBS, INGRESO, EDAD_FECHA_FIN FROM spells")
def read_features(t: Tables):
    path = scratch_path(t.spark, "features-csv")
    wide = t.spells.select(F.col("spell_id").alias(readers.INDEX_COLUMN), "EDAD_FECHA_FIN", "INGRESO", "Prestaciones_PBS")
    wide.write.csv(path, header=True)
    return readers.read_features(t.spark, path, ["Prestaciones_PBS", "INGRESO", "EDAD_FECHA_FIN"])


# -- filters ---------------------------------------------------------------


@query(
    "filter_portfolio",
    """SELECT AFILIADO_ID_EPS, spell_id, risk_12m FROM active_risk
    WHERE trim(PLAN) = 'BUILDING' AND trim(POLIZA) = 'SI' AND grupo_operativo = 'CRITICO'""",
)
def filter_portfolio(t: Tables):
    chosen = {
        "PLAN": "BUILDING ",
        "POLIZA": "SI",
        "TIPO_IPS": "TODOS",
        "NO_SUCH": "x",
        "NIVEL_INGRESO": None,
        "grupo_operativo": "critico",
    }
    return portfolio.apply_filters(active_risk(t), chosen).select(ID, "spell_id", "risk_12m")


@query(
    "filter_choices",
    "\nUNION ALL ".join(
        f"SELECT DISTINCT '{n}' AS variable, {'FALLA' if n == 'ESTADO' else n} AS valor FROM last_spells "
        f"WHERE {'FALLA' if n == 'ESTADO' else n} IS NOT NULL"
        for n in portfolio.FILTERS
    ),
)
def filter_choices(t: Tables):
    return portfolio.filter_choices(book(t))


@query("active_only", "SELECT AFILIADO_ID_EPS, spell_id FROM last_spells WHERE upper(trim(grupo_churn)) = 'ACTIVOS'")
def active_only(t: Tables):
    return portfolio.active_only(clean.last_spell(t.spells)).select(ID, "spell_id")


@query("affiliate_lookup", "SELECT AFILIADO_ID_EPS, spell_id, PLAN FROM spells WHERE AFILIADO_ID_EPS = '77'")
def affiliate_lookup(t: Tables):
    return portfolio.lookup(t.spells, " 77 ").select(ID, "spell_id", "PLAN")


# -- joins -----------------------------------------------------------------


@query("join_permanence", "SELECT AFILIADO_ID_EPS, spell_id, risk_12m, grupo_operativo, tiempo_gatillo_m FROM active_risk")
def join_permanence(t: Tables):
    return active_risk(t).select(ID, "spell_id", *integrate.RISK_COLUMNS)


def per_affiliate(events, prefix: str):
    return events.groupBy(ID).agg(
        F.count(F.lit(1)).alias(f"{prefix}_n"), F.count(F.when(F.col("tipo").isin("error", "Queja"), 1)).alias(f"{prefix}_quejas")
    )


@query(
    "integrate_sources",
    """SELECT spell_id, s.AFILIADO_ID_EPS, coalesce(u.n, 0) AS usage_n, coalesce(u.q, 0) AS usage_quejas,
      coalesce(m.n, 0) AS crm_n, coalesce(m.q, 0) AS crm_quejas
    FROM spells s
    LEFT JOIN (SELECT AFILIADO_ID_EPS, count(*) AS n, count(*) FILTER (tipo = 'error') AS q FROM complaints GROUP BY 1) u
      ON s.AFILIADO_ID_EPS = u.AFILIADO_ID_EPS
    LEFT JOIN (SELECT AFILIADO_ID_EPS, count(*) AS n, count(*) FILTER (tipo = 'Queja') AS q FROM interactions GROUP BY 1) m
      ON s.AFILIADO_ID_EPS = m.AFILIADO_ID_EPS""",
)
def integrate_sources(t: Tables):
    joined = integrate.integrate(
        t.spells.select("spell_id", ID), per_affiliate(t.complaints, "usage"), per_affiliate(t.interactions, "crm")
    )
    return joined.select("spell_id", ID, "usage_n", "usage_quejas", "crm_n", "crm_quejas")


@query(
    "window_aligned_counts",
    """SELECT spell_id, """
    + ", ".join(f"count(*) FILTER (tipo || '_' || plan = '{n}') AS {n}" for n in INTERACTIONS)
    + """ FROM (SELECT spell_id, AFILIADO_ID_EPS, FECHA_INICIO,
        coalesce(FECHA_FIN, (SELECT greatest(max(FECHA_FIN), max(FECHA_INICIO)) FROM spells)) AS fin FROM spells) s
      LEFT JOIN (SELECT AFILIADO_ID_EPS AS a, fecha, tipo, plan FROM interactions) i
        ON a = AFILIADO_ID_EPS AND fecha BETWEEN FECHA_INICIO AND fin GROUP BY spell_id""",
)
def window_aligned_counts(t: Tables):
    base = t.spells.select("spell_id", ID, "FECHA_INICIO", "FECHA_FIN")
    cutoff = base.agg(F.greatest(F.max("FECHA_FIN"), F.max("FECHA_INICIO"))).scalar()
    found = integrate.counts_in_window(base, t.interactions, KINDS, PLANS, F.coalesce(F.col("FECHA_FIN"), cutoff))
    return found.select("spell_id", *INTERACTIONS)


@query(
    "recency_features",
    f"""WITH ref_day AS (SELECT max(ts)::date AS d FROM complaints),
    l AS (SELECT AFILIADO_ID_EPS AS a, max(ts)::date AS ult, max(ts) FILTER (tipo = 'error')::date AS queja, count(*) AS n
      FROM complaints GROUP BY 1),
    m AS (SELECT s.AFILIADO_ID_EPS, d, ult, queja, coalesce(n, 0) AS usos,
        greatest({whole_months("FECHA_INICIO", "d")}, 0)::int AS antiguedad_m
      FROM last_spells s CROSS JOIN ref_day LEFT JOIN l ON a = s.AFILIADO_ID_EPS)
    SELECT AFILIADO_ID_EPS, antiguedad_m, CASE WHEN antiguedad_m >= 24 THEN '[24,inf)' WHEN antiguedad_m >= 18 THEN '[18,24)'
        WHEN antiguedad_m >= 12 THEN '[12,18)' WHEN antiguedad_m >= 6 THEN '[6,12)' ELSE '[0,6)' END AS tramo,
      CASE WHEN queja IS NOT NULL THEN greatest({whole_months("queja", "d")}, 0)::int END AS meses_desde_queja,
      date_diff('day', ult, d)::int AS dias_inactivo, usos,
      round(usos / nullif(antiguedad_m, 0)::double, 6) AS uso_por_mes FROM m""",
)
def recency_features(t: Tables):
    asof = t.complaints.agg(F.max("ts").cast("date")).scalar()
    found = integrate.recency(clean.last_spell(t.spells), t.complaints, "error", asof)
    return found.withColumn("uso_por_mes", F.round("uso_por_mes", 6))


# -- portfolio views -------------------------------------------------------


@query(
    "level_metrics",
    f"""SELECT Regional_Agrupadora AS nivel, count(*) AS afiliados, round(avg({CANCEL_SQL}), 6) AS tasa_cancel
    FROM last_spells WHERE Regional_Agrupadora <> '' GROUP BY 1""",
)
def level_metrics(t: Tables):
    found = portfolio.level_metrics(book(t), "Regional_Agrupadora")
    return found.withColumn("tasa_cancel", F.round("tasa_cancel", 6))


_LEVELS = ("Regional_Agrupadora", "PLAN", "NIVEL_INGRESO", "SEGMENTO_EDAD", "TIPO_AFILIADO", "Compania", "TIPO_IPS")
_LEVELS += ("CONDICION_SALUD", "POLIZA", "GRUPO_CAUSA_CANCELACION", "Sexo_Cd", "nation")
_BANDS = {"consumos_cat": band_sql(f"({USAGE_SQL})"), "pqrs_cat": band_sql(f"({PQRS_SQL})")}


@query(
    "level_metrics_all",
    "\nUNION ALL ".join(
        f"SELECT '{n}' AS variable, {level} AS nivel, count(*) AS afiliados, round(avg({CANCEL_SQL}), 6) AS tasa_cancel "
        f"FROM last_spells WHERE {level} <> '' GROUP BY {level}"
        for n, level in (dict(zip(_LEVELS, _LEVELS)) | _BANDS).items()
    ),
)
def level_metrics_all(t: Tables):
    return portfolio.level_metrics_all(book(t), (*_LEVELS, *_BANDS)).withColumn("tasa_cancel", F.round("tasa_cancel", 6))


_PYR = "FILTER (upper(Sexo_Cd) = '{s}')"


@query(
    "population_pyramid",
    f"""SELECT *, -n_M AS "n_M_izq", -tasa_M AS "tasa_M_izq" FROM (
      SELECT CASE WHEN EDAD_FECHA_FIN BETWEEN 0 AND 100 THEN least(floor(EDAD_FECHA_FIN / 5) * 5, 95)::int END AS edad_desde,
        count(*) {_PYR.format(s="M")} AS "n_M", count(*) {_PYR.format(s="F")} AS "n_F",
        round(coalesce(avg({CANCEL_SQL}) {_PYR.format(s="M")}, 0), 6) AS "tasa_M",
        round(coalesce(avg({CANCEL_SQL}) {_PYR.format(s="F")}, 0), 6) AS "tasa_F"
      FROM last_spells WHERE Sexo_Cd <> '' GROUP BY 1) p""",
)
def population_pyramid(t: Tables):
    found = portfolio.pyramid(book(t))
    return found.withColumns({n: F.round(n, 6) for n in ("tasa_M", "tasa_F", "tasa_M_izq")})


_CLUSTERS = f"""SELECT * FROM (SELECT * EXCLUDE (cluster), {CLUSTER_SQL} AS cluster, {GROUP_SQL} AS grupo_norm FROM last_spells) x
    WHERE cluster IS NOT NULL AND grupo_norm IS NOT NULL"""


@query(
    "cluster_share",
    f"""SELECT grupo_norm, cluster, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY grupo_norm), 6) AS participacion
    FROM ({_CLUSTERS}) y GROUP BY grupo_norm, cluster""",
)
def cluster_share(t: Tables):
    return portfolio.cluster_share(book(t)).withColumn("participacion", F.round("participacion", 6))


NAMES = {0: "Estables", 2: "Nuevos", 999: "Ruido"}
NAME_SQL = "CASE cluster " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in NAMES.items()) + " ELSE 'Cluster ' || cluster END"


@query(
    "cluster_summary_status",
    f"""SELECT cluster, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS participacion, {NAME_SQL} AS nombre
    FROM ({_CLUSTERS}) y WHERE grupo_norm = 'CANCELADO' GROUP BY cluster""",
)
def cluster_summary_status(t: Tables):
    found = portfolio.cluster_summary(book(t), "CANCELADO", NAMES)
    return found.withColumn("participacion", F.round("participacion", 6))


@query(
    "cluster_composition",
    f"""SELECT cluster, nivel, n, sum(n) OVER (PARTITION BY cluster)::bigint AS n_cluster,
      round(n / sum(n) OVER (PARTITION BY cluster), 6) AS pct_cluster, {NAME_SQL} AS nombre
    FROM (SELECT cluster, coalesce(nullif(Sexo_Cd, ''), 'SIN_INFORMACION') AS nivel, count(*) AS n
      FROM ({_CLUSTERS}) y WHERE grupo_norm = 'ACTIVO' GROUP BY 1, 2) z""",
)
def cluster_composition(t: Tables):
    found = portfolio.cluster_composition(book(t), "Sexo_Cd", "ACTIVO", NAMES)
    return found.withColumn("pct_cluster", F.round("pct_cluster", 6))


@query(
    "operational_groups",
    """SELECT grupo_operativo, CASE grupo_operativo WHEN 'CRITICO' THEN 'Crítico' WHEN 'ALTO' THEN 'Alto'
        WHEN 'ESTRATEGIA_PROACTIVA' THEN 'Estrategia Proactiva' WHEN 'BAJO' THEN 'Bajo' ELSE grupo_operativo END AS grupo,
      count(*) AS afiliados,
      coalesce(nullif(list_position(['CRITICO', 'ALTO', 'ESTRATEGIA_PROACTIVA', 'BAJO'], grupo_operativo), 0), 5)::int AS orden
    FROM active_risk WHERE grupo_operativo <> '' GROUP BY grupo_operativo""",
)
def operational_groups(t: Tables):
    return portfolio.group_counts(active_risk(t))


LUMP_SQL = """kept AS (SELECT nation AS k FROM last_spells GROUP BY 1 ORDER BY count(*) DESC, nation LIMIT 12)"""


@query(
    "lump_top_levels",
    f"""WITH {LUMP_SQL} SELECT grupo, count(*) AS n FROM (
      SELECT CASE WHEN nation IN (SELECT k FROM kept) THEN nation ELSE 'OTROS' END AS grupo FROM last_spells) g GROUP BY grupo""",
)
def lump_top_levels(t: Tables):
    return portfolio.lump(book(t), "nation").groupBy("grupo").agg(F.count(F.lit(1)).alias("n"))


@query(
    "relative_risk",
    f"""SELECT round(a, 6) AS tasa_con, round(b, 6) AS tasa_sin, round(a / b, 6) AS razon, round(1 - a / b, 6) AS reduccion
    FROM (SELECT avg({CANCEL_SQL}) FILTER (TIPO_IPS = 'EXCLUSIVA') AS a, avg({CANCEL_SQL}) FILTER (TIPO_IPS <> 'EXCLUSIVA') AS b
      FROM last_spells) r""",
)
def relative_risk(t: Tables):
    found = portfolio.relative_risk(book(t), F.col("TIPO_IPS") == "EXCLUSIVA")
    return found.select(*[F.round(n, 6).alias(n) for n in found.columns])
