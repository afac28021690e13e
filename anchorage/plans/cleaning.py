"""Queries over the cleaning rules and derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorage.functions import columns as c
from anchorage.operators import clean
from anchorage.plans.catalog import query
from anchorage.plans.oracle import months_frac, whole_months
from anchorage.plans.tables import AGE_STAGES, INTERACTIONS, Tables

DATE_TEXT_SQL = """
dates AS (SELECT o_orderkey, CASE o_orderkey % 10
    WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y')
    WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%d.%m.%Y')
    WHEN 4 THEN 'sin fecha' WHEN 5 THEN strftime(o_orderdate, '%Y/%m/%d')
    WHEN 6 THEN strftime(o_orderdate, '%d/%m/%y') WHEN 7 THEN strftime(o_orderdate, '%y.%m.%d')
    WHEN 8 THEN strftime(o_orderdate, '%-d %B %Y')
    ELSE strftime(o_orderdate, '%d') || ' de ' || ['ene', 'feb', 'mar', 'abr', 'may', 'jun', 'jul', 'ago', 'sep', 'oct', 'nov', 'dic'][month(o_orderdate)]
      || ' de ' || strftime(o_orderdate, '%Y') END AS txt, CASE WHEN o_orderkey % 10 >= 8 THEN o_orderdate::date END AS named FROM orders),
norm AS (SELECT o_orderkey, txt, named, regexp_replace(trim(txt), '[/. ]', '-', 'g') AS d FROM dates)"""


@query(
    "parse_date_any",
    f"""WITH {DATE_TEXT_SQL}
    SELECT o_orderkey, txt, CASE WHEN named IS NOT NULL THEN named WHEN regexp_matches(d, '^\\d{{2}}-\\d{{2}}-\\d{{2}}$')
      THEN coalesce(try_strptime(d, '%d-%m-%y'), try_strptime(d, '%y-%m-%d'))::date
      ELSE coalesce(try_strptime(d, '%d-%m-%Y')::date,
        CASE WHEN regexp_matches(d, '^\\d{{4}}-') THEN try_strptime(d, '%Y-%m-%d')::date END) END AS fecha FROM norm""",
)
def parse_date_any(t: Tables):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 10
    spanish = F.get(F.array(*map(F.lit, c.MONTH_NAMES[36:])), F.month(d) - 1)
    text = (
        F.when(k == 0, F.date_format(d, "dd/MM/yyyy"))
        .when(k == 1, F.date_format(d, "dd-MM-yyyy"))
        .when(k == 2, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 3, F.date_format(d, "dd.MM.yyyy"))
        .when(k == 4, "sin fecha")
        .when(k == 5, F.date_format(d, "yyyy/MM/dd"))
        .when(k == 6, F.date_format(d, "dd/MM/yy"))
        .when(k == 7, F.date_format(d, "yy.MM.dd"))
        .when(k == 8, F.date_format(d, "d MMMM yyyy"))
        .otherwise(F.concat_ws(" de ", F.date_format(d, "dd"), spanish, F.date_format(d, "yyyy")))
    )
    return t.raw("orders").select("o_orderkey", text.alias("txt")).withColumn("fecha", c.parse_date_any(F.col("txt")))


PRICE_TEXT_SQL = """
prices AS (SELECT o_orderkey, CASE o_orderkey % 6
    WHEN 0 THEN replace(printf('%.2f', o_totalprice), '.', ',') WHEN 1 THEN format('{:,.2f}', o_totalprice)
    WHEN 2 THEN '$ ' || format('{:,.2f}', o_totalprice)
    WHEN 3 THEN ' 12' || chr(160) || (o_orderkey % 1000)::varchar WHEN 4 THEN '-' || printf('%.2f', o_totalprice)
    ELSE 'sin dato' END AS txt FROM orders)"""


def price_text(t: Tables):
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    plain = F.format_string("%.2f", p)
    kind = k % 6
    text = (
        F.when(kind == 0, F.replace(plain, F.lit("."), F.lit(",")))
        .when(kind == 1, F.format_number(p, 2))
        .when(kind == 2, F.concat(F.lit("$ "), F.format_number(p, 2)))
        .when(kind == 3, F.concat(F.lit(" 12 "), (k % 1000).cast("string")))
        .when(kind == 4, F.concat(F.lit("-"), plain))
        .otherwise("sin dato")
    )
    return t.raw("orders").select("o_orderkey", text.alias("txt"))


def price_query(name: str, rule, sql: str):
    query(name, f"WITH {PRICE_TEXT_SQL} SELECT o_orderkey, txt, {sql} AS num FROM prices")(
        lambda t: price_text(t).withColumn("num", rule(F.col("txt")))
    )


price_query("safe_num", c.safe_num, "try_cast(replace(txt, ',', '.') AS double)")
price_query(
    "numify_simple",
    c.numify_simple,
    "try_cast(replace(replace(replace(txt, chr(160), ''), ' ', ''), ',', '.') AS double)",
)
price_query(
    "parse_money", c.parse_money, "try_cast(nullif(regexp_replace(txt, '[^0-9.]', '', 'g'), '') AS double)"
)

NUM_SQL = "try_cast(replace(replace(replace({c}, chr(160), ''), ' ', ''), ',', '') AS double)"


def num_or_sql(col: str, default: float) -> str:
    v = NUM_SQL.format(c=col)
    return f"CASE WHEN isfinite({v}) THEN {v} ELSE {default}::double END"


CAMPAIGN_SQL = f"""SELECT campaign_id, {num_or_sql("ltv", 720000)} AS ltv, {num_or_sql("call_cost", 10000)} AS call_cost,
    coalesce(try_cast(nullif(regexp_replace(incentive, '[^0-9.]', '', 'g'), '') AS double), 180000) AS incentive,
    {num_or_sql("success", 0.30)} AS success,
    CASE WHEN trunc({NUM_SQL.format(c="budget")}) > 0 THEN trunc({NUM_SQL.format(c="budget")})::int END AS budget
  FROM campaigns"""


def clean_campaigns(t: Tables):
    """Campaign parameters as numbers; a missing or bad budget stays null for the operator to fill."""
    return t.campaigns.select(
        "campaign_id",
        c.num_or(F.col("ltv"), 720_000).alias("ltv"),
        c.num_or(F.col("call_cost"), 10_000).alias("call_cost"),
        F.coalesce(c.parse_money(F.col("incentive")), F.lit(180_000.0)).alias("incentive"),
        c.num_or(F.col("success"), 0.30).alias("success"),
        c.int_or(F.col("budget"), F.lit(None)).alias("budget"),
    )


query("num_default", CAMPAIGN_SQL)(clean_campaigns)


@query(
    "binarize_sex",
    "SELECT spell_id, CASE upper(trim(Sexo_Cd)) WHEN 'M' THEN 1 WHEN 'F' THEN 0 END AS sexo FROM spells",
)
def binarize_sex(t: Tables):
    return t.spells.select("spell_id", c.sex_bin(F.col("Sexo_Cd")).alias("sexo"))


_ANSWER_SQL = "[POLIZA, 'true', 'y', ' no ', 'x', '1', '0'][(spell_id % 7) + 1]"


@query(
    "binarize_yes_no",
    f"""SELECT spell_id, CASE WHEN v IN ('SI', 'SÍ', 'YES', 'Y', '1') THEN 1 WHEN v IN ('NO', 'N', '0') THEN 0 END AS perfil,
      CASE WHEN v IN ('SI', 'SÍ', 'YES', '1', 'TRUE') THEN 1 WHEN v IN ('NO', '0', 'FALSE') THEN 0 END AS tabla
    FROM (SELECT spell_id, upper(trim({_ANSWER_SQL})) AS v FROM spells) s""",
)
def binarize_yes_no(t: Tables):
    answers = F.array(F.col("POLIZA"), *map(F.lit, ("true", "y", " no ", "x", "1", "0")))
    answer = F.get(answers, (F.col("spell_id") % 7).cast("int"))
    return t.spells.select(
        "spell_id",
        c.yes_no_bin(answer, "profile").alias("perfil"),
        c.yes_no_bin(answer, "table").alias("tabla"),
    )


CLUSTER_SQL = """CASE WHEN trim(cluster) IN ('-1', '999') THEN 999
    ELSE try_cast(nullif(regexp_extract(trim(cluster), '-?\\d+', 0), '') AS int) END"""
GROUP_SQL = """CASE WHEN upper(trim(grupo_churn)) IN ('ACTIVO', 'ACTIVOS') THEN 'ACTIVO'
    WHEN upper(trim(grupo_churn)) IN ('CANCELADO', 'CANCELADOS') THEN 'CANCELADO' END"""


@query("clean_cluster", f"SELECT spell_id, {CLUSTER_SQL} AS cluster_id FROM spells")
def clean_cluster(t: Tables):
    return t.spells.select("spell_id", c.clean_cluster(F.col("cluster")).alias("cluster_id"))


@query("norm_group", f"SELECT spell_id, {GROUP_SQL} AS grupo FROM spells")
def norm_group(t: Tables):
    return t.spells.select("spell_id", c.norm_group(F.col("grupo_churn")).alias("grupo"))


def pretty_sql(col: str) -> str:
    words = f"string_split(lower(trim(regexp_replace({col}, '[_\\s]+', ' ', 'g'))), ' ')"
    acronyms = ", ".join(f"'{a}'" for a in c.ACRONYMS)
    return f"""list_aggregate(list_transform({words}, lambda w: CASE
      WHEN upper(w[1]) || w[2:] IN ({acronyms}) THEN upper(w) WHEN w = 'cd' THEN 'Cod.'
      ELSE upper(w[1]) || w[2:] END), 'string_agg', ' ')"""


@query(
    "pretty_feature",
    f"""SELECT feature, {pretty_sql("feature")} AS etiqueta, n FROM (
      SELECT p_type || '__PAC_Cd ' || p_brand || '_ID' AS feature, count(*) AS n FROM part GROUP BY 1
      UNION ALL SELECT feature, count(*) AS n FROM contrib_ok GROUP BY 1) f""",
)
def pretty_feature(t: Tables):
    parts = t.raw("part").select(F.concat("p_type", F.lit("__PAC_Cd "), "p_brand", F.lit("_ID")).alias("feature"))
    names = parts.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    contrib = contrib_long(t).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    both = names.unionByName(contrib)
    return both.select("feature", c.pretty_feature_name(F.col("feature")).alias("etiqueta"), "n")


def contrib_long(t: Tables):
    from anchorage.plans.explain import contributions_table

    return contributions_table(t)


@query(
    "status_flag",
    """SELECT spell_id, CASE WHEN f = 'CANCELADOS' THEN 'CANCELADOS' WHEN f IS NOT NULL THEN 'ACTIVOS' END AS ESTADO,
      CASE WHEN f = 'CANCELADOS' THEN 1 WHEN f IS NOT NULL THEN 0 END AS is_cancel
    FROM (SELECT spell_id, CASE WHEN FECHA_FIN IS NULL THEN NULL ELSE FALLA END AS f FROM spells) s""",
)
def status_flag(t: Tables):
    unknown_open = t.spells.withColumn("FALLA", F.when(F.col("FECHA_FIN").isNotNull(), F.col("FALLA")))
    return clean.add_status(unknown_open).select("spell_id", "ESTADO", "is_cancel")


USAGE_SQL = "coalesce(Prestaciones_PAC, 0) + coalesce(Prestaciones_PBS, 0)"
PQRS_SQL = " + ".join(f"coalesce({n}, 0)" for n in clean.PQRS)


def band_sql(v: str) -> str:
    return f"""CASE WHEN {v} <= 0 THEN '0' WHEN {v} = 1 THEN '1' WHEN {v} BETWEEN 2 AND 5 THEN '2 a 5'
      WHEN {v} >= 6 THEN '6+' END"""


@query(
    "usage_total",
    f"""SELECT spell_id, {USAGE_SQL} AS consumos_total, coalesce(Prestaciones_PAC, 0) AS solo_pac,
      {USAGE_SQL} AS con_fin FROM spells""",
)
def usage_total(t: Tables):
    # The three column-presence branches, one after the other on the same rows.
    both = clean.add_usage_total(t.spells.select("spell_id", *clean.USAGE)).withColumnRenamed("consumos_total", "_both")
    final = clean.add_usage_total(both.withColumnsRenamed({n: f"{n}_FIN" for n in clean.USAGE}))
    single = clean.add_usage_total(final.withColumnRenamed("consumos_total", "con_fin").drop("Prestaciones_PBS_FIN"))
    return single.select("spell_id", F.col("_both").alias("consumos_total"), F.col("consumos_total").alias("solo_pac"), "con_fin")


@query("pqrs_total", f"SELECT spell_id, {PQRS_SQL} AS pqrs_total FROM spells")
def pqrs_total(t: Tables):
    return clean.add_pqrs_total(t.spells).select("spell_id", "pqrs_total")


@query(
    "count_buckets",
    f"""SELECT spell_id, {band_sql("u")} AS consumos_cat, {band_sql("q")} AS pqrs_cat,
      {band_sql("g")} AS con_hueco, coalesce(list_position(['0', '1', '2 a 5', '6+'], {band_sql("g")}), 0)::int AS orden
    FROM (SELECT spell_id, {USAGE_SQL} AS u, {PQRS_SQL} AS q, coalesce(Prestaciones_PAC, 0) * 0.75 AS g FROM spells) s""",
)
def count_buckets(t: Tables):
    gap = c.bucket_0_1_2_5_6p(F.col("Prestaciones_PAC") * 0.75)
    return clean.add_metrics(t.spells).select(
        "spell_id",
        "consumos_cat",
        "pqrs_cat",
        gap.alias("con_hueco"),
        F.coalesce(c.band_order(gap), F.lit(0)).alias("orden"),
    )


FRICTION_SQL = (
    "CASE WHEN " + " + ".join(f"coalesce({n}, 0)" for n in clean.FRICTION) + " > 0 THEN 'Con Quejas' ELSE 'Sin Quejas' END"
)


@query("friction_flag", f"SELECT spell_id, {FRICTION_SQL} AS TIENE_QUEJAS FROM spells")
def friction_flag(t: Tables):
    return clean.has_complaints(t.spells).select("spell_id", "TIENE_QUEJAS")


AFFILIATION_LEVELS = ("ASEGURADO_COLECTIVO", "ASEGURADO FAMILIAR")


@query(
    "one_hot",
    """SELECT spell_id, (TIPO_AFILIADO = 'ASEGURADO COLECTIVO')::int AS "TIPO_AFILIADO_ASEGURADO_COLECTIVO",
      (TIPO_AFILIADO = 'ASEGURADO FAMILIAR')::int AS "TIPO_AFILIADO_ASEGURADO FAMILIAR" FROM spells""",
)
def one_hot(t: Tables):
    return clean.one_hot(
        t.spells.select("spell_id", "TIPO_AFILIADO"), "TIPO_AFILIADO", "TIPO_AFILIADO_", AFFILIATION_LEVELS
    ).drop("TIPO_AFILIADO")


STAGE_SQL = f"coalesce(SEGMENTO_EDAD, '{AGE_STAGES[0]}')"


@query("undummy", f"SELECT spell_id, Regional_Agrupadora AS region, {STAGE_SQL} AS etapa FROM features")
def undummy(t: Tables):
    regions = clean.undummy(t.features.drop("Regional_Agrupadora"), "Regional_Agrupadora_", "region")
    return clean.undummy(regions, "SEGMENTO_EDAD_", "etapa").select("spell_id", "region", "etapa")


_AGE_CUT_SQL = """CASE WHEN EDAD_FECHA_FIN <= 0 THEN NULL WHEN EDAD_FECHA_FIN <= 20 THEN '0-20'
    WHEN EDAD_FECHA_FIN <= 30 THEN '20-30' WHEN EDAD_FECHA_FIN <= 40 THEN '30-40' WHEN EDAD_FECHA_FIN <= 50 THEN '40-50'
    WHEN EDAD_FECHA_FIN <= 60 THEN '50-60' WHEN EDAD_FECHA_FIN <= 100 THEN '60+' END"""


@query("life_stage", f"SELECT spell_id, {STAGE_SQL} AS con_banderas, {_AGE_CUT_SQL} AS con_edad FROM spells")
def life_stage(t: Tables):
    flags = clean.life_stage(t.features, "con_banderas")
    by_age = c.cut(F.col("EDAD_FECHA_FIN"), clean.AGE_EDGES, clean.AGE_LABELS)
    return flags.select("spell_id", "con_banderas", by_age.alias("con_edad"))


@query("fixed_bins", f"SELECT rango, count(*) AS n FROM (SELECT {_AGE_CUT_SQL} AS rango FROM spells) s GROUP BY rango")
def fixed_bins(t: Tables):
    band = c.cut(F.col("EDAD_FECHA_FIN"), clean.AGE_EDGES, clean.AGE_LABELS)
    return t.spells.groupBy(band.alias("rango")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "date_plus_months",
    """SELECT spell_id, m, (FECHA_INICIO + round_even(30.4375::double * m, 0)::int)::date AS fecha FROM (
      SELECT spell_id, FECHA_INICIO, unnest([1, 3, 6, 8, 12, 18, 24]) AS m FROM spells) s""",
)
def date_plus_months(t: Tables):
    horizons = F.array(*map(F.lit, (1, 3, 6, 8, 12, 18, 24)))
    rows = t.spells.select("spell_id", "FECHA_INICIO", F.explode(horizons).alias("m"))
    return rows.select("spell_id", "m", c.date_plus_months(F.col("FECHA_INICIO"), F.col("m")).alias("fecha"))


@query(
    "tenure_months_int",
    f"SELECT spell_id, greatest({whole_months('FECHA_INICIO', 'FECHA_FIN')}, 0)::int AS meses FROM spells WHERE FECHA_FIN IS NOT NULL",
)
def tenure_months_int(t: Tables):
    months = c.months_elapsed(F.col("FECHA_INICIO"), F.col("FECHA_FIN"))
    return t.spells.where(F.col("FECHA_FIN").isNotNull()).select("spell_id", months.alias("meses"))


@query(
    "tenure_months_frac",
    f"SELECT spell_id, round({months_frac('FECHA_INICIO', 'FECHA_FIN')}, 6) AS meses FROM spells WHERE FECHA_FIN IS NOT NULL",
)
def tenure_months_frac(t: Tables):
    months = c.months_frac(F.col("FECHA_INICIO"), F.col("FECHA_FIN"))
    return t.spells.where(F.col("FECHA_FIN").isNotNull()).select("spell_id", F.round(months, 6).alias("meses"))


@query(
    "clamp01",
    "SELECT c_custkey, greatest(least(round(c_acctbal / 5000, 6), 1.0), 0.0)::double AS v FROM customer",
)
def clamp01(t: Tables):
    return t.raw("customer").select("c_custkey", c.clamp01(F.round(F.col("c_acctbal") / 5000, 6)).alias("v"))


_KEPT = ("spell_id", "FLAG_FRICCION_INICIAL", "Prestaciones_PAC", *INTERACTIONS)


@query(
    "leak_free_columns",
    f"""SELECT spell_id, (Queja_PAC > 0)::int AS FLAG_FRICCION_INICIAL, Prestaciones_PAC, {", ".join(INTERACTIONS)}
    FROM spells""",
)
def leak_free_columns(t: Tables):
    wide = t.spells.select(
        "AFILIADO_ID_EPS",
        "spell_id",
        "FECHA_INICIO",
        "FECHA_FIN",
        F.coalesce((F.col("Queja_PAC") > 0).cast("int"), F.lit(None)).alias("FLAG_FRICCION_INICIAL"),
        "Prestaciones_PAC",
        F.col("Prestaciones_PBS").alias("Prestaciones_PBS_FIN"),
        (F.col("GRUPO_CAUSA_CANCELACION") == "MORA").cast("int").alias("GRUPO_CAUSA_CANCELACION_MORA"),
        *INTERACTIONS,
    )
    return clean.drop_leakage(wide)


TENURE_SQL = f"""tenured AS (SELECT *, (FALLA = 'CANCELADOS')::int AS FALLA_BIN,
    greatest({whole_months("FECHA_INICIO", "coalesce(FECHA_FIN, corte)")}, 0)::int AS meses_transcurridos
  FROM spells, (SELECT greatest(max(FECHA_FIN), max(FECHA_INICIO)) AS corte FROM spells) k)"""


@query(
    "censor_exclusion",
    f"""WITH {TENURE_SQL} SELECT spell_id, FALLA_BIN, meses_transcurridos FROM tenured
    WHERE NOT (FALLA_BIN = 0 AND meses_transcurridos < 12)""",
)
def censor_exclusion(t: Tables):
    return clean.modelling_base(clean.with_tenure(t.spells)).select("spell_id", "FALLA_BIN", "meses_transcurridos")


@query(
    "valid_spells",
    f"""SELECT spell_id, CASE upper(trim(grupo_churn)) WHEN 'CANCELADOS' THEN 1 ELSE 0 END AS event,
      round({months_frac("FECHA_INICIO", "FECHA_FIN")}, 6) AS t_m FROM spells
    WHERE FECHA_FIN >= FECHA_INICIO AND upper(trim(grupo_churn)) IN ('CANCELADOS', 'ACTIVOS')""",
)
def valid_spells(t: Tables):
    return clean.valid_spells(t.spells).select("spell_id", "event", F.round("t_m", 6).alias("t_m"))


@query("last_spell", "SELECT AFILIADO_ID_EPS, spell_id, FECHA_FIN FROM last_spells")
def last_spell(t: Tables):
    return clean.last_spell(t.spells).select("AFILIADO_ID_EPS", "spell_id", "FECHA_FIN")


@query("first_per_id", "SELECT AFILIADO_ID_EPS, risk_12m, dup FROM permanencia WHERE dup = 0")
def first_per_id(t: Tables):
    return clean.first_per_id(t.permanencia.select("AFILIADO_ID_EPS", "risk_12m", "dup"), "AFILIADO_ID_EPS", F.asc("dup"))
