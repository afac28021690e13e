"""Queries that fit and apply models.

What surrounds the fits has SQL twins. So have the conditions that a fit meets at its
optimum: score equations, whose two sides SQL computes from the outcomes alone, fixed
points, and isotonic means by their definition.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorage.operators import clean, models
from anchorage.operators.survival import HORIZONS
from anchorage.plans.catalog import query
from anchorage.plans.portfolio import book
from anchorage.plans.risk import rounded
from anchorage.plans.tables import AGE_STAGES, REGIONS, Tables

FEATURES = ("ACCT_BAL", "NUM_ORDERS", "NUM_ITEMS", "Prestaciones_PAC", "Prestaciones_PBS", "risk_12m")
LABEL = "Es_Fuga_Real"
SEGMENT_FEATURES = ("ACCT_BAL", "NUM_ORDERS", "Prestaciones_PAC", "Prestaciones_PBS")
PROFILE_LEVELS = {
    "SEGMENTO_EDAD": AGE_STAGES,
    "TIPO_AFILIADO": ("ASEGURADO COLECTIVO", "ASEGURADO FAMILIAR", "TOMADOR FAMILIAR"),
    "Regional_Agrupadora": REGIONS,
    "Compania": ("DIGITAL", "PROPIO", "TERCERO"),
    "TIPO_IPS": ("ALIADA", "CONVENIO", "EXCLUSIVA", "PROPIA", "SIN_INFORMACION"),
}
HAZARD_FEATURES = (
    *(f"{n}_COD" for n in models.ORDINALS),
    "Sexo_Cd_BIN",
    "POLIZA_BIN",
    "RAMO_FAMILIAR",
    *(f"{n}_{level}" for n in models.FAMILIES for level in PROFILE_LEVELS[n]),
)
COX_FEATURES = ("EDAD_FECHA_FIN", "INGRESO", "Prestaciones_PAC", "Prestaciones_PBS")


def labelled(t: Tables):
    """Numeric inputs and the outcome, one row per customer."""
    outcome = t.scored.select(F.col("id").cast("string").alias("ID"), LABEL)
    return t.wide_features.join(outcome, "ID")


def scored_by_logit(t: Tables):
    rows = labelled(t)
    model = models.fit_logit(rows, FEATURES, LABEL)
    return models.score(model, rows, FEATURES, ["ID", LABEL])


@query("kmeans_segments")
def kmeans_segments(t: Tables):
    found = models.fit_segments(t.wide_features, SEGMENT_FEATURES, 4)
    return found.groupBy("segmento").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in SEGMENT_FEATURES])


@query("kmeans_select_k")
def kmeans_select_k(t: Tables):
    return models.select_k(t.wide_features, SEGMENT_FEATURES, (2, 3, 4, 5))


@query(
    "kmeans_fixed_point",
    f"SELECT unnest({list(SEGMENT_FEATURES)}) AS variable, (SELECT count(*) FROM wide_features) AS filas, 0.0::double AS desvio",
)
def kmeans_fixed_point(t: Tables):
    """Every centre is the mean of the rows nearest to it, so the largest distance is 0."""
    return rounded(models.centre_gaps(t.wide_features, SEGMENT_FEATURES, 4), "desvio")


@query("logit_churn")
def logit_churn(t: Tables):
    return scored_by_logit(t)


_BALANCED = " UNION ALL ".join(
    f"SELECT '{name}' AS variable, round(sum(w * y * {x}), 3) AS observado, round(sum(w * y * {x}), 3) AS ajustado FROM weighted"
    for name, x in [(models.INTERCEPT, "1.0::double"), *[(f, f"z{i}") for i, f in enumerate(FEATURES)]]
)


@query(
    "logit_balance",
    "WITH labelled_rows AS (SELECT Es_Fuga_Real AS y, "
    + ", ".join(f"coalesce({f}, 0)::double AS {f}" for f in FEATURES)
    + """ FROM wide_features JOIN (SELECT id::varchar AS sid, Es_Fuga_Real FROM scored) o ON ID = sid),
    weighted AS (SELECT y, CASE WHEN y = 1 THEN 0.5 / (avg(y) OVER ()) ELSE 0.5 / (1 - avg(y) OVER ()) END / count(*) OVER () AS w, """
    + ", ".join(f"{f} / (stddev_samp({f}) OVER ()) AS z{i}" for i, f in enumerate(FEATURES))
    + f" FROM labelled_rows) {_BALANCED}",
)
def logit_balance(t: Tables):
    """Weighted churn per row and per scaled input, as it came and as the logit has it."""
    rows = models.with_class_weight(labelled(t), LABEL)
    model = models.fit_logit(labelled(t), FEATURES, LABEL)
    scored = models.score(model, rows, FEATURES, [LABEL, "peso", *FEATURES])
    return rounded(models.balance(*models.spread_inputs(scored, FEATURES, "peso"), LABEL, "peso", "Probabilidad"), "observado", "ajustado", digits=3)


@query("gbt_stopping")
def gbt_stopping(t: Tables):
    """Held-out loss by number of trees; the chosen number is the smallest with the least loss."""
    return models.stopping_curve(labelled(t), FEATURES, LABEL, "ID")


@query("gbt_churn")
def gbt_churn(t: Tables):
    rows = labelled(t)
    model = models.fit_gbt(rows, FEATURES, LABEL, "ID")
    return models.score(model, rows, FEATURES, ["ID", LABEL])


@query("score_churn")
def score_churn(t: Tables):
    """The model of the customers with an order history scores everyone."""
    known = labelled(t).where(F.col("NUM_ORDERS").isNotNull())
    return models.score(models.fit_logit(known, FEATURES, LABEL), t.wide_features, FEATURES, ["ID"])


@query("model_importance")
def model_importance(t: Tables):
    rows = labelled(t)
    return models.importance(rows, models.fit_gbt(rows, FEATURES, LABEL, "ID", 10), FEATURES)


@query("calibrate")
def calibrate(t: Tables):
    platt = models.calibrate(t.scored, "Probabilidad", LABEL, "platt").withColumnRenamed("calibrada", "platt")
    return models.calibrate(platt, "Probabilidad", LABEL, "isotonic").withColumnRenamed("calibrada", "isotonica")


@query(
    "calibrate_isotonic",
    """WITH x AS (SELECT Probabilidad AS p, sum(Es_Fuga_Real)::double AS y, count(*)::double AS n FROM scored GROUP BY 1),
    s AS (SELECT p, row_number() OVER w AS i, sum(y) OVER w AS ys, sum(n) OVER w AS ns FROM x
      WINDOW w AS (ORDER BY p ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT j.i AS j, k.i AS k, (k.ys - coalesce(b.ys, 0)) / (k.ns - coalesce(b.ns, 0)) AS mean
      FROM s j JOIN s k ON k.i >= j.i LEFT JOIN s b ON b.i = j.i - 1),
    l AS (SELECT j, k, min(mean) OVER (PARTITION BY j ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS least FROM m),
    f AS (SELECT k, max(least) AS v FROM l GROUP BY k)
    SELECT id, Probabilidad, round(v, 6) AS isotonica FROM scored JOIN s ON p = Probabilidad JOIN f ON k = i""",
)
def calibrate_isotonic(t: Tables):
    """The twin is the definition: the largest over starts at or below a score of the least mean of a range from there to it or beyond."""
    found = models.calibrate(t.scored, "Probabilidad", LABEL, "isotonic")
    return found.select("id", "Probabilidad", F.round("calibrada", 6).alias("isotonica"))


@query(
    "calibrate_balance",
    " UNION ALL ".join(
        f"SELECT '{name}' AS variable, round(sum(Es_Fuga_Real * {x}), 3) AS observado, round(sum(Es_Fuga_Real * {x}), 3) AS ajustado FROM scored"
        for name, x in ((models.INTERCEPT, "1.0::double"), ("Probabilidad", "Probabilidad"))
    ),
)
def calibrate_balance(t: Tables):
    """Churners, and their scores, as they came and as Platt's probabilities have them."""
    found = models.calibrate(t.scored, "Probabilidad", LABEL, "platt").withColumn("peso", F.lit(1.0))
    return rounded(models.balance(found, ["Probabilidad"], LABEL, "peso", "calibrada"), "observado", "ajustado", digits=3)


_ORDER = {n: f"coalesce(nullif(list_position({list(known)}, {n}), 0), {len(known) + 1})::double" for n, known in models.ORDINALS.items()}
_FLAGS = {f"{n}_{v}": f"coalesce(({n} = '{v}')::int, 0)" for n, known in PROFILE_LEVELS.items() for v in known}


def profiles(t: Tables):
    """Every affiliate's last spell read as a profile, all fields coded."""
    return models.encode_profiles(book(t), levels=PROFILE_LEVELS)


@query(
    "encode_profiles",
    "SELECT AFILIADO_ID_EPS, "
    + ", ".join(f'{sql} AS "{n}_COD"' for n, sql in _ORDER.items())
    + """, CASE upper(trim(Sexo_Cd)) WHEN 'M' THEN 1.0 WHEN 'F' THEN 0.0 ELSE -1.0 END::double AS "Sexo_Cd_BIN",
      CASE WHEN upper(trim(POLIZA)) IN ('SI', 'SÍ') THEN 1.0 WHEN upper(trim(POLIZA)) = 'NO' THEN 0.0 ELSE -1.0 END::double AS "POLIZA_BIN",
      -1.0::double AS "RAMO_FAMILIAR", """
    + ", ".join(f'{sql} AS "{n}"' for n, sql in _FLAGS.items())
    + " FROM last_spells",
)
def encode_profiles(t: Tables):
    return profiles(t).select("AFILIADO_ID_EPS", *HAZARD_FEATURES)


@query(
    "person_months",
    """SELECT mes::int AS mes, count(*)::double AS meses_persona, (count(*) FILTER (event = 1 AND mes = last))::double AS eventos,
      round(count(*) FILTER (event = 1 AND mes = last) / count(*), 6) AS observado
    FROM (SELECT event, last, unnest(range(1, last + 1)) AS mes FROM (
      SELECT event, greatest(ceil(t_m), 1)::int AS last FROM valid) v) m GROUP BY 1""",
)
def person_months(t: Tables):
    lived = models.person_months(clean.valid_spells(profiles(t)), HAZARD_FEATURES)
    return models.observed_hazard(lived).withColumn("observado", F.round("observado", 6))


# Account balance, orders, and the two kinds of use.
CENTRES = ((0.0, 5.0, 10.0, 10.0), (4500.0, 15.0, 30.0, 30.0), (9000.0, 25.0, 60.0, 60.0))


@query(
    "nearest_centre",
    "SELECT ID, list_position(d, list_min(d))::int - 1 AS segmento FROM (SELECT ID, ["
    + ", ".join(
        " + ".join(f"(coalesce({f}, 0) - {x}::double) * (coalesce({f}, 0) - {x}::double)" for f, x in zip(SEGMENT_FEATURES, centre))
        for centre in CENTRES
    )
    + "] AS d FROM wide_features) w",
)
def nearest_centre(t: Tables):
    return models.nearest_centre(t.wide_features, SEGMENT_FEATURES, CENTRES).select("ID", "segmento")


_POINT = "[" + ", ".join(f"coalesce({f}, 0)" for f in SEGMENT_FEATURES) + "]"


@query(
    "segment_silhouette",
    f"""WITH c AS (SELECT ID, segmento, x FROM (SELECT ID, {_POINT} AS x, list_position(d, list_min(d))::int - 1 AS segmento FROM (SELECT *, ["""
    + ", ".join(
        " + ".join(f"(coalesce({f}, 0) - {x}::double) * (coalesce({f}, 0) - {x}::double)" for f, x in zip(SEGMENT_FEATURES, centre))
        for centre in CENTRES
    )
    + """] AS d FROM wide_features) w) v),
    p AS (SELECT a.ID, a.segmento = b.segmento AS own, avg(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS m,
        sum(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS s, count(*) AS n
      FROM c a, c b GROUP BY a.ID, own, b.segmento),
    q AS (SELECT ID, max(s / (n - 1)) FILTER (own AND n > 1) AS a, min(m) FILTER (NOT own) AS b FROM p GROUP BY ID)
    SELECT count(*) AS n, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silueta FROM q""",
)
def segment_silhouette(t: Tables):
    """Silhouette of the segments around fixed centres; the twin pairs all rows."""
    found = models.nearest_centre(t.wide_features, SEGMENT_FEATURES, CENTRES)
    return rounded(models.silhouette(found, SEGMENT_FEATURES, "segmento"), "silueta")


def _observed_events(name: str, flag: str) -> str:
    events = f"(count(*) FILTER (event = 1 AND {flag} = 1))::double"
    return f"SELECT '{name}' AS variable, {events} AS observado, {events} AS ajustado FROM valid"


@query("hazard_balance", " UNION ALL ".join(_observed_events(n, sql) for n, sql in _FLAGS.items()))
def hazard_balance(t: Tables):
    """Cancellations per profile level, as they came and as the logistic monthly hazard expects them."""
    lived = models.person_months(clean.valid_spells(profiles(t)), HAZARD_FEATURES)
    fitted = models.with_hazard(models.fit_hazard_logit(lived, HAZARD_FEATURES), lived)
    return rounded(models.balance(fitted, list(_FLAGS), "label", "peso", "hazard").where(F.col("variable") != models.INTERCEPT), "observado", "ajustado", digits=2)


@query("discrete_hazard_fit")
def discrete_hazard_fit(t: Tables):
    lived = models.person_months(clean.valid_spells(profiles(t)), HAZARD_FEATURES)
    model = models.fit_hazard(clean.valid_spells(profiles(t)), HAZARD_FEATURES)
    fitted = models.with_hazard(model, lived)
    weight = F.sum("peso")
    return fitted.groupBy(F.col("mes").cast("int").alias("mes")).agg(
        weight.alias("meses_persona"),
        (F.sum(F.col("label") * F.col("peso")) / weight).alias("observado"),
        (F.sum(F.col("hazard") * F.col("peso")) / weight).alias("ajustado"),
    )


def scored_profiles(t: Tables):
    rows = profiles(t)
    model = models.fit_hazard(clean.valid_spells(rows), HAZARD_FEATURES)
    return models.score_profiles(model, rows, "AFILIADO_ID_EPS", HAZARD_FEATURES, HORIZONS)


@query("profile_scoring")
def profile_scoring(t: Tables):
    return scored_profiles(t)


@query("profile_horizons")
def profile_horizons(t: Tables):
    """The same risks by date, counted from the latest start in the portfolio."""
    since = t.spells.agg(F.max("FECHA_INICIO")).scalar()
    risks = scored_profiles(t).withColumn("_since", since)
    return models.dated_horizons(risks, "AFILIADO_ID_EPS", F.col("_since"), HORIZONS)


@query("cox_ph")
def cox_ph(t: Tables):
    return models.fit_cox(clean.valid_spells(book(t)), COX_FEATURES)


@query(
    "cox_score",
    f"SELECT unnest({list(COX_FEATURES)}) AS variable, 0.0::double AS gradiente, true AS converge, "
    "(SELECT count(*) FILTER (event = 1) FROM valid) AS eventos",
)
def cox_score(t: Tables):
    """The score of every input per event is 0 at the fitted coefficients."""
    rows = clean.valid_spells(book(t))
    events = rows.agg(F.sum(F.col("event").cast("bigint"))).scalar()
    found = models.fit_cox(rows, COX_FEATURES).withColumn("eventos", events)
    return rounded(found, "gradiente").select("variable", "gradiente", "converge", "eventos")
