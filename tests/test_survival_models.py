"""Survival identities and model sanity on planted data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorage.operators import checks, models, survival


def spells(spark, rows):
    """rows: (group, months lived in whole months, cancelled)."""
    df = spark.createDataFrame(rows, "g string, m int, c int")
    return df.select(
        "g",
        F.lit("2020-01-01").cast("date").alias("FECHA_INICIO"),
        F.add_months(F.lit("2020-01-01").cast("date"), F.col("m")).alias("FECHA_FIN"),
        F.when(F.col("c") == 1, "CANCELADOS").otherwise("ACTIVOS").alias("grupo_churn"),
    )


def test_km_without_censoring_is_the_share_alive(spark):
    curve = survival.km(spells(spark, [("a", m, 1) for m in (1, 2, 2, 5)]), "g").orderBy("t").collect()
    assert [(r.t, round(r.S_t, 9), r.n) for r in curve] == [(1.0, 0.75, 4), (2.0, 0.25, 4), (5.0, 0.0, 4)]


def test_km_with_censoring(spark):
    rows = [("a", 1, 1), ("a", 2, 0), ("a", 3, 1), ("a", 4, 0), ("b", 2, 0)]
    curve = {(r.grupo, r.t): r.S_t for r in survival.km(spells(spark, rows), "g").collect()}
    assert curve["a", 1.0] == pytest.approx(0.75)
    assert curve["a", 2.0] == pytest.approx(0.75)
    assert curve["a", 3.0] == pytest.approx(0.375)
    assert curve["b", 2.0] == 1.0


def test_risk_before_the_first_time_is_zero(spark):
    curve = survival.km(spells(spark, [("a", 5, 1), ("a", 9, 1)]), "g")
    got = {r.horizonte: r.riesgo for r in survival.risk_at(curve, (1, 5, 6, 12)).collect()}
    assert got == {1: 0.0, 5: 0.5, 6: 0.5, 12: 1.0}


def test_curve_needs_all_months(spark):
    df = spark.createDataFrame([("a", 0.5)], "AFILIADO_ID_EPS string, S_1m double")
    with pytest.raises(ValueError, match="S_120m"):
        survival.curve_long(df)


def test_monthly_curves_are_worked_out_in_many_tasks(spark, folder):
    import __spark_entry__
    from anchorage.plans.tables import Tables

    long = __spark_entry__.queries()["curve_long"](spark, folder)
    one = Tables(spark, folder).raw("customer")
    assert one.rdd.getNumPartitions() == 1 and long.rdd.getNumPartitions() >= 8
    assert long.count() == 120 * one.count()


def test_assign_group(spark):
    def row(r12):
        return (str(r12), *[(1 - r12) ** (m / 12) for m in range(1, 121)])

    names = ["AFILIADO_ID_EPS", *[f"S_{m}m" for m in range(1, 121)]]
    df = spark.createDataFrame([row(r) for r in (0.9, 0.6, 0.35, 0.1, 0.0)], names)
    got = {r.AFILIADO_ID_EPS: (r.grupo, r.mes_gatillo) for r in survival.assign_group(df).collect()}
    assert got["0.9"] == ("CRITICO", 2)
    assert got["0.6"] == ("ALTO", 5)
    assert got["0.35"] == ("ESTRATEGIA_PROACTIVA", 10)
    assert got["0.1"] == ("BAJO", 41)
    assert got["0.0"] == ("BAJO", None)


def planted(n=1500):
    draw = random.Random(1)
    rows = []
    for i in range(n):
        x, z = draw.gauss(0, 1), draw.gauss(0, 1)
        t = draw.expovariate(0.1 * math.exp(0.8 * x - 0.4 * z))
        stop = draw.uniform(2, 25)
        rows.append((i, x, z, round(min(t, stop), 1) + 0.1, int(t <= stop)))
    return rows


def test_cox_finds_planted_effects_and_matches_brute_force(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "id long, x double, z double, t_m double, event int")
    got = {r.variable: r.coef for r in models.fit_cox(df, ["x", "z"]).collect()}
    assert got["x"] == pytest.approx(0.8, abs=0.12)
    assert got["z"] == pytest.approx(-0.4, abs=0.12)
    # The score of the partial likelihood vanishes at the fitted point.
    a = np.array([[r[1], r[2]] for r in rows])
    t, e = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    w = np.exp(a @ np.array([got["x"], got["z"]]))
    slope = np.zeros(2)
    for i in np.flatnonzero(e):
        at_risk = t >= t[i]
        slope += a[i] - (w[at_risk, None] * a[at_risk]).sum(0) / w[at_risk].sum()
    assert np.abs(slope).max() < 1e-5


def test_person_months_equal_the_plain_expansion(spark):
    rows = [(1.0, 2.3, 1), (1.0, 2.9, 1), (1.0, 2.5, 0), (2.0, 0.0, 1), (2.0, 3.0, 1)]
    df = spark.createDataFrame(rows, "f double, t_m double, event int")
    got = {(r.f, r.mes, r.label): r.peso for r in models.person_months(df, ["f"]).collect()}
    want = {}
    for f, t, e in rows:
        last = max(1, math.ceil(t))
        for m in range(1, last + 1):
            key = (f, float(m), float(e == 1 and m == last))
            want[key] = want.get(key, 0) + 1
    assert got == want


def test_logit_learns_and_weights_classes(spark):
    draw = random.Random(2)
    rows = []
    for i in range(800):
        x = draw.gauss(0, 1)
        rows.append((i, x, draw.gauss(0, 1), int(draw.random() < 1 / (1 + math.exp(2.5 - 2 * x)))))
    df = spark.createDataFrame(rows, "id long, x double, noise double, Es_Fuga_Real int")
    model = models.fit_logit(df, ["x", "noise"], "Es_Fuga_Real")
    scored = models.score(model, df, ["x", "noise"], ["id", "Es_Fuga_Real"])
    assert checks.auc(scored).first().auc > 0.8
    assert models.importance(df, model, ["x", "noise"]).first().variable == "x"
    weighted = models.with_class_weight(df, "Es_Fuga_Real").groupBy("Es_Fuga_Real").agg(F.sum("peso").alias("w")).collect()
    assert weighted[0].w == pytest.approx(weighted[1].w)


def test_gbt_and_calibration(spark):
    draw = random.Random(4)
    rows = []
    for i in range(800):
        x = draw.random()
        rows.append((i, x, int(draw.random() < x * x)))
    df = spark.createDataFrame(rows, "id long, x double, y int")
    gbt = models.score(models.fit_gbt(df, ["x"], "y", "id", 8), df, ["x"], ["id", "y"])
    found = checks.auc(gbt.withColumnRenamed("y", "Es_Fuga_Real")).first().auc
    assert found > 0.7
    iso = models.calibrate(df, "x", "y", "isotonic").orderBy("x").collect()
    assert all(a.calibrada <= b.calibrada + 1e-12 for a, b in zip(iso, iso[1:], strict=False))
    platt = models.calibrate(df, "x", "y", "platt").orderBy("x").collect()
    assert platt[0].calibrada < platt[-1].calibrada
    assert sum(r.calibrada for r in platt) == pytest.approx(sum(r.y for r in platt), rel=0.02)


def test_hazard_curve_never_rises(spark):
    rows = [(float(i % 2), 1.0 + (i % 7) * (1 + i % 2), 1) for i in range(200)]
    model = models.fit_hazard(spark.createDataFrame(rows, "f double, t_m double, event int"), ["f"], 5, 3)
    profiles = spark.createDataFrame([("p0", 0.0), ("p1", 1.0)], "k string, f double")
    curve = models.hazard_curve(model, profiles, "k", 12).orderBy("k", "t").collect()
    for a, b in zip(curve, curve[1:], strict=False):
        assert a.k != b.k or b.S_t <= a.S_t + 1e-12
    risks = models.score_profiles(model, profiles, "k", ["f"], (3, 12)).collect()
    assert all(r.risk_3m <= r.risk_12m for r in risks)


def test_select_k_and_segments(spark):
    draw = random.Random(6)
    rows = [(draw.gauss(8 * (i % 3), 0.4), draw.gauss(-5 * (i % 3), 0.4)) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, y double")
    table = {r.k: r for r in models.select_k(df, ["x", "y"], (2, 3)).collect()}
    assert table[3].costo < table[2].costo and table[3].silueta > table[2].silueta
    sizes = [r["count"] for r in models.fit_segments(df, ["x", "y"], 3).groupBy("segmento").count().collect()]
    assert sorted(sizes) == [100, 100, 100]


def test_encode_profiles_of_mixed_spellings(spark):
    rows = [("2", "ORO", "M", None, "1", None, "A_B"), (None, None, None, "sí", None, "0", "x"), ("BAJA", "9", "f", "no", None, None, None)]
    df = spark.createDataFrame(rows, "CONDICION_SALUD string, PLAN string, Sexo_Cd string, POLIZA string, RAMO_FAMILIAR string, RAMO_FAMILIAR_BIN string, TIPO_IPS string")
    got = models.encode_profiles(df, levels={"TIPO_IPS": ("A B", "x")})
    names = ("CONDICION_SALUD_COD", "PLAN_COD", "Sexo_Cd_BIN", "POLIZA_BIN", "RAMO_FAMILIAR", "TIPO_IPS_A B", "TIPO_IPS_x")
    assert [tuple(r[n] for n in names) for r in got.collect()] == [(2, 3, 1, -1, 1, 1, 0), (4, 5, -1, 1, 0, 0, 1), (1, 9, 0, 0, -1, 0, 0)]


def test_encode_profiles(spark):
    df = spark.createDataFrame([("ALTA", None), ("new", "A")], "CONDICION_SALUD string, NIVEL_INGRESO string")
    got = [(r.CONDICION_SALUD_COD, r.NIVEL_INGRESO_COD) for r in models.encode_profiles(df).collect()]
    assert got == [(3.0, 4.0), (4.0, 1.0)]


def test_concordance_of_any_real_risk(spark):
    from anchorage.operators import survival

    draw = random.Random(8)
    rows = [(float(draw.randint(1, 30)), draw.randint(0, 1), draw.choice([-3.0, 2.5, 1e-7, 4e-7, 1e12, draw.gauss(0, 5)])) for _ in range(150)]
    odd = [(3.0, 1, None), (None, 1, 2.0), (4.0, None, 1.0), (5.0, 1, float("nan"))]
    df = spark.createDataFrame(rows + odd, "t double, e int, r double")
    met = [(a, b) for a in rows for b in rows if a[1] == 1 and a[0] < b[0]]
    won, tied = sum(a[2] > b[2] for a, b in met), sum(a[2] == b[2] for a, b in met)
    got = survival.c_index(df, "t", "e", "r").first()
    assert (got.concordantes, got.empates, got.comparables) == (won, tied, len(met))
    assert got.c_index == pytest.approx((won + tied / 2) / len(met))
    assert survival.c_index(df.limit(0), "t", "e", "r").first().c_index is None


def test_isotonic_tells_close_scores_apart(spark):
    df = spark.createDataFrame([(0.12341, 0), (0.12344, 1)], "x double, y int")
    assert [r.calibrada for r in models.calibrate(df, "x", "y", "isotonic").orderBy("x").collect()] == [0.0, 1.0]


def test_cox_tells_whether_it_converged(spark):
    draw = random.Random(9)
    rows = [(float(draw.randint(1, 20)), draw.randint(0, 1), draw.gauss(0, 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "t_m double, event int, x double")
    assert models.fit_cox(df, ["x"]).first().converge
    assert not models.fit_cox(df, ["x"], steps=1).first().converge


def test_cox_does_not_converge_where_an_input_separates_the_events(spark):
    rows = [(float(i + 1), 1, 40.0 - i) for i in range(30)] + [(float(40 + i), 0, 0.0) for i in range(30)]
    df = spark.createDataFrame(rows, "t_m double, event int, x double")
    found = models.fit_cox(df, ["x"]).first()
    assert not found.converge and found.pasos < 50 and math.isfinite(found.coef)


def test_cox_halves_a_step_that_goes_too_far(spark):
    draw = random.Random(3)
    # A few extreme inputs make the first Newton step overshoot.
    rows = [(draw.expovariate(1.0) + 0.01, 1, draw.choice([0.0, 0.0, 0.1, 60.0])) for _ in range(150)]
    rows = [(t / (1 + x), e, x) for t, e, x in rows]
    df = spark.createDataFrame(rows, "t_m double, event int, x double")
    found = models.fit_cox(df, ["x"]).first()
    assert found.converge and abs(found.gradiente) < 1e-8


def test_cox_with_nobody(spark):
    df = spark.createDataFrame([], "t_m double, event int, x double")
    assert models.fit_cox(df, ["x"]).first().coef == 0.0


def test_gbt_stops_at_the_least_loss(spark):
    draw = random.Random(6)
    rows = [(i, x := draw.random(), int(draw.random() < x), draw.random()) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, x double, y int, noise double")
    curve = models.stopping_curve(df, ["x", "noise"], "y", "id", 25).orderBy("arboles").collect()
    losses = [r.perdida for r in curve]
    assert [r.arboles for r in curve] == list(range(1, 26))
    assert [i for i, r in enumerate(curve) if r.elegido] == [losses.index(min(losses))]
    # The loss of the first trees, from the trees themselves.
    held = models.boosting_rows(df, ["x", "noise"], "y", "id")
    model = models.boosted_trees("y", 3).fit(held.where(~F.col("valida")))
    margin = np.zeros(held.where("valida").count())
    y = np.array([r.y for r in held.where("valida").select("y").collect()]) * 2 - 1
    w = np.array([r.peso for r in held.where("valida").select("peso").collect()])
    for k, tree in enumerate(model.trees):
        told = tree.transform(held.where("valida").drop("prediction", "leafId")).collect()
        margin += model.treeWeights[k] * np.array([r.prediction for r in told])
        plain = np.mean(2 * np.log1p(np.exp(-2 * y * margin)))
        weighted = np.average(2 * np.log1p(np.exp(-2 * y * margin)), weights=w)
        assert min(abs(plain - losses[k]), abs(weighted - losses[k])) < 1e-6


def test_score_equations_hold_for_a_weighted_logit(spark):
    draw = random.Random(8)
    rows = [(i, x := draw.gauss(0, 1), draw.gauss(5, 3), int(draw.random() < 1 / (1 + math.exp(-x)))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x double, z double, y int")
    weighted = models.with_class_weight(df, "y")
    scored = models.score(models.fit_logit(df, ["x", "z"], "y"), weighted, ["x", "z"], ["y", "peso", "x", "z"])
    found = models.balance(scored, ["x", "z"], "y", "peso", "Probabilidad").collect()
    assert [r.variable for r in found] == [models.INTERCEPT, "x", "z"]
    assert all(r.observado == pytest.approx(r.ajustado, abs=1e-4) for r in found)


def test_silhouette_equals_the_pairs(spark):
    draw = random.Random(5)
    rows = [(draw.choice("abc"), draw.gauss(0, 1), None if i % 9 == 0 else draw.gauss(0, 2)) for i in range(90)] + [("alone", 9.0, 9.0), (None, 1.0, 1.0)]
    got = models.silhouette(spark.createDataFrame(rows, "g string, x double, y double"), ["x", "y"], "g").first()
    points = [(g, np.array([x, y or 0.0])) for g, x, y in rows if g]
    values = []
    for i, (g, p) in enumerate(points):
        away = {}
        for j, (h, q) in enumerate(points):
            if i != j:
                away.setdefault(h, []).append(((p - q) ** 2).sum())
        means = {h: np.mean(v) for h, v in away.items()}
        a, b = means.get(g), min(v for h, v in means.items() if h != g)
        values.append(0.0 if a is None else (b - a) / max(a, b))
    assert got.n == 91 and got.silueta == pytest.approx(np.mean(values))
    assert models.silhouette(spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, x double"), ["x"], "g").first().silueta == 0.0


def test_centres_are_the_means_of_their_rows(spark):
    draw = random.Random(12)
    df = spark.createDataFrame([(draw.gauss(i % 3 * 4, 1), draw.random()) for i in range(300)], "x double, y double")
    assert all(r.desvio < 1e-9 and r.filas == 300 for r in models.centre_gaps(df, ["x", "y"], 3).collect())


def test_profiles_that_lack_different_fields_are_scored_apart(spark):
    rows = [(1, None, 1.0), (2, 1.0, None), (3, None, 1.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    keys = df.select("id", F.to_json(F.array(F.col("a").cast("string"), F.col("b").cast("string"))).alias("k")).collect()
    assert keys[0].k == keys[2].k != keys[1].k


def test_the_two_policy_forms_have_their_own_spellings(spark):
    df = spark.createDataFrame([("Y", "Y"), (None, "true"), (None, "FALSE"), ("n", "SI"), ("TRUE", None)], "POLIZA_BIN string, POLIZA string")
    assert [r.POLIZA_BIN for r in models.encode_profiles(df).select("POLIZA_BIN").collect()] == [1.0, 1.0, 0.0, 0.0, -1.0]
