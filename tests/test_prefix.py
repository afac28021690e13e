"""Prefix operators, bins and pair counts against brute force, on skewed rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorage.functions import draws
from anchorage.operators import bins, checks, impact, integrate, risk, survival
from anchorage.operators.explain import sample_by_group, scale01
from anchorage.operators.prefix import at_places, exact_quantiles, piece_bits, pruned, ranked, running_before, top_n
from anchorage.session import lookup_join, scratch_path, shared_folder


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the scores are one value, the rest crowd near zero or are missing."""
    draw = random.Random(7)
    rows = []
    for i in range(3000):
        kind = i % 3
        score = 0.25 if kind == 0 else (draw.random() ** 8 if kind == 1 else round(draw.random(), 2))
        rows.append((i, None if i % 101 == 0 else score, int(draw.random() < (score or 0)), "hot" if i % 2 else f"g{i % 40}"))
    return rows, spark.createDataFrame(rows, "id long, Probabilidad double, Es_Fuga_Real int, g string")


def md5_bits(key):
    import hashlib

    return int(hashlib.md5(str(key).encode()).hexdigest()[:8], 16)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), md5_bits(r[0]), r[0]))


def test_ranked(skewed):
    rows, df = skewed
    want = {r[0]: i + 1 for i, r in enumerate(ordered(rows))}
    assert {r.id: r["rank"] for r in ranked(df, "Probabilidad", "id").collect()} == want


def test_top_n_by_either_way(skewed, monkeypatch):
    rows, df = skewed
    want = {r[0] for r in ordered(rows)[:1200]}
    assert {r.id for r in top_n(df, 1200, "Probabilidad", "id").collect()} == want
    monkeypatch.setattr("anchorage.operators.prefix.PAGE", 10**6)
    assert {r.id for r in top_n(df, 1200, "Probabilidad", "id").collect()} == want
    assert top_n(df, 10**6, "Probabilidad", "id").count() == 3000


def test_exact_quantiles_by_group(skewed):
    rows, df = skewed
    probs = [0, 0.1, 1 / 3, 0.5, 0.9, 1]
    got = {r.g: r.q for r in exact_quantiles(df, F.col("Probabilidad"), probs, ["g"]).collect()}
    for g in {r[3] for r in rows}:
        values = [r[1] for r in rows if r[3] == g and r[1] is not None]
        assert got[g] == pytest.approx(np.quantile(values, probs), abs=1e-12)


def test_qcut_keeps_ties_together(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 3.0, 4.0, None, 5.0]], "v double")
    got = [(r.v, r.bin) for r in bins.qcut(df, "v", 4).collect()]
    assert len({b for v, b in got if v == 1.0}) == 1
    assert [b for v, b in got if v is None] == [None]
    assert max(b for _, b in got if b is not None) < 4
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r.bin for r in bins.qcut(same, "v", 4).collect()] == [None, None]


def test_risk_deciles_with_dropped_edges(spark):
    df = spark.createDataFrame([(i, 0.0 if i < 50 else i / 100) for i in range(100)], "id long, Probabilidad double")
    labels = {r.decil for r in bins.risk_deciles(df, "Probabilidad").collect()}
    assert max(labels) == 10
    assert min(labels) == 11 - len(labels)


def test_rank_deciles_are_equal(skewed):
    _, df = skewed
    rows, _ = skewed
    known = sum(r[1] is not None for r in rows)
    counts = {r.decil: r["count"] for r in bins.rank_deciles(df, "Probabilidad", "id").groupBy("decil").count().collect()}
    assert counts.pop(None, 0) == len(rows) - known
    assert sorted(counts) == list(range(1, 11))
    assert all(abs(n - known / 10) <= 1 for n in counts.values())


def test_auc(skewed):
    rows, df = skewed
    pos = [r[1] for r in rows if r[2] == 1 and r[1] is not None]
    neg = [r[1] for r in rows if r[2] == 0 and r[1] is not None]
    won = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    assert checks.auc(df).first().auc == pytest.approx(won / (len(pos) * len(neg)))


def test_c_index_counts_every_pair(spark):
    draw = random.Random(3)
    rows = [(draw.randint(1, 30) / 2, draw.randint(0, 1), 0.5 if draw.random() < 0.4 else draw.random()) for _ in range(400)]
    won = pairs = 0
    for t1, e, r1 in rows:
        for t2, _, r2 in rows:
            if e and t1 < t2:
                a, b = round(r1 * 1e6), round(r2 * 1e6)
                pairs += 1
                won += (a > b) + (a == b) / 2
    got = survival.c_index(spark.createDataFrame(rows, "t double, e int, r double"), "t", "e", "r").first()
    assert got.comparables == pairs
    assert got.c_index == pytest.approx(won / pairs)


def test_profit_by_n_equals_sorted_sum(spark):
    draw = random.Random(5)
    risks = [0.3 if draw.random() < 0.4 else round(draw.random(), 3) for _ in range(900)]
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(risks)], "AFILIADO_ID_EPS string, risk_12m double")
    plan = impact.Campaign(budget=500)
    got = {r.k: r.fugas_esp for r in impact.profit_by_n(df, plan).collect()}
    top = np.cumsum(sorted(risks, reverse=True))
    assert 500 in got and 50 in got
    for k, v in got.items():
        assert v == pytest.approx(top[k - 1])


def test_curve_points(spark):
    def ks(rows, budget):
        return sorted(r.k for r in impact.curve_points(spark.range(rows), budget).collect())

    assert ks(5, 3) == [3, 5] or ks(5, 3)[0] == 3
    descending = ks(1000, 20)
    assert descending[0] == 20 and descending[-1] == 50
    assert ks(10_000, 9)[-1] == 100
    assert len(ks(10_000, 2450)) == 25


def test_kpis_agree_with_the_grid_and_the_summary(spark):
    df = spark.createDataFrame([(str(i), (i % 50) / 50) for i in range(400)], "AFILIADO_ID_EPS string, risk_12m double")
    plan = impact.Campaign(ltv=720_000, budget=120)
    one = impact.impact_summary(df, plan).first()
    params = spark.createDataFrame(
        [(1, plan.ltv * 1.0, plan.call_cost * 1.0, plan.incentive * 1.0, plan.success, plan.budget), (2, 1.0, 0.0, 0.0, 0.5, None)],
        "campaign_id int, ltv double, call_cost double, incentive double, success double, budget int",
    )
    many = {r.campaign_id: r for r in impact.impact(df, params).collect()}
    assert many[1].ganancia_neta == pytest.approx(one.ganancia_neta)
    assert many[1].roi == pytest.approx(one.roi)
    assert many[2].n == 100 and many[2].roi is None
    cells = {(r.incentivo, r.exito): r.ganancia_neta for r in impact.grid_expected(df, plan).collect()}
    assert cells[180_000.0, 0.3] == pytest.approx(one.ganancia_neta)
    assert len(cells) == 240


def test_roi_zero_counts_as_unset(spark):
    df = spark.createDataFrame([(1, 0.9, 1)], "id long, Probabilidad double, Es_Fuga_Real int")
    assert impact.roi(df, impact.Campaign()) is None
    assert impact.roi(df, impact.Campaign(), top=0, threshold=0.0) is None
    free = impact.Campaign(call_cost=0, incentive=0)
    assert impact.roi(df, free, top=5).first().roi_pct == 0.0


def test_threshold_curve_counts_each_score(skewed):
    rows, df = skewed
    curve = impact.threshold_curve(df, impact.Campaign()).collect()
    assert len(curve) == 100
    for r in curve:
        assert r.gestionados == sum(1 for x in rows if x[1] is not None and x[1] >= r.umbral)


def test_window_counts_on_a_hot_affiliate(spark):
    draw = random.Random(11)
    day = "2024-01-01"
    spells = [("hot" if i % 3 else f"a{i}", i, draw.randint(0, 60), draw.randint(-5, 40)) for i in range(300)]
    events = [("hot" if draw.random() < 0.6 else f"a{draw.randint(0, 300)}", draw.randint(0, 110), draw.choice("QP"), "PAC") for _ in range(800)]
    s = spark.createDataFrame(spells, "AFILIADO_ID_EPS string, spell_id int, a int, b int").select(
        "AFILIADO_ID_EPS",
        "spell_id",
        F.date_add(F.lit(day), F.col("a")).alias("FECHA_INICIO"),
        F.date_add(F.lit(day), F.col("a") + F.col("b")).alias("FECHA_FIN"),
    )
    e = spark.createDataFrame(events, "AFILIADO_ID_EPS string, d int, tipo string, plan string").withColumn(
        "fecha", F.date_add(F.lit(day), F.col("d"))
    )
    got = {r.spell_id: (r.Q_PAC, r.P_PAC) for r in integrate.counts_in_window(s, e, ["Q", "P"], ["PAC"], F.col("FECHA_FIN")).collect()}
    for who, i, a, b in spells:
        inside = [x[2] for x in events if x[0] == who and a <= x[1] <= a + b]
        assert got[i] == (inside.count("Q"), inside.count("P"))


def test_sample_by_group_is_whole_and_repeatable(spark):
    df = spark.range(5000).select(F.col("id").alias("ID"), F.when(F.col("id") % 4 == 0, "small").otherwise("big").alias("feature"))
    one = sample_by_group(df, "feature", "ID", 2000)
    sizes = {r.feature: r["count"] for r in one.groupBy("feature").count().collect()}
    assert sizes == {"small": 1250, "big": 2000}
    two = sample_by_group(df.repartition(7), "feature", "ID", 2000)
    assert {r.ID for r in one.collect()} == {r.ID for r in two.collect()}


def test_scale01_rules(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", None), ("k", 2.0), ("k", None), ("n", None)]
    df = spark.createDataFrame(rows, "feature string, feature_value double")
    chart = sorted((r.feature, r.fv01) for r in scale01(df, 0.5).collect())
    assert chart == [("a", 0.0), ("a", 0.5), ("a", 1.0), ("k", 0.5), ("k", 0.5), ("n", 0.5)]
    gaps = [(r.feature, r.feature_value, r.fv01) for r in scale01(df, None).collect()]
    assert ("a", None, None) in gaps and ("n", None, None) in gaps and ("k", None, 0.5) in gaps


def test_lift_ends_at_full_coverage(skewed):
    _, df = skewed
    table = checks.lift(df).collect()
    assert None not in {r.decil for r in table} and table == checks.lift(df.where(F.col("Probabilidad").isNotNull())).collect()
    assert table[-1].cobertura == pytest.approx(100.0)
    assert sum(r.clientes for r in table) == df.where(F.col("Probabilidad").isNotNull()).count()


def test_lookup_join_either_way(spark):
    big = spark.range(100).select((F.col("id") % 5).alias("k"))
    small = spark.range(4).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for limit in (1, 100):
        joined = lookup_join(big, small, "k", max_rows=limit)
        assert joined.count() == 100
        assert joined.where(F.col("v").isNull()).count() == 20
    assert "BroadcastExchange" in lookup_join(big, small, "k")._jdf.queryExecution().executedPlan().toString()


def test_shared_folder_is_the_sessions(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark)
    assert named is None or shared_folder(spark) == named
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_no_cross_joins_or_python_in_plans(spark, folder):
    from anchorage.plans import ORACLES, QUERIES

    for name in ("impact_kpis", "vulnerability_matrix", "c_index", "sensitivity_expected", "window_aligned_counts"):
        assert name in ORACLES
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
            assert word not in plan, (name, word)


def test_last_spell_drops_rows_before_the_shuffle(spark, folder):
    from anchorage.plans import QUERIES

    assert "WindowGroupLimit" in QUERIES["last_spell"](spark, folder)._jdf.queryExecution().executedPlan().toString()


def test_quantiles_keep_the_asked_probability(spark):
    values = [float(v * v) for v in range(2001)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [1e-5, 0.99999, 1 / 3, 0.123456789]
    assert exact_quantiles(df, F.col("v"), probs).first().q == pytest.approx(np.quantile(values, probs), rel=1e-12)


def test_scores_that_are_missing_belong_to_no_bin(spark):
    rows = [(0.05, 0), (0.95, 1), (0.97, 0), (None, 1), (None, 1), (float("nan"), 1)]
    df = spark.createDataFrame(rows, "Probabilidad double, Es_Fuga_Real int")
    assert {r.bin: (r.n, r.tasa) for r in checks.calibration(df).collect()} == {0: (1, 0.0), 9: (2, 0.5)}
    assert checks.cum_capture(df).agg(F.max("cobertura")).first()[0] == 100.0


def test_top_n_reaches_rows_without_a_score(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(1500)] + [(9000 + i, None) for i in range(800)], "id long, s double")
    got = top_n(df, 2000, "s", "id").collect()
    assert len(got) == 2000 and sum(r.s is None for r in got) == 500
    assert sorted(r.s for r in top_n(df, 1200, "s", "id").collect()) == [0.0] * 200 + [1.0] * 500 + [2.0] * 500


def test_top_n_by_every_way_on_ties_and_missing_scores(spark, monkeypatch):
    draw = random.Random(2)
    rows = [(i, draw.choice([0.5, 0.5, round(draw.random(), 3), None, float("nan") if i % 50 == 0 else 0.5])) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, s double").repartition(9)
    high = lambda s: (s is None, 0 if s is None else (-math.inf if math.isnan(s) else -s))
    want = [r[0] for r in sorted(rows, key=lambda r: (*high(r[1]), md5_bits(r[0]), r[0]))]
    monkeypatch.setattr("anchorage.operators.prefix.PAGE", 10)
    for large in (10**6, 10):
        monkeypatch.setattr("anchorage.operators.prefix.LARGE_PAGE", large)
        for n in (11, 300, 1500, 3900, 5000):
            assert {r.id for r in top_n(df, n, "s", "id").collect()} == set(want[:n]), (large, n)


def test_the_bound_prunes_rows_and_loses_none(spark):
    df = spark.range(100_000).select("id", (F.col("id") * 7919 % 100_000 / 100_000).alias("s"))
    left = pruned(df, 2_000, "s").count()
    assert 2_000 <= left < 3_500
    assert pruned(df, 10**6, "s").count() == 100_000
    assert pruned(df.where("id < 0"), 5, "s").count() == 0
    plan = top_n(df, 2_000, "s", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "Subquery" in plan


def test_places_find_their_rows(spark):
    draw = random.Random(4)
    values = [0.3 if draw.random() < 0.4 else round(draw.random(), 2) for _ in range(2500)]
    counts = spark.createDataFrame([(v,) for v in values], "v double").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    run = running_before(counts, "v", ["n"], descending=True, pieces=True)
    wanted = spark.createDataFrame([(k, k % 7) for k in (0, 1, 24, 25, 26, 700, 1300, 2498, 2499)], "k long, v2 long")
    got = {r.k: r.v for r in at_places(run, "n_before", wanted, "k", piece_bits(counts)).collect()}
    order = sorted(values, reverse=True)
    assert got == {k: order[k] for k in got} and len(got) == 9


def test_sketches_of_nothing(spark):
    none = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert exact_quantiles(none.where("v is null"), F.col("v"), [0.5]).first().q == [None]
    assert ranked(none.withColumn("id", F.monotonically_increasing_id()), "v", "id").count() == 2


def test_bootstrap_band_equals_the_same_draws_in_python(spark):
    import hashlib

    draw = random.Random(7)
    rows = [(i, "abc"[i % 3] if i % 10 else None, None if i % 17 == 0 else draw.random()) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, g string, Riesgo_Calculado double")
    got = {r.valor: (r.banda_inf, r.banda_sup) for r in risk.bootstrap_band(df, "g", "id", 60).collect()}
    for g in "abc":
        means = []
        for rep in range(1, 61):
            total = weight = 0
            for i, h, r in rows:
                if h == g and r is not None:
                    bits = int(hashlib.md5(f"{i}|{rep}".encode()).hexdigest()[:8], 16)
                    w = sum(bits >= cut for cut in risk.POISSON_CUTS)
                    total, weight = total + w * r, weight + w
            means.append(total / weight)
        assert got[g] == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))


def test_draws_are_those_of_md5():
    import hashlib

    ends = [str(i).encode() for i in (1, 9, 10, 999, 1000)]
    for starts in ([b""], [b"7|", b"8|"], [b"x" * 51] * 3, ["ñ".encode() * 26], [b"y" * 80, b"z" * 80]):
        want = [[int(hashlib.md5(a + b).hexdigest()[:8], 16) for b in ends] for a in starts]
        assert draws.md5_bits(starts, ends).tolist() == want
    bits = sorted({0, 2**32 - 1, *[cut + d for cut in risk.POISSON_CUTS for d in (-1, 0, 1) if cut + d < 2**32]})
    weights = draws.poisson_weights(np.array(bits, np.uint32))
    assert weights.tolist() == [sum(b >= cut for cut in risk.POISSON_CUTS) for b in bits]


def test_bootstrap_band_draws_in_many_tasks_from_rows_that_lie_in_one(spark):
    rows = [(i, "a", 0.5) for i in range(40)] + [(None, "b", 0.25), (None, "b", 0.25)]
    rows += [(i, "c", 0.5 if i else float("inf")) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, g string, Riesgo_Calculado double").coalesce(1)
    band = risk.bootstrap_band(df, "g", "id", 30)
    plan = band._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan[plan.index("MapInArrow") :]
    got = {r.valor: (r.banda_inf, r.banda_sup) for r in band.collect()}
    # The infinite risk counts only in the replicates that draw its row.
    assert got["a"] == (0.5, 0.5) and got["b"] == (0.25, 0.25) and got["c"] == (0.5, float("inf"))


def test_window_counts_keep_every_spell(spark):
    spells = [("a", 1, "2024-01-05", "2024-01-10"), ("a", 1, "2024-01-05", "2024-01-10"), ("a", 2, "2024-01-10", None), (None, 3, "2024-01-01", "2024-02-01")]
    spells += [("b", 4, None, "2024-01-10"), ("c", 5, "2024-01-10", "2024-01-01")]
    s = spark.createDataFrame(spells, "AFILIADO_ID_EPS string, Q_PAC int, i string, f string").select(
        "AFILIADO_ID_EPS", "Q_PAC", F.col("Q_PAC").alias("nr"), F.to_date("i").alias("FECHA_INICIO"), F.to_date("f").alias("FECHA_FIN")
    )
    events = [("a", "2024-01-05"), ("a", "2024-01-10"), ("a", "2024-01-11"), ("a", "2024-01-04"), (None, "2024-01-05"), ("a", None), ("c", "2024-01-05")]
    e = spark.createDataFrame(events, "AFILIADO_ID_EPS string, d string").select("AFILIADO_ID_EPS", F.to_date("d").alias("fecha"), F.lit("Q").alias("tipo"), F.lit("PAC").alias("plan"))
    got = sorted((r.nr, r.Q_PAC) for r in integrate.counts_in_window(s, e, ["Q"], ["PAC"], F.col("FECHA_FIN")).collect())
    assert got == [(1, 2), (1, 2), (2, 0), (3, 0), (4, 0), (5, 0)]


def test_c_index_over_several_digits(spark):
    draw = random.Random(13)
    rows = [(draw.randint(1, 9), draw.randint(0, 1), draw.random() if i % 4 else 0.5) for i in range(1500)]
    t, e, r = (np.array(x) for x in zip(*rows, strict=True))
    later = (t[:, None] < t[None, :]) & (e[:, None] == 1)
    want = (later & (r[:, None] > r[None, :])).sum(), (later & (r[:, None] == r[None, :])).sum(), later.sum()
    got = survival.c_index(spark.createDataFrame(rows, "t int, e int, r double"), "t", "e", "r").first()
    assert (got.concordantes, got.empates, got.comparables) == tuple(map(float, want))
    assert survival.c_index(spark.createDataFrame(rows[:1], "t int, e int, r double"), "t", "e", "r").first().c_index is None
    assert survival.c_index(spark.createDataFrame([], "t int, e int, r double"), "t", "e", "r").first().comparables == 0.0
