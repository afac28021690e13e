"""Fitting and scoring with Spark ML, and the survival fits built on aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorage.functions import columns as c
from anchorage.functions.columns import hash_percent
from anchorage.operators.clean import one_hot
from anchorage.operators.prefix import count_below, piece_bits, split_points
from anchorage.session import written

SEED = 42
#: Steps and tolerance of the logistic fits, close enough for their score equations to hold.
STEPS, TOLERANCE = 300, 1e-12
UNKNOWN = "unknown"
INTERCEPT = "intercepto"

# Ordinal levels of the profile fields, lowest first.
ORDINALS = {
    "CONDICION_SALUD": ("BAJA", "MEDIA", "ALTA"),
    "NIVEL_INGRESO": ("A", "B", "C"),
    "PLAN": ("BRONCE", "PLATA", "ORO", "DIAMANTE"),
}
# The profile fields that become one flag per level.
FAMILIES = ("SEGMENTO_EDAD", "TIPO_AFILIADO", "Regional_Agrupadora", "Compania", "TIPO_IPS")
NOT_GIVEN = -1.0

#: Standardised Cox coefficients beyond this have run away; most halvings of one step.
FARTHEST, HALVINGS = 20.0, 12


def filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})


def with_class_weight(df: DataFrame, label: str, out: str = "peso") -> DataFrame:
    """Weight rows so both classes count the same."""
    share = df.agg(F.avg(F.col(label).cast("double"))).scalar()
    p = F.col("_p")
    weight = F.when(F.col(label) == 1, F.try_divide(F.lit(0.5), p)).otherwise(F.try_divide(F.lit(0.5), 1 - p))
    return df.withColumn("_p", share).withColumn(out, F.coalesce(weight, F.lit(1.0))).drop("_p")


def assembled(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out)


# -- churn -----------------------------------------------------------------


def training_rows(df: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    """Just what a fit reads, written once: every stage of the fit passes over it."""
    return written(filled(df, features).select(*keep, *features))


def fit_logit(df: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    logit = LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="peso", maxIter=STEPS, tol=TOLERANCE)
    rows = training_rows(df, features, label)
    return Pipeline(stages=[assembled(features), scaler, logit]).fit(with_class_weight(rows, label))


def balance(scored: DataFrame, names: Sequence[str], label: str, weight: str, p: str) -> DataFrame:
    """Score equations of a fitted probability: (variable, observado, ajustado) per input and for the intercept.

    Both are weighted sums over the rows, of outcome times input and of probability
    times input; where a logistic fit without penalty is at its optimum they are equal.
    """
    w, y, q = F.col(weight), F.col(label).cast("double"), F.col(p)
    cells = [(INTERCEPT, F.lit(1.0)), *[(n, F.col(f"`{n}`").cast("double")) for n in names]]
    sums = [F.sum(w * v * x).alias(f"{kind}{i}") for i, (_, x) in enumerate(cells) for kind, v in (("y", y), ("p", q))]
    rows = [
        F.struct(F.lit(n).alias("variable"), F.col(f"y{i}").alias("observado"), F.col(f"p{i}").alias("ajustado"))
        for i, (n, _) in enumerate(cells)
    ]
    return scored.agg(*sums).select(F.inline(F.array(*rows)))


def spread_inputs(df: DataFrame, names: Sequence[str], weight: str) -> tuple[DataFrame, list[str]]:
    """Inputs divided by their spread, and weights by the number of rows, so that ``balance`` sums are of one size."""
    rows = filled(df, names)
    scales = rows.agg(F.struct(F.count(F.lit(1)).alias("n"), *[F.stddev_samp(f"`{n}`").alias(n) for n in names]).alias("s")).scalar()
    rows = rows.withColumn("_s", scales)
    rows = rows.withColumns({n: F.try_divide(F.col(f"`{n}`"), F.col(f"_s.`{n}`")) for n in names})
    return rows.withColumn(weight, F.col(weight) / F.col("_s.n")).drop("_s"), list(names)


def boosted_trees(label: str, rounds: int) -> GBTClassifier:
    return GBTClassifier(labelCol=label, weightCol="peso", maxIter=rounds, maxDepth=3, stepSize=0.2, seed=SEED)


def boosting_rows(df: DataFrame, features: Sequence[str], label: str, key: str) -> DataFrame:
    """Weighted rows with ``valida``, a hashed fifth of them, and their vectors, written once."""
    held_out = df.withColumn("valida", hash_percent(F.col(key)) < 20)
    rows = with_class_weight(training_rows(held_out, features, label, "valida"), label)
    return assembled(features).transform(rows)


def fit_gbt(df: DataFrame, features: Sequence[str], label: str, key: str, rounds: int = 20) -> PipelineModel:
    """Boosted trees; a hashed fifth of the rows stops the boosting early."""
    rows = boosting_rows(df, features, label, key)
    model = boosted_trees(label, rounds).setValidationIndicatorCol("valida").fit(rows)
    return PipelineModel([assembled(features), model])


def stopping_curve(df: DataFrame, features: Sequence[str], label: str, key: str, rounds: int = 20) -> DataFrame:
    """(arboles, perdida, elegido): loss on the held-out fifth by number of trees, for boosting that
    never stops early, and whether that number is the best one, the smaller on a tie."""
    rows = boosting_rows(df, features, label, key)
    model = boosted_trees(label, rounds).fit(rows.where(~F.col("valida")))
    losses = [float(x) for x in model.evaluateEachIteration(rows.where("valida"))]
    best = losses.index(min(losses))
    found = [(i + 1, x, i == best) for i, x in enumerate(losses)]
    return df.sparkSession.createDataFrame(found, "arboles int, perdida double, elegido boolean")


def score(model: PipelineModel, df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """P(churn) per row."""
    p = vector_to_array("probability")
    return model.transform(filled(df, features)).select(*keep, F.get(p, F.lit(1)).alias("Probabilidad"))


def importance(df: DataFrame, model: PipelineModel, features: Sequence[str], k: int = 10) -> DataFrame:
    """Top k inputs by importance, or by absolute coefficient; empty if the model has neither."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        weights = last.featureImportances.toArray()
    elif hasattr(last, "coefficients"):
        weights = np.abs(last.coefficients.toArray())
    else:
        weights = []
    rows = sorted(zip(features, map(float, weights), strict=False), key=lambda r: (-r[1], r[0]))[:k]
    return df.sparkSession.createDataFrame(rows, "variable string, peso double")


def calibrate(df: DataFrame, score_col: str, label: str, method: str = "platt") -> DataFrame:
    """Add ``calibrada``: the score mapped to a probability.

    Isotonic pooling is fed one weighted row per distinct score. Spark pools these
    within ranges first, so its last step sees pooled blocks only.
    """
    rows = df.withColumn("_y", F.col(label).cast("double"))
    if method == "platt":
        vector = assembled([score_col], "_x")
        logit = LogisticRegression(
            featuresCol="_x", labelCol="_y", probabilityCol="_p", rawPredictionCol="_r", maxIter=STEPS, tol=TOLERANCE
        )
        out = Pipeline(stages=[vector, logit]).fit(rows.select(score_col, "_y")).transform(rows)
        return out.select(*df.columns, F.get(vector_to_array("_p"), F.lit(1)).alias("calibrada"))
    step = F.col(score_col).cast("double")
    pooled = rows.groupBy(step.alias("_x")).agg(F.avg("_y").alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"))
    model = IsotonicRegression(featuresCol="_x", labelCol="_y", weightCol="_w", predictionCol="calibrada").fit(pooled)
    return model.transform(df.withColumn("_x", step)).select(*df.columns, "calibrada")


# -- segments --------------------------------------------------------------


def scaled_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    rows = filled(df, features)
    return Pipeline(stages=[assembled(features, "raw"), scaler]).fit(rows).transform(rows)


def kmeans(k: int) -> KMeans:
    """Seeded K-Means that ends when no centre moves any more."""
    return KMeans(k=k, seed=SEED, predictionCol="segmento", maxIter=STEPS, tol=0.0)


def fit_segments(df: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """Seeded K-Means on scaled features; adds ``segmento``."""
    rows = written(scaled_features(df, features))
    return kmeans(k).fit(rows).transform(rows).drop("raw", "features")


def centre_gaps(df: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """(variable, filas, desvio): the largest distance, on the scaled axis, between a centre and the mean of its rows."""
    rows = written(scaled_features(df, features))
    model = kmeans(k).fit(rows)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    place = vector_to_array("features")
    told = model.transform(rows).withColumn("_x", place)
    means = told.groupBy("segmento").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.get("_x", F.lit(i))).alias(f"m{i}") for i in range(len(features))])
    own = F.get(centres, F.col("segmento"))
    gaps = [F.max(F.abs(F.col(f"m{i}") - F.get(own, F.lit(i)))).alias(f"g{i}") for i in range(len(features))]
    cells = [
        F.struct(F.lit(f).alias("variable"), F.col("n").alias("filas"), F.col(f"g{i}").alias("desvio")) for i, f in enumerate(features)
    ]
    return means.agg(F.sum("n").alias("n"), *gaps).select(F.inline(F.array(*cells)))


def silhouette(df: DataFrame, features: Sequence[str], cluster: str) -> DataFrame:
    """One row (n, silueta): mean silhouette by squared distance, from sums per cluster.

    The mean squared distance of a row to a cluster follows from that cluster's count,
    sum and sum of squares, so no pair of rows is formed; these sums, a row for each
    cluster, are the only thing that is broadcast. A row alone in its cluster counts 0,
    as does every row where there is one cluster. Missing values are zero.
    """
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, f in enumerate(features)]
    rows = df.where(F.col(cluster).isNotNull()).select(F.col(cluster).alias("_c"), *x)
    own = range(len(features))
    square = reduce(lambda a, b: a + b, [F.col(f"_x{i}") * F.col(f"_x{i}") for i in own])
    rows = rows.withColumn("_q", square)
    sums = rows.groupBy("_c").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("_q").alias("q"), F.array(*[F.sum(f"_x{i}") for i in own]).alias("s")
    )
    # One element for each cluster.
    every = sums.agg(F.collect_list(F.struct("_c", "n", "q", "s")).alias("k")).scalar()
    dot = lambda s: reduce(lambda a, b: a + b, [F.col(f"_x{i}") * F.get(s, F.lit(i)) for i in own])
    total = lambda c: c["n"] * F.col("_q") - 2 * dot(c["s"]) + c["q"]
    placed = rows.withColumn("_k", every)
    mine = F.get(F.filter("_k", lambda c: c["_c"] == F.col("_c")), F.lit(0))
    others = F.transform(F.filter("_k", lambda c: c["_c"] != F.col("_c")), lambda c: total(c) / c["n"])
    a = F.when(mine["n"] > 1, F.greatest(total(mine), F.lit(0.0)) / (mine["n"] - 1))
    placed = placed.select(a.alias("a"), F.array_min(others).alias("b"))
    value = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return placed.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("silueta"))


def select_k(df: DataFrame, features: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """Training cost and silhouette for each k; the scaled rows are written once."""
    rows = written(scaled_features(df, features).select("features"))
    judge = ClusteringEvaluator(predictionCol="segmento")
    found = []
    for k in ks:
        model = kmeans(k).fit(rows)
        found.append((k, float(model.summary.trainingCost), float(judge.evaluate(model.transform(rows)))))
    return df.sparkSession.createDataFrame(found, "k int, costo double, silueta double")


# -- survival --------------------------------------------------------------


def encode_profiles(
    df: DataFrame, ordinals: Mapping[str, Sequence[str]] = ORDINALS, levels: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Every profile field as a number.

    Ordinal fields count from 1; a missing or unseen level takes the code after the
    last, and a field that is a number already keeps it. Sex and policy may be given
    as 0/1 or as text, the family branch as RAMO_FAMILIAR or RAMO_FAMILIAR_BIN; not
    given is -1; the two policy fields have their own spellings of yes and no. Each field of ``levels`` becomes one flag per level.
    """
    text = {n: F.col(n).cast("string") for n in df.columns}

    def code(name: str, known: Sequence[str]) -> Column:
        place = F.array_position(F.array(*map(F.lit, known)), F.coalesce(text[name], F.lit(UNKNOWN)))
        unseen = F.coalesce(text[name].try_cast("int"), F.lit(len(known) + 1))
        return F.when(place > 0, place).otherwise(unseen).cast("double")

    def given(*spellings: Column) -> Column:
        return F.coalesce(*spellings, F.lit(NOT_GIVEN)).cast("double")

    def number(name: str) -> Column:
        return text[name].try_cast("int") if name in text else F.lit(None).cast("int")

    sex = c.sex_bin(text["Sexo_Cd"]) if "Sexo_Cd" in text else F.lit(None).cast("int")
    policy = [c.yes_no_bin(text[n], form) for n, form in (("POLIZA_BIN", "profile"), ("POLIZA", "table")) if n in text]
    coded = df.withColumns({f"{n}_COD": code(n, known) for n, known in ordinals.items() if n in text})
    coded = coded.withColumns(
        {
            "Sexo_Cd_BIN": given(number("Sexo_Cd_BIN"), sex),
            "POLIZA_BIN": given(number("POLIZA_BIN"), *policy),
            "RAMO_FAMILIAR": given(number("RAMO_FAMILIAR"), number("RAMO_FAMILIAR_BIN")),
        }
    )
    for name, known in (levels or {}).items():
        coded = one_hot(coded, name, f"{name}_", known)
    return coded


def person_months(df: DataFrame, features: Sequence[str], time: str = "t_m", event: str = "event") -> DataFrame:
    """One weighted row per month lived, with the event on the last month only.

    Rows that share features, last month and event are counted first, so the
    expansion grows with the distinct profiles and not with the affiliates.
    """
    last = F.greatest(F.ceil(time), F.lit(1)).cast("int")
    counts = df.groupBy(*features, last.alias("_last"), F.col(event).alias("_event")).agg(F.count(F.lit(1)).alias("_n"))
    months = counts.withColumn("mes", F.explode(F.sequence(F.lit(1), F.col("_last"))))
    label = ((F.col("mes") == F.col("_last")) & (F.col("_event") == 1)).cast("double")
    lived = months.groupBy(*features, "mes", label.alias("label")).agg(F.sum("_n").cast("double").alias("peso"))
    return lived.withColumn("mes", F.col("mes").cast("double"))


def fit_hazard(df: DataFrame, features: Sequence[str], trees: int = 10, depth: int = 5) -> PipelineModel:
    """Random forest on the monthly hazard."""
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, weightCol="peso", labelCol="label", seed=SEED)
    return Pipeline(stages=[assembled([*features, "mes"]), forest]).fit(written(person_months(df, features)))


def fit_hazard_logit(lived: DataFrame, features: Sequence[str]) -> PipelineModel:
    """Logistic regression on the monthly hazard of ``person_months`` rows, the month being one more input."""
    logit = LogisticRegression(weightCol="peso", labelCol="label", maxIter=STEPS, tol=TOLERANCE)
    return Pipeline(stages=[assembled([*features, "mes"]), logit]).fit(written(lived.select(*features, "mes", "label", "peso")))


def with_hazard(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("hazard", F.get(vector_to_array("probability"), F.lit(1)))


def hazard_curve(model: PipelineModel, profiles: DataFrame, key: str, last_month: int = 24) -> DataFrame:
    """Survival per (profile, month) as the running product of 1 - hazard.

    Profiles are placed by key before the months are added, so the product
    needs no shuffle of the longer table.
    """
    placed = profiles.repartition(F.col(key))
    months = placed.withColumn("mes", F.explode(F.sequence(F.lit(1), F.lit(last_month))))
    months = months.withColumn("mes", F.col("mes").cast("double"))
    hazard = with_hazard(model, months)
    upto = Window.partitionBy(key).orderBy("mes").rowsBetween(Window.unboundedPreceding, 0)
    return hazard.select(
        key, F.col("mes").cast("int").alias("t"), "hazard", F.product(1 - F.col("hazard")).over(upto).alias("S_t")
    )


def score_profiles(
    model: PipelineModel, profiles: DataFrame, key: str, features: Sequence[str], horizons: Sequence[int]
) -> DataFrame:
    """Cancellation risk of every profile at each horizon.

    Profiles with the same features are scored once and joined back.
    """
    same = F.to_json(F.array(*[F.col(f"`{f}`").cast("string") for f in features]))
    rows = profiles.select(key, *features).withColumn("_same", same)
    curve = hazard_curve(model, rows.dropDuplicates(["_same"]).drop(key), "_same", max(horizons))
    picks = [F.max(F.when(F.col("t") == h, 1 - F.col("S_t"))).alias(f"risk_{h}m") for h in horizons]
    return rows.select(key, "_same").join(curve.groupBy("_same").agg(*picks), "_same").drop("_same")


def dated_horizons(risks: DataFrame, key: str, since: Column, horizons: Sequence[int]) -> DataFrame:
    """One row per profile and horizon: months, the date they end, risk and survival."""
    rows = F.array(
        *[
            F.struct(F.lit(h).alias("meses"), F.add_months(since, h).alias("fecha"), F.col(f"risk_{h}m").alias("risk"))
            for h in horizons
        ]
    )
    return risks.select(key, F.inline(rows)).withColumn("S_t", 1 - F.col("risk"))


def nearest_centre(df: DataFrame, features: Sequence[str], centres: Sequence[Sequence[float]], out: str = "segmento") -> DataFrame:
    """Assign rows to fixed centres by squared distance, the first on a tie; missing values are zero."""

    def cost(centre: Sequence[float]) -> Column:
        gaps = [F.col(f).cast("double") - F.lit(float(x)) for f, x in zip(features, centre, strict=True)]
        return reduce(lambda a, b: a + b, [g * g for g in gaps])

    costs = F.array(*[cost(x) for x in centres])
    return filled(df, features).withColumn(out, (F.array_position(costs, F.array_min(costs)) - 1).cast("int"))


def observed_hazard(lived: DataFrame) -> DataFrame:
    """Person-months, events and observed hazard per month of ``person_months`` rows."""
    events = F.sum(F.col("label") * F.col("peso"))
    return lived.groupBy(F.col("mes").cast("int").alias("mes")).agg(
        F.sum("peso").alias("meses_persona"), events.alias("eventos"), (events / F.sum("peso")).alias("observado")
    )


@dataclass
class CoxRows:
    """Prepared rows (t, piece, event, x0, x1, ...) with the means and spreads that scale their inputs."""

    rows: DataFrame
    means: np.ndarray
    sds: np.ndarray


def cox_rows(df: DataFrame, features: Sequence[str], time: str, event: str) -> CoxRows:
    """Standardised inputs and the piece of the time range that each row's time lies in, written once."""
    rows = filled(df, features)
    spread = rows.agg(*[f(c) for c in features for f in (F.avg, F.stddev_samp)]).first()
    means, sds = np.array(spread[0::2], dtype=float), np.array(spread[1::2], dtype=float)
    sds[~(sds > 0)] = 1.0
    scaled = [
        ((F.col(c) - float(m)) / float(s)).alias(f"x{i}") for i, (c, m, s) in enumerate(zip(features, means, sds, strict=True))
    ]
    ready = rows.select(F.col(time).alias("t"), F.col(event).cast("double").alias("event"), *scaled)
    bits = piece_bits(df)
    placed = ready.withColumn("_points", split_points(ready, F.col("t"), bits))
    placed = placed.select(count_below(F.col("_points"), F.col("t"), bits).alias("piece"), *ready.columns)
    return CoxRows(written(placed), means, sds)


def cox_sums(df: DataFrame, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Breslow log-likelihood, gradient and information at ``beta`` in one Spark job.

    Rows are summed per distinct time; the sums are cumulated inside pieces of the time
    range and over the pieces' totals, so no task holds all times. One row of
    p + p * p + 1 numbers comes back.
    """
    p = len(beta)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    eta = " + ".join(f"({float(b)!r}D) * x{i}" for i, b in enumerate(beta))
    sums = [F.sum("event").alias("d"), F.sum(F.expr(f"event * ({eta})")).alias("e0"), F.sum("w").alias("s0")]
    sums += [F.sum(F.expr(f"event * x{i}")).alias(f"e{i + 1}") for i in range(p)]
    sums += [F.sum(F.expr(f"w * x{i}")).alias(f"s_{i}") for i in range(p)]
    sums += [F.sum(F.expr(f"w * x{i} * x{j}")).alias(f"s_{i}_{j}") for i, j in pairs]
    per_time = df.withColumn("w", F.exp(F.expr(eta))).groupBy("piece", "t").agg(*sums)
    cumulated = ["s0", *[f"s_{i}" for i in range(p)], *[f"s_{i}_{j}" for i, j in pairs]]
    totals = per_time.groupBy("piece").agg(*[F.sum(c).alias(c) for c in cumulated])
    # At most one row for each piece.
    past = Window.orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    after = totals.select("piece", *[F.coalesce(F.sum(c).over(past), F.lit(0.0)).alias(f"{c}_after") for c in cumulated])
    later = Window.partitionBy("piece").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    inside = per_time.select("piece", "d", *[f"e{i}" for i in range(p + 1)], *[F.sum(c).over(later).alias(c) for c in cumulated])
    run = inside.where("d > 0").join(after, "piece").withColumns({c: F.col(c) + F.col(f"{c}_after") for c in cumulated})
    row = run.agg(
        F.sum(F.expr("e0 - d * ln(s0)")),
        *[F.sum(F.expr(f"e{i + 1} - d * s_{i} / s0")) for i in range(p)],
        *[F.sum(F.expr(f"d * (s_{i}_{j} / s0 - s_{i} * s_{j} / (s0 * s0))")) for i, j in pairs],
    ).first()
    numbers = [0.0 if v is None else float(v) for v in row]
    info = np.zeros((p, p))
    for value, (i, j) in zip(numbers[p + 1 :], pairs, strict=True):
        info[i, j] = info[j, i] = value
    return numbers[0], np.array(numbers[1 : p + 1]), info


def cox_optimum(df: DataFrame, p: int, steps: int, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool, int]:
    """(beta, gradient, information, converged, steps taken) of Newton's method with step halving.

    A step that lowers the likelihood is halved until it does not. Coefficients beyond
    ``FARTHEST`` on standardised inputs mean that the inputs separate the events: the
    likelihood has no maximum, and the fit ends unconverged.
    """
    beta = np.zeros(p)
    likelihood, gradient, info = cox_sums(df, beta)
    for taken in range(1, steps + 1):
        step = np.linalg.lstsq(info, gradient, rcond=None)[0]
        for _ in range(HALVINGS):
            found = cox_sums(df, beta + step)
            if found[0] >= likelihood - 1e-9 * (1 + abs(likelihood)):
                break
            step = step / 2
        beta, (likelihood, gradient, info) = beta + step, found
        if np.max(np.abs(beta), initial=0.0) > FARTHEST:
            return beta, gradient, info, False, taken
        if np.max(np.abs(step), initial=0.0) < tol:
            return beta, gradient, info, True, taken
    return beta, gradient, info, False, steps


def fit_cox(
    df: DataFrame, features: Sequence[str], time: str = "t_m", event: str = "event", steps: int = 50, tol: float = 1e-8
) -> DataFrame:
    """Proportional hazards by Newton steps on standardised inputs (Breslow ties).

    ``gradiente`` is the score of an input per event at the returned coefficients, 0 at the
    optimum; ``converge`` tells whether the last step was below ``tol``, ``pasos`` how many
    were taken. Only p by p numbers reach the driver. The prepared rows are written to the
    shared folder, since every step reads them.
    """
    ready = cox_rows(df, features, time, event)
    beta, gradient, info, done, taken = cox_optimum(ready.rows, len(features), steps, tol)
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(info)), 0)) / ready.sds
    events = max(float(ready.rows.agg(F.sum("event")).first()[0] or 0), 1.0)
    found = [
        (f, float(b), float(np.exp(b)), float(e), float(g / events), done, taken)
        for f, b, e, g in zip(features, beta / ready.sds, errors, gradient, strict=True)
    ]
    schema = "variable string, coef double, razon double, error double, gradiente double, converge boolean, pasos int"
    return df.sparkSession.createDataFrame(found, schema)
