"""Risk views: means by level, curves, matrices, distribution and quadrants."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from anchorage.functions.columns import is_finite
from anchorage.functions.draws import POISSON_CUTS as POISSON_CUTS, weighted_sums
from anchorage.operators.bins import binned, qcut, quantile_edges, with_bounds
from anchorage.operators.prefix import exact_quantiles
from anchorage.session import mapped, spread

RISK = "Riesgo_Calculado"
RISK_CUT = 0.35
FEW_LEVELS = 20
REPLICATES = 1_000

# Names of the five age quantiles, youngest first.
AGE_QUINTILES = ("Joven", "Adulto Joven", "Adulto", "Maduro", "Mayor")

# Quadrant names by (high risk, high value); low-low is ours.
QUADRANTS = {
    (True, True): "EMERGENCIA",
    (False, True): "VACAS LECHERAS",
    (True, False): "DEJAR IR",
    (False, False): "RESTO",
}


def n_distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-missing values per column, and the treatment that number leads to."""
    flat = [F.col(n).cast("string").alias(n) for n in columns]
    long = df.select(*flat).unpivot([], list(columns), "variable", "valor").where(F.col("valor").isNotNull())
    counts = long.distinct().groupBy("variable").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumns(
        {
            "barras": (F.col("n") < FEW_LEVELS).cast("int"),
            "en_rangos": (F.col("n") > FEW_LEVELS).cast("int"),
        }
    )


def has_many_values(df: DataFrame, col: str) -> bool:
    """More than 20 distinct values; reads at most 21 of them to the driver's plan."""
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    return values.limit(FEW_LEVELS + 1).count() > FEW_LEVELS


def _with_global_mean(sums: DataFrame) -> DataFrame:
    """Add the mean over all rows, from the same per-level sums."""
    overall = sums.agg(F.sum("_s") / F.sum("_n")).scalar()
    return sums.withColumns({"riesgo": F.col("_s") / F.col("_n"), "riesgo_global": overall, "n": F.col("_n")})


def _sums(df: DataFrame, *by) -> DataFrame:
    return df.where(F.col(RISK).isNotNull()).groupBy(*by).agg(F.sum(RISK).alias("_s"), F.count(F.lit(1)).alias("_n"))


def risk_by_level(df: DataFrame, var: str) -> DataFrame:
    """Mean risk per level, lowest first, beside the global mean."""
    found = _with_global_mean(_sums(df, F.col(var).alias("nivel"))).where(F.col("nivel").isNotNull())
    return found.select("nivel", "n", "riesgo", "riesgo_global").orderBy("riesgo", "nivel")


def inspect_numeric(df: DataFrame, var: str, q: int = 10) -> DataFrame:
    """Mean risk per quantile bin of a numeric variable, beside the global mean."""
    edges = quantile_edges(df, F.col(var), q)
    found = _with_global_mean(_sums(binned(df, var, edges, "rango"), "rango")).where(F.col("rango").isNotNull())
    bounded = with_bounds(found, edges, "rango")
    return bounded.select("rango", "rango_low", "rango_high", "n", "riesgo", "riesgo_global").orderBy("rango")


def risk_curve(df: DataFrame, var: str) -> DataFrame:
    """Mean risk, count and standard error per value of a numeric variable."""
    found = df.where(F.col(var).isNotNull()).groupBy(F.col(var).alias("valor"))
    return found.agg(
        F.avg(RISK).alias("riesgo"),
        F.count(RISK).alias("n"),
        (F.stddev_samp(RISK) / F.sqrt(F.count(RISK))).alias("error"),
    ).orderBy("valor")


def drawn_sums(rows: DataFrame, replicates: int) -> DataFrame:
    """(valor, _s, _n) from (valor, _key, value): weighted sums and weights of a run of equal values, an entry a replicate.

    A task takes its rows in order of ``valor`` and holds one run's sums at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = [str(r).encode() for r in range(1, replicates + 1)]
        last, total, count, kind = None, None, None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([total]), pa.array([count])], names=["valor", "_s", "_n"])

        for batch in batches:
            kind = batch.schema.field(0).type
            values, keys = batch.column(0).to_pylist(), [k.encode() for k in batch.column(1).to_pylist()]
            risks = batch.column(2).to_numpy(zero_copy_only=False)
            starts = [i for i in range(len(values)) if not i or values[i] != values[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(values)]):
                if total is None or values[a] != last:
                    if total is not None:
                        yield told()
                    last, total, count = values[a], np.zeros(replicates), np.zeros(replicates, np.int64)
                sums, weights = weighted_sums(keys[a:b], risks[a:b], suffixes)
                total, count = total + sums, count + weights
        if total is not None:
            yield told()

    schema = StructType([rows.schema["valor"]]).add("_s", ArrayType(DoubleType())).add("_n", ArrayType(LongType()))
    return mapped(rows, run, schema)


def bootstrap_band(df: DataFrame, var: str, key: str, replicates: int = REPLICATES, level: float = 0.95) -> DataFrame:
    """(valor, banda_inf, banda_sup): percentile band of the mean risk per value of a variable.

    Every row draws its weight in every replicate from a hash of its key and the replicate, so one pass serves
    all replicates and no row is drawn from a group. The rows are dealt out before they draw. Weighted sums are
    combined before the shuffle; a value keeps one mean for each replicate in which it has a row.
    """
    rows = df.where(F.col(var).isNotNull() & F.col(RISK).isNotNull())
    # A missing key leaves the replicate alone to be hashed.
    rows = rows.select(F.col(var).alias("valor"), F.concat_ws("|", F.col(key), F.lit("")).alias("_key"), F.col(RISK).cast("double"))
    drawn = drawn_sums(spread(rows).sortWithinPartitions("valor"), replicates)
    each = drawn.select("valor", F.posexplode(F.arrays_zip("_s", "_n")).alias("_rep", "_sums"))
    sums = each.groupBy("valor", "_rep").agg(F.sum("_sums._s").alias("_s"), F.sum("_sums._n").alias("_n"))
    means = sums.where(F.col("_n") > 0).select("valor", (F.col("_s") / F.col("_n")).alias("_m"))
    tail = (1 - level) / 2
    return means.groupBy("valor").agg(
        F.percentile("_m", F.lit(round(tail, 6))).alias("banda_inf"), F.percentile("_m", F.lit(round(1 - tail, 6))).alias("banda_sup")
    )


def risk_curve_with_band(df: DataFrame, var: str, key: str, replicates: int = REPLICATES) -> DataFrame:
    """``risk_curve`` with the bootstrapped band; both sides have one row per value."""
    return risk_curve(df, var).join(bootstrap_band(df, var, key, replicates), "valor", "left").orderBy("valor")


def risk_quartiles(df: DataFrame, var: str) -> DataFrame:
    """Minimum, quartiles and maximum of risk per level."""
    rows = df.where(F.col(var).isNotNull()).select(F.col(var).alias("nivel"), RISK)
    found = exact_quantiles(rows, F.col(RISK), [0, 0.25, 0.5, 0.75, 1], ["nivel"])
    names = ("minimo", "q1", "mediana", "q3", "maximo")
    return found.select("nivel", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)])


def risk_by_flags(df: DataFrame, prefix: str) -> DataFrame:
    """Mean risk of the rows that carry each flag; a row may count under several."""
    names = [n for n in df.columns if n.startswith(prefix)]
    means = df.agg(*[F.avg(F.when(F.col(f"`{n}`") == 1, F.col(RISK))).alias(n.removeprefix(prefix)) for n in names])
    short = [F.col(f"`{n.removeprefix(prefix)}`") for n in names]
    return means.unpivot([], short, "nivel", "riesgo").orderBy(F.desc_nulls_last("riesgo"), "nivel")


def contrast(df: DataFrame, groups: Mapping[str, Column]) -> DataFrame:
    """Mean risk of a few segments side by side."""
    return df.agg(*[F.avg(F.when(test, F.col(RISK))).alias(name) for name, test in groups.items()])


def risk_matrix(df: DataFrame, rows: Sequence[str], col: str, levels: Sequence[str]) -> DataFrame:
    """Mean risk by row keys and known column levels."""
    cells = [F.avg(F.when(F.col(col) == level, F.col(RISK))).alias(level) for level in levels]
    wide = df.groupBy(*rows).agg(F.count(col).alias("_known"), *cells)
    return wide.where(F.col(rows[0]).isNotNull() & (F.col("_known") > 0)).drop("_known")


def vulnerability_matrix(df: DataFrame, income: str, stage: str, levels: Sequence[str]) -> DataFrame:
    """Income (in deciles when it has many values) by life stage."""
    if not has_many_values(df, income):
        return risk_matrix(df, [income], stage, levels)
    edges = quantile_edges(df, F.col(income), 10)
    ranged = binned(df, income, edges, "rango")
    return with_bounds(risk_matrix(ranged, ["rango"], stage, levels), edges, "rango")


def age_income_matrix(df: DataFrame, age: str, income: str) -> DataFrame:
    named = qcut(df, age, len(AGE_QUINTILES), "_quintil")
    names = F.array(*map(F.lit, AGE_QUINTILES))
    return risk_matrix(named.withColumn("Ciclo", F.get(names, F.col("_quintil"))), [income], "Ciclo", AGE_QUINTILES)


def risk_interaction(df: DataFrame, a: str, b: str) -> DataFrame:
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return rows.groupBy(a, b).agg(F.avg(RISK).alias("riesgo"), F.count(RISK).alias("n"))


def box_stats(df: DataFrame, col: str) -> DataFrame:
    """Quartiles, mean, Tukey fences and rows beyond them, over finite values."""
    rows = df.select(F.col(col).try_cast("double").alias("v")).where(is_finite(F.col("v")))
    q = exact_quantiles(rows, F.col("v"), [0.25, 0.5, 0.75]).select("q").scalar()
    low = F.get("q", F.lit(0)) - 1.5 * (F.get("q", F.lit(2)) - F.get("q", F.lit(0)))
    high = F.get("q", F.lit(2)) + 1.5 * (F.get("q", F.lit(2)) - F.get("q", F.lit(0)))
    placed = rows.withColumn("q", q).withColumns({"low": low, "high": high})
    return placed.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("v").alias("media"),
        F.max(F.get("q", F.lit(0))).alias("q1"),
        F.max(F.get("q", F.lit(1))).alias("mediana"),
        F.max(F.get("q", F.lit(2))).alias("q3"),
        F.max("low").alias("cerca_inf"),
        F.max("high").alias("cerca_sup"),
        F.count(F.when(~F.col("v").between(F.col("low"), F.col("high")), 1)).alias("n_fuera"),
    )


def histogram(df: DataFrame, col: str, bins: int = 30, cut: float = RISK_CUT) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins are kept."""
    rows = df.select(F.col(col).alias("v")).where(is_finite(F.col("v")))
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    lo, width = F.col("r.lo"), F.col("r.hi") - F.col("r.lo")
    place = F.coalesce(F.floor(F.try_divide(F.col("v") - lo, width) * bins), F.lit(0))
    placed = rows.withColumn("r", ends.select(F.struct("lo", "hi")).scalar())
    counts = placed.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    step = (F.col("hi") - F.col("lo")) / bins
    scale = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return scale.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * step).alias("desde"),
        (F.col("lo") + (F.col("bin") + 1) * step).alias("hasta"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.lit(float(cut)).alias("corte"),
    )


def quadrants(df: DataFrame, value: str, cut: float = RISK_CUT) -> DataFrame:
    """Customers per risk-by-value quadrant; a text value only marks the high risk."""
    risk = F.col(RISK) >= cut
    if dict(df.dtypes)[value] == "string":
        label = F.when(risk, "ALTA PRIORIDAD").otherwise("RESTO")
    else:
        median = exact_quantiles(df, F.col(value), [0.5]).select(F.get("q", F.lit(0))).scalar()
        df = df.withColumn("_median", median)
        rich = F.col(value) >= F.col("_median")
        label = (
            F.when(risk & rich, QUADRANTS[True, True])
            .when(~risk & rich, QUADRANTS[False, True])
            .when(risk & ~rich, QUADRANTS[True, False])
            .when(~risk & ~rich, QUADRANTS[False, False])
        )
    return df.groupBy(label.alias("cuadrante")).agg(F.count(F.lit(1)).alias("n"), F.avg(RISK).alias("riesgo"))
