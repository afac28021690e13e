"""Survival curves and tables. Windows here run over distinct times, which the
calendar bounds, never over affiliates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorage.functions.columns import clamp01, date_plus_months
from anchorage.operators.clean import valid_spells
from anchorage.operators.portfolio import lump
from anchorage.operators.prefix import running_before

ID = "AFILIADO_ID_EPS"
HORIZONS = (1, 3, 6, 12, 18, 24)
MONTHS = 120

#: Bits of a digit of a rank in the concordance.
RANK_BITS = 4

# Months tested, in order, and the group each one leads to.
TRIGGERS = ((3, "CRITICO"), (6, "ALTO"), (12, "ESTRATEGIA_PROACTIVA"))
CALM = "BAJO"

# Tenure windows in months.
WINDOWS = ((0, 6, "[0,6)"), (6, 18, "[6,18)"), (18, None, "[18,inf)"))


def at_risk_counts(df: DataFrame, group: Sequence[str], time: str = "t_m", event: str = "event") -> DataFrame:
    """Events and rows still at risk per (group, time)."""
    group = list(group)
    counts = df.groupBy(*group, F.col(time).alias("t")).agg(
        F.sum(F.col(event).cast("bigint")).alias("d"), F.count(F.lit(1)).alias("m")
    )
    later = Window.partitionBy(*group).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("en_riesgo", F.sum("m").over(later))


def km(df: DataFrame, col: str, k: int = 12) -> DataFrame:
    """Kaplan-Meier curve per level of a column, the rarer levels together as OTROS."""
    counts = at_risk_counts(valid_spells(lump(df, col, k)), ["grupo"])
    upto = Window.partitionBy("grupo").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("grupo")
    alive = clamp01(F.product(1 - F.col("d") / F.col("en_riesgo")).over(upto))
    curve = counts.select("grupo", "t", alive.alias("S_t"), F.sum("m").over(whole).alias("n"))
    return curve.withColumn("risk_t", 1 - F.col("S_t"))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def attach_group_n(curve: DataFrame, sizes: DataFrame, group: str) -> DataFrame:
    """Group sizes onto a curve; both sides are summaries, so Spark picks the join by size."""
    return curve.join(sizes, group, "left")


def risk_at(curve: DataFrame, horizons: Sequence[int] = HORIZONS, group: str = "grupo") -> DataFrame:
    """Step lookup: risk at each horizon from the last S_t at or before it, 0 before the first."""
    steps = [
        F.coalesce(F.max_by("S_t", F.when(F.col("t") <= h, F.col("t"))), F.lit(1.0)).alias(f"_{h}") for h in horizons
    ]
    cells = [F.struct(F.lit(h).alias("horizonte"), (1 - F.col(f"_{h}")).alias("riesgo")) for h in horizons]
    return curve.groupBy(group).agg(*steps).select(group, F.inline(F.array(*cells)))


def horizon_table(curve: DataFrame, base_date: Column, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    dated = risk_at(curve, horizons).withColumn("_base", base_date)
    return dated.withColumn("fecha", date_plus_months(F.col("_base"), F.col("horizonte"))).drop("_base")


def curve_columns(df: DataFrame, months: int = MONTHS) -> tuple[str, list[str]]:
    """Which family of monthly columns the table carries in full: S first, else risk."""
    for kind in ("S", "risk"):
        names = [f"{kind}_{m}m" for m in range(1, months + 1)]
        if set(names) <= set(df.columns):
            return kind, names
    raise ValueError(f"needs S_1m..S_{months}m or risk_1m..risk_{months}m")


def curve_long(df: DataFrame, key: str = ID) -> DataFrame:
    """One row per (id, month): survival and risk, limited to [0, 1]."""
    kind, names = curve_columns(df)
    values = F.array(*[F.col(n).try_cast("double") for n in names])
    long = df.select(key, F.posexplode(values).alias("_pos", "_v"))
    alive = F.col("_v") if kind == "S" else 1 - F.col("_v")
    return long.select(key, (F.col("_pos") + 1).alias("t"), clamp01(alive).alias("S_t")).withColumn(
        "risk_t", 1 - F.col("S_t")
    )


def mean_curve(df: DataFrame) -> DataFrame:
    """Mean predicted survival per month: one aggregate over the wide row, no explosion."""
    kind, names = curve_columns(df)
    means = df.agg(*[F.avg(F.col(n).try_cast("double")).alias(n) for n in names])
    long = means.select(F.posexplode(F.array(*names)).alias("_pos", "_v"))
    alive = F.col("_v") if kind == "S" else 1 - F.col("_v")
    return long.select((F.col("_pos") + 1).alias("t"), clamp01(alive).alias("S_t"))


def life_table(df: DataFrame) -> DataFrame:
    """Hazard per whole month: events over rows at risk when the month starts."""
    monthly = df.withColumn("mes", F.floor("t_m").cast("int"))
    counts = at_risk_counts(monthly, [], "mes")
    return counts.select(F.col("t").alias("mes"), "en_riesgo", F.col("d").alias("eventos")).withColumn(
        "hazard", F.col("eventos") / F.col("en_riesgo")
    )


def window_hazard(df: DataFrame) -> DataFrame:
    """Events per person-month inside each tenure window, from one pass."""
    t, parts, cells = F.col("t_m"), [], []
    for i, (low, high, label) in enumerate(WINDOWS):
        inside = (t >= low) if high is None else ((t >= low) & (t < high))
        spent = F.greatest((t if high is None else F.least(t, F.lit(float(high)))) - low, F.lit(0.0))
        parts += [F.sum(F.when(inside, F.col("event").cast("bigint")).otherwise(0)).alias(f"_d{i}"), F.sum(spent).alias(f"_s{i}")]
        cells.append(
            F.struct(F.lit(label).alias("ventana"), F.col(f"_d{i}").alias("eventos"), F.col(f"_s{i}").alias("meses_persona"))
        )
    return df.agg(*parts).select(F.inline(F.array(*cells))).withColumn("hazard", F.try_divide("eventos", "meses_persona"))


def assign_group(df: DataFrame, threshold: float = 0.30, digits: int = 9) -> DataFrame:
    """Operational group from the months at which risk passes the threshold, and the first such month."""
    kind, names = curve_columns(df)

    def risk(m: int) -> Column:
        v = F.col(names[m - 1])
        return F.round(v if kind == "risk" else 1 - v, digits)

    group = F.lit(CALM)
    for month, label in reversed(TRIGGERS):
        group = F.when(risk(month) >= threshold, label).otherwise(group)
    curve = F.array(*names)
    passed = F.transform(curve, lambda v: F.round(v if kind == "risk" else 1 - v, digits) >= threshold)
    first = F.array_position(passed, F.lit(True)).cast("int")
    found = df.select(ID, group.alias("grupo"), first.alias("mes_gatillo"))
    return found.withColumn("mes_gatillo", F.nullif("mes_gatillo", F.lit(0)))


def c_index(df: DataFrame, time: str, event: str, risk: str) -> DataFrame:
    """Harrell's concordance of any real risk with time; rows that lack one of the three take no part.

    Pairs are counted, never formed. Each risk becomes its dense rank, written in digits
    of base 16. Two different ranks first differ in one digit, so each comparable pair
    meets in exactly one group (level of that digit, digits above it); there only the
    counts per digit and distinct time matter, cumulated over times (the calendar bounds
    them). A cell is copied once per digit: three times for up to 4,096 distinct risks, five
    times for a million, and copies are summed before the shuffle. Ties are the pairs with equal last digits, and at the highest
    digit all pairs meet.
    """
    r = F.col(risk).cast("double")
    rows = df.select(F.col(time).alias("t"), F.col(event).cast("bigint").alias("e"), r.alias("v"))
    rows = rows.where(F.col("t").isNotNull() & F.col("e").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    cells = rows.groupBy("t", "e", "v").agg(F.count(F.lit(1)).alias("n"))
    values = cells.groupBy("v").agg(F.lit(1).cast("bigint").alias("one"))
    order = running_before(values, "v", ["one"]).select("v", F.col("one_before").alias("r"), F.col("one_all").alias("of"))
    cells = cells.join(order, "v")
    digits = range(1 << RANK_BITS)
    top = F.expr(f"(length(regexp_replace(bin(of), '^0+', '')) - 1) div {RANK_BITS}").cast("int")
    placed = cells.withColumn("top", top).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top"))))
    placed = placed.select(
        "t",
        "e",
        "n",
        "level",
        (F.col("level") == F.col("top")).alias("top"),
        F.expr(f"cast(shiftright(r, level * {RANK_BITS}) & {len(digits) - 1} as int)").alias("digit"),
        F.expr(f"shiftright(r, (level + 1) * {RANK_BITS})").alias("prefix"),
    )
    counts = [f"coalesce(sum(case when digit = {k} then {v} end), 0) as {n}{k}" for n, v in (("n", "n"), ("e", "n * e")) for k in digits]
    sums = placed.groupBy("level", "top", "prefix", "t").agg(*map(F.expr, counts))
    later = "over (partition by level, top, prefix order by t desc rows between unbounded preceding and 1 preceding)"
    after = sums.selectExpr(
        "level",
        "top",
        f"array({', '.join(f'cast(e{k} as double)' for k in digits)}) as e",
        f"array({', '.join(f'cast(coalesce(sum(n{k}) {later}, 0) as double)' for k in digits)}) as n",
    )
    zero = F.lit(0.0)
    # The counts of all digits below each one.
    step = lambda s, n: F.struct((s["sum"] + n).alias("sum"), F.array_append(s["below"], s["sum"]).alias("below"))
    below = F.aggregate("n", F.struct(zero.alias("sum"), F.array().cast("array<double>").alias("below")), step)
    after = after.withColumn("below", below)

    def met(others: Column) -> Column:
        return F.aggregate(F.zip_with("e", others, lambda e, n: e * n), zero, lambda s, x: s + x)

    every = F.aggregate("e", zero, lambda s, x: s + x) * F.col("below.sum")
    found = after.agg(
        F.coalesce(F.sum(met(F.col("below.below"))), zero).alias("concordantes"),
        F.coalesce(F.sum(F.when(F.col("level") == 0, met(F.col("n")))), zero).alias("empates"),
        F.coalesce(F.sum(F.when(F.col("top"), every)), zero).alias("comparables"),
    )
    won = F.col("concordantes") + F.col("empates") / 2
    return found.withColumn("c_index", F.try_divide(won, F.col("comparables")))


def stack_curves(df: DataFrame, columns: Sequence[str], k: int = 12) -> DataFrame:
    """Kaplan-Meier curves of several variables in one long table; each curve is a small summary."""
    curves = [km(df, c, k).withColumn("variable", F.lit(c)) for c in columns]
    return reduce(DataFrame.unionByName, curves)
