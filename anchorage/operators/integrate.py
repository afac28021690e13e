"""Joins that bring risk, usage and interactions onto the spell table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorage.functions import columns as c
from anchorage.operators.prefix import as_columns

ID = "AFILIADO_ID_EPS"
RISK_COLUMNS = ("risk_12m", "grupo_operativo", "tiempo_gatillo_m")

# Tenure brackets, lower bounds in months.
BRACKETS = ((24, "[24,inf)"), (18, "[18,24)"), (12, "[12,18)"), (6, "[6,12)"), (0, "[0,6)"))


def with_risk(df: DataFrame, perm: DataFrame) -> DataFrame:
    """Left join of the predicted risk onto affiliates; stale risk columns go first.

    ``perm`` holds one row per affiliate. The id may be written in any case and be a
    number on either side; it comes out as text under its usual name.
    """
    risk = perm.select(F.col(ID).cast("string").alias(ID), *RISK_COLUMNS)
    return (
        df.drop(*RISK_COLUMNS)
        .withColumn(ID, F.col(ID).cast("string"))
        .join(risk, ID, "left")
        .withColumns(
            {
                "risk_12m": F.col("risk_12m").try_cast("double"),
                "grupo_operativo": c.upper_trim(F.col("grupo_operativo")),
            }
        )
    )


def integrate(spells: DataFrame, *sources: DataFrame) -> DataFrame:
    """Left join per-affiliate summaries onto every spell; no record means zero.

    Each source is already aggregated to one row per affiliate, so a busy
    affiliate never multiplies rows.
    """
    for source in sources:
        added = [n for n in source.columns if n != ID]
        joined = spells.join(source, ID, "left")
        spells = joined.withColumns({n: F.coalesce(F.col(n), F.lit(0).cast(source.schema[n].dataType)) for n in added})
    return spells


def counts_in_window(
    spells: DataFrame, events: DataFrame, kinds: Sequence[str], plans: Sequence[str], end: Column
) -> DataFrame:
    """Events of each kind and plan inside [FECHA_INICIO, end], both days included.

    Events are never paired with spells. Per affiliate and calendar day they are
    counted first. A spell's two boundary days carry its row number through the same
    sweep as these counts, one ordered pass per affiliate in which the counts are
    cumulated (the calendar bounds the days); the difference of the two running totals
    is the spell's count. Spells and events are read once each, and the rows of a spell
    are already together when they are put back into one.
    """
    names = [f"{kind}_{plan}" for kind in kinds for plan in plans]
    kept = [n for n in spells.columns if n not in names]
    tag = F.concat_ws("_", "tipo", "plan")
    none = F.lit(0).cast("bigint")
    daily = (
        events.where(F.col("fecha").isNotNull() & F.col(ID).isNotNull())
        .groupBy(ID, F.col("fecha").alias("_day"))
        .agg(*[F.count(F.when(tag == n, 1)).alias(n) for n in names])
        .withColumns({"_side": none.cast("int"), "_row": F.lit(None).cast("bigint")})
    )
    bounded = spells.withColumns({"_end": end, "_start": F.date_sub("FECHA_INICIO", 1)})
    bounded = as_columns(bounded, spells.columns, _hi="_end", _lo="_start").select(*kept, "_hi", "_lo")
    bounded = bounded.withColumn("_row", F.monotonically_increasing_id())
    open_ = F.struct(F.col("_lo").alias("_day"), F.lit(-1).alias("_side"), F.lit(None).cast(bounded.select(*kept).schema).alias("_spell"))
    close = F.struct(F.col("_hi").alias("_day"), F.lit(1).alias("_side"), F.struct(*kept).alias("_spell"))
    edges = bounded.select(ID, "_row", (F.col("_hi") > F.col("_lo")).alias("_ordered"), F.inline(F.array(open_, close)))
    both = daily.unionByName(edges.withColumns({n: none for n in names}), allowMissingColumns=True)
    # A day's counts come before the boundaries that fall on it.
    sweep = Window.partitionBy(ID).orderBy("_day", F.col("_side") != 0).rowsBetween(Window.unboundedPreceding, 0)
    marks = both.withColumns({n: F.col("_side") * F.sum(n).over(sweep) for n in names}).where(F.col("_row").isNotNull())
    spans = marks.groupBy(ID, "_row").agg(
        F.first("_spell", ignorenulls=True).alias("_spell"), F.max("_ordered").alias("_ordered"), *[F.sum(n).alias(n) for n in names]
    )
    inside = F.col("_ordered") & F.col(f"_spell.{ID}").isNotNull()
    return spans.select("_spell.*", *[F.when(inside, F.col(n)).otherwise(none).alias(n) for n in names])


def recency(spells: DataFrame, events: DataFrame, complaint: str, asof: Column) -> DataFrame:
    """Tenure bracket, months since the last complaint, days since any activity, usage rate.

    ``spells`` holds one row per affiliate; events are summarised first.
    """
    last = events.groupBy(ID).agg(
        F.max("ts").alias("_last"),
        F.max(F.when(F.col("tipo") == complaint, F.col("ts"))).alias("_complaint"),
        F.count(F.lit(1)).alias("_uses"),
    )
    day, tenure = F.col("_asof"), F.col("antiguedad_m")
    bracket = F.when(tenure >= BRACKETS[0][0], BRACKETS[0][1])
    for low, label in BRACKETS[1:]:
        bracket = bracket.when(tenure >= low, label)
    uses = F.coalesce("_uses", F.lit(0))
    dated = spells.withColumn("_asof", asof).withColumn("antiguedad_m", c.months_elapsed(F.col("FECHA_INICIO"), day))
    return dated.join(last, ID, "left").select(
        ID,
        tenure,
        bracket.alias("tramo"),
        c.months_elapsed(F.to_date("_complaint"), day).alias("meses_desde_queja"),
        F.datediff(day, F.to_date("_last")).alias("dias_inactivo"),
        uses.alias("usos"),
        F.try_divide(uses, tenure).alias("uso_por_mes"),
    )
