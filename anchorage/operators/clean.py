"""Whole-table cleaning passes: status, totals, bands, flags and row rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorage.functions import columns as c

# Interaction kinds that count as complaints and requests;
# compliments (Felicitaciones) never do.
PQRS_KINDS = ("Inquietud", "Peticion", "Queja", "Sugerencia")
PQRS = tuple(f"{kind}_{plan}" for kind in PQRS_KINDS for plan in ("PAC", "PBS"))

# The five counts that mark friction.
FRICTION = ("Queja_PAC", "Queja_PBS", "Inquietud_PAC", "Inquietud_PBS", "Peticion_PAC")

USAGE = ("Prestaciones_PAC", "Prestaciones_PBS")

# Columns kept away from model features.
NOT_FEATURES = ("AFILIADO_ID_EPS", "FECHA_INICIO", "FECHA_FIN", "meses_transcurridos")
KEEP_DESPITE_SUFFIX = "FLAG_FRICCION_INICIAL"
CAUSE_PREFIX = "GRUPO_CAUSA_CANCELACION_"

# Age bins used when no age-segment flags exist.
AGE_EDGES = (0, 20, 30, 40, 50, 60, 100)
AGE_LABELS = ("0-20", "20-30", "30-40", "40-50", "50-60", "60+")


def zero_sum(names: Sequence[str]) -> Column:
    """Sum of columns with missing read as zero."""
    return reduce(add, [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])


def add_status(df: DataFrame) -> DataFrame:
    """ESTADO from FALLA, else from an existing ESTADO, else missing; is_cancel keeps missing."""
    if "FALLA" in df.columns:
        falla = F.col("FALLA")
        status = F.when(falla == "CANCELADOS", "CANCELADOS").when(falla.isNotNull(), "ACTIVOS")
    elif "ESTADO" in df.columns:
        status = F.col("ESTADO").cast("string")
    else:
        status = F.lit(None).cast("string")
    df = df.withColumn("ESTADO", status)
    return df.withColumn("is_cancel", (F.col("ESTADO") == "CANCELADOS").cast("int"))


def add_usage_total(df: DataFrame) -> DataFrame:
    final = [f"{n}_FIN" for n in USAGE]
    if set(USAGE) <= set(df.columns):
        total = zero_sum(USAGE)
    elif set(final) <= set(df.columns):
        total = zero_sum(final)
    else:
        present = [n for n in (*USAGE, *final) if n in df.columns]
        total = zero_sum(present) if present else F.lit(0.0)
    return df.withColumn("consumos_total", total)


def add_pqrs_total(df: DataFrame) -> DataFrame:
    present = [n for n in PQRS if n in df.columns] or [f"{n}_FIN" for n in PQRS if f"{n}_FIN" in df.columns]
    return df.withColumn("pqrs_total", zero_sum(present) if present else F.lit(None).cast("double"))


def add_count_bands(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "consumos_cat": c.bucket_0_1_2_5_6p(F.col("consumos_total")),
            "pqrs_cat": c.bucket_0_1_2_5_6p(F.col("pqrs_total")),
        }
    )


def add_metrics(df: DataFrame) -> DataFrame:
    return add_count_bands(add_pqrs_total(add_usage_total(add_status(df))))


def has_complaints(df: DataFrame, out: str = "TIENE_QUEJAS") -> DataFrame:
    present = [n for n in FRICTION if n in df.columns]
    return df.withColumn(out, F.when(zero_sum(present) > 0, "Con Quejas").otherwise("Sin Quejas"))


def one_hot(df: DataFrame, col: str, prefix: str, levels: Sequence[str]) -> DataFrame:
    """0/1 column per level; unseen and missing values give all zeros.

    Space and underscore are the same character for matching.
    """
    value = F.translate(F.trim(F.col(col).cast("string")), "_", " ")
    flags = {
        f"{prefix}{level}": F.coalesce((value == level.replace("_", " ")).cast("int"), F.lit(0)) for level in levels
    }
    return df.withColumns(flags)


def undummy(df: DataFrame, prefix: str, out: str) -> DataFrame:
    """Level of the first largest flag, so a row of zeros gives the first level."""
    names = [n for n in df.columns if n.startswith(prefix)]
    flags = [F.col(f"`{n}`") for n in names]
    top = F.greatest(*flags) if len(flags) > 1 else flags[0]
    labels = F.array(*[F.lit(n.removeprefix(prefix)) for n in names])
    return df.withColumn(out, F.get(labels, F.array_position(F.array(*flags), top).cast("int") - 1))


def life_stage(df: DataFrame, out: str = "Etapa_Vida", prefix: str = "SEGMENTO_EDAD_", age: str = "EDAD") -> DataFrame:
    if any(n.startswith(prefix) for n in df.columns):
        return undummy(df, prefix, out)
    return df.withColumn(out, c.cut(F.col(age), AGE_EDGES, AGE_LABELS))


def drop_leakage(df: DataFrame) -> DataFrame:
    """Keep the columns a churn model may see; decided from names, no data is read."""

    def allowed(name: str) -> bool:
        if name == KEEP_DESPITE_SUFFIX:
            return True
        return not (name.endswith("_FIN") or name.startswith(CAUSE_PREFIX) or name in NOT_FEATURES)

    return df.select(*[f"`{n}`" for n in df.columns if allowed(n)])


def modelling_base(df: DataFrame, churn: str = "FALLA_BIN", tenure: str = "meses_transcurridos") -> DataFrame:
    """Drop active rows with under a year of tenure (administrative censoring)."""
    return df.where(~((F.col(churn) == 0) & (F.col(tenure) < 12)))


def with_tenure(df: DataFrame) -> DataFrame:
    """Churn label and whole-month tenure; an open spell ends at the cut-off date."""
    cutoff = df.agg(F.greatest(F.max("FECHA_FIN"), F.max("FECHA_INICIO"))).scalar()
    ended = df.withColumn("_end", F.coalesce(F.col("FECHA_FIN"), cutoff)).withColumns(
        {
            "FALLA_BIN": (F.col("FALLA") == "CANCELADOS").cast("int"),
            "meses_transcurridos": c.months_elapsed(F.col("FECHA_INICIO"), F.col("_end")),
        }
    )
    return ended.drop("_end")


def first_per_id(df: DataFrame, key: str, *order) -> DataFrame:
    """First row per key; Spark drops all but each partition's first before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def last_spell(df: DataFrame, key: str = "AFILIADO_ID_EPS") -> DataFrame:
    """Latest spell per affiliate; a spell still open (no end date) is the latest."""
    return first_per_id(df, key, F.desc_nulls_first("FECHA_FIN"), F.desc("spell_id"))


def event_flag(df: DataFrame) -> Column:
    """1 cancelled, 0 active, else missing; from grupo_churn when present, else ESTADO."""
    source = "grupo_churn" if "grupo_churn" in df.columns else "ESTADO"
    status = c.upper_trim(F.col(source))
    return F.when(status == "CANCELADOS", 1).when(status == "ACTIVOS", 0)


def valid_spells(df: DataFrame) -> DataFrame:
    """Spells usable for survival: ordered dates and a known event; adds t_m and event."""
    start, end = F.col("FECHA_INICIO"), F.col("FECHA_FIN")
    return (
        df.withColumn("event", event_flag(df))
        .where((end >= start) & F.col("event").isNotNull())
        .withColumn("t_m", c.months_frac(start, end))
    )
