"""Portfolio views: filters, counts and rates by level, pyramid, clusters, groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorage.functions import columns as c

ALL = "TODOS"
NO_DATA = "(Sin dato)"
NO_INFORMATION = "SIN_INFORMACION"
OTHERS = "OTROS"

# The columns a portfolio can be filtered and described by.
FILTERS = (
    "ESTADO",
    "TIPO_AFILIADO",
    "Regional_Agrupadora",
    "CONDICION_SALUD",
    "Sexo_Cd",
    "POLIZA",
    "NIVEL_INGRESO",
    "GRUPO_CAUSA_CANCELACION",
    "Compania",
    "PLAN",
    "TIPO_IPS",
    "SEGMENTO_EDAD",
)

# Operational groups in order of urgency, with their labels.
GROUPS = {
    "CRITICO": "Crítico",
    "ALTO": "Alto",
    "ESTRATEGIA_PROACTIVA": "Estrategia Proactiva",
    "BAJO": "Bajo",
}


def is_blank(col: Column) -> Column:
    return col.isNull() | (F.trim(col) == "")


def apply_filters(df: DataFrame, chosen: Mapping[str, str | None]) -> DataFrame:
    """AND of equalities; TODOS or nothing means no filter, unknown columns are skipped."""
    for name, value in chosen.items():
        if value is None or value == ALL or name not in df.columns:
            continue
        text = F.trim(F.col(name).cast("string"))
        wanted = str(value).strip()
        if name == "grupo_operativo":
            text, wanted = F.upper(text), wanted.upper()
        df = df.where(text == wanted)
    return df


def filter_choices(df: DataFrame, columns: Sequence[str] = FILTERS) -> DataFrame:
    """Distinct non-missing values per filter column, sorted."""
    present = [F.col(n).cast("string").alias(n) for n in columns if n in df.columns]
    long = df.select(*present).unpivot([], present, "variable", "valor")
    return long.where(F.col("valor").isNotNull()).distinct().orderBy("variable", "valor")


def active_only(df: DataFrame) -> DataFrame:
    source = "grupo_churn" if "grupo_churn" in df.columns else "ESTADO"
    return df.where(c.upper_trim(F.col(source)) == "ACTIVOS") if source in df.columns else df


def lookup(df: DataFrame, key: str | None, column: str = "AFILIADO_ID_EPS") -> DataFrame:
    wanted = (key or "").strip()
    return df.where(F.col(column) == wanted) if wanted else df


def level_metrics(df: DataFrame, var: str, metric: str = "count") -> DataFrame:
    """Rows and cancellation rate per non-empty level, highest first by the chosen metric."""
    level = F.col(var).cast("string")
    found = (
        df.where(level.isNotNull() & (level != ""))
        .groupBy(level.alias("nivel"))
        .agg(F.count(F.lit(1)).alias("afiliados"), F.avg("is_cancel").alias("tasa_cancel"))
    )
    by = "afiliados" if metric == "count" else "tasa_cancel"
    return found.orderBy(F.desc_nulls_last(by), "nivel")


def level_metrics_all(df: DataFrame, columns: Sequence[str] = FILTERS) -> DataFrame:
    """The same for many variables in one pass and one shuffle."""
    present = [n for n in columns if n in df.columns]
    flat = df.select("is_cancel", *[F.col(n).cast("string").alias(n) for n in present])
    long = flat.unpivot(["is_cancel"], present, "variable", "nivel")
    return (
        long.where(F.col("nivel").isNotNull() & (F.col("nivel") != ""))
        .groupBy("variable", "nivel")
        .agg(F.count(F.lit(1)).alias("afiliados"), F.avg("is_cancel").alias("tasa_cancel"))
    )


def pyramid(df: DataFrame) -> DataFrame:
    """Five-year age bins by sex, men on the negative side; ages off the scale keep a null bin."""
    age = F.col("EDAD_FECHA_FIN")
    low = F.least(F.floor(age / 5) * 5, F.lit(95)).cast("int")
    bin_low = F.when(age.between(0, 100), low)
    sex = F.upper(F.col("Sexo_Cd"))
    rows = df.where(c.is_finite(age) & F.col("Sexo_Cd").isNotNull() & (F.col("Sexo_Cd") != ""))
    wide = rows.groupBy(bin_low.alias("edad_desde")).agg(
        *[F.count(F.when(sex == s, 1)).alias(f"n_{s}") for s in "MF"],
        *[F.coalesce(F.avg(F.when(sex == s, F.col("is_cancel"))), F.lit(0.0)).alias(f"tasa_{s}") for s in "MF"],
    )
    return wide.withColumns({"n_M_izq": -F.col("n_M"), "tasa_M_izq": -F.col("tasa_M")}).orderBy("edad_desde")


def labelled_clusters(df: DataFrame) -> DataFrame:
    """Clean cluster ids and normalised status, rows without either dropped."""
    return df.withColumns(
        {"cluster": c.clean_cluster(F.col("cluster")), "grupo_norm": c.norm_group(F.col("grupo_churn"))}
    ).where(F.col("cluster").isNotNull() & F.col("grupo_norm").isNotNull())


def share_of(counts: DataFrame, n: str, within: Sequence[str], out: str) -> DataFrame:
    """Share of each counted row within its group; runs on counts, not on the detail."""
    return counts.withColumn(out, F.col(n) / F.sum(n).over(Window.partitionBy(*within)))


def cluster_share(df: DataFrame) -> DataFrame:
    counts = labelled_clusters(df).groupBy("grupo_norm", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return share_of(counts, "n", ["grupo_norm"], "participacion").orderBy("grupo_norm", F.desc("n"), "cluster")


def cluster_name(cluster: Column, names: Mapping[int, str]) -> Column:
    default = F.concat(F.lit("Cluster "), cluster.cast("string"))
    if not names:
        return default
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), cluster), default)


def cluster_summary(df: DataFrame, status: str = "ACTIVO", names: Mapping[int, str] | None = None) -> DataFrame:
    counts = (
        labelled_clusters(df)
        .where(F.col("grupo_norm") == status)
        .groupBy("cluster", "grupo_norm")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    named = share_of(counts, "n", ["grupo_norm"], "participacion").drop("grupo_norm")
    return named.withColumn("nombre", cluster_name(F.col("cluster"), names or {})).orderBy(F.desc("n"), "cluster")


def cluster_composition(
    df: DataFrame, var: str, status: str = "ACTIVO", names: Mapping[int, str] | None = None
) -> DataFrame:
    """Levels of one variable inside each cluster, biggest cluster first."""
    text = F.col(var).cast("string")
    level = F.when(text.isNull() | (text == ""), NO_INFORMATION).otherwise(text)
    counts = (
        labelled_clusters(df)
        .where(F.col("grupo_norm") == status)
        .groupBy("cluster", level.alias("nivel"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    size = F.sum("n").over(Window.partitionBy("cluster"))
    return (
        counts.withColumns({"n_cluster": size, "pct_cluster": F.col("n") / size})
        .withColumn("nombre", cluster_name(F.col("cluster"), names or {}))
        .orderBy(F.desc("n_cluster"), "cluster", "nivel")
    )


def group_counts(df: DataFrame) -> DataFrame:
    """Affiliates per operational group in order of urgency, unknown groups last."""
    group = F.col("grupo_operativo").cast("string")
    order = F.array_position(F.array(*map(F.lit, GROUPS)), group)
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv]), group), group)
    return (
        df.where(group.isNotNull() & (group != ""))
        .groupBy(group.alias("grupo_operativo"))
        .agg(F.count(F.lit(1)).alias("afiliados"))
        .select(
            "grupo_operativo",
            label.alias("grupo"),
            "afiliados",
            F.when(order > 0, order.cast("int")).otherwise(len(GROUPS) + 1).alias("orden"),
        )
        .orderBy("orden", "grupo_operativo")
    )


def lump(df: DataFrame, col: str, k: int = 12, out: str = "grupo") -> DataFrame:
    """Keep the k most frequent levels (ties by name); the rest become OTROS."""
    text = F.col(col).cast("string")
    level = F.when(is_blank(text), NO_DATA).otherwise(text)
    kept = (
        df.groupBy(level.alias("_level"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), "_level")
        .limit(k)
        .select("_level", F.lit(True).alias("_kept"))
    )
    # The kept list has at most k rows by construction.
    tagged = df.withColumn("_level", level).join(F.broadcast(kept), "_level", "left")
    return tagged.withColumn(out, F.when(F.col("_kept"), F.col("_level")).otherwise(OTHERS)).drop("_level", "_kept")


def relative_risk(df: DataFrame, flag: Column, event: str = "is_cancel") -> DataFrame:
    """Event rate with and without a flag, their ratio and the relative reduction."""
    rates = df.agg(
        F.avg(F.when(flag, F.col(event))).alias("tasa_con"), F.avg(F.when(~flag, F.col(event))).alias("tasa_sin")
    )
    ratio = F.try_divide("tasa_con", "tasa_sin")
    return rates.withColumns({"razon": ratio, "reduccion": 1 - ratio})
