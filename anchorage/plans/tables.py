"""Retention-shaped tables derived from the star-schema test tables.

Every frame is lazy; Catalyst prunes whatever a query does not read. The SQL
twins live in ``oracle.py``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorage.session import spread

# Interaction kinds and plans, in column order.
KINDS = ("Queja", "Peticion", "Inquietud", "Sugerencia", "Felicitaciones")
PLANS = ("PAC", "PBS")
INTERACTIONS = tuple(f"{kind}_{plan}" for kind in KINDS for plan in PLANS)

MONTHS = 120
RISK_CUT = 0.30

# Levels that one-hot columns are made for.
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
AGE_STAGES = ("01_DEPENDIENTE", "02_ADULTOJOVEN", "03_PRODUCTIVO", "04_ADULTOMAYOR")

# Weights of the linear score behind the contribution table.
CONTRIB_WEIGHTS = {
    "ACCT_BAL": -0.0002,
    "NUM_ORDERS": -0.05,
    "NUM_ITEMS": 0.01,
    "Prestaciones_PAC": -0.03,
    "Prestaciones_PBS": 0.02,
    "risk_12m": 1.5,
    "CONST_BIN": 0.4,
}

#: Further numeric inputs, cyclic in the customer key, half of them pushing each way.
CYCLES = {f"CYCLE_{step}": (step, (-1) ** i * (0.02 + 0.005 * i)) for i, step in enumerate((3, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61))}
MORE_WEIGHTS = CONTRIB_WEIGHTS | {name: weight for name, (_, weight) in CYCLES.items()}


def pick(index, *levels):
    return F.get(F.array(*map(F.lit, levels)), index.cast("int"))


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def items(self) -> DataFrame:
        """One row per order with items: last ship date, counts, interaction counts."""
        kind = pick(F.col("l_suppkey") % 5, *KINDS)
        plan = F.when(F.col("l_linestatus") == "O", "PAC").otherwise("PBS")
        tag = F.concat_ws("_", kind, plan)
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_orderkey").alias("o_orderkey"))
            .agg(
                F.max("l_shipdate").cast("date").alias("fin"),
                F.count(F.lit(1)).alias("n_items"),
                F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("n_pac"),
                *[F.count(F.when(tag == t, 1)).cast("double").alias(t) for t in INTERACTIONS],
            )
        )

    @cached_property
    def spells(self) -> DataFrame:
        """One row per order, shaped as one affiliate subscription spell."""
        place = (
            self.raw("nation")
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
        )
        who = (
            self.raw("customer")
            .join(place, "c_nationkey")
            .select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment", "n_name", "r_name")
        )
        orders = self.raw("orders").join(self.items, "o_orderkey", "left").join(who, "o_custkey")
        cust, key, status = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderstatus")
        age = (cust * 7 + key) % 104
        priority = F.col("o_orderpriority")
        return orders.select(
            cust.cast("string").alias("AFILIADO_ID_EPS"),
            key.alias("spell_id"),
            F.col("o_orderdate").cast("date").alias("FECHA_INICIO"),
            F.col("fin").alias("FECHA_FIN"),
            F.when(status == "F", "CANCELADOS").otherwise("ACTIVOS").alias("FALLA"),
            F.when(status == "F", "CANCELADOS")
            .when(status == "O", "ACTIVOS")
            .otherwise(" activo ")
            .alias("grupo_churn"),
            F.col("r_name").alias("Regional_Agrupadora"),
            F.col("n_name").alias("nation"),
            F.col("c_mktsegment").alias("PLAN"),
            F.when(priority.isin("1-URGENT", "2-HIGH"), "A")
            .when(priority == "3-MEDIUM", "B")
            .when(priority == "5-LOW", "C")
            .alias("NIVEL_INGRESO"),
            pick(cust % 3, "ASEGURADO COLECTIVO", "ASEGURADO FAMILIAR", "TOMADOR FAMILIAR").alias("TIPO_AFILIADO"),
            pick(key % 3, "DIGITAL", "PROPIO", "TERCERO").alias("Compania"),
            pick(key % 5, "ALIADA", "CONVENIO", "EXCLUSIVA", "PROPIA", "SIN_INFORMACION").alias("TIPO_IPS"),
            F.when(cust % 7 == 0, None).when(cust % 2 == 0, "f").otherwise("M").alias("Sexo_Cd"),
            age.cast("double").alias("EDAD_FECHA_FIN"),
            F.when(age < 18, AGE_STAGES[0])
            .when(age < 30, AGE_STAGES[1])
            .when(age < 60, AGE_STAGES[2])
            .when(age <= 100, AGE_STAGES[3])
            .alias("SEGMENTO_EDAD"),
            F.when(F.col("c_acctbal") < 0, "NO").when(F.col("c_acctbal") < 5000, "SI").otherwise("SÍ").alias("POLIZA"),
            F.when(F.col("n_items") >= 6, "ALTA")
            .when(F.col("n_items") >= 3, "MEDIA")
            .otherwise("BAJA")
            .alias("CONDICION_SALUD"),
            F.col("n_pac").cast("double").alias("Prestaciones_PAC"),
            (F.col("n_items") - F.col("n_pac")).cast("double").alias("Prestaciones_PBS"),
            F.when(key % 6 < 4, (key % 6).cast("string"))
            .when(key % 6 == 4, "-1")
            .otherwise("cluster 7")
            .alias("cluster"),
            F.when(status == "F", pick(key % 4, "MORA", "NO PBS", "OTRAS CAUSAS", "PETICION DEL CLIENTE"))
            .otherwise("NO APLICA")
            .alias("GRUPO_CAUSA_CANCELACION"),
            *INTERACTIONS,
            F.col("c_acctbal").alias("INGRESO"),
            F.round(F.least(F.col("o_totalprice") / 500000, F.lit(1.0)), 6).alias("Riesgo_Calculado"),
        )

    @cached_property
    def features(self) -> DataFrame:
        """Spells with a calculated risk and the one-hot columns a model reads."""
        region = [
            F.when(F.col("Regional_Agrupadora") == r, 1).otherwise(0).alias(f"Regional_Agrupadora_{r}") for r in REGIONS
        ]
        stage = [
            F.coalesce((F.col("SEGMENTO_EDAD") == a).cast("int"), F.lit(0)).alias(f"SEGMENTO_EDAD_{a}")
            for a in AGE_STAGES
        ]
        return self.spells.select("*", *region, *stage)

    @cached_property
    def interactions(self) -> DataFrame:
        """One row per logged interaction of an affiliate."""
        orders = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        return (
            self.raw("lineitem")
            .join(orders, "l_orderkey")
            .select(
                F.col("o_custkey").cast("string").alias("AFILIADO_ID_EPS"),
                F.col("l_shipdate").cast("date").alias("fecha"),
                pick(F.col("l_suppkey") % 5, *KINDS).alias("tipo"),
                F.when(F.col("l_linestatus") == "O", "PAC").otherwise("PBS").alias("plan"),
            )
        )

    @cached_property
    def base_risk(self) -> DataFrame:
        key = F.col("c_custkey")
        risk = ((key * 7919) % 1000) / F.lit(1000.0)
        return self.raw("customer").select(key, risk.alias("risk_12m"), "c_acctbal")

    @cached_property
    def permanencia(self) -> DataFrame:
        """Predicted 120-month curve per affiliate; accounts in debt appear twice."""
        return self.curves(self.base_risk)

    @cached_property
    def permanencia_dealt(self) -> DataFrame:
        """``permanencia``, its few columns dealt out before each row grows to 120 months."""
        return self.curves(spread(self.base_risk))

    def curves(self, base: DataFrame) -> DataFrame:
        risk = F.col("risk_12m")

        def survival(m: int):
            return F.pow(1 - risk, F.lit(m / 12.0))

        def passed(m: int):
            return F.round(1 - survival(m), 9) >= RISK_CUT

        group = (
            F.when(passed(3), " critico ").when(passed(6), "ALTO").when(passed(12), "ESTRATEGIA_PROACTIVA")
        ).otherwise("BAJO")
        months = F.array(*[F.lit(float(m)) for m in range(1, MONTHS + 1)])
        first = F.array_position(
            F.transform(months, lambda m: F.round(1 - F.pow(1 - risk, m / 12.0), 9) >= RISK_CUT), F.lit(True)
        )
        copies = F.when(F.col("c_acctbal") < 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return base.withColumn("_first", first.cast("int")).select(
            F.col("c_custkey").cast("string").alias("AFILIADO_ID_EPS"),
            "risk_12m",
            group.alias("grupo_operativo"),
            F.nullif("_first", F.lit(0)).alias("tiempo_gatillo_m"),
            F.explode(copies).alias("dup"),
            *[survival(m).alias(f"S_{m}m") for m in range(1, MONTHS + 1)],
        )

    @cached_property
    def scored(self) -> DataFrame:
        """One scored customer per row with the outcome that came true."""
        key = F.col("c_custkey")
        draw = (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % 1000) / F.lit(1000.0)
        return self.base_risk.select(
            key.alias("id"),
            F.col("risk_12m").alias("Probabilidad"),
            (draw < F.col("risk_12m")).cast("int").alias("Es_Fuga_Real"),
        )

    @cached_property
    def wide_features(self) -> DataFrame:
        """One row per customer with the numeric inputs of the contribution table."""
        usage = (
            self.raw("orders")
            .join(self.items, "o_orderkey", "left")
            .groupBy(F.col("o_custkey").alias("c_custkey"))
            .agg(
                F.count(F.lit(1)).cast("double").alias("NUM_ORDERS"),
                F.sum("n_items").cast("double").alias("NUM_ITEMS"),
                F.sum("n_pac").cast("double").alias("Prestaciones_PAC"),
                F.sum(F.col("n_items") - F.col("n_pac")).cast("double").alias("Prestaciones_PBS"),
            )
        )
        return self.base_risk.join(usage, "c_custkey", "left").select(
            F.col("c_custkey").cast("string").alias("ID"),
            F.col("c_acctbal").alias("ACCT_BAL"),
            "NUM_ORDERS",
            "NUM_ITEMS",
            "Prestaciones_PAC",
            "Prestaciones_PBS",
            "risk_12m",
            F.lit(1.0).alias("CONST_BIN"),
        )

    @cached_property
    def more_features(self) -> DataFrame:
        """The numeric inputs and sixteen more, beyond what a chart of twenty or a list of seven shows."""
        key = F.col("ID").cast("bigint")
        return self.wide_features.select("*", *[((key * step % 97) / F.lit(10.0)).alias(n) for n, (step, _) in CYCLES.items()])

    @cached_property
    def complaints(self) -> DataFrame:
        """Web events read as interactions: an error plays the complaint."""
        return self.raw("events").select(
            F.col("user_id").cast("string").alias("AFILIADO_ID_EPS"),
            F.col("ts").cast("timestamp_ntz").alias("ts"),
            F.col("event_type").alias("tipo"),
            "value",
        )

    @cached_property
    def campaigns(self) -> DataFrame:
        """One campaign per supplier with its parameters still as form text."""
        key = F.col("s_suppkey")
        money = F.format_number(F.abs(F.col("s_acctbal")) * 1000, 0)
        return self.raw("supplier").select(
            key.alias("campaign_id"),
            F.when(key % 5 == 0, "sin dato").when(key % 5 == 1, F.concat(F.lit(" "), money)).otherwise(money).alias("ltv"),
            F.when(key % 4 == 0, None).otherwise(F.concat((key % 90 + 1).cast("string"), F.lit(" 000"))).alias("call_cost"),
            F.concat(F.lit("$ "), money).alias("incentive"),
            F.when(key % 6 == 0, "NaN").otherwise(F.format_string("0.%d", key % 10)).alias("success"),
            F.when(key % 7 == 0, "-3").when(key % 7 == 1, "x").otherwise(((key + 1) * 37).cast("string")).alias("budget"),
        )

