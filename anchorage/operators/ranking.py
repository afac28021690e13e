"""The prioritised risk table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.functions.columns import tie_order

ID = "AFILIADO_ID_EPS"


def ranking(df: DataFrame, columns: Sequence[str], limit: int = 5, offset: int = 0) -> DataFrame:
    """One page of active affiliates by risk, highest first and unknown risk last."""
    risk = F.col("risk_12m").try_cast("double")
    shown = df.select(
        F.col(ID),
        risk.alias("riesgo"),
        F.when(risk.isNotNull(), F.format_string("%.2f%%", risk * 100)).alias("probabilidad"),
        "FECHA_INICIO",
        *[n for n in columns if n in df.columns],
    )
    return shown.orderBy(F.desc_nulls_last("riesgo"), tie_order(F.col(ID)), ID).offset(offset).limit(limit)
