"""Readers that check and coerce on the way in, and the list writer."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorage.functions import columns as c
from anchorage.operators.clean import PQRS, USAGE, first_per_id
from anchorage.operators.explain import tidy

# Text that means missing in the delimited files.
MISSING = ("", "NA", "NaN", "NULL", "null")

DATES = ("FECHA_INICIO", "FECHA_FIN")
NUMBERS = ("EDAD_FECHA_FIN", "Felicitaciones_PAC", "Felicitaciones_PBS", *(f"{n}{end}" for n in (*USAGE, *PQRS) for end in ("", "_FIN")))
CONTRIB_COLUMNS = ("ID", "feature", "shap_value", "feature_value")
INDEX_COLUMN = "Unnamed: 0"


def require(df: DataFrame, names: Sequence[str]) -> DataFrame:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def first_line(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path).limit(1).collect()
    return rows[0][0] if rows else ""


def detect_sep(line: str) -> str:
    """Most frequent delimiter of a header line outside quotes; semicolon wins ties, then tab."""
    bare = "".join(line.split('"')[::2])
    comma, semicolon, tab = (bare.count(s) for s in ",;\t")
    if semicolon >= comma and semicolon >= tab:
        return ";"
    return "\t" if tab >= comma else ","


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, multi_line: bool = False) -> DataFrame:
    """All columns as text with trimmed headers; the schema comes from the header line alone.

    Quotes follow RFC 4180: a quoted cell may hold separators and doubled quotes.
    Line breaks inside quotes need ``multi_line``, which reads each file as a whole;
    without it they, like any row of another width, fail the read. Files of one
    folder must agree in their headers. A column without a header, as a saved index
    has, is named by its position, and the headers are then not compared.
    """
    header = first_line(spark, path).lstrip("\ufeff")
    sep = sep or detect_sep(header)
    raw = next(csv.reader([header], delimiter=sep), [])
    names = [n.strip() or f"Unnamed: {i}" for i, n in enumerate(raw)]
    alike = all(n.strip() for n in raw) and len({n.lower() for n in raw}) == len(raw)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (raw if alike else names)])
    rows = spark.read.csv(
        path, sep=sep, header=True, schema=schema, enforceSchema=not alike, multiLine=multi_line, quote='"', escape='"', mode="FAILFAST"
    )
    return rows.toDF(*names)


def known(text: Column) -> Column:
    return F.when(~text.isin(*MISSING), text)


def read_spells(spark: SparkSession, path: str, sep: str | None = None, multi_line: bool = False) -> DataFrame:
    """Spell table from delimited text: missing marks to null, dates and numbers coerced."""
    df = read_delimited(spark, path, sep, multi_line)

    def coerced(name: str) -> Column:
        text = known(F.col(f"`{name}`"))
        if name in DATES:
            return c.parse_date_any(text)
        return c.safe_num(text) if name in NUMBERS else text

    return df.select(*[coerced(n).alias(n) for n in df.columns])


def read_permanence(spark: SparkSession, path: str, order: Sequence[str] = ()) -> DataFrame:
    """Risk table with a text id and one row per id, the first by ``order``."""
    df = require(spark.read.parquet(path), ["AFILIADO_ID_EPS"])
    df = df.withColumn("AFILIADO_ID_EPS", F.col("AFILIADO_ID_EPS").cast("string"))
    return first_per_id(df, "AFILIADO_ID_EPS", *(order or [n for n in df.columns if n != "AFILIADO_ID_EPS"]))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_contrib(spark: SparkSession, *paths: str, multi_line: bool = False) -> DataFrame:
    """Contribution table from the first path that exists."""
    found = next((p for p in paths if path_exists(spark, p)), None)
    if found is None:
        raise FileNotFoundError(", ".join(paths))
    return tidy(require(read_delimited(spark, found, ",", multi_line), CONTRIB_COLUMNS))


def read_features(spark: SparkSession, path: str, expected: Sequence[str]) -> DataFrame:
    """Feature matrix in the model's column order, without the saved index column."""
    df = require(read_delimited(spark, path, ",").drop(INDEX_COLUMN), expected)
    return df.select(*[c.number_or_null(F.col(f"`{n}`")).alias(n) for n in expected])


def write_lists(df: DataFrame, path: str, group: str = "Grupo") -> None:
    """One CSV set per list, each in its own folder."""
    df.write.mode("overwrite").option("header", True).partitionBy(group).csv(path)
