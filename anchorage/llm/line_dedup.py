"""Line dedup across documents, in built-in functions.

Lines are exploded with their places, normalised and hashed; the distinct documents
of every hash are counted with partial counts, and a line that enough documents hold
stays only in the largest of them. Dropped places return to their documents, whose
other lines are put together again by position. Texts travel once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.llm.common import discard, joined_to_unique, staged, table

MIN_CHARS = 40
MIN_DOCUMENTS = 5
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def normalised(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case.

    A line whose characters are single bytes has no other letters that ``lower`` changes.
    """
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, at, h1, h2) of every line whose key has enough code points: its place and 128 bits of its key."""
    every = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    keyed = every.filter(F.length("line") >= min_chars).withColumn("key", normalised(F.col("line")))
    hashes = F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    return keyed.filter(F.length("key") >= min_chars).select("doc_id", "text_hash", "at", *hashes)


def frequent(lines: DataFrame, min_documents: int) -> DataFrame:
    """(h1, h2, holder, rows) of the keys that enough documents hold, with the largest of these and the number of lines."""
    return (
        lines.groupBy("h1", "h2", "doc_id")
        .agg(F.count("*").alias("rows"))
        .groupBy("h1", "h2")
        .agg(F.count("doc_id").alias("documents"), F.max("doc_id").alias("holder"), F.sum("rows").alias("rows"))
        .filter(F.col("documents") >= min_documents)
        .drop("documents")
    )


def dropped(docs: DataFrame, min_chars: int, min_documents: int) -> DataFrame:
    """(d_doc, d_text, gone): the places of the lines that a document loses, found by its id and text hash."""
    lines = staged(long_lines(docs, min_chars), "lines")
    keys = staged(frequent(lines, min_documents), "line-keys")
    lost = joined_to_unique(lines, keys, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
    gone = lost.groupBy(F.col("doc_id").alias("d_doc"), F.col("text_hash").alias("d_text")).agg(F.collect_set("at").alias("gone"))
    gone = staged(gone, "dropped-lines")
    discard(lines, keys)
    return gone


def left_of(docs: DataFrame, min_chars: int, min_documents: int) -> DataFrame:
    """(row, n_lines, n_dropped, left): every row of ``docs`` as a struct with its text after dropping."""
    gone = dropped(docs, min_chars, min_documents)
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_doc"), text_hash(F.col("text")).alias("_text"))
    same = held["_doc"].eqNullSafe(gone["d_doc"]) & (held["_text"] == gone["d_text"])
    found = held.join(gone, same, "left").withColumn("_lines", lines_of(F.col("row.text")))
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("gone"))
    rest = F.array_join(F.transform(places, lambda at: F.get("_lines", at)), "\n")
    return found.select(
        "row",
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(rest).alias("left"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for every row of ``docs`` (doc_id, text).

    A line's key is the line without white space at its ends, A-Z in lower case. A key
    of at least ``min_chars`` code points that at least ``min_documents`` documents hold
    loses all its lines but those of the largest doc_id holding it. A null or empty text
    is one empty line. Rows that repeat a doc_id are one document, and each row gives a
    row; a row without an id counts as no document and loses the lines that enough
    others hold. Other columns are ignored; an empty table gives no rows.
    """
    rows = left_of(docs.select("doc_id", "text"), min_chars, min_documents)
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.col("left").alias("text"))


def cut_documents(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Every row of ``docs`` with all its columns, its text as ``dedup_lines`` leaves it.

    ``n_chars``, where there is such a column, follows a text that lost lines. A null
    text is empty afterwards; other rules are those of ``dedup_lines``.
    """
    row = F.col("row").withField("text", F.col("left"))
    if "n_chars" in docs.columns:
        length = F.length("left").cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(F.col("n_dropped") > 0, length).otherwise(F.col("row.n_chars")))
    return left_of(docs, min_chars, min_documents).select(row.alias("row")).select("row.*")


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Line dedup of the whole table ``documents``: counts and the digest of what is left of each text."""
    rows = dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          '{UPPER}', '{UPPER.lower()}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= {MIN_CHARS}
      GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}),
m AS (SELECT k.doc_id, k.place, k.line, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.holder AS lost
      FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
