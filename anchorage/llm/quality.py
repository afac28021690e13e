"""Quality rules with cross-document line frequency, in built-in functions only.

Every line is normalised and hashed. Per host the distinct documents that hold a
line are counted; lines above the host's limit are boilerplate. A document whose
words are nearly all boilerplate is depleted and rejected, as is one that fails
the base rules.

Copies of one document count once, for its lines and for the host's limit: equal
texts, by a hash of all normalised lines in order, are one document, so that a
document that was copied many times does not turn its own prose into boilerplate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.llm.common import staged, table

MIN_WORDS = 50
MAX_REPEATED = 50
MIN_DOCUMENTS = 20
HOST_SHARE = 0.01
LEAST_LEFT = 0.2
#: Bits that hold a place in an array.
START = (1 << 31) - 1
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tail(array: Column) -> Column:
    return F.slice(array, F.lit(2), F.greatest(F.size(array) - 1, F.lit(0)))


def head(array: Column) -> Column:
    return F.slice(array, F.lit(1), F.greatest(F.size(array) - 1, F.lit(0)))


def beside(array: str, alike: Callable[[Column, Column], Column]) -> Column:
    """The elements that are alike to the one before or after them."""
    near = lambda x, at: F.coalesce(alike(x, F.get(array, at)), F.lit(False))
    return F.filter(array, lambda x, at: near(x, at - 1) | near(x, at + 1))


def words_of(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def small(text: Column) -> Column:
    """A-Z lowered; ``translate``, which makes an object of every character, only where others than ASCII are."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def line_key(line: Column) -> Column:
    """60 bits of the md5 of a normalised line."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def repeated_words(df: DataFrame) -> DataFrame:
    """Add n_repeat_words from ``words``.

    Windows are sorted as plain longs, 33 bits of their hash above their start; only those
    that share these bits with a neighbour, every repeated window among them, become rows
    and are sorted by their whole hash. Equal neighbours there are the starts of repeated
    windows, whose three-word spans are then measured without overlap.
    Each array is a column of its own, so no array is rebuilt inside a lambda.
    """
    df = df.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    first = F.slice("_h", F.lit(1), F.greatest(F.size("_h") - 2, F.lit(0)))
    df = df.withColumn("_three", F.transform(first, lambda h, i: F.xxhash64(h, F.get("_h", i + 1), F.get("_h", i + 2))))
    df = df.withColumn("_key", F.sort_array(F.transform("_three", lambda h, i: h.bitwiseAND(F.lit(~START)).bitwiseOR(i.cast("long")))))
    near = beside("_key", lambda a, b: a.bitwiseXOR(b).between(0, START))
    at = F.transform(near, lambda key: key.bitwiseAND(F.lit(START)).cast("int"))
    df = df.withColumn("_sorted", F.sort_array(F.transform(at, lambda i: F.struct(F.get("_three", i).alias("h"), i.alias("i")))))
    same = beside("_sorted", lambda a, b: a["h"] == b["h"])
    df = df.withColumn("_starts", F.sort_array(F.transform(same, lambda x: x["i"])))
    gaps = F.zip_with(head(F.col("_starts")), tail(F.col("_starts")), lambda a, b: F.least(F.lit(3), b - a))
    covered = F.aggregate(gaps, F.lit(3).cast("long"), lambda s, g: s + g)
    return df.withColumn("n_repeat_words", F.when(F.size("_starts") == 0, F.lit(0).cast("long")).otherwise(covered)).drop(
        "_h", "_three", "_key", "_sorted", "_starts"
    )


def features(docs: DataFrame) -> DataFrame:
    """Per row: the base counts, and its lines as (hash, words, place among all lines)."""
    df = docs.select("doc_id", F.col("source").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("words", words_of(F.col("text")))
    df = repeated_words(df)
    df = df.withColumn("_raw", F.filter(F.split("text", "\n"), lambda line: line.rlike("[^\\x20\\x09\\x0B-\\x0D]")))
    tidy = F.transform(F.split(F.regexp_replace("text", "[\\x20\\x09\\x0B-\\x0D]+", " "), "\n"), lambda line: F.trim(line))
    tidy = F.transform(tidy, lambda line, at: F.struct(small(line).alias("line"), at.alias("at")))
    df = df.withColumn("_tidy", F.filter(tidy, lambda x: x["line"] != ""))
    lines = F.transform(
        "_tidy", lambda x: F.struct(line_key(x["line"]).alias("line"), F.size(F.split(x["line"], " ")).alias("words"), x["at"].alias("at"))
    )
    return df.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_raw") - F.size(F.array_distinct("_raw"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        lines.alias("lines"),
    ).withColumn("page", F.xxhash64("lines.line"))


def frequent_lines(rows: DataFrame, min_documents: int, host_share: float) -> DataFrame:
    """(host, line) held by more distinct texts than the host's limit."""
    limits = (
        rows.groupBy("host", "page")
        .agg(F.lit(1).alias("one"))
        .groupBy("host")
        .agg(F.greatest(F.lit(float(min_documents)), host_share * F.count("*")).alias("most"))
    )
    counted = (
        rows.select("host", "page", F.explode("lines.line").alias("line"))
        .groupBy("host", "line", "page")
        .agg(F.lit(1).alias("one"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > min_documents)
    )
    same = counted["host"].eqNullSafe(limits["host"])
    return counted.join(limits, same).filter(F.col("n") > F.col("most")).select(counted["host"], "line")


def judged(docs: DataFrame, min_words: int, max_repeated: int, min_documents: int, host_share: float, least_left: float) -> DataFrame:
    """The columns of ``judge`` with host and gone, the places of the frequent lines (null where there are none)."""
    rows = staged(features(docs), "quality")
    often = frequent_lines(rows, min_documents, host_share).withColumnsRenamed({"host": "often_host", "line": "often_line"})
    held = rows.select("doc_id", "text_hash", "host", F.explode("lines").alias("held"))
    hit = held["host"].eqNullSafe(often["often_host"]) & (held["held.line"] == often["often_line"])
    removed = (
        held.join(often, hit, "left_semi")
        .groupBy("doc_id", "text_hash", "host", F.col("held.at").alias("at"))
        .agg(F.max("held.words").alias("words"))
        .groupBy("doc_id", "text_hash", "host")
        .agg(F.sum("words").alias("n_boilerplate"), F.collect_list("at").alias("gone"))
        .withColumnsRenamed({"doc_id": "r_doc", "text_hash": "r_text", "host": "r_host"})
    )
    same = rows["doc_id"].eqNullSafe(removed["r_doc"]) & (rows["text_hash"] == removed["r_text"]) & rows["host"].eqNullSafe(removed["r_host"])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    left = F.col("n_words") - F.col("n_boilerplate")
    return (
        rows.join(removed, same, "left")
        .withColumn("n_boilerplate", F.coalesce("n_boilerplate", F.lit(0)))
        .select(
            "doc_id",
            "text_hash",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            failed.alias("base_failed"),
            (~failed & (left >= least_left * F.col("n_words"))).alias("kept"),
            "n_boilerplate",
            "host",
            "gone",
        )
    )


def judge(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    max_repeated: int = MAX_REPEATED,
    min_documents: int = MIN_DOCUMENTS,
    host_share: float = HOST_SHARE,
    least_left: float = LEAST_LEFT,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): counts, base_failed and kept.

    A null text has no words and fails the base rules. Rows without a source share
    one host. Repeated rows are judged alike, each on its own row; other columns
    are ignored; an empty table gives no rows.
    """
    return judged(docs, min_words, max_repeated, min_documents, host_share, least_left).drop("host", "gone")


def kept_documents(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    max_repeated: int = MAX_REPEATED,
    min_documents: int = MIN_DOCUMENTS,
    host_share: float = HOST_SHARE,
    least_left: float = LEAST_LEFT,
) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, their texts without the
    frequent lines; ``n_chars`` follows a text that lost lines if there is such a column.

    Rows are found again by id, text and source, nulls included; rows that repeat are all kept.
    """
    kept = judged(docs, min_words, max_repeated, min_documents, host_share, least_left).filter("kept")
    kept = kept.select("doc_id", "text_hash", "host", "gone").dropDuplicates(["doc_id", "text_hash", "host"])
    held = docs.select(F.struct("*").alias("row"))
    same = (
        held["row.doc_id"].eqNullSafe(kept["doc_id"])
        & (F.xxhash64(F.coalesce(held["row.text"], F.lit(""))) == kept["text_hash"])
        & held["row.source"].eqNullSafe(kept["host"])
    )
    lines = F.split("row.text", "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    found = held.join(kept, same).withColumn("_lines", F.when(F.col("gone").isNotNull(), lines))
    found = found.withColumn("_left", F.array_join(F.transform(places, lambda at: F.get("_lines", at)), "\n"))
    row = F.col("row").withField("text", F.coalesce("_left", "row.text"))
    if "n_chars" in docs.columns:
        length = F.length("_left").cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(length))
    return found.select(row.alias("row")).select("row.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Quality counts and verdict for every row of the whole table ``documents``."""
    return judge(table(spark, sf_dir, "documents")).drop("text_hash")


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
t AS (SELECT doc_id, i, word AS a, lead(word) OVER s AS b, lead(word, 2) OVER s AS c FROM p
      WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t WHERE c IS NOT NULL),
v AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS j)
      WHERE n >= 2 GROUP BY doc_id),
raw AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
tidy AS (SELECT doc_id, source, trim(line) AS line, place FROM (
           SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM (
             SELECT doc_id, source, string_split(regexp_replace(
               translate(text, '{UPPER}', '{UPPER.lower()}'), '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), chr(10)) AS lines
             FROM d)) WHERE trim(line) <> ''),
k AS (SELECT doc_id, source, ('0x' || left(md5(line), 15))::BIGINT AS line, len(string_split(line, ' ')) AS n, place FROM tidy),
l AS (SELECT d.doc_id, d.source, md5(coalesce(string_agg(line, ' ' ORDER BY place), '')) AS page
      FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id, d.source),
f AS (SELECT k.source, line, count(DISTINCT page) AS n FROM k JOIN l USING (doc_id) GROUP BY k.source, line),
h AS (SELECT source, greatest({MIN_DOCUMENTS}, {HOST_SHARE} * count(DISTINCT page)) AS most FROM l GROUP BY source),
o AS (SELECT f.source, f.line FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n > h.most),
x AS (SELECT k.doc_id, sum(k.n) AS n_boilerplate
      FROM k JOIN o ON k.source IS NOT DISTINCT FROM o.source AND k.line = o.line GROUP BY k.doc_id),
b AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(n_boilerplate, 0)::BIGINT AS n_boilerplate
      FROM w LEFT JOIN v USING (doc_id) LEFT JOIN raw USING (doc_id) LEFT JOIN x USING (doc_id)),
q AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - n_boilerplate >= {LEAST_LEFT} * n_words AS kept, n_boilerplate
FROM q
"""
