"""MinHash near-dedup with bottom-k sketches of one hash function.

Documents with the same words are one class from the start. Every class keeps the
k smallest hashes of its shingles. Inverted lists of the retained values propose
pairs: values are ordered from rare to frequent and only so many of a sketch's
values are listed that two sketches with enough in common must meet in one, so a
passage shared by many documents proposes nothing by itself. The union of two
sketches estimates their similarity; exact sets confirm it.

A list of at most ``SHORT_LIST`` classes proposes all its pairs. A longer one
first proposes only (smallest class, member). What is not linked by that is
compared in blocks of bounded size inside tasks, which return links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.llm.common import discard, mapped, ship, staged, table
from anchorage.llm.components import components

WORDS = 5
KEEP = 64
PERCENT = 85
#: Share of retained values that linked sketches have in common, but for one pair in a million.
SURE = 0.62
SHORT_LIST = 32
BLOCK_FEW, BLOCK_MANY = 256, 1024
SLICE = 2048

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles, or of all words where there are fewer."""
    if not words:
        return np.empty(0, np.int64)
    if len(words) < WORDS:
        whole = xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))
        return np.array([whole], np.uint64).view(np.int64)
    each = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)
    n = len(each) - WORDS + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(WORDS):
        mixed = (mixed ^ (each[k : k + n] * _FACTORS[k])) * _FACTORS[(k + 1) % WORDS]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def key_of(words: list[bytes]) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    return tuple(np.frombuffer(digest, np.int64).tolist())


def signatures(docs: DataFrame, full: bool = False) -> DataFrame:
    """(doc_id, text_hash, k1, k2, n_shingles, hashes) per row; ``full`` keeps whole sets, else bottom-k sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, kept = [], [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                found = shingles(words)
                keys.append(key_of(words))
                sizes.append(len(found))
                kept.append(found if full else found[:KEEP])
            offsets = np.zeros(len(kept) + 1, np.int32)
            offsets[1:] = np.cumsum([len(h) for h in kept])
            flat = pa.array(np.concatenate([*kept, np.empty(0, np.int64)]), pa.int64())
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([k[0] for k in keys], pa.int64()),
                pa.array([k[1] for k in keys], pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), flat),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "k1", "k2", "n_shingles", "hashes"])

    schema = "doc_id long, text_hash long, k1 long, k2 long, n_shingles long, hashes array<long>"
    text = F.coalesce(F.col("text"), F.lit(""))
    return mapped(docs.select("doc_id", F.xxhash64(text), "text"), run, schema)


def in_common(n: Column) -> Column:
    """Values that a sketch of a set of n shares at least with a linked one's."""
    whole = F.ceil(n * PERCENT / F.lit(100))
    return F.when(n * 100 <= KEEP * PERCENT, whole).otherwise(F.floor(F.least(n, F.lit(KEEP)) * SURE)).cast("int")


def postings(reps: DataFrame) -> DataFrame:
    """(value, rep, n) of the listed values: the rarest of each sketch, without those nobody shares."""
    held = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("hashes").alias("value"))
    often = held.groupBy("value").agg(F.count("*").alias("often")).filter("often > 1")
    listed = F.least(F.col("n"), F.lit(KEEP)).cast("int") - in_common(F.col("n")) + 1
    own = F.least(F.col("n"), F.lit(KEEP)).cast("int") - F.size("shared")
    return (
        held.join(often, "value")
        .groupBy("rep", "n")
        .agg(F.sort_array(F.collect_list(F.struct("often", "value"))).alias("shared"))
        .withColumn("take", F.greatest(listed - own, F.lit(0)))
        .select("rep", "n", F.explode(F.slice("shared", F.lit(1), F.col("take"))["value"]).alias("value"))
    )


def proposed(lists: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of classes whose sizes allow a link, from ``lists`` (value, rep, n, members, hub)."""
    left = lists.select("value", "members", F.col("rep").alias("a"), F.col("n").alias("na"), "hub")
    right = lists.filter(F.col("members") <= SHORT_LIST).select("value", F.col("rep").alias("b"), F.col("n").alias("nb"))
    short = left.join(right, "value").filter("a < b").select("a", "b", "na", "nb")
    hubs = lists.filter("rep = hub").select("value", F.col("n").alias("na"))
    long = (
        left.filter((F.col("members") > SHORT_LIST) & (F.col("a") != F.col("hub")))
        .withColumnRenamed("na", "nb")
        .join(hubs, "value")
        .select(F.col("hub").alias("a"), F.col("a").alias("b"), "na", "nb")
    )
    able = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
    return short.union(long).filter(able).distinct()


def with_hashes(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    a = hashes.select(F.col("rep").alias("a"), F.col("hashes").alias("ha"))
    b = hashes.select(F.col("rep").alias("b"), F.col("hashes").alias("hb"))
    return pairs.join(a, "a").join(b, "b")


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose union sketch holds enough values of both; complete sketches are judged exactly."""
    least = F.slice(F.sort_array(F.array_union("ha", "hb")), 1, KEEP)
    both = F.size(F.array_intersect(F.array_intersect("ha", "hb"), least))
    of = F.least(F.lit(KEEP), F.size(F.array_union("ha", "hb")))
    whole = F.greatest("na", "nb") <= KEEP
    exact = 100 * F.size(F.array_intersect("ha", "hb")) >= PERCENT * F.size(F.array_union("ha", "hb"))
    enough = F.when(whole, exact).otherwise(both >= F.floor(SURE * of))
    return with_hashes(pairs, sketches).filter(enough).select("a", "b", "na", "nb")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    same = F.size(F.array_intersect("ha", "hb"))
    return with_hashes(pairs, sets).filter(100 * same >= PERCENT * (F.col("na") + F.col("nb") - same)).select("a", "b")


def linked_blocks(few: list[np.ndarray], many: list[np.ndarray], apart: np.ndarray) -> np.ndarray:
    """Index pairs (few, many) whose exact similarity links them, where ``apart`` allows."""
    rows = [*few, *many]
    sizes = np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    _, code, times = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    shared = times[code] > 1
    owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    same = np.zeros((len(few), len(many)), np.float32)
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, SLICE):
        a, b = np.searchsorted(code, [start, start + SLICE])
        part = np.zeros((len(rows), SLICE), np.float32)
        part[owner[a:b], code[a:b] - start] = 1
        same += part[: len(few)] @ part[len(few) :].T
    union = sizes[: len(few), None] + sizes[None, len(few) :] - same
    return np.argwhere(apart & (100 * same >= PERCENT * union))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same numbers as the links (a, b), one for each number but the smallest of those joined."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(names))
    while True:
        least, before = np.minimum(label[u], label[v]), label.copy()
        np.minimum.at(label, before[u], least)
        np.minimum.at(label, before[v], least)
        label = label[label]
        if (label == before).all():
            break
    joined = label != np.arange(len(names))
    return names[label[joined]], names[joined]


def left_over(lists: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that join the parts of long lists that their hubs did not join.

    Lists with one hub are compared together. Members of the largest part are only
    compared with members of the others, in blocks of bounded size. A block finds all its
    links and returns as many as join its parts alike, fewer than it has members.
    """
    held = (
        lists.filter(F.col("members") > SHORT_LIST)
        .select("hub", "rep")
        .distinct()
        .join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
        .withColumn("part", F.coalesce("label", "rep"))
        .drop("label")
    )
    sizes = held.groupBy("hub", "part").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("hub").agg(
        F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("total"), F.count("*").alias("parts")
    )
    rows = held.join(whole.filter("parts > 1"), "hub")
    few = F.greatest(F.lit(1), F.ceil((F.col("total") - F.col("most.n")) / BLOCK_FEW)).cast("int")
    many = F.greatest(F.lit(1), F.ceil(F.col("total") / BLOCK_MANY)).cast("int")
    rows = rows.select(
        "hub", "rep", "part", (F.col("part") != F.col("most.part")).alias("is_few"), few.alias("few"), many.alias("many")
    )
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.filter("is_few").select("hub", "rep", "part", own("few").alias("f"), upto("many").alias("m"), F.lit(True).alias("is_few"))
    right = rows.select("hub", "rep", "part", upto("few").alias("f"), own("many").alias("m"), F.lit(False).alias("is_few"))

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        a, b = block[block["is_few"]], block[~block["is_few"]]
        if a.empty or b.empty:
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        apart = a["part"].to_numpy()[:, None] != b["part"].to_numpy()[None, :]
        found = linked_blocks(list(a["hashes"]), list(b["hashes"]), apart)
        links = spanning(a["part"].to_numpy()[found[:, 0]], b["part"].to_numpy()[found[:, 1]])
        return pd.DataFrame(dict(zip("ab", links))).astype("int64")

    ship(lists.sparkSession)
    return left.union(right).join(sets, "rep").groupBy("hub", "f", "m").applyInPandas(compare, "a long, b long")


def text_classes(ids: DataFrame) -> DataFrame:
    """(rep, doc, text, k1, k2), written: a number for every class of rows with the same words, its
    smallest doc_id, and the text hash of one row with that id. Ids that are missing come last."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("row")
    found = ids.filter("n_shingles > 0").groupBy("k1", "k2").agg(least)
    found = found.select(F.monotonically_increasing_id().alias("rep"), F.col("row.doc_id").alias("doc"), F.col("row.text_hash").alias("text"), "k1", "k2")
    return staged(found, "classes")


def chosen_rows(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows (doc_id, text_hash, ...) that stand for a class, found by id, missing ones included, and text."""
    wanted = classes.select(F.col("doc").alias("_doc"), F.col("text").alias("_text"))
    return rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["_doc"]) & (rows["text_hash"] == wanted["_text"]), "left_semi")


def same_document(ids: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (a, b) between the classes of rows that repeat a doc_id with other words, if there are such rows."""
    held = ids.filter("n_shingles > 0 and doc_id is not null")
    key = F.struct("k1", "k2")
    several = held.groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).filter("low != high").select("doc_id", "low")
    if several.isEmpty():
        return None
    pairs = held.join(several, "doc_id").filter(F.col("low") != key).select("low", "k1", "k2").distinct()
    a = classes.select(F.col("rep").alias("a"), F.struct("k1", "k2").alias("low"))
    return pairs.join(a, "low").join(classes.select(F.col("rep").alias("b"), "k1", "k2"), ["k1", "k2"]).select("a", "b")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, text_hash.

    Texts without words, null ones included, are linked with nothing. Rows that repeat a
    doc_id are one document, linked by each of its texts. Rows without an id are linked like
    the others; their component is the smallest id among them all, if there is one. Where
    there is none, the rows of one of the texts are kept. Other columns are ignored; an empty
    table gives no rows.
    """
    rows = staged(signatures(docs), "signatures")
    ids = rows.select("doc_id", "text_hash", "k1", "k2", "n_shingles")
    classes = text_classes(ids)
    numbered = classes.select("rep", "k1", "k2")
    found = chosen_rows(rows.filter("n_shingles > 0"), classes).select("k1", "k2", "n_shingles", "hashes")
    sketches = staged(found.join(numbered, ["k1", "k2"]).dropDuplicates(["rep"]).select("rep", "n_shingles", "hashes"), "sketches")

    listed = staged(postings(sketches), "postings")
    heads = listed.groupBy("value").agg(F.count("*").alias("members"), F.min("rep").alias("hub")).filter("members > 1")
    lists = listed.join(heads, "value")
    pairs = staged(likely(proposed(lists), sketches), "pairs")

    hot = lists.filter(F.col("members") > SHORT_LIST).select("rep")
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).union(hot).distinct()
    hashed = docs.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"))
    full = signatures(chosen_rows(hashed, classes.join(wanted, "rep", "left_semi")), full=True)
    sets = staged(full.join(numbered, ["k1", "k2"]).dropDuplicates(["rep"]).select("rep", "hashes"), "sets")

    found, same = confirmed(pairs, sets), same_document(ids, classes)
    first = staged(found.unionByName(same) if same else found, "links")
    labels = components(first)
    more = staged(left_over(lists, labels, sets), "more")
    if not more.isEmpty():
        labels = components(first.union(more))
    discard(sketches, listed, pairs, sets, first, more)

    linked = labels.withColumnRenamed("node", "rep").join(classes.select("rep", "doc"), "rep")
    smallest = linked.groupBy("label").agg(F.min("doc").alias("least"))
    named = linked.join(smallest, "label").select("rep", "least", "label")
    groups = classes.join(named, "rep", "left").select(
        "k1",
        "k2",
        F.when(F.col("label").isNotNull(), F.col("least")).otherwise(F.col("doc")).alias("component_id"),
        (F.coalesce("label", "rep") == F.col("rep")).alias("first"),
    )
    told = ids.join(groups, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    # Where no row has an id, the rows of one text stay.
    kept = F.col("doc_id").eqNullSafe(component) & (F.col("doc_id").isNotNull() | F.coalesce("first", F.lit(True)))
    return told.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_hash")


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-dedup of the whole table ``documents``: component, kept or not, and set size of every row."""
    return near_groups(table(spark, sf_dir, "documents")).drop("text_hash")


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(words[i : i + 4], 'string_agg', ' ') AS shingle
      FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 4))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= {PERCENT} * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
