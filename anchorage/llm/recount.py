"""Edit-aware token counts.

A document keeps a segment tree over leaves of consecutive pre-token units, with the
characters and tokens of every subtree. The trees are a table: a row holds a text and the
characters and tokens of its leaves, from which the sums follow without encoding. An edit
finds its leaves by character sums, re-encodes only these, widened until both ends are
places where the encoding may be cut, and updates the sums above them; leaves that grew
are split. The next batch of edits starts from the kept leaves. Counts equal a full recount.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.llm.common import mapped, staged, table
from anchorage.llm.tokens import Encoder, encoder, public_path, units

LEAF_UNITS = 32
REMOVED = 12
EDITS = "array<struct<start:bigint,removed:bigint,inserted:string>>"


def safe_cut(text: str, at: int) -> bool:
    """Whether the text may be encoded in two parts at ``at``."""
    return at in (0, len(text)) or (text[at] == " " and not text[at - 1].isspace() and at + 1 < len(text) and not text[at + 1].isspace())


class Tree:
    """Characters and tokens of the leaves, with sums in heap order from node 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.leaves = len(chars)
        self.size = 1 << max(0, (len(chars) - 1).bit_length())
        pad = [0] * (self.size - len(chars))
        self.chars, self.tokens = [0] * self.size + chars + pad, [0] * self.size + tokens + pad
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) that holds the character at ``place``; the last leaf beyond the end."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def kept(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves."""
        end = self.size + self.leaves
        return self.chars[self.size : end], self.tokens[self.size : end]

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.size + leaf
        self.chars[node], self.tokens[node] = chars, tokens
        while node > 1:
            node //= 2
            self._sum(node)


def leaves_of(parts: list[str], own: Encoder, count: int) -> tuple[list[int], list[int]]:
    """Characters and tokens of ``count`` leaves over the units of a text, at least one."""
    tokens = [len(ids) // 4 for ids in own.unit_ids(parts)]
    cuts = [len(parts) * k // count for k in range(count + 1)]
    spans = list(zip(cuts, cuts[1:]))
    return [sum(map(len, parts[a:b])) for a, b in spans], [sum(tokens[a:b]) for a, b in spans]


def planted(text: str, own: Encoder) -> Tree:
    """The tree of a text."""
    parts = units(text)
    return Tree(*leaves_of(parts, own, max(1, -(-len(parts) // LEAF_UNITS))))


def edited(text: str, tree: Tree, start: int, removed: int, inserted: str, own: Encoder) -> tuple[str, int]:
    """Apply one edit to text and tree; returns the new text and how many characters were encoded.

    Places beyond the end are the end.
    """
    start = min(max(start, 0), len(text))
    stop = min(start + max(removed, 0), len(text))
    first, a = tree.leaf_at(start)
    last, b = tree.leaf_at(stop)
    new = text[:start] + inserted + text[stop:]
    shift = len(new) - len(text)
    end = b + tree.chars[tree.size + last]
    while not safe_cut(new, a):
        first, a = tree.leaf_at(a - 1)
    while not safe_cut(new, end + shift):
        last, b = tree.leaf_at(end)
        end = b + tree.chars[tree.size + last]
    part = new[a : end + shift]
    parts, slots = units(part), last - first + 1
    count = max(1, -(-len(parts) // LEAF_UNITS))
    if len(parts) <= 2 * LEAF_UNITS * slots:
        count = min(count, slots)
    sizes, tokens = leaves_of(parts, own, count)
    if count <= slots:
        for k in range(slots):
            tree.put(first + k, *((sizes[k], tokens[k]) if k < count else (0, 0)))
    else:
        chars, counts = tree.kept()
        chars[first : last + 1], counts[first : last + 1] = sizes, tokens
        tree.__init__(chars, counts)
    return new, len(part)


LEAVES = "leaf_chars array<int>, leaf_tokens array<int>"
COUNTS = "doc_id long, n_tokens long, n_edits int, edited_chars long, edited_tokens long, encoded_chars long, leaves int"


def columns_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def plant(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text, edits, leaf_chars, leaf_tokens): the tree of every row of ``docs``, encoded once.

    Columns: doc_id, text and, if there are any, edits. A null text is empty; a null doc_id
    stays null, repeated rows give equal rows, other columns are ignored, and an empty table
    gives no rows.
    """
    edits = F.col("edits") if "edits" in docs.columns else F.array().cast(EDITS)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), edits.cast(EDITS).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            kept = [planted(text, own).kept() for text in batch.column(1).to_pylist()]
            leaves = [pa.array([k[i] for k in kept], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *leaves], names=[*rows_names, *columns_of(LEAVES)])

    rows_names = rows.columns
    return mapped(rows, run, f"doc_id long, text string, edits {EDITS}, {LEAVES}")


def apply_edits(trees: DataFrame, tokenizer: str) -> DataFrame:
    """Trees after the edits of each row of ``trees``, with token counts before and after.

    Columns: doc_id, text, leaf_chars, leaf_tokens, as ``plant`` or an earlier call gives
    them, and edits array<struct<start, removed, inserted>>, applied in order. Only the
    leaves that an edit touches and their context are encoded; ``encoded_chars`` tells how
    much that was. Null edits are none, null parts of an edit are 0 and empty. Rows without
    edits keep their leaves; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            out = []
            for doc, text, chars, tokens, edits in zip(*(batch.column(k).to_pylist() for k in range(5))):
                tree = Tree(chars, tokens)
                before, encoded = tree.tokens[1], 0
                for edit in edits or []:
                    text, n = edited(text, tree, edit["start"] or 0, edit["removed"] or 0, edit["inserted"] or "", own)
                    encoded += n
                kept = tree.kept()
                out.append((doc, before, len(edits or []), len(text), tree.tokens[1], encoded, len(kept[0]), text, *kept))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            kinds += [pa.list_(pa.int32())] * 2
            columns = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=columns_of(after))

    after = f"{COUNTS}, text string, {LEAVES}"
    return mapped(trees.select("doc_id", "text", *columns_of(LEAVES), F.col("edits").cast(EDITS)), run, after)


def recount(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Token counts before and after the edits of each row of ``docs`` (doc_id, text, edits), as ``plant`` and ``apply_edits`` take them."""
    return apply_edits(plant(docs, tokenizer), tokenizer).select(*columns_of(COUNTS))


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document with two edits of its own: a stretch replaced by its source's
    name at a place drawn by its id, and its language appended. The trees are planted and
    written first; the edits are applied to the written trees."""
    docs = table(spark, sf_dir, "documents")
    place = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.length("text") + 1).cast("long")
    swap = F.struct(place.alias("start"), F.lit(REMOVED).cast("long").alias("removed"), F.col("source").alias("inserted"))
    add = F.struct(
        (F.length("text").cast("long") * 2 + 1).alias("start"),
        F.lit(0).cast("long").alias("removed"),
        F.concat(F.lit(" "), F.col("lang")).alias("inserted"),
    )
    trees = staged(plant(docs.withColumn("edits", F.array(swap, add)), public_path()), "trees")
    return apply_edits(trees, public_path()).select(*columns_of(COUNTS))
