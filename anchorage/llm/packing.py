"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. Bins are planned on the
histogram of piece lengths, which has at most ``capacity`` rows however large the
corpus is: each bin takes the longest piece left and the combination of other
lengths that fills it best, found by subset-sum dynamic programming on an integer
used as a bitset. The combination is removed as often as the counts allow, so the
number of distinct combinations is bounded by the capacity as well. Spark then
numbers the pieces of each length and places them by their number.

Documents that were written in an order, as a mix is, can be packed in windows of it: a
sequence then holds neighbours of the order, and sequences are numbered along it. A
window is planned in a task, on its own histogram.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorage.llm.common import mapped, ship, staged, table
from anchorage.llm.tokens import encoder, public_path

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"
RANK_ROWS = 200_000
#: Documents of an order that are packed together, and the room for the numbers of their sequences.
WINDOW = 8_192
NUMBERS = 2**32


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]] if n else []


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, place: str | None = None) -> DataFrame:
    """One row per piece of every row of ``docs`` (doc_id, text).

    A null text is empty: its only id is the end id. A null doc_id stays null and
    repeated rows give their pieces again. Other columns are ignored, but for ``place``,
    a number that every piece of its row then carries.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer).ids
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text, at in zip(*batch.columns):
                ids = ids_of(text.as_py()) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    row = (doc.as_py(), k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), at.as_py())
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "place"]
            shown = len(names) if place else len(names) - 1
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out[:shown], kinds)], names=names[:shown])

    at = F.col(place).cast("long") if place else F.lit(0)
    return mapped(docs.select("doc_id", "text", at.alias("place")), run, PIECES + ", place long" if place else PIECES)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length fill one bin best, the longest length among them.

    Bit s of a stage is set when the lengths so far can sum to s. Longer lengths
    come last, so walking back takes long pieces first and leaves short ones.
    """
    longest = max(counts)
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    reach, stages = 1, []
    for length in sorted(counts):
        left = min(counts[length] - (length == longest), room // length)
        step = 1
        while left > 0:
            take = min(step, left)
            stages.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            step *= 2
    chosen = {longest: 1}
    total = reach.bit_length() - 1
    for length, take, before in reversed(stages):
        size = length * take
        if total >= size and before >> (total - size) & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= size
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(repeats, pieces per length) of every distinct bin, in the order they are filled."""
    left = {length: n for length, n in counts.items() if n}
    bins = []
    while left:
        chosen = fullest(left, capacity)
        repeats = min(left[length] // n for length, n in chosen.items())
        for length, n in chosen.items():
            left[length] -= n * repeats
            if not left[length]:
                del left[length]
        bins.append((repeats, chosen))
    return bins


def segments(bins: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, pieces per bin, first sequence, offset), by first rank."""
    found: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for repeats, chosen in bins:
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            found.setdefault(length, []).append((used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * repeats
            offset += n * length
        sequence += repeats
    return {length: np.array(rows, dtype=np.int64) for length, rows in found.items()}


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """Number the pieces of each length from 0, in hash buckets so that one frequent
    length is spread over many tasks."""
    buckets = max(8, total // RANK_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (
        rows.withColumn("rank", F.row_number().over(inside) - 1)
        .join(starts, ["length", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("first"))
        .drop("bucket", "first")
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their sequence and place.

    A null text is empty and gives its end alone; a null doc_id stays null, repeated rows
    are packed each, other columns are ignored, and an empty table gives no rows.
    """
    cuts = staged(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = segments(plan(counts, capacity))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for length, at in frame.groupby("length").indices.items():
                table = slots[int(length)]
                rank = frame["rank"].to_numpy()[at]
                first, n, begin, base = table[np.searchsorted(table[:, 0], rank, side="right") - 1].T
                sequence[at] = begin + (rank - first) // n
                offset[at] = base + (rank - first) % n * length
            yield frame.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    ship(docs.sparkSession)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked(cuts, sum(counts.values())).select(columns).mapInPandas(place, PLACED)


def in_written_order(docs: DataFrame) -> DataFrame | None:
    """(doc_id, text, place) for every row of ``docs``: its place from 0 in the files it is read from,
    taken by name. None where the rows come from no files."""
    try:
        at = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("nth"))
    except AnalysisException:
        return None
    # One task cumulates the files, a row each.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = at.groupBy("file").agg(F.count("*").alias("n"))
    starts = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return at.join(F.broadcast(starts), "file").select("doc_id", "text", (F.col("start") + F.col("nth")).alias("place"))


def slots_of(window: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """(window, length, rank, sequence_id, offset) of every piece of a window, from rows (window, length, n)."""
    counts = dict(zip(window["length"].tolist(), window["n"].tolist()))
    columns = ["window", "length", "rank", "sequence_id", "offset"]
    found = [np.empty((0, len(columns)), np.int64)]
    base = int(window["window"].iloc[0])
    for length, table in segments(plan(counts, capacity)).items():
        rank = np.arange(counts[length])
        first, n, begin, offset = table[np.searchsorted(table[:, 0], rank, side="right") - 1].T
        parts = (np.full_like(rank, base), np.full_like(rank, length), rank, base * NUMBERS + begin + (rank - first) // n, offset + (rank - first) % n * length)
        found.append(np.column_stack(parts))
    return pd.DataFrame(np.concatenate(found), columns=columns)


def pack_in_order(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, window: int | None = None) -> DataFrame:
    """``pack`` within windows of so many documents of the order in which ``docs`` was written.

    Sequence numbers rise from window to window, and pieces of one length fill a window's
    sequences in the order of their documents. A window may end in a sequence that is not
    full. Rows that come from no files have no order and are packed together.
    """
    rows, size = in_written_order(docs), window or WINDOW
    if rows is None:
        return pack(docs, tokenizer, capacity, end_id)
    cuts = staged(pieces(rows, tokenizer, capacity, end_id, "place"), "pieces")
    cuts = cuts.withColumn("window", F.floor(F.col("place") / size))
    counts = cuts.groupBy("window", "length").agg(F.count("*").alias("n"))
    ship(docs.sparkSession)
    kinds = "window long, length long, rank long, sequence_id long, offset long"
    slots = counts.groupBy("window").applyInPandas(lambda found: slots_of(found, capacity), kinds)
    order = Window.partitionBy("window", "length").orderBy("place", "piece")
    # The slots have a row a piece but shuffle to very little, which Spark would take for a size to broadcast.
    placed = cuts.withColumn("rank", F.row_number().over(order) - 1).join(slots.hint("merge"), ["window", "length", "rank"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Packing of the whole table ``documents`` into sequences of at most 1,024 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_path())
