"""Removal of byte strings that occur more than once, by interval expansion on a BWT.

Every window of ``length`` bytes is keyed by the smallest hash among its q-grams,
so equal windows share a key. Consecutive windows with one key form a segment.
Segments whose key occurs once hold no repeat and never travel; the others meet by
key. In blocks of bounded size the suffixes of their segments are sorted, and
backward extension on the Burrows-Wheeler transform, breadth first, sets the common
prefixes of neighbouring suffixes by increasing value. It stops at ``length``:
neighbours that are still unset share at least that many bytes.

A key with more text than a block holds is compared window by window instead:
128-bit window hashes are counted by Spark, with partial counts before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.llm.common import joined_to_unique, mapped, staged, table

LENGTH = 200
GRAM = 24
#: A segment has at most so many windows, and counts once for each UNIT bytes.
MOST_WINDOWS, UNIT = 4096, 400
#: Most units of one key that are sorted together; block size in bytes.
MOST_UNITS, BLOCK = 10_000, 2_000_000
BITS, PACKED = 9, 7
#: Twice the windows of a text that are hashed at a time; a power of two.
STRIDE = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_WORD = 1 << 64


def rolling(data: np.ndarray, size: int, factor: int = _ODD) -> np.ndarray:
    """Polynomial hash of every substring of ``size`` bytes, built from powers of two."""
    power, span, done, width = data.astype(np.uint64), 1, None, 0
    while True:
        if size & span:
            if done is None:
                done, width = power, span
            else:
                n = len(data) - width - span + 1
                done = done[:n] * np.uint64(pow(factor, span, _WORD)) + power[width : width + n]
                width += span
        if span * 2 > size:
            break
        n = len(power) - span
        power = power[:n] * np.uint64(pow(factor, span, _WORD)) + power[span:]
        span *= 2
    done = done ^ (done >> np.uint64(31))
    done = done * np.uint64(0xD6E8FEB86659FD93)
    return done ^ (done >> np.uint64(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[: len(values) - span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(key, first window, windows, places) of the runs of windows with one smallest
    q-gram hash. ``places`` counts where the run's windows have that q-gram first:
    two windows of one run can only be equal if there are several such places.
    """
    total = len(data) - length + 1
    if total <= 0:
        return (np.empty(0, np.int64),) * 4
    keys, places = np.empty(total, np.uint64), np.empty(total, np.int64)
    low = np.uint64(STRIDE - 1)
    for start in range(0, total, STRIDE // 2):
        hashes = rolling(data[start : start + STRIDE // 2 + length - 1], gram)
        tagged = hashes & ~low | np.arange(len(hashes), dtype=np.uint64)
        at = (sliding_least(tagged, length - gram + 1) & low).astype(np.int64)
        keys[start : start + STRIDE // 2] = hashes[at]
        places[start : start + STRIDE // 2] = start + at
    first = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
    count = np.diff(first, append=total)
    moved = np.concatenate([[0], np.cumsum(np.diff(places) != 0)])
    several = 1 + moved[first + count - 1] - moved[first]
    if count.max() > MOST_WINDOWS:
        pieces = -(-count // MOST_WINDOWS)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        count = np.minimum(np.repeat(count, pieces) - nth * MOST_WINDOWS, MOST_WINDOWS)
        first = np.repeat(first, pieces) + nth * MOST_WINDOWS
        several = np.repeat(several, pieces)
    return keys[first].view(np.int64), first, count, several


def sorted_suffixes(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffix order to at least ``depth`` symbols by doubling; also where groups of
    equal prefixes begin after the first doubling, and the length of those prefixes."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(PACKED, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(PACKED):
        key = key << BITS | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    known, groups, reached = PACKED, None, 0
    while known < depth:
        ends = np.append(starts[1:], True)
        slots = np.flatnonzero(~(starts & ends))
        if len(slots):
            own = order[slots]
            after = own + known
            next_rank = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            joint = rank[own] * (n + 1) + next_rank
            by = np.argsort(joint, kind="stable")
            joint = joint[by]
            order[slots] = own[by]
            fresh = np.concatenate([[True], joint[1:] != joint[:-1]])
            starts[slots] |= fresh
            rank[own[by]] = np.maximum.accumulate(np.where(fresh, slots, 0))
        known *= 2
        if groups is None:
            groups, reached = starts.copy(), known
    return order, groups, reached


def shared_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part, which of its windows of ``length`` bytes also start elsewhere in the parts."""
    sizes = np.array([len(p) for p in parts])
    n = int(sizes.sum()) + len(parts)
    symbols = np.zeros(n, np.uint16)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    inside = np.ones(n, bool)
    inside[begins + sizes] = False
    symbols[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 1
    valid = np.zeros(n + 1, np.int64)
    np.add.at(valid, begins, 1)
    np.add.at(valid, begins + np.maximum(sizes - length + 1, 0), -1)
    valid = np.cumsum(valid[:n]) > 0

    order, groups, reached = sorted_suffixes(symbols, length + 1)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    back = np.where(order > 0, place[order - 1], -1)
    before = np.where(order > 0, symbols[order - 1], 0).astype(np.int64)
    known = np.append(groups, True)
    low = np.flatnonzero(groups)
    high = np.append(low[1:], n)
    for _ in range(reached, length):
        size = high - low
        one = size == 1
        lone = back[low[one]]
        lows, highs = [lone[lone >= 0]], [lone[lone >= 0] + 1]
        if not one.all():
            left, size = low[~one], size[~one]
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) + np.repeat(left - (ends - size), size)
            key = np.repeat(np.arange(len(left)) << BITS, size) | before[at]
            moved = back[at]
            key, moved = key[moved >= 0], moved[moved >= 0]
            if len(key):
                by = np.argsort(key, kind="stable")
                key, moved = key[by], moved[by]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
                lows.append(np.minimum.reduceat(moved, cuts))
                highs.append(np.maximum.reduceat(moved, cuts) + 1)
        low, high = np.concatenate(lows), np.concatenate(highs)
        new = ~known[high]
        low, high = low[new], high[new]
        known[high] = True
        if not len(low):
            break
    equal = np.flatnonzero(~known[1:n]) + 1
    equal = equal[valid[order[equal]] & valid[order[equal - 1]]]
    shared = np.zeros(n, bool)
    shared[order[equal]] = True
    shared[order[equal - 1]] = True
    return [shared[b : b + max(s - length + 1, 0)] for b, s in zip(begins, sizes)]


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with its text never null and the two 64-bit hashes that tell texts apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"text": text, "c1": F.xxhash64(text), "c2": F.xxhash64(F.lit("second"), text)})


def segment_keys(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, c1, c2, keys) per row; a long segment names its key once per unit of text,
    and one that may repeat itself at least twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(3):
                key, _, count, several = segments(np.frombuffer(text.as_py().encode("utf-8", "replace"), np.uint8), length)
                units = np.maximum(-(-(count + length - 1) // UNIT), np.minimum(several, 2))
                found.append(np.repeat(key, units))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in found])]).astype(np.int32)
            flat = pa.array(np.concatenate([*found, np.empty(0, np.int64)]), pa.int64())
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(pa.array(offsets), flat)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "c1", "c2", "keys"])

    columns = keyed(docs).select("doc_id", "c1", "c2", "text")
    return mapped(columns, run, "doc_id long, c1 long, c2 long, keys array<long>")


def candidates(rows: DataFrame) -> DataFrame:
    """(c1, c2, keys, hot): per distinct text its keys that occur more than once, and
    whether each has more text than one block holds."""
    texts = rows.groupBy("c1", "c2").agg(F.first("keys").alias("keys"))
    keys = texts.select("c1", "c2", F.explode("keys").alias("key"))
    often = keys.groupBy("key").agg(F.count("*").alias("units")).filter("units > 1")
    held = keys.join(often, "key").select("c1", "c2", "key", (F.col("units") > MOST_UNITS).alias("hot"))
    listed = F.sort_array(F.collect_set(F.struct("key", "hot")))
    return held.groupBy("c1", "c2").agg(listed.alias("l")).select("c1", "c2", F.col("l.key").alias("keys"), F.col("l.hot").alias("hot"))


SEGMENT = "key long, c1 long, c2 long, first long, body binary, hot boolean"


def repeated_segments(texts: DataFrame, length: int) -> DataFrame:
    """Segments of ``texts`` (c1, c2, text, keys, hot, copies) whose key is a candidate; the
    body is the segment's text, or its window hashes where the key is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for c1, c2, text, keys, hot in zip(*(batch.column(k) for k in range(5))):
                body = text.as_py().encode("utf-8", "replace")
                data = np.frombuffer(body, np.uint8)
                key, first, count, _ = segments(data, length)
                wanted = keys.values.to_numpy(zero_copy_only=False)
                at = np.searchsorted(wanted, key)
                hit = (at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == key)
                is_hot = hot.values.to_numpy(zero_copy_only=False)[np.minimum(at, len(wanted) - 1)]
                for k in np.flatnonzero(hit):
                    a, b = int(first[k]), int(first[k] + count[k] + length - 1)
                    part = body[a:b]
                    if is_hot[k]:
                        whole = data[a:b]
                        both = [rolling(whole, length), rolling(whole, length, 0xC2B2AE3D27D4EB4F)]
                        part = np.stack(both, axis=1).astype("<u8").tobytes()
                    row = (int(key[k]), c1.as_py(), c2.as_py(), a, part, bool(is_hot[k]))
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            names = ["key", "c1", "c2", "first", "body", "hot"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=names)

    # With the same columns as the last step reads, one shuffle of the texts serves both.
    return mapped(texts.select("c1", "c2", "text", "keys", "hot", "copies"), run, SEGMENT)


RUNS = "c1 long, c2 long, a long, b long"


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def block_runs(keys: np.ndarray, ids: list[tuple[int, int, int]], parts: list[bytes], length: int) -> list[tuple]:
    """Repeated byte ranges (c1, c2, a, b) of the segments of whole keys.

    Equal segments of one key count as one, all of whose windows repeat.
    """
    seen: dict[tuple[int, bytes], int] = {}
    which = [seen.setdefault((int(k), p), len(seen)) for k, p in zip(keys, parts)]
    times = np.bincount(which, minlength=len(seen))
    shared = shared_windows([p for _, p in seen], length)
    out = []
    for (c1, c2, first), w in zip(ids, which):
        flags = shared[w]
        starts, ends = ([0], [len(flags)]) if times[w] > 1 else runs_of(flags)
        out.extend((c1, c2, first + int(a), first + int(b) + length - 1) for a, b in zip(starts, ends))
    return out


def cold_runs(segs: DataFrame, length: int) -> DataFrame:
    """Repeated ranges of segments that meet by key, in blocks of whole keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(keys, ids, parts):
            rows = block_runs(np.array(keys), ids, parts, length)
            columns = list(zip(*rows)) or [[]] * 4
            arrays = [pa.array(c, pa.int64()) for c in columns]
            return pa.RecordBatch.from_arrays(arrays, names=["c1", "c2", "a", "b"])

        keys, ids, parts, size = [], [], [], 0
        for batch in batches:
            for key, c1, c2, first, body in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if size >= BLOCK and key != keys[-1]:
                    yield solved(keys, ids, parts)
                    keys, ids, parts, size = [], [], [], 0
                keys.append(key)
                ids.append((c1, c2, first))
                parts.append(body)
                size += len(body)
        if keys:
            yield solved(keys, ids, parts)

    met = segs.filter("not hot").select("key", "c1", "c2", "first", "body")
    return mapped(met.repartition("key").sortWithinPartitions("key"), run, RUNS)


def hot_runs(segs: DataFrame, length: int) -> DataFrame:
    """Repeated ranges of hot keys' segments, from counts of their window hashes.

    A hash that very many windows share is not brought to one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c1, c2, first, body in zip(*(batch.column(k).to_pylist() for k in range(4))):
                both = np.frombuffer(body, "<u8").reshape(-1, 2).view("<i8")
                n = len(both)
                arrays = [np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])]
                arrays += [np.full(n, c1), np.full(n, c2), first + np.arange(n)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], names=["w1", "w2", "c1", "c2", "a"])

    hot = segs.filter("hot").select("c1", "c2", "first", "body")
    windows = mapped(hot, run, "w1 long, w2 long, c1 long, c2 long, a long")
    often = windows.groupBy("w1", "w2").agg(F.count("*").alias("rows")).filter("rows > 1")
    met = joined_to_unique(windows, staged(often, "window-hashes"), ["w1", "w2"])
    return met.select("c1", "c2", "a", (F.col("a") + length).alias("b"))


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of ranges as maximal runs; ranges that touch are one run."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(starts[1:] > ends[:-1])
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), ends[np.append(cut, len(ends) - 1)].tolist()))


def repeat_free(docs: DataFrame, length: int, with_text: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, c1, c2, keys) per row, and per distinct text its c1, c2, counts, spans and what is left."""
    rows = staged(segment_keys(docs, length), "segment-keys")
    wanted = staged(candidates(rows), "candidates")
    texts = keyed(docs).groupBy("c1", "c2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    segs = repeated_segments(texts.join(wanted, ["c1", "c2"]), length)
    if wanted.filter(F.array_contains("hot", True)).isEmpty():
        ranges = cold_runs(segs, length)
    else:
        segs = staged(segs, "segments")
        ranges = cold_runs(segs, length).union(hot_runs(segs, length))
    ranges = ranges.groupBy("c1", "c2").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for c1, c2, text, copies, a, b in zip(*(batch.column(k) for k in range(6))):
                body = text.as_py().encode("utf-8", "replace")
                if copies.as_py() > 1 and len(body) >= length:
                    gone = [(0, len(body))]
                elif a.is_valid:
                    gone = merged(a.values.to_numpy(), b.values.to_numpy())
                else:
                    gone = []
                edges = [0, *(e for s in gone for e in s), len(body)]
                left = b"".join(body[x:y] for x, y in zip(edges[::2], edges[1::2]))
                spans = [{"start": s, "end": e} for s, e in gone]
                row = (c1.as_py(), c2.as_py(), len(body), len(body) - len(left), len(gone), hashlib.sha256(left).hexdigest(), spans)
                for column, value in zip(out, (*row, left.decode("utf-8", "ignore") if with_text else None)):
                    column.append(value)
            kinds = (*[pa.int64()] * 5, pa.string(), span, pa.string())
            names = ["c1", "c2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=names)

    schema = "c1 long, c2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, text string"
    found = mapped(texts.join(ranges, ["c1", "c2"], "left").select("c1", "c2", "text", "copies", "a", "b"), run, schema)
    return rows, found


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 and spans.

    Every byte covered by a string of ``length`` bytes that also starts elsewhere in
    the table is removed. A null text is empty; repeated rows and equal texts are
    copies of each other, so all their bytes go if they are long enough. A null
    doc_id stays null. Other columns are ignored; an empty table gives no rows.
    """
    rows, found = repeat_free(docs, length, with_text=False)
    return rows.select("doc_id", "c1", "c2").join(found.drop("text"), ["c1", "c2"]).drop("c1", "c2")


def cut_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with every text cut as by ``without_repeats``, less characters that a cut
    broke; ``n_chars`` follows the text if there is such a column. Null texts become empty."""
    _, found = repeat_free(docs, length, with_text=True)
    left = found.select("c1", "c2", F.col("text").alias("left"))
    row = F.col("row").withField("text", F.col("left"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("left").cast(docs.schema["n_chars"].dataType))
    whole = keyed(docs.select(F.struct("*").alias("row"), "text")).withColumn("row", F.col("row").withField("text", F.lit(None).cast("string")))
    return whole.select("row", "c1", "c2").join(left, ["c1", "c2"]).select(row.alias("row")).select("row.*")




def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every text of the whole table ``documents`` without its repeated strings."""
    return without_repeats(table(spark, sf_dir, "documents")).drop("spans")
