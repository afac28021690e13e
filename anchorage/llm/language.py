"""Language of mixed texts: script candidates, then Viterbi over per-word scores.

Word scores are log-probabilities of hashed character n-grams per language,
relative to the mean over the languages that use the word's script. A path over
the words of a document pays a penalty for every change of language, so short
foreign words do not break a span. The document's language covers most letters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.llm.common import mapped, table

#: Most labelled rows that the model is counted on.
SAMPLE = 24_000
ORDERS = (1, 2, 3, 4)
BITS = 16
BUCKETS = 1 << BITS
SMOOTHING = 0.5
SWITCH = 6.0
WORD_BOUND = 4.0
SCRIPT_SHARE = 0.01
BARRED = -1e4
MEMO_WORDS = 300_000
CHUNK_WORDS = 200_000
FOLDS, HELD = 4, 2
UNKNOWN = "und"

# First code points of the blocks, and the script that starts there.
SCRIPT_STARTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0x10000, "Other"), (0x20000, "Han"),
)
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})
_STARTS = np.array([s for s, _ in SCRIPT_STARTS])
_SCRIPT_OF = np.array([SCRIPTS.index(s) for _, s in SCRIPT_STARTS])


def scripts_of(codes: np.ndarray) -> np.ndarray:
    """Index into SCRIPTS of each code point."""
    return _SCRIPT_OF[np.searchsorted(_STARTS, codes, side="right") - 1]


def letters_of(unit: str) -> str:
    """The letters of a white-space-delimited unit, in lower case; numerals such as ``½`` are none."""
    return unit.lower() if unit.isalpha() else "".join(filter(str.isalpha, unit)).lower()


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every n-gram of the marked words, for all words at once."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    buckets, owners = [], []
    for n in ORDERS:
        at = np.flatnonzero(left >= n)
        mixed = np.full(len(at), n, np.uint64)
        for k in range(n):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[at + k]
        buckets.append(((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(owner[at])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """langs: learned values. logp: languages x buckets. uses: scripts x languages that use them."""

    langs: list[str]
    logp: np.ndarray
    uses: np.ndarray

    def words(self, words: list[str]) -> np.ndarray:
        """Score of every word and language: relative to the best candidate of the word's
        script, bounded, and barred outside the candidates. Words of a script that no
        language uses favour none."""
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        bucket, owner = grams(words)
        found = np.stack([np.bincount(owner, weights=p[bucket], minlength=len(words)) for p in self.logp], axis=1)
        allowed = self.uses[scripts_of(np.array([ord(w[0]) for w in words]))]
        best = np.where(allowed, found, -np.inf).max(axis=1, keepdims=True)
        found = np.clip(found - best + WORD_BOUND, -WORD_BOUND, WORD_BOUND)
        found = np.where(allowed, found, BARRED)
        return np.where(allowed.any(axis=1, keepdims=True), found, 0).astype(np.float32)


def fold(folds: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Count n-grams and scripts per language on about ``sample`` hash-chosen labelled
    rows outside the held-out fold. Null languages, ids and texts are left out."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(FOLDS) != HELD))
    total = rows.select("doc_id").count()
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1.0, sample / max(total, 1)) * (1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                own = totals.setdefault(lang.as_py(), np.zeros(BUCKETS + len(SCRIPTS)))
                times = Counter(w for w in map(letters_of, text.as_py().split()) if w)
                if not times:
                    continue
                words, n = list(times), np.array(list(times.values()))
                bucket, owner = grams(words)
                own[:BUCKETS] += np.bincount(bucket, weights=n[owner], minlength=BUCKETS)
                scripts = scripts_of(np.array([ord(w[0]) for w in words]))
                letters = n * np.array([len(w) for w in words])
                own[BUCKETS:] += np.bincount(scripts, weights=letters, minlength=len(SCRIPTS))
        for lang, own in totals.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at])],
                names=["lang", "bucket", "n"],
            )

    counted = (
        mapped(rows.filter(drawn).select("lang", "text"), count, "lang string, bucket long, n double")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    langs = sorted(counted["lang"].unique())
    table_ = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    table_[np.searchsorted(langs, counted["lang"].to_numpy(str)) if langs else [], counted["bucket"].to_numpy(int)] = counted["n"]
    seen = table_[:, :BUCKETS] + SMOOTHING
    logp = np.log(seen / seen.sum(axis=1, keepdims=True)).astype(np.float32)
    letters = table_[:, BUCKETS:]
    share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
    return Model(langs, logp, share.T >= SCRIPT_SHARE)


def paths(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best language of every word of several documents that follow each other.

    All documents advance together, longest first, so a step costs one array
    operation for as many documents as still have words.
    """
    if not len(scores):
        return np.empty(0, np.int64)
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    live = np.searchsorted(-size, -np.arange(size[0]), side="left") if len(size) else np.empty(0)
    kept = np.zeros(scores.shape, bool)
    came = np.zeros(len(scores), np.int64)
    best = np.zeros((len(order), scores.shape[1]), np.float32)
    for t in range(size[0]):
        n = live[t]
        at = first[:n] + t
        now = best[:n]
        top = now.argmax(axis=1)
        moved = now[np.arange(n), top] - switch
        came[at] = top
        kept[at] = now >= moved[:, None]
        best[:n] = np.maximum(now, moved[:, None]) + scores[at]
        best[:n] -= best[:n].max(axis=1, keepdims=True)
    state = best.argmax(axis=1)
    out = np.zeros(len(scores), np.int64)
    for t in range(size[0] - 1, -1, -1):
        n = live[t]
        at = first[:n] + t
        out[at] = state[:n]
        state[:n] = np.where(kept[at, state[:n]], state[:n], came[at])
    return out


class Labeller:
    """Spans and language of texts, with a bounded memo of word scores."""

    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch = model, switch
        self._clear()

    def _clear(self) -> None:
        self._memo: dict[str, int] = {}
        self._scores = np.zeros((0, len(self.model.langs)), np.float32)
        self._sizes = np.zeros(0, np.int64)

    def _learn(self, units: list[str]) -> None:
        letters = [letters_of(u) for u in units]
        sizes = np.array([len(w) for w in letters])
        scores = np.zeros((len(units), len(self.model.langs)), np.float32)
        scores[sizes > 0] = self.model.words([w for w in letters if w])
        self._memo.update(zip(units, range(len(self._memo), len(self._memo) + len(units))))
        self._scores = np.concatenate([self._scores, scores])
        self._sizes = np.concatenate([self._sizes, sizes])

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
        """(language, share of letters, spans of (language, first word, words)) per text."""
        if not self.model.langs:
            return [(UNKNOWN, 0.0, [])] * len(texts)
        out: list = [None] * len(texts)
        held: list[tuple[int, list[str]]] = []
        n = 0
        for i in sorted(range(len(texts)), key=lambda i: len(texts[i] or "")):
            held.append((i, (texts[i] or "").split()))
            n += len(held[-1][1])
            if n >= CHUNK_WORDS:
                self._chunk(held, out)
                held, n = [], 0
        self._chunk(held, out)
        return out

    def _chunk(self, held: list[tuple[int, list[str]]], out: list) -> None:
        new = set().union(*(units for _, units in held)).difference(self._memo)
        if len(self._memo) + len(new) > MEMO_WORDS:
            self._clear()
            new = set().union(*(units for _, units in held))
        self._learn(sorted(new))
        memo = self._memo
        rows = [np.array([memo[u] for u in units], dtype=np.int64) for _, units in held]
        rows = [r[self._sizes[r] > 0] for r in rows]
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        flat = np.concatenate([*rows, np.empty(0, np.int64)])
        found = paths(self._scores[flat], lengths, self.switch)
        sizes = self._sizes[flat]
        for (i, _), a, b in zip(held, np.cumsum(lengths) - lengths, np.cumsum(lengths)):
            out[i] = self._told(found[a:b], sizes[a:b])

    def _told(self, path: np.ndarray, sizes: np.ndarray) -> tuple[str, float, list[tuple[str, int, int]]]:
        if not len(path):
            return UNKNOWN, 0.0, []
        langs = self.model.langs
        letters = np.bincount(path, weights=sizes, minlength=len(langs))
        top = int(letters.argmax())
        cuts = np.flatnonzero(np.diff(path, prepend=-1))
        ends = np.append(cuts[1:], len(path))
        spans = [(langs[path[a]], int(a), int(b - a)) for a, b in zip(cuts, ends)]
        return langs[top], float(letters[top] / letters.sum()), spans


SPANS = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<lang:string,first:int,words:int>>"


def label(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with its language and labelled spans.

    A text that is null or has no letter is ``und`` with score 0 and no spans, as is
    every text when nothing was learned. Words in a script that no learned language
    uses favour none. A null doc_id is not held out, repeated rows give equal rows,
    other columns are ignored, and an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, switch)
        kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))
        for batch in batches:
            told = labeller.label(batch.column(2).to_pylist())
            spans = [[dict(zip(("lang", "first", "words"), s)) for s in t[2]] for t in told]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([t[0] for t in told], pa.string()),
                pa.array([t[1] for t in told], pa.float64()),
                pa.array(spans, kind),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    held = F.coalesce(fold(FOLDS) == HELD, F.lit(False)).alias("held_out")
    return mapped(docs.select("doc_id", held, "text"), run, SPANS)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every text of the whole table ``documents``, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return label(docs, train(docs)).drop("spans")
