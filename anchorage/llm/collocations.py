"""Phrase collocations: contiguous word sequences that occur more often than their parts explain.

Tasks count phrases in burstable tries (``trie``) and spill whole subtrees as runs sorted
by phrase; Spark merges the runs by prefix partition. A phrase can only be frequent where
all its pairs are. Pairs are therefore counted by their hashes first, and the tries follow
the text along pairs whose hash is frequent. These hashes reach the tasks as one bit each,
in at most ``MOST_BITS`` bits however many they are: a full filter lets more phrases be
counted and loses none.

A prefix partition holds the phrases with the same first two words. At most ``HEAVY`` pairs
that hold a large part of all words are split by the whole phrase instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorage.llm.common import discard, joined_to_unique, mapped, staged, table
from anchorage.llm.trie import LIMIT, STEP, HatTrie

LONGEST = 5
LEAST = 100
COVERED = 100
TOP = 2_000
HEAVY = 1_024
BITS_EACH = 16
MOST_BITS = 1 << 27
#: Text that is numbered at once, and words that a task numbers before it starts anew.
CHUNK = 4 << 20
MOST_WORDS = 400_000
#: Pairs whose hashes a task holds before it counts them.
HELD_PAIRS = 3_000_000
RUN_ROWS = 20_000
UNKNOWN = "und"

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TIDY = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _SEPARATORS + b"\t",
    b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(_SEPARATORS) + b" ",
)
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
RUN = "lang string, phrase string, words int, n long, prefix long"


def sequence_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a language and the words that follow it from their 64-bit hashes."""
    mixed = np.zeros(len(parts[0]), np.uint64)
    for k, part in enumerate(parts):
        mixed = (mixed ^ part) * _FACTORS[k % len(_FACTORS)]
        mixed ^= mixed >> np.uint64(31)
    return mixed


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Numbers(dict):
    """Numbers of words in the order in which they come; 0 is no word and 1 ends a piece."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})
        self.words = [b"", b"\n"]

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        return number


class Filter:
    """One bit per hash of a frequent pair."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = np.uint64(64 * len(bits) - 1)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return hashes & self.mask

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        slot = self.slots(hashes)
        return (self.bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def numbered(texts: list[bytes], numbers: Numbers) -> np.ndarray:
    """Numbers of the words of tidied texts, with a 1 at the end of every piece."""
    data = (b"\n".join(texts) + b"\n").replace(b"\n", b" \n ")
    found = np.array(list(map(numbers.__getitem__, data.split(b" "))), dtype=np.int64)
    return found[found > 0]


def reach(stops: np.ndarray) -> np.ndarray:
    """How many places lie from each one to the next stop, a stop itself having none; the last place is a stop."""
    ends = np.flatnonzero(stops)
    places = np.arange(len(stops))
    return ends[np.searchsorted(ends, places)] - places


def distinct(ids: np.ndarray, span: np.ndarray, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, first places, counts) of the distinct sequences of ``low`` to ``high`` words that fit into ``span``."""
    if low == 1:
        at = np.flatnonzero(span)
        _, first, counts = np.unique(ids[at], return_index=True, return_counts=True)
        yield 1, at[first], counts
    code = ids
    for words in range(2, high + 1):
        at = np.flatnonzero(span >= words)
        _, first, inverse, counts = np.unique((code[at] << 32) | ids[at + words - 1], return_index=True, return_inverse=True, return_counts=True)
        if words >= low:
            yield words, at[first], counts
        # Sequences are numbered anew, so that the next word fits into the same 64 bits.
        code = np.zeros(len(ids), np.int64)
        code[at] = inverse


class Reader:
    """Numbers the words of texts by language, in chunks of bounded size, and knows their hashes."""

    def __init__(self):
        self.numbers = Numbers()
        self._hashes = np.zeros(0, np.uint64)

    def hashes(self) -> np.ndarray:
        new = [word_hash(w) for w in self.numbers.words[len(self._hashes) :]]
        self._hashes = np.concatenate([self._hashes, np.array(new, dtype=np.uint64)])
        return self._hashes

    def chunks(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the language, numbers of the words with a 1 at the end of every piece)."""
        held: dict[str, tuple[list[bytes], int]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            tidy = (text.as_py() or "").encode("utf-8", "replace").translate(_TIDY)
            texts, size = held.get(lang, ([], 0))
            texts.append(tidy)
            held[lang] = texts, size + len(tidy)
            if held[lang][1] >= CHUNK:
                yield self._numbered(lang, held.pop(lang)[0])
        for lang, (texts, _) in held.items():
            yield self._numbered(lang, texts)

    def _numbered(self, lang: str, texts: list[bytes]) -> tuple[int, np.ndarray]:
        return self.numbers[b"\n" + lang.encode("utf-8", "replace")], numbered(texts, self.numbers)

    def pairs(self, lang: int, ids: np.ndarray) -> np.ndarray:
        """Hash of the pair that starts at each place but the last; it counts only where both are words."""
        known = self.hashes()
        words = known[ids]
        return sequence_hash([np.full(len(ids) - 1, known[lang]), words[:-1], words[1:]])


def tagged(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")


def pair_hashes(docs: DataFrame) -> DataFrame:
    """(hash, n): partial counts of the pairs in ``docs`` (lang, text), by hash only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        held: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            hashes, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

        for batch in batches:
            for lang, ids in reader.chunks(batch):
                word = ids != 1
                held.append(reader.pairs(lang, ids)[word[:-1] & word[1:]])
                if sum(map(len, held)) >= HELD_PAIRS:
                    yield told()
            if len(reader.numbers.words) > MOST_WORDS:
                reader = Reader()
        if held:
            yield told()

    return mapped(tagged(docs), run, "hash long, n long")


def runs(docs: DataFrame, low: int, high: int, known: Filter | None = None, heavy: np.ndarray | None = None) -> DataFrame:
    """``RUN`` rows of partial counts of the phrases of ``low`` to ``high`` words in ``docs`` (lang, text).

    ``known`` holds the pairs along which phrases are followed, ``heavy`` the hashes of those
    that are split by the whole phrase. Words also give rows with words 0, the number of all words.
    """
    shared = docs.sparkSession.sparkContext.broadcast((known.bits if known else None, heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, split = shared.value
        wanted = Filter(bits) if bits is not None else None
        reader, trie = Reader(), HatTrie()

        def count(lang: int, ids: np.ndarray) -> None:
            stops = ids == 1
            span = reach(stops)
            if low == 1:
                trie.add([int(lang).to_bytes(STEP, "little") + b"\0" * STEP], [int((~stops).sum())])
            if wanted:
                pair = span > 1
                pair[:-1] &= wanted.holds(reader.pairs(lang, ids))
                # As many words as such pairs in a row, and one.
                span = np.where(pair, reach(~pair) + 1, 0)
            for words, first, counts in distinct(ids, span, low, high):
                rows = np.empty((len(first), words + 1), "<u4")
                rows[:, 0] = lang
                for k in range(words):
                    rows[:, k + 1] = ids[first + k]
                data, size = rows.tobytes(), STEP * (words + 1)
                trie.add((data[i : i + size] for i in range(0, len(data), size)), counts.tolist())

        def told(rows: list[tuple[bytes, int]], names: pa.Array) -> Iterator[pa.RecordBatch]:
            """Runs of whole subtrees, sorted by phrase, one for each length."""
            known_, words_ = reader.hashes(), reader.numbers.words
            for size in {len(key) for key, _ in rows}:
                own = [r for r in rows if len(r[0]) == size]
                ids = np.frombuffer(b"".join([key for key, _ in own]), "<u4").reshape(len(own), -1).T.astype(np.int64)
                langs, which = np.unique(ids[0], return_inverse=True)
                lang = pa.array([words_[i][1:].decode() for i in langs], pa.string()).take(pa.array(which))
                parts = [names.take(pa.array(i)) for i in ids[1:]]
                phrase = pc.binary_join_element_wise(*parts, b" ").cast(pa.string())
                start = sequence_hash([known_[i] for i in ids[:3]])
                if len(ids) > 3 and split is not None and len(split):
                    start = np.where(np.isin(start, split), sequence_hash([known_[i] for i in ids]), start)
                words = np.where(ids[1] == 0, 0, len(ids) - 1).astype(np.int32)
                columns = [lang, phrase, pa.array(words), pa.array([n for _, n in own], pa.int64()), pa.array(start.view(np.int64))]
                batch = pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "words", "n", "prefix"])
                yield batch.sort_by([("lang", "ascending"), ("phrase", "ascending")])

        def sent(left: int) -> Iterator[pa.RecordBatch]:
            names = pa.array(reader.numbers.words, pa.binary())
            rows: list[tuple[bytes, int]] = []
            for subtree in trie.spill(left):
                rows += subtree
                if len(rows) >= RUN_ROWS:
                    yield from told(rows, names)
                    rows = []
            if rows:
                yield from told(rows, names)

        for batch in batches:
            for lang, ids in reader.chunks(batch):
                count(lang, ids)
                if trie.entries > LIMIT:
                    yield from sent(LIMIT // 2)
            if len(reader.numbers.words) > MOST_WORDS:
                yield from sent(0)
                reader = Reader()
        yield from sent(0)

    return mapped(tagged(docs), run, RUN)


def merged(found: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, n) of the phrases that all runs together hold often enough, and the word totals."""
    whole = found.repartition("prefix").groupBy("prefix", "lang", "phrase").agg(F.max("words").alias("words"), F.sum("n").alias("n"))
    return whole.filter((F.col("words") == 0) | (F.col("n") >= least)).drop("prefix")


def frequent_pairs(hashes: DataFrame) -> Filter:
    """The filter of all pair ``hashes`` (hash)."""
    size = 1 << 16
    wanted = hashes.count() * BITS_EACH
    while size < min(wanted, MOST_BITS):
        size *= 2
    slot = F.col("hash").bitwiseAND(F.lit(size - 1))
    bit = F.expr("shiftleft(1L, cast(hash & 63 as int))")
    # At most MOST_BITS / 64 rows.
    rows = hashes.groupBy(F.shiftright(slot, 6).alias("place")).agg(F.bit_or(bit).alias("bits")).toPandas()
    bits = np.zeros(size // 64, np.int64)
    bits[rows["place"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return Filter(bits.view(np.uint64))


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> list[DataFrame]:
    """Written tables (lang, phrase, words, n): words, and phrases of two to ``longest`` words, that occur
    ``least`` times in their language. Rows with words 0 tell how many words each language has."""
    found = [staged(merged(runs(docs, 1, 1), least), "words")]
    if longest > 1 and not found[0].filter("words = 1").isEmpty():
        pairs = pair_hashes(docs).groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        pairs = staged(pairs, "pair-hashes")
        all_words = found[0].filter("words = 0").agg(F.sum("n")).first()[0]
        # Fewer than HEAVY hashes, as there are fewer pairs than words.
        heavy = [r["hash"] for r in pairs.filter(F.col("n") > all_words / HEAVY).collect()]
        heavy = np.array(heavy, dtype=np.int64).view(np.uint64)
        found.append(staged(merged(runs(docs, 2, longest, frequent_pairs(pairs), heavy), least), "phrases"))
        discard(pairs)
    return found


def looked_up(rows: DataFrame, counts: DataFrame, on: list[str]) -> DataFrame:
    """``rows``, a written table, with the columns that ``counts`` has for its keys ``on``; ``rows`` is deleted."""
    uses = rows.groupBy(*on).agg(F.count("*").alias("rows"))
    found = staged(counts.join(uses, on), "lookup")
    out = staged(joined_to_unique(rows, found, on), "looked-up")
    discard(rows, found)
    return out


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate that no longer one covers.

    ``docs`` holds (lang, text): texts in lower case (A-Z) are split at ``.,;:!?`` and line
    ends into pieces, and these at spaces and tabs into words. A candidate is a phrase of 2
    to ``longest`` words that occurs a >= ``least`` times in its language; of all its cuts the
    one with the smallest floor(1000 * a * n / (l * r)) counts, the first one on a tie. A
    candidate inside a longer one that occurs at least ``covered`` percent as often goes.

    A null text is empty, a null language is ``und``; repeated rows count each; other columns
    are ignored; an empty table gives no rows.
    """
    tables = phrase_counts(docs, least, longest)
    every = reduce(DataFrame.unionByName, tables)
    counts = every.filter("words > 0")
    found = counts.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    # What lies in a longer candidate lies in one that is a word longer and occurs as often at least.
    inner = F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)")))
    longer = found.filter("words > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("outer_a"))
    kept = found.join(longer, ["lang", "phrase"], "left").filter(
        F.col("outer_a").isNull() | (100 * F.col("outer_a") < covered * F.col("a"))
    )
    cut = kept.select("lang", "phrase", "words", "a", F.explode(F.expr("sequence(1, words - 1)")).alias("k")).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.expr("substring_index(phrase, ' ', k)").alias("head"),
        F.expr("substring_index(phrase, ' ', k - words)").alias("rest"),
    )
    told = staged(cut, "cuts")
    for part, name in (("head", "l"), ("rest", "r")):
        told = looked_up(told, counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    told = looked_up(told, every.filter("words = 0").select("lang", "n"), ["lang"])
    discard(*tables)
    exact = lambda name: F.col(name).cast("decimal(14,0)")
    told = told.withColumn("_over", exact("a") * exact("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("_under", exact("l") * exact("r"))
    told = told.withColumn("score", F.expr("_over div _under"))
    best = told.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    return best.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` collocations of every language: score and a descending, then by the bytes of the phrase."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language in the whole table ``documents``."""
    return ranked(collocations(table(spark, sf_dir, "documents")))


SQL = f"""
WITH p AS (SELECT lang, row_number() OVER () AS id, piece FROM (
             SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p),
g AS (SELECT lang, size, words[i : i + size - 1] AS part
      FROM (SELECT lang, words, size, unnest(generate_series(1, len(words) - size + 1)) AS i
            FROM w, (SELECT unnest(range(1, {LONGEST + 1})) AS size) WHERE len(words) >= size)),
f AS MATERIALIZED (SELECT lang, array_to_string(part, ' ') AS phrase, any_value(part) AS part, any_value(size) AS size,
                          count(*)::HUGEINT AS f FROM g GROUP BY lang, array_to_string(part, ' ')),
n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE size > 1 AND f >= {LEAST}),
o AS (SELECT lang, array_to_string(part[i : i + s - 1], ' ') AS phrase, max(f) AS f
      FROM (SELECT *, unnest(generate_series(1, size - s + 1)) AS i
            FROM (SELECT *, unnest(generate_series(2, size - 1)) AS s FROM c WHERE size > 2)) GROUP BY ALL),
k AS (SELECT c.* FROM c LEFT JOIN o USING (lang, phrase) WHERE o.f IS NULL OR 100 * o.f < {COVERED} * c.f),
x AS (SELECT k.lang, k.phrase, k.k, k.f AS a, l.f AS l, r.f AS r, n.n, (1000 * k.f * n.n) // (l.f * r.f) AS score
      FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM k) k JOIN n USING (lang)
      JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.part[1 : k.k], ' ')
      JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.part[k.k + 1 :], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l,
       r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM b QUALIFY rank <= {TOP}
"""
