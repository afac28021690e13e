import random
import re
from collections import Counter, defaultdict

import pytest

from anchorage.llm import collocations
from anchorage.llm.trie import HatTrie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=100, longest=5, covered=100, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    candidates = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= least}
    inside = defaultdict(int)
    for (lang, words), n in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                inside[lang, words[i : i + size]] = max(inside[lang, words[i : i + size]], n)
    found = defaultdict(list)
    for (lang, words), a in candidates.items():
        if 100 * inside[lang, words] >= covered * a:
            continue
        n = totals[lang]
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * n // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(words).encode(), left, right, n))
    out = []
    for lang, rows_ in found.items():
        for rank, (score, a, phrase, left, right, n) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["Die", "ÄÖ", "été", "a\x1cb", " ", "und"]
    weights = [1 / (i + 1) for i in range(len(words))]
    fixed = ["new york city hall", "of the", "ad hoc", "New\tYork  city", "le petit été ÄÖ x"]
    out = []
    for _ in range(150):
        parts = []
        for _ in range(30):
            parts += draw.choices(words, weights, k=draw.randint(0, 9))
            parts.append(draw.choice(fixed))
            parts.append(draw.choice(["", ".", ",", "\n", "!?", "\r\n", " \x0b", "\t", ";x"]))
        out.append((draw.choice(["en", "en", "en", "fr", None, "und", ""]), " ".join(parts)))
    out += [("en", None), (None, None), ("de", ""), ("en", "  \t ... \n"), out[0], out[0]]
    out += [("xx", "again and again " * 4000)]
    return out


@pytest.mark.parametrize("covered, longest, top", [(100, 5, 2000), (60, 5, 7), (100, 2, 2000)])
def test_equals_brute_force(spark, rows, covered, longest, top):
    docs = spark.createDataFrame([(g, t, 1, "p", 9) for g, t in rows], "lang string, text string, n int, phrase string, words long")
    got = collocations.ranked(collocations.collocations(docs.repartition(5), 30, longest, covered), top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 30, longest, covered, top)


def test_runs_merge_to_the_same_counts(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "LIMIT", 50)
    monkeypatch.setattr(collocations, "MOST_WORDS", 30)
    monkeypatch.setattr(collocations, "CHUNK", 2_000)
    monkeypatch.setattr(collocations, "HELD_PAIRS", 500)
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations.ranked(collocations.collocations(docs, 30))
    assert sorted(map(tuple, got.collect())) == brute(rows, 30)


def test_hot_pair_and_products_beyond_64_bits(spark):
    rows = [("en", f"of the w{i % 700} x{i % 3}") for i in range(60_000)]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), 50)
    assert sorted(map(tuple, collocations.ranked(got).collect())) == brute(rows, 50)
    exact = spark.range(1).selectExpr("cast(9000000000000 as decimal(14,0)) as a")
    exact = exact.selectExpr("a * a * cast(1000 as decimal(4,0)) as over", "cast(a * a as decimal(29,0)) as under")
    assert exact.selectExpr("over div under as s").first()["s"] == 1000


def test_empty_tables(spark):
    for rows in ([], [("en", None)], [("en", "few words here")]):
        docs = spark.createDataFrame(rows, "lang string, text string")
        assert collocations.ranked(collocations.collocations(docs)).count() == 0


def test_trie_bursts_and_spills_whole_subtrees():
    draw = random.Random(1)
    trie, want, got, heads = HatTrie(burst=4), Counter(), Counter(), []
    for _ in range(3000):
        key = b"".join(draw.randint(0, 5).to_bytes(4, "little") for _ in range(draw.randint(2, 6)))
        trie.add([key], [2])
        want[key] += 2
        if trie.entries > 300:
            for subtree in trie.spill(150):
                heads.append({k[:8] for k, _ in subtree})
                got.update(dict(subtree))
            assert trie.entries <= 150
    for subtree in trie.spill(0):
        got.update(dict(subtree))
    assert got == want and trie.entries == 0 and all(len(h) == 1 for h in heads)


def test_query_equals_brute_force_and_sql(spark, duck, folder):
    got = sorted(map(tuple, collocations.op11_collocations(spark, folder).collect()))
    assert got == brute(duck.sql("SELECT lang, text FROM documents").fetchall())
    assert got == sorted(duck.sql(collocations.SQL).fetchall())
