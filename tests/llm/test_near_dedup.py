import random

import numpy as np
import pytest

from anchorage.llm import near_dedup
from anchorage.llm.components import components
from anchorage.llm.near_dedup import shingles, words_of


def brute(rows):
    """component of every id by comparing all pairs of full sets."""
    sets = {}
    for doc, text in rows:
        if doc is not None:
            sets.setdefault(doc, set(shingles(words_of(text)).tolist()))
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in sets}


def family(draw, base, n, most):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randint(0, most)):
            words[draw.randrange(len(words))] = f"edit{draw.randint(0, 10**6)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(4)
    word = lambda: "w" + str(draw.randint(0, 400))
    texts = family(draw, [word() for _ in range(140)], 60, 9)
    texts += family(draw, [word() for _ in range(30)], 25, 2)
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(draw.randint(5, 120))) for _ in range(50)]
    texts += ["one two", "One TWO", "one two three", "", None, "   \n", texts[0], texts[0].upper()]
    draw.shuffle(texts)
    return list(enumerate(texts))


def test_shingles():
    assert len(shingles(words_of("a b c"))) == 1
    assert len(shingles(words_of("a b c d e f"))) == 2
    assert len(shingles(words_of("a a a a a a a"))) == 1
    assert len(shingles(words_of(None))) == 0
    assert words_of("A\x0bÉ\x85x b") == ["a".encode(), "É\x85x".encode(), b"b"]


@pytest.mark.parametrize("short, few, many", [(32, 256, 1024), (3, 7, 11)])
def test_groups_equal_brute_force(spark, corpus, monkeypatch, short, few, many):
    monkeypatch.setattr(near_dedup, "SHORT_LIST", short)
    monkeypatch.setattr(near_dedup, "BLOCK_FEW", few)
    monkeypatch.setattr(near_dedup, "BLOCK_MANY", many)
    docs = spark.createDataFrame([(d, t, "z") for d, t in corpus], "doc_id long, text string, hashes string")
    want = brute(corpus)
    got = near_dedup.near_groups(docs).collect()
    assert len(got) == len(corpus)
    for row in got:
        assert row["component_id"] == want[row["doc_id"]], row
        assert row["kept"] == (row["doc_id"] == row["component_id"])
        assert row["n_shingles"] == len(shingles(words_of(corpus[row["doc_id"]][1])))


def test_blocks_equal_sets():
    draw = random.Random(5)
    rows = [np.array(sorted(draw.sample(range(40), draw.randint(1, 30)))) for _ in range(30)]
    few, many = rows[:10], rows[10:]
    apart = np.ones((10, 20), bool)
    apart[0] = False
    got = {tuple(x) for x in near_dedup.linked_blocks(few, many, apart).tolist()}
    want = {
        (i, j)
        for i, a in enumerate(few)
        for j, b in enumerate(many)
        if i and 100 * len(set(a) & set(b)) >= 85 * len(set(a) | set(b))
    }
    assert got == want


def test_left_over_returns_fewer_links_than_members(spark):
    draw = random.Random(8)
    base = [draw.randint(0, 10**12) for _ in range(60)]
    sets = [sorted({*base, draw.randint(10**13, 10**14)}) for _ in range(300)] + [sorted(draw.sample(range(10**6), 60)) for _ in range(20)]
    lists = spark.createDataFrame([(1, k, len(sets), -1) for k in range(len(sets))], "value long, rep long, members long, hub long")
    labels = spark.createDataFrame([], "node long, label long")
    hashes = spark.createDataFrame(list(enumerate(sets)), "rep long, hashes array<long>")
    links = near_dedup.left_over(lists, labels, hashes)
    got = links.collect()
    assert 299 <= len(got) <= 2 * len(sets)
    assert {r.node: r.label for r in components(links).collect()} == dict.fromkeys(range(300), 0)


def test_spanning_links_join_what_all_links_join():
    draw = random.Random(9)
    for n, m in ((1, 0), (30, 12), (30, 40), (200, 150)):
        pairs = np.array([[draw.randrange(n), draw.randrange(n)] for _ in range(m)], np.int64).reshape(-1, 2) * 7 + 3
        want = {int(x): {int(x)} for x in pairs.ravel()}
        for x, y in pairs.tolist():
            both = want[x] | want[y]
            for z in both:
                want[z] = both
        a, b = near_dedup.spanning(pairs[:, 0], pairs[:, 1])
        got = {x: {x} for x in want}
        for x, y in zip(a.tolist(), b.tolist()):
            assert x == min(want[y]) and x != y
            both = got[x] | got[y]
            for z in both:
                got[z] = both
        assert got == want and len(set(b.tolist())) == len(b)


def test_odd_rows(spark):
    rows = [(None, "same words here", 1), (5, "same words here", 1), (5, "same words here", 1), (None, "alone", 1), (7, None, 1)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string, rep long")).collect()
    told = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in got if r["n_shingles"] != 1 or r["component_id"])
    assert told == [(-1, 5, False), (5, 5, True), (5, 5, True), (7, 7, True)]
    alone = [r for r in got if r["doc_id"] is None and r["component_id"] is None]
    assert len(alone) == 1 and alone[0]["kept"]


def test_every_text_of_a_repeated_id_links(spark):
    word = lambda i: f"v{i}"
    x, y = [word(i) for i in range(46)], [word(100 + i) for i in range(46)]
    near = lambda w: [*w[:43], "other", "end", "here"]
    z = [word(300 + i) for i in range(46)]
    rows = [(1, x), (1, y), (3, near(y)), (2, near(x)), (None, z), (None, near(z)), (None, near(x)), (9, [word(900 + i) for i in range(60)])]
    a, b = set(shingles(words_of(" ".join(near(y)))).tolist()), set(shingles(words_of(" ".join(y))).tolist())
    assert 85 <= 100 * len(a & b) / len(a | b) < 90
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(docs).collect()]
    # Of the two near texts whose rows have no id one stays.
    key = lambda r: (r[0] or -1, r[1] or -1, r[2])
    want = [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, None, True), (None, None, False), (None, 1, False), (9, 9, True)]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_very_long_texts(spark):
    draw = random.Random(6)
    long = [f"u{draw.randint(0, 10**6)}" for _ in range(60_000)]
    changed = [w if i % 2000 else "changed" for i, w in enumerate(long)]
    docs = spark.createDataFrame([(4, " ".join(changed)), (2, " ".join(long)), (3, " ".join(long[:30_000]))], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs).collect()} == {4: 2, 2: 2, 3: 3}


def test_empty_table(spark):
    assert near_dedup.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (7, 3), (7, 3)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
