import hashlib
import random
from collections import Counter, defaultdict

import pytest

from anchorage.llm import line_dedup

SPACE = "\t\n\x0b\x0c\r "
LOWER = str.maketrans(line_dedup.UPPER, line_dedup.UPPER.lower())


def brute(rows):
    """(doc_id, n_lines, n_dropped, text) per row."""
    holders = defaultdict(set)
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40 and doc is not None:
                holders[key(line)].add(doc)
    out = Counter()
    for doc, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(holders[key(x)]) < 5 or doc == max(holders[key(x)])]
        out[doc, len(lines), len(lines) - len(left), "\n".join(left)] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    line = lambda n: " ".join(f"W{draw.randint(0, 5000)}" for _ in range(n))
    shared = [line(12) for _ in range(6)] + ["Ünïcode ÀÉ " * 4 + "kept apart", "x" * 39, "x" * 40, "é" * 40, "É" * 40]
    found = []
    for doc in range(60):
        picks = [draw.choice(["", " ", "\t"]) + draw.choice([s, s.lower(), s.upper()]) + draw.choice(["", "\r", " \x0b"]) for s in draw.sample(shared, 4)]
        body = [line(3), *picks, "", line(15), picks[0]]
        draw.shuffle(body)
        found.append((doc, "\n".join(body)))
    four = line(20)
    found += [(100 + i, f"{four}\n{i}") for i in range(4)] + [(100, four)]
    found += [(None, shared[0]), (None, None), (200, None), (201, ""), (202, "\n\n"), (203, shared[0]), (203, shared[0]), (204, shared[1] + "\nother")]
    found += [(300, "\n".join([shared[2], line(30)] * 4000))]
    found += [(1000 + i, shared[3]) for i in range(3000)]
    return found


def test_equals_brute_force(spark, rows):
    docs = spark.createDataFrame([(d, t, 1, "a", d) for d, t in rows], "doc_id long, text string, gone int, row string, n_lines long")
    got = Counter(map(tuple, line_dedup.dedup_lines(docs).collect()))
    assert got == brute(rows)
    assert any(dropped for _, _, dropped, _ in got)


def test_documents_keep_their_columns(spark, rows):
    docs = spark.createDataFrame([(d, t, "s", -1) for d, t in rows], "doc_id long, text string, left string, n_chars long")
    got = line_dedup.cut_documents(docs)
    assert got.columns == docs.columns
    want = Counter()
    for (doc, _, dropped, text), n in brute(rows).items():
        want[doc, text, "s", len(text) if dropped else -1] += n
    assert Counter(map(tuple, got.collect())) == want


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_brute_force_and_sql(spark, duck, folder):
    got = Counter(map(tuple, line_dedup.op13_line_dedup(spark, folder).collect()))
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    want = Counter()
    for (doc, n, dropped, text), times in brute(rows).items():
        want[doc, n, dropped, hashlib.sha256(text.encode()).hexdigest()] += times
    assert got == want
    assert got == Counter(duck.sql(line_dedup.SQL).fetchall())
