import random

import numpy as np
from pyspark.sql import functions as F

from anchorage.llm import nearest, recount
from anchorage.llm.common import staged
from anchorage.llm.tokens import encoder, public_path

ROWS = "vec_id long, embedding array<float>, score double"


def best(rows, query, top=5):
    """Nearest ids by brute force over usable rows, ties to the smaller id."""
    own = np.array(dict(rows)[query], float)
    scored = []
    for other, vector in rows:
        if other != query:
            v = np.array(vector, float)
            scored.append((-round(float(own @ v / np.linalg.norm(own) / np.linalg.norm(v)), 12), other))
    return [i for _, i in sorted(scored)[:top]]


def test_recall_against_brute_force(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=16).astype(np.float32).tolist()) for i in range(1500)]
    table = spark.createDataFrame([(i, v, 0.0) for i, v in rows], ROWS)
    got = nearest.search(table, table.filter("vec_id % 50 = 0")).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert all([r["rank"] for r in got if r["query_id"] == q] and len(v) == 5 for q, v in found.items())
    hits = sum(len(set(best(rows, q)) & set(found[q])) for q in range(0, 1500, 50))
    assert hits / (30 * 5) >= 0.9
    vectors = dict(rows)
    for r in got[:20]:
        a, b = np.array(vectors[r["query_id"]], float), np.array(vectors[r["vec_id"]], float)
        assert abs(r["score"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_copies_ties_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.0], 0.0) for i in range(0, 400, 2)]
    rows += [(1, [0.0, 1.0, 0.0], 0.0), (3, [float("nan"), 1.0, 0.0], 0.0), (5, None, 0.0), (7, [0.0, 0.0, 0.0], 0.0), (9, [None, 1.0, 1.0], 0.0)]
    rows += [(11, [float("inf"), 1.0, 0.0], 0.0), (None, [1.0, 0.0, 0.0], 0.0), (0, [1.0, 0.0, 0.0], 0.0), (13, [1.0, 2.0], 0.0)]
    table = spark.createDataFrame(rows, ROWS)
    got = nearest.search(table, table.filter("vec_id in (0, 100, 3, 5, 13)")).collect()
    by = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 100, 3, 5, 13)}
    assert by == {0: [2, 4, 6, 8, 10], 100: [0, 2, 4, 6, 8], 3: [], 5: [], 13: []}
    assert {r["score"] for r in got} == {1.0}


def test_few_and_no_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 1.0], 0.0), (1, [1.0, 0.9], 0.0), (2, [0.9, 1.0], 0.0)], ROWS)
    got = nearest.search(table, table.filter("vec_id = 0")).collect()
    assert sorted(r["vec_id"] for r in got) == [1, 2]
    assert nearest.search(table.limit(0), table.limit(0)).count() == 0
    assert nearest.search(table, table.limit(0)).count() == 0


def test_split_groups_find_the_same(spark, monkeypatch):
    draw = np.random.default_rng(2)
    table = spark.createDataFrame([(i, draw.normal(size=6).astype(np.float32).tolist(), 0.0) for i in range(300)], ROWS)
    ask = table.filter("vec_id % 20 = 0")
    want = {tuple(r) for r in nearest.search(table, ask).collect()}
    monkeypatch.setattr(nearest, "GROUP_ROWS", 7)
    assert {tuple(r) for r in nearest.search(table, ask).collect()} == want


def all_sums(logs):
    """Log chance of every combination of one move a direction."""
    total = np.zeros(1)
    for row in logs:
        total = (total[:, None] + row).ravel()
    return total


def test_last_bucket_by_falling_chance():
    draw = np.random.default_rng(5)
    for directions in (1, 2, 7, 8):
        chance = draw.dirichlet((1, 3, 1), size=directions) * 0.99
        total = -np.sort(-all_sums(np.log(chance)))
        for success in (0.05, 0.6, 0.85):
            reached = int(np.searchsorted(np.cumsum(np.exp(total)), success)) + 1
            bound = nearest.least(np.log(chance), success)
            assert (total >= bound).sum() == min(reached, len(total))
    assert (all_sums(np.log(chance)) >= nearest.least(np.log(chance), 0.9999)).all()


def test_rounded_sums_visit_at_least_as_much(monkeypatch):
    draw = np.random.default_rng(6)
    logs = np.log(draw.dirichlet((1, 3, 1), size=12))
    exact = nearest.least(logs, 0.6)
    monkeypatch.setattr(nearest, "MOST_SUMS", 100)
    assert exact - 0.02 < nearest.least(logs, 0.6) <= exact + 1e-6


def test_visited_rows_are_those_of_the_likely_buckets(monkeypatch):
    draw = np.random.default_rng(8)
    monkeypatch.setattr(nearest, "TILE", 13)
    for directions in (1, 2, 3, 7):
        slots, slot = draw.integers(-2, 3, (300, directions)), draw.integers(-2, 3, (20, directions))
        logs = np.log(draw.dirichlet((1, 3, 1), size=(20, directions)))
        bound = np.array([nearest.least(of, 0.6) for of in logs])
        missed = np.ones((300, 20), bool)
        nearest.visit(missed, *nearest.tree(slots), slot, logs, bound)
        move = slots[:, None, :] - slot + 1
        chance = np.take_along_axis(logs[None], np.clip(move, 0, 2)[..., None], axis=3)[..., 0].sum(axis=2)
        want = ((move >= 0) & (move <= 2)).all(axis=2) & (chance >= bound)
        assert want.any() and (missed == ~want).all()


def test_shortlist_holds_the_highest():
    near = np.random.default_rng(9).normal(size=(1003, 7)) / 10
    near[:, 3] = -np.inf
    near[5:8, 4], near[:5, 4], near[8:, 4] = 0.5, -np.inf, -np.inf
    found = set(zip(*(x.tolist() for x in nearest.shortlist(near, 5))))
    for column in range(7):
        want = {(int(k), column) for k in np.argsort(-near[:, column])[:6] if np.isfinite(near[k, column])}
        assert want <= found and sum(c == column for _, c in found) <= 3 * len(want)


def test_vectors_of_one_direction_leave_a_call_as_few_rows():
    query, score, ids = np.array([1, 0, 1, 1, 0]), np.array([0.5, 1.0, 0.5, 0.7, 1.0]), np.array([9, 4, 8, 3, 2])
    assert nearest.highest(query, score, ids, 2).tolist() == [4, 1, 3, 2]
    draw = np.random.default_rng(10)
    x = np.outer(draw.uniform(1, 2, 5000), draw.normal(size=3))
    k, i = nearest.shortlist(x @ x[:2].T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x[:2], axis=1)), 5)
    assert len(k) == 10_000 and np.allclose(nearest.scores(x[:2], x, i, k), 1)


def test_queries_that_visit_millions_of_buckets(spark, monkeypatch):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=16).astype(np.float32).tolist()) for i in range(400)]
    table = spark.createDataFrame([(i, v, 0.0) for i, v in rows], ROWS)
    monkeypatch.setattr(nearest, "PER_BUCKET", 1e-9)
    found = {}
    for r in nearest.search(table, table.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sum(len(set(best(rows, q)) & set(found[q])) for q in range(0, 400, 100)) >= 18


def test_edits_equal_full_recount():
    draw = random.Random(3)
    own = encoder(public_path())
    parts = ["ab", "Cd ef", " ", "  ", "\n", "x1", "'s ", "é ", " z"]
    for _ in range(1500):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 160)))
        tree = recount.planted(text, own)
        assert (tree.tokens[1] * 4, tree.chars[1]) == (len(own.ids(text)), len(text))
        for _ in range(4):
            insert = draw.choice(["", " ", "q", " w e ", "\n \n"])
            text, _n = recount.edited(text, tree, draw.randint(0, len(text) + 2), draw.randint(0, 9), insert, own)
            assert (tree.tokens[1] * 4, tree.chars[1]) == (len(own.ids(text)), len(text)), text


def test_only_touched_leaves_are_encoded():
    own = encoder(public_path())
    text = "some words in a row " * 4000
    tree = recount.planted(text, own)
    _, n = recount.edited(text, tree, 40_000, 5, "new", own)
    assert n < 500


def test_a_second_batch_starts_from_the_kept_trees(spark):
    draw = random.Random(31)
    own = encoder(public_path())
    texts = ["some words in a row " * 3000, "", "short text", " a  b\n" * 900, "x" * 5000]
    edits = lambda n: [(draw.randint(0, 70_000), draw.randint(0, 9), draw.choice(["new", " two words", "", "\n"])) for _ in range(n)]
    kind = f"doc_id long, edits {recount.EDITS}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("leaf_chars", F.lit(1))
    trees = recount.plant(docs, public_path()).drop("edits")
    for _ in range(3):
        batch = {doc: edits(4) for doc in range(len(texts))}
        sent = spark.createDataFrame([(d, e) for d, e in batch.items()], kind)
        trees = staged(recount.apply_edits(trees.join(sent, "doc_id"), public_path()), "edited")
        for row in trees.collect():
            text = texts[row["doc_id"]]
            for start, removed, inserted in batch[row["doc_id"]]:
                start = min(start, len(text))
                text = text[:start] + inserted + text[start + removed :]
            texts[row["doc_id"]] = text
            assert row["text"] == text and row["edited_tokens"] * 4 == len(own.ids(text))
            assert sum(row["leaf_tokens"]) == row["edited_tokens"] and sum(row["leaf_chars"]) == len(text)
            if row["doc_id"] == 0:
                assert row["encoded_chars"] < 4000
        trees = trees.select("doc_id", "text", "leaf_chars", "leaf_tokens")


def test_leaves_that_grow_are_split():
    own = encoder(public_path())
    text = "some words " * 100
    tree = recount.planted(text, own)
    for k in range(60):
        text, n = recount.edited(text, tree, 300 + 12 * k, 0, " more of it ", own)
    text, n = recount.edited(text, tree, 500, 0, "many words " * 500, own)
    text, n = recount.edited(text, tree, 600, 3, "x", own)
    assert n < 1500 and max(tree.kept()[0]) < 1500
    assert tree.tokens[1] * 4 == len(own.ids(text))


def test_recount_rows(spark):
    rows = [(1, "one two three", [(4, 3, "2")]), (2, None, [(0, 9, "made"), (99, 1, " up")]), (3, "kept", None), (None, "", []), (None, "", [])]
    rows += [(4, "a b", [(None, None, None), (-5, -5, "z")])]
    schema = "doc_id long, text string, edits array<struct<start:long,removed:long,inserted:string>>"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "1 as n_tokens")
    own = encoder(public_path())
    got = {r["doc_id"]: r for r in recount.recount(docs, public_path()).collect()}
    for doc, before, after in ((1, "one two three", "one 2 three"), (2, "", "made up"), (3, "kept", "kept"), (None, "", ""), (4, "a b", "za b")):
        assert got[doc]["n_tokens"] == len(own.ids(before)) // 4
        assert (got[doc]["edited_tokens"], got[doc]["edited_chars"]) == (len(own.ids(after)) // 4, len(after))
    assert recount.recount(docs.limit(0), public_path()).count() == 0


def test_query_equals_recount_of_edited_texts(spark, folder):
    from zlib import crc32

    own = encoder(public_path())
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in recount.op6_token_counts(spark, folder).collect():
        text = docs[r["doc_id"]]["text"]
        at = crc32(str(r["doc_id"]).encode()) % (len(text) + 1)
        new = text[:at] + docs[r["doc_id"]]["source"] + text[at + recount.REMOVED :] + " " + docs[r["doc_id"]]["lang"]
        assert r["n_tokens"] * 4 == len(own.ids(text)) and r["edited_tokens"] * 4 == len(own.ids(new))


def test_queries_far_from_all_rows_get_their_true_neighbours(spark):
    random = np.random.default_rng(21)
    centres = random.standard_normal((20, 32))
    tight = np.repeat(centres, 100, axis=0) + 0.02 * random.standard_normal((2000, 32))
    x = np.vstack([tight, random.standard_normal((6, 32))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    far = list(range(2000, 2006))
    got = nearest.search(rows, rows.filter((F.col("vec_id") % 20 == 0) | (F.col("vec_id") >= 2000))).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in far:
        near = unit @ unit[q]
        near[q] = -2
        want = np.argsort(-near)[:5].tolist()
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
