"""The pipeline against stages worked out by brute force on a small table."""

import random
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from anchorage.llm.near_dedup import shingles, words_of
from anchorage.llm.tokens import encoder, public_path
from tests.llm.test_quality_mixing import counts

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(1)
    line = lambda n: " ".join(f"w{draw.randint(0, 3000)}" for _ in range(n))
    passage = line(60)
    texts = [f"{line(50)}\n{line(30)}" for _ in range(40)]
    texts += [f"{line(60)} {passage} {line(20)}" for _ in range(10)]
    base = line(160).split()
    for _ in range(12):
        words = list(base)
        words[draw.randrange(160)] = f"edit{draw.randint(0, 999)}"
        texts.append(" ".join(words))
    texts += [texts[0], texts[0], "too short", "", None, "a b c " * 60]
    rows = [(i, t, "en", draw.choice(["a", "a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[5] + " tail", None, "b", None), (None, line(70), None, "b", None)]


def expected(rows):
    """Texts left after each stage: the rules, one per group, passages cut, all kept."""
    kept = [r for r in rows if counts(r[1])[0] >= 50 and 100 * counts(r[1])[4] <= 50 * counts(r[1])[0]]
    sets = [set(shingles(words_of(r[1])).tolist()) for r in kept]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            near = 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
            if near and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    last = float("inf")
    one = {}
    for r, g in zip(kept, group):
        if g not in one or (last if r[0] is None else r[0]) < (last if one[g][0] is None else one[g][0]):
            one[g] = r
    one = list(one.values())
    bodies = [r[1].encode() for r in one]
    times = Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    cut = []
    for r, b in zip(one, bodies):
        gone = set()
        for i in range(len(b) - 199):
            if times[b[i : i + 200]] > 1:
                gone.update(range(i, i + 200))
        text = bytes(c for i, c in enumerate(b) if i not in gone).decode("utf-8", "ignore")
        cut.append((r[0], text, r[2], r[3], len(text)))
    return kept, one, cut


def test_stages_equal_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, COLUMNS)
    kept, one, cut = expected(rows)
    wanted = [kept, one, cut, cut]
    for (name, stage), want in zip(corpus_pipeline.STAGES, wanted):
        got = corpus_pipeline.staged(stage(spark, docs, ""), "test-stage")
        assert got.columns == docs.columns, name
        assert Counter(map(tuple, got.collect())) == Counter(want), name
        docs = got
    own = encoder(public_path())
    packed = corpus_pipeline.STAGES[4][1](spark, docs, "").toPandas()
    lengths = packed.groupby("doc_id", dropna=False)["length"].sum()
    assert lengths.sum() == sum(len(own.ids(r[1])) // 4 + 1 for r in cut)
    for _, bin_ in packed.sort_values("offset").groupby("sequence_id"):
        assert bin_["length"].sum() <= 1024 and bin_["offset"].tolist() == [0, *bin_["length"].cumsum()[:-1]]


def test_clashing_columns_and_empty_table(spark, rows):
    docs = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], COLUMNS + ", c1 string, slot long, text_hash long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.staged(stage(spark, docs, ""), "test-clash")
        assert docs.columns[-3:] == ["c1", "slot", "text_hash"]
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_very_long_text_and_rows_that_repeat(spark):
    draw = random.Random(2)
    long = "\n".join(" ".join(f"w{draw.randint(0, 10**6)}" for _ in range(20)) for _ in range(4000))
    rows = [(1, long, "en", "a", len(long))] * 3 + [(2, " ".join(f"v{i}" for i in range(80)), "en", None, 0)] * 2
    docs = spark.createDataFrame(rows, COLUMNS)
    for (_, stage), n in zip(corpus_pipeline.STAGES[:4], (5, 2, 2, 2)):
        docs = corpus_pipeline.staged(stage(spark, docs, ""), "test-long")
        assert docs.count() == n
    packed = corpus_pipeline.STAGES[4][1](spark, docs, "").toPandas()
    own = encoder(public_path())
    assert packed.groupby("doc_id")["length"].sum().to_dict() == {d: len(own.ids(t)) // 4 + 1 for d, t in {(r[0], r[1]) for r in rows}}


def test_packing_follows_the_mix(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(i, " ".join(f"w{draw.randint(0, 999)}" for _ in range(draw.randint(20, 900))), "en", "a" if i < 45 else "b", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    monkeypatch.setattr(corpus_pipeline.packing, "WINDOW", 12)
    mixed = corpus_pipeline.staged(corpus_pipeline.STAGES[3][1](spark, docs, ""), "test-mixed")
    slots = corpus_pipeline.mixing.schedule(docs).orderBy("slot", "place").select("row.doc_id").collect()
    place = {r.doc_id: k for k, r in enumerate(slots)}
    assert [place[r.doc_id] for r in corpus_pipeline.packing.in_written_order(mixed).orderBy("place").collect()] == list(range(60))

    packed = corpus_pipeline.STAGES[4][1](spark, mixed, "").toPandas()
    packed["window"] = packed["doc_id"].map(place) // 12
    assert (packed.groupby("sequence_id")["window"].nunique() == 1).all()
    assert packed.sort_values("sequence_id")["window"].is_monotonic_increasing and packed["window"].nunique() == 5
    for _, bin_ in packed.sort_values("offset").groupby("sequence_id"):
        assert bin_["length"].sum() <= 1024 and bin_["offset"].tolist() == [0, *bin_["length"].cumsum()[:-1]]
    for (_, length), same in packed[packed["piece"] == 0].groupby(["window", "length"]):
        along = same.assign(at=same["doc_id"].map(place)).sort_values("at")
        assert along["sequence_id"].is_monotonic_increasing

    own = corpus_pipeline.staged(docs.orderBy("doc_id"), "test-unmixed")
    other = corpus_pipeline.STAGES[4][1](spark, own, "").toPandas()
    together = lambda t: set(t.groupby("sequence_id")["doc_id"].apply(frozenset))
    assert together(other) != together(packed) and len(other) == len(packed)


def test_registered_queries():
    names = list(__spark_entry__.queries())
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and "pipeline" not in __spark_entry__.oracle_sql()


def test_run_over_the_table(spark, folder):
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert len(got) and got.groupby("sequence_id")["length"].sum().max() <= 1024
