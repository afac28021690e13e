import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from anchorage.llm import mixing, quality

WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def counts(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated)


@pytest.fixture(scope="module")
def crawl():
    draw = random.Random(6)
    line = lambda n: " ".join(f"w{draw.randint(0, 5000)}" for _ in range(n))
    rows = []
    for doc in range(60):
        body = "\n".join(line(20) for _ in range(4))
        menu = "Home \t About | Contact" if doc % 2 else "home about | contact"
        rows.append((doc, body + "\n" + menu, "h1"))
    footer = line(80)
    rows += [(1000 + i, f"{line(4)}\n{footer}", "h1") for i in range(40)]
    copied = "\n".join(line(20) for _ in range(4))
    rows += [(200 + i, copied, "h2") for i in range(50)]
    rows += [(300, None, None), (301, "", "h1"), (302, "a b c " * 40, None), (None, line(60), "h1"), (0, rows[0][1], "h1"), (303, "x " * 10, "h1")]
    return rows


def test_counts_equal_brute_force(spark, crawl):
    docs = spark.createDataFrame([(d, t, s, 1) for d, t, s in crawl], "doc_id long, text string, source string, words long")
    want = Counter((d, *counts(t)) for d, t, _ in crawl)
    got = quality.judge(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])


def test_counts_and_keys_of_odd_texts(spark):
    draw = random.Random(9)
    texts = ["", "a", "a b", "a b c", "a a a a", "\n\n", " \t\x0b", "1 one\n1 one\n2 \u00c9A B\x0bc\r\n0 x", "\u00a0 \U0001f600#%\u0130 A\u2003b | <&>", "x\u0085y \x1cz " * 9]
    texts += [" ".join(draw.choice("ab\u00c9Z") for _ in range(draw.randint(0, 90))) for _ in range(60)]
    texts += ["".join(draw.choice("aB \t\n\x0b\x0c\r#$01\u00c9\U0001f600") for _ in range(draw.randint(0, 300))) for _ in range(60)]
    texts.append(" ".join(f"w{i % 4999}" for i in range(30_000)))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("h"))
    low = str.maketrans(quality.UPPER, quality.UPPER.lower())
    for r in quality.features(rows).collect():
        text = texts[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(text), text
        tidy = [(" ".join(WORDS.findall(x)).translate(low), at) for at, x in enumerate(text.split("\n"))]
        want = [(int(hashlib.md5(x.encode()).hexdigest()[:15], 16), len(x.split(" ")), at) for x, at in tidy if x]
        assert [(x["line"], x["words"], x["at"]) for x in r["lines"]] == want, text


def test_features_make_no_object_for_every_character(spark):
    docs = spark.createDataFrame([(0, "A b\n1 c", "h")], "doc_id long, text string, source string")
    plan = quality.features(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(text" not in plan and plan.count("translate(") <= 1


def test_boilerplate_is_rejected_and_copies_are_kept(spark, crawl):
    docs = spark.createDataFrame(crawl, "doc_id long, text string, source string")
    kept = {(r["doc_id"]): r["kept"] for r in quality.judge(docs).collect()}
    assert all(kept[d] for d in range(60)) and kept[None]
    assert not any(kept[1000 + i] for i in range(40))
    assert all(kept[200 + i] for i in range(50))
    assert not any(kept[d] for d in (300, 301, 302, 303))


def test_repeated_rows_are_judged_like_single_ones(spark, crawl):
    docs = spark.createDataFrame(crawl, "doc_id long, text string, source string")
    twice = [r for r in quality.judge(docs).collect() if r["doc_id"] == 0]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0]["n_boilerplate"] == 4


def test_quality_equals_sql(spark, duck, folder):
    got = quality.op7_quality_rules(spark, folder).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = duck.sql(quality.SQL).df().sort_values("doc_id").reset_index(drop=True)
    for column in want.columns:
        assert (got[column] == want[column]).all(), column


def test_quality_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_kept_texts_lose_the_frequent_lines(spark, crawl):
    rows = [(d, t, s, len(t or ""), 1) for d, t, s in crawl]
    rows += [(400 + i, f"\n A  b\tC \n{t}\n\n", s, 7, 2) for i, (_, t, s) in enumerate(crawl[:60])]
    # The same text and no id in two hosts; the line is frequent in the first only.
    body = " ".join(f"v{i}" for i in range(60)) + "\nhome about | contact"
    rows += [(None, body, "h1", len(body), 3), (None, body, "h9", len(body), 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, gone int")
    judged = {(r["doc_id"]): r["kept"] for r in quality.judge(docs).collect()}
    frequent = {"home about | contact", "a b c"}
    tidy = lambda line: " ".join(WORDS.findall(line)).lower()
    want = Counter()
    for d, t, s, n, g in rows:
        if judged[d]:
            left = "\n".join(x for x in t.split("\n") if s != "h1" or tidy(x) not in frequent)
            want[d, left, s, n if left == t else len(left), g] += 1
    got = quality.kept_documents(docs)
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == want
    assert sum(1 for (_, t, _, _, _) in want if "ontact" in t) == 1


def test_pages_of_one_template_count_one_by_one(spark):
    draw = random.Random(8)
    line = lambda n: " ".join(f"w{draw.randint(0, 5000)}" for _ in range(n))
    template = "\n".join(line(8) for _ in range(20))
    rows = [(i, f"{template}\nown {i}", "pages") for i in range(30)]
    shared = line(60)
    rows += [(100 + i, f"{shared}\n{line(60)}", "copied") for i in range(25)]
    copied = line(70)
    rows += [(1000 + i, copied, "copied") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert all(got[i]["n_boilerplate"] == 160 and not got[i]["kept"] for i in range(30))
    assert all(got[100 + i]["n_boilerplate"] == 60 for i in range(25))
    assert all(got[1000 + i]["kept"] and got[1000 + i]["n_boilerplate"] == 0 for i in range(3000))


def test_every_block_runs_in_its_window():
    draw = random.Random(7)
    for _ in range(100):
        k = draw.randint(1, 9)
        slots = max(draw.choice([k, 16, 64]), k)
        share = mixing.shares({f"s{i}": draw.random() + 0.01 for i in range(k)}, slots)
        assert sum(share.values()) == slots
        found = mixing.timetable(share, slots)
        assert sorted(x for at in found.values() for x in at) == list(range(slots))
        for s, at in found.items():
            for i, slot in enumerate(at):
                assert i * slots // share[s] <= slot < -(-(i + 1) * slots // share[s])


@pytest.mark.parametrize(
    "weights",
    [{f"s{i}": 1.0 for i in range(20)}, {f"s{i}": 0.001 if i == 3 else 1.0 for i in range(20)}, {f"s{i}": 1.0 + i for i in range(1100)}],
    ids=["equal", "small", "many"],
)
def test_mix_stays_within_a_block_of_the_target_weights(weights):
    total = sum(weights.values())
    done = Counter()
    for t, (s, phase, release, deadline) in enumerate(mixing.phases(dict.fromkeys(weights, 10**6), weights)):
        assert release <= t < deadline and phase == 0
        done[s] += 1
        if t % 50 == 0 or t > 19_900:
            assert all(abs(done[s] - weights[s] * (t + 1) / total) < 1 + 1e-9 for s in weights)
        if t == 20_000:
            break


def test_mix_follows_weights_and_drops_nothing(spark):
    sizes = {"a": 60, "b": 40, "c": 11, None: 27}
    rows = [(f"{s}{i}", 1000 * k + i, s, 5) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [rows[0], ("n", None, "a", 5)]
    docs = spark.createDataFrame(rows, "text string, doc_id long, source string, slot long")
    weights = {"a": 3.0, "b": 2.0, None: 1.0}
    got = mixing.schedule(docs, weights, block=2, slots=12).collect()
    assert Counter(r["row"] for r in got) == Counter(docs.collect())
    blocks = sorted({(r["slot"], r["row"]["source"], r["phase"], r["release"], r["deadline"]) for r in got}, key=lambda b: b[0])
    assert [b[0] for b in blocks] == list(range(len(blocks)))
    assert all(b[3] <= b[0] < b[4] for b in blocks)
    done = Counter()
    exact = mixing.shares({"=a": 3.0, "=b": 2.0, "": 1.0}, 12)
    share = {"a": exact["=a"] / 12, "b": exact["=b"] / 12, None: exact[""] / 12}
    for slot, source, _, _, _ in blocks[:30]:
        done[source] += 1
        assert all(abs(done[s] - share[s] * (slot + 1)) < 1 for s in share)
    assert blocks[-1][1] == "c" or "c" in {b[1] for b in blocks[-6:]}


def test_mixed_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(i, "t", "ab"[i % 2], "p") for i in range(40)], "doc_id long, text string, source string, phase string")
    got = mixing.mixed(docs, block=2)
    assert got.columns == docs.columns and Counter(got.collect()) == Counter(docs.collect())
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_more_sources_than_slots(spark):
    docs = spark.createDataFrame([(i, f"s{i}") for i in range(30)], "doc_id long, source string")
    assert sorted(r["slot"] for r in mixing.schedule(docs, slots=4).collect()) == list(range(30))
