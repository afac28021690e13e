import random
import zlib

import numpy as np
import pytest

from anchorage.llm import language, licences, toxicity

EN = "the of and is that with house river because water which morning people".split()
DE = "der die und ist nicht haus fluss weil wasser welche morgen leute straße".split()
RU = "и не что дом река потому вода который утро люди".split()


def fold(doc, n):
    return zlib.crc32(str(doc).encode()) % n


def prose(draw, words, n):
    return " ".join(draw.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def toxic_tables(spark):
    draw = random.Random(1)
    rows, marks = [], []
    for doc in range(500):
        bad = doc % 4 == 0
        words = prose(draw, EN, draw.randint(20, 120)).split()
        if bad:
            words[draw.randrange(len(words))] = draw.choice(["vileword", "nastyterm"])
        rows.append((doc, " ".join(words), "z"))
        marks.append((doc, int(bad)))
    marks += [(0, 0), (None, 1), (9999, 1), (3, None)]
    rows += [(None, None, "z"), (600, "", "z"), (600, "", "z"), (601, "x" * 100, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxic_documents_are_found_out_of_sample(toxic_tables):
    docs, marks = toxic_tables
    got = toxicity.score(docs, toxicity.train(docs, marks)).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 500]
    assert held and all(fold(r["doc_id"], 5) == 0 for r in held)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (None, 600)}) == 1
    assert not [r["held_out"] for r in got if r["doc_id"] is None][0]


def test_toxicity_without_labels_or_rows(toxic_tables):
    docs, marks = toxic_tables
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, marks.limit(0))).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), toxicity.fit([], [])).count() == 0


def test_presence_does_not_depend_on_windows(monkeypatch):
    text = prose(random.Random(2), EN, 400)
    whole = toxicity.Presence()(text)
    monkeypatch.setattr(toxicity, "WINDOW", 64)
    assert (toxicity.Presence()(text) == whole).all()


@pytest.fixture(scope="module")
def languages(spark):
    draw = random.Random(3)
    rows = [(i, prose(draw, words, 40), lang, "z") for i in range(240) for lang, words in [(("en", EN), ("de", DE), ("ru", RU))[i % 3]]]
    mixed = prose(draw, EN, 30) + " " + prose(draw, DE, 12) + " " + prose(draw, EN, 20)
    numerals = [(1005, "² ½ ③", "en", "z"), (1006, "Ⅷ 12", "de", "z"), (1007, "½der ²und Ⅷ", "de", "z")]
    odd = numerals + [(1000, mixed, None, "z"), (1001, None, "en", "z"), (1002, "12 34 !!", "de", "z"), (None, prose(draw, DE, 20), "de", "z"), (1003, "日本語", None, "z"), (1004, "", "en", "z")]
    return spark.createDataFrame(rows + odd + odd[:1], "doc_id long, text string, lang string, score string")


def test_languages_and_spans(languages):
    got = language.label(languages, language.train(languages)).collect()
    assert len(got) == languages.count()
    named = {r["doc_id"]: r for r in got}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 240]
    assert held and all(fold(r["doc_id"], 4) == 2 for r in held)
    assert all(r["lang_pred"] == ("en", "de", "ru")[r["doc_id"] % 3] for r in held)
    assert [(s["lang"], s["first"], s["words"]) for s in named[1000]["spans"]] == [("en", 0, 30), ("de", 30, 12), ("en", 42, 20)]
    assert 0.5 < named[1000]["score"] < 1
    assert named[1007]["lang_pred"] == "de"
    for doc in (1001, 1002, 1004, 1005, 1006):
        assert (named[doc]["lang_pred"], named[doc]["score"], named[doc]["spans"]) == ("und", 0.0, [])
    assert named[None]["lang_pred"] == "de" and not named[None]["held_out"]
    assert named[1003]["lang_pred"] in ("en", "de", "ru")


def test_paths_equal_brute_force():
    draw = np.random.default_rng(4)
    lengths = np.array([5, 0, 1, 7, 7])
    scores = draw.normal(size=(lengths.sum(), 3)).astype(np.float32)
    got = language.paths(scores, lengths, 1.0)

    def worth(path, own):
        return sum(own[i, p] for i, p in enumerate(path)) - sum(a != b for a, b in zip(path, path[1:]))

    for end, n in zip(np.cumsum(lengths), lengths):
        own = scores[end - n : end]
        best = max((worth(p, own) for p in np.ndindex(*[3] * n)), default=0)
        assert abs(worth(got[end - n : end], own) - best) < 1e-4


def test_nothing_learned_and_empty(languages):
    model = language.train(languages.limit(0))
    assert {r["lang_pred"] for r in language.label(languages, model).collect()} == {"und"}
    assert language.label(languages.limit(0), model).count() == 0


def test_memo_is_emptied(monkeypatch, languages):
    model = language.train(languages)
    texts = [r["text"] for r in languages.limit(20).collect()]
    want = language.Labeller(model).label(texts)
    monkeypatch.setattr(language, "MEMO_WORDS", 5)
    monkeypatch.setattr(language, "CHUNK_WORDS", 50)
    assert language.Labeller(model).label(texts) == want


def test_every_template_is_found_by_itself(spark):
    draw = random.Random(9)
    notices = [(family, n) for family, found in licences.TEMPLATES.items() for n in found]
    rows = [(i, "\n".join(prose(draw, EN, k) for k in (9, 2, 1, 9))) for i in range(150)]
    taught = spark.createDataFrame(rows, "doc_id long, text string")
    model = licences.train(taught)
    rows += [(1000 + k, n) for k, (_, n) in enumerate(notices)]
    told = {r["doc_id"]: r["families"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [(n, told[1000 + k]) for k, (_, n) in enumerate(notices)] == [(n, [family]) for family, n in notices]
    assert all(told[i] == [] for i in range(150))


def test_licence_families(spark):
    draw = random.Random(5)
    notices = {
        "mit": "Released under the MIT License.",
        "apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    }
    rows = [(i, "\n".join(prose(draw, EN, 9) for _ in range(3)), "z") for i in range(150)]
    rows += [(200 + k, f"{prose(draw, EN, 8)}\n{notice}\n{prose(draw, EN, 8)}", "z") for k, notice in enumerate(notices.values())]
    rows += [(300, "\n".join(notices.values()), "z")] * 2
    rows += [(301, None, "z"), (302, "", "z"), (None, notices["mit"], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    model = licences.train(docs)
    got = licences.scan(docs, model).collect()
    assert len(got) == len(rows)
    told = {r["doc_id"]: r for r in got}
    for k, family in enumerate(notices):
        assert told[200 + k]["families"] == [family] and told[200 + k]["n_paragraphs"] == 3
    assert told[300]["families"] == sorted(notices) and told[300]["n_confirmed"] == 4
    assert told[None]["families"] == ["mit"]
    assert all(told[d]["families"] == [] for d in range(150))
    assert (told[301]["n_paragraphs"], told[302]["n_named"]) == (0, 0)
    assert licences.scan(docs.limit(0), model).count() == 0


def test_notices_that_were_not_taught(spark):
    """Held-out wordings, and prose about licences that names none."""
    draw = random.Random(19)
    notices = [
        ("mit", "Released under the MIT License in 2020."),
        ("mit", "MIT License"),
        ("public-domain", "The Unlicense"),
        ("bsd", "// SPDX-License-Identifier: BSD-2-Clause"),
        ("isc", "/* SPDX-License-Identifier: ISC */"),
        ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3"),
        ("lgpl", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
        ("gpl", "# it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3"),
        ("epl", "made available under the terms of the Eclipse Public License 2.0"),
        ("cc-by-nd", "This article is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
        ("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY'),
    ]
    # The first is named but shares too few words with a template to be confirmed.
    plain = ["Distributed under the terms of the MIT License.", "The license fee is due in January.", "He lost his driving license on the general public road.", "software for any river", "A permission slip was granted by the school."]
    rows = [(i, "\n".join(prose(draw, EN, k) for k in (9, 2, 1, 9))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    more = [(1000 + k, n) for k, (_, n) in enumerate(notices)] + [(2000 + k, n) for k, n in enumerate(plain)]
    every = docs.union(spark.createDataFrame(more + [(3000, "word " * 200_000 + "MIT License")], "doc_id long, text string"))
    told = {r["doc_id"]: r["families"] for r in licences.scan(every, licences.train(docs)).collect()}
    assert [(n, told[1000 + k]) for k, (_, n) in enumerate(notices)] == [(n, [family]) for family, n in notices]
    assert all(told[2000 + k] == [] for k in range(len(plain))) and told[3000] == []


def test_threshold_counts_every_paragraph(spark):
    rows = [(0.6 + 0.4 * k / 1000, k % 2 == 0) for k in range(1000)]
    scored = spark.createDataFrame(rows, "probability double, strange boolean")
    for total in (1_000, 20_000, 400_000, 10**6):
        cut = licences.threshold_of(scored, total)
        reached = sum(s and p >= cut for p, s in rows)
        assert reached <= licences.MISTAKEN * total
        assert cut == licences.LEAST or sum(s and p >= cut - 0.4 / licences.STEPS - 1e-12 for p, s in rows) > licences.MISTAKEN * total


def test_template_comparison_equals_brute_force(spark):
    from pyspark.sql import functions as F

    known = licences.family_shingles()
    texts = ["Licensed under the Apache License, Version 2.0 and more words", "MIT License", "a b", "of the Software without restriction . this software"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", licences.paragraph_words(F.col("t")))
    for row in rows.select("t", licences.resemblance(F.col("w"), known).alias("r")).collect():
        words = licences.split_words(row["t"])
        own = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
        assert row["r"] == [0.0, *(len(own & set(known[f])) / len(own) for f in licences.FAMILIES[1:])]


def test_template_words_are_split_alike(spark):
    from pyspark.sql import functions as F

    notices = [n for found in licences.TEMPLATES.values() for n in found]
    rows = spark.createDataFrame([(n,) for n in notices], "notice string").select("notice", licences.paragraph_words(F.col("notice")).alias("w"))
    for row in rows.collect():
        assert row["w"] == licences.split_words(row["notice"])
