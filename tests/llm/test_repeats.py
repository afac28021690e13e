import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from anchorage.llm import repeats


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = True
        left = bytes(c for c, g in zip(b, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), len(b) - len(left), runs, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("letters", [b"ab", b"abcdefghij "])
def test_shared_windows_equal_brute_force(letters):
    draw = random.Random(6)
    for _ in range(60):
        length = draw.choice([20, 25, 40])
        base = [bytes(draw.choices(letters, k=draw.randint(5, 80))) for _ in range(4)]
        extra = [bytes([draw.randint(0, 255)]) * draw.choice([1, 30])]
        parts = [b"".join(draw.choices(base + extra, k=draw.randint(1, 5))) for _ in range(draw.randint(1, 7))]
        times = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        for part, flags in zip(parts, repeats.shared_windows(parts, length)):
            assert flags.tolist() == [times[part[i : i + length]] > 1 for i in range(len(part) - length + 1)]


def test_segments_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(repeats, "MOST_WINDOWS", 50)
    draw = random.Random(7)
    data = np.frombuffer(bytes(draw.choices(b"abc", k=900)) + b"And " * 300, np.uint8)
    _, first, count, _ = repeats.segments(data)
    assert first[0] == 0 and count.max() <= 50
    assert (first[1:] == (first + count)[:-1]).all() and first[-1] + count[-1] == len(data) - 199


def test_equal_windows_share_keys_across_strides(monkeypatch):
    draw = random.Random(8)
    data = np.frombuffer(bytes(draw.choices(b"abcdef", k=5000)), np.uint8)
    whole = repeats.segments(data)
    monkeypatch.setattr(repeats, "STRIDE", 1 << 10)
    parts = repeats.segments(data)
    assert [np.repeat(k, c).tolist() for k, c in ((whole[0], whole[2]),)] == [np.repeat(parts[0], parts[2]).tolist()]


def corpus():
    draw = random.Random(9)
    text = lambda n: "".join(draw.choices("abcdefgh é\n", k=n))
    passage, tail = text(320), text(150)
    texts = [text(draw.randint(0, 300)) + passage[draw.randint(0, 60) :] + text(draw.randint(0, 200)) for _ in range(12)]
    texts += [text(400) + tail, text(90) + tail, "And " * 400, text(900), None, "", "short", texts[0], texts[0], "copy", "copy", "é" * 260]
    return texts


@pytest.mark.parametrize("units", [10_000, 2])
def test_query_equals_brute_force(spark, monkeypatch, units):
    monkeypatch.setattr(repeats, "MOST_UNITS", units)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, c1 string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.without_repeats(docs).collect()}
    assert got == dict(enumerate(brute(texts, 200)))


def test_table_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.op8_suffix_dedup(spark, folder).collect()}
    assert got == {r["doc_id"]: w for r, w in zip(rows, brute([r["text"] for r in rows], 200))}


def test_repeated_and_null_ids_and_empty_table(spark):
    long = "x1 y2 z3 " * 5 + "".join(chr(97 + i * 7 % 26) for i in range(300))
    docs = spark.createDataFrame([(1, long), (1, long), (None, "unlike"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"] == r["n_bytes"], r["n_bytes"]) for r in repeats.without_repeats(docs).collect())
    assert got == [(0, False, 6), (0, True, 0), (1, True, len(long)), (1, True, len(long))]
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_cut_documents_keep_their_columns(spark):
    passage = "".join(chr(97 + i * i % 23) for i in range(260))
    rows = [(1, "éa " + passage, 9, "k"), (2, "other " + passage + " end", 9, "k"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, c1 string")
    got = {r["doc_id"]: r for r in repeats.cut_documents(docs).collect()}
    assert got[1]["text"].startswith("éa") and len(got[1]["text"]) <= 3 and got[1]["n_chars"] == len(got[1]["text"])
    assert "end" in got[2]["text"] and got[2]["c1"] == "k" and got[None]["text"] == ""
