import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from anchorage.llm import packing
from anchorage.llm.tokens import encoder, public_path, units

PARTS = ["a", "Bc", " ", "  ", "\n", "\t", " \n", "'s", "12", "é", "\x85", "\x1c", "ß!", "日本", "\xa0", "🙂", "́", "<|endoftext|>"]


@pytest.fixture(scope="module")
def reference():
    whole = Tokenizer.from_file(public_path())
    whole.encode_special_tokens = True
    return lambda text: whole.encode(text, add_special_tokens=False).ids


def test_ids_equal_whole_text_encoding(reference):
    draw = random.Random(1)
    own = encoder(public_path())
    for _ in range(3000):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14)))
        assert "".join(units(text)) == text
        assert own.ids(text) == np.array(reference(text), "<u4").tobytes(), repr(text)


def test_memo_is_emptied_when_full(monkeypatch, reference):
    monkeypatch.setattr("anchorage.llm.tokens.MEMO_UNITS", 2)
    own = encoder(public_path())
    for text in ("one two three four", "five six one two"):
        assert own.ids(text) == np.array(reference(text), "<u4").tobytes()


def test_cut_leaves_only_the_first_piece_short():
    assert packing.cut(0, 8) == []
    assert packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_fullest_is_the_best_combination():
    draw = random.Random(2)
    for _ in range(300):
        counts = {draw.randint(1, 30): draw.randint(1, 3) for _ in range(5)}
        chosen = packing.fullest(counts, 30)
        sums = {max(counts)}
        for length, n in counts.items():
            left = n - (length == max(counts))
            sums = {s + k * length for s in sums for k in range(left + 1)}
        assert sum(n * length for length, n in chosen.items()) == max(s for s in sums if s <= 30)
        assert all(n <= counts[length] for length, n in chosen.items())


def test_plan_uses_every_piece_once():
    draw = random.Random(3)
    counts = {draw.randint(1, 1024): draw.randint(1, 40) for _ in range(200)}
    used = {}
    for repeats, chosen in packing.plan(counts):
        assert sum(n * length for length, n in chosen.items()) <= 1024
        for length, n in chosen.items():
            used[length] = used.get(length, 0) + repeats * n
    assert used == counts


def test_pack_odd_rows(spark, reference):
    long_text = "word and another one, " * 900
    rows = [(1, "a b", "x"), (2, None, "x"), (2, None, "x"), (None, "", "x"), (3, long_text, "x"), (4, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack(docs, public_path()).toPandas()
    for doc, text in ((1, "a b"), (3, long_text)):
        ids = np.array(reference(text) + [2], "<u4")
        mine = got[got.doc_id == doc].sort_values("piece")
        want = [(s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n in packing.cut(len(ids), 1024)]
        assert list(mine[["start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    assert len(got[got.doc_id == 2]) == 2 and got.doc_id.isna().sum() == 1
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert bin_["length"].sum() <= 1024
        assert bin_["offset"].tolist() == [0, *bin_["length"].cumsum()[:-1]]
    assert got.sequence_id.nunique() == -(-got["length"].sum() // 1024)


def test_pack_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, public_path()).count() == 0


def test_query_packs_tightly(spark, folder):
    got = packing.op2_best_fit_packing(spark, folder).toPandas()
    assert got.sequence_id.nunique() <= 1.02 * got["length"].sum() / 1024
