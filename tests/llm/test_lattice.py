import math
import zlib
from collections import Counter

import pytest

from varicube.llm import lattice


class Pieces:
    def __init__(self, pieces):
        self.pieces = pieces + [f"<0x{b:02X}>" for b in range(256)]
        self.usable = [True] * len(pieces) + [False] * 256
        self.byte_ids = list(range(len(pieces), len(pieces) + 256))


def brute(text, p, byte_p, single):
    if not text:
        return 1.0
    total = sum(p[text[:n]] * brute(text[n:], p, byte_p, single) for n in range(1, len(text) + 1) if text[:n] in p)
    if text[0] not in single:
        total += byte_p ** len(text[0].encode()) * brute(text[1:], p, byte_p, single)
    return total


@pytest.mark.parametrize("word", ["abab", "abcab", "", "ééa", "zab", "ab▁a"])
def test_sum_over_all_segmentations(word):
    p = {"▁": 0.1, "▁a": 0.2, "▁ab": 0.05, "a": 0.1, "b": 0.1, "ab": 0.15, "ba": 0.05, "é": 0.01}
    byte_p = 0.001
    model = lattice.Lattice(Pieces(list(p)), [math.log(v) for v in p.values()] + [math.log(byte_p)] * 256)
    single = {w for w in p if len(w) == 1}
    assert model.log10(word) == pytest.approx(math.log10(brute("▁" + word, p, byte_p, single)), abs=1e-9)


def test_long_word_does_not_underflow():
    model = lattice.Lattice(Pieces(["▁", "a"]), [math.log(0.1), math.log(0.5)] + [math.log(0.001)] * 256)
    assert model.log10("a" * 5000) == pytest.approx(-1 + 5000 * math.log10(0.5))


def words_of(text):
    return (text or "").encode().lower().split()


def test_word_probabilities_add_up():
    model = lattice.WordModel(tokens=100, ends=10, distinct=30, discount=0.6)
    known = 90 / 100 - 0.6 * 30 / 100
    assert known + 0.6 * 30 / 100 + 10 ** model.end_log10() == pytest.approx(1.0)
    assert 10 ** model.log10(5, -3.0) == pytest.approx((5 - 0.6) / 100 + 0.18 * 1e-3)


@pytest.mark.parametrize("frequent", [2, 65536])
def test_base_and_counts_by_brute_force(documents, edge, monkeypatch, frequent):
    monkeypatch.setattr(lattice, "FREQUENT", frequent)
    for frame in (documents, edge):
        rows = [(r["doc_id"], words_of(r["text"])) for r in frame.select("doc_id", "text").collect()]
        fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
        train = [w for i, w in rows if fold(i) != 2]
        c = Counter(w for words in train for w in words)
        c[None] = len(train)
        n, v = sum(c.values()), sum(x > 0 for x in c.values())
        want = sorted(
            (str(i), fold(i) == 2, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None]), 6))
            for i, w in rows
        )
        got = lattice.scores(frame).collect()
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["score"] < 0 for r in got)


def test_empty_table(empty):
    assert lattice.scores(empty).count() == 0
