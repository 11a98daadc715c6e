import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from varicube.llm import token_orc

LIBRARY = Tokenizer.from_file(public_tokenizers.path(token_orc.TOKENIZER))
DEFINITION = open(public_tokenizers.path(token_orc.TOKENIZER), encoding="utf-8").read()
ENCODER = token_orc.Encoder(DEFINITION)


def whole(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [token_orc.END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


PARTS = st.sampled_from(
    ["a", "It's", "don't", "ß", "é", "é", "́", "ΑΣ", "σ.", "İ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", " ", "\xa0", "\x00",
     "\x01", " \x01 ", "<|endoftext|>", "<|startoftext|> x", "123", "4.5", "?!", ".", ",'s", "日本", "\U0001f600", "가", "ﬁ", "word", "Straße.", "Été!", "ŉ", "İx", "ǅ:", "x2;"]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(PARTS, st.text(max_size=4)), max_size=12).map("".join), min_size=1, max_size=5))
def test_words_give_the_ids_of_whole_texts(texts):
    texts = [t for t in texts if "\ud800" > max(t, default="") or t.encode(errors="ignore").decode() == t]
    ids, counts = ENCODER.encode(pa.array(texts, pa.string()))
    assert counts.tolist() == [len(whole(t)) for t in texts]
    assert ids.tolist() == [i for t in texts for i in whole(t)]


def brute(rows):
    expected, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole(text)
        expected.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return expected


def places(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_documents_by_brute_force(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert places(token_orc.report(documents)) == brute(rows)


def test_edges(edge):
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    assert places(token_orc.report(edge)) == brute(rows)


def test_text_by_text_gives_the_same(edge):
    assert places(token_orc.report(edge, word_wise=False)) == places(token_orc.report(edge))


def test_hot_id_and_small_cache(spark, monkeypatch):
    monkeypatch.setattr(token_orc, "CACHE_WORDS", 3)
    frame = spark.createDataFrame([(7, f"text {i} of many words here") for i in range(300)] + [(None, None)] * 20, "doc_id long, text string")
    found = places(token_orc.report(frame))
    starts = [r[1] for r in found]
    sizes = [r[2] for r in found]
    assert starts == [sum(sizes[:i]) for i in range(len(sizes))] and [r[0] for r in found] == [None] * 20 + [7] * 300
    assert sorted(r[3] for r in found) == sorted([crc(whole(f"text {i} of many words here")) for i in range(300)] + [crc([2])] * 20)


def test_empty(empty):
    assert token_orc.report(empty).collect() == []


def test_invalid_utf8_is_replaced(spark):
    frame = spark.sql("SELECT 1L AS doc_id, CAST(unhex('61FF62') AS STRING) AS text")
    assert places(token_orc.report(frame)) == brute([(1, "a�b")])


def test_stripes_are_read_in_parallel_and_lookups_skip(spark, tmp_path):
    folder = str(tmp_path / "ids")
    frame = spark.range(0, 30_000, 2).selectExpr("id AS doc_id", "concat('w', id, ' some text of this row ', hex(id * 7919)) AS text").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        token_orc.write_ids(frame, folder, stripe_bytes=64 << 10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(list(Path(folder).glob("*.orc"))) == 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        per_task = token_orc.read_ids(spark, folder).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(n > 0 for n in per_task) > 2 and sum(per_task) == 15_000

    def scanned(ids):
        found = token_orc.lookup(spark, folder, ids)
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan()
        return rows, plan.collectLeaves().head().metrics().apply("numOutputRows").value()

    rows, read = scanned([20_000])
    assert [r["doc_id"] for r in rows] == [20_000] and rows[0]["ids"] == whole("w20000 some text of this row " + format(20_000 * 7919, "X"))
    assert read <= 2 * token_orc.ROW_STRIDE
    rows, read = scanned([20_001])  # inside the range of its stripe, but in no document: the Bloom filter knows
    assert rows == [] and read <= token_orc.ROW_STRIDE


def test_unfit_tokenizer_is_refused():
    class Two:
        def encode(self, text, add_special_tokens):
            return type("E", (), {"ids": [1, 2]})()

        def encode_batch_fast(self, texts, add_special_tokens):
            return [self.encode(t, False) for t in texts]

    encoder = token_orc.Encoder(DEFINITION)
    encoder.tokenizer, encoder.mark = Two(), np.array([1, 2], dtype="<u4")
    with pytest.raises(ValueError, match="mark"):
        encoder.encode(pa.array(["1a 2b"]))
