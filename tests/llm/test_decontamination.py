import pytest

from varicube.llm import decontamination as dec


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


def contained(text, item):
    words, wanted = dec.tokens(text or ""), dec.tokens(item)
    have = dec.shingles(words) if len(wanted) >= dec.SHINGLE else {tuple(words[i : i + len(wanted)]) for i in range(len(words))}
    need = dec.shingles(wanted)
    return len(need & have) / len(need) if need else 0


def test_matches_brute_force(documents, items):
    bench = [(r["item_id"], r["text"]) for r in items.collect()]
    want = {(r["doc_id"], i) for r in documents.collect() for i, t in bench if contained(r["text"], t) >= 0.8}
    got = {(r["doc_id"], r["item_id"]) for r in dec.hits(documents, items).collect()}
    assert want and got == want
    report = dec.report(documents, items).collect()
    assert len(report) == documents.count()
    assert {r["doc_id"] for r in report if r["contaminated"]} == {d for d, _ in want}
    assert {r["doc_id"] for r in dec.clean(documents, items).collect()} == {r["doc_id"] for r in report if not r["contaminated"]}


def test_block_bounds_lose_nothing(items):
    bench = [(r["item_id"], *dec.question_and_answer(r["text"])) for r in items.collect()]
    counts = {}
    for _, q, a in bench:
        for w in set(q + a):
            counts[w] = counts.get(w, 0) + 1
    part = dec.Part(bench, counts, len(bench), sum(len(q) + len(a) for _, q, a in bench) / len(bench))
    passage = sum((q for _, q, _ in bench[:3]), [])[: 2 * part.stride]
    ids = [part.number[w] for w in passage]
    runs = [set(ids[i : i + part.stride]) for i in range(0, len(ids), part.stride)]
    every = {}
    for left, right in zip(runs, [*runs[1:], set()]):
        if right or len(runs) == 1:
            scores = {}
            for (term, _), postings in part.postings.items():
                if term in left | right:
                    for place, impact in postings:
                        scores[place] = scores.get(place, 0) + impact
            for place, s in scores.items():
                every[place] = max(every.get(place, 0), s)
    for threshold in (0.1, 0.3, 0.6, 1.0):
        assert part.retrieve(ids, threshold) == pytest.approx({p: s for p, s in every.items() if s >= threshold - 1e-9})


def test_question_and_answer_must_both_be_there(spark):
    items = spark.createDataFrame([(1, "What is the name of the tall old tower by the river? It is called the lantern of the north")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "x " * 300 + "what is the NAME of the tall, old tower by the river? it is called the lantern of the north" + " y" * 300),
         (2, "What is the name of the tall old tower by the river? Nobody knows at all what it may be"), (3, "words only")],
        "doc_id long, text string",
    )
    assert {r["doc_id"] for r in dec.hits(docs, items).collect()} == {1}


def test_many_parts(documents, items, monkeypatch):
    whole = {(r["doc_id"], r["item_id"]) for r in dec.hits(documents, items).collect()}
    monkeypatch.setattr(dec, "PART_WORDS", 640)
    monkeypatch.setattr(dec, "PARTS_AT_ONCE", 2)
    original = dec.build
    monkeypatch.setattr(dec, "build", lambda frame: original(frame, 640))
    assert {(r["doc_id"], r["item_id"]) for r in dec.hits(documents, items).collect()} == whole


def test_edges(spark, edge, empty, items):
    assert dec.report(edge, items).count() == 10
    out = dec.clean(edge, items)
    assert out.columns == edge.columns and out.count() == 10
    assert dec.report(empty, items).count() == 0
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "x"), (3, "The same text of a few words here."), (3, "The same text of a few words here.")], "item_id long, text string")
    assert {r["doc_id"] for r in dec.hits(edge, odd).collect()} == {6, 7, 8}
    assert dec.hits(edge, odd.limit(0)).count() == 0 and dec.clean(edge, odd.limit(0)).count() == 10


def test_results_go_by_row(spark):
    item = "the little red boat sailed over the wide blue bay at noon"
    items = spark.createDataFrame([(7, item), (None, item)], "item_id long, text string")
    rows = [(None, f"yes {item} yes"), (None, "nothing to see in here at all"), (5, "a clean text of some plain words"), (5, item), (None, None), (6, "x " * 100_000 + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS matches", "2 AS item_id")
    got = [(r["doc_id"], r["contaminated"], r["n_items"], r["item_ids"], r["best_score"]) for r in dec.report(docs, items).collect()]
    hit, none = (True, 1, "7", pytest.approx(1.0)), (False, 0, "", None)
    want = [(None, *hit), (None, *none), (5, *none), (5, *hit), (None, *none), (6, *hit)]
    for row in want:
        got.remove(row)
    assert not got
    assert sorted(r["text"] or "" for r in dec.clean(docs, items).collect()) == sorted(rows[i][1] or "" for i in (1, 2, 4))


def test_invalid_bytes_are_replaced(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'616263FF20646566' AS STRING) AS text")
    items = spark.sql("SELECT 3L AS item_id, CAST(X'6162632064656620FF' AS STRING) AS text")
    assert [r["contaminated"] for r in dec.report(docs, items).collect()] == [True]
