import zlib

import numpy as np

from varicube.llm import quality


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r for r in quality.scores(docs, quality.fit(docs, labels)).collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in rows.items())
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    held = [(rows[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    good, bad = (np.array([s for s, q in held if q == k]) for k in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.9


def test_labels_outside_the_fold_do_not_matter(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()
    flipped = [(r["doc_id"], 1 - r["quality"] if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 else r["quality"]) for r in labels]
    plain = spark.createDataFrame([(r["doc_id"], r["quality"]) for r in labels], "doc_id long, quality int")
    changed = spark.createDataFrame(flipped, "doc_id long, quality int")
    assert quality.fit(documents, plain) == quality.fit(documents, changed)


def test_edges(spark, edge, empty, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(documents, labels)
    rows = quality.scores(edge, model).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    kept = quality.keep_good(edge, model)
    assert kept.columns == edge.columns
    assert kept.count() == sum(r["predicted"] for r in rows)
    assert quality.scores(empty, model).count() == 0 and quality.keep_good(empty, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.scores(edge, quality.fit(documents, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(50)] + [(60, None), (61, 0), (61, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.scores(edge, quality.fit(documents, ones)).collect()} == {1.0}
    assert quality.fit(empty, labels).constant == 0.5


def test_long_text_leans_on_the_dictionaries():
    good, bad = (quality.Sizes(quality.train_dictionary([text] * 20)) for text in (b"fine prose of calm words ", b"$$$ %%% !!! &&& ###"))
    assert quality.evidence(good, bad, b"fine prose of calm words " * 5000)[0] > 0
    assert quality.evidence(good, bad, b"") == (0.0, 0.0)
