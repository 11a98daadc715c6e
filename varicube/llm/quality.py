"""Quality classifier by compression: which of two dictionaries, of good or of bad text, shortens a text more?

A zstandard dictionary is trained on good and one on bad labelled text. A text is compressed in pieces of ``CHUNK``
bytes with both, so a long text keeps leaning on the dictionaries and not on itself; the sizes add up over the whole
text. The evidence is the size difference over the sum, and a logistic curve fitted on labelled texts that are in
neither dictionary turns it into the probability of label 1. The curve also sees how far the text shrinks at all,
because a text that repeats itself shrinks alike with both dictionaries.

The fit takes a bounded sample: in the order of a seeded hash, at most ``PER_CLASS`` whole texts and ``CLASS_BYTES`` bytes
a class for the dictionaries and ``CALIBRATION`` texts and as many bytes for the curve. Scoring is one pass without a
shuffle.

Defined cases: null and empty texts have no evidence (difference 0, ratio 1) and get the curve's value there; a
document whose label rows disagree, or whose label is null, is not learned from; with one class only, the score is
that class's label, without labels 0.5; equal texts get equal scores; an empty table gives an empty result; extra
columns are never inputs and pass through ``keep_good``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varicube.llm.common import checkpointed, crc_fold, slim_batches, utf8

LEVEL = 3
CHUNK = 1024
DICTIONARY_BYTES = 112_640
PER_CLASS = 3_000
CLASS_BYTES = 12 << 20
CALIBRATION = 6_000
THRESHOLD = 0.3
FOLDS, HELD_FOLD = 5, 0
SEED = 17


def _pieces(text: bytes, length: int) -> list[bytes]:
    return [text[i : i + length] for i in range(0, len(text), length)]


def train_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    samples = [piece for text in texts for piece in _pieces(text, 2048)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[:DICTIONARY_BYTES]


class Sizes:
    """Compressed size of texts with one dictionary."""

    def __init__(self, dictionary: bytes):
        content = zstandard.ZstdCompressionDict(dictionary)
        content.precompute_compress(level=LEVEL)
        self._compressor = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    def of(self, text: bytes) -> int:
        return sum(len(self._compressor.compress(piece)) for piece in _pieces(text, CHUNK))


def evidence(good: Sizes, bad: Sizes, text: bytes) -> tuple[float, float]:
    """The normalised size difference (above 0: nearer to good text) and the log of the compression ratio."""
    if not text:
        return 0.0, 0.0
    with_good, with_bad = good.of(text), bad.of(text)
    return (with_bad - with_good) / (with_bad + with_good), math.log((with_good + with_bad) / (2 * len(text)))


def _terms(points: np.ndarray) -> np.ndarray:
    difference, ratio = points[:, 0], points[:, 1]
    return np.column_stack([np.ones(len(points)), 10 * difference, ratio, ratio**2, 10 * difference * ratio])


def fit_curve(points: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    x, weights = _terms(points), np.zeros(5)
    penalty = ridge * np.diag([1e-3, 1, 1, 1, 1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, x.T @ (labels - p) - penalty @ weights)
        weights = weights + step
        if np.abs(step).max() < 1e-9:
            break
    return weights


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    constant: float | None = None

    def scorer(self):
        if self.constant is not None:
            return lambda texts: np.full(len(texts), self.constant)
        good, bad, weights = Sizes(self.good), Sizes(self.bad), np.array(self.weights)

        def score(texts: list[bytes]) -> np.ndarray:
            points = np.array([evidence(good, bad, text) for text in texts]).reshape(-1, 2)
            return 1 / (1 + np.exp(-np.clip(_terms(points) @ weights, -30, 30)))

        return score


def _within(rows: list, rows_most: int, bytes_most: int) -> list:
    chosen, used = [], 0
    for row in rows:
        if len(chosen) < rows_most and used + row["bytes"] <= bytes_most:
            chosen.append(row)
            used += row["bytes"]
    return chosen


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES, calibration: int = CALIBRATION) -> QualityModel:
    """Learn from the labelled documents outside the held-out fold; the texts fetched are bounded by the parameters."""
    agreed = labels.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most")).where("label = most")
    learnt = docs.where(crc_fold(F.col("doc_id"), FOLDS) != HELD_FOLD).select("doc_id", F.octet_length("text").alias("bytes"))
    pool = checkpointed(
        learnt.join(agreed, "doc_id").where("bytes > 0")
        .select("doc_id", "label", "bytes", F.xxhash64(F.lit(SEED), "doc_id").alias("place"))
        .withColumn("for_curve", F.pmod("place", F.lit(2)) == 0)
    )

    def draw(rows: DataFrame, most: int) -> list:
        return _within(rows.orderBy("place", "doc_id", "bytes").limit(most).collect(), most, class_bytes)

    chosen = {label: draw(pool.where(~F.col("for_curve") & (F.col("label") == label)), per_class) for label in (0, 1)}
    curve = draw(pool.where("for_curve"), calibration)
    if not chosen[0] or not chosen[1]:
        present = [label for label in (0, 1) if chosen[label]]
        return QualityModel(b"", b"", (), float(present[0]) if present else 0.5)
    ids = {row["doc_id"] for row in [*chosen[0], *chosen[1], *curve]}
    wanted = docs.sparkSession.createDataFrame([(i,) for i in sorted(ids)], "doc_id long")  # at most 2 per_class + calibration ids
    texts = {r["doc_id"]: r["text"].encode() for r in docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").where("text is not null").collect()}
    good, bad = (train_dictionary([texts[r["doc_id"]] for r in chosen[label]]) for label in (1, 0))
    sizes = Sizes(good), Sizes(bad)
    used = curve or [*chosen[0], *chosen[1]]
    points = np.array([evidence(*sizes, texts[r["doc_id"]]) for r in used])
    return QualityModel(good, bad, tuple(fit_curve(points, np.array([r["label"] for r in used], dtype=float))))


def scores(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = docs.select("doc_id", (crc_fold(F.col("doc_id"), FOLDS) == HELD_FOLD).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in slim_batches(batches):
            values = score(utf8(batch.column("text")))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(values, pa.float64()), pa.array((values >= threshold).astype("int32"))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in slim_batches(batches):
            yield batch.filter(pa.array(score(utf8(batch.column("text"))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
