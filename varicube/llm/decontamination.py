"""Benchmark decontamination: a BM25 index of the test items, searched by every passage of every training text.

The index. Words are lower-cased runs of letters and digits. An item's word has the impact idf * tf-part / self, where
self is the item's score against its own words, so 1 means that a passage holds every word of the item. Items are laid
out by self-score in blocks of ``BLOCK``; each word keeps its largest impact overall and per block.

The search is WAND with block maxima. A passage's words are looked up; where their largest impacts add up to less than
``threshold`` no item can reach it and the passage is done. Else the block maxima of its words are added up, blocks below
the threshold are skipped, and only the postings in the remaining blocks are scored. All items at or above the threshold are
retrieved. An item of n words is searched with passages of twice the next power of two (64 at least) that overlap by
half, so an item lies in one passage wherever a text holds it.

Verification: of an item's question and of its answer (the part after a question mark or a word such as "answer:"; none
otherwise), ``overlap`` of the five-word shingles must be in the text.

The test set may be of any size: items are dealt to parts of bounded words, and texts are passed once for each
``PARTS_AT_ONCE`` parts; only those parts are sent to the tasks. Idf uses counts over all items.

Defined cases: null and empty texts and items match nothing; a question or answer of fewer than five words is one
shingle; repeated item ids are joined into one row per (id, text); repeated documents, and rows without an id,
each get their own result; an item without an id is found and not listed; invalid UTF-8 is replaced; empty tables give no match; extra columns pass through ``clean``.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from varicube.llm.common import checkpointed, slim_batches, utf8

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 8
PART_WORDS = 1 << 16
PARTS_AT_ONCE = 16
SHORTEST_CLASS = 64

_word = re.compile(r"[^\W_]+").findall
_answer = re.compile(r"\?|\b(?:answer|réponse|antwort|respuesta)\s*:", re.IGNORECASE)


def tokens(text: str) -> list[str]:
    return _word(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words before and after the last mark of an answer; all are the question if nothing would be left on a side."""
    marks = list(_answer.finditer(text))
    for mark in reversed(marks):
        question, answer = tokens(text[: mark.end()]), tokens(text[mark.end() :])
        if question and answer:
            return question, answer
    return tokens(text), []


def shingles(ids: list[int]) -> set[tuple[int, ...]]:
    if not ids:
        return set()
    return set(zip(*[ids[k:] for k in range(min(SHINGLE, len(ids)))]))


class Part:
    """A bounded part of the index: items of one length class."""

    def __init__(self, items: list[tuple[int, list[str], list[str]]], document_counts: dict[str, int], n_items: int, mean_length: float):
        self.stride = max(SHORTEST_CLASS, 1 << (max(len(q) + len(a) for _, q, a in items) - 1).bit_length())
        impacts = []
        for item_id, question, answer in items:
            counts = Counter(question + answer)
            length = sum(counts.values())
            scores = {
                w: math.log(1 + (n_items - document_counts[w] + 0.5) / (document_counts[w] + 0.5))
                * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
                for w, tf in counts.items()
            }
            whole = sum(scores.values())
            impacts.append((whole, item_id, question, answer, {w: s / whole for w, s in scores.items()}))
        impacts.sort(key=lambda x: (x[0], str(x[1])))
        self.number: dict[str, int] = {}
        for _, _, _, _, scores in impacts:
            for w in scores:
                self.number.setdefault(w, len(self.number))
        blocks = -(-len(impacts) // BLOCK)
        self.in_block = np.zeros((len(self.number), blocks), dtype=np.float32)
        self.postings: dict[tuple[int, int], list[tuple[int, float]]] = defaultdict(list)
        self.items = []
        for place, (_, item_id, question, answer, scores) in enumerate(impacts):
            coded = [[self.number[w] for w in side] for side in (question, answer)]
            self.items.append((item_id, shingles(coded[0]), shingles(coded[1]), len(coded[0]), len(coded[1])))
            for w, impact in scores.items():
                number, block = self.number[w], place // BLOCK
                self.in_block[number, block] = max(self.in_block[number, block], impact * (1 + 1e-6))
                self.postings[number, block].append((place, impact))
        self.postings = dict(self.postings)
        self.most = self.in_block.max(axis=1).astype(float).tolist()

    def retrieve(self, ids: list[int], threshold: float) -> dict[int, float]:
        """Places of the items that a passage of the text reaches, with their largest score. ``ids``: -1 for other words."""
        stride, most = self.stride, self.most
        runs = [set(ids[i : i + stride]) for i in range(0, len(ids), stride)] or [set()]
        found: dict[int, float] = {}
        for left, right in zip(runs, [*runs[1:], set()]):
            if not right and len(runs) > 1:
                continue
            passage = left | right
            passage.discard(-1)
            if sum(map(most.__getitem__, passage)) < threshold:
                continue
            terms = list(passage)
            for block in np.flatnonzero(self.in_block[terms].sum(axis=0) >= threshold):
                scores: dict[int, float] = defaultdict(float)
                for term in terms:
                    for place, impact in self.postings.get((term, int(block)), ()):
                        scores[place] += impact
                for place, score in scores.items():
                    if score >= threshold - 1e-9:
                        found[place] = max(found.get(place, 0.0), score)
        return found

    def matches(self, words: list[str], threshold: float, overlap: float) -> list[tuple[int, float, float, float]]:
        """(item id, BM25 share, question overlap, answer overlap) of the verified items."""
        get = self.number.get
        ids = [get(w, -1) for w in words]
        found, out = self.retrieve(ids, threshold), []
        # Of the text's shingles only those of the retrieved items are kept, so a long text needs no more memory.
        wanted: dict[int, set] = defaultdict(set)
        for place in found:
            _, question, answer, q_words, a_words = self.items[place]
            wanted[min(SHINGLE, q_words)] |= question
            wanted[min(SHINGLE, a_words)] |= answer
        there = {k: wanted[k].intersection(zip(*[islice(ids, i, None) for i in range(k)])) for k in wanted}
        for place, score in found.items():
            item_id, question, answer, q_words, a_words = self.items[place]
            sides = ((question, min(SHINGLE, q_words)), (answer, min(SHINGLE, a_words)))
            shares = [len(side & there[k]) / len(side) if side else 1.0 for side, k in sides]
            if min(shares) >= overlap:
                out.append((item_id, score, *shares))
        return out


def build(items: DataFrame, part_words: int = PART_WORDS) -> Iterator[Part]:
    """The index, part by part; ``items`` has item_id and text."""
    rows = checkpointed(items.select("item_id", "text").where("text is not null").distinct())
    kind = items.schema["item_id"].dataType.simpleString()

    def split(batches):
        for batch in batches:
            sides = [question_and_answer(t.decode("utf-8", "replace")) for t in utf8(batch.column("text"))]
            yield pa.record_batch(
                [batch.column("item_id"), pa.array([q for q, _ in sides], pa.list_(pa.string())), pa.array([a for _, a in sides], pa.list_(pa.string()))],
                ["item_id", "question", "answer"],
            )

    coded = rows.mapInArrow(split, f"item_id {kind}, question array<string>, answer array<string>")
    coded = coded.withColumn("n", F.size("question") + F.size("answer")).where("n > 0")
    coded = checkpointed(
        coded.withColumn("length", F.greatest(F.lit(SHORTEST_CLASS), F.pow(2, F.ceil(F.log2("n")))).cast("bigint"))
        .withColumn("place", F.xxhash64("item_id", "question", "answer"))
    )
    totals = coded.agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean")).first()
    if not totals["n"]:
        return
    counts = checkpointed(
        coded.select(F.explode(F.array_distinct(F.concat("question", "answer"))).alias("word")).groupBy("word").count()
    )
    for (length,) in sorted(coded.select("length").distinct().collect()):
        own = coded.where(F.col("length") == length)
        n = own.count()
        # All items of a class have at most ``length`` words, which bounds every part.
        per_part = max(1, part_words // length)
        parts = -(-n // per_part)
        for part in range(parts):
            members = own.where(F.pmod("place", F.lit(parts)) == part)
            words = members.select(F.explode(F.concat("question", "answer")).alias("word")).distinct()
            known = {r["word"]: r["count"] for r in counts.join(words, "word").collect()}
            dealt = [(r["item_id"], r["question"], r["answer"]) for r in members.collect()]
            if dealt:
                yield Part(dealt, known, totals["n"], totals["mean"])


def _groups(parts: Iterator[Part]) -> Iterator[list[Part]]:
    group: list[Part] = []
    for part in parts:
        group.append(part)
        if len(group) == PARTS_AT_ONCE:
            yield group
            group = []
    if group:
        yield group


def matched(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """Each document row with its verified items: doc_id, matches (item_id, score, question_overlap, answer_overlap).

    Matches are gathered row by row, so rows without an id, or with one id, do not get each other's.
    """
    found = StructType([
        StructField("item_id", items.schema["item_id"].dataType), *[StructField(c, DoubleType()) for c in ("score", "question_overlap", "answer_overlap")]
    ])
    rows = docs.select("doc_id", "text", F.array().cast(ArrayType(found)).alias("matches"))
    kind = to_arrow_type(ArrayType(found))
    for group in _groups(build(items)):

        def run(batches, group=group):
            for batch in slim_batches(batches):
                lists = batch.column("matches").to_pylist()
                for at, text in enumerate(utf8(batch.column("text"))):
                    words = tokens(text.decode("utf-8", "replace"))
                    new = [match for part in group for match in part.matches(words, threshold, overlap)]
                    lists[at] = (lists[at] or []) + [dict(zip(found.names, match)) for match in new]
                yield pa.record_batch([batch.column("doc_id"), batch.column("text"), pa.array(lists, kind)], ["doc_id", "text", "matches"])

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select("doc_id", "matches")


def hits(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """One row per verified pair of document row and item: doc_id, item_id, score, question_overlap, answer_overlap."""
    return matched(docs, items, threshold, overlap).select("doc_id", F.inline("matches"))


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document row: doc_id, contaminated, n_items, item_ids (ascending, comma-joined), best_score."""
    ids = F.array_sort(F.array_distinct(F.array_compact("matches.item_id")))
    return matched(docs, items, **options).select(
        "doc_id", (F.size("matches") > 0).alias("contaminated"), F.size(ids).cast("bigint").alias("n_items"),
        F.array_join(ids.cast("array<string>"), ",").alias("item_ids"), F.array_max("matches.score").alias("best_score"),
    )


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns."""
    for group in _groups(build(items)):

        def run(batches, group=group):
            for batch in slim_batches(batches):
                words = [tokens(text.decode("utf-8", "replace")) for text in utf8(batch.column("text"))]
                yield batch.filter(pa.array([not any(part.matches(w, threshold, overlap) for part in group) for w in words], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
