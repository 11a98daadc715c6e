"""Language-model score by a subword lattice.

The vocabulary is that of an existing subword tokenizer. Its pieces get unigram probabilities from the corpus: the
tokenizer splits every distinct training word and pieces are counted as often as the word occurs. A word's lattice has
an arc for every piece that fits, and one for the whole word if training has it, weighted by its discounted relative
frequency; the discounted mass weights the segmentations into pieces. The forward recursion in log space sums all
segmentations. A text's probability is the product over its words and its end, because a piece begins at every word and
none crosses into the next. A character that is no piece is spelled by the tokenizer's byte pieces, so every text has a
probability.

Plan: words are counted per task and summed by word (every word of every text); each distinct word is scored once. A
text needs its words' counts and scores back: words with more than a 65,536th of all tokens (so fewer than 65,536 of
them) are sent to every task, and the rest, each at most once per text, are joined by word and summed by text. ``docs``
is stored data: rows are numbered by scan.

Defined cases: a null text is empty and consists of its end; a null id counts as empty text in the fold; without
training texts N is 0, the pieces are equally likely and a text ends after each word with probability 1/2; repeated rows get their own equal scores; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varicube.llm.common import checkpointed, crc_fold, slim_batches, utf8

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS, HELD_FOLD = 7, 2
SMOOTHING = 0.1
FREQUENT = 65_536
FLUSH_WORDS = 200_000
START = "▁"


class Vocabulary:
    """Pieces of a tokenizer file; ``proto`` travels with the tasks."""

    def __init__(self, path: str = MODEL_PATH):
        with open(path, "rb") as file:
            self.proto = file.read()
        tokenizer = self.tokenizer()
        size = tokenizer.get_piece_size()
        self.pieces = [tokenizer.id_to_piece(i) for i in range(size)]
        self.byte_ids = [i for i in range(size) if tokenizer.is_byte(i)]
        self.usable = [not (tokenizer.is_control(i) or tokenizer.is_unknown(i) or tokenizer.is_byte(i)) for i in range(size)]

    def tokenizer(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.proto)


class Lattice:
    """Marginal probability of words, given the natural log of each piece's probability."""

    def __init__(self, vocabulary: Vocabulary, log_p: list[float]):
        self.bytes_log_p = [log_p[i] for i in vocabulary.byte_ids]
        self.single: set[str] = set()
        self.automaton = ahocorasick.Automaton()
        for piece, usable, p in zip(vocabulary.pieces, vocabulary.usable, log_p):
            # A word starts with START and has no other, so pieces with START inside or alone in the middle never fit.
            if usable and START not in piece[1:]:
                self.automaton.add_word(piece, (len(piece), p))
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()

    def log10(self, word: str) -> float:
        text = START + word
        arcs: list[list[tuple[int, float]]] = [[] for _ in text]
        for last, arc in self.automaton.iter(text):
            arcs[last].append(arc)
        forward = [0.0] * (len(text) + 1)
        exp, log = math.exp, math.log
        for end, into in enumerate(arcs):
            ways = [forward[end + 1 - length] + p for length, p in into]
            if text[end] not in self.single:
                ways.append(forward[end] + sum(self.bytes_log_p[b] for b in text[end].encode("utf-8", "replace")))
            if len(ways) == 1:
                forward[end + 1] = ways[0]
            else:
                most = max(ways)
                forward[end + 1] = most + log(sum([exp(w - most) for w in ways]))
        return forward[-1] / math.log(10)


def _bags(batch: pa.RecordBatch) -> Iterator[Counter]:
    for text in utf8(batch.column("text")):
        yield Counter(text.lower().split())


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n (in all texts) and c (in training texts) for every distinct word; words are UTF-8 with A-Z in lower case."""
    rows = docs.select((crc_fold(F.col("doc_id"), FOLDS) != HELD_FOLD).alias("train"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, train = Counter(), Counter()

        def flushed() -> pa.RecordBatch:
            words = list(every)
            batch = pa.record_batch(
                [pa.array(words, pa.binary()).cast(pa.string()), pa.array([every[w] for w in words], pa.int64()), pa.array([train[w] for w in words], pa.int64())],
                ["word", "n", "c"],
            )
            every.clear()
            train.clear()
            return batch

        for batch in slim_batches(batches):
            for is_train, bag in zip(batch.column("train").to_pylist(), _bags(batch)):
                every.update(bag)
                if is_train:
                    train.update(bag)
            if len(every) > FLUSH_WORDS:
                yield flushed()
        yield flushed()

    return rows.mapInArrow(run, "word string, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def piece_log_p(counts: DataFrame, vocabulary: Vocabulary, smoothing: float = SMOOTHING) -> list[float]:
    """Natural log probabilities of the pieces, from the training words."""
    tokenizer_of = vocabulary.tokenizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, found = tokenizer_of(), Counter()
        for batch in batches:
            for ids, c in zip(tokenizer.encode(batch.column("word").to_pylist(), num_threads=1), batch.column("c").to_pylist()):
                for i in ids:
                    found[i] += c
        yield pa.record_batch([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["piece", "n"])

    counted = counts.where("c > 0").select("word", "c").mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    found = {r["piece"]: r["n"] for r in counted.collect()}  # one row per piece of the vocabulary
    size = len(vocabulary.pieces)
    total = sum(found.values()) + smoothing * size
    return [math.log((found.get(i, 0) + smoothing) / total) for i in range(size)]


@dataclass(frozen=True)
class WordModel:
    """Probability of a word: its own arc, discounted, plus the discounted mass times the sum over its pieces."""

    tokens: int
    ends: int
    distinct: int
    discount: float

    def log10(self, count: int, pieces: float) -> float:
        if not self.tokens:
            return pieces + math.log10(0.5)
        whole = max(count - self.discount, 0) / self.tokens
        share = self.discount * self.distinct / self.tokens or 0.5 / self.tokens
        by_pieces = pieces + math.log10(share)
        if not whole:
            return by_pieces
        most = max(math.log10(whole), by_pieces)
        return most + math.log10(10 ** (math.log10(whole) - most) + 10 ** (by_pieces - most))

    def end_log10(self) -> float:
        return math.log10((self.ends or 0.5) / self.tokens) if self.tokens else math.log10(0.5)


def scores(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    vocabulary = Vocabulary(path)
    counts = checkpointed(word_counts(docs))
    ends = docs.where(crc_fold(F.col("doc_id"), FOLDS) != HELD_FOLD).count()
    totals = counts.agg(
        F.sum("n").alias("n"), F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("distinct"),
        F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice"),
    ).first()
    train_tokens = (totals["c"] or 0) + ends
    base_total = train_tokens + (totals["distinct"] or 0) + (ends > 0) + 1
    log_p = piece_log_p(counts, vocabulary)
    # The usual estimate of the discount from words seen once and twice.
    discount = min(0.9, max(0.1, totals["once"] / (totals["once"] + 2 * totals["twice"]))) if totals["once"] else 0.5
    model = WordModel(train_tokens, ends, totals["distinct"] or 0, discount)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary, log_p)
        for batch in batches:
            values = [model.log10(c, lattice.log10(w)) for w, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist())]
            yield pa.record_batch([*batch.columns, pa.array(values, pa.float64())], ["word", "n", "c", "p"])

    words = checkpointed(counts.select("word", "n", "c").mapInArrow(score, "word string, n long, c long, p double"))
    frequent = {
        r["word"].encode(): (r["c"], r["p"]) for r in words.where(F.col("n") > (totals["n"] or 0) // FREQUENT).select("word", "c", "p").collect()
    }
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    base = {w: math.log10((c + 1) / base_total) for w, (c, _) in frequent.items()}
    end = (int(ends > 0), math.log10((ends + 1) / base_total), model.end_log10())

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim_batches(batches):
            out = []
            for bag in _bags(batch):
                n, known, b, p = 1, *end
                for word, tf in bag.items():
                    n += tf
                    if word in frequent:
                        c, word_p = frequent[word]
                        known += tf * (c > 0)
                        b += tf * base[word]
                        p += tf * word_p
                out.append((n, known, b, p))
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.record_batch(
                [batch.column("row"), batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["row", "doc_id", "n_tokens", "known", "base", "p"],
            )

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim_batches(batches, 4 << 20):
            rows, words_out, tfs = [], [], []
            for row, bag in zip(batch.column("row").to_pylist(), _bags(batch)):
                cold = [w for w in bag if w not in frequent]
                rows += [row] * len(cold)
                words_out += cold
                tfs += [bag[w] for w in cold]
            yield pa.record_batch(
                [pa.array(rows, pa.int64()), pa.array(words_out, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64())], ["row", "word", "tf"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    heads = numbered.mapInArrow(head, f"row long, doc_id {kind}, n_tokens long, known long, base double, p double")
    cold = numbered.select("row", "text").mapInArrow(rest, "row long, word string, tf long")
    tf = F.col("tf")
    sums = cold.join(words.select("word", "c", "p").hint("shuffle_hash"), "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, tf).otherwise(0)).alias("more_known"),
        F.sum(tf * F.log10((F.col("c") + 1) / F.lit(float(base_total)))).alias("more_base"),
        F.sum(tf * F.col("p")).alias("more_p"),
    )
    zero = F.lit(0)
    return heads.join(sums, "row", "left").select(
        "doc_id", (crc_fold(F.col("doc_id"), FOLDS) == HELD_FOLD).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"), F.lit(train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("p") + F.coalesce("more_p", F.lit(0.0))).alias("score"),
    )
