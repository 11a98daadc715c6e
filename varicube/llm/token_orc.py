"""Token ids of documents in ORC files.

Documents are range-partitioned by id, encoded in that order and written by Spark's ORC writer: one row per document with
its id, the ids of its text and its place in the file. ORC stores integers run-length encoded, in stripes that tasks read
independently, with an index of every ``ROW_STRIDE`` rows and a Bloom filter on the document id, so a look-up skips the
files, stripes and row groups that cannot hold the wanted ids. A file's name carries its number; earlier files' sums
turn places in a file into places in the corpus.

Words are encoded, not texts: the tokenizer drops white space and no token of it crosses white space, so the ids of a text
are those of its words (runs without space or line feed) in order. A task encodes a batch's distinct words once and keeps a
bounded cache. The mark between words of such a batch is a control character; a word that holds it is encoded alone.
Words of Latin letters are one pre-token of this tokenizer, so they go to its model directly; a sentence mark after a
letter or digit is a pre-token of its own and is cut off first.
``word_wise=False`` is for tokenizers without that property: it encodes each text by one call.

Defined cases: a null text is empty and gives only the end id; rows without an id come first; rows with the same id
stand next to each other in any order (equal rows are interchangeable); a hot id is split over partitions, since a hash
of the text and the row's place break ties; an empty table gives an empty result; extra columns are ignored. A text of
any length is one row; memory in a task grows with its longest text. Invalid UTF-8 is read with replacement characters.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varicube.llm.common import slim_batches, work_folder

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
ROW_STRIDE = 1_000
STRIPE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
CACHE_WORDS = 600_000
LONG_WORD = 64
WORDS_A_CALL = 5_000
SENTENCE_MARKS = ".,;:!?"
MARK = "\x01"
SCHEMA = "doc_id long, row long, first long, n_tokens long, ids array<int>"


class Encoder:
    """Texts to ids by a tokenizer file's JSON; one per Python worker."""

    def __init__(self, definition: str, end_id: int = END_ID, word_wise: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.word_wise = Tokenizer.from_str(definition), np.uint32(end_id), word_wise
        self.cache: dict[str, bytes] = {"": b""}
        self.mark = self._ids(MARK) if word_wise else None
        self.marks = {m: self._ids(m).tobytes() for m in SENTENCE_MARKS} if word_wise else {}
        self.letters = self._latin() if word_wise else {}

    def _latin(self) -> dict[int, str]:
        """Latin letters (NFC leaves them alone) as the model sees them, taken from the tokenizer's own pre-tokenizer."""
        letters = [c for c in map(chr, range(0x250)) if c.isalpha() and c.lower() == c]
        seen = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c) for c in letters}
        table = {c: pieces[0][0] for c, pieces in seen.items() if len(pieces) == 1}
        every = "".join(map(chr, table))
        whole = self.tokenizer.pre_tokenizer.pre_tokenize_str(every)
        return table if len(whole) == 1 and whole[0][0] == every.translate(table) else {}

    def _word(self, word: str) -> bytes | None:
        """Ids of a word of Latin letters, perhaps with a sentence mark behind it; None for other words."""
        if len(word) > 1 and word[-1] in self.marks and word[-2].isalnum():
            rest = word[:-1]
            known = self.cache.get(rest) or self._word(rest) or self._ids(rest).tobytes()
            return known + self.marks[word[-1]]
        lowered = word.lower()
        if not lowered.isalpha() or max(lowered) >= "\u0250" or len(word) > LONG_WORD or not self.letters:
            return None
        found = [token.id for token in self.tokenizer.model.tokenize(lowered.translate(self.letters))]
        return struct.pack(f"<{len(found)}I", *found)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that the cache lacks, as bytes."""
        known = {w: ids for w in words if (ids := self._ids(w).tobytes() if MARK in w else self._word(w)) is not None}
        others = [w for w in words if w not in known]
        for at in range(0, len(others), WORDS_A_CALL):
            plain = others[at : at + WORDS_A_CALL]
            joined = f" {MARK} ".join(plain)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids)).tolist()
            if len(self.mark) != 1 or len(ends) != len(plain):
                raise ValueError("the mark between words is no token of its own in this tokenizer")
            raw, begin = ids.tobytes(), 0
            for word, end in zip(plain, ends):
                known[word] = raw[4 * begin : 4 * end]
                begin = end + 1
        return known

    def _lookup(self, words: list[str]) -> list[bytes]:
        found = list(map(self.cache.get, words))
        missing = [w for w, ids in zip(words, found) if ids is None]
        if not missing:
            return found
        new = self._learn(missing)
        if len(self.cache) < CACHE_WORDS:  # frequent words come early
            self.cache.update((w, ids) for w, ids in new.items() if len(w) <= LONG_WORD)
        return [new[w] if ids is None else ids for w, ids in zip(words, found)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, end ids included, and each text's number of ids."""
        if not self.word_wise:
            each = [np.append(self._ids(t), self.end) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.array([len(e) for e in each], dtype=np.int64)
        split = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        pieces = self._lookup(words.dictionary.to_pylist())
        table = np.frombuffer(b"".join([*pieces, self.end.tobytes()]), dtype="<u4")
        sizes = np.array([len(p) // 4 for p in pieces] + [1], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        per_text = np.diff(split.offsets.to_numpy())
        index = np.insert(words.indices.to_numpy(), np.cumsum(per_text), len(pieces))  # each text's last word is the end
        lengths = sizes[index]
        place = np.cumsum(lengths) - lengths
        ids = table[np.repeat(starts[index] - place, lengths) + np.arange(lengths.sum())]
        bounds = np.cumsum(per_text + 1)
        counts = np.diff(np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], bounds])])
        return ids, counts


_encoders: dict[tuple, Encoder] = {}


def _encoder(*key) -> Encoder:
    """The worker's encoder; its cache serves all tasks of the worker."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def write_ids(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, word_wise: bool = True,
    stripe_bytes: int = STRIPE_BYTES, row_stride: int = ROW_STRIDE,
) -> None:
    """Encode ``docs`` (doc_id, text) with the tokenizer file and write ``folder`` in ascending order of doc_id."""
    with open(tokenizer or public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        definition = file.read()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumns(
        {"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()}
    )
    ordered = rows.repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition, end_id, word_wise)
        row = first = 0
        for batch in slim_batches(batches, BATCH_BYTES):
            texts = batch.column("text")
            try:
                texts.validate(full=True)
            except pa.ArrowInvalid:
                decoded = [b.decode(errors="replace") for b in texts.cast(pa.large_binary()).to_pylist()]
                texts = pa.array(decoded, pa.large_string())
            ids, counts = encoder.encode(texts)
            ends = np.cumsum(counts)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
            columns = [
                batch.column("doc_id"), pa.array(np.arange(row, row + len(counts))), pa.array(first + ends - counts),
                pa.array(counts.astype(np.int64)), lists,
            ]
            row, first = row + len(counts), first + int(counts.sum())
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "first", "n_tokens", "ids"])

    encoded = ordered.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
    options = {
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
        "orc.row.index.stride": str(row_stride), "orc.stripe.size": str(stripe_bytes), "compression": "zstd",
    }
    encoded.write.options(**options).orc(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, file (its number), row, first (ids before it in the file), n_tokens, ids; stripes are read in parallel."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    return spark.read.schema(SCHEMA).orc(folder).select("doc_id", number.alias("file"), "row", "first", "n_tokens", "ids")


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; the filter reaches the files' statistics, row indexes and Bloom filters."""
    return read_ids(spark, folder).where(F.col("doc_id").isin([int(i) for i in doc_ids]))


def starts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, before): ids in all earlier files. One row per file, so its running sum is short."""
    totals = read_ids(spark, folder).groupBy("file").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, file, first, n_tokens and ids_crc32 of what was read; ids count as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values, bounds = lists.flatten().to_numpy().astype("<u4"), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            counts = pa.array(np.diff(bounds).astype(np.int64))
            columns = [batch.column("doc_id"), batch.column("file"), batch.column("first"), counts, pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "file", "first", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "file", "first", "ids").mapInArrow(run, "doc_id long, file long, first long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write ``docs`` and describe every document from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or work_folder(spark, "token-ids")
    write_ids(docs, folder, **options)
    joined = digests(read_ids(spark, folder)).join(starts(spark, folder), "file")
    return joined.select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
