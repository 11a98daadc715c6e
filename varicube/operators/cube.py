"""Category expansion and counting."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varicube.domain import DIMENSIONS, CategoryDomain, is_redundant

ARRAY_DIMENSIONS = dict(zip(("vt", "gs", "fs", "gc", "fa"), DIMENSIONS))
TERM_ARRAYS = tuple(ARRAY_DIMENSIONS)
DENSE_CELLS = 1 << 22
#: Bits used of a BIGINT word.
WORD_BITS = 62
#: Signatures whose categories a task remembers.
MOST_KNOWN = 100_000


def signatures(variants: DataFrame, keys: list[str]) -> DataFrame:
    """Variants with identical term arrays (within ``keys``) collapsed to one row and its multiplicity.

    Partial aggregation runs before the shuffle, so a sample that owns a third of all variants sends at
    most its distinct signatures from each task.
    """
    return variants.groupBy(*keys, *TERM_ARRAYS).agg(F.count(F.lit(1)).alias("n"))


def _places(domain: CategoryDomain) -> list[tuple[str, str, str, int, int]]:
    """(array, dimension, term, word, bit) of every term: its place in the words of a packed signature."""
    terms = [(a, d, t) for a, d in ARRAY_DIMENSIONS.items() for t in domain.terms[d]]
    return [(a, d, t, i // WORD_BITS, i % WORD_BITS) for i, (a, d, t) in enumerate(terms)]


def _words(domain: CategoryDomain) -> list[str]:
    return [f"_w{i}" for i in range(_places(domain)[-1][3] + 1)]


def packed_signatures(variants: DataFrame, domain: CategoryDomain, keys: list[str]) -> DataFrame:
    """``signatures`` with the term arrays as bits of a few BIGINT words, which is what travels through shuffles."""
    bits: dict[int, list] = {}
    for array, _, term, word, bit in _places(domain):
        bits.setdefault(word, []).append(F.when(F.array_contains(array, term), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint"))
    words = [reduce(lambda x, y: x.bitwiseOR(y), own).alias(name) for own, name in zip(bits.values(), _words(domain))]
    return variants.select(*keys, *words).groupBy(*keys, *_words(domain)).agg(F.count(F.lit(1)).alias("n"))


def expand(packed: DataFrame, domain: CategoryDomain, keys: list[str]) -> DataFrame:
    """One row per category of each packed signature: ``keys``, ``code`` and ``n``.

    Every signature has a term in each dimension, so explode_outer equals explode; it keeps Catalyst from adding a filter
    on each array's size. Terms are already integers, scaled to the dimension's place in the category code. Redundant
    pairs only involve the first three exploded dimensions, so they are dropped before the remaining two multiply the rows.
    """
    position = {d: {t: i for i, t in enumerate(domain.terms[d])} for d in DIMENSIONS}
    listed: dict[str, list] = {}
    for array, dimension, term, word, bit in _places(domain):
        place = F.lit(position[dimension][term] * domain.stride(dimension)).cast("bigint")
        listed.setdefault(array, []).append(F.when(F.col(f"_w{word}").bitwiseAND(F.lit(1 << bit)) != 0, place))
    rows = packed.select(*keys, "n", *[F.array_compact(F.array(*places)).alias(array) for array, places in listed.items()])
    for array in ("vt", "gs", "gc"):
        rows = rows.withColumn(array, F.explode_outer(array))
    prefix = F.col("vt") + F.col("gs") + F.col("gc")
    rows = rows.select(*keys, "n", prefix.alias("prefix"), "fs", "fa")
    rows = rows.where(~F.col("prefix").isin(domain.redundant_prefixes()))
    for array in ("fs", "fa"):
        rows = rows.withColumn(array, F.explode_outer(array))
    return rows.select(*keys, (F.col("prefix") + F.col("fs") + F.col("fa")).alias("code"), "n")


def _signature_codes(domain: CategoryDomain):
    """Function from the words of a packed signature to the codes of its categories; the same rule as ``expand``."""
    position = {d: {t: i for i, t in enumerate(domain.terms[d])} for d in DIMENSIONS}
    listed: dict[str, list] = {}
    for array, dimension, term, word, bit in _places(domain):
        listed.setdefault(array, []).append((word, bit, position[dimension][term] * domain.stride(dimension)))
    redundant = np.array(domain.redundant_prefixes(), dtype=np.int64)

    def codes(words) -> np.ndarray:
        vt, gs, fs, gc, fa = (
            np.array([place for word, bit, place in listed[a] if int(words[word]) >> bit & 1], dtype=np.int64) for a in TERM_ARRAYS
        )
        prefix = np.add.outer(np.add.outer(vt, gs), gc).ravel()
        prefix = prefix[~np.isin(prefix, redundant)]
        return np.add.outer(np.add.outer(prefix, fs), fa).ravel()

    return codes


def sample_rows(variants: DataFrame, domain: CategoryDomain, sample: str = "SAMPLE", also: tuple[str, ...] = ()) -> DataFrame:
    """One row per sample: its categories and their counts, (sample, also, codes, counts), codes ascending.

    A sample's distinct signatures meet, sorted, in one task before they become categories; category rows, some forty
    times as many, are added up where they arise and never shuffled. A sample has at most the signatures of the domain,
    however many variants it owns. A batch's last sample waits for the next batch, which may continue it. All variants of
    a sample have the same values in the columns ``also``.
    """
    words = _words(domain)
    met = packed_signatures(variants, domain, [sample, *also]).repartition(sample).sortWithinPartitions(sample)
    codes_of, size = _signature_codes(domain), domain.size

    def added(batch: pa.RecordBatch, owner: np.ndarray, names: pa.Array, known: dict) -> pa.RecordBatch:
        packed = np.column_stack([batch.column(w).to_numpy() for w in words])
        distinct, which = np.unique(packed, axis=0, return_inverse=True)
        if len(known) > MOST_KNOWN:
            known.clear()
        lists = [known[k] if (k := tuple(row)) in known else known.setdefault(k, codes_of(k)) for row in distinct.tolist()]
        lengths = np.array([len(c) for c in lists])[which.reshape(-1)]
        starts = (np.cumsum([0, *map(len, lists)])[:-1])[which.reshape(-1)]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)
        key = np.repeat(owner.astype(np.int64) * size, lengths) + np.concatenate(lists)[at]
        weight = np.repeat(batch.column("n").to_numpy(), lengths)
        if len(names) * size <= DENSE_CELLS:
            sums = np.bincount(key, weight, len(names) * size)
            found = np.flatnonzero(sums)
            sums = sums[found]
        else:
            found, back = np.unique(key, return_inverse=True)
            sums = np.bincount(back, weight)
        owners, first = np.unique(found // size, return_index=True)
        offsets = pa.array(np.append(first, len(found)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64())) for values in (found % size, np.rint(sums).astype(np.int64))]
        one = pa.array(np.searchsorted(owner, owners))  # a row of each sample
        return pa.record_batch([names.take(pa.array(owners)), *(batch.column(c).take(one) for c in also), *lists], [sample, *also, "codes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            encoded = batch.column(sample).dictionary_encode(null_encoding="encode")
            owner = encoded.indices.to_numpy()
            done = int(np.searchsorted(owner, len(encoded.dictionary) - 1))  # names are numbered as they come
            if done:
                yield added(batch.slice(0, done), owner[:done], encoded.dictionary, known)
            held = batch.slice(done)
        if held is not None:
            encoded = held.column(sample).dictionary_encode(null_encoding="encode")
            yield added(held, encoded.indices.to_numpy(), encoded.dictionary, known)

    kinds = ", ".join(f"`{c}` {variants.schema[c].dataType.simpleString()}" for c in (sample, *also))
    return met.mapInArrow(run, f"{kinds}, codes array<bigint>, counts array<bigint>")


def code_sums(rows: DataFrame, n_codes: int, *weights: str) -> DataFrame:
    """(code, n, weights): the counts of ``sample_rows`` added up over samples, plain and times each weight of the sample.

    A task emits one row per code, so neither the samples' rows nor their counts are shuffled.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((1 + len(weights), n_codes), dtype=np.int64), np.zeros(n_codes, dtype=bool)
        for batch in batches:
            lists = batch.column("codes")
            codes, counts = lists.flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
            seen[codes] = True
            total[0] += np.rint(np.bincount(codes, counts, n_codes)).astype(np.int64)
            for place, name in enumerate(weights, 1):
                weight = np.repeat(batch.column(name).to_numpy(), np.diff(lists.offsets.to_numpy()))
                total[place] += np.rint(np.bincount(codes, counts * weight, n_codes)).astype(np.int64)
        found = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(found), *(pa.array(row[found]) for row in total)], ["code", "n", *weights])

    kinds = ", ".join(f"`{c}` bigint" for c in ("code", "n", *weights))
    parts = rows.select("codes", "counts", *(F.col(w).cast("bigint") for w in weights)).mapInArrow(add, kinds)
    return parts.groupBy("code").agg(*(F.sum(c).alias(c) for c in ("n", *weights)))


def long_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """``sample_rows`` as one row per key and category: (keys, code, n)."""
    return rows.select(*keys, F.inline(F.arrays_zip(F.col("codes").alias("code"), F.col("counts").alias("n"))))


def category_counts(variants: DataFrame, domain: CategoryDomain, sample: str = "SAMPLE") -> DataFrame:
    """Variants per sample and category: (sample, code, n), only where n > 0."""
    return long_counts(sample_rows(variants, domain, sample), sample)


def category_universe(counts: DataFrame, domain: CategoryDomain) -> DataFrame:
    """Distinct categories with their terms and key."""
    codes = counts.select("code").distinct()
    return codes.select("code", *domain.decode(F.col("code")), domain.key(F.col("code")).alias("Category"))


def spell_out(frame: DataFrame, domain: CategoryDomain) -> DataFrame:
    """Add the category key and its five terms to a coded result."""
    return frame.withColumn("Category", domain.key(F.col("code"))).select(
        "*", *domain.decode(F.col("code"))
    )


def dense_rows(rows: DataFrame, codes: list[int], sample: str = "SAMPLE") -> DataFrame:
    """One row per sample of ``sample_rows`` with its counts in ``codes`` order, zeros included.

    A row is bounded by the category list, which the domain fixes, not by the number of variants.
    """
    width = len(codes)
    sorter = np.argsort(np.array(codes, dtype=np.int64))
    ordered = np.array(codes, dtype=np.int64)[sorter]

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, DENSE_CELLS // max(1, width))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                lists, values = part.column("codes"), part.column("counts").flatten().to_numpy()
                owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten().to_numpy()
                place = np.searchsorted(ordered, flat)
                known = place < width
                known[known] = ordered[place[known]] == flat[known]
                dense = np.zeros((len(lists), width), dtype=np.int64)
                dense[owner[known], sorter[place[known]]] = values[known]
                ends = pa.array(np.arange(0, (len(lists) + 1) * width, width) if width else np.zeros(len(lists) + 1), pa.int32())
                yield pa.record_batch([part.column(sample), pa.ListArray.from_arrays(ends, dense.ravel())], [sample, "counts"])

    kind = rows.schema[sample].dataType.simpleString()
    return rows.select(sample, "codes", "counts").mapInArrow(scatter, f"`{sample}` {kind}, counts array<bigint>")


def drop_redundant(categories: DataFrame) -> DataFrame:
    """Categories (five term columns) free of redundant pairs."""
    return categories.where(~is_redundant(F.col("variant_type"), F.col("gene_set"), F.col("gencode")))


def drop_by_rule_table(categories: DataFrame, rules: DataFrame) -> DataFrame:
    """Anti-join against a user rule table in which ``*`` matches any term.

    Rules with the same starred columns form one equi-join, so each pattern is a hash anti-join.
    """
    stars = F.concat_ws("", *[F.when(F.col(d) == "*", "1").otherwise("0") for d in DIMENSIONS])
    patterns = [r[0] for r in rules.select(stars.alias("pattern")).distinct().collect()]  # at most 2**5
    for pattern in sorted(patterns):
        fixed = [d for d, flag in zip(DIMENSIONS, pattern) if flag == "0"]
        chosen = rules.where(stars == pattern)
        if not fixed:
            return categories.limit(0)
        categories = categories.join(chosen.select(*fixed).distinct(), fixed, "left_anti")
    return categories


def signature_codes(signature_rows: DataFrame, domain: CategoryDomain) -> DataFrame:
    """Each signature as one row: its multiplicity and the sorted codes of all its categories."""

    def triples(v):
        return F.flatten(F.transform(
            "gs", lambda g: F.transform("gc", lambda c: F.struct(v.alias("v"), g.alias("g"), c.alias("c")))
        ))

    allowed = F.filter(
        F.flatten(F.transform("vt", triples)), lambda t: ~is_redundant(t["v"], t["g"], t["c"])
    )

    def codes(t):
        return F.flatten(F.transform(
            "fs", lambda s: F.transform("fa", lambda a: domain.encode(t["v"], t["g"], s, t["c"], a))
        ))

    return signature_rows.withColumn("_allowed", allowed).select(
        F.array_sort(F.flatten(F.transform("_allowed", codes))).alias("codes"), "n"
    )
