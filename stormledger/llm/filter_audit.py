"""Audit of how filters interact: what each removes first, again or alone, in every order of applying them.

A document's failures are one bitmask. The four filters that read a text alone come from the bytes of a batch: classes of
bytes and prefix sums count words, capitals and symbols, and sorted word hashes, each pair of equal neighbours verified by its
bytes, give the distinct words. Whether a text is a copy is known after grouping by its digest. From then on only the counts of
masks matter, and every order's figures are sums over them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_scan import buffers, byte_class, characters, equal_slices, hashes, pieces, within, words
from .common import table

FILTERS = "ABCDE"
#: The bit of the last filter; the others' follow from their order.
COPY = 16
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
CAPITALS, SYMBOLS = byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), byte_class("#$%&*|")
#: Bits of a word's hash in its sorting key; the text's place in the batch has the others.
HASH_BITS = 48


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, n_texts: int) -> np.ndarray:
    """The number of distinct words of each text (at most 2**16 texts).

    Words are sorted by text and hash. Neighbours with equal hashes are compared by their bytes; a text in which two differ is counted anew from its words.
    """
    key = owner.astype(np.uint64) << np.uint64(HASH_BITS) | hashes(data, starts, ends) >> np.uint64(64 - HASH_BITS)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(key[1:] == key[:-1])
    same = equal_slices(data, starts, ends, order[at], order[at + 1])
    out = np.bincount(owner, minlength=n_texts) - np.bincount(owner[order[at]], minlength=n_texts)
    for text in np.unique(owner[order[at[~same]]]).tolist():
        i, j = np.searchsorted(owner, (text, text + 1))
        out[text] = len({data[a:b].tobytes() for a, b in zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True)})
    return out


def failures(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """The mask of filters A to D that each text fails, and its digest."""
    data, bounds = buffers(column)
    n_texts = len(bounds) - 1
    starts, ends, owner = words(data, bounds)
    n_words = np.bincount(owner, minlength=n_texts)
    tests = [
        n_words < LEAST_WORDS,
        100 * distinct_words(data, starts, ends, owner, n_texts) < LEAST_DISTINCT * n_words,
        100 * within(CAPITALS[data], bounds) > MOST_CAPITALS * within(characters(data), bounds),
        within(SYMBOLS[data], bounds) > 0,
    ]
    view, at = memoryview(data), bounds.tolist()
    digests = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(at, at[1:], strict=False)]
    return sum(t.astype(np.int32) << k for k, t in enumerate(tests)), digests


def scanned(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``doc_id``, ``part`` (null: empty), ``mask`` and ``digest`` of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            mask, digests = failures(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(mask, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {docs.schema[id_col].dataType.simpleString()}, part string, mask int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Counts ``n`` of documents by ``part``, ``mask`` (a bit for each filter they fail), ``good`` and ``toxic``.

    The texts are read once; ids, masks and digests are written to the shared folder. The smallest id of each digest comes
    of partial sums, so a text with very many copies is one row a task.
    """
    rows = table(scanned(docs, id_col, text_col, part_col), "masks")
    firsts = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = rows.join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    keys = [F.col("part"), F.when(copy, F.col("mask") + COPY).otherwise(F.col("mask")).alias("mask"), *(F.coalesce(k, F.lit(False)).alias(k) for k in ("good", "toxic"))]
    return joined.groupBy(*keys).agg(F.count("*").alias("n"))


def steps() -> list[tuple[str, int, int, int]]:
    """Every order of the filters and step of it: the filter's bit and the bits of those before."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    return [("".join(p), k + 1, bit[f], sum(bit[e] for e in p[:k])) for p in permutations(FILTERS) for k, f in enumerate(p)]


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per ``part`` (null: empty), ``filter_order`` and ``step``, with counts of the part's documents.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (fails its filter, removed before), ``unique_fails`` (fails no other),
    ``good_lost`` and ``toxic_lost`` (removed here, so labelled) and ``shapley`` (the filter's removals summed over all orders).

    Null texts are empty. Each row counts, repeated ones too. A copy has the text of a smaller id: rows that share the smallest
    id are none, and a null id is neither smaller nor a copy. A label that any row of ``labels`` gives an id holds for it;
    ids without labels have none. Long texts are scanned alone; further columns are ignored; no documents give no rows.
    """
    counts = mask_counts(docs, labels, id_col, text_col, part_col)
    every = F.explode(F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(b).alias("bit"), F.lit(e).alias("before")) for o, k, b, e in steps()]))
    rows = counts.withColumn("at", every).select("*", "at.*")
    mask, bit = F.col("mask"), F.col("bit")
    fails, gone = mask.bitwiseAND(bit) > 0, mask.bitwiseAND(F.col("before")) > 0
    total = lambda chosen, n=F.col("n"): F.sum(F.when(chosen, n).otherwise(0))
    orders = len(steps()) // len(FILTERS)
    first_in = F.expr(f"n * ({orders} div greatest(bit_count(mask), 1))")  # in as many orders a failed filter is the first of those failed
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(fails & ~gone & F.col("good")).alias("good_lost"),
        total(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
        total(fails, first_in).alias("shapley"),
    )
