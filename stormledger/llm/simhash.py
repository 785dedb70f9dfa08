"""SimHash near-duplicate detection: pigeonhole blocks, a join on blocks, Hamming verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .components import connected_components

#: Shingles whose bits are counted at once.
BATCH_SHINGLES = 100_000
#: Fingerprints of a block that are compared in one group; blocks with more are split into chunks, compared in pairs.
CHUNK = 2048
#: Linked pairs that a task holds before it merges them.
HELD_PAIRS = 500_000


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> list[int]:
    """XXH64 of the runs of ``words`` words of a lower-cased text (fewer words: of them all; none: nothing)."""
    w = text.split()  # of bytes: cuts at the six ASCII white spaces only
    if not w:
        return []
    one = xxhash.xxh64_intdigest
    return [one(s, seed) for s in map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))] if len(w) >= words else [one(b" ".join(w), seed)]


def fingerprints(texts: list[bytes], words: int) -> np.ndarray:
    """The SimHash of each text: a bit is set if it is in more than half of the shingles' hashes."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    held: list[int] = []
    starts, owners = [], []

    def flush() -> None:
        if not held:
            return
        bits = np.unpackbits(np.array(held, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        n = np.diff([*starts, len(held)])
        out[owners] += ((2 * ones > n[:, None]) * weights).sum(axis=1, dtype=np.uint64)
        held.clear(), starts.clear(), owners.clear()

    for i, text in enumerate(texts):
        own = shingle_hashes(text.lower(), words)
        if len(own) > BATCH_SHINGLES:  # a very long text: count its bits in pieces
            ones = np.zeros(64, np.int64)
            for a in range(0, len(own), BATCH_SHINGLES):
                ones += np.unpackbits(np.array(own[a : a + BATCH_SHINGLES], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = ((2 * ones > len(own)) * weights).sum(dtype=np.uint64)
        elif own:
            starts.append(len(held))
            owners.append(i)
            held.extend(own)
            if len(held) > BATCH_SHINGLES:
                flush()
    flush()
    return out


def document_fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) of every whole text; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            # bytes.lower() lower-cases A-Z alone
            fp = fingerprints([b"" if t is None else t.encode() for t in batch.column(1).to_pylist()], words)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": fp.view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"doc_id {kind}, fp long")


def block_masks(bits: int, distance: int, spare: int) -> list[int]:
    """Masks of which any two fingerprints within ``distance`` agree on at least one.

    ``distance + spare`` blocks: at most ``distance`` of them differ, so some ``spare`` blocks are the same in both.
    """
    n = distance + spare
    edges = [round(i * bits / n) for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, spare)]


def split_bits(mask: int, parts: int) -> list[int]:
    """The set bits of ``mask`` in ``parts`` masks of about equal size."""
    bits = [1 << b for b in range(64) if mask >> b & 1]
    return [sum(bits[round(i * len(bits) / parts) : round((i + 1) * len(bits) / parts)]) for i in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def local_roots(n: int, a: np.ndarray, b: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
    """For each of n nodes the smallest node that the pairs (a, b) connect it to, on from ``roots``."""
    roots = np.arange(n) if roots is None else roots
    while True:
        low = np.minimum(roots[a], roots[b])
        before = roots.copy()
        np.minimum.at(roots, roots[a], low)
        np.minimum.at(roots, roots[b], low)
        while True:
            up = roots[roots]
            if (up == roots).all():
                break
            roots = up
        if (before == roots).all():
            return roots


def linked(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, within each group (rows in order of group), what pairs within ``distance`` connect.

    Compares each row with the d-th after it, for every d that a group has; gives at most one edge a row.
    """
    n = len(fp)
    ends = np.flatnonzero(np.append(group[1:] != group[:-1], True))
    size = np.diff(np.append(-1, ends))
    after = np.repeat(ends, size) - np.arange(n)  # rows of the group that follow
    roots, held, count = np.arange(n), [], 0
    left, d = np.flatnonzero(after > 0), 1
    while len(left):
        close = left[np.bitwise_count(fp[left] ^ fp[left + d]) <= distance]
        if len(close):
            held.append((close, close + d))
            count += len(close)
        if count > HELD_PAIRS:
            roots = local_roots(n, *(np.concatenate(x) for x in zip(*held, strict=True)), roots)
            held, count = [], 0
        d += 1
        left = left[after[left] >= d]
    if held:
        roots = local_roots(n, *(np.concatenate(x) for x in zip(*held, strict=True)), roots)
    moved = np.flatnonzero(roots != np.arange(n))
    return moved, roots[moved]


def close_pairs(prints: DataFrame, distance: int = 3, spare: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Edges ``u``, ``v`` between distinct fingerprints (column ``fp``) with the components of all pairs within ``distance``.

    Fingerprints meet in the blocks they share. A block with more than ``chunk`` fingerprints is refined: a close pair in it
    differs in at most ``distance`` of the remaining bits, so it also shares one of ``distance`` + 1 parts of those. What is still
    larger is split by hash into chunks, each two of which are compared in a group of their own. So no group is
    larger than two chunks, and no pair is left out. A group gives one edge a row at most, however many pairs it has.
    """
    masks = block_masks(64, distance, spare)
    finer = F.array(*[F.array(*[F.lit(_signed(x)) for x in split_bits(~m & (1 << 64) - 1, distance + 1)]) for m in masks])
    keys = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("mask", "key"))
    shared = keys.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    meet = keys.join(shared, ["mask", "key"])
    small = meet.where(F.col("n") <= chunk).select(F.xxhash64("mask", "key").alias("g"), "fp")
    parts = F.transform(F.get(finer, F.col("mask")), lambda x: F.col("fp").bitwiseAND(x))
    large = meet.where(F.col("n") > chunk).select("mask", "key", "fp", F.posexplode(parts).alias("part", "rest"))
    shared = large.groupBy("mask", "key", "part", "rest").agg(F.count("*").alias("n")).where("n > 1")
    large = large.join(shared, ["mask", "key", "part", "rest"]).withColumn("m", F.ceil(F.col("n") / chunk).cast("int")).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    others = F.when(F.col("m") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("m") - 1), lambda j: j != F.col("c")))
    split = large.withColumn("j", F.explode(others)).select(F.xxhash64("mask", "key", "part", "rest", F.least("c", "j"), F.greatest("c", "j")).alias("g"), "fp")
    pairs = small.unionAll(split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def out(g: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = linked(g, fp.view(np.uint64), distance)
            return pa.RecordBatch.from_pydict({"u": fp[a], "v": fp[b]})

        for batch in batches:
            g, fp = np.append(g, batch.column(0).to_numpy()), np.append(fp, batch.column(1).to_numpy())
            if len(g) and g[0] != g[-1]:
                last = int(np.searchsorted(g, g[-1]))  # the last group may go on
                yield out(g[:last], fp[:last])
                g, fp = g[last:], fp[last:]
        if len(g):
            yield out(g, fp)

    return pairs.repartition("g").sortWithinPartitions("g").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, spare: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (the smallest id reachable).

    Texts whose fingerprints differ in at most ``distance`` bits are linked. Equal fingerprints are compared once.
    Null texts are empty; texts without words have fingerprint zero and are linked like any other. Null ids belong to
    their component but don't name it (without any other id its ``component_id`` is null); repeated ids are kept. Other columns
    are ignored, an empty table gives no rows.
    """
    each = cut(document_fingerprints(docs, words, id_col, text_col))
    prints = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    of = connected_components(close_pairs(prints, distance, spare))
    placed = prints.join(of, prints["fp"] == of["node"], "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    # A component may hold a third of all rows: both sides of the join are shuffled for it alone, so adaptive execution splits it.
    names = cut(placed.groupBy("component").agg(F.min("least_id").alias("component_id")))
    named = placed.join(names, "component").select("fp", "component_id")
    return each.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
