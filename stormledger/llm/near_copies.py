"""Near copies by seeded SimHash fingerprints: a join on blocks, Hamming verification, an exact check, components.

Three of 64 bits is too narrow a reach for texts with a Jaccard similarity of 0.8. So a text has several fingerprints
here, each the SimHash of a few shingles that are sampled under a seed of its own: two texts with similarity s have the same
fingerprint with probability s to the power of the shingles sampled, whatever their lengths. Each such fingerprint is a block.
All texts of a block meet by 256 bits of SimHash over all their shingles; what lies within reach makes candidate groups, one for
each text. In those the shingles themselves are compared: only texts with the asked similarity are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, distinct, numbered, slices, table, texts
from .components import connected_components
from .perfect_hash import mixed

#: Words of a shingle, least Jaccard similarity of linked texts.
SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints that are blocks, shingles sampled for each: at the least similarity a pair shares none with probability (1 - 0.8^4)^10 = 0.005.
BLOCKS, SAMPLED = 10, 4
#: Fingerprints of all shingles, and how many of their 256 bits may differ; at the least similarity 39 do, with a deviation of 6.
WHOLE, DISTANCE = 4, 64
#: Texts and shingles of a chunk; groups with more are split into several.
CHUNK_TEXTS, CHUNK_SHINGLES = 2048, 2_000_000
#: Shingles whose bits are counted at once, words whose hashes a task remembers.
AT_ONCE, MEMO_WORDS = 100_000, 150_000


class Shingles:
    """The distinct shingle hashes of texts: words between ASCII white space, A-Z lower-cased; fewer words than a shingle's are one."""

    def __init__(self, words: int = SHINGLE):
        self.words, self.memo = words, {}

    def __call__(self, text: str) -> tuple[np.ndarray, bytes]:
        """Hashes in ascending order, and the normalised text."""
        words = text.encode().lower().split()
        if not words:
            return np.empty(0, np.uint64), b""
        memo = self.memo
        missing = {w for w in words if w not in memo}
        if missing:
            if len(memo) + len(missing) > MEMO_WORDS:
                memo.clear()
                missing = set(words)
            memo.update((w, xxhash.xxh64_intdigest(w)) for w in missing)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        size = min(self.words, len(h))
        out = h[: len(h) - size + 1].copy()
        for i in range(1, size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i]
        return distinct(mixed(out, 1)), b" ".join(words)


def majorities(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of n owners a SimHash: the bits that more than half of its hashes have. Rows in order of owner."""
    ones, size = np.zeros((n, 64), np.int64), np.bincount(owner, minlength=n)
    for a in range(0, len(h), AT_ONCE):
        bits = np.unpackbits(h[a : a + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[a : a + AT_ONCE]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ones[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return ((2 * ones > size[:, None]) * (np.uint64(1) << np.arange(64, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def sampled_fingerprints(h: np.ndarray, starts: np.ndarray, blocks: int = BLOCKS, sampled: int = SAMPLED) -> np.ndarray:
    """The SimHash of each text's ``sampled`` shingles under each of ``blocks`` seeds: a shingle is drawn as the least under a hash."""
    out = np.empty((len(starts), blocks), np.uint64)
    for j in range(blocks):
        drawn = np.column_stack([np.minimum.reduceat(mixed(h, 100 + j * sampled + c), starts) for c in range(sampled)])
        out[:, j] = majorities(drawn.ravel(), np.repeat(np.arange(len(starts)), sampled), len(starts))
    return out


def sketches(rows: DataFrame, words: int = SHINGLE) -> DataFrame:
    """Of each row of (row, text): ``row``, the normalised text's 128-bit key ``k1 k2``, its distinct shingles' number ``size``, fingerprints of samples ``blocks`` and those of all shingles ``w``, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_up = Shingles(words)
        for batch in slices(batches):
            both = [cut_up(t) for t in texts(batch.column(1))]
            keys = np.array([divmod(xxhash.xxh3_128_intdigest(t), 1 << 64) for _, t in both], np.uint64).reshape(-1, 2)
            sets = [s if len(s) else np.zeros(1, np.uint64) for s, _ in both]  # texts without words are alike
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            flat, owner = np.concatenate([np.empty(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), size)
            blocks = sampled_fingerprints(flat, np.cumsum(size) - size) if sets else np.empty((0, BLOCKS), np.uint64)
            whole = np.column_stack([majorities(mixed(flat, 50 + i), owner, len(sets)) for i in range(WHOLE)])
            blocks = mixed(blocks, 60) + np.arange(BLOCKS, dtype=np.uint64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(blocks.view(np.int64).ravel()), BLOCKS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({"row": batch.column(0), "k1": keys[:, 0].copy().view(np.int64), "k2": keys[:, 1].copy().view(np.int64), "size": size, "blocks": lists, "w": pa.array([x.tobytes() for x in whole], pa.binary())})

    return rows.mapInArrow(run, "row long, k1 long, k2 long, size long, blocks array<long>, w binary")


def shingle_sets(rows: DataFrame, words: int = SHINGLE) -> DataFrame:
    """``row`` and its distinct ``shingles`` as sorted 32-bit prints, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_up = Shingles(words)
        for batch in slices(batches):
            sets = [s if len(s) else np.zeros(1, np.uint64) for s in (cut_up(t)[0] for t in texts(batch.column(1)))]
            packed = [distinct((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in sets]
            yield pa.RecordBatch.from_pydict({"row": batch.column(0), "shingles": pa.array(packed, pa.binary())})

    return rows.mapInArrow(run, "row long, shingles binary")


def similar(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of ``others`` (sorted sets, none empty) have at least this Jaccard similarity to ``one``."""
    flat, size = np.concatenate(others), np.fromiter(map(len, others), np.int64, len(others))
    hits = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    common = np.add.reduceat(hits, np.cumsum(size) - size, dtype=np.int64)
    return common >= similarity * (len(one) + size - common)


def united(known: np.ndarray, size: np.ndarray, w: np.ndarray, sets: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """For each text of a group the first one that links connect it to; texts with the same ``known`` value are connected already.

    Each text meets all after it that it isn't connected with. Those within DISTANCE whose sizes allow the similarity are
    linked, if ``sets`` are given just where the sets agree: first the nearest text of each other component is compared, then the rest.
    """
    roots = np.unique(known, return_index=True)[1][np.unique(known, return_inverse=True)[1]]
    for i in range(len(w) - 1):
        apart = np.flatnonzero(roots[i + 1 :] != roots[i]) + i + 1
        if not len(apart):
            continue
        far = np.bitwise_count(w[apart] ^ w[i]).sum(axis=1)
        fits = np.minimum(size[i], size[apart]) >= similarity * np.maximum(size[i], size[apart])
        on = (far <= DISTANCE) & fits
        near = apart[on][np.argsort(far[on], kind="stable")]
        if not len(near):
            continue
        nearest = np.zeros(len(near), bool)
        nearest[np.unique(roots[near], return_index=True)[1]] = True
        for some in (near[nearest], near[~nearest]):
            some = some[roots[some] != roots[i]]
            if len(some):
                joined = roots[some if sets is None else some[similar(sets[i], [sets[j] for j in some], similarity)]]
                if len(joined):
                    joined = np.append(joined, roots[i])
                    roots[np.isin(roots, joined)] = joined.min()
    return roots


def compared(dealt: DataFrame, similarity: float) -> DataFrame:
    """Links ``u``, ``v`` of each group ``g`` within each part ``k`` of ``dealt`` (k, g, row, known, size, w and perhaps shingles): one a row at most."""
    exact = "shingles" in dealt.columns
    columns = ["k", "g", "row", "known", "size", "w", *(["shingles"] if exact else [])]

    def links(held: list[tuple]) -> pa.RecordBatch:
        row, known, size = (np.array([x[k] for x in held], np.int64) for k in (1, 2, 3))
        w = np.frombuffer(b"".join(x[4] for x in held), np.uint64).reshape(-1, WHOLE)
        roots = united(known, size, w, [np.frombuffer(x[5], np.uint32) for x in held] if exact else None, similarity)
        moved = np.flatnonzero(roots != np.arange(len(roots)))
        return pa.RecordBatch.from_pydict({"g": np.full(len(moved), held[0][0], np.int64), "u": row[moved], "v": row[roots[moved]]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in slices(batches):
            for k, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != part:
                    if len(held) > 1:
                        yield links(held)
                    part, held = k, []
                held.append(rest)
        if len(held) > 1:
            yield links(held)

    return dealt.select(columns).repartition("k").sortWithinPartitions("k", "row").mapInArrow(run, "g long, u long, v long")


def links_within(members: DataFrame, payload: DataFrame, similarity: float) -> DataFrame:
    """Links with the components of all pairs that share a group: ``members`` has ``g``, ``row`` and ``size``, ``payload`` what is compared, by row.

    A group within CHUNK_TEXTS and CHUNK_SHINGLES is compared at once. A larger one is split by hash into chunks, each compared in
    itself; then the first texts of what that connected, chunk by chunk again. What is still apart from the group's largest
    part meets all texts of the group: it alone goes to every chunk. So in a huge group of near copies a text is sent a few
    times, and no pair is left out.
    """
    counts = [F.count("*").alias("n"), F.sum("size").alias("total")]
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK_TEXTS), F.ceil(F.col("total") / CHUNK_SHINGLES)).cast("int")
    part = lambda m: F.pmod(F.xxhash64("row"), m).cast("int")
    with_payload = lambda df: table(compared(df.join(payload.hint("merge"), "row"), similarity), "links")
    held = table(members.join(members.groupBy("g").agg(*counts).where("n > 1").select("g", chunks.alias("m")), "g").withColumn("c", part(F.col("m"))), "members")
    first = with_payload(held.select(F.xxhash64("g", "c").alias("k"), "g", "row", "size", F.col("row").alias("known")))
    large = held.where("m > 1")
    if large.isEmpty():
        return first.select("u", "v")

    rooted = lambda rows, links: rows.join(links.select("g", F.col("u").alias("known"), F.col("v").alias("__v")), ["g", "known"], "left").withColumn("known", F.coalesce("__v", "known")).drop("__v")
    placed = rooted(large.withColumn("known", F.col("row")), first)
    heads = placed.where("row = known")
    more = heads.groupBy("g").agg(*counts).select("g", chunks.alias("j"))
    second = with_payload(heads.join(more, "g").select(F.xxhash64("g", part(F.col("j")), F.lit(1)).alias("k"), "g", "row", "size", "known"))

    placed = table(rooted(placed, second), "members")
    largest = placed.groupBy("g", "known").agg(F.count("*").alias("n")).groupBy("g").agg(F.max_by("known", F.struct("n", "known")).alias("most"))
    apart = placed.join(largest, "g").where("known <> most").drop("most")
    left = apart.groupBy("g").agg(*counts).select("g", chunks.alias("j"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    everyone = placed.join(left, "g").withColumn("l", each(F.col("j"))).select("g", "c", "l", "row", "size", "known")
    again = apart.join(left, "g").withColumn("l", part(F.col("j"))).withColumn("c", each(F.col("m"))).select("g", "c", "l", "row", "size", "known")
    third = with_payload(everyone.unionAll(again).distinct().select(F.xxhash64("g", "c", "l", F.lit(2)).alias("k"), "g", "row", "size", "known"))
    return first.unionAll(second).unionAll(third).select("u", "v")


def shared_blocks(heads: DataFrame) -> DataFrame:
    """``g``, ``row`` and ``size`` for blocks with several texts; of blocks with the same texts, one."""
    keys = heads.select("row", "size", F.explode("blocks").alias("g"))
    same = [F.count("*").alias("n"), F.sum("size").alias("total"), F.bit_xor(F.xxhash64("row")).alias("x1"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("x2")]
    kept = keys.groupBy("g").agg(*same).where("n > 1").groupBy("n", "total", "x1", "x2").agg(F.min("g").alias("g"))
    return keys.join(kept.select("g").hint("merge"), "g").select("g", "row", "size")


def text_links(heads: DataFrame, rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links ``u``, ``v`` between distinct texts (``row size blocks w`` of ``heads``, ``row text`` of ``rows``) with the components of all pairs
    that share a block, are within DISTANCE and have at least this similarity.

    Blocks are compared by fingerprints alone. Each text is then in one candidate group at most, and there alone its shingles are
    sent. Joins with texts and fingerprints are by shuffle whatever the tables' sizes: nothing that grows is broadcast.
    """
    candidates = connected_components(links_within(shared_blocks(heads), heads.select("row", "w"), similarity))
    candidates = table(candidates.select(F.col("component").alias("g"), F.col("node").alias("row")), "candidates")
    sets = shingle_sets(rows.select("row", "text").join(candidates.select("row").hint("merge"), "row", "left_semi"))
    payload = table(sets.join(heads.select("row", "w").hint("merge"), "row"), "sets")
    members = candidates.join(heads.select("row", "size").hint("merge"), "row")
    return links_within(members, payload, similarity)


def first_of_groups(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``row`` of the one to keep of each group of near copies among (row, id, text): the least id, then the least row."""
    each = table(sketches(rows.select("row", "text")), "sketches")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("best")
    texts_ = cut(each.select("row", "k1", "k2").join(rows.select("row", "id"), "row").groupBy("k1", "k2").agg(best).select("best"))
    heads = table(each.select("row", "size", "blocks", "w").join(texts_.select(F.col("best.row").alias("row")).hint("merge"), "row", "left_semi"), "heads")
    of = connected_components(text_links(heads, rows, similarity))
    placed = texts_.join(of, F.col("best.row") == of["node"], "left").select(F.coalesce("component", "best.row").alias("c"), "best")
    return placed.groupBy("c").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near copies, that with the least id; columns stay the same, whatever their names.

    Texts are near copies if the Jaccard similarity of their distinct shingles of five words reaches ``similarity``; groups are the
    components of such links. Null texts are empty, and texts without words are copies of each other. Null ids come after all
    others; rows with the same id, or a null one, are judged by their own texts. Of rows alike in everything one stays. An
    empty table stays empty.
    """
    rows = numbered(docs)
    named = rows.select("row", F.col("doc").getField(id_col).alias("id"), F.col("doc").getField(text_col).alias("text"))
    return rows.join(table(first_of_groups(named, similarity), "kept").hint("merge"), "row", "left_semi").select("doc.*")
