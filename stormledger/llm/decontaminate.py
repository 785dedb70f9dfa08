"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages of words, as TF-IDF vectors over the benchmark's vocabulary (no other word can
add to a product with an item). A distributed randomised SVD of the passages gives the corpus' main directions with their
singular values. Passages and items are folded into that space alone, each direction divided by its singular value, so that
common themes count no more than rare ones. Passages whose cosine with an item there reaches a threshold are candidates;
longest common subsequences and the item's answer decide.
"""

from __future__ import annotations

import gc
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, distinct, slices, texts

#: Words of a passage; each starts half a passage after the one before.
PASSAGE, STEP = 64, 32
#: Directions of the SVD, those drawn beyond them, least latent cosine of a candidate, items that share a vocabulary and a search.
RANK, OVERSAMPLE, COSINE, BLOCK_ITEMS = 128, 16, 0.38, 50_000
#: Terms that more than this share of the items have, and more than so many, tell no items apart: the search leaves them out.
COMMON_SHARE, COMMON_ITEMS = 0.05, 10
#: A passage that shares less than this part of an item's squared TF-IDF weight holds too little of it.
MASS = 0.25
#: An item is found where this share of its words is a common subsequence; or this much less, with this share of its answer.
LCS, LCS_WITH_ANSWER, ANSWER = 0.8, 0.6, 0.8
#: Terms whose sums are gathered at once in the distributed product; passages and items that a task compares at once.
CHUNK_TERMS, PASSAGES_AT_ONCE, ITEMS_AT_ONCE = 128, 1024, 4096
_words = re.compile(r"[^\W_]+").findall
_plain_words = re.compile(r"\w+").findall
_sentence_end = re.compile(r"[.!?]\s+")


@dataclass(frozen=True)
class Items:
    """A block of benchmark items: ids, terms in order, and how many of the last terms are the answer (the last sentence)."""

    ids: list[int]
    vocabulary: dict[str, int]
    sequences: list[np.ndarray]
    answers: list[int]

    def telling(self) -> np.ndarray:
        """Which terms the search uses: all but common ones; an item of which those are more than half keeps them."""
        own = [np.unique(s) for s in self.sequences]
        kept = np.bincount(np.concatenate(own), minlength=len(self.vocabulary)) <= max(COMMON_ITEMS, COMMON_SHARE * len(own))
        for terms in [t for t in own if 2 * np.count_nonzero(kept[t]) < len(t)]:
            kept[terms] = True
        return kept


def read_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK_ITEMS) -> Iterator[Items]:
    """The benchmark in blocks, through the driver row by row. Items without words or without an id are left out."""
    rows = benchmark.select(F.col(id_col).cast("long"), text_col).where(F.col(id_col).isNotNull()).orderBy(id_col, text_col).toLocalIterator()
    ids, vocabulary, sequences, answers = [], {}, [], []
    for item, text in rows:
        words = _words((text or "").lower())
        if not words:
            continue
        last = len(_words(_sentence_end.split((text or "").strip())[-1].lower()))
        ids.append(item)
        sequences.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32))
        answers.append(min(last, len(words)))
        if len(ids) == block:
            yield Items(ids, vocabulary, sequences, answers)
            ids, vocabulary, sequences, answers = [], {}, [], []
    if ids:
        yield Items(ids, vocabulary, sequences, answers)


def benchmark_words(docs: DataFrame, vocabulary: dict[str, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each text with any: the places (in words) and terms of its benchmark words, as packed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(100_000)
        get = vocabulary.get
        for batch in slices(batches):
            ids, places, found = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                text = text.lower()
                words = _words(text) if "_" in text else _plain_words(text)  # the second is the faster pattern
                terms = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                at = np.flatnonzero(terms >= 0)
                if len(at):
                    ids.append(key)
                    places.append(at.astype(np.int32).tobytes())
                    found.append(terms[at].tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "places": pa.array(places, pa.binary()), "terms": pa.array(found, pa.binary())})

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, "doc_id long, places binary, terms binary")


@dataclass
class Blocks:
    """The benchmark words of some documents, by blocks of STEP words; passage b is blocks b and b + 1.

    A term counts once for each block that has it, so a passage's vector is the sum of its two blocks'.
    """

    terms: np.ndarray
    block: np.ndarray
    n: int

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> tuple[Blocks, list[np.ndarray], np.ndarray]:
        places = [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
        terms = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int32)
        sizes = np.array([int(p[-1]) // STEP + 2 for p in places])  # one empty block ends each document
        base = np.cumsum(sizes) - sizes
        own = np.concatenate(places) // STEP if places else np.empty(0, np.int64)
        block = own.astype(np.int64) + np.repeat(base, [len(p) for p in places])
        return cls(terms, block, int(sizes.sum())), places, base

    def only(self, kept: np.ndarray) -> Blocks:
        """With the words of ``kept`` terms alone."""
        on = kept[self.terms]
        return Blocks(self.terms[on], self.block[on], self.n)

    def distinct(self, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (block, term), in order."""
        keys = distinct(self.block * n_terms + self.terms)
        block = keys // n_terms
        return block, keys - block * n_terms


def block_counts(hits: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """For each term the number of blocks that have it, and the number of blocks with any; over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_ = np.zeros(n_terms, np.int64), 0
        for batch in slices(batches):
            blocks, _, _ = Blocks.of(batch)
            if blocks.n:
                of, term = blocks.distinct(n_terms)
                counts += np.bincount(term, minlength=n_terms)
                any_ += 1 + int(np.count_nonzero(np.diff(of)))
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"term": np.append(there, -1), "n": np.append(counts[there], any_)})

    rows = hits.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts, any_ = np.zeros(n_terms, np.int64), 0
    for r in rows:
        if r.term < 0:
            any_ = r.n
        else:
            counts[r.term] = r.n
    return counts, any_


def gram_product(hits: DataFrame, idf: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A'(A x) for the passages' TF-IDF matrix A and a matrix x with a row for each term.

    Each task multiplies its passages with x and back; the products, one row of numbers for each term, are added up by
    chunks of terms. What is sent and gathered is as large as the benchmark's vocabulary, whatever the corpus.
    """
    n_terms, width = x.shape
    sent = hits.sparkSession.sparkContext.broadcast((x * idf[:, None]).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighed, total = sent.value, np.zeros((n_terms, width))
        for batch in slices(batches):
            blocks = Blocks.of(batch)[0].only(idf > 0)
            if not len(blocks.terms):
                continue
            # One row for each second passage: together they are the whole text, each word once.
            row, term = blocks.distinct(n_terms)
            row //= 2
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            y = np.add.reduceat(weighed[term], starts, axis=0)
            at = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(row))))
            order = np.argsort(term, kind="stable")
            term = term[order]
            firsts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            total[term[firsts]] += np.add.reduceat(y[at[order]], firsts, axis=0)
        total *= idf[:, None]
        parts = range(0, n_terms, CHUNK_TERMS)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(parts, pa.int64()), "sums": pa.array([total[a : a + CHUNK_TERMS].astype(np.float32).tobytes() for a in parts], pa.binary())})

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for sums in batch.column(1).to_pylist():
                own = np.frombuffer(sums, np.float32).astype(np.float64)
                total = own if total is None else total + own
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    kinds = "chunk long, sums binary"
    partial = hits.mapInArrow(run, kinds).withColumn("salt", F.spark_partition_id() % 64)
    summed = partial.groupBy("chunk", "salt").applyInArrow(add, kinds).groupBy("chunk").applyInArrow(add, kinds)
    rows = sorted(summed.collect(), key=lambda r: r.chunk)
    return np.concatenate([np.frombuffer(r.sums, np.float32) for r in rows] or [np.zeros(n_terms * width, np.float32)]).reshape(n_terms, width).astype(np.float64)


def randomised_svd(hits: DataFrame, idf: np.ndarray, rank: int = RANK, oversample: int = OVERSAMPLE, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors of the passages' TF-IDF matrix A (columns) and their singular values, truncated to ``rank``.

    The range finder draws Omega and takes Q from A'A Omega; a power iteration gives Y = A'A Q. As A'A is about Y (Q'Y)^-1 Y', the SVD of
    the small Y (Q'Y)^-1/2 has A's singular values and right vectors. Directions without a singular value are left out.
    """
    n_terms = len(idf)
    width = min(n_terms, rank + oversample)
    q, _ = np.linalg.qr(gram_product(hits, idf, np.random.default_rng(seed).standard_normal((n_terms, width))))
    y = gram_product(hits, idf, q)
    core = q.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    kept = values > 1e-7 * max(values.max(initial=0.0), 1e-300)
    u, sigma, _ = np.linalg.svd(y @ (vectors[:, kept] / np.sqrt(values[kept])), full_matrices=False)
    kept = min(rank, int(np.count_nonzero(sigma > 1e-4 * sigma.max(initial=0.0))))
    return u[:, :kept], sigma[:kept]


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence, by bit rows over ``a``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        u = row & masks.get(x, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@dataclass(frozen=True)
class LatentSpace:
    """What a search needs of the terms: idf (and that with 0 for those it leaves out), latent vectors (idf times right singular vector
    over singular value), the items' unit vectors."""

    idf: np.ndarray
    searched: np.ndarray
    embedding: np.ndarray
    queries: np.ndarray

    @classmethod
    def of(cls, items: Items, idf: np.ndarray, searched: np.ndarray, directions: np.ndarray, sigma: np.ndarray) -> LatentSpace:
        embedding = (directions / sigma * searched[:, None]).astype(np.float32)
        queries = np.array([embedding[np.unique(s)].sum(axis=0) for s in items.sequences], np.float32).reshape(len(items.sequences), embedding.shape[1])
        norms = np.linalg.norm(queries, axis=1)
        return cls(idf, searched, embedding, (queries / np.where(norms > 0, norms, 1)[:, None]).T.copy())


class Searcher:
    """Finds a block's items in documents, in a latent space."""

    def __init__(self, items: Items, space: LatentSpace, cosine: float = COSINE):
        self.items, self.space, self.cosine = items, space, cosine
        self.squares = space.searched**2
        own = [np.unique(s).astype(np.int64) for s in items.sequences]
        self.mass = np.array([float(self.squares[t].sum()) for t in own])
        self.keys = np.concatenate([i * len(self.squares) + t for i, t in enumerate(own)])
        self.member = np.zeros(len(space.idf), bool)

    def find(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """(doc_id, item_id, cosine, lcs, lcs_ratio, answer_ratio, start_word) of items found in the batch's documents."""
        blocks, places, base = Blocks.of(batch)
        if blocks.n:
            yield from self.verify(batch.column(0).to_pylist(), blocks, places, base, *self.candidates(blocks))

    def candidates(self, blocks: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, latent cosine) of all pairs whose latent cosine reaches the threshold and that share enough weight."""
        of, term = blocks.only(self.space.searched > 0).distinct(len(self.squares))
        found: list[tuple[np.ndarray, ...]] = []
        if len(of):
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            ends = np.append(starts[1:], len(of))
            # Passages begin at blocks that have words and at those before them, unless that is the end of another document.
            own = of[starts]
            first = distinct(np.concatenate([own, np.maximum(own - 1, 0)]))
            a, b = (np.minimum(np.searchsorted(own, first + i), len(own) - 1) for i in (0, 1))
            has_a, has_b = own[a] == first, own[b] == first + 1
            for lo in range(0, len(first), PASSAGES_AT_ONCE):
                p = slice(lo, lo + PASSAGES_AT_ONCE)
                k0, k1 = int(min(a[p][0], b[p][0])), int(max(a[p][-1], b[p][-1])) + 1
                sums = np.add.reduceat(self.space.embedding[term[starts[k0] : ends[k1 - 1]]], starts[k0:k1] - starts[k0], axis=0)
                x = sums[a[p] - k0] * has_a[p][:, None] + sums[b[p] - k0] * has_b[p][:, None]
                norm = np.linalg.norm(x, axis=1)
                x /= np.where(norm > 0, norm, 1)[:, None]
                for c in range(0, self.space.queries.shape[1], ITEMS_AT_ONCE):
                    cosine = x @ self.space.queries[:, c : c + ITEMS_AT_ONCE]
                    at, item = np.nonzero(cosine >= self.cosine)
                    near = cosine[at, item]
                    at, item = at + lo, item + c
                    weight = np.zeros(len(at))
                    for part, has in ((a, has_a), (b, has_b)):
                        weight += np.where(has[at], self.shared(term, starts[part[at]], ends[part[at]], item), 0.0)
                    on = weight >= MASS * self.mass[item]
                    found.append((first[at[on]], item[on], near[on]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3

    def shared(self, term: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray) -> np.ndarray:
        """For stretches of ``term`` the squared weight of the terms that each has in common with an item."""
        size = end - start
        if not len(size):
            return np.zeros(0)
        ends = np.cumsum(size)
        t = term[np.repeat(start, size) + np.arange(ends[-1]) - np.repeat(ends - size, size)]
        key = np.repeat(item, size) * len(self.squares) + t
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.add.reduceat(np.where(self.keys[at] == key, self.squares[t], 0.0), ends - size)

    def verify(self, ids: list, blocks: Blocks, places: list[np.ndarray], base: np.ndarray, passages: np.ndarray, item: np.ndarray, cosine: np.ndarray) -> Iterator[tuple]:
        offsets = np.cumsum([0, *map(len, places)])
        docs = np.searchsorted(np.append(base[1:], blocks.n), passages, side="right")
        best: dict[tuple[int, int], tuple] = {}
        member, held = self.member, -1
        for k in np.argsort(item, kind="stable").tolist():
            i, d = int(item[k]), int(docs[k])
            sequence = self.items.sequences[i]
            if i != held:
                if held >= 0:
                    member[self.items.sequences[held]] = False
                member[sequence], held = True, i
            n = len(sequence)
            word = (int(passages[k]) - int(base[d])) * STEP
            lo, hi = np.searchsorted(places[d], (word - n, word + PASSAGE + n))
            terms = blocks.terms[offsets[d] + lo : offsets[d] + hi]
            inside = member[terms]
            # No common subsequence is longer than the item's words that are there.
            if np.count_nonzero(inside) / n < LCS_WITH_ANSWER:
                continue
            at, terms = places[d][lo:hi][inside], terms[inside]
            # The stretch of about the item's length that has most of its weight.
            reach = np.searchsorted(at, at + math.ceil(1.25 * n))
            weight = np.append(0, np.cumsum(self.space.idf[terms]))
            a = int(np.argmax(weight[reach] - weight[:-1]))
            stretch = terms[a : reach[a]]
            if len(stretch) / n < LCS_WITH_ANSWER:
                continue
            common = lcs_length(sequence, stretch)
            ratio = common / n
            if ratio < LCS_WITH_ANSWER:
                continue
            tail = sequence[n - self.items.answers[i] :]
            answer = lcs_length(tail, stretch) / len(tail)
            if ratio >= LCS or answer >= ANSWER:
                row = (common, float(cosine[k]), -int(at[a]), ratio, answer)
                best[d, i] = max(best.get((d, i), row), row)
        if held >= 0:
            member[self.items.sequences[held]] = False
        for (d, i), (common, near, start, ratio, answer) in best.items():
            yield ids[d], self.items.ids[i], near, common, ratio, answer, -start


SCHEMA = "doc_id long, item_id long, cosine double, lcs int, lcs_ratio double, answer_ratio double, start_word int"


def find_items(docs: DataFrame, items: Items, id_col: str = "doc_id", text_col: str = "text", rank: int = RANK) -> DataFrame:
    """The items of one block that each text holds, one row for each text and item."""
    n_terms = len(items.vocabulary)
    hits = cut(benchmark_words(docs, items.vocabulary, id_col, text_col))
    counts, blocks = block_counts(hits, n_terms)
    idf = np.log((2 + blocks) / (1 + counts))
    searched = np.where(items.telling(), idf, 0.0)
    directions, sigma = randomised_svd(hits, searched, rank)
    if not len(sigma):  # no document has a word of the benchmark
        return docs.sparkSession.createDataFrame([], SCHEMA)
    sent = docs.sparkSession.sparkContext.broadcast((items, LatentSpace.of(items, idf, searched, directions, sigma)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*sent.value)
        for batch in slices(batches):
            rows = list(zip(*searcher.find(batch), strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

    return hits.mapInArrow(run, SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that hold benchmark items: one row for each document and item, with the best passage's figures.

    ``doc_id``, ``item_id``, ``cosine`` (latent), ``lcs`` (words in common, in order), ``lcs_ratio`` (of the item), ``answer_ratio`` (of the item's
    last sentence) and ``start_word`` (place of the passage found, in words). Every document is searched for every item. The corpus
    is read once for ``BLOCK_ITEMS`` items, which share a vocabulary and a latent space; that also bounds what is sent to tasks.
    Null and empty texts hold nothing, items without words are never found; an empty table, or one that has no word of the benchmark, gives no rows. Ids are
    cast to long (what isn't a number becomes null). Rows that share an id are searched each and reported as one, by the
    best passage; a null id stays null.
    """
    out = None
    for items in read_items(benchmark):
        found = find_items(docs, items, id_col, text_col)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    one = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("lcs"), F.desc("cosine"), "start_word")
    return out.withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n")
