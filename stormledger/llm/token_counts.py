"""Token counts by rank-synchronous array merging.

New pre-tokens of a batch are held as one ragged numpy array of symbols. Each round looks up the ranks of all
neighbouring pairs, takes every sequence's lowest, merges it wherever it occurs in that sequence, and drops sequences
that have no pair left; the surviving symbols are the count. No ids are made. A long sequence has rounds of its own that
touch only the places that the last merges changed.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, texts
from .text_parts import letters_and_marks, parts

#: Parts of texts whose counts a worker remembers; about 120 bytes each.
MEMO_PARTS = 800_000
#: Symbols of new pre-tokens that are merged at once.
ROUND_SYMBOLS = 2_000_000
#: Symbols from which on a sequence has rounds of its own.
LONG = 1024
_NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: printable Latin-1 stands for itself."""
    kept = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


class MergeCounter:
    """Counts the tokens of texts under a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        letters = byte_letters()
        self.symbol = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in file["model"]["merges"]], np.int64).reshape(-1, 3)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_ranks = np.append(keys[order], -1), np.append(order, 0).astype(np.int32)
        self.made = pairs[:, 2]
        special = [t["content"] for t in file["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.specials = special
        self.pretokens = regex.compile(pattern).findall
        self.spaced: dict[str, int] = {}
        self.plain: dict[str, int] = {"": 0}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.key_ranks[at], _NONE)

    def merged_length(self, piece: bytes) -> int:
        """The number of symbols that are left of one long piece.

        Symbols are linked in arrays. Places wait under the rank of the pair that starts there; a round takes the lowest rank, merges
        all its places that still hold, and looks up the pairs that this made.
        """
        n = len(piece)
        symbols = np.append(self.symbol[np.frombuffer(piece, np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank = np.full(n + 1, _NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look_up(at: np.ndarray) -> None:
            right = after[at]
            found = np.where(right < n, self.ranks(symbols[at], symbols[np.minimum(right, n)]), _NONE)
            rank[at] = found
            order = np.argsort(found, kind="stable")
            order = order[: np.searchsorted(found[order], _NONE)]
            ranked = found[order]
            for part in np.split(order, np.flatnonzero(np.diff(ranked)) + 1) if len(order) else []:
                r = int(found[part[0]])
                if r not in waiting:
                    waiting[r] = []
                    heappush(heap, r)
                waiting[r].append(at[part])

        look_up(np.arange(n))
        while heap:
            r = heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # Hits in a row are one symbol repeated: every second one merges, from the left.
            fresh = np.append(True, at[1:] != after[at[:-1]])
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
            gone = after[at]
            follow = after[gone]
            symbols[at], rank[gone], after[at] = self.made[r], _NONE, follow
            n_left = follow < n
            before[follow[n_left]] = at[n_left]
            left = before[at]
            look_up(np.unique(np.concatenate([at, left[left >= 0]])))
        count, i = 0, 0
        while i < n:
            count, i = count + 1, int(after[i])
        return count

    def merged_lengths(self, pieces: list[bytes]) -> np.ndarray:
        """The number of symbols that are left of each piece."""
        if any(len(p) >= LONG for p in pieces):
            out = np.fromiter((self.merged_length(p) if len(p) >= LONG else 0 for p in pieces), np.int64, len(pieces))
            short = [i for i, p in enumerate(pieces) if len(p) < LONG]
            out[short] = self.merged_lengths([pieces[i] for i in short])
            return out
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.zeros(len(pieces), np.int64)
        symbols = self.symbol[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        while len(symbols):
            first = np.empty(len(owner), bool)
            first[0] = True
            np.not_equal(owner[1:], owner[:-1], out=first[1:])
            rank = np.full(len(symbols), _NONE)
            inner = np.flatnonzero(~first[1:])
            rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
            starts = np.flatnonzero(first)
            lowest = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(symbols)))
            done = lowest == _NONE
            out[owner[starts[done]]] = size[done]
            if done.all():
                break
            low = np.repeat(lowest, size)
            hit = (rank == low) & (low != _NONE)
            # Hits in a row are one symbol repeated: every second one merges, from the left.
            at = np.flatnonzero(hit)
            new_run = np.empty(len(at), bool)
            new_run[0] = True
            new_run[1:] = np.diff(at) > 1
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.repeat(~done, size)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def learn(self, spaced: set[str], plain: set[str]) -> None:
        cut = [(self.spaced, s, letters_and_marks(s) or self.pretokens(" " + s)) for s in spaced]
        cut += [(self.plain, s, self.pretokens(s)) for s in plain]
        flat = list({p for _, _, ps in cut for p in ps})
        counts: dict[str, int] = {}
        fresh = []
        for p in flat:
            known = self.spaced.get(p[1:]) if p[0] == " " else self.plain.get(p)
            if known is None:
                fresh.append(p)
            else:
                counts[p] = known
        raw = [p.encode() for p in fresh]
        at = 0
        while at < len(raw):
            stop, symbols = at, 0
            while stop < len(raw) and (stop == at or symbols + len(raw[stop]) <= ROUND_SYMBOLS):
                symbols += len(raw[stop])
                stop += 1
            counts.update(zip(fresh[at:stop], self.merged_lengths(raw[at:stop]).tolist(), strict=True))
            at = stop
        get = counts.__getitem__
        for memo, part, ps in cut:
            memo[part] = sum(map(get, ps))

    def count(self, batch: list[str]) -> list[int]:
        """The number of tokens of each text; special strings in a text are one token each."""
        segments, extra = [], []
        for text in batch:
            if self.special is not None and any(s in text for s in self.specials):
                own = self.special.split(text)
                segments.append(own)
                extra.append(len(own) - 1)
            else:
                segments.append([text])
                extra.append(0)
        cut = [[parts(s) for s in own] for own in segments]
        known_spaced, known_plain = self.spaced, self.plain
        spaced = {s for own in cut for _, rest in own for s in rest if s not in known_spaced}
        plain = {s for own in cut for head, _ in own for s in head if s not in known_plain}
        if len(known_spaced) + len(spaced) + len(known_plain) + len(plain) > MEMO_PARTS:
            self.spaced, self.plain = {}, {"": 0}
            spaced = {s for own in cut for _, rest in own for s in rest}
            plain = {s for own in cut for head, _ in own for s in head if s}
        if spaced or plain:
            self.learn(spaced, plain)
        a, b = self.plain.__getitem__, self.spaced.__getitem__
        return [x + sum(sum(map(a, head)) + sum(map(b, rest)) for head, rest in own) for x, own in zip(extra, cut, strict=True)]


@lru_cache(maxsize=2)
def merge_counter(path: str, pattern: str) -> MergeCounter:
    """The counter of this worker process; later tasks find what earlier ones remembered."""
    gc.set_threshold(100_000)
    return MergeCounter(path, pattern)


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of every whole text; one row per row of ``docs``, nothing is shuffled.

    Columns: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens). A null text is the
    empty one: 0 bytes, 0 tokens. Null and repeated keys are kept as they are; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merge_counter(path, pattern)
        for batch in slices(batches):
            own = texts(batch.column(1))
            n = np.array(counter.count(own), np.int64)
            n_bytes = np.fromiter((len(t.encode()) for t in own), np.int64, len(own))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": n_bytes, "n_tokens": n, "over_limit": n > limit})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
