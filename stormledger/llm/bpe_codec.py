"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash resolves pre-tokens that are vocabulary entries as a whole; what it misses goes
through merges, driven by a heap over linked bytes. Decoding gathers the ids' bytes.

Ranks follow the tiktoken convention: the pair whose joined bytes have the lowest rank merges first, leftmost on ties.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, texts
from .perfect_hash import PerfectHash
from .text_parts import letters_and_marks, parts

#: Parts of texts whose ids a worker remembers; about 250 bytes each.
MEMO_PARTS = 500_000

def load_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file in the order of their ranks (ranks are 0, 1, 2, ...)."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


class ByteBpe:
    """Encodes and decodes with the ranks in ``path``; ``pattern`` cuts texts into pre-tokens.

    Each part of a text (see ``text_parts``) is encoded once and remembered.
    """

    def __init__(self, path: str, pattern: str):
        self.tokens = load_ranks(path)
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        self.whole = PerfectHash(self.tokens)
        self.pairs = [self.ranks.get(bytes((i >> 8, i & 255)), -1) for i in range(1 << 16)]
        self.pretokens = regex.compile(pattern).findall
        self.decimals = list(map(str, range(len(self.tokens))))
        #: Known parts: as little-endian ids and as decimals. Those in ``spaced`` stand without the space before them.
        self.spaced: dict[str, tuple[bytes, str]] = {}
        self.plain: dict[str, tuple[bytes, str]] = {"": (b"", "")}

    def merge(self, piece: bytes) -> list[int]:
        """Merges for one pre-token: a heap of ranked neighbours over a doubly linked list of byte ranges.

        ``now[i]`` is the rank of the pair that starts at i, -1 for none; a heap entry that disagrees is stale.
        """
        n, get, pairs = len(piece), self.ranks.get, self.pairs
        bits = 10 if n < 1024 else 40  # of the position in a heap entry
        mask = (1 << bits) - 1
        now = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
        now.append(-1)
        heap = [r << bits | i for i, r in enumerate(now) if r >= 0]
        heapify(heap)
        end, before = list(range(1, n + 1)), list(range(-1, n))
        while heap:
            top = heappop(heap)
            i = top & mask
            if now[i] != top >> bits:
                continue
            j = end[i]
            stop = end[i] = end[j]
            now[j] = now[i] = -1
            if stop < n:
                before[stop] = i
                r = get(piece[i : end[stop]])
                if r is not None:
                    now[i] = r
                    heappush(heap, r << bits | i)
            if i:
                p = before[i]
                r = get(piece[p:stop])
                if r is None:
                    now[p] = -1
                else:
                    now[p] = r
                    heappush(heap, r << bits | p)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def learn(self, spaced: set[str], plain: set[str]) -> None:
        """Remember parts: one vectorised look-up for all their pre-tokens, merges for what it misses."""
        cut = [(self.spaced, s, letters_and_marks(s) or self.pretokens(" " + s)) for s in spaced]
        cut += [(self.plain, s, self.pretokens(s)) for s in plain]
        flat = list({p for _, _, ps in cut for p in ps})
        raw = [p.encode() for p in flat]
        ids = {}
        for p, b, i in zip(flat, raw, self.whole.lookup(raw).tolist(), strict=True):
            if i >= 0:
                ids[p] = [i]
            elif known := self.spaced.get(p[1:]) if p[0] == " " else self.plain.get(p):
                ids[p] = array("I", known[0]).tolist()
            else:
                ids[p] = self.merge(b)
        decimal = self.decimals.__getitem__
        for memo, part, ps in cut:
            own = ids[ps[0]] if len(ps) == 1 else [i for p in ps for i in ids[p]]
            memo[part] = (array("I", own).tobytes(), " ".join(map(decimal, own)))

    def encode_parts(self, batch: list[str]) -> list[list[tuple[bytes, str]]]:
        """For each text its parts' ids, as little-endian bytes and as decimals."""
        cut = [parts(t) for t in batch]
        known_spaced, known_plain = self.spaced, self.plain
        spaced, plain = {s for _, rest in cut for s in rest if s not in known_spaced}, {s for head, _ in cut for s in head if s not in known_plain}
        if len(known_spaced) + len(spaced) + len(known_plain) + len(plain) > MEMO_PARTS:
            self.spaced, self.plain = {}, {"": (b"", "")}
            spaced, plain = {s for _, rest in cut for s in rest}, {s for head, _ in cut for s in head if s}
        if spaced or plain:
            self.learn(spaced, plain)
        return [[*map(self.plain.__getitem__, head), *map(self.spaced.__getitem__, rest)] for head, rest in cut]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(a for a, _ in self.encode_parts([text])[0]), "<u4").tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, joined."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """The codec of this worker process; later tasks find what earlier ones remembered."""
    gc.set_threshold(100_000)
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again; one row per row of ``docs``, nothing is shuffled.

    Columns: ``doc_id``, ``n_tokens``, ``ids_sha256`` (of the decimal ids, joined by a space), ``decoded_sha256`` (of
    the decoded bytes) and, with ``keep_ids``, ``ids`` (array of int) and ``decoded`` (the text). A null text is the empty
    one: no ids, digests of nothing. Null and repeated keys are kept as they are; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(path, pattern)
        for batch in slices(batches):
            rows = {"doc_id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for own in codec.encode_parts(texts(batch.column(1))):
                ids = np.frombuffer(b"".join([a for a, _ in own]), "<u4")
                decoded = codec.decode(ids)
                rows["n_tokens"].append(len(ids))
                rows["ids_sha256"].append(hashlib.sha256(" ".join([d for _, d in own if d]).encode()).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                if keep_ids:
                    rows["ids"].append(ids.astype(np.int32))
                    rows["decoded"].append(decoded.decode())
            if not keep_ids:
                rows.pop("ids"), rows.pop("decoded")
            else:
                rows["ids"] = pa.array(rows["ids"], pa.list_(pa.int32()))
            rows["n_tokens"] = pa.array(rows["n_tokens"], pa.int64())
            yield pa.RecordBatch.from_pydict(rows)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, schema)
