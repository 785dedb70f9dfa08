"""Token-id output in binary shards with keyed access.

A shard is two files. ``.ids`` holds the ids of its documents one after another, as unsigned little-endian integers.
``.idx`` holds, in order: a header (magic, bytes of an id, documents, keys, seed), the documents' keys and numbers of ids in their order, a
minimal perfect hash over the distinct keys (one displacement for each bucket), and for each of its slots a fingerprint
of the key, the first id's place in the shard and the number of ids. A look-up hashes the key, reads one slot and
compares the fingerprint: constant time, and no key is stored in the hash itself.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib
from collections.abc import Iterator
from contextlib import ExitStack
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import cut, fresh_dir, slices, texts
from .perfect_hash import displacements, mixed, slot_of
from .storage import committed, reading
from .text_parts import MARKS

MAGIC = b"IDSHARD1"
HEADER = struct.Struct("<8sIQQQ")
SLOT = np.dtype([("fingerprint", "<u4"), ("at", "<u8"), ("n", "<u8")])
#: Words whose ids a worker remembers; about 180 bytes each.
MEMO_WORDS = 600_000
#: Words that are encoded as one text: a call costs as much as several words.
JOINED_WORDS = 400
#: Bytes of ids that a reader holds at once, unless one document has more.
READ_BYTES = 4 << 20
_NULL_KEY = -(2**63)


class WordEncoder:
    """Encodes texts with a tokenizers file whose pre-tokens hold no white space; each word is encoded once."""

    def __init__(self, path: str, end_id: int, id_type: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.end, self.id_type = np.array([end_id], id_type).tobytes(), id_type
        self.memo: dict[str, bytes] = {"": b""}
        # The last id of each pre-token is known by its suffix, if every byte has such an id.
        vocab, suffix = self.tokenizer.get_vocab(with_added_tokens=False), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for w, i in vocab.items() if suffix and w.endswith(suffix)]] = True
        self.joins = bool(suffix) and all(c + suffix in vocab for c in ByteLevel.alphabet())

    def ids(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.id_type).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def joined_ids(self, words: list[str]) -> list[bytes]:
        """What `ids` gives of words of letters. Many are encoded as one text, and its ids are cut where pre-tokens end.

        A word gives one pre-token at least; where there are more than words, the words are encoded one by one.
        """
        parts = [words[i : i + JOINED_WORDS] for i in range(0, len(words), JOINED_WORDS)]
        out = []
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(list(map(" ".join, parts)), add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.id_type)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                out += [raw[i:j] for i, j in zip([0, *cuts], cuts, strict=False)]
            else:
                out += self.ids(part)
        return out

    def learn(self, words: set[str]) -> None:
        """Letters with marks after them are two runs of the pattern, so each run is encoded once."""
        memo = self.memo
        split, whole = [], set()
        for w in words:
            run = w if w.isalpha() else w.rstrip(MARKS)
            if run != w and run.isalpha():
                split.append((w, run, w[len(run) :]))
                whole.update((run, w[len(run) :]))
            else:
                whole.add(w)
        fresh = whole.difference(memo)
        letters = list(filter(str.isalpha, fresh)) if self.joins else []
        memo.update(zip(letters, self.joined_ids(letters), strict=True))
        others = list(fresh.difference(letters))
        memo.update(zip(others, self.ids(others), strict=True))
        memo.update([(w, memo[run] + memo[marks]) for w, run, marks in split])

    def encode(self, batch: list[str]) -> list[bytes]:
        """The ids of each text with the end id, as bytes."""
        # No pre-token reaches over a space or line feed, so the text can be cut there.
        cut_texts = [t.replace("\n", " ").split(" ") for t in batch]
        memo = self.memo
        missing = {w for ws in cut_texts for w in ws if w not in memo}
        if len(memo) + len(missing) > MEMO_WORDS:
            memo.clear()
            memo[""] = b""
            missing = {w for ws in cut_texts for w in ws if w}
        if missing:
            self.learn(missing)
        get = memo.__getitem__
        return [b"".join(map(get, ws)) + self.end for ws in cut_texts]


@lru_cache(maxsize=2)
def word_encoder(path: str, end_id: int, id_type: str) -> WordEncoder:
    """The encoder of this worker process; later tasks find what earlier ones remembered."""
    gc.set_threshold(100_000)
    return WordEncoder(path, end_id, id_type)


def key_prints(keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each integer key for the slots, and an independent fingerprint of 32 bits."""
    k = keys.astype(np.int64).view(np.uint64)
    return mixed(k, 2 * seed + 1), (mixed(k, 2 * seed + 2) >> np.uint64(32)).astype(np.uint32)


def index_bytes(keys: np.ndarray, at: np.ndarray, n: np.ndarray, id_bytes: int) -> bytes:
    """The index file of documents in ascending key order; equal keys are one entry that spans their ids."""
    if not (keys[1:] >= keys[:-1]).all():
        raise ValueError("keys must ascend")
    distinct, first = np.unique(keys, return_index=True)
    seed = 0
    while len(np.unique(key_prints(distinct, seed)[0])) < len(distinct):
        seed += 1
    h, prints = key_prints(distinct, seed)
    displaced = displacements(h, len(distinct))
    slots = np.zeros(len(distinct), SLOT)
    if len(distinct):
        slot = slot_of(h, displaced, len(distinct))
        total = np.add.reduceat(n, first)
        slots["fingerprint"][slot], slots["at"][slot], slots["n"][slot] = prints, at[first], total
    header = HEADER.pack(MAGIC, id_bytes, len(keys), len(distinct), seed)
    return header + keys.astype("<i8").tobytes() + n.astype("<u4").tobytes() + displaced.astype("<u8").tobytes() + slots.tobytes()


class ShardReader:
    """Keyed access to one shard: ``uri`` without the suffix."""

    def __init__(self, uri: str):
        self.uri = uri
        with reading(uri + ".idx") as f:
            raw = f.read()
        magic, self.id_bytes, docs, n, self.seed = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't a shard")
        at = HEADER.size
        self.keys = np.frombuffer(raw, "<i8", docs, at)
        self.lengths = np.frombuffer(raw, "<u4", docs, at + 8 * docs).astype(np.int64)
        at += 12 * docs
        buckets = max(1, -(-n // 4))
        self.displaced = np.frombuffer(raw, "<u8", buckets, at)
        self.slots = np.frombuffer(raw, SLOT, n, at + 8 * buckets)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is there (by its fingerprint), its first id's place and its number of ids."""
        if not len(self.slots):
            none = np.zeros(len(keys), np.int64)
            return none.astype(bool), none, none
        h, prints = key_prints(keys, self.seed)
        entry = self.slots[slot_of(h, self.displaced, len(self.slots))]
        return entry["fingerprint"] == prints, entry["at"].astype(np.int64), entry["n"].astype(np.int64)

    def payloads(self, at: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of ascending, separate ranges; read in blocks."""
        kind, size = f"<u{self.id_bytes}", self.id_bytes
        with reading(self.uri + ".ids") as f:
            i = 0
            while i < len(at):
                j = i + 1
                while j < len(at) and (at[j] + n[j] - at[i]) * size <= READ_BYTES:
                    j += 1
                block = np.frombuffer(f.read_at(int(at[j - 1] + n[j - 1] - at[i]) * size, int(at[i]) * size), kind)
                for k in range(i, j):
                    yield block[at[k] - at[i] : at[k] - at[i] + n[k]]
                i = j


def write_shards(docs: DataFrame, path: str, out: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", id_type: str = "<u2") -> DataFrame:
    """Encode every whole text and write its ids, ``end_id`` last, in ascending order of keys; one row per shard.

    Range-partitions the texts once; each task sorts its range, encodes and streams it to a shard of its own.
    Null texts are empty; null keys sort first and share one entry; equal keys share one entry and stand in order of text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path, end_id, id_type)
        size, keys, counts, base = np.dtype(id_type).itemsize, [], [], None
        with ExitStack() as stack:
            for batch in slices(batches):
                if base is None:
                    base = f"{out}/shard-{TaskContext.get().partitionId():06d}"
                    stream = stack.enter_context(committed(base + ".ids"))
                own = encoder.encode(texts(batch.column(1)))
                stream.write(b"".join(own))
                keys.extend(_NULL_KEY if k is None else k for k in batch.column(0).to_pylist())
                counts.extend(len(x) // size for x in own)
        if base is None:
            return
        n = np.array(counts, np.int64)
        with committed(base + ".idx") as f:
            f.write(index_bytes(np.array(keys, np.int64), np.cumsum(n) - n, n, size))
        yield pa.RecordBatch.from_pydict({"shard": [base], "first_key": pa.array([keys[0]], pa.int64()), "n_docs": pa.array([len(keys)], pa.int64()), "n_tokens": pa.array([int(n.sum())], pa.int64())})

    texts_by_key = docs.select(docs[id_col].cast("long").alias("k"), docs[text_col].alias("t")).repartitionByRange("k").sortWithinPartitions("k", "t")
    return cut(texts_by_key.mapInArrow(run, "shard string, first_key long, n_docs long, n_tokens long"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards, found by its key: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    The manifest, one row per shard, passes the driver for the running sum of ids. A task reads a shard in blocks.
    Documents that share a key are told apart by the lengths in the index.
    """
    spark = manifest.sparkSession
    rows = sorted(manifest.collect(), key=lambda r: (r.first_key, r.shard))
    starts = [0, *accumulate(r.n_tokens for r in rows)]
    tasks = spark.createDataFrame([(r.shard, s) for r, s in zip(rows, starts, strict=False)], "shard string, base long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = ShardReader(shard)
                keys, order = np.unique(reader.keys, return_index=True)
                there, at, n = reader.find(keys)
                if not there.all():
                    raise ValueError(f"{shard}: a key isn't in the index")
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                stops = [*order[1:].tolist(), len(reader.keys)]
                for key, i, j, first, ids in zip(keys.tolist(), order.tolist(), stops, at.tolist(), reader.payloads(at, n), strict=True):
                    a = 0
                    for length in reader.lengths[i:j].tolist():
                        out["doc_id"].append(None if key == _NULL_KEY else key)
                        out["start"].append(base + first + a)
                        out["n_tokens"].append(length)
                        out["ids_crc32"].append(zlib.crc32(ids[a : a + length].astype("<u4").tobytes()))
                        a += length
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return tasks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, path: str, end_id: int = 2, out: str | None = None) -> DataFrame:
    """Write the shards (below the shared folder unless ``out`` is given) and read every document back from them."""
    out = out or fresh_dir(docs.sparkSession, "token-shards")
    return read_shards(write_shards(docs, path, out, end_id))
