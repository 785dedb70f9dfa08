"""Document fingerprints by a homomorphic multiset hash.

A paragraph is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo
powers of two. So the order of paragraphs doesn't matter, and a paragraph can be added to or taken from a fingerprint
without the rest of the text. A vector has two ranges of lanes:

* identity lanes, pseudo-random words drawn from the whole paragraph's hash: equal multisets of paragraphs agree in all, and
  others in all with negligible chance;
* likeness lanes, a count sketch (one lane and sign each) of the paragraph's word pairs: the cosine of two fingerprints'
  likeness lanes estimates that of the documents' word pairs.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts
from .perfect_hash import mixed

#: Lanes and bits of each range. A likeness lane is a signed count modulo 2**20.
IDENTITY_LANES, IDENTITY_BITS, LIKENESS_LANES, LIKENESS_BITS = 16, 32, 128, 20
#: Characters whose word pairs are hashed at once, and words whose hashes a task remembers.
BATCH_CHARS, MEMO_WORDS = 2_000_000, 400_000
_I, _L = np.uint64(1 << IDENTITY_BITS), 1 << LIKENESS_BITS


class Hasher:
    """Fingerprints texts: vectors of shape (IDENTITY_LANES + LIKENESS_LANES), each lane below its power of two."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def word_hashes(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        missing = {w for w in words if w not in memo}
        if missing:
            if len(memo) + len(missing) > MEMO_WORDS:
                memo.clear()
                missing = set(words)
            one = xxhash.xxh64_intdigest
            memo.update((w, one(w)) for w in missing)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    def vectors(self, texts_: list[str]) -> np.ndarray:
        """The fingerprint of each text."""
        out = np.zeros((len(texts_), IDENTITY_LANES + LIKENESS_LANES), np.int64)
        at, chars = 0, 0
        for i, t in enumerate(texts_):
            chars += len(t)
            if chars > BATCH_CHARS:
                self._add(texts_[at : i + 1], out[at : i + 1])
                at, chars = i + 1, 0
        if at < len(texts_):
            self._add(texts_[at:], out[at:])
        return out

    def _add(self, texts_: list[str], out: np.ndarray) -> None:
        paragraphs = [t.split("\n") if t else [] for t in texts_]
        counts = np.fromiter(map(len, paragraphs), np.int64, len(paragraphs))
        flat = [p for ps in paragraphs for p in ps]
        if not flat:
            return
        owner = np.repeat(np.arange(len(texts_)), counts)
        one = xxhash.xxh64_intdigest
        h = np.fromiter((one(p, 1) for p in flat), np.uint64, len(flat))
        k = np.fromiter((one(p, 2) for p in flat), np.uint64, len(flat))
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        for lane in range(IDENTITY_LANES):
            drawn = (mixed(h + np.uint64(lane) * k, lane + 1) % _I).astype(np.int64)
            out[owner[starts], lane] = np.add.reduceat(drawn, starts) % int(_I)
        words = [p.split() for p in flat]
        n = np.fromiter(map(len, words), np.int64, len(words))
        hashed = self.word_hashes([w for ws in words for w in ws])
        if not len(hashed):
            return
        paragraph = np.repeat(np.arange(len(flat)), n)
        left, right = hashed[:-1], hashed[1:]
        inner = paragraph[1:] == paragraph[:-1]
        pair = mixed(left[inner] * np.uint64(3) + right[inner], 77)
        of = owner[paragraph[1:][inner]]
        single = np.flatnonzero(n == 1)  # a paragraph of one word is its own pair
        if len(single):
            firsts = np.cumsum(n) - n
            pair = np.append(pair, mixed(hashed[firsts[single]], 78))
            of = np.append(of, owner[single])
        lane = (pair % np.uint64(LIKENESS_LANES)).astype(np.int64)
        sign = np.where(pair >> np.uint64(63), 1.0, -1.0)
        sketch = np.bincount(of * LIKENESS_LANES + lane, weights=sign, minlength=len(texts_) * LIKENESS_LANES)
        out[:, IDENTITY_LANES:] = sketch.astype(np.int64).reshape(len(texts_), -1) % _L


def modulo(vectors: np.ndarray) -> np.ndarray:
    """Sums or differences of fingerprints, brought back below the lanes' powers of two."""
    out = vectors.copy()
    out[..., :IDENTITY_LANES] %= int(_I)
    out[..., IDENTITY_LANES:] %= _L
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each two fingerprints: 1 where equal, else the cosine of the likeness lanes (not below 0)."""
    x, y = (v[..., IDENTITY_LANES:].astype(np.float64) for v in (a, b))
    x, y = (np.where(v >= _L // 2, v - _L, v) for v in (x, y))
    norm = np.sqrt((x * x).sum(-1) * (y * y).sum(-1))
    cosine = np.divide((x * y).sum(-1), norm, out=np.zeros_like(norm), where=norm > 0)
    return np.where((a == b).all(-1), 1.0, np.clip(cosine, 0.0, 1.0))


def as_text(vectors: np.ndarray) -> list[str]:
    """Fingerprints in hex: 8 digits for each identity lane, then 5 for each likeness lane."""
    identity = vectors[:, :IDENTITY_LANES].astype(">u4").tobytes().hex()
    wide = vectors[:, IDENTITY_LANES:].astype(">u4").tobytes().hex()
    a, b = 8 * IDENTITY_LANES, 8 * LIKENESS_LANES
    return [identity[i * a : i * a + a] + "".join([wide[j + 3 : j + 8] for j in range(i * b, i * b + b, 8)]) for i in range(len(vectors))]


def from_text(fingerprint: str) -> np.ndarray:
    """The lanes of a fingerprint in hex."""
    a = 8 * IDENTITY_LANES
    return np.array([int(fingerprint[i : i + 8], 16) for i in range(0, a, 8)] + [int(fingerprint[i : i + 5], 16) for i in range(a, len(fingerprint), 5)], np.int64)


def combine(fingerprint: str, added: str | None = None, removed: str | None = None) -> str:
    """A fingerprint with another's paragraphs added and a third's removed."""
    v = from_text(fingerprint)
    if added:
        v = v + from_text(added)
    if removed:
        v = v - from_text(removed)
    return as_text(modulo(v)[None, :])[0]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every whole text; nothing is shuffled. Null texts are empty: all lanes 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fingerprint": as_text(hasher.vectors(texts(batch.column(1))))})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def _ranges(docs: DataFrame, id_col: str, shards: int) -> tuple[np.ndarray, dict[int, int]]:
    """Bounds that cut the ids into ranges of about equal size, and the largest id of each range that has any.

    Read from the ids alone; what comes to the driver is one number for each range.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("k")).where("k is not null")
    cuts = ids.stat.approxQuantile("k", [i / shards for i in range(1, shards)], 0.2 / shards) if shards > 1 else []
    bounds = np.array(sorted(set(map(int, cuts))), np.int64)

    @F.pandas_udf("int")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(), side="right").astype(np.int32))

    return bounds, {r.s: r.top for r in ids.groupBy(shard("k").alias("s")).agg(F.max("k").alias("top")).collect()}


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, whose last half is the next document's beginning.

    The last floor(n_chars / 2) code points give way to as many first ones (or all) of the document with the next smaller id;
    after the smallest comes the largest. Columns: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next`` (likeness to the edited text's and to the next document's fingerprint).

    The ids are cut into ranges; each range's texts, and the one text that follows them, meet in a task in order. So the
    texts are shuffled once. Null texts are empty. Equal ids stand in order of text. A row without an id isn't in the order: its next
    is the empty text, and it is nobody's next. Other columns are ignored; a single document is its own next.
    """
    spark = docs.sparkSession
    parts = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, tops = _ranges(docs, id_col, 4 * parts)
    order = sorted(tops, reverse=True)  # ranges in the order of the documents
    # The first document of each range is also read by the range before it, as a guest.
    guest_of = {tops[s]: order[i - 1] for i, s in enumerate(order)}

    @F.pandas_udf("array<int>")
    def places(k: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, k.to_numpy(), side="right").tolist()
        return pd.Series([[s, g] if (g := guest_of.get(x, s)) != s else [s] for x, s in zip(k.tolist(), own, strict=True)])

    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    cols = docs.select(key.alias("k"), text.alias("t"))
    apart = F.array((-1 - F.pmod(F.xxhash64("t"), F.lit(parts))).cast("int"))
    placed = cols.withColumn("p", F.when(F.col("k").isNull(), apart).otherwise(places(F.coalesce("k", F.lit(0)))))
    placed = placed.select("k", "t", F.posexplode("p").alias("at", "s")).select("s", "k", "t", (F.col("at") > 0).alias("guest"))
    # Within a range: its own texts in descending order, then the guests (more than one if ids repeat), of which the first counts.
    ordered = placed.repartition(parts, "s").sortWithinPartitions("s", "guest", F.desc("k"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(100_000)
        hasher = Hasher()
        held: list[tuple[int, int | None, str, bool]] = []  # shard, id, text, whether it's another range's first
        first: dict[int, str] = {}

        def finish(rows: list, following: list[str]) -> pa.RecordBatch:
            own = [t for _, _, t, _ in rows]
            edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(own, following, strict=True)]
            v = hasher.vectors([*own, following[-1]])
            e = hasher.vectors(edited)
            # Each text's next is the row after it, except at the end of a range that closes on its own first text.
            nxt = v[1:].copy()
            for i, (a, b) in enumerate(zip(following[:-1], own[1:], strict=True)):
                if a is not b:
                    nxt[i] = hasher.vectors([a])[0]
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array([k for _, k, _, _ in rows], pa.int64()),
                "n_chars": pa.array([len(t) for t in own], pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": as_text(v[:-1]),
                "edited_fingerprint": as_text(e),
                "near_edited": likeness(v[:-1], e),
                "near_next": likeness(v[:-1], nxt),
            })

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            """Give the held rows whose next is known; the last of a range that had no guest closes the circle."""
            rows, following = [], []
            keep = []
            for i, row in enumerate(held):
                s, _, t, guest = row
                if guest:
                    continue
                if s < 0:
                    rows.append(row)
                    following.append("")
                elif i + 1 < len(held) and held[i + 1][0] == s:
                    rows.append(row)
                    following.append(held[i + 1][2])
                elif i + 1 < len(held) or last:
                    rows.append(row)
                    following.append(first[s])
                else:
                    keep.append(row)
            held[:] = keep
            if rows:
                yield finish(rows, following)

        for batch in slices(batches):
            for s, k, t, guest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                first.setdefault(s, t)
                held.append((s, k, t, guest))
            for s in set(first) - {held[-1][0]} - {r[0] for r in held}:
                del first[s]
            yield from close(False)
        yield from close(True)

    kind = docs.schema[id_col].dataType.simpleString()
    out = ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
