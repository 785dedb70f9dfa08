"""Near-duplicate passages by compact windows.

A text is a sequence of shingles. Under a hash function, the Cartesian tree over the shingles' hashes groups all passages of the
least length by the position of their least hash: a compact window (p, a, b) stands for the passages that reach at most a
shingles before p and b after it. Windows of different texts that share a function and a hash meet; where their extents leave
room for a passage, all passages there share that min-hash. Passages that share it under enough functions are
candidates, and their shingles decide.

A key's windows first meet its leaders alone. Where a window's check fails, the stretches that the windows of its key cover are
cut out of their texts once and meet again, by the min-hashes of groups of further functions: first with a leader, then
those that failed with a few texts of each class of the group's key.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from operator import sub

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, texts, tidy
from .components import connected_components
from .perfect_hash import mixed

#: Words of a shingle, words of the shortest passage, hash functions, functions that must agree, similarity.
SHINGLE, LEAST_WORDS, FUNCTIONS, AGREE, SIMILARITY = 5, 50, 6, 3, 0.8
#: Windows that a task combines before it sends them on; words that are hashed at once; grid of requested passages.
COMBINED, AT_ONCE, GRID = 1_500_000, 10_000, 64
#: The base of words' hashes, and its inverse modulo 2^64.
_BASE, _INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
REACH = LEAST_WORDS - SHINGLE + 1  # shingles of the shortest passage
#: Groups of further functions, and functions of a group, all of which must agree: passages with a Jaccard of 0.8 miss all groups with probability 0.03, those with 0.4 meet with 0.05.
GROUPS, GROUPED = 12, 6
_WINDOW = "key long, tid long, spot long, leader long, leader_spot long"


def text_key(text: str) -> int:
    """A text's 64-bit hash, signed: copies share it."""
    x = xxhash.xxh3_64_intdigest(text.encode())
    return x - (1 << 64) if x >= 1 << 63 else x


class Shingler:
    """Shingle hashes of texts; a word's hash is a difference of running sums over the bytes of many."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def words(self, words: list[str]) -> np.ndarray:
        b = np.frombuffer(" ".join(words).encode(), np.uint8)
        if len(b) >= len(self.powers):
            self.powers, self.inverses = (np.multiply.accumulate(np.append(np.uint64(1), np.full(2 * len(b), x, np.uint64))) for x in (_BASE, _INVERSE))
        end = np.append(np.flatnonzero(b == 32), len(b))
        start = np.append(0, end[:-1] + 1)
        sums = np.append(np.uint64(0), np.cumsum(b * self.powers[: len(b)]))
        return mixed((sums[end] - sums[start]) * self.inverses[start], 2)

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().split()
        if len(words) < SHINGLE:
            return np.empty(0, np.uint64)
        h = np.concatenate([self.words(words[i : i + AT_ONCE]) for i in range(0, len(words), AT_ONCE)])
        n = len(words) - SHINGLE + 1
        out = h[:n].copy()
        for i in range(1, SHINGLE):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        return mixed(out, 1)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from the least of 2, 4, 8 and so on."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :])


def compact_windows(shingles: np.ndarray, owner_end: np.ndarray, function: int, reach: int = REACH) -> tuple[np.ndarray, ...]:
    """(position, a, b, hash) of the windows of concatenated texts; ``owner_end`` is for each shingle its text's end.

    Only nodes of the Cartesian tree whose span has a passage count: those are the least of some passage. Equal hashes are
    ordered by position modulo the passage's length, so a run of equal shingles gives one window a passage.
    """
    n = len(shingles)
    h = (mixed(shingles, function + 10) >> np.uint64(32)).astype(np.int64)
    residue = np.arange(n) % reach
    least = sliding_least(h << 6 | residue, reach)
    start = np.flatnonzero(owner_end[: n - reach + 1] >= np.arange(n - reach + 1) + reach)
    least = least[start]
    at = start + (((least & 63) - start) % reach)
    new = np.append(True, (at[1:] != at[:-1]) | (np.diff(start) > 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    p = at[first]
    return p, p - start[first], start[last] + reach - 1 - p, least[first] >> 6


def meet(key: np.ndarray, tid: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted rows the indices of leaders, of followers, and of each follower's leader.

    A window follows the first leader of its key, of whichever text, that leaves room for a passage; without one it leads.
    So a key with very many windows has few leaders, and every window has one. A leader of the window's own text is no
    match, but is given, so that the window isn't lost (see ``unsettled``).
    """
    a, b = spot >> 6 & 63, spot & 63
    new = np.append(True, key[1:] != key[:-1])
    open_ = np.arange(len(key))
    leader_of = np.empty(len(key), np.int64)
    group = np.cumsum(new)
    while len(open_):
        g = group[open_]
        head = np.append(True, g[1:] != g[:-1])
        lead = open_[np.flatnonzero(head)[np.cumsum(head) - 1]]
        room = np.minimum(a[lead], a[open_]) + np.minimum(b[lead], b[open_]) + 1 >= REACH
        room |= lead == open_
        leader_of[open_[room]] = lead[room]
        open_ = open_[~room]
    follower = np.flatnonzero(leader_of != np.arange(len(key)))
    return np.flatnonzero(leader_of == np.arange(len(key))), follower, leader_of[follower]


def _combine(key: np.ndarray, tid: np.ndarray, spot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Leaders as windows, followers as matches with their leaders."""
    order = np.lexsort((spot, tid, key))
    key, tid, spot = key[order], tid[order], spot[order]
    lead, follow, of = meet(key, tid, spot)
    yield _rows(key[lead], tid[lead], spot[lead], None, None)
    yield _rows(key[follow], tid[follow], spot[follow], tid[of], spot[of])


def _matched(key: np.ndarray, tid: np.ndarray, spot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What `_combine` gives, of the leaders those alone whose key has others."""
    lead, follow = _combine(key, tid, spot)
    k = lead.column(0).to_numpy()
    same = np.concatenate([[False], k[1:] == k[:-1], [False]])
    yield lead.filter(pa.array(same[1:] | same[:-1]))
    yield follow


def _rows(key: np.ndarray, tid: np.ndarray, spot: np.ndarray, leader: np.ndarray | None, leader_spot: np.ndarray | None) -> pa.RecordBatch:
    none = pa.nulls(len(key), pa.int64())
    return pa.RecordBatch.from_pydict({"key": key, "tid": tid, "spot": spot, "leader": none if leader is None else leader, "leader_spot": none if leader_spot is None else leader_spot})


def windows(docs: DataFrame) -> DataFrame:
    """Windows of all texts (column ``text``), combined within a task: its leaders, and matches of the windows that follow them.

    ``key`` is function and hash, ``spot`` is position, a and b. A text that a task has met already gives nothing more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(100_000)
        shingler, seen, held, count = Shingler(), set(), [], 0
        for batch in slices(batches):
            ids, parts = [], []
            for t in texts(batch.column(0)):
                k = text_key(t)
                if k not in seen:
                    seen.add(k)
                    s = shingler(t)
                    if len(s) >= REACH:
                        ids.append(k)
                        parts.append(s)
            if not parts:
                continue
            n = np.fromiter(map(len, parts), np.int64, len(parts))
            ends = np.cumsum(n)
            owner = np.repeat(np.arange(len(n)), n)
            shingles, keys = np.concatenate(parts), np.array(ids, np.int64)
            for f in range(FUNCTIONS):
                p, a, b, h = compact_windows(shingles, ends[owner], f)
                own = owner[p]
                # The shingle itself is what windows share, so all 64 bits of it are the key.
                key = (mixed(shingles[p], f + 40) & ~np.uint64(7) | np.uint64(f)).view(np.int64)
                held.append((key, keys[own], (p - (ends - n)[own]) << 12 | a << 6 | b))
                count += len(p)
            if count > COMBINED:
                yield from _combine(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, count = [], 0
        if held:
            yield from _combine(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return docs.select("text").mapInArrow(run, _WINDOW)


def matches(found: DataFrame) -> DataFrame:
    """All matches: those within tasks, and those of leaders that meet by key; one shuffle of the leaders.

    Leaders of a key that has several are given too, without a leader of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tid = spot = np.empty(0, np.int64)
        for batch in batches:
            known = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            if known.any():
                yield batch.filter(pa.array(known))
            own = [batch.column(i).to_numpy()[~known] for i in range(3)]
            key, tid, spot = (np.append(x, y) for x, y in zip((key, tid, spot), own, strict=True))
            if len(key) and key[0] != key[-1]:
                last = int(np.searchsorted(key, key[-1]))
                yield from _matched(key[:last], tid[:last], spot[:last])
                key, tid, spot = key[last:], tid[last:], spot[last:]
            elif len(key) > COMBINED:  # one key with very many leaders: go on with fewer
                lead, follow, of = meet(key, tid, spot)
                yield _rows(key[follow], tid[follow], spot[follow], tid[of], spot[of])
                key, tid, spot = key[lead], tid[lead], spot[lead]
        if len(key):
            yield from _matched(key, tid, spot)

    place = F.when(F.col("leader").isNull(), F.col("key")).otherwise(F.xxhash64("tid", "leader"))
    return found.repartition(place).sortWithinPartitions(F.col("leader").isNull(), "key", "tid").mapInArrow(run, _WINDOW)


_PAIR = "tid long, start int, stop int, leader long, leader_start int, leader_stop int"


def candidate_passages(found: DataFrame, agree: int = AGREE) -> DataFrame:
    """Passages of two texts that share min-hashes under enough functions: (text, shingles from, to) twice, ends exclusive."""

    def region(rows: np.ndarray, tid: int, leader: int) -> Iterator[tuple]:
        f, spot, other = rows[:, 0] & 7, rows[:, 1], rows[:, 2]
        p, q = spot >> 12, other >> 12
        a = np.minimum(spot >> 6 & 63, other >> 6 & 63)
        b = np.minimum(spot & 63, other & 63)
        low = int((p - a).min())
        size = int((p + b).max()) - low + 1
        total = np.zeros(size, np.int64)
        for k in np.unique(f):
            on = f == k
            step = np.zeros(size + 1, np.int64)
            np.add.at(step, p[on] - a[on] - low, 1)
            np.add.at(step, p[on] + b[on] + 1 - low, -1)
            total += np.cumsum(step)[:-1] > 0
        ok = np.flatnonzero(np.diff(np.concatenate([[0], (total >= agree).astype(np.int8), [0]])))
        for s, e in zip(ok[::2] + low, ok[1::2] + low, strict=True):
            if e - s >= REACH:
                inside = (p >= s) & (p < e)
                if inside.any():
                    yield tid, int(s), int(e), leader, max(0, int((q - p)[inside].min() + s)), int((q - p)[inside].max() + e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, 5), np.int64)

        def give(x: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.append(True, (x[1:, 3:] != x[:-1, 3:]).any(axis=1)))
            n = np.diff(np.append(first, len(x)))
            enough = np.bitwise_count(np.bitwise_or.reduceat(1 << (x[:, 0] & 7), first)) >= agree  # most pairs share too few functions
            x, n = x[np.repeat(enough, n)], n[enough]
            cuts = np.cumsum(n)[:-1]
            out = [r for g in np.split(x, cuts) if len(g) for r in region(g, int(g[0, 3]), int(g[0, 4]))]
            kinds = [pa.int64(), pa.int32(), pa.int32()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], [c.split()[0] for c in _PAIR.split(", ")])

        for batch in batches:
            rest = np.concatenate([rest, np.column_stack([batch.column(i).to_numpy() for i in (0, 2, 4, 1, 3)])])
            if len(rest):
                last = np.flatnonzero((rest[:, 3:] != rest[-1, 3:]).any(axis=1))
                if len(last):
                    yield give(rest[: last[-1] + 1])
                    rest = rest[last[-1] + 1 :]
        if len(rest):
            yield give(rest)

    return found.repartition("tid", "leader").sortWithinPartitions("tid", "leader").mapInArrow(run, _PAIR)


def passage_prints(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The shingles' 32-bit prints of each asked passage (``at`` document, ``lo``, ``hi``); texts and requests meet by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, at, own = Shingler(), None, None
        for batch in slices(batches):
            out: dict[str, list] = {"at": [], "lo": [], "hi": [], "prints": []}
            for k, text, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if lo is None:
                    at, own = k, text
                elif k == at:
                    if isinstance(own, str):  # only texts that are asked for are cut up
                        own = (shingler(own) >> np.uint64(32)).astype(np.uint32)
                    for name, v in zip(out, (k, lo, hi, own[lo:hi].tobytes()), strict=True):
                        out[name].append(v)
            yield pa.RecordBatch.from_pydict({n: pa.array(v, t) for (n, v), t in zip(out.items(), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)})

    rows = docs.select(F.col("doc_id").alias("at"), "text", F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))
    rows = rows.unionAll(asked.select("at", F.lit(None).cast("string").alias("text"), "lo", "hi"))
    return rows.repartition("at").sortWithinPartitions("at", F.col("lo").asc_nulls_first()).mapInArrow(run, "at long, lo int, hi int, prints binary")


def verified(pairs: DataFrame, prints: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs whose passages, trimmed to the shingles they share, are long and similar enough (Jaccard of their shingles)."""
    one = prints.select(F.col("at").alias("doc"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.col("prints").alias("x"))
    two = prints.select(F.col("at").alias("leader_doc"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.col("prints").alias("y"))
    both = pairs.withColumn("lo_a", _down("start")).withColumn("hi_a", _up("stop")).withColumn("lo_b", _down("leader_start")).withColumn("hi_b", _up("leader_stop"))
    both = both.join(one, ["doc", "lo_a", "hi_a"]).join(two, ["leader_doc", "lo_b", "hi_b"])
    return compared(both.select("tid", "start", "stop", "lo_a", "leader", "leader_start", "leader_stop", "lo_b", "x", "y"), similarity)


def compared(both: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs with the prints of both sides, ``x`` from shingle ``lo_a`` on and ``y`` from ``lo_b`` on: their similar passages."""
    names = "tid long, start int, stop int, leader long, leader_start int, leader_stop int, similarity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for tid, s, e, la, leader, ls, le, lb, x, y in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
                a = np.frombuffer(x, np.uint32)[s - la : e - la]
                b = np.frombuffer(y, np.uint32)[ls - lb : le - lb]
                out += [(tid, s + i, s + j, leader, ls + k, ls + m, v) for i, j, k, m, v in similar_passages(a, b, similarity)]
            kinds = [pa.int64(), pa.int32(), pa.int32()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], [c.split()[0] for c in names.split(", ")])

    return both.mapInArrow(run, names)


def _down(name: str) -> Column:
    return (F.col(name) - F.pmod(F.col(name), F.lit(GRID))).cast("int")


def _up(name: str) -> Column:
    return (F.ceil(F.col(name) / GRID) * GRID).cast("int")


def _stretches(places: list[int], gap: int) -> Iterator[list[int]]:
    """Ascending places, cut where more than ``gap`` lies between two."""
    at = 0
    for i in range(1, len(places)):
        if places[i] - places[i - 1] > gap:
            yield places[at:i]
            at = i
    yield places[at:]


def similar_passages(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY, reach: int = REACH) -> Iterator[tuple]:
    """Stretches of a that are similar to a stretch of b: (from, to in a, from, to in b, Jaccard), ends exclusive.

    Shared shingles of a are cut into stretches where more than a fifth of a passage isn't shared; each is trimmed to what is
    shared and compared with what of b lies between its first and last shared shingle. One that isn't similar enough
    as a whole is cut at its longest gap, and its parts are compared.
    """
    a, b = a.tolist(), b.tolist()
    own, places = set(a), {}
    for k, v in enumerate(b):
        if v in own:
            places.setdefault(v, []).append(k)
    shared = [i for i, v in enumerate(a) if v in places]
    if not shared or shared[-1] + 1 - shared[0] < reach:
        return
    gap = max(SHINGLE + 1, round(reach * (1 - similarity)) + 1)
    todo, failed = list(_stretches(shared, gap)), None
    while todo:
        part = todo.pop()
        i, j = part[0], part[-1] + 1
        if j - i < reach:
            continue
        x = set(a[i:j])
        both = x & places.keys()
        found = False
        # What it meets depends on its set alone, so the set that failed last fails again; one with too few shared members can't be similar.
        hopeless = x == failed or len(both) / len(x) < similarity
        for piece in [] if hopeless else _stretches(sorted(k for v in both for k in places[v]), gap):
            k, m = piece[0], piece[-1] + 1
            if m - k >= reach:
                y = set(b[k:m])
                common = len(x & y)
                value = common / (len(x) + len(y) - common)
                if value >= similarity:
                    found = True
                    yield i, j, k, m, value
        if not found:
            failed = x
            if len(part) > 1:
                gaps = list(map(sub, part[1:], part))
                longest = gaps.index(max(gaps))
                todo += [part[: longest + 1], part[longest + 1 :]]


def unsettled(found: DataFrame, links: DataFrame) -> DataFrame:
    """The windows of all keys under which some window's match wasn't verified: ``key``, ``tid``, ``spot``."""
    good = links.select("tid", "leader", "start", "stop")
    place = F.shiftright("spot", 12)
    matched = found.where("leader is not null")
    failed = matched.join(good, (matched["tid"] == good["tid"]) & (matched["leader"] == good["leader"]) & (place >= good["start"]) & (place < good["stop"]), "left_anti").select("key").distinct()
    sides = found.select("key", "tid", "spot").unionAll(matched.select("key", F.col("leader").alias("tid"), F.col("leader_spot").alias("spot")).distinct())
    return sides.join(cut(failed), "key", "left_semi")


def stretches(unsettled: DataFrame, agree: int = AGREE) -> DataFrame:
    """Where windows of enough functions hold a passage: ``tid``, shingles ``lo`` to ``hi`` (end exclusive), as one where at most a passage's length lies between.

    Of two texts that agree under enough functions, none of whose keys is settled, both have such a place.
    """

    def give(rows: np.ndarray) -> pa.RecordBatch:
        tid, key, spot = rows.T
        p, a, b = spot >> 12, spot >> 6 & 63, spot & 63
        first = np.flatnonzero(np.append(True, tid[1:] != tid[:-1]))
        room = np.maximum.reduceat(p + b, first) + 2
        base = np.cumsum(room) - room
        shift = np.repeat(base, np.diff(np.append(first, len(tid))))
        total = np.zeros(int(room.sum()) + 1, np.int8)
        for f in range(FUNCTIONS):  # starts of passages under a window of the function
            on = key & 7 == f
            step = np.zeros(len(total) + 1, np.int64)
            np.add.at(step, (p - a + shift)[on], 1)
            np.add.at(step, (p + b - REACH + 2 + shift)[on], -1)
            total += np.cumsum(step)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (total >= agree).astype(np.int8), [0]])))
        lo, hi = edge[::2], edge[1::2] + REACH - 1
        text = np.searchsorted(base, lo, "right") - 1
        if len(lo):
            new = np.append(True, (text[1:] != text[:-1]) | (lo[1:] - hi[:-1] > REACH))
            last = np.append(np.flatnonzero(new)[1:], len(lo)) - 1
            lo, text, hi = lo[new], text[new], hi[last]
        return pa.RecordBatch.from_pydict({"tid": tid[first][text], "lo": (lo - base[text]).astype(np.int32), "hi": (hi - base[text]).astype(np.int32)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, 3), np.int64)
        for batch in batches:
            rest = np.concatenate([rest, np.column_stack([batch.column(i).to_numpy() for i in range(3)])])
            last = np.flatnonzero(rest[:, 0] != rest[-1, 0]) if len(rest) else []
            if len(last):  # the last text may go on
                yield give(rest[: last[-1] + 1])
                rest = rest[last[-1] + 1 :]
        if len(rest):
            yield give(rest)

    return unsettled.select("tid", "key", "spot").repartition("tid").sortWithinPartitions("tid").mapInArrow(run, "tid long, lo int, hi int")


def regrouped(parts: DataFrame) -> DataFrame:
    """Passages of stretches (``tid``, ``part``, ``prints``) by the min-hashes of each group of functions: ``key``, ``tid``, ``part``, the first and last start ``lo`` and ``hi``, and the same of the key's first passage, as ``leader``, ``leader_part``, ``leader_lo``, ``leader_hi``.

    Keys of one text alone are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own_prints = [np.frombuffer(x, np.uint32) for x in batch.column(2).to_pylist()]
            n = np.fromiter(map(len, own_prints), np.int64, len(own_prints))
            ends, own = np.cumsum(n), np.repeat(np.arange(len(n)), n)
            start = np.flatnonzero(ends[own] >= np.arange(len(own)) + REACH)
            if not len(start):
                continue
            prints, text = np.concatenate(own_prints).astype(np.uint64), own[start]
            keys, texts_, first, last = [], [], [], []
            for g in range(GROUPS):
                k = np.full(len(start), g, np.uint64)
                for f in range(g * GROUPED, (g + 1) * GROUPED):
                    least = sliding_least((mixed(prints, 100 + f) >> np.uint64(32)).astype(np.int64), REACH)
                    k = mixed(k ^ least[start].view(np.uint64), 50)
                head = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (text[1:] != text[:-1])))
                tail = np.append(head[1:], len(k)) - 1
                for x, y in zip((keys, texts_, first, last), (k[head].view(np.int64), text[head], start[head], start[tail]), strict=True):
                    x.append(y)
            k, t, lo, hi = map(np.concatenate, (keys, texts_, first, last))
            order = np.lexsort((t, k))  # a stretch's places under a key as one
            k, t, lo, hi = k[order], t[order], lo[order], hi[order]
            head = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])))
            k, t, lo, hi = k[head], t[head], np.minimum.reduceat(lo, head), np.maximum.reduceat(hi, head)
            tid, part = (batch.column(i).to_numpy()[t] for i in range(2))
            shift = part - (ends - n)[t]
            yield pa.RecordBatch.from_pydict({"key": k, "tid": tid, "part": part, "lo": (lo + shift).astype(np.int32), "hi": (hi + shift).astype(np.int32)})

    rows = parts.select("tid", "part", "prints").mapInArrow(run, "key long, tid long, part int, lo int, hi int")
    over = Window.partitionBy("key")
    first = F.min(F.struct("tid", "part", "lo", "hi")).over(over)
    rows = rows.withColumns({"l": first, "m": F.max("tid").over(over)}).where("l.tid <> m")
    return rows.select("key", "tid", "part", "lo", "hi", *[F.col(f"l.{c}").alias(f"leader_{c}".replace("_tid", "")) for c in ("tid", "part", "lo", "hi")])


def _hulls(met: DataFrame) -> DataFrame:
    """One pair for each two stretches of ``met``, over all passages with which they meet."""
    ends = [F.min("lo").alias("start"), (F.max("hi") + REACH).cast("int").alias("stop")]
    ends += [F.min("leader_lo").alias("leader_start"), (F.max("leader_hi") + REACH).cast("int").alias("leader_stop")]
    return met.groupBy("tid", "part", "leader", "leader_part").agg(*ends)


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("tid").alias("u"), F.col("leader").alias("v"))


def _sides(links: DataFrame) -> DataFrame:
    """Each link from both of its texts: ``tid``, ``other``, ``start``, ``stop``."""
    there = links.select(F.col("leader").alias("tid"), F.col("tid").alias("other"), F.col("leader_start").alias("start"), F.col("leader_stop").alias("stop"))
    return links.select("tid", F.col("leader").alias("other"), "start", "stop").unionAll(there)


def _unmet(met: DataFrame, links: DataFrame, one: DataFrame, of: DataFrame) -> DataFrame:
    """Whom the passages of ``met`` that failed with their key's first text meet next; rows as ``_hulls`` takes them.

    ``links`` are all that is known so far, ``one`` those with the keys' first texts, ``of`` the classes that links make. Of each class
    that a key holds four texts stand for it, the first and last by their keys and by another hash. A passage without any link meets those of
    all classes of its key, its own among them; for passages that have one, the first and last of each two classes meet. So there are as many pairs as passages and classes, not as texts and texts.
    """
    good = one.select("tid", "leader", "start", "stop")
    failed = met.where("tid <> leader")
    inside = (good["start"] < failed["hi"] + REACH) & (good["stop"] > failed["lo"])
    left = failed.join(good, (failed["tid"] == good["tid"]) & (failed["leader"] == good["leader"]) & inside, "left_anti")
    own = ("tid", "part", "lo", "hi")
    left = cut(left.select("key", *own, "leader"))
    keys = left.groupBy("key").agg(F.min("leader").alias("leader"))  # the same for all rows of a key
    there = met.select("key", *own).join(keys, "key").join(of.select(F.col("node").alias("tid"), "component"), "tid", "left")
    by = F.struct(F.xxhash64("tid").alias("h"), *own)  # any order of its own
    ends = [F.min(F.struct(*own)).alias("a"), F.max(F.struct(*own)).alias("b"), F.min(by).alias("x"), F.max(by).alias("y")]
    there = there.groupBy("key", "leader", F.coalesce("component", "tid").alias("c")).agg(*ends)
    more = [F.struct(*[F.col(f"{x}.{c}").alias(c) for c in own]) for x in "xy"]
    heads = there.select("key", "leader", "c", "a", "b", F.explode(F.array_distinct(F.array("a", "b", *more))).alias("other"))
    heads = cut(heads.select("key", "leader", "c", "other", F.col("other").isin(F.col("a"), F.col("b")).alias("outer")).where("other.tid <> leader"))
    spans = _sides(links).groupBy("tid").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    settled = F.exists("spans", lambda x: (x["start"] <= F.col("hi")) & (x["stop"] >= F.col("lo") + REACH))
    alone = left.join(spans, "tid", "left").where(~F.coalesce(settled, F.lit(False)))
    each = alone.select("key", F.struct(*own).alias("own")).join(heads.select("key", "other"), "key").where("own.tid <> other.tid")
    others = heads.where("outer").select("key", F.col("c").alias("own_c"), F.col("other").alias("own"))
    across = others.join(heads.where("outer").select("key", "c", "other"), "key").where("own_c < c").select("key", "own", "other")
    every = each.unionAll(across)
    swap = F.col("own.tid") < F.col("other.tid")
    side = lambda c, up: F.when(swap == F.lit(up), F.col(f"own.{c}")).otherwise(F.col(f"other.{c}"))
    return every.select(*[side(c, True).alias(c) for c in own], *[side(c, False).alias(f"leader_{c}".replace("_tid", "")) for c in own])


def remaining_links(parts: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links, and the classes that they make (``node``, ``component``): ``links`` and those of the stretches that they leave unsettled (``tid``, ``part``, their first shingle, and ``prints``).

    By each key of ``regrouped``, texts are checked against the first text; what fails there, by ``_unmet``. So no passage is left
    with a failed partner only, copies cost one check, and what links connect already isn't compared again.
    """
    met = cut(regrouped(parts))

    def check(pairs: DataFrame) -> DataFrame:
        """What lies between the ends of each side is cut out before it is sent on."""
        def inside(start: str, stop: str, part: str) -> Column:
            return F.col("prints").substr(4 * (F.col(start) - F.col(part)) + 1, 4 * (F.col(stop) - F.col(start)))

        other = parts.select(F.col("tid").alias("leader"), F.col("part").alias("leader_part"), "prints")
        both = pairs.join(parts.select("tid", "part", "prints"), ["tid", "part"]).withColumn("x", inside("start", "stop", "part")).drop("prints")
        both = both.join(other, ["leader", "leader_part"]).withColumn("y", inside("leader_start", "leader_stop", "leader_part"))
        return cut(compared(both.select("tid", "start", "stop", F.col("start").alias("lo_a"), "leader", "leader_start", "leader_stop", F.col("leader_start").alias("lo_b"), "x", "y")))

    one = check(cut(_hulls(met.where("tid <> leader"))))
    links = cut(links.unionAll(one))
    of = cut(connected_components(_edges(links)))
    two = check(cut(_hulls(_unmet(met, links, one, of))))
    # The last links connect whole classes.
    class_of = lambda c: of.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    between = _edges(two).distinct().join(class_of("u"), "u", "left").join(class_of("v"), "v", "left")
    between = between.select(F.coalesce("u_c", "u").alias("u"), F.coalesce("v_c", "v").alias("v"))
    wider = connected_components(between)
    all_nodes = of.unionAll(_edges(two).select(F.explode(F.array("u", "v")).alias("node")).distinct().join(of, "node", "left_anti").select("node", F.col("node").alias("component")))
    of = all_nodes.join(wider.select(F.col("node").alias("component"), F.col("component").alias("w")), "component", "left").select("node", F.coalesce("w", "component").alias("component"))
    return cut(links.unionAll(two)), cut(of)


def merged(spans: list) -> str:
    """Sorted spans as ``from-to`` in words, overlapping ones joined."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return ",".join(f"{s}-{e}" for s, e in out)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its class, its links, and its passages of 50 words or more that other texts have too.

    ``doc_id``; ``class_id``, the smallest id of the documents that copies and links of passages connect it to; ``n_copies``, documents with
    the same text; ``n_links``, texts it was verified against with success; ``spans``, its repeated passages as ``from-to`` in words; of
    texts with copies that have 50 words, the whole. Passages are words in lower case, compared by their shingles of five.

    A window is verified against the leader of its key; only where that fails, against others that share the
    min-hashes of a group of functions with it, one by one or by their classes (see ``remaining_links``). So copies' classes come without all pairs. Null texts are empty, short texts have no passages. Ids must be whole numbers; rows with a null id are
    left out of all groups (class null, no spans), repeated ids are kept. Other columns are ignored.
    """

    @F.pandas_udf("tid long, n int")
    def key_of(t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"tid": t.map(text_key).astype("int64"), "n": t.map(lambda x: len(x.split())).astype("int32")})

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = base.where("doc_id is not null")
    with tidy(docs.sparkSession):
        each, info = _told(known, key_of)
    out = each.select("doc_id", "tid").join(info, "tid").drop("tid")
    none = base.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), F.lit("").alias("spans"))
    return out.unionAll(none)


def _told(known: DataFrame, key_of) -> tuple[DataFrame, DataFrame]:
    """Documents with their texts' keys, and what `repeated_passages` tells of each text."""
    found = cut(matches(windows(known)))
    each = cut(known.select("doc_id", key_of("text").alias("k")).select("doc_id", "k.tid", "k.n"))
    heads = cut(each.groupBy("tid").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n_copies"), F.max("n").alias("n")))

    def check(pairs: DataFrame) -> DataFrame:
        placed = pairs.join(heads.select("tid", "doc"), "tid").join(heads.select(F.col("tid").alias("leader"), F.col("doc").alias("leader_doc")), "leader")
        placed = cut(placed)
        sides = (("doc", "start", "stop"), ("leader_doc", "leader_start", "leader_stop"))
        one, two = (placed.select(F.col(doc).alias("at"), _down(s).alias("lo"), _up(e).alias("hi")) for doc, s, e in sides)
        return cut(verified(placed, cut(passage_prints(known, one.unionAll(two).distinct()))))

    links = check(candidate_passages(found.where("leader <> tid")))
    asked = cut(stretches(unsettled(found, links)).join(heads.select("tid", F.col("doc").alias("at")), "tid"))
    parts = cut(passage_prints(known, asked.select("at", "lo", "hi")).join(asked, ["at", "lo", "hi"]).select("tid", F.col("lo").alias("part"), "prints"))
    links, of = remaining_links(parts, links)
    sides = _sides(links)

    @F.pandas_udf("string")
    def joined(spans: pd.Series) -> pd.Series:
        return spans.map(lambda xs: merged([(x["start"], x["stop"]) for x in xs]))

    # Spans that overlap are nearly always equal, so the distinct ones of a text are few, however many texts share them.
    grouped = sides.select("tid", "start", (F.col("stop") + SHINGLE - 1).alias("stop")).distinct().groupBy("tid").agg(F.collect_list(F.struct("start", "stop")).alias("s")).select("tid", joined("s").alias("spans"))
    exact = sides.select("tid", "other").distinct().groupBy("tid").agg(F.count("*").alias("n_links"))
    named = heads.join(of, heads["tid"] == of["node"], "left").select("tid", "doc", "n_copies", "n", F.coalesce("component", "tid").alias("c"))
    # A class or a text may hold a third of all rows. Both sides of its join are shuffled for it alone, so adaptive execution splits it.
    names = cut(named.groupBy("c").agg(F.min("doc").alias("class_id")))
    whole = (F.col("n_copies") > 1) & (F.col("n") >= LEAST_WORDS)
    info = named.join(names, "c").join(exact, "tid", "left").join(grouped, "tid", "left")
    info = info.select("tid", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(whole, F.concat(F.lit("0-"), F.col("n"))).otherwise(F.coalesce("spans", F.lit(""))).alias("spans"))
    return each, cut(info)
