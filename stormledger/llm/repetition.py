"""Quality rules over words, symbols and repetition.

Repetition is measured as coverage: rolling hashes of several n-gram lengths find the n-grams that stand twice or more in a
text, and the characters inside any of them are counted once each, as are those of lines that repeat an earlier line. All
of it is numpy over the bytes of a batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_scan import buffers, byte_class, characters, hashes, pieces, running, within, words
from .perfect_hash import mixed

SYMBOLS = byte_class("#*$%&|<>")
#: Words to a window of the base rule; the fewest words; percent of the words that may stand in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 3, 50, 50
#: Percent of a text's word characters that may lie inside duplicated n-grams, by n. The published limits (15 down to 10) count
#: repeats without their first occurrence; here every occurrence is covered, so the limits are three times as high: a short
#: text in which a line or two stand twice stays, one that says a passage again and again doesn't.
NGRAM_LIMITS = {5: 45, 6: 42, 7: 39, 8: 36, 9: 33, 10: 30}
#: Percent of the word characters that may lie in lines that repeat an earlier one.
LINE_LIMIT = 30
_BASE = np.uint64(0x9E3779B97F4A7C15)
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in NGRAM_LIMITS)]


def rolled(hashes_: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length n, in ascending order, the hash of every run of n words: the one of n - 1 times a base plus the next word's."""
    h = hashes_
    for n in range(1, max(lengths) + 1):
        if n > 1:
            h = h[: max(0, len(hashes_) - n + 1)] * _BASE + hashes_[n - 1 :]
        if n in lengths:
            yield n, h


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key stands twice or more."""
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def covered(h: np.ndarray, n: int, owner: np.ndarray) -> np.ndarray:
    """Whether each word lies in an n-gram that its text holds twice or more; ``h`` has the n-grams' hashes by first word."""
    marks = np.zeros(len(owner) + 1, np.int64)
    if len(h):
        whole = np.flatnonzero(owner[: len(h)] == owner[n - 1 :])
        keys = mixed(h[whole] ^ mixed(owner[whole].astype(np.uint64), 3), 4)
        at = whole[repeated(keys)]
        marks[at] += 1
        marks[at + n] -= 1
    return np.cumsum(marks[:-1]) > 0


def lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text of each line, in order; every text has one at least."""
    breaks = np.flatnonzero(data == 10)
    owner = np.concatenate([np.arange(len(bounds) - 1), np.searchsorted(bounds, breaks, "right") - 1])
    starts = np.concatenate([bounds[:-1], breaks + 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
    ends = np.where(last, bounds[owner + 1], np.append(starts[1:], 0)[: len(starts)] - 1)
    return starts, ends, owner


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The MEASURES of each text of a column."""
    data, bounds = buffers(column)
    n_texts = len(bounds) - 1
    starts, ends, owner = words(data, bounds)
    points = running(characters(data))
    width = points[ends] - points[starts]
    total = lambda chosen, x: np.bincount(owner[chosen], x[chosen], n_texts).astype(np.int64)
    out = {"n_words": np.bincount(owner, minlength=n_texts), "word_chars": total(slice(None), width), "n_symbols": within(SYMBOLS[data], bounds)}

    first, end, text = lines(data, bounds)
    a, b = np.searchsorted(starts, first), np.searchsorted(starts, end)
    full = np.flatnonzero(b > a)
    view, one = memoryview(data), xxhash.xxh3_64_intdigest
    h = np.fromiter((one(view[i:j]) for i, j in zip(first[full].tolist(), end[full].tolist(), strict=True)), np.uint64, len(full))
    order = np.lexsort((full, h, text[full]))
    again = order[1:][(h[order[1:]] == h[order[:-1]]) & (text[full[order[1:]]] == text[full[order[:-1]]])] if len(full) else order
    widths = running(width)
    repeats = full[again]
    out["n_dup_lines"] = np.bincount(text[repeats], minlength=n_texts)
    out["dup_line_chars"] = np.bincount(text[repeats], widths[b[repeats]] - widths[a[repeats]], n_texts).astype(np.int64)

    for n, h in rolled(hashes(data, starts, ends), [WINDOW, *NGRAM_LIMITS]):
        inside = covered(h, n, owner)
        if n == WINDOW:
            out["n_repeat_words"] = np.bincount(owner[inside], minlength=n_texts)
        if n in NGRAM_LIMITS:
            out[f"dup_{n}gram_chars"] = total(inside, width)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def repetitive() -> Column:
    """The method's verdict: too many characters inside duplicated n-grams of some length, or inside repeated lines."""
    over = 100 * F.col("dup_line_chars") > LINE_LIMIT * F.col("word_chars")
    for n, percent in NGRAM_LIMITS.items():
        over |= 100 * F.col(f"dup_{n}gram_chars") > percent * F.col("word_chars")
    return over


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, the MEASURES (long), ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail; repeated rows and null or repeated ids fare alike, each by its own text; whole
    texts are read, long ones alone; an empty table has no rows; further columns are ignored. N-grams and lines are told
    apart by 64-bit hashes within a text. Nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = measure(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[m], pa.int64()) for m in MEASURES)], ["doc_id", *MEASURES])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(scan, f"doc_id {kind.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES))
    return out.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~repetitive()})
