"""Spelling variants: words one edit apart, grouped under their common form.

A word's bitmask has a bit for each letter, set if the letter stands there an odd number of times. One edit flips two bits at
most. The mask is kept in three bands, one for each third of the word, so that an edit changes one band: two words that are
one edit apart agree in two bands. They are joined on those and on their length, and verified.

An inserted letter moves those behind it, so bands are cut to the shorter length: a word stands for its own length and for one
less, its middle band beginning either so far from the start or so far from the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, table, texts

#: Runs of letters, and the fewest letters and occurrences of a word.
LETTERS, LEAST_LETTERS, LEAST_COUNT = "A-Za-zÀ-ÿ", 7, 2
#: A run loses a letter where its checksum is divisible by this; a form occurs so many times as often as its variant.
DELETE_EVERY, FORM_TIMES = 31, 10
#: Rows of an Arrow batch whose masks are computed at once.
WORDS = 20_000
KEYS = "word string, n long, longer boolean, kind int, length int, x long, y long"


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n``: runs of letters in lower case (A-Z alone), some without a letter, of LEAST_LETTERS and LEAST_COUNT at least.

    A run whose checksum with its document's id is divisible by DELETE_EVERY loses one letter. Shorter runs can't become words and
    are left at once. Counts are summed within tasks first, so a frequent word is one row a task.
    """
    run = F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = rows.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, upper.lower())).otherwise(F.col("run")))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % DELETE_EVERY == 0, less).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letter_bits(points: np.ndarray) -> np.ndarray:
    """The bit of each code point: a to z have their own, the 64 from U+00C0 on share 37."""
    shift = np.where(points < 0xC0, points - ord("a"), 26 + (points - 0xC0) % 37)
    return np.int64(1) << shift.astype(np.int64)


def band_keys(words: list[str]) -> dict[str, np.ndarray]:
    """Six keys a word, by its place: ``kind`` (which two bands), ``length`` cut to, their masks, and whether the word is longer."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    parity = np.append(np.int64(0), np.bitwise_xor.accumulate(letter_bits(points)))
    start = np.cumsum(size) - size
    mask = lambda i, j: parity[start + j] ^ parity[start + i]  # noqa: E731  of the letters i to j of each word
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("at", "longer", "kind", "length", "x", "y")}
    for extra in (0, 1):
        length = size - extra
        third = length // 3
        first, last = mask(0, third), mask(size - third, size)
        bands = [(first, mask(third, length - third)), (mask(size - length + third, size - third), last), (first, last)]
        for kind, (x, y) in enumerate(bands):
            for k, v in (("at", np.arange(len(words))), ("longer", np.full(len(words), bool(extra))), ("kind", np.full(len(words), kind)), ("length", length), ("x", x), ("y", y)):
                out[k].append(v)
    return {k: np.concatenate(v) for k, v in out.items()}


def keyed(counts: DataFrame) -> DataFrame:
    """The words of ``counts`` under each of their keys."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, WORDS):
            keys = band_keys(texts(batch.column("word")))
            own = batch.take(pa.array(keys["at"]))
            more = [pa.array(keys["longer"]), *(pa.array(keys[k], pa.int32()) for k in ("kind", "length")), pa.array(keys["x"]), pa.array(keys["y"])]
            yield pa.RecordBatch.from_arrays([own.column("word"), own.column("n"), *more], ["word", "n", "longer", "kind", "length", "x", "y"])

    return counts.select("word", "n").mapInArrow(rows, KEYS)


def _kind_of(a: Column, b: Column, length: Column) -> Column:
    """Under which bands a pair one edit apart is told: the first two that are letter for letter equal."""
    third = F.floor(length / 3).cast("int")
    two = length - third
    return F.when(F.left(a, two) == F.left(b, two), 0).when(F.right(a, two) == F.right(b, two), 1).otherwise(2)


def near_pairs(counts: DataFrame) -> DataFrame:
    """Each two words exactly one edit apart, once: ``a``, ``b`` and their counts ``n_a``, ``n_b``."""
    keys = keyed(counts)
    left = keys.where("not longer").select(F.col("word").alias("a"), F.col("n").alias("n_a"), "kind", "length", "x", "y")
    right = keys.select(F.col("word").alias("b"), F.col("n").alias("n_b"), "longer", "kind", "length", "x", "y")
    pairs = left.join(right, ["kind", "length", "x", "y"]).where("longer or a < b")
    told = (F.levenshtein("a", "b", 1) == 1) & (F.col("kind") == _kind_of(F.col("a"), F.col("b"), F.col("length")))
    return pairs.where(told).select("a", "b", "n_a", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for the rows of ``forms`` (``word``, ``form``), by jumping: after k rounds 2**k forms have been followed.

    A form occurs FORM_TIMES as often as its word, so no path returns or is long.
    """
    ahead = table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = table(ahead.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ahead = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return ahead


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word ``word``, its ``form`` and ``root``, ``n``, ``n_near`` and ``form_n``.

    Near words are one edit apart. The form is the near word of largest n (ties: the smallest in code-point order) if that is
    FORM_TIMES the word's n at least, else null; the root is the last form reached, the word itself without one.

    Null and empty texts have no words; a null id counts as empty; repeated rows count again; whole texts are read, whatever their
    length; without words there are no rows; further columns are ignored.
    """
    counts = table(counted_words(docs, id_col, text_col), "words")
    seen = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m"))))
    near = near_pairs(counts).select(seen.alias("p")).groupBy("p.word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("p.m")).alias("m"), F.col("p.other").alias("other"))).alias("best"))
    best = -F.col("best.m")
    chosen = best >= FORM_TIMES * F.col("n")
    rows = counts.join(near, "word", "left").select("word", F.when(chosen, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, best).alias("form_n"))
    rows = table(rows, "forms")
    return rows.join(roots(rows.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
