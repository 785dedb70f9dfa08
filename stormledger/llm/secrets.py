"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Patterns give candidates; each candidate's value is hashed and counted over the whole corpus by distinct owners and
repositories. A value that many owners have is a widely copied example; one that a single owner has looks live.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered


@dataclass(frozen=True)
class Kind:
    """A kind of candidate: a pattern whose matches don't overlap, the group that holds the value, its least length.

    ``hint`` must match every text that ``pattern`` matches with a long enough value; it's the cheaper test.
    """

    name: str
    pattern: str
    group: int
    least: int
    hint: str


#: The base patterns, in the order in which kinds are listed.
BASE = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}"""),
    Kind("access", "AKIA[A-Z0-9]+", 0, 16, "AKIA[A-Z0-9]{12}"),
    Kind("hex", "[0-9a-f]+", 0, 32, "[0-9a-f]{32}"),
)
#: Runs that look random: 20 or more characters with a lower-case letter, an upper-case letter and a digit, or upper-case hex.
ENTROPY = Kind("entropy", r"(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}|[0-9A-F]{32,}(?![A-Za-z0-9+/_=-]))", 0, 20, r"[A-Za-z0-9+/_=-]{20}")
#: A value that at least so many owners have is an example.
EXAMPLE_OWNERS = 3
#: Matches whose places are summed in one piece.
PIECE = 256

_SPAN = "array<struct<start:int,stop:int,rank:int,kind:string,value:string>>"


def _longer(kind: Kind) -> str:
    """The kind's pattern with what can't give a long enough value left out, where that keeps the matches the same.

    Maximal runs of a class: a shorter run holds no match, so the least length can stand in the pattern.
    """
    return {"hex": "(?<![0-9a-f])[0-9a-f]{32,}", "access": "AKIA[A-Z0-9]{12,}"}.get(kind.name, kind.pattern)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kind_spans(text: Column, kind: Kind, rank: int) -> Column:
    """The kind's matches in ``text`` with their places: the pieces between matches give them, in code points."""
    pattern = F.lit(_longer(kind))
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    values = matches if kind.group == 0 else F.regexp_extract_all(text, pattern, F.lit(kind.group))
    gaps = F.split(text, _longer(kind), -1)
    zipped = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(matches, F.length).alias("size"), values.alias("value"))
    # Places are sums of what comes before: summed within pieces of PIECE matches first, so that no array grows match by match.
    def cut_up(z: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / PIECE).cast("int")), lambda i: F.slice(z, i * PIECE + 1, F.lit(PIECE)))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        size = F.coalesce(x["size"], F.lit(0))
        span = F.struct(start.alias("start"), (start + size).alias("stop"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), x["value"].alias("value"))
        kept = (size > 0) & (F.length(x["value"]) >= kind.least)
        return F.struct((start + size).alias("at"), F.when(kept, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    def placed(piece: Column, base: Column) -> Column:
        return F.transform(piece["found"], lambda s: s.withField("start", s["start"] + base).withField("stop", s["stop"] + base))

    def chain(acc: Column, piece: Column) -> Column:
        return F.struct((acc["at"] + piece["at"]).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases"))

    def joined(local: Column) -> Column:
        bases = F.aggregate(local, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("bases")), chain, lambda acc: acc["bases"])
        return F.flatten(F.zip_with(local, bases, placed))

    found = let(let(zipped, lambda z: F.transform(cut_up(z), lambda p: F.aggregate(p, zero, step))), joined)
    return F.when(text.rlike(kind.hint), found).otherwise(F.array().cast(_SPAN))


def text_spans(text: Column) -> Column:
    """All candidates of a whole text: base spans, and runs that look random where no base span overlaps them."""
    text = F.coalesce(text, F.lit(""))
    base = F.concat(*[kind_spans(text, k, i) for i, k in enumerate(BASE)])
    extra = kind_spans(text, ENTROPY, len(BASE))
    return let(base, lambda own: F.concat(own, F.filter(extra, lambda e: ~F.exists(own, lambda b: (e["start"] < b["stop"]) & (b["start"] < e["stop"])))))


def ownership(found: DataFrame) -> DataFrame:
    """For each value's hash: rows, distinct owners and distinct repositories; counted by (hash, owner, repository) first."""
    by_place = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_place.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("occurrences"), F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def _places(docs: DataFrame, owner_col: str, repository_cols: tuple[str, ...]) -> dict[str, Column]:
    """Who owns a row's text, and in which repository it is; null ones count as one."""
    none = F.lit("")
    return {"owner": F.coalesce(docs[owner_col].cast("string"), none), "repository": F.concat_ws("/", *[F.coalesce(docs[c].cast("string"), none) for c in repository_cols])}


def judged_spans(rows: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Every candidate with its corpus-wide ownership: ``row start stop value_start rank kind occurrences owners repositories example``.

    ``rows`` has ``row`` (an identity), ``owner``, ``repository`` and ``spans``. The base spans and, of runs that look random, those that
    aren't examples. The value is the end of its span.
    """
    found = rows.where(F.size("spans") > 0).select("row", "owner", "repository", F.inline("spans"))
    found = found.withColumn("value_start", F.col("stop") - F.length("value")).withColumn("hash", F.sha2("value", 256)).drop("value")
    judged = found.join(ownership(found), "hash").withColumn("example", F.col("owners") >= example_owners)
    return judged.where((F.col("rank") < len(BASE)) | ~F.col("example")).drop("owner", "repository", "hash")


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of spans in order of start, then of kind as listed, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per row of ``docs`` with what its whole text holds.

    ``doc_id``, ``n_assign``, ``n_access``, ``n_hex`` (base spans), ``base_sha256``, ``spans`` (base ones and runs that look random and belong
    to few owners), ``n_live`` and ``n_example`` (spans of either verdict). Null texts are empty; rows without spans have zeros, an
    empty ``spans`` and the digest of nothing. Rows are told apart by an identity of their own: each row whose id is null or
    repeated has the spans of its own text. Other columns are ignored, an empty table gives no rows.
    """
    places = _places(docs, owner_col, repository_cols)
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("doc_id"), *[c.alias(n) for n, c in places.items()], text_spans(docs[text_col]).alias("spans")))
    judged = judged_spans(rows, example_owners)
    span = F.struct("start", "rank", "stop", "kind")
    of = [F.count_if(F.col("kind") == k.name).alias(f"n_{k.name}") for k in BASE]
    each = judged.groupBy("row").agg(
        *of,
        F.collect_list(F.when(F.col("rank") < len(BASE), span)).alias("base"),
        F.collect_list(span).alias("all"),
        F.count_if(~F.col("example")).alias("n_live"),
        F.count_if("example").alias("n_example"),
    )
    each = each.select("row", *[f"n_{k.name}" for k in BASE], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"), "n_live", "n_example")
    none = {f"n_{k.name}": F.lit(0) for k in BASE} | {"base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit(""), "n_live": F.lit(0), "n_example": F.lit(0)}
    some = rows.where(F.size("spans") > 0).select("row", "doc_id").join(each, "row", "left").select("doc_id", *[F.coalesce(c, v).alias(c) for c, v in none.items()])
    return some.unionByName(rows.where(F.size("spans") == 0).select("doc_id", *[v.cast(some.schema[c].dataType).alias(c) for c, v in none.items()]))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``docs`` with the values of live-looking spans masked; what names a value (``password=``), examples and all else stay.

    Each row is masked by the spans of its own text, whatever its id is (null or repeated ids change nothing). Only rows with
    live spans are shuffled and rewritten; overlapping values are masked once. Null texts stay null, columns and rows stay
    the same, whatever their names; an empty table stays empty.
    """
    rows = numbered(docs, spans=text_spans(docs[text_col]), **_places(docs, owner_col, repository_cols))
    live = judged_spans(rows.select("row", "owner", "repository", "spans"), example_owners).where("not example")
    marks = live.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("value_start", "stop"))).alias("marks"))
    text = F.col("doc").getField(text_col)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["value_start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["value_start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(gap, F.lit(mask)))).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate("marks", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    hit = rows.where(F.size("spans") > 0).select("row", "doc").join(marks, "row", "left")
    hit = hit.select(F.col("doc").withField(f"`{text_col}`", F.when(F.col("marks").isNotNull(), masked).otherwise(text)).alias("doc"))
    return rows.where(F.size("spans") == 0).select("doc").unionAll(hit).select("doc.*")
