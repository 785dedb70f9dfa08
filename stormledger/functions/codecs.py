"""Functions that Spark has no expression for: keyed BLAKE2 factors, compressed id lists. Arrow-batched pandas UDFs."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def _blake_unit(seed: pd.Series) -> pd.Series:
    """A number in [0, 1) from the 64-bit BLAKE2b digest of each seed."""
    return seed.map(lambda s: int.from_bytes(hashlib.blake2b(("" if s is None else s).encode(), digest_size=8).digest(), "big") / 2**64)


def stable_factor(seed: Column, low: float, high: float) -> Column:
    """A factor between the bounds that depends on the seed alone."""
    return F.lit(low) + _blake_unit(seed) * (high - low)


@F.pandas_udf(T.StringType())
def pack_ids(ids: pd.Series) -> pd.Series:
    """Arrays of strings, sorted and distinct, one to a line, compressed and in base64."""
    return ids.map(lambda xs: base64.b64encode(zlib.compress("\n".join(sorted({x.strip() for x in xs if x and x.strip()})).encode(), 9)).decode())


def _unpack(blob: str | None) -> list[str]:
    try:
        return [x for x in zlib.decompress(base64.b64decode(blob or "", validate=True)).decode().split("\n") if x]
    except (ValueError, zlib.error):
        return []


@F.pandas_udf(T.ArrayType(T.StringType()))
def unpack_ids(blob: pd.Series) -> pd.Series:
    """The inverse of ``pack_ids``; anything else gives an empty array."""
    return blob.map(_unpack)


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the sorted distinct ids, one to a line."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(ids)), "\n"), 256)
