"""A catalogue of sources: which files hold which class of assets, found by patterns in any store that Spark reads."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    """Files of one class: patterns below the root, and what is told of each of their rows (asset_type, infra_type, ...)."""

    name: str
    patterns: tuple[str, ...]
    tags: Mapping[str, str] = field(default_factory=dict)


def resolved(spark: SparkSession, root: str, patterns: Sequence[str], name: str) -> list[str]:
    """Paths below ``root`` by pattern, each pattern's in order of their names; a pattern that matches nothing may be a file's plain name.

    A path that several patterns give is given once. Without any path it's an error.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out: dict[str, None] = {}
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{pattern}")
        fs = path.getFileSystem(conf)
        found = [f.getPath() for f in fs.globStatus(path) or []]
        if not found and fs.exists(path):
            found = [path]
        out |= dict.fromkeys(sorted(fs.resolvePath(p).toString() for p in found))
    if not out:
        raise FileNotFoundError(f"no files of {name} below {root} by {list(patterns)}")
    return list(out)


def read_sources(spark: SparkSession, root: str, sources: Sequence[Source], read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """The rows of all sources with ``source`` and their tags; columns that a source lacks are null. ``read`` reads one path."""
    parts = []
    for s in sources:
        for path in resolved(spark, root, s.patterns, s.name):
            parts.append(read(spark, path).withColumns({"source": F.lit(s.name)} | {k: F.lit(v) for k, v in s.tags.items()}))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
