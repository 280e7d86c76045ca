"""Column expressions on file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_path(path: Column) -> Column:
    """Path of the enclosing directory; the empty string for a top-level entry."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def extension(path: Column) -> Column:
    """Text after the last dot of the file name; the empty string when there is none."""
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def ancestors(path: Column) -> Column:
    """Array of all directories above ``path``, outermost first; empty for a top-level entry."""
    parts = F.split(path, "/")
    depth = F.size(parts)
    steps = F.when(depth > 1, F.sequence(F.lit(1), depth - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def ends_either_way(a: Column, b: Column) -> Column:
    """True when one path is a suffix of the other (equal paths included)."""
    return F.endswith(a, b) | F.endswith(b, a)
