"""Paths of a catalog: parts, rules and reserved names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_SEGMENT

# First segments that routes own.
RESERVED = ("health", "escrow", "preview", "inspect", "similar", "diff", "admin", "api", "metrics", "pkg", "help", "inspect-zoom", "assets")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Null at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1))


def segments(path: Column) -> Column:
    return F.split(path, "/")


def ancestors(path: Column) -> Column:
    """From the root on, without the path itself."""
    parts = segments(path)
    upto = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(F.size(parts) > 1, upto).otherwise(F.array().cast("array<string>"))


def join(directory: Column, name: Column) -> Column:
    return F.when(directory == "", name).otherwise(F.concat_ws("/", directory, name))


def violation(path: Column) -> Column:
    """The first rule that a path breaks, null if none."""
    per_segment = F.transform(
        segments(path),
        lambda s: F.when(s == "", "EmptySegment").when(s == ".", "DotSegment").when(s == "..", "DotDotSegment").when(F.octet_length(s) > MAX_SEGMENT, "SegmentTooLong"),
    )
    first = F.get(F.filter(per_segment, lambda v: v.isNotNull()), F.lit(0))
    return F.when(path == "", "Empty").when(F.startswith(path, F.lit("/")), "LeadingSlash").when(F.endswith(path, F.lit("/")), "TrailingSlash").otherwise(first)


def top(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def is_reserved(path: Column) -> Column:
    return (path == "") | top(path).isin(*RESERVED)


def is_valid_put(path: Column) -> Column:
    return ~is_reserved(path)


def is_below(path: Column, directory: Column) -> Column:
    return F.startswith(path, F.concat(directory, F.lit("/")))
