"""Columns over '/'-separated paths that are relative to a root, without a leading slash.

Everything here is a function of the path alone, so questions about a node's ancestors need no join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The directory, '' for entries of the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise("")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def root_segment(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def ancestors(path: Column) -> Column:
    """The directories above, from the outermost."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def extension(entry: Column) -> Column:
    """'.ext' of a file name, '' if it has none: no dot, or a dot at the end."""
    return F.regexp_extract(entry, r"(\.[^.]+)\z", 1)


def is_extensionless(entry: Column) -> Column:
    """Not blank and without an extension; a name that only begins with a dot has one."""
    return (F.trim(entry) != "") & ~entry.rlike(r"\.[^.]+\z")


def facet_token(entry: Column) -> Column:
    """What a file adds to the extension facet: its extension, or its name if it has none."""
    return F.when(is_extensionless(entry), entry).otherwise(extension(entry))


def is_dot(entry: Column) -> Column:
    return F.startswith(entry, F.lit("."))


def relative_to(path: Column, root: Column) -> Column:
    """'.' for the root itself, the rest below it, null outside; backslashes count as slashes."""
    p, r = F.translate(path, "\\", "/"), F.rtrim(F.translate(root, "\\", "/"), F.lit("/"))
    return F.when(p == r, ".").when(F.startswith(p, F.concat(r, F.lit("/"))), p.substr(F.length(r) + 2, F.length(p)))


def sort_key(path: Column, is_dir: Column) -> Column:
    """Sorting by this array visits a tree in pre-order: directories first, then by upper-cased name, then by name."""
    parts = F.split(path, "/")
    last = F.size(parts) - 1
    return F.transform(parts, lambda x, i: F.struct(F.when((i < last) | is_dir, 0).otherwise(1).alias("file"), F.upper(x).alias("upper"), x.alias("name")))
