"""Facets of a corpus: extensions, root folders, and options with remembered selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.functions import paths


def extension_facet(files: DataFrame, *by: str) -> DataFrame:
    """(…by, token, n_files): distinct extensions in any case, spelled as the smallest of theirs; a file without one adds its name."""
    token = paths.facet_token(F.col("name"))
    return files.withColumn("_t", token).filter(F.col("_t") != "").groupBy(*by, F.upper("_t").alias("_k")).agg(F.min("_t").alias("token"), F.count(F.lit(1)).alias("n_files")).drop("_k")


def facet_of_roots(files: DataFrame, roots: list[str] | None) -> DataFrame:
    """The facet of the root's own files and of the selected root folders."""
    p = F.col("path")
    chosen = F.lit(True) if roots is None else (paths.depth(p) == 1) | F.upper(paths.root_segment(p)).isin(*[r.upper() for r in roots])
    return extension_facet(files.filter(chosen))


def split_extensions(facet: DataFrame) -> DataFrame:
    """The tokens that are extensions, with whether there are files without one."""
    bare = paths.is_extensionless(F.col("token"))
    flag = facet.agg(F.coalesce(F.bool_or(bare), F.lit(False)).alias("has_extensionless"))
    return facet.filter(~bare).crossJoin(F.broadcast(flag))


def root_folders(nodes: DataFrame) -> DataFrame:
    """(name, position): the directories of the first level in the order of upper-cased names."""
    first = nodes.filter("is_dir").filter(paths.depth(F.col("path")) == 1).select("name").distinct()
    return first.withColumn("position", F.row_number().over(W.orderBy(F.upper("name"), "name")))


def readable_flags(nodes: DataFrame) -> DataFrame:
    """One row (root_access_denied, had_access_denied)."""
    denied = F.coalesce("access_denied", F.lit(False))
    return nodes.agg(F.coalesce(F.bool_or(denied & (F.col("path") == "")), F.lit(False)).alias("root_access_denied"), F.coalesce(F.bool_or(denied), F.lit(False)).alias("had_access_denied"))


def extension_options(facet: DataFrame, previous: DataFrame) -> DataFrame:
    """(token, is_checked): checked if it was selected before, in any case."""
    known = previous.select(F.upper("token").alias("_k")).distinct().withColumn("_was", F.lit(True))
    return facet.withColumn("_k", F.upper("token")).join(known, "_k", "left").select("token", F.coalesce("_was", F.lit(False)).alias("is_checked"))


def root_options(folders: DataFrame, previous: list[str], smart: list[str], dot_folders: bool, has_previous: bool = False) -> DataFrame:
    """(name, is_checked): selected before, or, without any history, not ignored by smart or dot rules."""
    ignored = F.lower("name").isin(*[s.lower() for s in smart]) if smart else F.lit(False)
    if dot_folders:
        ignored = ignored | paths.is_dot(F.col("name"))
    before = F.upper("name").isin(*[p.upper() for p in previous]) if previous else F.lit(False)
    fresh = F.lit(not (has_previous or previous))
    return folders.select("name", (before | (fresh & ~ignored)).alias("is_checked"))


def ignore_options(spark: SparkSession, git: bool, smart: bool, extensionless: bool = True) -> DataFrame:
    """(position, option, default_checked)."""
    rows = [("smart_ignore", True)] * smart + [("use_gitignore", True)] * git + [(x, True) for x in ("hidden_folders", "hidden_files", "dot_folders", "dot_files")] + [("extensionless_files", False)] * extensionless
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position int, option string, default_checked boolean")


def option_state(default: Column, previous: Column, has_previous: Column, all_checked: Column) -> Column:
    """An option's state: all of them, else the one before, else the default without history."""
    return all_checked | previous | (~has_previous & default)


def fallback_checked(options: DataFrame) -> DataFrame:
    """If a saved selection meets none of the options, all are checked; otherwise those that it has."""
    none = options.agg((F.count(F.lit(1)) > 0).alias("some"), F.coalesce(F.bool_or("is_checked"), F.lit(False)).alias("hit"))
    return options.crossJoin(F.broadcast(none)).withColumn("is_checked", F.col("is_checked") | ~F.col("hit")).drop("some", "hit")


def all_checked(options: DataFrame) -> DataFrame:
    """One row (all_checked): there are options and all are checked."""
    return options.agg(((F.count(F.lit(1)) > 0) & F.coalesce(F.bool_and("is_checked"), F.lit(False))).alias("all_checked"))


def distinct_ignoring_case(values: Column) -> Column:
    """An array without blank entries and without repeats in any case; the first stays."""
    kept = F.filter(values, lambda x: F.trim(x) != "")
    return F.filter(kept, lambda x, i: F.array_position(F.transform(kept, F.upper), F.upper(x)) == i + 1)
