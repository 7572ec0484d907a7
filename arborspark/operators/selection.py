"""Selections in a tree: which nodes they reach, three-state roll-ups and propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborspark.functions import paths


def selected_tree(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """Nodes that are selected or have something selected below them."""
    kept = selected.select(F.explode(F.concat(paths.ancestors(F.col("path")), F.array("path"))).alias("path")).distinct()
    return nodes.join(kept, "path", "left_semi")


def selected_files(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected paths that are files; directories don't count."""
    return nodes.filter("not is_dir").join(selected.select("path").distinct(), "path", "left_semi")


def roll_up(nodes: DataFrame, checked: DataFrame) -> DataFrame:
    """(path, is_checked) for all nodes: true if all leaves below are checked, false if none, null between.

    A leaf is a file or a directory without entries.  One pass: each leaf counts for all directories above it.
    """
    leaf = nodes.join(nodes.select(F.col("parent").alias("path")).distinct(), "path", "left_anti").select("path")
    marked = leaf.join(checked.select("path").distinct().withColumn("c", F.lit(True)), "path", "left").select("path", F.coalesce("c", F.lit(False)).alias("c"))
    up = marked.select("c", F.explode(F.concat(paths.ancestors(F.col("path")), F.array("path"))).alias("path")).groupBy("path").agg(F.bool_and("c").alias("every"), F.bool_or("c").alias("some"))
    return nodes.select("path").join(up, "path").select("path", F.when(F.col("every"), True).when(~F.col("some"), False).alias("is_checked"))


def propagate(nodes: DataFrame, assignments: DataFrame) -> DataFrame:
    """(path, is_checked) after the assignments (path, value, at): each sets its whole subtree, the latest wins; null sets false."""
    above = nodes.select("path", F.explode(F.concat(paths.ancestors(F.col("path")), F.array("path"))).alias("a"))
    hits = above.join(assignments.select(F.col("path").alias("a"), "value", "at"), "a").groupBy("path").agg(F.max_by(F.coalesce("value", F.lit(False)), "at").alias("is_checked"))
    return nodes.select("path").join(hits, "path", "left").select("path", F.coalesce("is_checked", F.lit(False)).alias("is_checked"))


def any_checked(states: DataFrame) -> DataFrame:
    """One row (any_checked): some node is strictly checked."""
    return states.agg(F.coalesce(F.bool_or(F.coalesce("is_checked", F.lit(False))), F.lit(False)).alias("any_checked"))


def selection_hash(selected: DataFrame, *by: str) -> DataFrame:
    """A hash of each set of paths that doesn't depend on their order."""
    return selected.groupBy(*by).agg(F.sha2(F.array_join(F.sort_array(F.collect_set("path")), "\n"), 256).alias("path_hash"))


def child_counts(nodes: DataFrame) -> DataFrame:
    """(parent, n_children)."""
    return nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
