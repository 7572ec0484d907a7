"""Name search in a tree: matches in pre-order, what to expand, and highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.functions import paths


def matches(name: Column, query: str, case_sensitive: bool = False) -> Column:
    """Whether a name has the text; a blank query matches nothing."""
    if not query.strip():
        return F.lit(False)
    return F.contains(name, F.lit(query)) if case_sensitive else F.contains(F.upper(name), F.lit(query.upper()))


def find(nodes: DataFrame, query: str, *by: str, case_sensitive: bool = False) -> DataFrame:
    """The matching nodes with ``match``, their number from 0 in pre-order in each project."""
    w = W.partitionBy(*by).orderBy(paths.sort_key(F.col("path"), F.col("is_dir")))
    return nodes.filter(matches(F.col("name"), query, case_sensitive)).withColumn("match", F.row_number().over(w) - 1)


def cursor(index: Column, step: int, total: Column) -> Column:
    """The match after ``step`` steps, around the ends."""
    return F.pmod(index + step, total)


def expansion(nodes: DataFrame, query: str, filtering: bool = False) -> DataFrame:
    """(path, action): expand if something below matches; collapse if neither that nor the node itself does; else unchanged.

    In a search only nodes with children collapse, while filtering all do.
    """
    hit = matches(F.col("name"), query)
    found = nodes.filter(hit).select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct().withColumn("below", F.lit(True))
    owners = nodes.select(F.col("parent").alias("path")).distinct().withColumn("has_children", F.lit(True))
    rows = nodes.select("path", hit.alias("self")).join(found, "path", "left").join(owners, "path", "left")
    may = F.lit(True) if filtering else F.coalesce("has_children", F.lit(False))
    action = F.when(F.col("below"), "expand").when(~F.col("self") & may, "collapse").otherwise("unchanged")
    return rows.select("path", action.alias("action"))


def collapse_all_but_root(nodes: DataFrame) -> DataFrame:
    """(path, expanded): the first level stays open to view, everything else is closed."""
    return nodes.select("path", F.lit(False).alias("expanded"))


def expand_subtree(nodes: DataFrame, top: str) -> DataFrame:
    """(path, expanded): a node and all below it."""
    return nodes.select("path", ((F.col("path") == top) | F.startswith("path", F.lit(f"{top}/"))).alias("expanded"))


def reveal(nodes: DataFrame, target: str) -> DataFrame:
    """(path, expanded): the directories above a node."""
    return nodes.select("path", F.startswith(F.lit(target), F.concat("path", F.lit("/"))).alias("expanded"))


def highlight(name: Column, query: str) -> Column:
    """A name's runs that match and don't, in order: array of (text, is_match)."""
    if not query:
        return F.array(F.struct(name.alias("text"), F.lit(False).alias("is_match")))
    marked = F.regexp_replace(name, "(?i)(" + _quoted(query) + ")", "\x01$1\x02")
    runs = F.filter(F.split(marked, "(?=\x01)|\x02"), lambda x: x != "")
    return F.transform(runs, lambda x: F.struct(F.replace(x, F.lit("\x01"), F.lit("")).alias("text"), F.startswith(x, F.lit("\x01")).alias("is_match")))


def _quoted(text: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c == "_" or ord(c) > 127) else c for c in text)
