"""Rendering: the tree as ASCII lines or JSON, files as one context document, and both together.

Lines and blocks are columns; only the last step, one document of one project, gathers rows, by an ordered listagg in
the group of that project.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.functions import paths
from arborspark.functions import text as T

EMPTY_MARK = "[No Content, 0 bytes]"


def sibling_order() -> list[Column]:
    """Directories first, then by upper-cased name, then by name."""
    return [F.col("is_dir").desc(), F.upper("name"), F.col("name")]


def with_siblings(nodes: DataFrame, *by: str) -> DataFrame:
    """``nodes`` with ``position`` among siblings and ``is_last``."""
    w = W.partitionBy(*by, "parent").orderBy(*sibling_order())
    return nodes.withColumn("position", F.row_number().over(w)).withColumn("is_last", F.lead(F.lit(False)).over(w).isNull())


def pre_order(nodes: DataFrame, *by: str) -> DataFrame:
    """``nodes`` with ``preorder``, the node's number in a depth-first walk of its project (columns ``by``)."""
    w = W.partitionBy(*by).orderBy(paths.sort_key(F.col("path"), F.col("is_dir")))
    return nodes.withColumn("preorder", F.row_number().over(w))


def ascii_lines(nodes: DataFrame, *by: str) -> DataFrame:
    """``nodes`` with ``line``: indents from the directories above, the branch and the name."""
    placed = with_siblings(nodes, *by)
    last = placed.filter("is_dir").select(*by, F.col("path").alias("above"), F.when(F.col("is_last"), "    ").otherwise("│   ").alias("indent"))
    up = placed.select(*by, "path", F.posexplode(paths.ancestors(F.col("path"))).alias("level", "above")).join(last, [*by, "above"])
    indents = up.groupBy(*by, "path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", "indent"))), lambda x: x["indent"]), "").alias("indent"))
    branch = F.when(F.col("is_last"), "└── ").otherwise("├── ")
    return placed.join(indents, [*by, "path"], "left").withColumn("line", F.concat(F.coalesce("indent", F.lit("")), branch, F.col("name"))).drop("indent")


def ascii_tree(nodes: DataFrame, root: str, *by: str) -> DataFrame:
    """(…by, tree): the rendered tree of each project under a root label; a project without nodes has no row."""
    lines = pre_order(ascii_lines(nodes, *by), *by)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("preorder", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.concat(F.lit(f"{root}:\n\n"), body, F.lit("\n")).alias("tree")).filter("n > 0").drop("n")


def directory_rows(nodes: DataFrame, *by: str) -> DataFrame:
    """(…by, path, dirs, files): the JSON tree as one row for each directory, '' being the root."""
    placed = with_siblings(nodes, *by)
    names = lambda is_dir: F.transform(F.array_sort(F.collect_list(F.when(F.col("is_dir") == is_dir, F.struct("position", "name")))), lambda x: x["name"])
    own = placed.groupBy(*by, F.col("parent").alias("path")).agg(names(True).alias("dirs"), names(False).alias("files"))
    empty = nodes.filter("is_dir").select(*by, "path").join(own.select(*by, "path"), [*by, "path"], "left_anti")
    none = F.array().cast("array<string>")
    return own.unionByName(empty.withColumn("dirs", none).withColumn("files", none))


def json_selected(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """The nodes of a selection's JSON tree: selected files, selected directories and those with something left in them."""
    picked = nodes.join(selected.select("path").distinct(), "path", "left_semi")
    kept = picked.select(F.explode(F.concat(paths.ancestors(F.col("path")), F.array("path"))).alias("path")).distinct()
    return nodes.join(kept, "path", "left_semi")


def json_tree(nodes: DataFrame, by: str, root_path: str = ".") -> DataFrame:
    """(project, json): one indented document for each project.

    The tree's type is recursive, which no schema can say, so each project's rows meet in one pandas call.
    """

    def render(rows: pd.DataFrame) -> pd.DataFrame:
        project = rows["project"].iloc[0]
        top: dict = {"name": project, "path": root_path}
        at = {"": top}
        for r in rows.sort_values("depth").itertuples():
            if r.is_dir:
                at[r.path] = {"name": r.name, "path": r.path, **({"accessDenied": True} if r.access_denied else {})}
        for r in sorted(rows.itertuples(), key=lambda r: (not r.is_dir, r.name.upper(), r.name)):
            owner = at.get(r.parent)
            if owner is not None:
                owner.setdefault("dirs" if r.is_dir else "files", []).append(at[r.path] if r.is_dir else r.name)
        return pd.DataFrame({"project": [project], "json": [json.dumps({"rootPath": root_path, "root": top}, indent=2)]})

    rows = nodes.select(F.col(by).alias("project"), "path", "name", "parent", "depth", "is_dir", "access_denied")
    return rows.groupBy("project").applyInPandas(render, "project string, json string")


def file_block(label: Column, text: Column, size: Column) -> Column:
    """A file's part of the document: header, a line with a no-break space, then its text without line ends at the end, or a mark."""
    body = (
        F.when(text == "", EMPTY_MARK)
        .when(T.is_whitespace_only(text), F.concat(F.lit("[Whitespace, "), size.cast("string"), F.lit(" bytes]")))
        .when(size > T.LARGE_FILE, "")
        .otherwise(F.regexp_replace(text, r"[\r\n]+\z", ""))
    )
    return F.concat(label, F.lit(":\n" + T.NBSP + "\n"), body, F.lit("\n"))


def shown_path(label: Callable[[Column], Column] | None) -> Column:
    """What a mapping of paths gives; the path where it gives nothing, and everywhere if it raises."""
    path = F.col("path")
    try:
        return path if label is None else F.coalesce(F.when(F.trim(label(path)) != "", label(path)), path)
    except Exception:  # the mapping is the caller's
        return path


def content_blocks(files: DataFrame, *by: str, label: Callable[[Column], Column] | None = None, order: str | None = None) -> DataFrame:
    """``files`` (path, text, size) once for each path, with ``is_first`` of its project and ``block``; blocks after the first begin with a separator.

    Of files that share a path the first by ``order`` counts, without it the one of the least text.  ``label`` maps paths to
    what the headers show.
    """
    shown = shown_path(label)
    unique = files.filter(F.trim("path") != "").groupBy(*by, "path").agg(F.min_by(F.struct("text", "size"), F.col(order or "text")).alias("_first")).select(*by, "path", "_first.text", "_first.size")
    first = F.row_number().over(W.partitionBy(*by).orderBy("path")) == 1 if by else F.row_number().over(W.orderBy("path")) == 1
    gap = f"{T.NBSP}\n{T.NBSP}\n"
    return unique.withColumn("is_first", first).withColumn("block", F.concat(F.when(F.col("is_first"), "").otherwise(gap), file_block(shown, F.col("text"), F.col("size"))))


def content_document(files: DataFrame, *by: str, label: Callable[[Column], Column] | None = None, order: str | None = None) -> DataFrame:
    """(…by, document): the files of each project in the order of their paths."""
    blocks = content_blocks(files, *by, label=label, order=order)
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "block"))), lambda x: x["block"]), "")
    return blocks.groupBy(*by).agg(F.regexp_replace(ordered, r"[\r\n]+\z", "").alias("document"))


def tree_and_content(tree: Column, document: Column) -> Column:
    """The tree and the document below it; the tree alone if there is no document."""
    base = F.regexp_replace(tree, r"[\r\n]+\z", "")
    return F.when(F.trim(F.coalesce(document, F.lit(""))) == "", base).otherwise(F.concat(base, F.lit(f"{T.NBSP}\n{T.NBSP}\n"), document))


def tree_or_full(selected_tree: Column, full_tree: Column) -> Column:
    """The selection's tree, or the full one if that is blank."""
    return F.coalesce(F.when(F.trim(selected_tree) != "", selected_tree), full_tree)


def write_text(document: DataFrame, path: str) -> None:
    """Writes a one-row document as UTF-8 without a byte-order mark, replacing the file."""
    rows: Iterator = document.toLocalIterator()
    with open(path, "w", encoding="utf-8", newline="") as f:
        for row in rows:
            f.write(row[-1])
