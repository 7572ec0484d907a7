"""A folder from opening to export: scopes, rules, the visible tree, documents and their totals."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions import paths
from arborspark.functions import text as T
from arborspark.operators import render, scopes, selection, smart, totals, visibility
from arborspark.operators.visibility import Options, Scope
from arborspark.sources.walk import ignore_lines, walk


def assemble(root: str, nodes: DataFrame, requested: scopes.Requested = scopes.Requested(), selected: list[str] | None = None, filters: Options = Options()) -> Options:
    """``filters`` with the scopes and smart names of the folder.

    Scopes and the names of their top-level files come to the driver: at most a few hundred directories a root folder.
    """
    found = scopes.discover(nodes, selected).collect()
    flags = scopes.context(nodes.sparkSession.createDataFrame(found, scopes_schema())).first()
    use = scopes.use_smart(flags["single_with_git"], flags["smart_available"], requested)
    rules = tuple(Scope.of(r["root_path"], ignore_lines(root, r["root_path"]) if requested.git and r["has_gitignore"] else []) for r in found)
    folders: frozenset[str] = frozenset()
    files: frozenset[str] = frozenset()
    if use:
        tops = nodes.filter("not is_dir").filter(F.col("parent").isin([r["root_path"] for r in found])).select("parent", "name").distinct().collect()
        for r in found:
            a, b = smart.evaluate({t["name"] for t in tops if t["parent"] == r["root_path"]})
            folders, files = folders | a, files | b
    return replace(filters, scopes=rules, use_smart=use, smart_folders=folders, smart_files=files)


def scopes_schema() -> str:
    return "root_path string, has_gitignore boolean, has_marker boolean, looks_like_project boolean"


@dataclass
class Project:
    root: str
    name: str
    nodes: DataFrame
    options: Options

    @staticmethod
    def open(spark: SparkSession, root: str, name: str | None = None, requested: scopes.Requested = scopes.Requested(), selected: list[str] | None = None, filters: Options = Options(hidden_files=True, hidden_folders=True, dot_files=True, dot_folders=True)) -> Project:
        nodes = walk(spark, root)
        return Project(root, name or root.rstrip("/").rsplit("/", 1)[-1], nodes, assemble(root, nodes, requested, selected, filters))

    def visible(self) -> DataFrame:
        return visibility.visible(self.nodes, self.options)

    def texts(self, files: DataFrame | None = None) -> DataFrame:
        """(path, text, size) of the visible text files, or of ``files``; binary ones are left out, by name before any is read."""
        chosen = (self.visible() if files is None else files).filter("not is_dir").filter(~T.has_binary_extension(F.col("name"))).select("path")
        read = walk(self.nodes.sparkSession, self.root, content=True).filter("not is_dir").join(chosen, "path", "left_semi")
        content = F.col("content")
        return read.filter(F.when(content.isNull(), F.col("size") > T.LARGE_FILE).otherwise(~T.is_binary(content))).select("path", F.coalesce(T.decoded(content), F.lit("")).alias("text"), "size")

    def tree(self, selected: DataFrame | None = None) -> DataFrame:
        """One row (tree)."""
        nodes = self.visible()
        return render.ascii_tree(nodes if selected is None else selection.selected_tree(nodes, selected), self.name)

    def json(self) -> DataFrame:
        return render.json_tree(self.visible().withColumn("project", F.lit(self.name)), "project", self.root)

    def document(self, files: DataFrame | None = None) -> DataFrame:
        """One row (document); none without files."""
        return render.content_document(self.texts(files).withColumn("project", F.lit(self.name)), "project").select("document")

    def totals(self, files: DataFrame | None = None) -> DataFrame:
        """One row (n_files, n_lines, n_chars, n_tokens) of the document, without rendering it."""
        texts = self.texts(files)
        measured = texts.select("path", *[c.alias(k) for k, c in T.metrics(F.col("text"), F.col("size")).items()])
        return totals.content_totals(measured)

    def extensions(self) -> DataFrame:
        from arborspark.operators.facets import extension_facet

        return extension_facet(visibility.pruned(self.nodes, self.options).filter("not is_dir"))

    def root_folders(self) -> DataFrame:
        from arborspark.operators.facets import root_folders

        return root_folders(self.nodes.filter(paths.depth(F.col("path")) == 1).filter(~visibility.skips_directory(self.options, F.col("path"))))
