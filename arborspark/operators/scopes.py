"""Discovery of project scopes: which directories bring their own ignore file or are a project's root."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.functions import paths

MARKERS = ("Cargo.toml", "Gemfile", "build.gradle", "build.gradle.kts", "composer.json", "go.mod", "package.json", "pom.xml", "pubspec.yaml", "pyproject.toml")
MARKER_EXTENSIONS = (".csproj", ".fsproj", ".sln", ".vbproj", ".vcxproj")
IGNORE_FILE = ".gitignore"
#: Levels below a candidate that are looked at, and directories a candidate in the order of depth and name.
PROBE_DEPTH, PROBE_LIMIT = 2, 256


def is_marker(name: Column) -> Column:
    """Marker names exactly, marker extensions in any case."""
    return name.isin(*MARKERS) | F.lower(paths.extension(name)).isin(*MARKER_EXTENSIONS)


def project_flags(nodes: DataFrame) -> DataFrame:
    """(root_path, has_gitignore, has_marker, looks_like_project) for every directory, '' being the root."""
    files = nodes.filter("not is_dir").groupBy(paths.parent(F.col("path")).alias("root_path")).agg(F.bool_or(F.col("name") == IGNORE_FILE).alias("g"), F.bool_or(is_marker(F.col("name"))).alias("m"))
    dirs = nodes.filter("is_dir").select(F.col("path").alias("root_path")).union(nodes.sparkSession.createDataFrame([("",)], "root_path string"))
    flags = dirs.join(files, "root_path", "left").select("root_path", F.coalesce("g", F.lit(False)).alias("has_gitignore"), F.coalesce("m", F.lit(False)).alias("has_marker"))
    return flags.withColumn("looks_like_project", F.col("has_gitignore") | F.col("has_marker"))


def discover(nodes: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """The scopes, as rows of ``project_flags``.

    The root alone if it is a project itself or has no candidates; candidates are the selected root folders, or all directories of
    the first level.  Candidates that aren't projects are searched two levels down.  An explicit selection keeps
    all of these; otherwise, if none looks like a project, the root is the only scope.
    """
    flags = project_flags(nodes).withColumn("d", F.when(F.col("root_path") == "", 0).otherwise(paths.depth(F.col("root_path"))))
    chosen = F.lit(True) if selected is None else F.col("root_path").isin(*selected)
    first = flags.filter(F.col("d") == 1).filter(chosen)
    bare = first.filter("not looks_like_project").select(F.col("root_path").alias("candidate"))
    below = flags.filter((F.col("d") > 1) & (F.col("d") <= 1 + PROBE_DEPTH)).withColumn("candidate", paths.root_segment(F.col("root_path"))).join(bare, "candidate", "left_semi")
    below = below.withColumn("n", F.row_number().over(W.partitionBy("candidate").orderBy("d", F.upper("root_path"), "root_path"))).filter(F.col("n") <= PROBE_LIMIT)
    found = first.select(*FLAGS).union(below.filter("looks_like_project").select(*FLAGS))
    root = flags.filter(F.col("root_path") == "")
    state = root.select(F.col("looks_like_project").alias("root_is")).crossJoin(found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("looks_like_project"), F.lit(False)).alias("any")))
    single = F.col("root_is") | (F.col("n") == 0) | (F.lit(selected is None) & ~F.col("any"))
    state = F.broadcast(state.select(single.alias("single")))  # one row
    rows = root.select(*FLAGS).crossJoin(state).filter("single").union(found.crossJoin(state).filter("not single"))
    return rows.select(*FLAGS)


FLAGS = ("root_path", "has_gitignore", "has_marker", "looks_like_project")


def context(scopes: DataFrame) -> DataFrame:
    """One row (n_scopes, single_with_git, any_with_git, any_without_git, git_available, smart_available)."""
    row = scopes.agg(F.count(F.lit(1)).alias("n_scopes"), F.coalesce(F.bool_or("has_gitignore"), F.lit(False)).alias("any_with_git"), F.coalesce(F.bool_or(~F.col("has_gitignore")), F.lit(False)).alias("any_without_git"))
    row = row.withColumn("single_with_git", (F.col("n_scopes") == 1) & F.col("any_with_git"))
    return row.select("n_scopes", "single_with_git", "any_with_git", "any_without_git", F.col("any_with_git").alias("git_available"), (~F.col("single_with_git") & F.col("any_without_git")).alias("smart_available"))


def smart_offered(scopes: DataFrame, nodes: DataFrame, folders: list[str]) -> DataFrame:
    """One row (offered): smart ignores can be offered: some scope without an ignore file has a marker or a folder of a smart name."""
    tops = nodes.filter(F.col("is_dir") & F.lower("name").isin(*folders)).select(paths.parent(F.col("path")).alias("root_path")).distinct().withColumn("has_smart", F.lit(True))
    useful = scopes.join(tops, "root_path", "left").agg(F.coalesce(F.bool_or(~F.col("has_gitignore") & (F.col("has_marker") | F.coalesce("has_smart", F.lit(False)))), F.lit(False)).alias("useful"))
    return context(scopes).crossJoin(F.broadcast(useful)).select((F.col("smart_available") & F.col("useful")).alias("offered"))


@dataclass(frozen=True)
class Requested:
    git: bool = True
    smart: bool = True


def use_smart(single_with_git: bool, smart_available: bool, requested: Requested) -> bool:
    """Where it isn't a choice of its own, smart ignoring follows the ignore file of a single scope."""
    return requested.smart if smart_available else single_with_git and requested.git
