"""Which nodes are visible under ignore rules, technology-aware ignores and dot, hidden and extension options.

A node is visible if neither it nor a directory above it is skipped.  Whether a directory is skipped depends on its path
alone, so the directories above are tested inside the row's own expression: no join and no shuffle, at any depth.
Only what depends on other rows, such as directories left empty, needs one pass over ancestors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborspark.functions import paths
from arborspark.functions.globs import IgnoreRule, compile_rules


@dataclass(frozen=True)
class Scope:
    """A directory ('' is the root) with the rules of its ignore file; the deepest scope above a node alone decides."""

    root: str
    rules: tuple[IgnoreRule, ...] = ()

    @staticmethod
    def of(root: str, lines: Sequence[str]) -> Scope:
        return Scope(root, tuple(compile_rules(lines)))


@dataclass(frozen=True)
class Options:
    scopes: tuple[Scope, ...] = ()
    smart_folders: frozenset[str] = frozenset()
    smart_files: frozenset[str] = frozenset()
    use_smart: bool = False
    hidden_folders: bool = False
    hidden_files: bool = False
    dot_folders: bool = False
    dot_files: bool = False
    extensionless: bool = False
    #: None allows all; an empty set of extensions leaves files without one alone.
    extensions: frozenset[str] | None = None
    root_folders: frozenset[str] | None = None
    name_filter: str | None = None
    smart_everywhere: bool = field(default=False)


def _false() -> Column:
    return F.lit(False)


def _case(branches: Sequence[tuple[Column, Column]], default: Column) -> Column:
    for condition, value in reversed(branches):
        default = F.when(condition, value).otherwise(default)
    return default


def is_ignored(rules: Sequence[IgnoreRule], rel: Column, name: Column, is_dir: Column) -> Column:
    """The last rule that matches decides.

    Unrolled into a CASE from the last rule to the first, with literal patterns: the first true branch wins, which is
    the last match, and each pattern is compiled once a task.  A directory that no rule matches counts as ignored
    if, without any negation, some path rule would match an entry in it.
    """

    def hit(rule: IgnoreRule) -> Column:
        target = name if rule.by_name else F.when(is_dir, F.concat(rel, F.lit("/"))).otherwise(rel) if rule.dir_only else rel
        return target.rlike(rule.pattern())

    matched = _case([(hit(r), F.lit(not r.negated)) for r in reversed(rules)], _false())
    if any(r.negated for r in rules):
        return matched
    probe = _false()
    for r in rules:
        if not (r.dir_only or r.by_name):
            probe = probe | F.concat(rel, F.lit("/_")).rlike(r.pattern())
    return matched | (is_dir & probe)


def may_traverse(rules: Sequence[IgnoreRule], rel: Column) -> Column:
    """Whether an ignored directory may still hold entries that a negation brings back."""
    by_dir = _false()
    for r in rules:
        if r.dir_only and not r.negated:
            by_dir = by_dir | F.concat(rel, F.lit("/")).rlike(r.pattern())
    out = _false()
    inside = F.concat(rel, F.lit("/"))
    for r in rules:
        if not r.negated:
            continue
        if r.by_name:
            out = out | ~by_dir
        elif not r.static_prefix:
            out = out | F.lit(True)
        else:
            prefix = F.lit(f"{r.static_prefix}/")
            out = out | F.startswith(prefix, inside) | F.startswith(inside, prefix)
    return out


def in_scope(path: Column, root: str) -> Column:
    """A scope's root isn't inside its own scope for matching, but for everything else it is."""
    return F.lit(True) if root == "" else (path == root) | F.startswith(path, F.lit(f"{root}/"))


def scope_of(path: Column, roots: Sequence[str]) -> Column:
    """The deepest scope root above the path, null without one."""
    return _case([(in_scope(path, r), F.lit(r)) for r in sorted(roots, key=lambda r: (-len(r), r))], F.lit(None).cast("string"))


def scope_table(nodes: DataFrame, scopes: DataFrame) -> DataFrame:
    """(path, scope_root) for scopes in a table rather than in the plan: ancestors joined on equality, the deepest taken."""
    above = nodes.select("path", F.explode(F.concat(F.array(F.lit("")), paths.ancestors(F.col("path")), F.array("path"))).alias("root_path"))
    hits = above.join(scopes.select("root_path"), "root_path").groupBy("path").agg(F.max_by("root_path", F.length("root_path")).alias("scope_root"))
    return nodes.select("path").join(hits, "path", "left")


def _scoped(options: Options, path: Column, of: callable) -> Column:
    branches = []
    for scope in sorted(options.scopes, key=lambda s: (-len(s.root), s.root)):
        rel = path if scope.root == "" else path.substr(F.lit(len(scope.root) + 2), F.length(path))
        value = of(scope.rules, rel) if scope.rules else _false()
        branches.append((in_scope(path, scope.root), (rel != "") & value))
    return _case(branches, _false())


def git_ignored(options: Options, path: Column, is_dir: Column) -> Column:
    return _scoped(options, path, lambda rules, rel: is_ignored(rules, rel, paths.name(path), is_dir))


def git_traversable(options: Options, path: Column) -> Column:
    return _scoped(options, path, lambda rules, rel: may_traverse(rules, rel))


def smart_applies(options: Options, path: Column) -> Column:
    """Everywhere without scopes, else inside any of them."""
    if not options.use_smart:
        return _false()
    inside = F.lit(not options.scopes)
    for scope in options.scopes:
        inside = inside | in_scope(path, scope.root)
    return inside


def skips_directory(options: Options, path: Column) -> Column:
    name = paths.name(path)
    skip = git_ignored(options, path, F.lit(True)) & ~git_traversable(options, path)
    if options.smart_folders:
        skip = skip | (smart_applies(options, path) & F.lower(name).isin(*sorted(x.lower() for x in options.smart_folders)))
    if options.dot_folders or options.hidden_folders:  # hidden means a dot at the beginning, as on Unix
        skip = skip | paths.is_dot(name)
    return skip


def skips_file(options: Options, path: Column) -> Column:
    name = paths.name(path)
    skip = git_ignored(options, path, _false())
    if options.smart_files:
        skip = skip | (smart_applies(options, path) & F.lower(name).isin(*sorted(x.lower() for x in options.smart_files)))
    if options.dot_files or options.hidden_files:
        skip = skip | paths.is_dot(name)
    if options.extensionless:
        skip = skip | paths.is_extensionless(name)
    return skip


def allowed_extension(options: Options, name: Column) -> Column:
    """Files without an extension always pass; others if theirs is allowed, in any case."""
    if options.extensions is None:
        return F.lit(True)
    known = sorted(x.upper() for x in options.extensions)
    return paths.is_extensionless(name) | (F.upper(paths.extension(name)).isin(*known) if known else _false())


def allowed_root(options: Options, path: Column, is_dir: Column) -> Column:
    """Restricts directories of the first level and what is in them; the root's own files pass."""
    if options.root_folders is None:
        return F.lit(True)
    known = sorted(x.upper() for x in options.root_folders)
    return ((paths.depth(path) == 1) & ~is_dir) | (F.upper(paths.root_segment(path)).isin(*known) if known else _false())


def reachable(options: Options, path: Column) -> Column:
    """No directory above is skipped."""
    return ~F.exists(paths.ancestors(path), lambda a: skips_directory(options, a))


def pruned(nodes: DataFrame, options: Options) -> DataFrame:
    """The nodes that a walk visits: filters by row and by the directories above, without the removal of empty directories."""
    path, is_dir = F.col("path"), F.col("is_dir")
    own = F.when(is_dir, ~skips_directory(options, path)).otherwise(~skips_file(options, path) & allowed_extension(options, paths.name(path)))
    return nodes.filter(allowed_root(options, path, is_dir)).filter(own).filter(reachable(options, path))


def _with_ancestors(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """The anchors and all directories above them."""
    kept = anchors.select(F.explode(F.concat(paths.ancestors(F.col("path")), F.array("path"))).alias("path")).distinct()
    return nodes.join(kept, "path", "left_semi")


def visible(nodes: DataFrame, options: Options) -> DataFrame:
    """The nodes of the filtered tree.

    With a name filter a file stays if its name contains the text, in any case, and a directory if its name does or something in
    it stays.  Without one, a directory goes if it is ignored (or all its entries would be) and nothing is left in it.
    Either way a directory stays if and only if one of its subtree's nodes stays by itself, so one pass over ancestors
    replaces the walk from the leaves.
    """
    walked = pruned(nodes, options)
    path, name, is_dir = F.col("path"), paths.name(F.col("path")), F.col("is_dir")
    if options.name_filter and options.name_filter.strip():
        return _with_ancestors(walked, walked.filter(F.contains(F.upper(name), F.lit(options.name_filter.upper()))))
    if not any(s.rules for s in options.scopes):
        return walked
    return _with_ancestors(walked, walked.filter(~(is_dir & ~F.coalesce(F.col("access_denied"), _false()) & emptied(options, path))))


def emptied(options: Options, path: Column) -> Column:
    """A directory that goes when nothing is left in it."""
    probe = F.concat(path, F.lit("/_probe_"))
    return git_ignored(options, path, F.lit(True)) | git_ignored(options, probe, _false())


def with_directories(files: DataFrame) -> DataFrame:
    """All nodes (path, name, parent, depth, is_dir, access_denied) of a table of file paths: the files and the directories above them."""
    dirs = files.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct().withColumn("is_dir", F.lit(True))
    return describe(files.select("path").distinct().withColumn("is_dir", F.lit(False)).union(dirs))


def describe(nodes: DataFrame) -> DataFrame:
    p = F.col("path")
    return nodes.select("path", paths.name(p).alias("name"), paths.parent(p).alias("parent"), paths.depth(p).alias("depth"), "is_dir", F.lit(False).alias("access_denied"))
