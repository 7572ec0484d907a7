"""The set-wise filters against a recursive walk of random trees."""

import random

import pytest
from pyspark.sql import functions as F
from test_globs import decide

from arborspark.functions.globs import compile_rules
from arborspark.operators import facets, scopes, smart, visibility
from arborspark.operators.visibility import Options, Scope


def random_files(rng):
    names = ["a", "b", "bin", "obj", ".git", "node_modules", "src", "docs", "x.log", "y.txt", ".env", "README", "z.CS", "keep.txt"]
    return sorted({"/".join([*(rng.choice(names[:8]) for _ in range(rng.randint(0, 3))), rng.choice(names[8:])]) for _ in range(40)})


def traversable(lines, path):
    rules = compile_rules(lines)
    by_dir = decide_any([r for r in rules if r.dir_only and not r.negated], path + "/")
    for r in rules:
        if r.negated:
            if r.by_name:
                if not by_dir:
                    return True
            elif not r.static_prefix or (r.static_prefix + "/").startswith(path + "/") or (path + "/").startswith(r.static_prefix + "/"):
                return True
    return False


def decide_any(rules, target):
    import re

    return any(re.search(r.pattern(r"\Z"), target) for r in rules)


def walk(tree, options, lines_of):
    """A recursive build, children before the decision about an empty directory."""
    roots = sorted((s.root for s in options.scopes), key=len)

    def scope(path):
        inside = [r for r in roots if r == "" or path == r or path.startswith(r + "/")]
        return inside[-1] if inside else None

    def git(path, is_dir):
        s = scope(path)
        rel = path if s in (None, "") else path[len(s) + 1 :]
        return bool(s is not None and rel and decide(lines_of[s], rel, is_dir))

    def passes(path):
        s = scope(path)
        rel = path if s in (None, "") else path[len(s) + 1 :]
        return bool(s is not None and rel and traversable(lines_of[s], rel))

    def smart_here(path):
        return options.use_smart and (not roots or scope(path) is not None)

    out = set()

    def visit(path, node):
        kept = []
        for name, child in node.items():
            p = f"{path}/{name}" if path else name
            top_dir = p.split("/")[0]
            if child is None:
                if options.root_folders is not None and "/" in p and top_dir.upper() not in {x.upper() for x in options.root_folders}:
                    continue
                dot = name.rfind(".")
                ext = name[dot:] if 0 <= dot < len(name) - 1 else ""
                if git(p, False) or (smart_here(p) and name.lower() in options.smart_files) or (options.dot_files and name[0] == ".") or (options.extensionless and not ext):
                    continue
                if options.extensions is not None and ext and ext.upper() not in {x.upper() for x in options.extensions}:
                    continue
                if options.name_filter and options.name_filter.upper() not in name.upper():
                    continue
                kept.append(p)
            else:
                if not path and options.root_folders is not None and name.upper() not in {x.upper() for x in options.root_folders}:
                    continue
                ignored = git(p, True)
                if (ignored and not passes(p)) or (smart_here(p) and name.lower() in options.smart_folders) or (options.dot_folders and name[0] == "."):
                    continue
                below = visit(p, child)
                if not below:
                    if options.name_filter:
                        if options.name_filter.upper() not in name.upper():
                            continue
                    elif any(s.rules for s in options.scopes) and (ignored or git(p + "/_probe_", False)):
                        continue
                kept += [p, *below]
        return kept

    out.update(visit("", tree))
    return out


CONFIGS = [
    ({"": ["bin/", "*.log", "!keep.txt"]}, {}),
    ({"": ["obj", "docs/*", "!docs/keep.txt"], "src": ["*.txt"], "src/a": []}, {"dot_files": True}),
    ({"": ["**/src/*"]}, {"use_smart": True, "smart_folders": frozenset({"node_modules"}), "smart_files": frozenset({"readme"}), "dot_folders": True}),
    ({"a": ["*"], "b": ["!*", "x.log"]}, {"extensionless": True, "extensions": frozenset({".TXT", ".cs"})}),
    ({}, {"name_filter": "O", "root_folders": frozenset({"A", "docs", "obj"})}),
    ({"": ["*.txt"]}, {"name_filter": "keep"}),
    ({"": ["a/", "!a/b/keep.txt", "!*.CS"]}, {"extensions": frozenset()}),
]


@pytest.mark.parametrize("config", range(len(CONFIGS)))
def test_visible_equals_a_recursive_walk(spark, config):
    lines_of, fields = CONFIGS[config]
    options = Options(scopes=tuple(Scope.of(r, x) for r, x in lines_of.items()), **fields)
    for seed in range(3):
        files = random_files(random.Random(config * 100 + seed))
        files = [f for f in files if not any(g.startswith(f + "/") for g in files)]
        tree = {}
        for f in files:
            at = tree
            *dirs, leaf = f.split("/")
            for d in dirs:
                at = at.setdefault(d, {})
            at[leaf] = None
        nodes = visibility.with_directories(spark.createDataFrame([(f,) for f in files], "path string"))
        got = {r.path for r in visibility.visible(nodes, options).select("path").collect()}
        assert got == walk(tree, options, lines_of), (files, lines_of, fields)


def nodes_of(spark, files):
    return visibility.with_directories(spark.createDataFrame([(f,) for f in files], "path string"))


def roots(df):
    return sorted(r.root_path for r in df.collect())


def test_scope_discovery(spark):
    mixed = nodes_of(spark, ["gitp/.gitignore", "gitp/a.csproj", "node/package.json", "plain/x.txt", "deep/er/pom.xml", "too/deep/down/here/go.mod"])
    assert roots(scopes.discover(mixed)) == ["deep", "deep/er", "gitp", "node", "plain", "too"]
    assert roots(scopes.discover(mixed, ["plain"])) == ["plain"]
    assert roots(scopes.discover(nodes_of(spark, ["a/x.txt", "b/y.txt"]))) == [""]
    assert roots(scopes.discover(nodes_of(spark, [".gitignore", "a/package.json"]))) == [""]
    assert roots(scopes.discover(nodes_of(spark, ["only.txt"]))) == [""]
    flags = scopes.context(scopes.discover(nodes_of(spark, [".gitignore", "a/x"]))).first()
    assert (flags.single_with_git, flags.git_available, flags.smart_available) == (True, True, False)


def test_smart_rules():
    folders, files = smart.evaluate({"package.json", "x.CSPROJ"})
    assert {"node_modules", "bin", "obj"} <= folders and files == {".ds_store", "desktop.ini", "thumbs.db"}

    def broken(names):
        raise RuntimeError

    assert smart.evaluate(set(), [broken, lambda names: (["Out"], [])]) == (frozenset({"out"}), frozenset())


def test_facets(spark):
    files = nodes_of(spark, ["a/Makefile", "a/x.cs", "b/y.CS", "b/.env", "z.txt", "b/odd."]).filter("not is_dir")
    found = {r.token: r.n_files for r in facets.extension_facet(files).collect()}
    assert found == {"Makefile": 1, ".CS": 2, ".env": 1, ".txt": 1, "odd.": 1}
    assert {r.token for r in facets.facet_of_roots(files, ["A"]).collect()} == {"Makefile", ".cs", ".txt"}
    split = facets.split_extensions(facets.extension_facet(files)).collect()
    assert {r.token for r in split} == {".CS", ".env", ".txt"} and all(r.has_extensionless for r in split)


def test_empty_nodes(spark):
    none = visibility.with_directories(spark.createDataFrame([], "path string"))
    assert visibility.visible(none, Options(scopes=(Scope.of("", ["x"]),))).count() == 0
    assert facets.extension_facet(none).count() == 0
    assert none.select(F.count("*")).first()[0] == 0
