"""Rendering, selections and search against recursive versions of the same."""

import json
import random

from pyspark.sql import functions as F

from arborspark.operators import presentation, profiles, render, search, selection, visibility
from arborspark.functions import gitparse, urls


def order(node):
    return sorted(node.items(), key=lambda x: (x[1] is None, x[0].upper(), x[0]))


def ascii_of(node, indent=""):
    out, items = [], order(node)
    for i, (name, child) in enumerate(items):
        last = i == len(items) - 1
        out.append(indent + ("└── " if last else "├── ") + name)
        if child is not None:
            out += ascii_of(child, indent + ("    " if last else "│   "))
    return out


def tree_of(files):
    tree = {}
    for f in files:
        at = tree
        *dirs, leaf = f.split("/")
        for d in dirs:
            at = at.setdefault(d, {})
        at[leaf] = None
    return tree


def random_tree(seed):
    rng = random.Random(seed)
    files = {"/".join([*(rng.choice(["B", "a", "_c", "d.x"]) for _ in range(rng.randint(0, 3))), rng.choice(["f1", "F2", "f1.txt", "_z"])]) for _ in range(25)}
    return sorted(f for f in files if not any(g.startswith(f + "/") for g in files))


def test_ascii_and_json(spark):
    for seed in range(4):
        files = random_tree(seed)
        nodes = visibility.with_directories(spark.createDataFrame([(f,) for f in files], "path string"))
        text = render.ascii_tree(nodes, "top").first().tree
        assert text == "top:\n\n" + "\n".join(ascii_of(tree_of(files))) + "\n"
        got = json.loads(render.json_tree(nodes.withColumn("p", F.lit("top")), "p", "/r").first().json)

        def expected(name, path, node):
            dirs = [expected(n, f"{path}/{n}" if path else n, c) for n, c in order(node) if c is not None]
            names = [n for n, c in order(node) if c is None]
            return {"name": name, "path": path} | ({"dirs": dirs} if dirs else {}) | ({"files": names} if names else {})

        want = expected("top", "", tree_of(files)) | {"path": "/r"}
        assert got == {"rootPath": "/r", "root": want}


def test_nothing_selected_renders_nothing(spark):
    nodes = visibility.with_directories(spark.createDataFrame([("a/b",)], "path string"))
    assert render.ascii_tree(selection.selected_tree(nodes, spark.createDataFrame([("zz",)], "path string")), "top").count() == 0


def test_roll_up(spark):
    for seed in range(3):
        files = random_tree(seed)
        rng = random.Random(seed)
        checked = {f for f in files if rng.random() < 0.6}
        nodes = visibility.with_directories(spark.createDataFrame([(f,) for f in files], "path string"))
        got = {r.path: r.is_checked for r in selection.roll_up(nodes, spark.createDataFrame([(c,) for c in checked], "path string")).collect()}

        def state(path):
            below = [f in checked for f in files if f == path or f.startswith(path + "/")]
            return True if all(below) else None if any(below) else False

        assert got == {p: state(p) for p in got} and len(got) == nodes.count()


def test_search(spark):
    nodes = visibility.with_directories(spark.createDataFrame([("src/Alpha.cs",), ("src/beta/alphabet.txt",), ("gamma/x",)], "path string"))
    assert [r.path for r in search.find(nodes, "ALPHA").orderBy("match").collect()] == ["src/beta/alphabet.txt", "src/Alpha.cs"]
    assert search.find(nodes, "alpha", case_sensitive=True).count() == 1
    assert search.find(nodes, "  ").count() == 0
    actions = {r.path: r.action for r in search.expansion(nodes, "beta").collect()}
    assert actions == {"src": "expand", "src/beta": "unchanged", "src/beta/alphabet.txt": "unchanged", "src/Alpha.cs": "unchanged", "gamma": "collapse", "gamma/x": "unchanged"}
    runs = spark.createDataFrame([("aXbxa(",)], "n string").select(search.highlight(F.col("n"), "x").alias("r"), search.highlight(F.col("n"), "a(").alias("s")).first()
    assert [(x.text, x.is_match) for x in runs.r] == [("a", False), ("X", True), ("b", False), ("x", True), ("a(", False)]
    assert [(x.text, x.is_match) for x in runs.s] == [("aXbx", False), ("a(", True)]


def test_icons_and_names(spark):
    nodes = spark.createDataFrame([("Dockerfile", False), ("a.CS", False), ("bin", True), ("src", True), ("odd", False)], "name string, is_dir boolean").withColumn("access_denied", F.lit(False))
    assert {r.name: r.icon_key for r in presentation.with_icons(nodes).collect()} == {"Dockerfile": "docker", "a.CS": "csharp", "bin": "grayFolder", "src": "folder", "odd": "unknownFile"}


def test_profiles_round_trip(spark, tmp_path):
    path = str(tmp_path / "p.json")
    assert profiles.read(spark, path).count() == 0
    rows = [("/a/", ["x", "X", " "], None, ["i"], "2024-01-01 00:00:00"), ("  ", ["x"], None, None, "2024-01-01 00:00:00"), ("/b", None, [".cs"], None, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, profiles.SCHEMA.replace("timestamp", "string")).withColumn("updated_utc", F.to_timestamp("updated_utc"))
    profiles.write(df, path)
    got = {r.path: (r.roots, r.exts, r.ignore_ids) for r in profiles.read(spark, path).collect()}
    assert got == {"/a": (["x"], [], ["i"]), "/b": ([], [".cs"], [])}
    (tmp_path / "p.json").write_text("{broken")
    assert profiles.read(spark, path).count() == 0


def test_urls_and_git(spark):
    one = spark.range(1)
    assert one.select(urls.encode_path(F.lit("a b/c#d/é~.-_*"))).first()[0] == "a%20b/c%23d/%C3%A9~.-_%2A"
    assert one.select(urls.sanitised(F.lit('a<b>:"/\\|?*\x01c'))).first()[0] == "abc"
    assert one.select(urls.sanitised(F.lit("???"))).first()[0] == "repo"
    assert one.select(gitparse.progress(F.lit("x 120% 33%"))).first()[0] == 33
