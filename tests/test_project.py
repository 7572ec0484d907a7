"""Real folders from opening to export."""

import os
import subprocess
import zipfile
from urllib.error import HTTPError

import pytest
from pyspark.sql import functions as F

from arborspark import cli
from arborspark.operators import facets, presentation
from arborspark.operators.scopes import Requested
from arborspark.operators.visibility import Options
from arborspark.plans.project import Project
from arborspark.sources import archives, repositories, walk


def make(root, files):
    for path, content in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content if isinstance(content, bytes) else content.encode())


MIXED = {
    "gitp/.gitignore": "bin/\nobj/\n", "gitp/a.csproj": "<x/>", "gitp/src/main.cs": "class A {}\n", "gitp/bin/out.txt": "o", "gitp/obj/tmp.txt": "t",
    "node/package.json": "{}", "node/src/app.js": "x", "node/node_modules/m/i.js": "m", "node/coverage/c.txt": "c", "node/empty.txt": "", "node/logo.png": b"\x89PNG\0", "node/blob.dat2": b"a\0b",
}


@pytest.fixture
def mixed(tmp_path):
    make(tmp_path, MIXED)
    return str(tmp_path)


def paths(df):
    return {r.path for r in df.select("path").collect()}


def test_walk_lists_what_spark_leaves_out(spark, tmp_path):
    make(tmp_path, {".gitignore": "x", "_u.txt": "u", "empty.txt": "", "a/b/c/d.txt": "deep", ".h/x": "h"})
    os.mkdir(tmp_path / "void")
    df = walk.walk(spark, str(tmp_path), content=True)
    assert paths(df) == {".gitignore", "_u.txt", "empty.txt", "a", "a/b", "a/b/c", "a/b/c/d.txt", ".h", ".h/x", "void"}
    assert {r.path: bytes(r.content) for r in df.filter("not is_dir").collect()}["a/b/c/d.txt"] == b"deep"
    assert paths(walk.walk(spark, str(tmp_path), prune=["A"], prune_dot=True)) == {".gitignore", "_u.txt", "empty.txt", "void"}
    assert walk.walk(spark, str(tmp_path / "missing")).count() == 0 and walk.can_read(str(tmp_path))


@pytest.mark.parametrize(
    "git, smart, hidden",
    [
        (True, True, {"gitp/bin", "gitp/bin/out.txt", "gitp/obj", "gitp/obj/tmp.txt", "node/node_modules", "node/node_modules/m", "node/node_modules/m/i.js", "node/coverage", "node/coverage/c.txt"}),
        (True, False, {"gitp/bin", "gitp/bin/out.txt", "gitp/obj", "gitp/obj/tmp.txt"}),
        (False, True, {"gitp/bin", "gitp/bin/out.txt", "gitp/obj", "gitp/obj/tmp.txt", "node/node_modules", "node/node_modules/m", "node/node_modules/m/i.js", "node/coverage", "node/coverage/c.txt"}),
        (False, False, set()),
    ],
)
def test_mixed_workspace(spark, mixed, git, smart, hidden):
    project = Project.open(spark, mixed, requested=Requested(git, smart), filters=Options())
    everything = paths(project.nodes)
    assert everything - paths(project.visible()) == hidden


def test_documents_and_totals(spark, mixed):
    project = Project.open(spark, mixed, "top")
    text = project.document().first().document
    assert text.startswith("gitp/a.csproj:\n \n<x/>\n \n \ngitp/src/main.cs:\n \nclass A {}\n")
    assert "node/empty.txt:\n \n[No Content, 0 bytes]" in text and "logo.png" not in text and "blob.dat2" not in text
    totals = project.totals().first()
    assert (totals.n_lines, totals.n_chars, totals.n_files) == (text.count("\n") + 1, len(text), 5)
    assert project.tree().first().tree.startswith("top:\n\n├── gitp\n│   ├── src\n")
    assert {r.token for r in project.extensions().collect()} == {".cs", ".csproj", ".js", ".json", ".txt", ".png", ".dat2"}
    assert [r.name for r in project.root_folders().orderBy("position").collect()] == ["gitp", "node"]


def test_single_scope_smart_follows_git(spark, tmp_path):
    make(tmp_path, {".gitignore": "# nothing\n", "x.csproj": "", "bin/a.txt": "a"})
    for git, seen in ((True, False), (False, True)):
        project = Project.open(spark, str(tmp_path), requested=Requested(git=git, smart=True), filters=Options())
        assert ("bin" in paths(project.visible())) == seen


def test_cli(spark, mixed, tmp_path, capsys):
    out = tmp_path / "out.txt"
    assert cli.main(["--path", mixed, "--format", "both", "--out", str(out), "--lang", " EN "]) == 0
    assert out.read_text().count(" \n \ngitp/a.csproj:") == 1
    assert cli.parse(["--lang", "xx"]).lang is None


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("repo-main/", "")
        z.writestr("repo-main/src/a.txt", "hello")
    (tmp_path / "bad.zip").write_bytes(b"no")
    rows = archives.read_zips(spark, str(tmp_path / "*.zip")).collect()
    assert {(r.path, r.is_dir, r.size) for r in rows} == {(None, True, 0), ("src/a.txt", False, 5)}


def test_zip_with_two_top_folders(spark, tmp_path):
    """The first folder is the top one; what lies beside it keeps its path."""
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        for name in ("root.txt", "one/a.txt", "two/b.txt", "onemore/c.txt"):
            z.writestr(name, "x")
    assert {r.path for r in archives.read_zips(spark, str(tmp_path / "r.zip")).collect()} == {"root.txt", "a.txt", "two/b.txt", "onemore/c.txt"}


def test_download_tries_master_after_main(tmp_path):
    tried = []

    def fetch(url, target):
        tried.append(url)
        if "main" in url:
            raise HTTPError(url, 404, "not found", None, None)
        if "broken" in url:
            raise HTTPError(url, 500, "broken", None, None)
        (tmp_path / target).write_text("zip")

    assert repositories.download(["x/main", "x/master"], "z", fetch) == "x/master" and tried == ["x/main", "x/master"]
    assert repositories.download(["x/main"], "z", fetch) is None
    with pytest.raises(HTTPError):
        repositories.download(["broken", "x/master"], "z", fetch)


def test_denied_directories(spark, tmp_path):
    """Listing fails inside tasks, for a directory and for the root; root users are denied nothing, so the scan is made to fail."""
    make(tmp_path, {"open/a.txt": "a", "shut/b.txt": "b"})

    def run(denied):
        reader = walk.WalkReader({"path": str(tmp_path), "with_root": "true", "split_depth": "1"})
        real = os.scandir

        def scandir(path):
            if str(path).rstrip("/") == denied:
                raise PermissionError(path)
            return real(path)

        os.scandir = scandir
        try:
            return sorted((r for part in reader.partitions() for r in reader.read(part)), key=lambda r: r[0])
        finally:
            os.scandir = real

    rows = {r[0]: r[7] for r in run(str(tmp_path / "shut"))}
    assert rows == {"": False, "open": False, "open/a.txt": False, "shut": True}
    rows = {r[0]: r[7] for r in run(str(tmp_path))}
    assert rows == {"": True}
    nodes = walk.walk(spark, str(tmp_path), with_root=True)
    assert paths(nodes) == {"", "open", "open/a.txt", "shut", "shut/b.txt"}
    assert tuple(facets.readable_flags(nodes).first()) == (False, False)
    assert tuple(facets.readable_flags(nodes.withColumn("access_denied", F.col("path") == "")).first()) == (True, True)


def test_catalogues(spark, tmp_path):
    (tmp_path / "en.json").write_text('\ufeff{"a": "Open", "b": "Close"}', encoding="utf-8")
    (tmp_path / "de.json").write_text('{"a": "Öffnen"}', encoding="utf-8")
    texts = presentation.catalogue(spark, str(tmp_path))
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert {tuple(r) for r in presentation.localised(keys, texts, "de").collect()} == {("a", "Öffnen"), ("b", "Close"), ("c", "[[c]]")}


def test_repositories(tmp_path):
    origin = tmp_path / "origin"
    origin.mkdir()
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@x", *a], cwd=origin, check=True, capture_output=True)
    run("init", "-b", "main")
    (origin / "a").write_text("1")
    run("add", "a")
    run("commit", "-m", "one")
    run("branch", "other")
    folder = str(tmp_path / "copy")
    assert repositories.clone(f"file://{origin}", folder).success
    assert repositories.current_branch(folder) == "main" and len(repositories.head(folder)) == 40
    assert any("refs/heads/other" in x for x in repositories.branch_lines(folder))
    assert repositories.local_branches(folder) == ["main"]
    assert repositories.switch(folder, "other").success and repositories.current_branch(folder) == "other"
    assert not repositories.clone("file:///nowhere/at/all", str(tmp_path / "no")).success


def test_stream_keeps_measures(spark, tmp_path):
    from arborspark.streaming import measures

    for n, rows in enumerate([[("a", "x\ny", 1), ("b", "", 1)], [("a", "z", 2)]]):
        spark.createDataFrame(rows, "path string, text string, arrived int").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    for n in range(2):
        stream = spark.readStream.schema("path string, text string, arrived int").parquet(f"{tmp_path}/in/{n}")
        measures.keep_measures(stream, f"{tmp_path}/out{n}", f"{tmp_path}/cp{n}", available_now=True).awaitTermination()
    assert {r.path: r.line_count for r in measures.newest(spark, f"{tmp_path}/out0").collect()} == {"a": 2, "b": 0}
    assert {r.path: r.line_count for r in measures.newest(spark, f"{tmp_path}/out1").collect()} == {"a": 1}
