"""Ignore patterns: fixed cases, and random ones against a matcher without regular expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from arborspark.functions.globs import compile_rules, parse_rule
from arborspark.operators.visibility import is_ignored, may_traverse


def decide(lines, path, is_dir):
    """The last rule that hits, by Python's regular expressions; with the probe of a directory's contents."""
    rules, found, name = compile_rules(lines), False, path.rsplit("/", 1)[-1]
    for r in rules:
        target = name if r.by_name else path + "/" if r.dir_only and is_dir else path
        if re.search(r.pattern(r"\Z"), target):
            found = not r.negated
    if is_dir and not found and not any(r.negated for r in rules):
        return any(not r.dir_only and not r.by_name and re.search(r.pattern(r"\Z"), path + "/_") for r in rules)
    return found


@pytest.mark.parametrize(
    "lines, path, is_dir, expected",
    [
        (["*.log"], "src/debug.log", False, True), (["*.log"], "debug.txt", False, False),
        (["debug.log"], "src/debug.log", False, True), (["debug.log"], "src/debug.log.bak", False, False),
        (["[Oo]bj/"], "obj", True, True), (["[Oo]bj/"], "Obj", True, True), (["[abc]"], "d", False, False), (["[0-9]"], "x", False, False), (["[a-z]"], "M", False, False),
        (["**/bin/*"], "bin/Debug", True, True), (["**/bin/*"], "src/Project/bin/Release", True, True), (["**/bin/*"], "Bin/x64", True, False),
        (["vendor/**"], "vendor/a/b/c/d.txt", False, True),
        (["file?.txt"], "file1.txt", False, True), (["file?.txt"], "file.txt", False, False), (["file?.txt"], "file12.txt", False, False),
        (["a/b"], "x/a/b", False, True), (["/a/b"], "x/a/b", False, False), (["[!a]"], "!", False, True), (["[!a]"], "b", False, False), (["[a&&b]"], "&", False, True), (["[a[b]"], "[", False, True),
        (["\\#x"], "#x", False, True), (["\\!x"], "!x", False, True), (["\\*.log"], "a/x.log", False, False), (["\\*.log"], "x.log", False, True),
        (["# c", "", "  "], "c", False, False), (["*.log", "!keep.log"], "keep.log", False, False), (["!keep.log", "*.log"], "keep.log", False, True),
        (["[bad", "*.log"], "x.log", False, False), (["docs/*"], "docs", True, True), (["docs/*", "!x"], "docs", True, False),
        (["build/"], "build", False, False), (["build/"], "build/x/y.txt", False, True),
    ],
)
def test_cases(lines, path, is_dir, expected):
    assert bool(decide(lines, path, is_dir)) == expected


def test_a_line_of_marks_alone_is_no_rule():
    assert [parse_rule(x) for x in ("", "#", "!", "/", "!/", "   ")] == [None] * 6


def glob_match(glob, text):
    """Without regular expressions: '**/' any directories or none, '**' anything, '*' and '?' all but slashes."""
    if not glob:
        return not text
    if glob.startswith("**/"):
        return glob_match(glob[3:], text) or any(glob_match(glob[3:], text[i + 1 :]) for i, c in enumerate(text) if c == "/")
    if glob.startswith("**"):
        return any(glob_match(glob[2:], text[i:]) for i in range(len(text) + 1))
    if glob[0] == "*":
        return any(glob_match(glob[1:], text[i:]) for i in range(len(text) + 1) if "/" not in text[:i])
    return bool(text) and (text[0] != "/" if glob[0] == "?" else glob[0] == text[0]) and glob_match(glob[1:], text[1:])


def brute(lines, path, is_dir):
    name, found, path_rules, negated_any = path.rsplit("/", 1)[-1], False, [], any(x.startswith("!") for x in lines)
    tails = lambda p: [p, *(p[i + 1 :] for i, c in enumerate(p) if c == "/")]

    def hit(line, p, d):
        dir_only, anchored = line.endswith("/"), line.startswith("/")
        body = line.strip("/") if dir_only else line.lstrip("/")
        if dir_only:
            starts = [p + "/" if d else p] if anchored else tails(p + "/" if d else p)
            return any(glob_match(body, s[:i]) for s in starts for i, c in enumerate(s) if c == "/")
        if "/" not in body and not anchored:
            return glob_match(body, p.rsplit("/", 1)[-1])
        return any(glob_match(body, s) for s in ([p] if anchored else tails(p)))

    for line in lines:
        negated = line.startswith("!")
        body = line[negated:]
        if hit(body, path, is_dir):
            found = not negated
        if not body.endswith("/") and ("/" in body):
            path_rules.append(body)
    if is_dir and not found and not negated_any:
        return any(hit(b, path + "/_", False) for b in path_rules)
    return found


def random_cases(seed):
    rng = random.Random(seed)
    part = lambda: "".join(rng.choice(["a", "b", "c", "*", "?", "ab"]) for _ in range(rng.randint(1, 2))).replace("**", "*")
    lines = []
    for _ in range(rng.randint(1, 5)):
        body = "/".join(rng.choice([part(), part(), "**"]) for _ in range(rng.randint(1, 3)))
        lines.append(rng.choice(["", "", "!"]) + rng.choice(["", "/"]) + body + rng.choice(["", "/"]))
    paths = sorted({"/".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(1, 4))) for _ in range(60)})
    return [x for x in lines if x.strip("!/")], paths


@pytest.mark.parametrize("seed", range(60))
def test_random_patterns_against_brute_force(seed):
    lines, paths = random_cases(seed)
    for path in paths:
        for is_dir in (True, False):
            assert bool(decide(lines, path, is_dir)) == bool(brute(lines, path, is_dir)), (lines, path, is_dir)


def test_spark_agrees_with_brute_force(spark):
    for seed in range(100, 108):
        lines, paths = random_cases(seed)
        rows = [(p, p.rsplit("/", 1)[-1], d) for p in paths for d in (True, False)]
        df = spark.createDataFrame(rows, "path string, name string, is_dir boolean")
        got = {(r.path, r.is_dir): r.hit for r in df.select("path", "is_dir", is_ignored(compile_rules(lines), F.col("path"), F.col("name"), F.col("is_dir")).alias("hit")).collect()}
        assert got == {(p, d): bool(brute(lines, p, d)) for p, _, d in rows}, lines


@pytest.mark.parametrize(
    "lines, path, expected",
    [
        (["build/", "!keep.txt"], "build", False), (["**/build/*", "!keep.txt"], "build", True), (["build/", "!build/keep.txt"], "build", True), (["build/", "!build/keep.txt"], "other", False),
        (["[Bb]in/", "!Directory.Build.rsp"], "src/bin", False), (["docs/*", "!docs/keep.txt"], "a/docs", False), (["x/*", "!*/y.txt"], "x", True),
    ],
)
def test_traversal(spark, lines, path, expected):
    assert spark.createDataFrame([(path,)], "path string").select(may_traverse(compile_rules(lines), F.col("path"))).first()[0] is expected
