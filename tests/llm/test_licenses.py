from pathlib import Path

import pytest
from cases import CLASHES, rows
from pyspark.sql import functions as F

from arborspark.llm import licenses

MIT = "Released under the MIT License."
APACHE = "Licensed under the Apache License, Version 2.0."
FILES = [
    ("a/LICENSE", APACHE), ("a/x.txt", "nothing here"), ("a/b/y.txt", None), ("a/b/z.txt", f"code\n# {MIT}\nmore"), ("a/b/c/LICENSE.md", MIT), ("a/b/c/w.txt", ""), ("ab/x.txt", "plain"),
    ("top.txt", "words " * 50_000 + "\n" + MIT), ("twice.txt", "x"), ("twice.txt", APACHE), ("twice.txt", APACHE), (None, MIT), (None, None), ("a/NOTICE", "copyright of nobody in particular and of many other things besides"),
    ("d/LICENSE", "no licence terms at all in these lines of text"), ("d/x", "y"),
]


def scan(spark, files):
    df = spark.createDataFrame(files, "path string, text string").select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in ("path", "text")])
    return {r.path: (r.licence, r.origin, r.directory) for r in licenses.scan(df).collect()}


def test_notices_and_inheritance(spark):
    got = scan(spark, FILES)
    assert got == {
        "a/LICENSE": ("Apache-2.0", "own", None), "a/x.txt": ("Apache-2.0", "inherited", "a"), "a/b/y.txt": ("Apache-2.0", "inherited", "a"), "a/b/z.txt": ("MIT", "own", None),
        "a/b/c/LICENSE.md": ("MIT", "own", None), "a/b/c/w.txt": ("MIT", "inherited", "a/b/c"), "ab/x.txt": (None, "none", None), "top.txt": ("MIT", "own", None), "twice.txt": ("Apache-2.0", "own", None),
        None: ("MIT", "own", None), "a/NOTICE": ("Apache-2.0", "inherited", "a"), "d/LICENSE": (None, "none", None), "d/x": (None, "none", None),
    }


def test_root_licence(spark):
    assert scan(spark, [("LICENSE", MIT), ("deep/er/x", "y")])["deep/er/x"] == ("MIT", "inherited", "")


def test_every_template_finds_itself(spark):
    files = [(f"{k}/LICENSE", text) for k, (_, text) in enumerate(licenses.TEMPLATES)]
    got = scan(spark, files)
    assert {p: x[0] for p, x in got.items()} == {f"{k}/LICENSE": name for k, (name, _) in enumerate(licenses.TEMPLATES)}


def test_whole_licence_texts(spark):
    """Real texts as licence files, among files of other words."""
    texts = {name: Path("/usr/share/common-licenses", file) for name, file in {"GPL-3.0": "GPL-3", "GPL-2.0": "GPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}.items()}
    if not all(p.exists() for p in texts.values()):
        pytest.skip("no licence texts here")
    files = [(f"{name}/LICENSE", p.read_text()) for name, p in texts.items()] + [(f"d/{i}", "the words of this text and of a few others to read") for i in range(20)]
    got = scan(spark, files)
    assert {name: got[f"{name}/LICENSE"] for name in texts} == {name: (name, "own", None) for name in texts}
    assert all(got[f"d/{i}"] == (None, "none", None) for i in range(20))


HEADER = """# Copyright 2020 The Authors. All rights reserved.
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.

import os
"""


def test_blocks_decide_before_lines(spark):
    """A header and a licence text each hold a line that alone says something else."""
    bsd = (Path(licenses.__file__).parent / "licence_texts" / "BSD-3-Clause.txt").read_text()
    files = [("a/x.py", HEADER + "print(1)\n"), ("b/LICENSE", "Copyright (c) 2011, Somebody Else.\nAll rights reserved.\n\n" + bsd), ("c/y.py", "words of a text\nAll rights reserved.\nand further words of it that say nothing"), *((f"d/{i}", "the words of this text and of a few others to read") for i in range(20))]
    got = scan(spark, files)
    assert got["a/x.py"][0] == "Apache-2.0" and got["b/LICENSE"][0] == "BSD-3-Clause" and got["c/y.py"][0] == "Proprietary"


def test_empty(spark):
    assert scan(spark, []) == {}
    assert rows(licenses.scan(spark.createDataFrame([("a/b", None)], "path string, text string"))) == [("a/b", None, "none", None, None)]
