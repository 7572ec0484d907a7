"""python -m arborspark.cli --path FOLDER [--lang CODE] [--format tree|json|content|both|totals] [--out FILE]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from arborspark.operators import render
from arborspark.operators.presentation import LANGUAGES
from arborspark.plans.project import Project
from arborspark.sources.walk import can_read


def parse(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="arborspark", description="The visible tree and texts of a folder as one document.")
    parser.add_argument("--path", default=".")
    parser.add_argument("--lang", default=None, type=lambda x: LANGUAGES.get(x.strip().lower()), help="code of a language; unknown ones are as if not given")
    parser.add_argument("--format", default="tree", choices=["tree", "json", "content", "both", "totals"])
    parser.add_argument("--out", default=None)
    return parser.parse_args(args)


def main(args: list[str] | None = None) -> int:
    given = parse(args)
    if not can_read(given.path):
        print(f"{given.path} can't be read")
        return 1
    spark = SparkSession.builder.appName("arborspark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    project = Project.open(spark, given.path)
    if given.format == "both":
        pair = project.tree().crossJoin(project.document())
        rows = pair.select(render.tree_and_content(F.col("tree"), F.col("document")).alias("text"))
    else:
        rows = {"tree": project.tree, "json": lambda: project.json().select("json"), "content": project.document, "totals": lambda: project.totals().select(F.to_json(F.struct("*")))}[given.format]()
    if given.out:
        render.write_text(rows, given.out)
    else:
        for row in rows.toLocalIterator():
            print(row[0])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
