"""Technology-aware ignores: marker files of an ecosystem hide the folders that its tools produce."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions import paths

_W = str.split
#: Ecosystem: (marker names, marker extensions, folders).
ECOSYSTEMS: dict[str, tuple[list[str], list[str], list[str]]] = {
    "dotnet": ([], _W(".csproj .fsproj .sln .vbproj"), _W("bin obj")),
    "frontend": (
        _W("bun.lock bun.lockb npm-shrinkwrap.json package-lock.json package.json pnpm-lock.yaml pnpm-workspace.yaml yarn.lock"),
        [],
        _W(".angular .astro .cache .next .nuxt .output .parcel-cache .svelte-kit .turbo .vite build coverage dist node_modules out storybook-static"),
    ),
    "go": (_W("go.mod go.work"), [], _W("bin vendor")),
    "jvm": (_W("build.gradle build.gradle.kts pom.xml settings.gradle settings.gradle.kts"), [], _W(".gradle build out target")),
    "php": (["composer.json"], [], ["vendor"]),
    "python": (
        _W("Pipfile environment.yml poetry.lock pyproject.toml requirements-dev.txt requirements.txt setup.cfg setup.py"),
        [],
        _W(".hypothesis .ipynb_checkpoints .mypy_cache .nox .pyre .pytest_cache .ruff_cache .tox .venv __pycache__ env venv"),
    ),
    "ruby": (_W("Gemfile Gemfile.lock"), [], _W(".bundle log tmp vendor")),
    "rust": (["Cargo.toml"], [], ["target"]),
}
#: Hidden everywhere.
COMMON_FILES = _W(".ds_store desktop.ini thumbs.db")

SmartRule = Callable[[set[str]], tuple[Iterable[str], Iterable[str]]]


def ecosystem_rule(names: list[str], extensions: list[str], folders: list[str]) -> SmartRule:
    """A rule for the names of a scope's top-level files: it gives folders and files to hide."""

    def rule(files: set[str]) -> tuple[Iterable[str], Iterable[str]]:
        hit = any(n in files for n in names) or any(f.lower().endswith(x) for f in files for x in extensions)
        return (folders, []) if hit else ([], [])

    return rule


def default_rules() -> list[SmartRule]:
    return [lambda files: ([], COMMON_FILES), *(ecosystem_rule(*x) for x in ECOSYSTEMS.values())]


def evaluate(files: set[str], rules: list[SmartRule] | None = None) -> tuple[frozenset[str], frozenset[str]]:
    """The union of all rules' folders and files, lower-cased; a rule that raises is left out."""
    folders, names = set(), set(COMMON_FILES) if rules is None else set()
    for rule in default_rules() if rules is None else rules:
        try:
            a, b = rule(files)
            a, b = {x.lower() for x in a}, {x.lower() for x in b}
        except Exception:  # noqa: BLE001 - a plug-in's fault is its own
            continue
        folders |= a
        names |= b
    return frozenset(folders), frozenset(names)


def dimension(spark: SparkSession) -> DataFrame:
    """(ecosystem, marker, is_extension, folder): the ecosystems as a table of a fixed size."""
    rows = [(e, m, ext, f) for e, (names, exts, folders) in ECOSYSTEMS.items() for ms, ext in ((names, False), (exts, True)) for m in ms for f in folders]
    return spark.createDataFrame(rows, "ecosystem string, marker string, is_extension boolean, folder string")


def smart_folders(files: DataFrame) -> DataFrame:
    """(parent, folder): what each directory's own marker files hide; the table of files needs path and name."""
    dim = F.broadcast(dimension(files.sparkSession))
    marked = files.select(paths.parent(F.col("path")).alias("parent"), F.col("name"), F.lower(paths.extension(F.col("name"))).alias("ext")).distinct()
    hit = (~F.col("is_extension") & (F.col("marker") == F.col("name"))) | (F.col("is_extension") & (F.col("marker") == F.col("ext")))
    return marked.join(dim, hit).select("parent", "folder").distinct()
