"""Display names and icon keys.  Icons are tables, joined by broadcast: by file name first, then by extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions import paths

GRAY_FOLDERS = (".git", ".idea", ".vs", ".vscode", "bin", "node_modules", "obj")
#: Icon: extensions without the dot.
BY_EXTENSION = {
    "7zip": "7z zip",
    "access": "accdb mdb",
    "audio": "aac ac3 aif aifc aiff amr flac m4a mid midi mka mp2 mp3 ogg opus ra wav wma",
    "batch": "bat cmd",
    "blazor": "razor",
    "c": "c",
    "conf": "cfg conf config editorconfig ini props sh targets toml",
    "cpp": "cc cpp cxx h hh hpp hxx",
    "csharp": "cs csproj csx",
    "css": "css less sass scss",
    "db": "db db3 dbf ldf mdf ndf s3db sqlite sqlite2 sqlite3 sqlite4",
    "dll": "dll",
    "excel": "xls xlsm xlsx xlt xltx",
    "exe": "exe msi",
    "go": "go",
    "gz": "gz tgz",
    "html": "htm html",
    "iso": "iso",
    "java": "java",
    "js": "cjs js mjs",
    "json": "json jsonc",
    "kotlin": "kt kts",
    "md": "markdown md",
    "pdf": "pdf",
    "php": "php",
    "picture": "arw avif bmp cr2 dng gif heic heif ico jfif jpeg jpg nef png psd raw svg tga tif tiff webp",
    "powerpoint": "pps ppsx ppt pptx",
    "powershell": "ps1 ps1xml psc1 psd1 psm1",
    "pyc": "pyc pyo",
    "python": "py pyi pyw",
    "react": "jsx tsx",
    "rust": "rs",
    "sln": "sln",
    "sql": "sql",
    "swift": "swift",
    "tar": "tar",
    "text": "csv log tsv txt",
    "video": "3g2 3gp avi flv m2ts m2v m4v mkv mov mp4 mpe mpeg mpg mts ogv ts vob webm wmv",
    "winrar": "rar",
    "word": "doc docx rtf",
    "xaml": "axaml xaml",
    "xml": "resx xml xsd xsl xslt",
    "yaml": "yaml",
    "yml": "yml",
}
#: Icon: lower-case file names.
BY_NAME = {
    "conf": ".dockerignore .editorconfig .npmignore .npmrc .yarnrc .yarnrc.yml makefile nuget.config yarn.lock",
    "docker": "dockerfile",
    "env": ".env .env.dev .env.local .env.production",
    "git": ".gitattributes .gitignore .gitmodules",
    "json": "global.json package-lock.json package.json",
    "md": "changelog.md copying.md license.md readme readme.md",
    "text": "changelog copying copying.txt license license.txt",
    "yaml": "pnpm-lock.yaml",
}


def _dimension(spark: SparkSession, icons: dict[str, str], key: str) -> DataFrame:
    return spark.createDataFrame([(word, icon) for icon, words in icons.items() for word in words.split()], f"{key} string, icon_of_{key} string")


def with_icons(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``icon_key``: grayFolder or folder; else by file name, by extension, or unknownFile.  Case doesn't matter."""
    spark = nodes.sparkSession
    by_name, by_ext = _dimension(spark, BY_NAME, "n"), _dimension(spark, BY_EXTENSION, "x")
    keyed = nodes.withColumn("n", F.lower("name")).withColumn("x", F.substring(F.lower(paths.extension(F.col("name"))), 2, 1 << 20))
    joined = keyed.join(F.broadcast(by_name), "n", "left").join(F.broadcast(by_ext), "x", "left")
    folder = F.when(F.coalesce("access_denied", F.lit(False)) | F.lower("name").isin(*GRAY_FOLDERS), "grayFolder").otherwise("folder")
    icon = F.when(F.col("is_dir"), folder).otherwise(F.coalesce("icon_of_n", "icon_of_x", F.lit("unknownFile")))
    return joined.withColumn("icon_key", icon).drop("n", "x", "icon_of_n", "icon_of_x")


def display_name(name: Column, denied: Column, is_root: Column, denied_label: str = "[access denied]", denied_root_label: str = "[access denied to root]") -> Column:
    """The name, or a label for what can't be read."""
    return F.when(F.coalesce(denied, F.lit(False)), F.when(is_root, denied_root_label).otherwise(denied_label)).otherwise(name)


def root_label(name: Column, override: Column) -> Column:
    """An override that isn't blank replaces the root's name."""
    return F.coalesce(F.when(F.trim(override) != "", override), name)


def lookup(value: Column, key: Column) -> Column:
    """A catalogue's text, or the key in double brackets."""
    return F.coalesce(value, F.concat(F.lit("[["), key, F.lit("]]")))


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(language, key, text) of a folder's JSON files, each an object of texts and named after its language; a byte-order mark is left out."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.lower(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json\z", 1)).alias("language"), F.ltrim(F.col("value"), F.lit("\ufeff")).alias("json"))
    return files.select("language", F.explode(F.from_json("json", "map<string,string>")).alias("key", "text"))


def localised(keys: DataFrame, texts: DataFrame, language: str, fallback: str = "en") -> DataFrame:
    """``keys`` (key, …) with ``text``: of the language, else of the fallback, else the key in double brackets."""
    wanted = texts.filter(F.col("language").isin(language, fallback)).groupBy("key").agg(F.min_by("text", F.col("language") != language).alias("_text"))
    return keys.join(wanted, "key", "left").withColumn("text", lookup(F.col("_text"), F.col("key"))).drop("_text")


LANGUAGES = {"ru": "ru", "en": "en", "uz": "uz", "tg": "tg", "kk": "kk", "fr": "fr", "de": "de", "it": "it"}


def language_code(text: Column) -> Column:
    """One of the eight known codes, or null."""
    code = F.lower(F.trim(text))
    return F.when(code.isin(*LANGUAGES), code)
