"""Saved selection profiles: normalisation, upsert, pruning and a JSON store that is replaced as a whole."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.operators.facets import distinct_ignoring_case

MAX_PROFILES = 500
SCHEMA = "path string, roots array<string>, exts array<string>, ignore_ids array<string>, updated_utc timestamp"


def normalise(profiles: DataFrame) -> DataFrame:
    """Profiles without blank paths; lists without blanks and repeats; null lists empty; slashes at a path's end gone."""
    none = F.array().cast("array<string>")
    rows = profiles.filter(F.trim("path") != "").withColumn("path", F.regexp_replace(F.trim("path"), r"(.)/+\z", "$1"))
    for c in ("roots", "exts"):
        rows = rows.withColumn(c, distinct_ignoring_case(F.coalesce(c, none)))
    return rows.withColumn("ignore_ids", F.array_distinct(F.coalesce("ignore_ids", none)))


def latest(profiles: DataFrame, *tie: str) -> DataFrame:
    """The newest profile of each path."""
    w = W.partitionBy("path").orderBy(F.desc("updated_utc"), *[F.desc(t) for t in tie])
    return profiles.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes replace profiles of the same path, whatever their dates."""
    return profiles.join(changes.select("path"), "path", "left_anti").unionByName(latest(changes))


def prune(profiles: DataFrame, keep: int = MAX_PROFILES) -> DataFrame:
    """The ``keep`` newest; of equally old ones the first by path.  A top-k: each task keeps k rows, one task merges them."""
    return profiles.orderBy(F.desc("updated_utc"), "path").limit(keep)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A store's profiles; none if it is missing or isn't JSON."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)["profiles"].items()
        rows = [(k, v.get("roots"), v.get("exts"), v.get("ignore_ids"), v.get("updated_utc")) for k, v in found if v is not None]
    except (OSError, ValueError, KeyError, AttributeError, TypeError):
        rows = []
    return normalise(spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).withColumn("updated_utc", F.to_timestamp("updated_utc")))


def write(profiles: DataFrame, path: str) -> None:
    """At most ``MAX_PROFILES`` profiles as one JSON file, put in place by rename."""
    rows = prune(normalise(profiles)).withColumn("updated_utc", F.date_format("updated_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).collect()
    data = {"schema_version": 1, "profiles": {r["path"]: {k: r[k] for k in ("roots", "exts", "ignore_ids", "updated_utc")} for r in rows}}
    temporary = f"{path}.{os.getpid()}.tmp"
    with open(temporary, "w", encoding="utf-8") as f:
        json.dump(data, f, indent=2)
    os.replace(temporary, path)


def stale(entries: DataFrame, now: str, hours: int = 24, created_col: str = "created") -> DataFrame:
    """Cache entries older than so many hours at a given time."""
    return entries.filter(F.col(created_col) < F.to_timestamp(F.lit(now)) - F.expr(f"interval {hours} hours"))
