"""ZIP archives as files of a tree: each archive's entries without its top folder."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions.urls import without_top_folder

ENTRIES = "archive string, top string, entry string, is_dir boolean, size bigint, content binary"


def zip_entries(archives: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(archive, top, entry, path, is_dir, size, content) of a table of archives; one that isn't a ZIP file has no entries.

    ``top`` is the folder of the first entry that has one; ``path`` is the entry's path below it, null for the top folder
    itself.  What lies beside the top folder keeps its whole path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    opened = zipfile.ZipFile(io.BytesIO(data.as_py() or b""))
                except zipfile.BadZipFile:
                    continue
                top = next((f[: f.index("/")] for f in (i.filename for i in opened.infolist()) if f.find("/") > 0), None)
                for info in opened.infolist():
                    content = None if info.is_dir() else opened.read(info)
                    yield pa.RecordBatch.from_pydict(
                        {"archive": [archive], "top": pa.array([top], pa.string()), "entry": [info.filename], "is_dir": [info.is_dir()], "size": pa.array([info.file_size], pa.int64()), "content": pa.array([content], pa.binary())}
                    )

    found = archives.select(F.col(path_col).alias("archive"), F.col(content_col).alias("content")).mapInArrow(run, ENTRIES)
    return found.withColumn("path", without_top_folder(F.col("entry"), F.col("top")))


def read_zips(spark: SparkSession, location: str) -> DataFrame:
    return zip_entries(spark.read.format("binaryFile").load(location).select("path", "content"))
