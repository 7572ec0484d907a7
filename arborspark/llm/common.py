"""What several operators of this subpackage share: shared storage, cheap scans and vectorised words.

Words are maximal runs of bytes that are neither ASCII white space, ASCII control nor ASCII punctuation, over
lower-cased text.  They are found straight in Arrow's string buffers with numpy, so no Python object is made
for a word or even for a document.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised code works on at a time; bounds a Python worker's memory.
CHUNK_BYTES = 1 << 20

_WORD_BYTE = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="arborspark-")
    import atexit

    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, its lineage cut; for small rows such as ids and edges."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: survives lost executors, prunes columns."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Collects the driver's garbage, upon which Spark deletes the shuffle files of finished steps; else executors' disks keep them until the driver runs short of memory."""
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes what ``shared_table`` wrote; for tables that nothing reads any more."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ordered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``part`` and ``place``: the number of the range of ``order`` that a row is in, and its place there, from 0; written to the shared folder.

    Ranges are shuffled by sampled bounds, so that none is large as long as not too many rows agree in all of ``order``.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return shared_table(rows.select(*df.columns, F.shiftright("_at", 33).alias("part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("place")), "ordered")


def small(df: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """``df`` marked for a broadcast if its rows have at most ``most_bytes``, measured; as it is beyond that, for a shuffled join."""
    lengths = [F.octet_length(F.col(c)) for c, kind in df.dtypes if kind in ("string", "binary")]
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum((F.coalesce(x, F.lit(0)) for x in lengths), F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if size + rows * (16 + 8 * len(df.columns)) <= most_bytes else df


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids``; these are broadcast if they are small."""
    return df.join(small(ids), key, "left_semi")


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null counts as the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes each; a longer row makes a range of its own."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end
        row = end


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place of ``h``."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, CHUNK_BYTES * 2)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))
            _inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE_INVERSE)]))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): words' byte spans, and per row the index of its first word, one more at the end.

    ``data`` starts at ``offsets[0]`` being 0.
    """
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def running_sum(data: np.ndarray) -> np.ndarray:
    """What ``span_hashes`` needs of ``data``; worth keeping where several kinds of spans are hashed."""
    _grow(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)], out=total[1:])
    return total


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span's bytes, from one running sum over ``data``."""
    total = running_sum(data) if total is None else total
    return mix((total[ends] - total[starts]) * _inverses[starts])
