"""BPE encoding and decoding of unsplit text by tree concatenation.

A text is one piece, not split into words first.  A long one is halved until its parts are short, the parts are encoded
by themselves, and neighbours are joined pairwise: a window of tokens around the joint is decoded and encoded
again, and grows until its first token is one that the left side had there and its last one that the right side had.

That is exact.  A sequence of tokens is the encoding of its bytes if and only if each two adjacent tokens are the
encoding of theirs; inside each side and inside the window that holds, and the window shares a token with each side.

Texts beyond ``segment_chars`` are cut into segments that are rows of their own, so that several executors
encode one long text; the shuffle that brings its tokens together carries such texts only.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Bpe:
    """A byte-level vocabulary of ranks, without pre-splitting."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self._piece = tiktoken.Encoding("unsplit", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def encode_piece(self, data: bytes) -> list[int]:
        return self._piece(data) if data else []

    def join(self, left: list[int], right: list[int], window: int = 4) -> list[int]:
        """The encoding of the two sides' bytes, from the encodings of each."""
        if not left or not right:
            return left + right
        while True:
            a, b = left[-window:], right[:window]
            again = self._piece(b"".join(map(self.tokens.__getitem__, a + b)))
            if (window >= len(left) or again[0] == a[0]) and (window >= len(right) or again[-1] == b[-1]):
                return left[:-window] + again + right[window:]
            window *= 2

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Joins neighbours level by level."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def encode(self, data: bytes, leaf: int = 16 << 10) -> list[int]:
        """Halves ``data`` down to ``leaf`` bytes, encodes the parts and joins them."""
        if len(data) <= leaf:
            return self.encode_piece(data)
        half = len(data) // 2
        return self.join(self.encode(data[:half], leaf), self.encode(data[half:], leaf))

    def decode(self, tokens: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, tokens))


@lru_cache(2)
def _bpe(path: str) -> Bpe:
    return Bpe(load_ranks(path))


def _lists(rows: list[list[int] | None]) -> pa.Array:
    ends = np.cumsum([0, *(len(r) if r is not None else 0 for r in rows)])
    flat = np.fromiter(chain.from_iterable(r for r in rows if r), np.int32, int(ends[-1]))
    mask = pa.array([r is None for r in rows]) if any(r is None for r in rows) else None
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=mask)


def _out(ids: pa.Array, rows: list[list[int] | None]) -> pa.RecordBatch:
    counts = pa.array([None if r is None else len(r) for r in rows], pa.int32())
    return pa.RecordBatch.from_arrays([ids, counts, _lists(rows)], ["doc_id", "n_tokens", "tokens"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, segment_chars: int = 64 << 10, rows_per_batch: int = 512) -> DataFrame:
    """(doc_id, n_tokens, tokens) for every row, each whole text as one unsplit piece.

    ``vocabulary`` is a file of ranks that every executor can read.

    - A null text gives null tokens; an empty one no tokens; a null id stays null.
    - Repeated rows each give a row.  No rows in, no rows out.  Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    long = F.coalesce(F.length("text") > segment_chars, F.lit(False))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocabulary)
        for big in batches:
            for at in range(0, big.num_rows, rows_per_batch):
                batch = big.slice(at, rows_per_batch)
                texts = batch.column(1)
                yield _out(batch.column(0), [None if (t := texts[i].as_buffer()) is None else bpe.encode(t.to_pybytes()) for i in range(len(texts))])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocabulary)
        for batch in batches:
            texts = batch.column(3)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists([bpe.encode(texts[i].as_buffer().to_pybytes()) for i in range(len(texts))])], ["row", "doc_id", "pos", "tokens"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocabulary)
        for batch in batches:
            for i, parts in enumerate(batch.column(1)):
                yield _out(batch.column(0).slice(i, 1), [bpe.join_all([p["tokens"] for p in parts.as_py()])])

    direct = docs.filter(~long).withColumn("text", F.col("text").cast("binary")).mapInArrow(short, f"doc_id {kind}, n_tokens int, tokens array<int>")
    at = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / segment_chars).cast("int"))
    pieces = docs.filter(long).withColumn("row", F.monotonically_increasing_id())
    pieces = pieces.select("row", "doc_id", F.posexplode(F.transform(at, lambda i: F.col("text").substr(i * segment_chars + 1, F.lit(segment_chars)).cast("binary"))).alias("pos", "part"))
    pieces = pieces.repartition("row", "pos").mapInArrow(segments, f"row bigint, doc_id {kind}, pos int, tokens array<int>")
    whole = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("pos", "tokens"))).alias("parts"))
    return direct.unionByName(whole.select("doc_id", "parts").mapInArrow(joined, f"doc_id {kind}, n_tokens int, tokens array<int>"))


def decode(encoded: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from tokens; null tokens give a null text, none an empty one; bytes that aren't UTF-8 become U+FFFD."""
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(tokens_col).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocabulary)
        for batch in batches:
            texts = [None if t is None else bpe.decode(t).decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
