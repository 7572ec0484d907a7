"""Approximate nearest neighbours by multi-index hashing.

Vectors are centred and turned by a learned rotation (iterative quantisation); their signs are their binary codes.  A code is
cut into m substrings, each with an index of its own.  By the pigeonhole principle, codes within a radius of
m (s + 1) - 1 bits agree in some substring but for s bits; probing all values that near in every substring's index
retrieves every code within that radius.  The retrieved vectors are ranked by their floats.

Each query has a radius of its own.  Rings of substring values are probed from the inside, in three rounds: all within one
bit, within three, and then as far as needed.  A query is settled once its radius holds all but ``miss`` of the vectors as
similar as its k-th best so far: two vectors at an angle a differ in a / pi of the bits, give or take a binomial deviation.
In data with close neighbours the first round settles nearly all.  Where neighbours are hardly nearer than other rows,
the radius they need, and with it the work, is wide: no code can tell them apart.

An index is cut into blocks of values that share their upper bits, and a block with more rows than ``block_rows`` into as many
as it takes, so that a task holds one block at a time; queries stream past it.  Only blocks that a query's rings reach
get it, and a block gives back at most k rows for each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.llm.common import cut, discard, shared_table

#: Vector bytes of a block of an index.
BLOCK_BYTES = 4 << 20
#: Rings of the first rounds; the last one goes as far as each query needs.
RINGS = ((0, 1), (2, 3))
RESULT = "vec_id bigint, neighbour_id bigint, rank int, cosine double"


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 30, seed: int = 1) -> np.ndarray:
    """(dims x bits) projection of iterative quantisation for centred rows: principal axes, turned so that signs lose least."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    if not len(x):
        return rng.normal(size=(d, bits))
    base = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :bits]
    if bits > d:  # more bits than dimensions: further random directions
        base = np.concatenate([base, np.linalg.qr(rng.normal(size=(bits, bits)))[0][:d, : bits - d]], 1)
    v = x @ base
    r = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ vt).T
    return base @ r


@dataclass
class Coder:
    """``deviations``: how many binomial deviations above its mean the Hamming distance of neighbours may lie."""

    mean: np.ndarray
    rotation: np.ndarray
    deviations: float

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """(rows x bits/8) bytes."""
        return np.packbits((unit - self.mean) @ self.rotation >= 0, axis=1, bitorder="little")


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows.astype(np.float64) ** 2).sum(1, keepdims=True))
    return (rows / np.where(norm > 0, norm, 1)).astype(np.float32)


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Distances of codes (rows x words of 64 bits) from one."""
    return np.bitwise_count(codes ^ code).sum(1, dtype=np.int64)


def fit(x: np.ndarray, bits: int, miss: float = 0.05, neighbours: int = 10) -> Coder:
    """Mean, rotation and deviations from rows of unit vectors; the last from the nearest rows of some of them.

    The deviations make up for what codes of fewer bits than dimensions, or a few directions, lose.
    """
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    coder = Coder(mean.astype(np.float32), learn_rotation(x - mean, bits).astype(np.float32), 1.6449)
    some = x[:512]
    if len(x) > 10 * neighbours:
        codes = coder.codes(x.astype(np.float32)).view(np.uint64)
        cosine = some @ x.T
        cosine[np.arange(len(some)), np.arange(len(some))] = -2
        near = np.argpartition(-cosine, neighbours, axis=1)[:, :neighbours]
        spread = np.maximum(((some - mean) ** 2).sum(1), 1e-12)
        centred = np.clip(1 - (1 - np.take_along_axis(cosine, near, 1)) / spread[:, None], -1, 1)
        p = np.arccos(centred) / np.pi
        h = np.array([hamming(codes[n], codes[i]) for i, n in enumerate(near)])
        coder.deviations = max(coder.deviations, float(np.quantile((h - bits * p) / np.sqrt(bits * p * (1 - p) + 1), 1 - miss)))
    return coder


@lru_cache(maxsize=64)
def ring(width: int, low: int, high: int) -> np.ndarray:
    """All patterns of ``low`` to ``high`` of ``width`` bits."""
    return np.array([sum(1 << i for i in c) for n in range(low, high + 1) for c in combinations(range(width), n)], np.uint32)


class Block:
    """A block of substring j's index: codes, in the order of their substrings, and vectors."""

    def __init__(self, ids: np.ndarray, least: np.ndarray, codes: np.ndarray, units: np.ndarray, j: int, width: int):
        part = substrings(codes, width)[:, j]
        order = np.argsort(part, kind="stable")
        self.ids, self.least, self.words, self.units, self.width = ids[order], least[order], codes.view(np.uint64)[order], units[order], width
        self.values, self.start, self.value_of = np.unique(part[order], return_index=True, return_inverse=True)
        self.start = np.append(self.start, len(part))

    def probe(self, value: int, low: int, high: int) -> np.ndarray:
        """Rows whose substring differs from ``value`` in ``low`` to ``high`` bits."""
        value = np.uint32(value)
        if sum(comb(self.width, i) for i in range(low, high + 1)) * 8 > len(self.values):  # fewer values than probes: look at each
            d = np.bitwise_count(self.values ^ value)
            return np.flatnonzero(((d >= low) & (d <= high))[self.value_of])
        wanted = ring(self.width, low, high) ^ value
        at = np.minimum(np.searchsorted(self.values, wanted), len(self.values) - 1)
        at = at[self.values[at] == wanted]
        return np.concatenate([np.arange(self.start[i], self.start[i + 1]) for i in at]) if len(at) else np.zeros(0, np.int64)

    def best(self, own: int, word: np.ndarray, unit: np.ndarray, value: int, low: int, high: int, radius: int, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines): of the codes within the radius that the rings reach, the k best of at least ``bound``; ties go to the least id."""
        rows = self.probe(value, low, high)
        rows = rows[hamming(self.words[rows], word) <= radius]
        rough = self.units[rows] @ unit
        least = max(bound, np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1] if len(rough) > k + 1 else bound)
        rows = rows[(rough >= least - 1e-5) & (self.ids[rows] != own)]
        scores = np.round((self.units[rows].astype(np.float64) * unit).sum(1), 6)  # alike in whatever block a row is
        order = np.lexsort((self.ids[rows], self.least[rows], -scores))[:k]
        rows, scores = rows[order], scores[order]
        return rows, scores


def substrings(codes: np.ndarray, width: int) -> np.ndarray:
    """(rows x m) substrings of codes in bytes."""
    return codes.view(f"<u{width // 8}").astype(np.uint32)


def _bytes(column: pa.Array, size: int) -> np.ndarray:
    """(rows x size) bytes of a binary column whose values are all that long."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def _probing(d: int, bits: int, width: int, k: int):
    """Streams rows sorted by (key, kind): a block's index rows, then the queries for it; gives (q, c, least, cosine)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            keys, kinds = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            out: list[tuple] = []
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                part = batch.slice(a, b - a)
                if keys[a] != key:
                    key, held, block = keys[a], [], None
                ids, least, low, high, radius, bound = (part.column(i).to_numpy() for i in (2, 3, 6, 7, 8, 9))
                codes, units = _bytes(part.column(4), bits // 8), _bytes(part.column(5), d * 4).view(np.float32)
                if kinds[a] == 0:
                    held.append((ids, least, codes, units))
                elif held:
                    j = int(key) >> 40
                    block = block or Block(*(np.concatenate(x) for x in zip(*held)), j, width)
                    values, words = substrings(codes, width)[:, j], codes.view(np.uint64)
                    for i in range(len(ids)):
                        rows, scores = block.best(ids[i], words[i], units[i], values[i], low[i], high[i], radius[i], bound[i], k)
                        if len(rows):
                            out.append((np.full(len(rows), ids[i]), block.ids[rows], block.least[rows], scores))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["q", "c", "least", "cosine"])

    return run


def neighbours(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, queries: Column | None = None, bits: int = 64, width: int | None = None, miss: float = 0.05, sample_rows: int = 10_000, block_rows: int | None = None
) -> DataFrame:
    """(vec_id, neighbour_id, rank, cosine): each query row's k nearest other rows by cosine; ``queries`` is a condition on the rows, by default all.

    Every row is indexed.  Rotation, mean and deviations are learned from a sample of at most ``sample_rows`` different
    vectors, those of the least hashes; a neighbour as far as the k-th is missed with a chance of about ``miss``.
    Substrings have ``width`` bits, 16 or 32, by default 16 for up to 2^24 rows.

    - Rows with a null id, a null vector or a null, infinite or NaN element have no result and are nobody's neighbour; so
      have vectors that aren't of the commonest length (of equally common ones, the longest).
    - Ids are whole numbers.  An id with several vectors is as near as the nearest of them and has one list.
    - Zero vectors have cosine 0 with all.  Ties go to the smaller id.  Identical vectors are compared once.
    - Repeated rows count once; fewer than k + 1 rows give fewer neighbours; no rows, none.
    - Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v"), (F.lit(True) if queries is None else queries).alias("asks")).filter("id is not null and size(v) > 0")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    commonest = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if commonest is None:
        return spark.createDataFrame([], RESULT)
    d, n = commonest["d"], commonest["count"]
    width = width or (16 if n <= 1 << 24 else 32)
    m = bits // width
    block_rows = block_rows or max(1024, BLOCK_BYTES // (4 * d))
    upper = min(16, max(0, ceil(log2(max(1, n / block_rows)))))  # bits of a substring that choose its block
    rows = rows.filter(F.size("v") == d).withColumn("h", F.struct(F.xxhash64("v"), F.xxhash64(F.lit(1), "v")))

    distinct = shared_table(rows.groupBy("h", "v").agg(F.min("id").alias("least"), F.max("asks").alias("asks")).withColumn("g", F.monotonically_increasing_id()), "vectors")
    sample = distinct.select("h", "v").orderBy("h").limit(sample_rows).collect()
    coder = fit(_unit(np.array([r["v"] for r in sample], np.float32).reshape(-1, d)).astype(np.float64), bits, miss)
    shared = spark.sparkContext.broadcast(coder)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
            codes = shared.value.codes(unit)
            heads = (substrings(codes, width) >> np.uint32(width - upper) if upper else np.zeros((len(unit), m))).astype(np.int32)
            spread = ((unit - shared.value.mean) ** 2).sum(1).astype(np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * m), pa.array(heads.ravel()))
            binary = lambda a: pa.array([x.tobytes() for x in a], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), binary(codes), binary(unit), lists, pa.array(spread)], ["g", "h", "least", "asks", "nonzero", "code", "unit", "heads", "spread"])

    kind = distinct.schema["h"].dataType.simpleString()
    reps = shared_table(distinct.select("g", "h", "least", "asks", F.exists("v", lambda x: x != 0).alias("nonzero"), "v").mapInArrow(coded, f"g bigint, h {kind}, least bigint, asks boolean, nonzero boolean, code binary, unit binary, heads array<int>, spread double"), "codes")
    discard(distinct)

    parts = reps.select("g", "least", "code", "unit", F.posexplode("heads").alias("j", "head"))
    # at most m 2^upper rows, so that its broadcast is bounded
    blocks = cut(parts.groupBy("j", "head").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("subs")))
    known = F.broadcast(blocks)
    key = lambda sub: (F.shiftleft(F.col("j").cast("bigint"), 40) + F.shiftleft(F.col("head").cast("bigint"), 24) + sub).alias("key")
    none = [F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("radius"), F.lit(0.0).alias("bound")]
    index = parts.join(known, ["j", "head"]).select(key(F.pmod(F.xxhash64("g"), F.col("subs"))), F.lit(0).alias("kind"), "g", "least", "code", "unit", *none)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4096, blocks.agg(F.sum("subs")).first()[0]))

    def probed(todo: DataFrame) -> DataFrame:
        """(q, c, least, cosine) of queries (g, low, high, radius, bound)."""
        asked = reps.join(todo, "g").select("g", "least", "code", "unit", "low", "high", "radius", "bound", F.posexplode("heads").alias("j", "at"))
        near = F.filter(F.sequence(F.lit(0), F.lit((1 << upper) - 1)), lambda x: F.bit_count(x) <= F.col("high"))
        reached = asked.withColumn("head", F.explode(F.transform(near, lambda x: x.bitwiseXOR(F.col("at"))))).join(known, ["j", "head"])
        sent = reached.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).select(key(F.col("sub")), F.lit(1).alias("kind"), "g", "least", "code", "unit", "low", "high", "radius", "bound")
        return index.union(sent).repartition(tasks, "key").sortWithinPartitions("key", "kind").mapInArrow(_probing(d, bits, width, k), "q bigint, c bigint, least bigint, cosine double")

    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), 1 - (1 - F.col("kth")) / F.greatest("spread", F.lit(1e-12))))) / np.pi
    needed = F.when(F.col("n") >= k, F.least(F.lit(bits), F.ceil(bits * angle + coder.deviations * F.sqrt(bits * angle * (1 - angle) + 1)).cast("int"))).otherwise(bits)
    asking = reps.filter("asks").select("g", "spread")
    todo, best = asking.select("g", F.lit(-2.0).alias("bound"), F.lit(0).alias("needed")), None
    for low, high in (*RINGS, (RINGS[-1][1] + 1, None)):
        reach = F.least(F.lit(width), F.floor(F.col("needed") / m).cast("int")) if high is None else F.lit(high)
        found = probed(todo.select("g", F.lit(low).alias("low"), reach.alias("high"), (m * (reach + 1) - 1).cast("int").alias("radius"), "bound"))
        found = (found if best is None else found.union(best)).groupBy("q", "c").agg(F.min("least").alias("least"), F.max("cosine").alias("cosine"))
        best = cut(found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("cosine"), "least", "c"))).filter(F.col("r") <= k).drop("r"))
        if high is None:
            break
        kth = best.groupBy(F.col("q").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("kth"))
        state = asking.join(todo.select("g"), "g", "left_semi").join(kth, "g", "left")
        todo = cut(state.select("g", F.when(F.col("n") >= k, F.col("kth")).otherwise(-2.0).alias("bound"), needed.alias("needed")).filter(F.col("needed") > m * (high + 1) - 1))
        if todo.isEmpty():
            break

    # of rows with the same vector, k + 1 ids are all that any list of k can need
    ids = rows.select("id", "h", "asks").groupBy("id", "h").agg(F.max("asks").alias("asks"))
    some = ids.withColumn("r", F.row_number().over(W.partitionBy("h").orderBy("id"))).filter(F.col("r") <= k + 1).groupBy("h").agg(F.collect_list("id").alias("some"))
    lists = reps.select("g", "h", "asks", "nonzero").join(some, "h")
    own = lists.filter("asks").select(F.col("g").alias("q"), F.when(F.col("nonzero"), 1.0).otherwise(0.0).alias("cosine"), "some")
    other = best.select("q", "c", "cosine").join(lists.select(F.col("g").alias("c"), "some"), "c").select("q", "cosine", "some")
    near = own.union(other).groupBy("q").agg(F.collect_list(F.struct("cosine", "some")).alias("lists"))
    near = near.join(reps.select(F.col("g").alias("q"), "h"), "q").select("h", "lists")
    flat = ids.filter("asks").join(near, "h").select(F.col("id").alias("vec_id"), F.explode("lists").alias("l")).select("vec_id", "l.cosine", F.explode("l.some").alias("neighbour_id"))
    flat = flat.filter("vec_id <> neighbour_id").groupBy("vec_id", "neighbour_id").agg(F.max("cosine").alias("cosine"))
    flat = flat.withColumn("rank", F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbour_id"))).filter(F.col("rank") <= k)
    return flat.select("vec_id", "neighbour_id", "rank", F.round("cosine", 5).alias("cosine"))
