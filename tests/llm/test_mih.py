import math
import os

import numpy as np
import pytest
from cases import CLASHES
from pyspark.sql import functions as F

from arborspark.llm import mih


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").select("*", *[F.lit("x").alias(c) for c in CLASHES])


def brute(ids, x, k=10):
    """The k best cosines of each row, in order."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    scores = x @ x.T
    np.fill_diagonal(scores, -9)
    return {i: {ids[j] for j in np.argsort(-s, kind="stable")[:k]} for i, s in zip(ids, scores)}, {i: np.sort(s)[::-1][:k] for i, s in zip(ids, scores)}


def found(df):
    out = {}
    for r in df.orderBy("vec_id", "rank").collect():
        out.setdefault(r.vec_id, []).append((r.neighbour_id, r["rank"], r.cosine))
    return out


def recall(got, near):
    return sum(len({n for n, _, _ in got.get(i, [])} & near[i]) for i in near) / sum(map(len, near.values()))


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_recall(spark, kind):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 32))
    x = centres[rng.integers(12, size=700)] + rng.normal(size=(700, 32)) * (0.05 if kind == "clusters" else 3.0)
    x = x.astype(np.float32)
    got = found(mih.neighbours(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])))
    near, best = brute(list(range(700)), x)
    assert set(got) == set(range(700)) and all([r for _, r, _ in v] == list(range(1, 11)) for v in got.values())
    assert recall(got, near) >= 0.95
    for i, v in got.items():
        assert all(c <= b + 1e-4 for (_, _, c), b in zip(v, best[i]))


def test_sparse_rows_beside_dense_clusters(spark):
    """Most rows are settled by the small radius; the others still find all of their neighbours."""
    rng = np.random.default_rng(4)
    centres = np.repeat(rng.normal(size=(68, 32)), 40, 0)
    x = np.concatenate([rng.normal(size=(300, 32)), centres + rng.normal(size=centres.shape) * 0.01]).astype(np.float32)
    got = found(mih.neighbours(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])))
    near, _ = brute(list(range(len(x))), x)
    assert recall(got, {i: near[i] for i in range(300)}) >= 0.99
    assert recall(got, {i: near[i] for i in range(300, len(x))}) >= 0.95


def test_probing_finds_all_codes_in_the_radius():
    """Rings up to s in all substrings reach every code within m (s + 1) - 1 bits, and nothing beyond the pigeonhole's promise is needed."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    codes = np.array([int(b) ^ sum(1 << int(i) for i in rng.choice(63, rng.integers(0, 12), replace=False)) for b in base for _ in range(4)], np.uint64)
    raw, unit = codes.view(np.uint8).reshape(-1, 8), np.ones((len(codes), 2), np.float32)
    for width, m in ((16, 4), (32, 2)):
        blocks = [mih.Block(np.arange(len(codes)), np.arange(len(codes)), raw, unit, j, width) for j in range(m)]
        parts = mih.substrings(raw, width)
        for s in range(4):
            for q in range(0, len(codes), 7):
                for j, block in enumerate(blocks):
                    near = {i for i in range(len(codes)) if int(parts[i, j] ^ parts[q, j]).bit_count() <= s}
                    assert set(block.ids[block.probe(parts[q, j], 0, s)].tolist()) == near
                found = {int(i) for j, block in enumerate(blocks) for i in block.ids[block.probe(parts[q, j], 0, s)]}
                assert {i for i in range(len(codes)) if int(codes[i] ^ codes[q]).bit_count() <= m * (s + 1) - 1} <= found


def test_probes_reach_few_rows_where_neighbours_are_close():
    """Among 20,000 rows in clusters of 20 the first rings settle a query after looking at a small part of the index."""
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(1000, 64)), 20, 0) + rng.normal(size=(20_000, 64)) * 0.05
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    coder = mih.fit(x[::2].astype(np.float64), 64)
    codes = coder.codes(x)
    ids, parts = np.arange(len(x)), mih.substrings(codes, 16)
    blocks = [mih.Block(ids, ids, codes, x, j, 16) for j in range(4)]
    looked = hits = 0
    for q in range(0, len(x), 997):
        found = {int(i) for j, b in enumerate(blocks) for i in b.ids[b.probe(parts[q, j], 0, 1)]}
        looked, hits = looked + len(found), hits + len(found & set(range(q // 20 * 20, q // 20 * 20 + 20)))
    assert hits >= 0.95 * 21 * 20 and looked < 21 * 0.02 * len(x)


def test_small_blocks_and_salted_hot_values(spark):
    """Blocks of 16 rows, and a value that a third of all rows share, give what one block gives."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(200, 16)), rng.normal(size=(1, 16)) + rng.normal(size=(100, 16)) * 1e-3]).astype(np.float32)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    assert found(mih.neighbours(df, block_rows=16)) == found(mih.neighbours(df))
    assert found(mih.neighbours(df.repartition(7))) == found(mih.neighbours(df))


def test_queries_are_a_part_of_the_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got, every = found(mih.neighbours(df, queries=F.col("vec_id") % 20 == 0)), found(mih.neighbours(df))
    assert set(got) == set(range(0, 120, 20)) and all(every[i] == v for i, v in got.items())


def test_an_id_with_two_vectors(spark):
    """It is as near as the nearer of them, and has one list."""
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0])]
    got = found(mih.neighbours(frame(spark, rows), k=2))
    assert [(n, c) for n, _, c in got[1]] == [(3, 1.0), (4, 0.70711)] and [(n, c) for n, _, c in got[3]] == [(1, 1.0), (2, 1.0)]


def test_plan_has_no_cross_join(spark):
    rows = [(i, np.random.default_rng(i).normal(size=4).tolist()) for i in range(50)]
    df = mih.neighbours(frame(spark, rows))
    plan = df._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_odd_rows(spark):
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, one), (2, one), (3, two), (3, two), (None, one), (4, None), (5, [1.0]), (6, [1.0, None, 0.0]), (7, [math.nan, 0.0, 0.0]), (8, [math.inf, 0.0, 0.0]), (9, [0.0, 0.0, 0.0]), (10, [])]
    got = found(mih.neighbours(frame(spark, rows)))
    assert set(got) == {1, 2, 3, 9}
    assert got[1][0] == (2, 1, 1.0) and got[2][0] == (1, 1, 1.0) and [n for n, _, _ in got[3]] == [1, 2, 9] and all(c == 0 for _, _, c in got[9])
    assert mih.neighbours(frame(spark, [])).collect() == []
    assert mih.neighbours(frame(spark, [(1, one)])).collect() == []


def test_many_identical_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(100, [2.0, 1.0])]
    got = found(mih.neighbours(frame(spark, rows), k=5))
    assert all([n for n, _, _ in got[i]] == [j for j in range(7) if j != i][:5] for i in range(60))
    assert [n for n, _, _ in got[100]] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_query_recall(spark, sf_dir, folder):
    from arborspark.llm.queries import op5_mih

    here = os.path.join(os.path.dirname(sf_dir), folder)
    rows = spark.read.parquet(f"{here}/embeddings.parquet").collect()
    near, best = brute([r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64))
    got = found(op5_mih(spark, here))
    asked = {i for i in near if i % 20 == 0}
    hits = sum(sum(c >= best[i][-1] - 1e-5 for _, _, c in got[i]) for i in asked)
    assert hits / sum(len(near[i]) for i in asked) >= 0.95 and set(got) == asked
