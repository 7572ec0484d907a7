import itertools
import random

import numpy as np
import pytest
from cases import empty, odd

from arborspark.llm import packing


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        lengths = [rng.randint(0, 40) for _ in range(rng.randint(1, 30))]
        sizes, counts = np.unique(lengths, return_counts=True)
        for buckets in (1, 2, 3, 5):
            got = packing.optimal_boundaries(sizes, counts, buckets)
            best = min(padding(lengths, [*c, max(lengths)]) for k in range(min(buckets, len(sizes))) for c in itertools.combinations(sizes[:-1].tolist(), k))
            assert len(got) == min(buckets, len(sizes)) and got[-1] == max(lengths) and padding(lengths, got) == best


def brute(docs, bounds, budget):
    out, at = [], {}
    for doc_id, n in sorted(docs, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1])):
        k = next(i for i, b in enumerate(bounds) if n <= b)
        fits = max(1, budget // max(bounds[k], 1))
        i = at.setdefault(k, 0)
        at[k] += 1
        out.append((doc_id, n, k, bounds[k], i // fits, i % fits))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(2)
    docs = [(rng.randrange(10**7) if rng.random() > 0.02 else None, "w " * rng.choice([0, 1, 3, 10, 50, 51, 52, 200])) for _ in range(500)]
    got = packing.pack(spark.createDataFrame(docs, "doc_id bigint, text string"), buckets=4, token_budget=300).collect()
    lengths = [(d, len(t.split())) for d, t in docs]
    sizes, counts = np.unique([n for _, n in lengths], return_counts=True)
    assert sorted((tuple(r) for r in got), key=repr) == brute(lengths, packing.optimal_boundaries(sizes, counts, 4), 300)


@pytest.mark.parametrize("kind", ["hashed", "string", "one"])
def test_any_ids(spark, kind):
    """64-bit hashes, strings, and one id for all rows."""
    rng = random.Random(3)
    ids = {"hashed": lambda i: rng.randrange(-(2**63), 2**63), "string": lambda i: f"doc-{rng.random()}", "one": lambda i: 7}[kind]
    docs = [(ids(i), "w " * rng.choice([0, 1, 3, 10, 50, 200])) for i in range(3000)]
    placed = packing.pack(spark.createDataFrame(docs, f"doc_id {'string' if kind == 'string' else 'bigint'}, text string"), buckets=3, token_budget=300)
    lengths = [(d, len(t.split())) for d, t in docs]
    sizes, counts = np.unique([n for _, n in lengths], return_counts=True)
    if kind == "one":
        out = sorted(tuple(r)[1:] for r in placed.collect())
        assert out == sorted(r[1:] for r in brute(lengths, packing.optimal_boundaries(sizes, counts, 3), 300))
    else:
        assert sorted((tuple(r) for r in placed.collect()), key=repr) == brute(lengths, packing.optimal_boundaries(sizes, counts, 3), 300)


def test_odd_rows(spark):
    df = odd(spark)
    got = packing.pack(df, token_budget=1000)
    lengths = [(r.doc_id, len((r.text or "").split())) for r in df.select("doc_id", "text").collect()]
    sizes, counts = np.unique([n for _, n in lengths], return_counts=True)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(lengths, packing.optimal_boundaries(sizes, counts, 8), 1000)
    assert packing.pack(empty(spark)).collect() == []
    assert packing.optimal_boundaries(np.zeros(0, int), np.zeros(0, int), 3) == []
