import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from cases import CLASHES, LONG, empty, odd
from pyspark.sql import functions as F

from arborspark.llm import mil
from arborspark.llm.common import string_buffers


@pytest.fixture(scope="module")
def labelled(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").select("doc_id", "text", "quality", "toxic").collect()
    random.Random(1).shuffle(rows := sorted(rows))
    return rows


def test_held_out_accuracy(spark, labelled):
    train, test = labelled[:280], labelled[280:]
    model = mil.train([r.text for r in train], [r.quality for r in train], [r.toxic for r in train])
    df = spark.createDataFrame([(r.doc_id, r.text) for r in test], "doc_id bigint, text string")
    got = {r.doc_id: r for r in mil.classify(df, model).collect()}
    assert np.mean([(got[r.doc_id].quality >= 0.5) == r.quality for r in test]) >= 0.95
    assert np.mean([(got[r.doc_id].toxicity >= 0.5) == r.toxic for r in test]) >= 0.85


def test_gradients_against_differences():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 1, 4, 2, 1])
    at, bag, y = np.cumsum(sizes) - sizes, np.repeat(np.arange(5), sizes), np.array([1.0, 0, 1, 0, 0])
    x = rng.normal(size=(sizes.sum(), 4))
    theta = [rng.normal(size=s) for s in ((4, 3), (3,), (3, 2), (3, 2), (2,), (3,), ())]
    _, grads = mil.loss_and_gradients(theta, x, at, bag, y, 0.1)
    for k, (p, g) in enumerate(zip(theta, grads)):
        for i in np.ndindex(np.shape(p)):
            up, down = [q.copy() for q in map(np.asarray, theta)], [q.copy() for q in map(np.asarray, theta)]
            up[k][i] += 1e-5
            down[k][i] -= 1e-5
            slope = (mil.loss_and_gradients(up, x, at, bag, y, 0.1)[0] - mil.loss_and_gradients(down, x, at, bag, y, 0.1)[0]) / 2e-5
            assert abs(slope - np.asarray(g)[i]) < 1e-6, (k, i)


def test_attention_and_score_against_loops():
    rng = np.random.default_rng(3)
    head = mil.Head(*(rng.normal(size=s) for s in ((5, 3), (3,), (3, 2), (3, 2), (2,), (3,), ())))
    sizes = [2, 1, 5]
    x = rng.normal(size=(8, 5))
    p, weights = head.score(x, np.array([0, 2, 3]), np.repeat(np.arange(3), sizes))
    at = 0
    for n, size in enumerate(sizes):
        hidden, raw = [], []
        for row in x[at : at + size]:
            h = [math.tanh(sum(row[i] * head.w1[i][k] for i in range(5)) + head.b1[k]) for k in range(3)]
            gate = [math.tanh(sum(h[i] * head.v[i][k] for i in range(3))) / (1 + math.exp(-sum(h[i] * head.u[i][k] for i in range(3)))) for k in range(2)]
            hidden.append(h)
            raw.append(math.exp(sum(gate[k] * head.w[k] for k in range(2))))
        share = [r / sum(raw) for r in raw]
        z = sum(s * h[k] * head.c[k] for s, h in zip(share, hidden) for k in range(3)) + head.b
        assert np.allclose(weights[at : at + size], share) and np.isclose(p[n], 1 / (1 + math.exp(-z)))
        at += size


def plain_passages(text, odds):
    """All features of a text's passages, word by word."""
    raw = text.encode()
    fold = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    spans = [m.span() for m in re.finditer(rb"[^\x00-/:-@\[-`{-\x7f]+", fold)]
    groups = [spans[i : i + mil.PASSAGE_WORDS] for i in range(0, len(spans), mil.PASSAGE_WORDS)] or [[]]
    begins = [0, *(g[0][0] for g in groups[1:]), len(raw)]
    sets = [None, bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b" \t", b"\n\r", b"#$%&*", b"|", b"!", b".,;:?", b"\"'()+-/<=>@[\\]^_`{}~", bytes(range(128, 256))]
    out = []
    for g, a, b in zip(groups, begins, begins[1:]):
        part = raw[a:b]
        kinds = [sum(c in s for c in part) / max(1, len(part)) for s in sets[1:]]
        words, n = [fold[i:j] for i, j in g], len(g)
        row = [1 - sum(kinds) if part else 0, *kinds, math.log1p(n)]
        if not n:
            out.append(row + [0] * (mil.WIDTH - len(row)))
            continue
        row += [sum(map(len, words)) / n, sum(x == y for x, y in zip(words, words[1:])) / n, len(set(words)) / n]

        def odd(word, k, length):
            one = np.frombuffer(word, np.uint8)
            cut = min(len(word), length) if length else len(word)
            h = mil.span_hashes(one, np.array([0]), np.array([cut]))[0]
            return odds[int(h >> np.uint64(7 * length)) & (mil.ODDS - 1), k]

        q, t = ([odd(w, k, 0) for w in words] for k in (0, 1))
        row += [sum(q) / n, sum(t) / n, min(q), max(t)]
        for length in mil.PREFIXES[1:]:
            t = [odd(w, 1, length) for w in words]
            row += [sum(t) / n, max(t), math.log1p(sum(x > mil.MARK for x in t))]
        out.append(row)
    return out


def test_all_features_against_loops():
    rng = random.Random(4)
    texts = ["", "One", " ".join(f"w{rng.randrange(9)}" for _ in range(150)), "¡é! x\n2", "...", "The the THE end | #5 $x & more, isn't it?\tYes!", "\u00fcber " * 70]
    odds = np.random.default_rng(5).normal(size=(mil.ODDS, 2)).astype(np.float32) * 2
    x, first = mil.passages(*string_buffers(pa.array(texts)), odds)
    want = [row for t in texts for row in plain_passages(t, odds)]
    assert x.shape == (len(want), mil.WIDTH) and np.allclose(x, want, atol=1e-5)


def test_gradients():
    """The loss falls along the gradient: two kinds of bags that differ in one passage become separable."""
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 12, 200)
    first = np.concatenate([[0], np.cumsum(sizes)])
    y = (np.arange(200) % 3 == 0).astype(float)
    x = rng.normal(size=(first[-1], 6))
    where = first[:-1] + rng.integers(0, sizes)
    x[where[y == 1], 2] += 6
    head = mil.fit_head(x, first, y)
    p, a = head.score(x.astype(np.float32), first[:-1], np.repeat(np.arange(200), sizes))
    assert ((p > 0.5) == y).mean() > 0.97
    many = (y == 1) & (sizes > 3)
    assert np.median(a[where[many]]) > 2 * np.median(1 / sizes[many])


def test_passages_against_plain_python():
    texts = ["", "one", " ".join(f"w{i % 7}" for i in range(150)), "¡é! x\n2", "..."]
    odds = np.zeros((mil.ODDS, 2), np.float32)
    x, first = mil.passages(*string_buffers(pa.array(texts)), odds)
    assert np.diff(first).tolist() == [1, 1, 3, 1, 1]
    assert np.allclose(x[first[2] : first[3], mil.KINDS], np.log1p([64, 64, 22]))
    assert np.allclose(x[first[2], mil.KINDS + 3], 7 / 64)
    assert np.allclose(x[:, : mil.KINDS].sum(1), [0, 1, 1, 1, 1, 1, 1])


def test_scores_do_not_depend_on_the_batch(spark, labelled):
    model = mil.train([r.text for r in labelled], [r.quality for r in labelled], [r.toxic for r in labelled])
    rows = [(r.doc_id, r.text) for r in labelled[:60]]
    whole = {r.doc_id: r for r in mil.classify(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), model).collect()}
    for r in mil.classify(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(30), model).collect():
        assert r.n_passages == whole[r.doc_id].n_passages and abs(r.quality - whole[r.doc_id].quality) < 1e-4 and abs(r.toxicity - whole[r.doc_id].toxicity) < 1e-4


def test_odd_rows(spark, labelled):
    model = mil.train([r.text for r in labelled[:100]], [r.quality for r in labelled[:100]], [r.toxic for r in labelled[:100]])
    df = odd(spark)
    got = mil.classify(df, model).collect()
    assert len(got) == df.count()
    for r in got:
        assert 0 <= r.top_passage < r.n_passages if r.n_passages else (r.quality, r.toxicity, r.top_passage, r.keep) == (None, None, None, False)
    assert [r.n_passages for r in got if r.doc_id in (2, 3, 5)] == [0, 1, -(-len(LONG.split()) // mil.PASSAGE_WORDS)]
    assert mil.classify(empty(spark), model).collect() == []


def test_fit_on_odd_tables(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (6, 0, 1), (7, 1, 0), (5, None, 0), (77, 1, 1), (2, 1, 1), (3, 0, 0)], "doc_id bigint, quality int, toxic int").select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in ("quality", "toxic")])
    model = mil.fit(docs, labels)
    assert mil.classify(docs, model).count() == docs.count()
    bare = mil.fit(empty(spark), labels.limit(0))
    got = mil.classify(docs, bare).filter("text_ is null" if "text_" in docs.columns else "n_passages > 0").collect()
    assert all(r.quality == 0.5 and r.toxicity == 0.5 for r in got)


def test_query(spark):
    from arborspark.llm.queries import op4_mil

    sf_dir = "/root/testdata/sf0.01"

    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = {r.doc_id: r for r in op4_mil(spark, sf_dir).collect()}
    assert set(got) == {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert np.mean([got[d].keep == (x.quality == 1 and x.toxic == 0) for d, x in labels.items()]) > 0.9
