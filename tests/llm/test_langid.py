import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from cases import LONG, empty, odd

from arborspark.llm import langid


@pytest.fixture(scope="module")
def split(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text").collect())
    return [r for r in rows if r[0] % 2 == 0], [r for r in rows if r[0] % 2]


@pytest.fixture(scope="module")
def model(split):
    by = {}
    for r in split[0]:
        by.setdefault(r[1], []).append(r)
    rows = [r for v in by.values() for r in v[:100]]
    return langid.train([r[2] for r in rows], [r[1] for r in rows])


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    nl, sizes = 3, np.array([4, 1, 3, 5])
    scores, trans, first = rng.normal(size=(sizes.sum(), nl)), rng.normal(size=(nl, nl)), rng.normal(size=nl)
    starts = np.cumsum(sizes) - sizes
    post, edges, z = langid.forward_backward(scores, starts, sizes, trans, first, learn=True)
    want, want_edges, want_z = np.zeros_like(scores), np.zeros((nl, nl)), 0.0
    for s, n in zip(starts, sizes):
        weights = {}
        for path in itertools.product(range(nl), repeat=int(n)):
            weights[path] = np.exp(first[path[0]] + sum(scores[s + i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        total = sum(weights.values())
        want_z += np.log(total)
        for path, w in weights.items():
            for i, y in enumerate(path):
                want[s + i, y] += w / total
            for a, b in zip(path, path[1:]):
                want_edges[a, b] += w / total
    assert np.allclose(post, want) and np.allclose(edges, want_edges) and np.isclose(z, want_z)


def test_code_switched_text_held_out(spark, split, model):
    """Runs of words of the held-out half, spliced; most words get their own language."""
    rng, by = random.Random(3), {}
    for _, lang, text in split[1]:
        if text.count("|") < 3 and sum(c.isalpha() for c in text) > 0.7 * len(text):
            by.setdefault(lang, []).extend([w for w in text.lower().split() if w.strip(".,").isalpha()])
    texts, gold = [], []
    for _ in range(150):
        words, labels = [], []
        for _ in range(4):
            lang = rng.choice(sorted(by))
            at, n = rng.randrange(len(by[lang]) - 20), rng.randint(5, 15)
            words += by[lang][at : at + n]
            labels += [lang] * n
        texts.append(" ".join(words))
        gold.append(labels)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    right = total = 0
    for r in langid.identify(df, model).collect():
        labels = [s.label for s in r.spans for _ in range(s.words)]
        assert len(labels) == len(gold[r.doc_id]) == r.n_words
        right += sum(a == b for a, b in zip(labels, gold[r.doc_id]))
        total += len(labels)
    assert right / total > 0.93


def test_whole_texts_held_out(spark, split, model):
    df = spark.createDataFrame([(d, t) for d, _, t in split[1]], "doc_id bigint, text string")
    lang = {d: x for d, x, _ in split[1]}
    got = langid.identify(df, model).collect()
    assert np.mean([r.language == lang[r.doc_id] for r in got]) > 0.97
    assert np.mean([r.accepted for r in got]) > 0.97


def test_rows_do_not_depend_on_their_batch(spark, split, model):
    rows = [(d, t) for d, _, t in split[1][:80]]
    whole = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), model).collect()}
    for d, t in rows[:25]:
        alone = langid.label(model, *_buffers(t))
        names = [model.labels[i] for i in alone.labels]
        assert names == [s.label for s in whole[d].spans for _ in range(s.words)]


def _buffers(text):
    data = np.frombuffer(text.lower().encode(), np.uint8)
    return data, np.array([0, len(data)])


def test_odd_rows(spark, model):
    df = odd(spark)
    got = langid.identify(df, model).collect()
    assert len(got) == df.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for d in (2, 3, 4, 8):
        assert [(r.language, r.share, r.n_words, r.accepted, r.spans) for r in by[d]] == [(None, 0.0, 0, False, [])]
    assert by[5][0].n_words == len(LONG.split()) and len(by[6]) == 3
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r.doc_id) for r in got if r.accepted)
    assert langid.identify(empty(spark), model).collect() == [] and langid.keep_identified(empty(spark), model).collect() == []


def test_fit_on_odd_tables(spark):
    rows = [(1, "en", "the words"), (2, None, "no language"), (None, "de", "keine Nummer"), (3, "fr", None), (4, "fr", ""), (5, "de", "ein Satz")]
    df = odd(spark, rows, "doc_id bigint, lang string, text string")
    fitted = langid.fit(df)
    assert fitted.labels == ["de", "en", "fr", "other"]
    assert langid.identify(df, fitted).count() == 6
    bare = langid.fit(empty(spark, "doc_id bigint, lang string, text string"))
    assert not any(r.accepted for r in langid.identify(df, bare).collect())
    assert isinstance(pa.array([1]), pa.Array)


def test_query(spark, sf_dir):
    from arborspark.llm.queries import op3_langid

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op3_langid(spark, sf_dir).collect()
    assert len(got) == len(docs) and np.mean([r.language == docs[r.doc_id].lang for r in got]) > 0.95
    for r in got:
        at = 0
        for s in r.spans:
            assert s.start == at
            at += s.words
        assert at == r.n_words
