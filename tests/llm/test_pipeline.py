"""The pipeline against the same stages in plain Python."""

import numpy as np
import pytest
from cases import ROWS, odd
from test_minhash import brute as groups
from test_packing import brute as packed
from test_rules import good

from arborspark.llm import langid, packing

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def plain(model, docs):
    """Rows of run() for (doc_id, text)."""
    kept = []
    for d, t in docs:
        data = np.frombuffer((t or "").lower().encode(), np.uint8)
        labels = langid.label(model, data, np.array([0, len(data)])).labels
        counts = np.bincount(labels, minlength=len(model.labels))[:-1]
        if len(labels) and counts.max() / len(labels) >= 0.5:
            kept.append((d, t))
    kept = [(d, t) for d, t in kept if good(t)]
    gone = {d for d, x in groups(kept).items() if not x[2]}
    lengths = [(d, len(t.split())) for d, t in kept if d not in gone]
    sizes, counts = np.unique([n for _, n in lengths], return_counts=True)
    return packed(lengths, packing.optimal_boundaries(sizes, counts, 8), 65536)


def test_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain(langid.fit(docs), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()), key=repr)
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_the_columns(spark, sf_dir):
    docs = odd(spark, [(d, t, "en" if i % 2 else None, None, None) for i, (d, t) in enumerate(ROWS)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).collect() == []


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "dedup", "packing"] and corpus_pipeline.ORACLE_SQL is None
