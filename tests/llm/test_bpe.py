import random

import pytest
from cases import LONG, empty, odd

from arborspark.llm import bpe


@pytest.fixture(scope="module")
def model():
    return bpe._bpe(bpe.VOCABULARY)


def slow(model, data):
    """Merges the pair of lowest rank, leftmost first, until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        best = min(((model.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
        if best[0] == 1 << 30:
            return [model.ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def texts():
    rng = random.Random(7)
    words = "the of and aaaa ab ba  \n é ü 😀 123 xyz -- unsplit".split(" ")
    return ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(1, 120))) for _ in range(40)] + ["a" * 300, "ab" * 100, " " * 77]


def test_joining_is_exact(model):
    for text in texts():
        data = text.encode()
        want = slow(model, data)
        assert model.encode_piece(data) == want
        for leaf in (1, 2, 5, 16):
            assert model.encode(data, leaf) == want
        parts = [data[i : i + 7] for i in range(0, len(data), 7)]
        assert model.join_all([model.encode_piece(p) for p in parts]) == want
        assert model.decode(want) == data


def test_rows_and_segments(spark, model):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for segment in (10, 64, 1 << 16):
        got = {r.doc_id: r.tokens for r in bpe.encode(df, segment_chars=segment).collect()}
        assert got == {i: model.encode_piece(t.encode()) for i, t in rows}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, segment_chars=50)).collect()}
    assert back == dict(rows)


def test_odd_rows(spark, model):
    df = odd(spark)
    got = bpe.encode(df, segment_chars=50_000)
    want = sorted(((r.doc_id, None if r.text is None else len(x := model.encode_piece(r.text.encode())), None if r.text is None else x) for r in df.select("doc_id", "text").collect()), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sorted((tuple(r) for r in bpe.decode(got).collect()), key=repr) == sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=repr)
    assert bpe.encode(empty(spark)).collect() == [] and len(LONG) > 50_000


def test_bytes_that_are_no_text(spark):
    df = spark.createDataFrame([(1, [bpe._bpe(bpe.VOCABULARY).ranks[b"\xff"]]), (2, []), (3, None)], "doc_id bigint, tokens array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(df).collect()} == {1: "�", 2: "", 3: None}


def test_query_round_trip(spark, sf_dir, model):
    from arborspark.llm.queries import op10_bpe

    got = {r.doc_id: r.tokens for r in op10_bpe(spark, sf_dir).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert got == {d: model.encode_piece(t.encode()) for d, t in docs.items()}
    assert all(model.decode(t).decode() == docs[d] for d, t in got.items())
