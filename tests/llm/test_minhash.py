import random
import re
import time

import numpy as np
from cases import LONG, empty, odd, rows

from arborspark.llm import minhash


def shingles(text, n=2):
    words = [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", text.lower()) if w]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def brute(docs, threshold=0.5):
    """Connected components of all pairs, by union-find over ids."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    known = [(d, t, shingles(t)) for d, t in docs if d is not None and t is not None]
    for i, (a, s, x) in enumerate(known):
        for b, t, y in known[i + 1 :]:
            if a != b and (s == t or (x and y and len(x & y) / len(x | y) >= threshold)):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for d in {d for d, _, _ in known}:
        groups.setdefault(find(d), []).append(d)
    return {d: (g, len(m), d == g) for g, m in groups.items() if len(m) > 1 for d in m}


def found(df):
    return {r.doc_id: (r.group_id, r.group_size, r.is_kept) for r in df.collect()}


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    docs = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(1, 300))]
        docs.append(" ".join(text))
        if i % 4 == 0:
            docs.append(" ".join(text).upper() + "!")
        if i % 5 == 0:
            for _ in range(3):
                docs.append(" ".join(w if rng.random() > 0.04 else rng.choice(words) for w in text))
        if i % 7 == 0 and len(text) > 150:
            docs.append(" ".join(text) + " " + passage)
        if i % 3 == 0 and len(text) > 200:
            docs.append(" ".join(rng.sample(text, len(text))) + " " + passage)
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_against_all_pairs(spark):
    for seed in range(2):
        docs = corpus(seed)
        assert found(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"))) == brute(docs)


def test_pairs_at_the_threshold_with_low_estimates(spark):
    """Pairs of similarity 0.503 whose sketches, by bad luck, estimate 0.31 to 0.38."""
    docs = []
    for seed in (65, 103, 119, 130, 153):
        rng = random.Random(seed)
        shared = [f"s{rng.random()}" for _ in range(203)]
        docs += [" ".join(shared + [f"{c}{rng.random()}" for _ in range(100)]) for c in "ab"]
    want = {d: (d - d % 2, 2, d % 2 == 0) for d in range(10)}
    assert found(minhash.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"))) == want


def test_a_large_group_of_copies(spark):
    """Hundreds of identical and hundreds of slightly different copies, and one passage in many texts of their own."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    docs = [(i, " ".join(base)) for i in range(300)]
    docs += [(1000 + i, " ".join(w if rng.random() > 0.01 else f"z{rng.random()}" for w in base)) for i in range(150)]
    docs += [(2000 + i, " ".join([f"u{i}_{j}" for j in range(200)] + base[:60])) for i in range(40)]
    got = found(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")))
    assert got == {d: (0, 450, d == 0) for d, _ in docs if d < 2000}


def test_odd_rows(spark):
    got = found(minhash.near_duplicates(odd(spark)))
    assert got == {6: (6, 2, True), 7: (6, 2, False)}
    copies = [(1, LONG), (2, LONG + "tail"), (3, ""), (4, ""), (5, "..."), (6, "..."), (7, ". . ."), (8, "one"), (9, "One!"), (None, LONG)]
    assert found(minhash.near_duplicates(odd(spark, copies))) == brute(copies)
    assert minhash.near_duplicates(empty(spark)).collect() == []


def test_dropping_keeps_one_of_each_group(spark):
    df = odd(spark)
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, (r.text or "")[:9]) for r in kept.filter("doc_id is not null").collect()) == [(-9, "ein deuts"), (1, "The quick"), (2, ""), (3, ""), (4, " \n\t "), (5, "word word"), (6, "another t"), (6, "twice the"), (8, "!!! ### ."), (10, "x")]
    assert kept.filter("doc_id is null").count() == 2
    assert minhash.drop_near_duplicates(empty(spark)).collect() == []


def test_dropping_loses_no_text_of_its_own(spark):
    """An id whose one text is a copy keeps its other one; repeated rows stay once, whichever of their columns differ."""
    a, b = "some words that stand twice in here", "a text unlike anything else in the table"
    kept = minhash.drop_near_duplicates(spark.createDataFrame([(1, a, "x"), (9, a, "y"), (9, b, "z"), (5, "x y", "p"), (5, "x y", "p"), (5, "x y", "q")], "doc_id bigint, text string, source string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (5, "x y"), (9, b)]


def test_the_texts_of_an_id_join_their_groups(spark):
    a, b = "some words that stand twice in here", "a text unlike anything else in the table"
    docs = [(1, a), (9, a), (9, b), (4, b), (7, "neither of the two texts above this one")]
    got = found(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")))
    assert got == brute(docs) == {d: (1, 3, d == 1) for d in (1, 4, 9)}


def test_ids_of_other_types(spark):
    docs = [("b", LONG), ("a", LONG + "tail"), ("c", "nothing of the kind")]
    assert found(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id string, text string"))) == {"a": ("a", 2, True), "b": ("a", 2, False)}


def test_short_texts_with_a_common_pair_of_words(spark):
    """Thousands of five-word texts share a pair of words: no two meet for that alone, and the few copies are found."""
    docs = [(i, f"so it a{i} b{i} c{i}") for i in range(8000)] + [(8000 + i, f"so it a{i} b{i} d{i}") for i in range(3)] + [(9000 + i, f"so it a{i} b{i} c{i} d{i}") for i in range(100, 103)]
    began = time.time()
    got = found(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")))
    pairs = [(i, 8000 + i) for i in range(3)] + [(i, 9000 + i) for i in range(100, 103)]
    assert got == {x: (a, 2, x == a) for a, b in pairs for x in (a, b)} and time.time() - began < 60


def test_long_lists_give_the_same(spark, monkeypatch):
    docs = corpus(7)
    monkeypatch.setattr(minhash, "LONG_LIST", 3)
    assert found(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"))) == brute(docs)


def test_sizes_around_powers_of_two(spark):
    """Sets of n and 2n n-grams of which one holds the other have a similarity of just a half."""
    docs = []
    for n in (1, 2, 3, 4, 7, 8, 15, 16, 31, 32, 33, 64, 128):
        words = [f"v{n}_{i}" for i in range(2 * n + 1)]
        docs += [(1000 * n, " ".join(words)), (1000 * n + 1, " ".join(words[: n + 1]))]
    assert found(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"))) == brute(docs)


def test_frequent_pairs_of_words_make_few_candidates(spark, monkeypatch):
    """Texts of few different words share many of their pairs: still hardly any two meet, and the linked ones are found."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    docs = [[rng.choice(words) for _ in range(150)] for _ in range(240)]
    docs += [[w if rng.random() > 0.03 else rng.choice(words) for w in text] for text in docs[:20]]
    docs = [(i, " ".join(text)) for i, text in enumerate(docs)]
    met, across = [], minhash._across
    monkeypatch.setattr(minhash, "_across", lambda *args: met.append(across(*args).count()) or across(*args))
    assert found(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"))) == brute(docs)
    assert sum(met) < len(docs) ** 2 / 2 / 20


def test_bands_agree_as_the_sets_do():
    """In a band a pair agrees with a chance of its similarity cubed; of pairs at the threshold all have two bands in common."""
    rng = np.random.default_rng(3)
    count = minhash.band_count(0.5)
    for shared, similarity in ((200, 0.5), (60, 60 / 540)):
        sets = []
        for _ in range(500):
            common = rng.integers(-(2**63), 2**63 - 1, shared)
            sets += [np.sort(np.concatenate([common, rng.integers(-(2**63), 2**63 - 1, 300 - shared)])) for _ in range(2)]
        keys = minhash.band_keys(np.concatenate(sets), np.arange(1001) * 300, np.arange(1000), count)
        agree = (keys[::2] == keys[1::2]).sum(1)
        assert abs(agree.mean() - count * similarity**3) < 0.1 + 0.05 * count * similarity**3
        assert similarity < 0.5 or agree.min() >= 2


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    parent = list(range(200))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(rows(minhash.components(spark.createDataFrame(pairs, "a bigint, b bigint"))))
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
