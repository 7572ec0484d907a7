"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage is encoded: its counts of kinds of
characters, word statistics and the mean and greatest log-odds of its words and of their beginnings, then a learned tanh layer.  Gated attention
weights, learned from document labels alone, average the passages, and a logistic layer scores the average.  One
such head judges quality, another toxicity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborspark.llm.common import chunks, only_ids, running_sum, span_hashes, string_buffers, word_spans

PASSAGE_WORDS = 64
ODDS = 1 << 19
#: Bytes of a word's beginning, each with log-odds of its own; 0 stands for the whole word.
PREFIXES = (0, 4, 5, 6)
#: A word counts as a mark of toxicity if it or a beginning of it has greater log-odds.
MARK = 1.5
#: Kinds of bytes: other, upper case, lower case, digit, blank, line end, symbols, bar, exclamation, stops, other ASCII punctuation, not ASCII.
KINDS = 12
_KIND = np.zeros(256, np.int64)
for _kind, _bytes in enumerate((b"", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b" \t", b"\n\r", b"#$%&*", b"|", b"!", b".,;:?", b"\"'()+-/<=>@[\\]^_`{}~", bytes(range(128, 256)))):
    _KIND[list(_bytes)] = _kind
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
WIDTH = KINDS + 8 + 3 * (len(PREFIXES) - 1)


@dataclass
class Head:
    w1: np.ndarray
    b1: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: np.ndarray

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w1 + self.b1)

    def attend(self, h: np.ndarray, at: np.ndarray, bag: np.ndarray) -> np.ndarray:
        """Each passage's weight in its bag; ``at`` has each bag's first passage, ``bag`` each passage's bag."""
        s = (np.tanh(h @ self.v) / (1 + np.exp(-(h @ self.u)))) @ self.w
        e = np.exp(s - np.maximum.reduceat(s, at)[bag])
        return e / np.add.reduceat(e, at)[bag]

    def score(self, x: np.ndarray, at: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(each bag's probability, each passage's weight)."""
        h = self.encode(x)
        a = self.attend(h, at, bag)
        return 1 / (1 + np.exp(-np.clip(np.add.reduceat(a[:, None] * h, at, 0) @ self.c + self.b, -30, 30))), a


@dataclass
class Model:
    odds: np.ndarray  # ODDS x (quality, toxic): log-odds of hashed words
    mean: np.ndarray
    spread: np.ndarray
    quality: Head | None  # None: no two classes to learn from, then the prior
    toxic: Head | None
    prior: tuple[float, float]


def _places(fold: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each of ``PREFIXES``, the words' places in the table of odds."""
    total, out = running_sum(fold), []
    for n in PREFIXES:
        h = span_hashes(fold, starts, np.minimum(ends, starts + n) if n else ends, total)
        out.append(((h >> np.uint64(7 * n)) & np.uint64(ODDS - 1)).astype(np.int64))
    return out


def passages(data: np.ndarray, offsets: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, each row's first passage): every row has one passage at least, all its bytes are in some passage."""
    fold = _FOLD[data]
    starts, ends, bounds = word_spans(fold, offsets)
    words = np.diff(bounds)
    count = np.maximum(1, -(-words // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(count)])
    n = int(first[-1])
    row = np.repeat(np.arange(len(words)), count)
    nth = np.arange(n) - first[row]
    begin = bounds[row] + nth * PASSAGE_WORDS
    # a row's first passage begins with the row, a later one with its first word
    byte = np.where(nth == 0, offsets[row], starts[np.minimum(begin, len(starts) - 1)] if len(starts) else 0)
    size = np.diff(np.append(byte, len(data)))
    kinds = np.bincount(np.repeat(np.arange(n) * KINDS, size) + _KIND[data], minlength=n * KINDS).reshape(n, KINDS)
    in_passage = np.minimum(bounds[row + 1], begin + PASSAGE_WORDS) - begin
    x = np.zeros((n, WIDTH), np.float32)
    x[:, :KINDS] = kinds / np.maximum(1, size)[:, None]
    x[:, KINDS] = np.log1p(in_passage)
    if len(starts):
        p = np.repeat(np.arange(n), in_passage)
        h = span_hashes(fold, starts, ends)
        per = np.maximum(1, in_passage)
        x[:, KINDS + 1] = np.bincount(p, ends - starts, n) / per
        same = (h[1:] == h[:-1]) & (p[1:] == p[:-1])
        x[:, KINDS + 2] = np.bincount(p[1:][same], minlength=n) / per
        key = np.sort(h >> np.uint64(24) | p.astype(np.uint64) << np.uint64(40))
        distinct = key[np.concatenate([[True], key[1:] != key[:-1]])] >> np.uint64(40)
        x[:, KINDS + 3] = np.bincount(distinct.astype(np.int64), minlength=n) / per
        some = np.flatnonzero(in_passage > 0)
        for k, place in enumerate(_places(fold, starts, ends)):
            value = odds[place]
            if not k:
                x[some, KINDS + 4 : KINDS + 6] = np.add.reduceat(value, begin[some], 0) / in_passage[some, None]
                x[some, KINDS + 6] = np.minimum.reduceat(value[:, 0], begin[some])
                x[some, KINDS + 7] = np.maximum.reduceat(value[:, 1], begin[some])
                continue
            at, toxic = KINDS + 5 + 3 * k, np.ascontiguousarray(value[:, 1])
            x[some, at] = np.add.reduceat(toxic, begin[some]) / in_passage[some]
            x[some, at + 1] = np.maximum.reduceat(toxic, begin[some])
            x[some, at + 2] = np.log1p(np.add.reduceat((toxic > MARK).astype(np.float32), begin[some]))
    return x, first


def word_odds(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, folds: np.ndarray, n_folds: int, least: int = 4) -> list[np.ndarray]:
    """Smoothed log-odds of each hashed word's or beginning's presence for each label column; 0 for those in fewer than ``least`` rows.

    The first table is over all rows, table 1 + f over the rows outside fold f.
    """
    fold = _FOLD[data]
    starts, ends, bounds = word_spans(fold, offsets)
    rows = np.repeat(np.arange(len(labels)), np.diff(bounds))
    sums = np.zeros((n_folds, 3, ODDS), np.float32)
    for place in _places(fold, starts, ends):
        pair = np.unique(rows * ODDS + place)
        row, place = pair // ODDS, pair % ODDS
        for f in range(n_folds):
            mine = folds[row] == f
            for k, weight in enumerate((None, labels[row, 0], labels[row, 1])):
                sums[f, k] += np.bincount(place[mine], None if weight is None else weight[mine], ODDS)
    out = []
    for f in range(-1, n_folds):
        use = [g for g in range(n_folds) if g != f]
        seen, y = sums[use, 0].sum(0), labels[folds != f]
        odds = np.zeros((ODDS, 2), np.float32)
        for k in range(2):
            yes = sums[use, k + 1].sum(0)
            odds[:, k] = np.log((yes + 0.5) / (y[:, k].sum() + 1)) - np.log((seen - yes + 0.5) / (len(y) - y[:, k].sum() + 1))
        odds[seen < least] = 0
        out.append(odds)
    return out


def loss_and_gradients(theta: list[np.ndarray], x: np.ndarray, at: np.ndarray, bag: np.ndarray, y: np.ndarray, decay: float = 1e-5) -> tuple[float, list[np.ndarray]]:
    """The bags' mean logistic loss, with a penalty on the first and the last layer's weights, and its gradient for each parameter."""
    w1, b1, v, u, w, c, b = theta
    h = np.tanh(x @ w1 + b1)
    tv, su = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
    s = (tv * su) @ w
    e = np.exp(s - np.maximum.reduceat(s, at)[bag])
    a = e / np.add.reduceat(e, at)[bag]
    m = np.add.reduceat(a[:, None] * h, at, 0)
    z = np.clip(m @ c + b, -30, 30)
    p = 1 / (1 + np.exp(-z))
    loss = float((np.logaddexp(0, z) - y * z).mean() + decay / 2 * ((w1**2).sum() + (c**2).sum()))
    d = (p - y) / len(y)
    dm = (d[:, None] * c)[bag]
    da = (dm * h).sum(1)
    ds = a * (da - np.add.reduceat(a * da, at)[bag])
    dg = ds[:, None] * w
    dv, du = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
    dz = (a[:, None] * dm + dv @ v.T + du @ u.T) * (1 - h**2)
    return loss, [x.T @ dz + decay * w1, dz.sum(0), h.T @ dv, h.T @ du, (tv * su).T @ ds, m.T @ d + decay * c, d.sum()]


def fit_head(x: np.ndarray, first: np.ndarray, y: np.ndarray, hidden: int = 16, gate: int = 8, rounds: int = 300, seed: int = 1) -> Head | None:
    """Gradient descent (Adam) on the bags' logistic loss."""
    if not 0 < y.sum() < len(y):
        return None
    rng = np.random.default_rng(seed)
    shape = [(x.shape[1], hidden), (hidden,), (hidden, gate), (hidden, gate), (gate,), (hidden,), ()]
    theta = [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or i == 4 else np.zeros(s) for i, s in enumerate(shape)]
    theta[5] = rng.normal(0, 0.3, hidden)
    moment, square = [np.zeros(s) for s in shape], [np.zeros(s) for s in shape]
    at, bag = first[:-1], np.repeat(np.arange(len(y)), np.diff(first))
    x = x.astype(np.float64)
    for step in range(1, rounds + 1):
        for i, g in enumerate(loss_and_gradients(theta, x, at, bag, y)[1]):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            square[i] = 0.999 * square[i] + 0.001 * g * g
            theta[i] = theta[i] - 0.02 * (moment[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return Head(*(np.asarray(p, np.float32) for p in theta))


def train(texts: list[str], quality: list[int], toxic: list[int], n_folds: int = 4, **options) -> Model:
    """The heads see each row with odds from the other folds' rows, so that they see odds as new rows have them."""
    y = np.array([quality, toxic], np.float64).T.reshape(-1, 2)
    folds = np.arange(len(texts)) % n_folds
    odds = word_odds(*string_buffers(pa.array(texts, pa.string())), y, folds, n_folds)
    parts, sizes = [], []
    for f in range(n_folds):
        x, first = passages(*string_buffers(pa.array(texts[f::n_folds], pa.string())), odds[f + 1])
        parts.append(x)
        sizes.append(np.diff(first))
    x, first = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    y = np.concatenate([y[f::n_folds] for f in range(n_folds)])
    mean, spread = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    scaled = (x - mean) / spread
    heads = [fit_head(scaled, first, y[:, k], **options) if len(x) else None for k in range(2)]
    prior = tuple(float((y[:, k].sum() + 0.5) / (len(y) + 1)) for k in range(2))
    return Model(odds[0], mean.astype(np.float32), spread.astype(np.float32), *heads, prior)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 4000) -> Model:
    """Trains on at most ``sample_rows`` labelled rows, those with the smallest hashes of their ids; rows without an id, a text or a
    label don't count, and of several labels of an id the smallest quality and the greatest toxicity do."""
    marks = labels.select(F.col(id_col).alias("id"), "quality", "toxic").dropna().groupBy("id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    marks = {r[0]: (r[1], r[2]) for r in marks.collect()}
    spark = docs.sparkSession
    ids = spark.createDataFrame([(k,) for k in marks], f"id {docs.schema[id_col].dataType.simpleString()}")
    rows = only_ids(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null"), ids, "id").collect()
    rows = sorted({(r[0], r[1]) for r in rows})
    return train([t for _, t in rows], [marks[i][0] for i, _ in rows], [marks[i][1] for i, _ in rows])


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least_quality: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """(doc_id, quality, toxicity, n_passages, top_passage, keep) for every row.

    ``top_passage`` is the passage with the greatest attention weight of the toxicity head, ``keep`` says that quality reaches
    ``least_quality`` and toxicity stays below ``most_toxic``.

    - A null text has null scores, no passages and isn't kept; an empty one is one empty passage, scored like any other.
    - A null id stays null; repeated rows each give a row; ties of attention go to the earlier passage.
    - No rows in, no rows out.  Other columns are ignored, whatever their names.  Long texts are read whole.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            missing = np.array(batch.column(1).is_null())
            data, offsets = string_buffers(batch.column(1))
            for a, b in chunks(offsets):
                x, first = passages(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], model.odds)
                x = (x - model.mean) / model.spread
                at, bag = first[:-1], np.repeat(np.arange(b - a), np.diff(first))
                out, weight = [], np.zeros(len(x), np.float32)
                for head, prior in zip((model.quality, model.toxic), model.prior, strict=True):
                    p, weight = head.score(x, at, bag) if head is not None else (np.full(b - a, prior), np.zeros(len(x), np.float32))
                    out.append(p.astype(np.float64))
                best = np.lexsort((np.arange(len(x)), -weight, bag))[at] - at
                none = missing[a:b]
                n = np.where(none, 0, np.diff(first)).astype(np.int32)
                keep = ~none & (out[0] >= least_quality) & (out[1] < most_toxic)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(p, mask=none) for p in out), pa.array(n), pa.array(best.astype(np.int32), mask=none), pa.array(keep)], ["doc_id", "quality", "toxicity", "n_passages", "top_passage", "keep"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, quality double, toxicity double, n_passages int, top_passage int, keep boolean")
