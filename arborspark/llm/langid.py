"""Language labels for the words of code-switched text, by a linear-chain conditional random field.

A word's features are its affixes, its byte bigrams and trigrams, and the word itself if the lexicon has it; they are
hashed into one table of weights.  Transitions between neighbours' labels are learned with them.  Forward-backward
over each line gives every word's posterior, and the likeliest label is taken.

Training rows carry one language for a whole text.  Sequences spliced from runs of words of different
languages teach the transitions; words with digits get the label ``other``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.llm.common import chunks, mix, only_ids, span_hashes, string_buffers, word_spans

OTHER = "other"
TABLE = 1 << 16
AFFIXES = 6
_M = np.uint64(TABLE - 1)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # TABLE x labels
    transitions: np.ndarray
    first: np.ndarray
    lexicon: np.ndarray  # sorted hashes of words


def _hash(kind: int, code: np.ndarray) -> np.ndarray:
    return (mix(code.astype(np.uint64) + np.uint64(kind << 40)) & _M).astype(np.int32)


@dataclass
class Features:
    """Places in the table: bigrams and trigrams with the bounds of each word's, affixes and lexicon entry per word."""

    pairs: np.ndarray
    pair_at: np.ndarray
    triples: np.ndarray
    triple_at: np.ndarray
    affixes: np.ndarray
    lexicon: np.ndarray


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray) -> Features:
    sizes = (ends - starts).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(sizes + 2)])
    padded = np.empty(at[-1], np.uint64)
    place = np.arange(at[-1]) - np.repeat(at[:-1], sizes + 2)
    source = np.repeat(starts, sizes + 2) + place - 1
    edge = (place == 0) | (place == np.repeat(sizes + 1, sizes + 2))
    padded[:] = data[np.clip(source, 0, max(len(data) - 1, 0))]
    padded[edge] = 1
    two = padded[:-1] << np.uint64(8) | padded[1:]
    three = two[:-1] << np.uint64(8) | padded[2:]
    in_word = np.ones(len(padded), bool)
    in_word[at[1:] - 1] = False
    pair_at = at[:-1] - np.arange(len(sizes))
    in_triple = in_word.copy()
    in_triple[at[1:] - 2] = False
    triple_at = at[:-1] - 2 * np.arange(len(sizes))
    affix = []
    for n in (2, 3, 4):
        k = np.minimum(sizes, n)
        head, tail = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
        for i in range(n):
            head = head << np.uint64(8) | np.where(i < k, data[np.minimum(starts + i, ends - 1)], 0).astype(np.uint64)
            tail = tail << np.uint64(8) | np.where(i < k, data[np.maximum(ends - 1 - i, starts)], 0).astype(np.uint64)
        affix += [_hash(10 + n, head), _hash(20 + n, tail)]
    spot = np.searchsorted(lexicon, hashes)
    known = (lexicon[np.minimum(spot, len(lexicon) - 1)] == hashes) if len(lexicon) else np.zeros(len(hashes), bool)
    word = np.where(known, _hash(3, hashes & np.uint64(0xFFFFFFFFFF)), _hash(4, np.minimum(sizes, 12)))
    return Features(_hash(1, two[in_word[:-1]]), pair_at, _hash(2, three[in_triple[:-2]]), triple_at, np.stack(affix, 1), word)


def emissions(f: Features, weights: np.ndarray) -> np.ndarray:
    """Each word's score for each label: means over its bigrams and trigrams, sums of the rest."""
    n = len(f.lexicon)
    if not n:
        return np.zeros((0, weights.shape[1]), np.float32)
    pairs = np.add.reduceat(weights[f.pairs], f.pair_at, 0) / np.diff(np.append(f.pair_at, len(f.pairs)))[:, None]
    triples = np.add.reduceat(weights[f.triples], f.triple_at, 0) / np.diff(np.append(f.triple_at, len(f.triples)))[:, None]
    return (4 * pairs + 4 * triples + weights[f.affixes].sum(1) + weights[f.lexicon]).astype(np.float32)


def forward_backward(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, first: np.ndarray, learn: bool = False):
    """(posteriors, expected transitions, log-likelihood's normaliser) of sequences of rows of ``scores``.

    All sequences step together, the longest first, so that a step is one small matrix product.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    top = scores.max(1, keepdims=True) if len(scores) else scores
    x, a = np.exp(scores - top), np.exp(transitions).astype(scores.dtype)
    alpha = np.zeros_like(x)
    z = float(top.sum()) if learn else 0.0
    now = np.zeros((0, x.shape[1]), x.dtype)
    for t in range(longest):
        at = starts[: active[t]] + t
        now = x[at] * (np.exp(first).astype(x.dtype) if t == 0 else now[: active[t]] @ a)
        total = now.sum(1, keepdims=True)
        now = now / total
        alpha[at] = now
        if learn:
            z += float(np.log(total).sum())
    edges = np.zeros(a.shape)
    back = np.zeros((0, x.shape[1]), x.dtype)
    for t in range(longest - 1, -1, -1):
        at = starts[: active[t]] + t
        if len(back) < active[t]:
            back = np.concatenate([back, np.ones((active[t] - len(back), x.shape[1]), x.dtype)])
        weighted = x[at] * back
        post = alpha[at] * back
        if t:
            if learn:
                before = alpha[at - 1]
                edges += (before / ((before @ a) * weighted).sum(1, keepdims=True)).T @ weighted
            back = weighted @ a.T
            back /= back.sum(1, keepdims=True)
        alpha[at] = post / post.sum(1, keepdims=True)
    return alpha, edges * a, z


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = string_buffers(pc.utf8_lower(pa.array(texts, pa.string())))
    return data, *word_spans(data, offsets)


def train(texts: list[str], langs: list[str], sequences: int = 2000, words_each: int = 40, run: int = 12, rounds: int = 80, seed: int = 1) -> Model:
    """Fits a model to texts of known languages."""
    labels = [*sorted(set(langs)), OTHER]
    data, starts, ends, bounds = _words(texts)
    rng = np.random.default_rng(seed)
    by = {lang: [i for i, x in enumerate(langs) if x == lang and bounds[i + 1] > bounds[i]] for lang in labels[:-1]}
    by = {k: v for k, v in by.items() if v}
    if not by:
        return Model(labels, np.zeros((TABLE, len(labels)), np.float32), np.zeros((len(labels),) * 2), np.zeros(len(labels)), np.zeros(0, np.uint64))
    names, token, gold, sizes = list(by), [], [], []
    digits = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 48) & (data <= 57), out=digits[1:])
    numeric = digits[ends] > digits[starts]
    numbers = np.flatnonzero(numeric)
    for _ in range(sequences):
        n, lang = 0, names[rng.integers(len(names))]
        goal = int(rng.integers(3, words_each * 2))
        while n < goal:
            doc = by[lang][rng.integers(len(by[lang]))]
            size = min(int(rng.geometric(1 / run)), goal - n, int(bounds[doc + 1] - bounds[doc]))
            at = int(rng.integers(bounds[doc], bounds[doc + 1] - size + 1))
            token += range(at, at + size)
            gold += [labels.index(lang)] * size
            n += size
            if len(numbers) and n < goal and rng.random() < 0.2:
                token.append(int(numbers[rng.integers(len(numbers))]))
                gold.append(len(labels) - 1)
                n += 1
            lang = names[rng.integers(len(names))]
        sizes.append(n)
    token, gold, sizes = np.array(token), np.array(gold), np.array(sizes)
    gold[numeric[token]] = len(labels) - 1
    hashes = span_hashes(data, starts, ends)
    unique, where, counts = np.unique(hashes[token], return_inverse=True, return_counts=True)
    lexicon = unique[counts >= 3]
    example = np.zeros(len(unique), np.int64)
    example[where] = token
    f = features(data, starts[example], ends[example], unique, lexicon)
    first_at = np.cumsum(sizes) - sizes
    nl = len(labels)
    theta = [np.zeros((TABLE, nl)), np.zeros((nl, nl)), np.zeros(nl)]
    moment, square = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    gold_edges = np.zeros((nl, nl))
    inner = np.ones(len(token), bool)
    inner[first_at] = False
    np.add.at(gold_edges, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    np_pairs = np.diff(np.append(f.pair_at, len(f.pairs)))
    np_triples = np.diff(np.append(f.triple_at, len(f.triples)))
    for step in range(1, rounds + 1):
        scores = emissions(f, theta[0])[where].astype(np.float64)
        post, edges, _ = forward_backward(scores, first_at, sizes, theta[1], theta[2], learn=True)
        delta = -post
        delta[np.arange(len(gold)), gold] += 1
        first = delta[first_at].sum(0) / len(sizes)
        word = np.stack([np.bincount(where, delta[:, k], len(unique)) for k in range(nl)], 1)
        grad = np.zeros_like(theta[0])
        for k in range(nl):
            grad[:, k] += np.bincount(f.pairs, np.repeat(4 * word[:, k] / np_pairs, np_pairs), TABLE)
            grad[:, k] += np.bincount(f.triples, np.repeat(4 * word[:, k] / np_triples, np_triples), TABLE)
            grad[:, k] += np.bincount(f.affixes.ravel(), np.repeat(word[:, k], AFFIXES), TABLE) + np.bincount(f.lexicon, word[:, k], TABLE)
        for i, g in enumerate((grad / len(token) - 1e-6 * theta[0], (gold_edges - edges) / len(token) - 1e-6 * theta[1], first)):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            square[i] = 0.999 * square[i] + 0.001 * g * g
            theta[i] += 0.1 * (moment[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return Model(labels, theta[0].astype(np.float32), theta[1], theta[2], lexicon)


@dataclass
class Labelled:
    """The labels of some rows' words; ``bounds`` has each row's first word, ``line`` each word's line."""

    labels: np.ndarray
    bounds: np.ndarray
    line: np.ndarray


def label(model: Model, data: np.ndarray, offsets: np.ndarray) -> Labelled:
    """Labels the words of lower-cased rows; a row's lines are the sequences."""
    starts, ends, bounds = word_spans(data, offsets)
    if not len(starts):
        return Labelled(np.zeros(0, np.int64), bounds, np.zeros(0, np.int64))
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=breaks[1:])
    line = breaks[starts] + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    hashes = span_hashes(data, starts, ends)
    unique, example, where = np.unique(hashes, return_index=True, return_inverse=True)
    scores = emissions(features(data, starts[example], ends[example], unique, model.lexicon), model.weights)
    new = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    post, _, _ = forward_backward(scores[where], new, np.diff(np.append(new, len(line))), model.transitions, model.first)
    return Labelled(post.argmax(1), bounds, line)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows_per_language: int = 200, **options) -> Model:
    """Trains on at most ``rows_per_language`` rows of each language of ``docs``, those with the smallest hashes of their ids.
    Rows without a language, id or text don't count."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    ids = rows.filter("lang is not null and id is not null").select("id", "lang").withColumn("rank", rank).filter(F.col("rank") <= rows_per_language).select("id")
    found = only_ids(rows.filter("lang is not null and text is not null"), ids.distinct(), "id").select("id", "lang", "text")
    found = sorted(tuple(r) for r in found.collect())
    return train([r[2] for r in found], [r[1] for r in found], **options)


def _summary(model: Model, found: Labelled, min_share: float):
    """(best label, its share, words, switches, accepted) of each row."""
    n, nl = len(found.bounds) - 1, len(model.labels)
    row = np.repeat(np.arange(n), np.diff(found.bounds))
    counts = np.bincount(row * nl + found.labels, minlength=n * nl).reshape(n, nl)
    words = counts.sum(1)
    best = counts[:, : nl - 1].argmax(1) if nl > 1 else np.zeros(n, np.int64)
    share = np.where((words > 0) & (nl > 1), counts[np.arange(n), best] / np.maximum(words, 1), 0.0)
    spoken = np.flatnonzero(found.labels != nl - 1)
    turn = (found.labels[spoken[1:]] != found.labels[spoken[:-1]]) & (row[spoken[1:]] == row[spoken[:-1]])
    switches = np.bincount(row[spoken[1:]][turn], minlength=n)
    return best, share, words, switches, (words > 0) & (share >= min_share) & (share > 0)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", min_share: float = 0.5) -> DataFrame:
    """(doc_id, language, share, n_words, n_switches, accepted, spans) for every row.

    ``spans`` are the runs of equally labelled words: (start, words, label), by word number.  ``language`` is the commonest
    one, ``share`` its share of the words, and a row is accepted from a share of ``min_share``.

    - A null, empty or wordless text has no words, null as its language, share 0 and isn't accepted; a null id stays null.
    - Repeated rows each give a row.  Ties go to the first language by name.  Long texts are labelled whole.
    - A model without languages accepts nothing.  No rows in, no rows out.  Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array(model.labels)
        for batch in batches:
            data, offsets = string_buffers(pc.utf8_lower(batch.column(1)))
            for a, b in chunks(offsets):
                found = label(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                best, share, words, switches, accepted = _summary(model, found, min_share)
                row = np.repeat(np.arange(b - a), np.diff(found.bounds))
                new = np.flatnonzero(np.concatenate([[True], (found.labels[1:] != found.labels[:-1]) | (row[1:] != row[:-1])])) if len(row) else np.zeros(0, np.int64)
                span = pa.StructArray.from_arrays([pa.array((new - found.bounds[row[new]]).astype(np.int32)), pa.array(np.diff(np.append(new, len(row))).astype(np.int32)), names.take(pa.array(found.labels[new]))], ["start", "words", "label"])
                at = np.searchsorted(row[new], np.arange(b - a + 1)).astype(np.int32)
                language = names.take(pa.array(best, mask=share <= 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), language, pa.array(share), pa.array(words.astype(np.int32)), pa.array(switches.astype(np.int32)), pa.array(accepted), pa.ListArray.from_arrays(pa.array(at), span)],
                    ["doc_id", "language", "share", "n_words", "n_switches", "accepted", "spans"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, language string, share double, n_words int, n_switches int, accepted boolean, spans array<struct<start:int,words:int,label:string>>")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", min_share: float = 0.5) -> DataFrame:
    """The rows that ``identify`` accepts, with all their columns, in one pass."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = string_buffers(pc.utf8_lower(batch.column(place)))
            for a, b in chunks(offsets):
                found = label(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield batch.slice(a, b - a).filter(pa.array(_summary(model, found, min_share)[-1]))

    return docs.mapInArrow(run, docs.schema)
