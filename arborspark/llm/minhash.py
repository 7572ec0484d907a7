"""MinHash near-duplicates with bottom-k sketches from one hash function.

1. Every text becomes the set of its hashed word n-grams; its ``k`` smallest hashes are its sketch.
2. Candidates come from inverted lists of two kinds.
   a. Pairs of which one set is whole in its sketch meet in lists of retained values.  A pair at the threshold shares
      at least o = ``min(threshold * size, (threshold - slack) * k)`` values, so among the rarest ``size - o + c``
      values of each sketch the two share c: only these are indexed, and fewer overlaps don't make a candidate.  Where
      both sketches are whole sets nothing is lost; where one isn't, about 32 of its 64 values are shared, by chance
      20 at least.
   b. Pairs of larger sets meet in bands: keys of three minima each, every minimum by a hash function of its own.  Two
      of the bands have to agree.  A pair of similarity s agrees in a band with a chance of s cubed, so texts that
      have no more in common than a passage or frequent pairs of words hardly meet, however many they are; there are
      so many bands that a pair just at the threshold is missed with a chance of ``MISS`` at most.
3. The sketch of the union (the ``k`` smallest of both) estimates the Jaccard similarity and filters.
4. The exact Jaccard similarity of the full n-gram sets verifies.

Texts in one group of verified links form connected components.  Identical texts are joined first, by digest.  Each list
links its members to the first one of their size class (the binary logarithm of the sets' sizes); only where that leaves
several components in a list are pairs between these compared.  The result equals comparing all pairs of every list,
without work that is quadratic in the size of a group of copies.  No step gathers a long list or a group in one
task: their counts and minima are partial aggregates that are joined back.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.llm.common import chunks, cut, discard, mix, release, shared_table, small, span_hashes, string_buffers, word_spans

#: Members from which on a list of texts is never handled by one task.
LONG_LIST = 4096
#: Minima in a band, and the greatest chance that fewer than two bands of a pair just at the threshold agree.
BAND_ROWS, MISS = 3, 2.5e-5

#: Lists of bands have numbers from here on; below are those of values.
BAND = 1 << 40

_ODD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each row's distinct word n-gram hashes in ascending order.

    A row of 1 to n - 1 words has one shingle, made of all its words; a row without words has none.
    """
    starts, ends, bounds = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    sizes = np.diff(bounds)
    parts, rows = [], []
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    if len(words) >= n:
        h = np.zeros(len(words) - n + 1, np.uint64)
        for i in range(n):
            h += words[i : i + len(h)] * _ODD[i % 5]
            mix(h)
        whole = row_of[: len(h)] == row_of[n - 1 :]
        parts.append(h[whole])
        rows.append(row_of[: len(h)][whole])
    for row in np.flatnonzero((sizes > 0) & (sizes < n)):
        h = np.full(1, sizes[row], np.uint64)
        for i in range(bounds[row], bounds[row + 1]):
            h += words[i : i + 1] * _ODD[0]
            mix(h)
        parts.append(h)
        rows.append(np.full(1, row))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(len(sizes) + 1, np.int64)
    values, rows = np.concatenate(parts).view(np.int64), np.concatenate(rows)
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[new], rows[new]
    return values, np.searchsorted(rows, np.arange(len(sizes) + 1))


def band_count(threshold: float, miss: float = MISS) -> int:
    """The least number of bands of which a pair at the threshold has two in common, but for a chance of ``miss``."""
    p, count = threshold**BAND_ROWS, 2
    while (1 - p) ** count + count * p * (1 - p) ** (count - 1) > miss:
        count += 1
    return count


def band_keys(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """``count`` 32-bit keys for each of ``rows``, whose sets must not be empty."""
    if not len(rows):
        return np.zeros((0, count), np.int32)
    sizes = bounds[rows + 1] - bounds[rows]
    ends = np.cumsum(sizes)
    x = values[np.arange(ends[-1]) + np.repeat(bounds[rows] - (ends - sizes), sizes)].astype(np.uint32)
    factors = mix(np.arange(1, count * BAND_ROWS + 1, dtype=np.uint64) * _ODD[1]).astype(np.uint32) | np.uint32(1)
    keys = np.empty((len(rows), count), np.int32)
    for band in range(count):
        h = np.zeros(len(rows), np.uint64)
        for factor in factors[band * BAND_ROWS : (band + 1) * BAND_ROWS]:
            h += np.minimum.reduceat(x * factor, ends - sizes) * _ODD[2]
            mix(h)
        keys[:, band] = h.astype(np.uint32).view(np.int32)
    return keys


def _chunked(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    for batch in batches:
        data, offsets = string_buffers(batch.column(1))
        for a, b in chunks(offsets):
            part = data[offsets[a] : offsets[b]]
            local = offsets[a : b + 1] - offsets[a]
            yield batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a) if batch.num_columns > 2 else None, *shingle_sets(part, local, n)


def _sketches(df: DataFrame, n: int, k: int, count: int, banded: int) -> DataFrame:
    """(doc_id, digest, size, sketch, bands) of (doc_id, lower-cased text, digest); sets of less than ``banded`` n-grams have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, digest, values, bounds in _chunked(batches, n):
            size = np.diff(bounds)
            kept = np.minimum(size, k)
            ends = np.concatenate([[0], np.cumsum(kept)])
            take = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], kept)
            sketch = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[take]))
            keys = band_keys(values, bounds, np.flatnonzero(size >= banded), count)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((size >= banded) * count)]).astype(np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([ids, digest, pa.array(size.astype(np.int32)), sketch, bands], ["doc_id", "digest", "size", "sketch", "bands"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, digest binary, size int, sketch array<bigint>, bands array<int>")


def _shingles(df: DataFrame, n: int) -> DataFrame:
    """(t, shingles) of (t, lower-cased text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, values, bounds in _chunked(batches, n):
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))], ["t", "shingles"])

    return df.mapInArrow(run, "t bigint, shingles array<bigint>")


def union_estimate(a: Column, b: Column, k: int) -> Column:
    """The Jaccard similarity as the sketch of the union tells it, from two sketches."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    shared = F.array_intersect(a, b)
    return F.size(F.array_intersect(union, shared)) / F.size(union)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components of edges (a, b), named by their smallest node.

    Alternates large-star and small-star steps; each halves distances, and each round is checkpointed.
    Edges with a null end, loops and repeated edges count for nothing.  Empty edges give an empty result.
    """
    edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        low = large.join(large.groupBy("b").agg(F.min("a").alias("m")), "b")
        small = low.select(F.col("m").alias("a"), F.col("b")).union(low.filter("a <> m").select("m", F.col("a").alias("b"))).distinct()
        edges = cut(small)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, lower) of the rows with an id and a text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")
    return rows.select("doc_id", F.unhex(F.md5("text")).alias("digest"), F.lower("text").alias("lower"))


def _pairs(x: DataFrame, y: DataFrame, on: list[str], threshold: float, whole: int) -> DataFrame:
    """(a, b, k): texts of a list that are in different components and whose sizes fit; k is the smaller one's class.

    Lists of values are for pairs of which the smaller one's class is below ``whole``.

    Of any two texts in different components, one at least is outside the list's largest one (x).  Where both are, the
    pair meets twice in the join and counts once.
    """
    x = x.select(*on, F.col("t").alias("x"), F.col("b").alias("bx"), F.col("c").alias("cx"), F.col("size").alias("nx"))
    y = y.select(*on, F.col("t").alias("y"), F.col("b").alias("by"), F.col("c").alias("cy"), F.col("size").alias("ny"), "big")
    fits = F.least("nx", "ny") >= F.lit(threshold) * F.greatest("nx", "ny")
    met = x.join(y, on).filter("cx <> cy and (cy = big or x < y)").filter(fits).filter((F.col("v") >= BAND) | (F.least("bx", "by") < whole))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.least("bx", "by").alias("k"), *on)


def _across(member: DataFrame, threshold: float, whole: int) -> DataFrame:
    """(a, b, k) once for each short list in which they meet; all of it with one shuffle by the list's value."""
    w = W.partitionBy("v")
    member = member.select("v", "t", "b", "size", "c").withColumn("n", F.count(F.lit(1)).over(W.partitionBy("v", "c")))
    member = member.withColumn("lo", F.min("c").over(w)).withColumn("hi", F.max("c").over(w)).withColumn("big", F.max(F.struct("n", "c")).over(w)["c"]).filter("lo <> hi")
    return _pairs(member.filter("c <> big"), member, ["v"], threshold, whole).select("a", "b", "k")


def _across_long(member: DataFrame, threshold: float, whole: int) -> DataFrame:
    """The same for long lists, which are cut into one for each size class: list k has the texts of class k and those that are not too large for them."""
    reach = F.explode(F.sequence(F.col("b") - max(1, ceil(log2(1 / threshold) - 1e-9)), F.col("b"))).alias("list")
    member = member.select("v", "t", "b", "size", "c", reach)
    each = member.groupBy("v", "list", "c").agg(F.count(F.lit(1)).alias("n"))
    lists = each.groupBy("v", "list").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.struct("n", "c"))["c"].alias("big")).filter("lo <> hi").select("v", "list", "big")
    member = member.join(lists, ["v", "list"])
    return _pairs(member.filter("c <> big"), member, ["v", "list"], threshold, whole).filter("list = k").select("a", "b", "k")


def text_groups(docs: DataFrame, n: int = 2, k: int = 64, threshold: float = 0.5, slack: float = 0.2, common: int = 4) -> DataFrame:
    """(digest, c): the component of every different text of (doc_id, digest, lower); a text without links is one of its own."""
    floor = threshold - slack
    # sets of this class or a higher one have bands, and meet each other in no list of values
    whole = k.bit_length() - 1
    rows = _sketches(docs.select("doc_id", "lower", "digest"), n, k, band_count(threshold), 1 << whole).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("size", "sketch", "bands")])
    texts = shared_table(rows.select(F.monotonically_increasing_id().alias("t"), "digest", "doc_id", "size", "sketch", "bands"), "sketches")
    sketches = texts.filter("size > 0").select("t", "size", "sketch")

    # o values at least are shared: of sets that are whole in their sketches, as many as the threshold asks for
    shared_least = lambda m: min(ceil(threshold * m - 1e-9), ceil(floor * k - 1e-9))
    # how many values of their prefixes a pair shares, by the size class of the smaller set
    classes = [max(1, min(common, shared_least(min(1 << b, k)) // 3)) for b in range(k.bit_length())]
    by_class = lambda counts, b: F.array(*[F.lit(c) for c in counts])[F.least(b, F.lit(whole))]
    # how many lists of its kind a pair has in common: of bands two
    least = lambda b: by_class([*classes[:whole], 2], b)
    # 40 bits of a hash are enough for a list: two values in one only make more candidates
    valued = sketches.filter(F.lit(threshold) * F.col("size") < 1 << whole)
    values = valued.select("t", F.explode(F.array_distinct(F.transform("sketch", lambda x: x.bitwiseAND((1 << 40) - 1)))).alias("v"))
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    per_text = values.join(counts, "v").groupBy("t").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("values"))
    b, m = F.length(F.bin("size")) - 1, F.least("size", F.lit(k))
    # values that no other text retains are the rarest: they stand first and take up places
    place = m - F.array(*[F.lit(shared_least(i)) for i in range(k + 1)])[m] + by_class(classes, b) - (m - F.size("values"))
    placed = per_text.join(valued.select("t", "size"), "t").select("t", "size", F.explode(F.slice("values", 1, F.greatest(place, F.lit(0)))).alias("x")).select("t", "size", "x.v", "x.df")
    # one shuffle for the bands, which most texts share with no other; a list is counted as it streams by
    bands = texts.select("t", "size", F.posexplode("bands").alias("band", "key"))
    bands = bands.select("t", "size", (F.shiftleft(F.col("band").cast("bigint"), 32) + F.col("key") + F.lit((1 << 31) + BAND)).alias("v")).repartition("v")
    bands = bands.join(bands.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "v").select("t", "size", "v", "df")
    index = shared_table(placed.union(bands).select("t", b.alias("b"), "size", "v", (F.col("df") > LONG_LIST).alias("long")), "index")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked."""
        near = sketches.select(F.col("t").alias("a"), F.col("sketch").alias("sa"))
        far = sketches.select(F.col("t").alias("b"), F.col("sketch").alias("sb"))
        estimated = cut(pairs.join(near, "a").join(far, "b").filter(union_estimate(F.col("sa"), F.col("sb"), k) >= floor).select("a", "b").distinct())
        release(docs.sparkSession)
        ids = estimated.select(F.col("a").alias("t")).union(estimated.select("b")).distinct().join(texts.select("t", "doc_id", "digest"), "t")
        sets = shared_table(_shingles(docs.join(small(ids), ["doc_id", "digest"]).select("t", "lower"), n), "shingles")
        if sets.count() > ids.count():  # rows that repeat an id and a text
            repeated, sets = sets, shared_table(sets.groupBy("t").agg(F.first("shingles").alias("shingles")), "shingles")
            discard(repeated)
        left = sets.select(F.col("t").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("t").alias("b"), F.col("shingles").alias("sb"))
        shared = F.size(F.array_intersect("sa", "sb"))
        jaccard = shared / (F.size("sa") + F.size("sb") - shared)
        links = cut(estimated.join(left, "a").join(right, "b").filter(jaccard >= threshold).select("a", "b").distinct())
        discard(sets)
        return links

    # short lists fit a task, which finds their aggregates by windows; those of long ones are partial aggregates, joined back
    short, long = (index.filter(c).filter((F.col("v") >= BAND) | (F.col("b") < whole)).select("t", "b", "v") for c in ("not long", "long"))
    firsts = short.withColumn("first", F.min("t").over(W.partitionBy("v", "b")))
    firsts = firsts.union(long.join(long.groupBy("v", "b").agg(F.min("t").alias("first")), ["v", "b"]).select(firsts.columns))
    spokes = firsts.filter("first < t").groupBy(F.col("first").alias("a"), F.col("t").alias("b"), F.col("b").alias("k")).count()
    star = cut(spokes.filter(F.col("count") >= least(F.col("k"))).select("a", "b"))
    release(docs.sparkSession)
    links = verified(star)
    groups = components(links)
    release(docs.sparkSession)

    members = index.join(groups.withColumnRenamed("node", "t"), "t", "left").select("t", "b", "size", F.coalesce("component", "t").alias("c"), "v", "long")
    met = _across(members.filter("not long"), threshold, whole).union(_across_long(members.filter("long"), threshold, whole))
    across = met.groupBy("a", "b", "k").count().filter(F.col("count") >= least(F.col("k"))).select("a", "b")
    across = cut(across.join(star, ["a", "b"], "left_anti"))
    release(docs.sparkSession)
    more = verified(across)
    groups = components(links.union(more)).withColumnRenamed("node", "t").withColumnRenamed("component", "c")
    found = cut(texts.select("t", "digest").join(groups, "t", "left").select("digest", F.coalesce("c", "t").alias("c")))
    discard(texts, index)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Groups of near-duplicate documents: (doc_id, group_id, group_size, is_kept), one row for each member.

    Two texts are linked if the Jaccard similarity of their sets of word n-grams (lower case, without ASCII
    punctuation) reaches ``threshold``, or if they are identical; groups are the connected components.  The
    group's smallest id names it and is the one that is kept.  Documents without a partner have no row.

    - A null id or a null text never matches and has no row.
    - Empty texts and texts without words match only identical texts.
    - Rows that repeat an id count once; the groups of an id's several texts are one group.
    - A text shorter than n words has one n-gram, all of it.  Long texts are used whole.
    - An empty table gives no rows; other columns are ignored, whatever their names.
    - With ``slack`` 0.2 and ``k`` 64, a pair just at the threshold is lost with a chance of about 0.001, of which the bands have 0.000025.
    """
    rows = _digests(docs, id_col, text_col)
    groups = text_groups(rows, **options)
    every = cut(rows.select("doc_id", "digest").distinct().join(groups, "digest").select("doc_id", "c").distinct())
    several = every.groupBy("doc_id").agg(F.min("c").alias("a"), F.max("c").alias("z")).filter("a <> z").select("doc_id", "a")
    bridges = cut(every.join(several, "doc_id").filter("a <> c").select("a", F.col("c").alias("b")))
    if not bridges.isEmpty():
        every = every.join(components(bridges).withColumnRenamed("node", "c"), "c", "left").select("doc_id", F.coalesce("component", "c").alias("c")).distinct()
    sizes = every.groupBy("c").agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("group_id")).filter("group_size > 1")
    return every.join(sizes, "c").select("doc_id", "group_id", "group_size", (F.col("doc_id") == F.col("group_id")).alias("is_kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of texts: the one of the smallest id and, for that, of the smallest digest.

    - It is decided text by text: what else stands under an id neither keeps nor drops a text.
    - Of rows with the same id and text one stays, the one whose columns have the least hash.
    - Rows with a null id or a null text stay, all of them.  No rows in, no rows out.
    """
    digest = F.unhex(F.md5(F.col(text_col)))
    rows = _digests(docs, id_col, text_col)
    groups = text_groups(rows, **options)
    pairs = cut(rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).join(groups, "digest"))
    kept = pairs.groupBy("c").agg(F.min(F.struct("doc_id", "digest", "n")).alias("k")).select("k.*")
    marks = pairs.join(kept.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti").select("doc_id", "digest", F.lit(0).alias("n"))
    marks = small(cut(marks.union(kept.filter("n > 1").select("doc_id", "digest", F.lit(1)))).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("n").alias("_n")))
    marked = docs.join(marks, (F.col(id_col) == F.col("_id")) & (digest == F.col("_digest")), "left")
    out = marked.filter("_n is null").select(docs.columns)
    if not marks.filter("_n = 1").isEmpty():
        named = [F.col(c) for c in docs.columns]
        hashed = F.xxhash64(*[F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
        out = out.union(marked.filter("_n = 1").groupBy("_id", "_digest").agg(F.min_by(F.struct(*named), hashed).alias("_row")).select("_row.*"))
    return out


SQL = """
with recursive d as (select distinct doc_id, text, list_filter(regexp_split_to_array(lower(text), '[\\x00-/:-@\\[-`{-\\x7f]+'), lambda x: x <> '') as w from documents where doc_id is not null and text is not null),
s as (select distinct doc_id, unnest(case when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as g from d where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where c / (x.n + y.n - c)::double >= 0.5
      union select x.doc_id, y.doc_id from d x join d y on x.text = y.text and x.doc_id < y.doc_id),
t as (select a, b from e union select b, a from e),
r as (select a as x, b as y from t union select r.x, t.b from r join t on r.y = t.a),
g as (select x as doc_id, least(x, min(y)) as group_id from r group by x)
select doc_id, group_id, count(*) over (partition by group_id) as group_size, doc_id = group_id as is_kept from g
"""
