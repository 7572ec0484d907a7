"""Packing into optimal length buckets.

The histogram of all lengths decides the bucket boundaries: dynamic programming finds those that minimise the
padding when every sequence is padded to its bucket's boundary.  Batches with a token budget form inside
each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.llm.common import discard, ordered, shared_table, small


def word_count(text: Column) -> Column:
    """Runs of anything but blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f]+")), F.lit(0)).cast("bigint")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The largest lengths of ``buckets`` buckets (or of as many as there are lengths) with the least padding.

    ``lengths`` ascend.  Of equally good choices, each bucket, from the last one, starts as low as it can.
    Exact: costs are integers, and the best split grows with the last length, so that each layer of the
    programme halves its ranges (O(n log n)).
    """
    n = len(lengths)
    if not n:
        return []
    size = np.asarray(lengths, np.int64)
    c = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
    s = np.concatenate([[0], np.cumsum(size * np.asarray(counts, np.int64))])
    buckets = min(buckets, n)
    cost = np.concatenate([[0], size * c[1:] - s[1:]])  # one bucket over the first j lengths
    choices = []
    for k in range(2, buckets + 1):
        now, choice = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        base = cost + s  # cost[i] + L[j] (c[j] - c[i]) - (s[j] - s[i])
        todo = [(k, n, k - 1, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            v = base[i] - size[j - 1] * c[i]
            best = int(np.argmin(v))
            now[j], choice[j] = v[best] + size[j - 1] * c[j] - s[j], i[best]
            todo += [(lo, j - 1, first, int(i[best])), (j + 1, hi, int(i[best]), last)]
        cost = now
        choices.append(choice)
    out, j = [int(size[n - 1])], n
    for choice in reversed(choices):
        j = int(choice[j])
        out.append(int(size[j - 1]))
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, buckets: int = 8, token_budget: int = 65536) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_len, batch, slot) for every row.

    ``length`` is a sequence's length in tokens, by default the text's words.  A bucket of boundary b takes
    ``max(1, token_budget // b)`` rows a batch, in the order of id and length; so a sequence longer than the
    budget is a batch of its own.  Batches are numbered within their bucket.

    - A null or empty text has length 0 and goes to the first bucket; a null id sorts first.
    - Ids are of any type that has an order; those of whole numbers may be sparse or hashes.
    - Repeated rows each take a slot; ties of id and length are interchangeable.
    - No rows in, no rows out.  Other columns are ignored, whatever their names.

    Texts are read once, for their lengths.  Only the histogram, one row for each different length, reaches the
    driver.  Rows are sorted by ranges and numbered by their place in the range and the ranges before it, so no task handles a
    whole bucket.
    """
    n_tokens = word_count(F.col(text_col)) if length is None else F.coalesce(length, F.lit(0)).cast("bigint")
    rows = shared_table(docs.select(F.col(id_col).alias("doc_id"), n_tokens.alias("n_tokens")), "lengths")
    histogram = sorted(tuple(r) for r in rows.groupBy("n_tokens").count().collect())
    bounds = optimal_boundaries(np.array([x[0] for x in histogram], np.int64), np.array([x[1] for x in histogram], np.int64), buckets)
    bounds = bounds or [0]
    bucket, edge = F.lit(len(bounds) - 1), F.lit(bounds[-1]).cast("bigint")
    for k in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[k], k).otherwise(bucket)
        edge = F.when(F.col("n_tokens") <= bounds[k], F.lit(bounds[k]).cast("bigint")).otherwise(edge)
    # the last column splits even rows that agree in id and length
    placed = ordered(rows.select("doc_id", "n_tokens", bucket.alias("bucket"), edge.alias("bucket_len"), F.monotonically_increasing_id().alias("row")), "bucket", "doc_id", "n_tokens", "row")
    discard(rows)
    counts = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("low"))
    before = W.partitionBy("bucket").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("bucket", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("start"))
    rank = F.col("place") + F.col("start")
    fits = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    return placed.join(small(starts), ["bucket", "part"]).select(
        "doc_id", "n_tokens", F.col("bucket").cast("int").alias("bucket"), "bucket_len", F.floor(rank / fits).cast("bigint").alias("batch"), F.pmod(rank, fits).cast("bigint").alias("slot")
    )


def sql(buckets: int = 8, token_budget: int = 65536) -> str:
    """The same in SQL, for at least ``buckets`` different lengths: one layer of the programme for each bucket."""
    layers = [
        """with t as (select doc_id, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0)::bigint as n_tokens from documents),
h as (select n_tokens as l, count(*) as m from t group by 1),
p as (select row_number() over (order by l) as j, l, (sum(m) over (order by l))::bigint as c, (sum(l * m) over (order by l))::bigint as s from h),
d1 as (select j, l, c, s, l * c - s as v, 0::bigint as i from p)"""
    ]
    for k in range(2, buckets + 1):
        layers.append(f"""d{k} as (select j, any_value(l) as l, any_value(c) as c, any_value(s) as s, min(x).v as v, min(x).i as i
from (select b.j, b.l, b.c, b.s, {{'v': a.v + b.l * (b.c - a.c) - (b.s - a.s), 'i': a.j}} as x from d{k - 1} a join p b on a.j < b.j) group by j)""")
    layers.append(f"e{buckets} as (select j, l, i from d{buckets} where j = (select max(j) from p))")
    for k in range(buckets - 1, 0, -1):
        layers.append(f"e{k} as (select d.j, d.l, d.i from d{k} d join e{k + 1} e on d.j = e.i)")
    edges = " union all ".join(f"select {k - 1} as bucket, l as bucket_len from e{k}" for k in range(1, buckets + 1))
    layers.append(f"edge as ({edges})")
    return (
        ",\n".join(layers)
        + f""",
r as (select t.doc_id, t.n_tokens, min({{'b': e.bucket, 'l': e.bucket_len}}) as e from t join edge e on t.n_tokens <= e.bucket_len group by t.doc_id, t.n_tokens),
q as (select doc_id, n_tokens, e.b as bucket, e.l as bucket_len, greatest(1, {token_budget} // greatest(e.l, 1)) as f, row_number() over (partition by e.b order by doc_id, n_tokens) - 1 as k from r)
select doc_id, n_tokens, bucket::int as bucket, bucket_len::bigint as bucket_len, (k // f)::bigint as batch, (k % f)::bigint as slot from q"""
    )
