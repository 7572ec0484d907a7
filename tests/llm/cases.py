"""Odd rows and clashing columns that every operator must take."""

from pyspark.sql import functions as F

LONG = "word " * 60_000 + "end\n"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."), (None, "a text without an id, which has some words in it"), (2, None), (3, ""), (4, " \n\t "), (5, LONG),
    (6, "twice the same row of words"), (6, "twice the same row of words"), (7, "twice the same row of words"), (6, "another text under the same id"), (8, "!!! ### ..."), (None, None), (-9, "ein deutscher Satz, der hier steht 😀"), (10, "x"),
]
#: Names that the operators use inside.
CLASHES = "id a b c d f k n t u v w x y m r g q digest size sketch shingles count first place df component group_id is_kept language share spans accepted bucket chunk rank batch slot n_tokens tokens pos row parts part keep path home directory depth licence score unit units key value shard data code ids least label odds level up length url html quality toxic".split()


def odd(spark, rows=ROWS, schema="doc_id bigint, text string"):
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *[F.lit(None if i % 2 else i).cast("string").alias(c) for i, c in enumerate(CLASHES) if c not in df.columns])


def empty(spark, schema="doc_id bigint, text string"):
    return odd(spark, [], schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
