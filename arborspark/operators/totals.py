"""Totals of an export without rendering it.

Lines and characters of the context document are sums over files of closed forms, plus separators; so they are an
ordinary aggregate that neither orders nor gathers anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborspark.functions import text as T
from arborspark.operators.render import EMPTY_MARK


def measured(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``files`` with the measures of their texts (columns of ``text.metrics``); the size is that of the UTF-8 bytes."""
    t = F.col(text_col)
    return files.select("*", *[c.alias(k) for k, c in T.metrics(t, F.octet_length(t)).items()])


def first_of_each_path(files: DataFrame, order_col: str, *by: str) -> DataFrame:
    """Without blank paths; of files that share a path the first stays.  A partial aggregate: give it measures rather than texts where these are all that is needed."""
    rest = [c for c in files.columns if c not in (*by, "path")]
    first = files.filter(F.trim("path") != "").groupBy(*by, "path").agg(F.min_by(F.struct(*rest), F.col(order_col)).alias("_first"))
    return first.select(*[F.col(c) if c in (*by, "path") else F.col("_first")[c].alias(c) for c in files.columns])


def _terms() -> tuple[Column, Column]:
    """(characters, line breaks) that one file adds."""
    mark = F.octet_length(F.concat(F.lit("[Whitespace, "), F.col("size_bytes").cast("string"), F.lit(" bytes]")))
    body = F.when(F.col("is_empty"), len(EMPTY_MARK)).when(F.col("is_whitespace_only"), mark).otherwise(F.greatest(F.lit(0), F.col("char_count") - F.col("trailing_newline_chars")))
    breaks = F.when(F.col("is_empty") | F.col("is_whitespace_only"), 0).otherwise(F.greatest(F.lit(0), F.greatest(F.lit(0), F.col("line_count") - 1) - F.col("trailing_newline_line_breaks")))
    return T.utf16_length(F.col("path")) + 2 + 2 + body + 1, breaks + 3


def content_totals(files: DataFrame, *by: str) -> DataFrame:
    """(…by, n_files, n_lines, n_chars, n_tokens) of measured files with unique paths; 0 of all without files."""
    chars, breaks = _terms()
    sums = files.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files"), F.sum(chars).alias("c"), F.sum(breaks).alias("b"))
    some = F.col("n_files") > 0
    total = F.when(some, F.col("c") + (F.col("n_files") - 1) * 4 - 1).otherwise(0).cast("bigint")
    lines = F.when(some, F.col("b") + (F.col("n_files") - 1) * 2 - 1 + 1).otherwise(0).cast("bigint")
    return sums.select(*by, "n_files", lines.alias("n_lines"), total.alias("n_chars"), T.tokens(total).alias("n_tokens"))


def text_totals(rendered: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """(…keep, n_lines, n_chars, n_tokens) of rendered texts, row by row."""
    t = F.col(text_col)
    return rendered.select(*keep, T.rendered_lines(t).alias("n_lines"), T.utf16_length(t).alias("n_chars"), T.tokens(T.utf16_length(t)).alias("n_tokens"))


def from_cache(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files with the measures kept for their paths; those without any are left out."""
    return files.select("path").join(cached, "path")
