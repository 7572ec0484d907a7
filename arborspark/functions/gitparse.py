"""What the output of git says: branches, progress and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: (kind, alternatives, each a set of texts that must all occur), in the order of testing.
ERRORS = [
    ("invalid_repository", (("not valid: is this a git repository",), ("repository", "not found"))),
    ("network", (("could not resolve host",), ("failed to connect",), ("unable to access",))),
    ("authentication", (("permission denied",), ("authentication failed",))),
    ("timeout", (("timed out",), ("timeout",))),
]


def error_kind(message: Column) -> Column:
    """invalid_repository, network, authentication, timeout, failed for a blank message, other for the rest."""
    text, kind = F.lower(message), F.lit("other")
    for name, choices in reversed(ERRORS):
        found = F.lit(False)
        for marks in choices:
            every = F.lit(True)
            for mark in marks:
                every = every & F.contains(text, F.lit(mark))
            found = found | every
        kind = F.when(found, name).otherwise(kind)
    return F.when(F.trim(F.coalesce(message, F.lit(""))) == "", "failed").otherwise(kind)


def progress(line: Column) -> Column:
    """The first whole number of at most 100 before a percent sign, blanks between allowed; or null."""
    found = F.transform(F.regexp_extract_all(line, F.lit(r"(?<!\d)0*(\d{1,9})\s*%"), 1), lambda x: x.cast("int"))
    return F.try_element_at(F.filter(found, lambda x: x <= 100), F.lit(1))


def trailing_percent(status: Column) -> Column:
    """The number of a status that ends in a percent sign, after its last blank; or null."""
    text = F.trim(status)
    token = F.regexp_replace(F.substring_index(text, " ", -1), r"%+\z", "")
    number = token.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z")
    return F.when(F.endswith(text, F.lit("%")) & number, token.try_cast("double"))


def remote_branch(line: Column) -> Column:
    """A branch's name in a line of ls-remote ('<hash> refs/heads/<name>') or of branch -r ('  origin/<name>'; aliases with -> don't count)."""
    head = F.regexp_extract(line, r"refs/heads/(.+)\z", 1)
    listed = F.regexp_extract(F.trim(line), r"^[^/\s]+/(\S+)\z", 1)
    name = F.when(head != "", F.trim(head)).when(~F.contains(line, F.lit("->")) & (listed != ""), listed)
    return F.when(name != "", name)


def branches(lines: DataFrame, current: str, local: DataFrame | None = None, line_col: str = "line", order_col: str = "n") -> DataFrame:
    """(name, is_active, is_remote, position): branches without repeats (in any case, the first stays), the current one first.

    ``local`` (name) has the branches that exist here; others, or all without it, are remote only.
    """
    named = lines.select(remote_branch(F.col(line_col)).alias("name"), F.col(order_col).alias("n")).filter("name is not null")
    first = named.groupBy(F.upper("name").alias("key")).agg(F.min_by("name", "n").alias("name"))
    here = F.lit(None)
    if local is not None:
        first, here = first.join(local.select(F.upper("name").alias("key"), F.lit(True).alias("here")).distinct(), "key", "left"), F.col("here")
    rows = first.select("name", (F.col("key") == current.upper()).alias("is_active"), here.isNull().alias("is_remote"))
    return rows.withColumn("position", F.row_number().over(W.orderBy(F.desc("is_active"), F.upper("name"), "name")))


def tail(lines: DataFrame, max_chars: int, line_col: str = "line", order_col: str = "n") -> DataFrame:
    """The last lines whose lengths sum to at most ``max_chars`` (1024 at least) — what a bounded buffer still holds."""
    total = F.sum(F.length(line_col)).over(W.orderBy(F.desc(order_col)).rowsBetween(W.unboundedPreceding, W.currentRow))
    return lines.withColumn("_sum", total).filter(F.col("_sum") <= max(1024, max_chars)).drop("_sum")


def quoted_argument(arg: Column) -> Column:
    """A command-line argument, in quotes if it has white space or quotes."""
    return F.when(arg.rlike(r'[\s"]'), F.concat(F.lit('"'), F.replace(arg, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(arg)
