"""Text classification and measurement, all as expressions over a STRING or BINARY column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that are taken for binary without a look at the content.
BINARY_EXTENSIONS = tuple(
    "." + x
    for group in ("png jpg jpeg gif bmp ico webp svg tiff tif", "mp4 avi mkv mov wmv flv webm", "mp3 wav flac aac ogg wma m4a", "zip rar 7z tar gz bz2 xz", "exe dll so dylib pdb ilk", "pdf doc docx xls xlsx ppt pptx", "ttf otf woff woff2 eot", "bin dat db sqlite mdb")
    for x in group.split()
)
LARGE_FILE = 10 * 1024 * 1024
ESTIMATED_LINE = 60
PROBE_BYTES = 512
NBSP = " "


def has_binary_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)\z", 1)).isin(*BINARY_EXTENSIONS)


def is_binary(content: Column) -> Column:
    """A NUL byte: anywhere in a file of up to the large size, among the first bytes of a larger one."""
    nul = F.lit(b"\x00")
    return F.when(F.length(content) > LARGE_FILE, F.contains(F.substring(content, 1, PROBE_BYTES), nul)).otherwise(F.contains(content, nul))


def decoded(content: Column) -> Column:
    """UTF-8 text of bytes; malformed bytes become U+FFFD, a byte-order mark goes."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^﻿", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def _breaks(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")


def line_count(text: Column) -> Column:
    """0 without characters, else line feeds plus one; a lone carriage return breaks no line."""
    return F.when(text == "", F.lit(0).cast("bigint")).otherwise(_breaks(text) + 1)


def is_whitespace_only(text: Column) -> Column:
    return (text != "") & text.rlike(r"(?U)^\s+\z")


def trailing_newlines(text: Column) -> Column:
    return F.regexp_extract(text, r"([\r\n]*)\z", 1)


def trailing_newline_chars(text: Column) -> Column:
    return F.length(trailing_newlines(text)).cast("bigint")


def trailing_newline_breaks(text: Column) -> Column:
    return _breaks(trailing_newlines(text))


def rendered_lines(text: Column) -> Column:
    """Lines of a rendered text: a last line counts only if something stands in it."""
    return F.when(text == "", F.lit(0).cast("bigint")).otherwise(_breaks(text) + F.when(text.rlike(r"[\r\n]\z"), 0).otherwise(1))


def tokens(chars: Column) -> Column:
    """The estimate of a token for four characters, rounded up."""
    return F.ceil(chars / F.lit(4.0)).cast("bigint")


def preview_lines(text: Column) -> Column:
    return _breaks(text) + 1


def _one_decimal(n: Column, unit: int) -> Column:
    """``n / unit`` with one decimal, rounded by the fraction's exact binary value and upwards where that is a tie (.25 and .75)."""
    tie = (n % unit).isin(unit // 4, unit * 3 // 4)
    return F.replace(F.format_number(F.when(tie, n + unit // 20).otherwise(n) / F.lit(float(unit)), 1), F.lit(","), F.lit(""))


def short_number(n: Column) -> Column:
    """1.2M from a million, 12.3K from ten thousand, else the number with separators."""
    return F.when(n >= 1_000_000, F.concat(_one_decimal(n, 1_000_000), F.lit("M"))).when(n >= 10_000, F.concat(_one_decimal(n, 1000), F.lit("K"))).otherwise(F.format_number(n, 0))


def metrics(text: Column, size: Column) -> dict[str, Column]:
    """All measures of a text; beyond the large size they are estimated from the size and the text isn't read."""
    large = size > LARGE_FILE
    pick = lambda estimate, exact: F.when(large, estimate).otherwise(exact)
    zero, no = F.lit(0).cast("bigint"), F.lit(False)
    return {
        "size_bytes": size.cast("bigint"),
        "line_count": pick(F.greatest(F.lit(1), F.floor(size / ESTIMATED_LINE)).cast("bigint"), line_count(text)),
        "char_count": pick(F.least(size, F.lit(2**31 - 1)).cast("bigint"), utf16_length(text)),
        "is_empty": pick(no, text == ""),
        "is_whitespace_only": pick(no, is_whitespace_only(text)),
        "trailing_newline_chars": pick(zero, trailing_newline_chars(text)),
        "trailing_newline_line_breaks": pick(zero, trailing_newline_breaks(text)),
        "is_estimated": large,
    }
