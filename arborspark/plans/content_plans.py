"""Queries of context documents and their totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions import paths
from arborspark.functions import text as T
from arborspark.operators import render, totals
from arborspark.operators.visibility import with_directories
from arborspark.plans.registry import query
from arborspark.plans.tables import CONV_FILES, DOC_FILES, conv_files, doc_files
from arborspark.plans.text_plans import BLANK, CHARS, TOKENS, TRAILING

_BREAKS = "(length(t) - length(replace(t, chr(10), '')) - (length(TR) - length(replace(TR, chr(10), ''))))".replace("TR", TRAILING)
_MARK = "('[Whitespace, ' || strlen(t) || ' bytes]')"
_TERMS = f"""terms as (select *, length(path) + 5 + case when t = '' then 21 when {BLANK} then length({_MARK}) else greatest(0, {CHARS} - length({TRAILING})) end as c,
    3 + case when t = '' or {BLANK} then 0 else greatest(0, {_BREAKS}) end as b from uniq)"""
_SUMS = """(b + (n_files - 1) * 2)::bigint as n_lines, (c + (n_files - 1) * 4 - 1)::bigint as n_chars, ceil((c + (n_files - 1) * 4 - 1) / 4.0)::bigint as n_tokens"""
_UNIQUE = f"with uniq as (select path, arg_min(text, doc_id) as t from ({DOC_FILES}) where trim(path) <> '' and not lower(regexp_extract(path, '(\\.[^./]+)$', 1)) in ({', '.join(repr(x) for x in T.BINARY_EXTENSIONS)}) group by path)"


def _text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = doc_files(spark, sf_dir).filter(~T.has_binary_extension(F.col("name")))
    return totals.first_of_each_path(totals.measured(files.select("path", "doc_id", "text")).drop("text"), "doc_id").drop("doc_id")


@query(f"{_UNIQUE}, {_TERMS} select n_files, {_SUMS} from (select count(*) as n_files, sum(c)::bigint as c, sum(b)::bigint as b from terms)")
def q_content_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.content_totals(_text_files(spark, sf_dir))


@query(f"{_UNIQUE}, {_TERMS} select directory, n_files, {_SUMS} from (select regexp_replace(path, '/[^/]*$', '') as directory, count(*) as n_files, sum(c)::bigint as c, sum(b)::bigint as b from terms group by 1)")
def q_content_totals_by_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.content_totals(_text_files(spark, sf_dir).withColumn("directory", paths.parent(F.col("path"))), "directory")


#: Files of which those of even turns come twice, the second time with another text; the first one counts.
_TWICE = f"select conv_id, path, text, 0 as n from ({CONV_FILES}) union all select conv_id, path, 'again ' || text, 1 from ({CONV_FILES}) where regexp_matches(path, '/[0-9]*[02468]_')"
_BLOCKS = f"""with sized as (select conv_id, path, arg_min(text, n) as t from ({_TWICE}) group by conv_id, path),
blocks as (select conv_id, path, row_number() over (partition by conv_id order by path) = 1 as is_first,
    path || ':' || chr(10) || chr(160) || chr(10) || case when t = '' then '[No Content, 0 bytes]' when {BLANK} then {_MARK} else regexp_replace(t, '[\\r\\n]+$', '') end || chr(10) as body from sized),
whole as (select conv_id, path, is_first, case when is_first then '' else chr(160) || chr(10) || chr(160) || chr(10) end || body as block from blocks),
docs as (select conv_id, regexp_replace(string_agg(block, '' order by path), '[\\r\\n]+$', '') as document from whole group by conv_id)"""


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = conv_files(spark, sf_dir)
    again = F.concat(F.lit("again "), "text")
    second = files.filter(F.col("path").rlike("/[0-9]*[02468]_")).select("conv_id", "path", again.alias("text"), F.octet_length(again).cast("bigint").alias("size"), F.lit(1).alias("n"))
    return files.withColumn("n", F.lit(0)).unionByName(second)


@query(f"{_BLOCKS} select conv_id, path, is_first, md5(block) as block_hash from whole")
def q_content_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.content_blocks(_twice(spark, sf_dir), "conv_id", order="n").select("conv_id", "path", "is_first", F.md5("block").alias("block_hash"))


@query(f"{_BLOCKS} select conv_id, md5(document) as document_hash from docs")
def q_content_document_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.content_document(_twice(spark, sf_dir), "conv_id", order="n").select("conv_id", F.md5("document").alias("document_hash"))


_LINES = "(length(t) - length(replace(t, chr(10), '')) + case when regexp_matches(t, '[\\r\\n]$') then 0 else 1 end)::bigint"


@query(f"{_BLOCKS} select conv_id, {_LINES} as n_lines, {CHARS} as n_chars, {TOKENS} as n_tokens from (select conv_id, document as t from docs)")
def q_content_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed form; the SQL measures the rendered documents, which must come to the same."""
    files = totals.measured(conv_files(spark, sf_dir).select("conv_id", "path", "text"))
    return totals.content_totals(files, "conv_id").drop("n_files")


@query(f"{_BLOCKS} select conv_id, {_LINES} as n_lines, {CHARS} as n_chars, {TOKENS} as n_tokens from (select conv_id, document as t from docs)")
def q_rendered_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.text_totals(render.content_document(conv_files(spark, sf_dir), "conv_id"), "document", "conv_id")


_TREE = """lines as (select d.conv_id, string_agg(case when d.n = d.total then '└── ' else '├── ' end || d.name, chr(10) order by upper(d.name), d.name) as lines
    from (select conv_id, string_split(path, '/')[-1] as name, row_number() over (partition by conv_id order by upper(path), path) as n, count(*) over (partition by conv_id) as total from sized) d group by d.conv_id)"""


@query(f"""{_BLOCKS}, {_TREE} select docs.conv_id, md5('chat:' || chr(10) || chr(10) || lines || chr(160) || chr(10) || chr(160) || chr(10) || document) as context_hash from docs join lines on docs.conv_id = lines.conv_id""")
def q_tree_and_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's tree with its document below; the separator's first no-break space ends the tree's last line."""
    files = conv_files(spark, sf_dir)
    nodes = files.select("conv_id", F.substring_index("path", "/", -1).alias("path"))
    nodes = nodes.select("conv_id", "path", F.col("path").alias("name"), F.lit("").alias("parent"), F.lit(False).alias("is_dir"))
    both = render.ascii_tree(nodes, "chat", "conv_id").join(render.content_document(files, "conv_id"), "conv_id")
    return both.select("conv_id", F.md5(render.tree_and_content(F.col("tree"), F.col("document"))).alias("context_hash"))


@query("select conv_id, regexp_replace('Talk/' || conv_id, '[/\\x00]', '_', 'g') || '_content.txt' as file_name from (select distinct conv_id from conversations)")
def q_export_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborspark.functions import urls

    ids = conv_files(spark, sf_dir).select("conv_id").distinct()
    return ids.select("conv_id", urls.export_name(F.concat(F.lit("Talk/"), F.col("conv_id").cast("string")), "content", "txt").alias("file_name"))


@query(f"select path, strlen(text)::bigint as size_bytes from (select path, arg_min(text, doc_id) as text from ({DOC_FILES}) group by path)")
def q_cached_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files joined with measures kept for their paths; those without any are left out."""
    files = with_directories(doc_files(spark, sf_dir)).filter("not is_dir")
    kept = totals.first_of_each_path(totals.measured(doc_files(spark, sf_dir).select("path", "doc_id", "text")).select("path", "doc_id", "size_bytes"), "doc_id").drop("doc_id")
    return totals.from_cache(files, kept)
