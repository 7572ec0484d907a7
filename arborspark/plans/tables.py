"""The given tables seen as trees of files, as DataFrames and as SQL.

The expressions for paths are read by Spark and by DuckDB alike, so both sides see the same tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions.globs import IgnoreRule
from arborspark.operators.visibility import with_directories

#: Documents as files of a workspace: lang/source/..., with markers, ignore files, binaries, dot-names and repeated paths.
DOC_PATH = """lang || '/' || source || '/' || case doc_id % 50
    when 3 then 'README' when 7 then 'package.json' when 9 then '.env_' || doc_id when 13 then 'app_' || doc_id || '.csproj'
    when 17 then 'bin/out_' || doc_id || '.dll' when 19 then 'node_modules/mod_' || doc_id || '.js' when 21 then '.gitignore'
    when 23 then 'img_' || doc_id || '.PNG' when 29 then '.cache/tmp_' || doc_id when 31 then 'docs/page_' || doc_id || '.md'
    when 37 then 'build/keep_' || doc_id || '.txt' when 39 then 'build/' || doc_id || '.log' when 41 then 'Thumbs.db' when 43 then 'pyproject.toml'
    else case doc_id % 3 when 0 then 'doc_' || doc_id || '.txt' when 1 then 'main_' || doc_id || '.py' else 'notes_' || doc_id || '.MD' end end"""
#: Pages as files: host/language/leaf.
PAGE_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '/?([?#].*)?$', '')"
CONV_PATH = "'conv_' || conv_id || '/' || turn || '_' || role || '.txt'"
PART_PATH = "p_brand || '/' || p_type || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.json'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(files: DataFrame) -> DataFrame:
    return files.withColumn("name", F.substring_index("path", "/", -1))


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, doc_id, text, name)"""
    return _named(table(spark, sf_dir, "documents").select(F.expr(DOC_PATH).alias("path"), "doc_id", "text"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, page_id, html, name)"""
    return _named(table(spark, sf_dir, "pages").select(F.expr(PAGE_PATH).alias("path"), "page_id", "html"))


def conv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, path, text, size)"""
    return table(spark, sf_dir, "conversations").select("conv_id", F.expr(CONV_PATH).alias("path"), "text", F.octet_length("text").cast("bigint").alias("size"))


def doc_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_directories(doc_files(spark, sf_dir))


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_directories(page_files(spark, sf_dir))


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_directories(table(spark, sf_dir, "part").select(F.expr(PART_PATH).alias("path")))


def geo_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, their nations and these nations' suppliers: a tree whose leaves are the suppliers."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return with_directories(joined.select(F.concat_ws("/", "r_name", "n_name", "s_name").alias("path")))


DOC_FILES = f"select {DOC_PATH} as path, doc_id, text from documents"
PAGE_FILES = f"select {PAGE_PATH} as path, page_id, html from pages"
CONV_FILES = f"select conv_id, {CONV_PATH} as path, text, strlen(text) as size from conversations"
PART_FILES = f"select {PART_PATH} as path from part"
GEO_FILES = "select r_name || '/' || n_name || '/' || s_name as path from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


def nodes_sql(files: str) -> str:
    """CTEs files, anc (path, above, d) of files and directories, and nodes."""
    return f"""files as ({files}),
seeds as (select path, string_split(path, '/') as a from (select distinct path from files)),
dirs as (select distinct array_to_string(a[1:d], '/') as path from seeds, unnest(range(1, len(a))) as u(d)),
nodes as (select path, string_split(path, '/')[-1] as name, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as parent,
    len(string_split(path, '/'))::int as depth, is_dir from (select path, false as is_dir from seeds union all select path, true from dirs)),
anc as (select path, array_to_string(string_split(path, '/')[1:d], '/') as above, d from nodes, unnest(range(1, depth)) as u(d))"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rules_sql(rules: list[IgnoreRule]) -> str:
    """A CTE rules (ord, regex, negated, dir_only, by_name, prefix); an empty one has a rule that never matches."""
    rows = ", ".join(f"({i}, {quoted(r.pattern('$'))}, {str(r.negated).lower()}, {str(r.dir_only).lower()}, {str(r.by_name).lower()}, {quoted(r.static_prefix)})" for i, r in enumerate(rules))
    return f"rules(ord, regex, negated, dir_only, by_name, prefix) as (values {rows})"


#: For CTEs nodes and rules with the root as the only scope: matched (by rules), ignored (with the probe of contents), traversable.
IGNORED = """hit as (select path, is_dir, coalesce(arg_max(not negated, ord), false) as matched from nodes left join rules
    on regexp_matches(case when by_name then name when dir_only and is_dir then path || '/' else path end, regex) group by path, is_dir),
ignored as (select path, is_dir, matched or (is_dir and not (select bool_or(negated) from rules) and exists (select 1 from rules where not dir_only and not by_name and regexp_matches(hit.path || '/_', regex))) as ignored from hit),
reach as (select path, exists (select 1 from rules r where r.negated and case
        when r.by_name then not exists (select 1 from rules x where x.dir_only and not x.negated and regexp_matches(nodes.path || '/', x.regex))
        when r.prefix = '' then true else starts_with(r.prefix || '/', nodes.path || '/') or starts_with(nodes.path || '/', r.prefix || '/') end) as traversable
    from nodes where is_dir)"""
