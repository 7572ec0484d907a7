"""Queries of facets, options and remembered selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions import paths
from arborspark.operators import facets
from arborspark.plans.registry import query
from arborspark.plans.tables import DOC_FILES, PAGE_FILES, doc_files, doc_nodes, nodes_sql, page_nodes, table

_TOKEN = "case when trim(name) <> '' and not regexp_matches(name, '\\.[^.]+$') then name else regexp_extract(name, '(\\.[^.]+)$', 1) end"
_TOKENS = f"named as (select *, string_split(path, '/')[-1] as name from ({DOC_FILES})), tokens as (select path, name, {_TOKEN} as t from named)"
_FACET = f"with {_TOKENS}, facet as (select min(t) as token, count(*) as n_files from tokens where t <> '' group by upper(t))"


@query(f"{_FACET} select * from facet")
def q_ext_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.extension_facet(doc_files(spark, sf_dir))


@query(f"with {_TOKENS} select string_split(path, '/')[1] as root, min(t) as token, count(*) as n_files from tokens where t <> '' group by root, upper(t)")
def q_ext_facet_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.extension_facet(doc_files(spark, sf_dir).withColumn("root", paths.root_segment(F.col("path"))), "root")


@query(f"with {_TOKENS} select min(t) as token, count(*) as n_files from tokens where t <> '' and (not contains(path, '/') or upper(string_split(path, '/')[1]) in ('DE', 'FR')) group by upper(t)")
def q_ext_facet_selected_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.facet_of_roots(doc_files(spark, sf_dir), ["de", "Fr"])


@query(f"{_FACET} select token, n_files, (select coalesce(bool_or(not regexp_matches(token, '\\.[^.]+$')), false) from facet) as has_extensionless from facet where regexp_matches(token, '\\.[^.]+$')")
def q_extensionless_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.split_extensions(facets.extension_facet(doc_files(spark, sf_dir)))


@query(f"with {nodes_sql(PAGE_FILES)} select name, row_number() over (order by upper(name), name)::int as position from (select distinct name from nodes where is_dir and depth = 1)")
def q_root_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.root_folders(page_nodes(spark, sf_dir))


@query(f"{_FACET} select token, upper(token) in ('.TXT', '.PY', 'README') as is_checked from facet")
def q_extension_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    previous = spark.createDataFrame([(".TXT",), (".py",), ("readme",)], "token string")
    return facets.extension_options(facets.extension_facet(doc_files(spark, sf_dir)), previous)


@query(f"with {nodes_sql(PAGE_FILES)} select name, not (starts_with(lower(name), 'spam-farm.') or starts_with(name, '.')) as is_checked from (select distinct name from nodes where is_dir and depth = 1)")
def q_root_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without history a folder is checked unless smart or dot rules ignore it."""
    return facets.root_options(facets.root_folders(page_nodes(spark, sf_dir)), [], [f"spam-farm.example.{x}" for x in ("com", "net", "org")], dot_folders=True)


@query("select * from (values (0, 'smart_ignore', true), (1, 'use_gitignore', true), (2, 'hidden_folders', true), (3, 'hidden_files', true), (4, 'dot_folders', true), (5, 'dot_files', true), (6, 'extensionless_files', false)) as v(position, option, default_checked)")
def q_ignore_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.ignore_options(spark, git=True, smart=True)


@query("select event_id, value > 90 or event_type = 'click' or (user_id % 2 <> 0 and event_type = 'view') as state from events")
def q_option_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as an option: default for views, previous for clicks, history for even users, all checked beyond a value of 90."""
    state = facets.option_state(F.col("event_type") == "view", F.col("event_type") == "click", F.col("user_id") % 2 == 0, F.col("value") > 90)
    return table(spark, sf_dir, "events").select("event_id", state.alias("state"))


@query(f"{_FACET} select token, true as is_checked, false as all_before from facet")
def q_selection_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved selection that meets nothing: all are checked."""
    options = facets.extension_options(facets.extension_facet(doc_files(spark, sf_dir)), spark.createDataFrame([(".gone",)], "token string"))
    return facets.fallback_checked(options).crossJoin(F.broadcast(facets.all_checked(options).select(F.col("all_checked").alias("all_before"))))


@query("select false as root_access_denied, true as had_access_denied")
def q_access_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories called build can't be read here."""
    return facets.readable_flags(doc_nodes(spark, sf_dir).withColumn("access_denied", F.col("is_dir") & (F.col("name") == "build")))
