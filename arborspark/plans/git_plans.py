"""Queries of repository URLs, the output of git, and saved profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions import gitparse, paths, urls
from arborspark.operators import presentation, profiles
from arborspark.plans.registry import query
from arborspark.plans.tables import DOC_FILES, PAGE_FILES, doc_files, page_files, table

#: Suppliers' repositories in six ways of writing an address; ``form`` tells which.
_OWNED = """select s_suppkey, s_suppkey % 6 as form, 'team' || s_nationkey as owner, replace(s_name, '#', '-') as repo from supplier"""
_URL = """case form when 0 then 'https://github.com/' || owner || '/' || repo || '.git' when 1 then 'https://me:pw@gitlab.com/' || owner || '/' || repo || '/?tab=1#x' when 2 then 'http://git.example.org/git/' || repo
    when 3 then 'https://example.org/' || repo when 4 then 'ssh://git@github.com/' || owner || '/' || repo else ' https://www.GitHub.com/' || owner || '/' || repo || '//' end"""


@query(f"""select s_suppkey, form not in (3, 4) as is_repository, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '://[^@/]*@', '://'), '/+$', ''), '\\.git$', '') as cleaned, repo as repo_name,
    case when form in (0, 5) then 'https://github.com/' || owner || '/' || repo || '/archive/refs/heads/main.zip' end as archive, case when form in (0, 5) then 'https://github.com/' || owner || '/' || repo || '/archive/refs/heads/master.zip' end as second from (select *, {_URL} as url from ({_OWNED}))""")
def q_repo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    owned = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 6).alias("form"), F.concat(F.lit("team"), F.col("s_nationkey").cast("string")).alias("owner"), F.replace("s_name", F.lit("#"), F.lit("-")).alias("repo"))
    return owned.select("s_suppkey", F.expr(_URL).alias("url")).select("s_suppkey", urls.is_repository(u).alias("is_repository"), urls.clean(u).alias("cleaned"), urls.repository_name(u).alias("repo_name"), urls.archive_urls(u)[0].alias("archive"), urls.archive_urls(u)[1].alias("second"))


@query("select page_id, regexp_matches(url, '^https?://([^/]*@)?([^/]*\\.)?(github\\.com|gitlab\\.com)[/:?#]') or regexp_matches(regexp_replace(url, '[?#].*$', ''), '\\.git$|/git/') as is_repository, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') as cleaned from pages")
def q_page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.is_repository(F.col("url")).alias("is_repository"), urls.clean(F.col("url")).alias("cleaned"))


@query(f"select path, 'https://github.com/acme/w/' || replace(replace(path, ' ', '%20'), '#', '%23') as web_path from (select distinct path from ({DOC_FILES}))")
def q_web_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = doc_files(spark, sf_dir).select("path").distinct()
    return files.select("path", urls.web_path(F.lit("https://me@github.com/acme/w.git?x=1"), F.col("path")).alias("web_path"))


@query(f"select path, string_split(path, '/')[-1] || '' as repo_name, case when path = string_split(path, '/')[1] then '.' else path[length(string_split(path, '/')[1]) + 2:] end as below from (select distinct path from ({PAGE_FILES}))")
def q_repo_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = page_files(spark, sf_dir).select("path").distinct()
    return files.select("path", urls.repository_name(F.concat(F.lit("https://x.org/"), F.col("path"))).alias("repo_name"), paths.relative_to(F.col("path"), paths.root_segment(F.col("path"))).alias("below"))


@query(f"""select path, case when starts_with(path, 'spam') then path when root = path then null else nullif(path[length(root) + 2:], '') end as below
    from (select path, string_split(path, '/')[1] as root from (select distinct path from ({PAGE_FILES}) union select distinct string_split(path, '/')[1] || '/' from ({PAGE_FILES})))""")
def q_archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host's pages as an archive whose top folder is the host, written with backslashes; those of hosts that begin with spam lie beside a top folder."""
    files = page_files(spark, sf_dir).select("path").distinct()
    entries = files.union(files.select(F.concat(paths.root_segment(F.col("path")), F.lit("/")))).distinct()
    top = F.when(F.startswith("path", F.lit("spam")), "repo-main").otherwise(paths.root_segment(F.col("path")))
    below = urls.without_top_folder(F.translate("path", "/", "\\"), top)
    return entries.select("path", F.when(F.col("path") == top, F.lit(None)).otherwise(below).alias("below"))


@query("select p_partkey, trim(trim(regexp_replace(p_brand || ':' || p_type || '/*' || p_name || '?' || chr(9), '[<>:\"/\\\\|?*\\x00-\\x1f]', '', 'g'))[1:100]) as safe from part")
def q_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_brand", F.lit(":"), "p_type", F.lit("/*"), "p_name", F.lit("?\t"))
    return table(spark, sf_dir, "part").select("p_partkey", urls.sanitised(raw).alias("safe"))


#: Events as lines of git's lists of branches, of four kinds; the second kind writes names in capitals.
_BRANCH = "event_type || '/' || (user_id % 40)"
_LINE = f"case event_id % 4 when 0 then md5(event_type) || ' refs/heads/' || {_BRANCH} when 1 then '  origin/' || upper({_BRANCH}) when 2 then '  origin/HEAD -> origin/' || {_BRANCH} else 'warning: ' || event_type end"


@query(f"""with named as (select event_id as n, case event_id % 4 when 0 then {_BRANCH} else upper({_BRANCH}) end as name from events where event_id % 4 < 2),
firsts as (select upper(name) as key, arg_min(name, n) as name from named group by 1),
flagged as (select name, key = 'VIEW/7' as is_active, key not in (select upper({_BRANCH}) from events where user_id % 40 < 10) as is_remote from firsts)
select name, is_active, is_remote, row_number() over (order by is_active desc, upper(name), name)::int as position from flagged""")
def q_branch_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    local = events.filter("user_id % 40 < 10").select(F.expr(_BRANCH).alias("name")).distinct()
    return gitparse.branches(events.select(F.col("event_id").alias("n"), F.expr(_LINE).alias("line")), "View/7", local)


_PROGRESS = "case event_id % 5 when 0 then 'Receiving objects: ' || (event_id % 250) || '% (1/2)' when 1 then 'Resolving ' || (event_id % 101) || '%' when 2 then '250% then ' || (event_id % 90) || ' %' when 3 then event_type else 'Unpacking ' || (event_id % 100) || '.5% ' end"


@query("""select event_id, case event_id % 5 when 0 then case when event_id % 250 <= 100 then event_id % 250 end when 1 then event_id % 101 when 2 then event_id % 90 when 4 then 5 end::int as percent,
    case event_id % 5 when 1 then event_id % 101 when 4 then event_id % 100 + 0.5 end::double as at_end from events""")
def q_progress_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    return table(spark, sf_dir, "events").select("event_id", F.expr(_PROGRESS).alias("line")).select("event_id", gitparse.progress(line).alias("percent"), gitparse.trailing_percent(line).alias("at_end"))


_MESSAGE = """case event_id % 9 when 0 then 'fatal: Repository ' || user_id || ' Not Found' when 1 then 'FATAL: unable to access x' when 2 then 'Could not resolve host: ' || event_type when 3 then 'Permission denied (publickey).'
    when 4 then event_type || ' timed out' when 5 then ' ' when 6 then 'repository ' || event_type when 7 then 'Authentication failed; connection timeout' else 'failed to connect, repository not found' end"""


@query(f"""select event_id, case when trim(m) = '' then 'failed' when m ilike '%not valid: is this a git repository%' or (m ilike '%repository%' and m ilike '%not found%') then 'invalid_repository'
    when m ilike '%could not resolve host%' or m ilike '%failed to connect%' or m ilike '%unable to access%' then 'network' when m ilike '%permission denied%' or m ilike '%authentication failed%' then 'authentication'
    when m ilike '%timed out%' or m ilike '%timeout%' then 'timeout' else 'other' end as kind from (select event_id, {_MESSAGE} as m from events)""")
def q_git_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", gitparse.error_kind(F.expr(_MESSAGE)).alias("kind"))


@query("select event_id from (select event_id, sum(length(event_type) + 90) over (order by event_id desc) as s from events) where s <= 4096")
def q_tail_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded buffer of a process's last lines, of all events' lines."""
    lines = table(spark, sf_dir, "events").select("event_id", F.concat(F.repeat(F.lit("x"), F.lit(90)), "event_type").alias("line"))
    return gitparse.tail(lines, 4096, order_col="event_id").select("event_id")


_ARGUMENT = "case p_partkey % 4 when 0 then replace(p_name, ' ', '_') when 1 then p_name when 2 then 'say \"' || p_name || '\"' else p_brand || chr(9) || p_size end"


@query(f"""select p_partkey, case when contains(a, ' ') or contains(a, chr(9)) or contains(a, '"') then '"' || replace(a, '"', '\\"') || '"' else a end as quoted from (select p_partkey, {_ARGUMENT} as a from part)""")
def q_argument_quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", gitparse.quoted_argument(F.expr(_ARGUMENT)).alias("quoted"))


@query("select doc_id, case when lower(trim(lang)) in ('ru', 'en', 'uz', 'tg', 'kk', 'fr', 'de', 'it') then lower(trim(lang)) end as code from documents")
def q_language_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", presentation.language_code(F.concat(F.lit(" "), F.upper("lang"))).alias("code"))


@query("select event_id from events where ts < timestamp '2024-01-15 12:00:00' - interval 24 hours")
def q_stale_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cache entries older than a day at a fixed time."""
    return profiles.stale(table(spark, sf_dir, "events"), "2024-01-15 12:00:00", created_col="ts").select("event_id")


@query(f"select path, starts_with(upper(path), 'EN/SRC1') as in_cache from (select distinct path from ({DOC_FILES}))")
def q_in_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix test in any case that doesn't look for a separator."""
    return doc_files(spark, sf_dir).select("path").distinct().select("path", urls.in_cache(F.col("path"), F.lit("en/SRC1")).alias("in_cache"))


def _event_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as saved states of their users' profiles."""
    path = F.concat(F.lit("/home/u"), F.col("user_id").cast("string"), F.lit("//"))
    roots = F.array("event_type", F.upper("event_type"), F.lit(" "), F.lit("src"))
    exts = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(".TXT"), F.lit(".txt"), F.lit(".py")))
    return table(spark, sf_dir, "events").select(path.alias("path"), roots.alias("roots"), exts.alias("exts"), F.array(F.lit("a"), F.lit("a")).alias("ignore_ids"), F.col("ts").alias("updated_utc"), "event_id")


_LATEST = """latest as (select '/home/u' || user_id as path, arg_max(event_type, (ts, event_id)) as e, max(ts) as updated_utc, arg_max(event_id, (ts, event_id)) as event_id from events group by user_id)"""
_NORMAL = "path, [e, 'src'] as roots, case when event_id % 3 = 0 then ['.TXT', '.py'] else [] end as exts, ['a'] as ignore_ids, updated_utc"


@query(f"with {_LATEST} select {_NORMAL} from latest")
def q_profile_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.latest(profiles.normalise(_event_profiles(spark, sf_dir)), "event_id").drop("event_id")


@query(f"with {_LATEST} select path, updated_utc from latest order by updated_utc desc, path limit 20")
def q_profile_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 newest profiles: a top-k."""
    return profiles.prune(q_profile_latest(spark, sf_dir), 20).select("path", "updated_utc")


@query(f"with {_LATEST} select path, case when event_id % 2 = 0 then 'changed' else e end as root from latest")
def q_profile_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second profile is saved again and replaces the old one."""
    kept = profiles.latest(profiles.normalise(_event_profiles(spark, sf_dir)), "event_id")
    changes = kept.filter("event_id % 2 = 0").withColumn("roots", F.array(F.lit("changed")))
    return profiles.upsert(kept.drop("event_id"), changes.drop("event_id")).select("path", F.col("roots")[0].alias("root"))


@query(f"with {_LATEST} select path, e as root from latest where path in (select '/home/u' || user_id from events where value > 95)")
def q_profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profiles of the users who had an event of a great value."""
    asked = table(spark, sf_dir, "events").filter("value > 95").select(F.concat(F.lit("/home/u"), F.col("user_id").cast("string")).alias("path")).distinct()
    return q_profile_latest(spark, sf_dir).join(asked, "path", "left_semi").select("path", F.col("roots")[0].alias("root"))
