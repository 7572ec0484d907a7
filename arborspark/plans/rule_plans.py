"""Queries of ignore rules, scopes and visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions import paths
from arborspark.functions.globs import compile_rules
from arborspark.operators import scopes, smart, totals, visibility
from arborspark.operators.visibility import Options, Scope
from arborspark.plans.registry import query
from arborspark.plans.tables import DOC_FILES, IGNORED, PAGE_FILES, doc_files, doc_nodes, nodes_sql, page_files, page_nodes, quoted, rules_sql
from arborspark.plans.text_plans import CHARS, TRAILING

PLAIN = ["# hosts and leaves", "*.example.net", "4??", "/blog.*/fr/", "**/es/1*", "[a-c]*", ""]
NEGATING = ["*.example.org", "9?", "*7", "fr/", "!*77", "!www.*/en/9*", "/m.*/de/**", "!/m.*/de/3*"]
WORKSPACE = ["build/", "*.log", ".cache/", "*.MD", "!docs/*.MD", "!keep_*.txt", "img_*"]
PROBED = ["**/docs/*", "*/*/bin/**", "/de/src1/*.csproj"]


def _nodes(files: str, lines: list[str]) -> str:
    return f"with {nodes_sql(files)}, {rules_sql(compile_rules(lines))}, {IGNORED}"


def _ignored(nodes: DataFrame, lines: list[str]) -> DataFrame:
    return nodes.select("path", "is_dir", visibility.is_ignored(compile_rules(lines), F.col("path"), F.col("name"), F.col("is_dir")).alias("ignored"))


@query(f"{_nodes(PAGE_FILES, PLAIN)} select path, is_dir, ignored from ignored where not is_dir")
def q_gitignore_last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ignored(page_nodes(spark, sf_dir).filter("not is_dir"), PLAIN)


@query(f"{_nodes(PAGE_FILES, NEGATING)} select path, is_dir, ignored from ignored")
def q_gitignore_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ignored(page_nodes(spark, sf_dir), NEGATING)


@query(f"{_nodes(DOC_FILES, PROBED)} select path, is_dir, ignored from ignored where is_dir")
def q_gitignore_dir_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories whose every entry some rule ignores count as ignored."""
    return _ignored(doc_nodes(spark, sf_dir).filter("is_dir"), PROBED)


@query(f"{_nodes(PAGE_FILES, NEGATING)} select path, traversable from reach")
def q_gitignore_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_nodes(spark, sf_dir).filter("is_dir").select("path", visibility.may_traverse(compile_rules(NEGATING), F.col("path")).alias("traversable"))


#: Scopes of the workspace of documents, nested ones included.
ROOTS = ["de", "de/src1", "de/src10", "en", "en/src5", "fr/src3", "fr/src3/docs"]
_SCOPES = f"scopes(root_path) as (values {', '.join(f'({quoted(r)})' for r in ROOTS)})"
_SCOPED = f"with {nodes_sql(DOC_FILES)}, {_SCOPES} select n.path, arg_max(s.root_path, length(s.root_path)) as scope_root from nodes n left join scopes s on n.path = s.root_path or starts_with(n.path, s.root_path || '/') group by n.path"


@query(_SCOPED)
def q_scope_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest scope above each node, with the scopes in the plan."""
    return doc_nodes(spark, sf_dir).select("path", visibility.scope_of(F.col("path"), ROOTS).alias("scope_root"))


@query(_SCOPED)
def q_scope_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with scopes in a table of any size."""
    return visibility.scope_table(doc_nodes(spark, sf_dir), spark.createDataFrame([(r,) for r in ROOTS], "root_path string"))


_LIST = lambda xs: ", ".join(map(quoted, xs))
_FLAGS = f"""flags as (select d.path as root_path, coalesce(bool_or(f.name = '.gitignore'), false) as has_gitignore,
    coalesce(bool_or(f.name in ({_LIST(scopes.MARKERS)}) or lower(regexp_extract(f.name, '(\\.[^.]+)$', 1)) in ({_LIST(scopes.MARKER_EXTENSIONS)})), false) as has_marker
    from (select path from nodes where is_dir union all select '') d left join (select * from nodes where not is_dir) f on f.parent = d.path group by d.path),
placed as (select *, has_gitignore or has_marker as looks_like_project, case when root_path = '' then 0 else len(string_split(root_path, '/')) end as d from flags)"""


def _discovered(selected: list[str] | None) -> str:
    chosen = "true" if selected is None else f"root_path in ({_LIST(selected)})"
    return f"""with {nodes_sql(DOC_FILES)}, {_FLAGS},
first as (select * from placed where d = 1 and {chosen}),
below as (select p.*, row_number() over (partition by f.root_path order by p.d, upper(p.root_path), p.root_path) as n from placed p join first f on not f.looks_like_project and starts_with(p.root_path, f.root_path || '/') where p.d between 2 and 3),
found as (select root_path, has_gitignore, has_marker, looks_like_project from first union all select root_path, has_gitignore, has_marker, looks_like_project from below where n <= 256 and looks_like_project),
single as (select (select looks_like_project from placed where root_path = '') or (select count(*) from found) = 0 or ({str(selected is None).lower()} and not (select bool_or(looks_like_project) from found)) as one),
scopes as (select root_path, has_gitignore, has_marker, looks_like_project from placed where root_path = '' and (select one from single) union all select * from found where not (select one from single))"""


@query(f"{_discovered(None)} select * from scopes")
def q_scope_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.discover(doc_nodes(spark, sf_dir))


@query(f"{_discovered(['de', 'es'])} select * from scopes")
def q_scope_discovery_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.discover(doc_nodes(spark, sf_dir), ["de", "es"])


@query(f"""{_discovered(None)} select count(*) as n_scopes, count(*) = 1 and coalesce(bool_or(has_gitignore), false) as single_with_git, coalesce(bool_or(has_gitignore), false) as any_with_git, coalesce(bool_or(not has_gitignore), false) as any_without_git,
    coalesce(bool_or(has_gitignore), false) as git_available, not (count(*) = 1 and coalesce(bool_or(has_gitignore), false)) and coalesce(bool_or(not has_gitignore), false) as smart_available from scopes""")
def q_scope_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.context(scopes.discover(doc_nodes(spark, sf_dir)))


_ALL_FOLDERS = sorted({f for _, _, folders in smart.ECOSYSTEMS.values() for f in folders})


@query(f"""{_discovered(None)} select not (count(*) = 1 and coalesce(bool_or(has_gitignore), false)) and coalesce(bool_or(not has_gitignore), false)
    and coalesce(bool_or(not has_gitignore and (has_marker or exists (select 1 from nodes where is_dir and parent = root_path and lower(name) in ({_LIST(_ALL_FOLDERS)})))), false) as offered from scopes""")
def q_smart_offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = doc_nodes(spark, sf_dir)
    return scopes.smart_offered(scopes.discover(nodes), nodes, _ALL_FOLDERS)


_DIMENSION = ", ".join(f"({quoted(m)}, {str(ext).lower()}, {quoted(f)})" for names, exts, folders in smart.ECOSYSTEMS.values() for ms, ext in ((names, False), (exts, True)) for m in ms for f in folders)
_MARKED = f"dim(marker, is_extension, folder) as (values {_DIMENSION}), marked as (select distinct f.parent, folder from nodes f join dim on not f.is_dir and case when is_extension then lower(regexp_extract(name, '(\\.[^.]+)$', 1)) = marker else name = marker end)"


@query(f"with {nodes_sql(DOC_FILES)}, {_MARKED} select parent, folder from marked")
def q_smart_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smart.smart_folders(doc_files(spark, sf_dir))


@query(f"with {nodes_sql(DOC_FILES)}, {_MARKED} select distinct folder from marked")
def q_smart_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that the markers of any directory hide in all of them."""
    return smart.smart_folders(doc_files(spark, sf_dir)).select("folder").distinct()


OPTIONS = Options((Scope.of("", WORKSPACE),), frozenset({"node_modules", "bin"}), frozenset({"thumbs.db"}), use_smart=True, hidden_files=True, dot_folders=True, extensions=frozenset({".txt", ".py", ".md", ".log", ".csproj"}), root_folders=frozenset({"de", "FR", "en"}))
#: The skips of OPTIONS in SQL, by node, then what a walk visits.
_WALK = """skips as (select n.path, n.is_dir, case when n.is_dir then (i.ignored and not coalesce(r.traversable, false)) or lower(n.name) in ('node_modules', 'bin') or starts_with(n.name, '.')
    else i.ignored or lower(n.name) = 'thumbs.db' or starts_with(n.name, '.') end as skip
    from nodes n join ignored i on i.path = n.path left join reach r on r.path = n.path),
pruned as (select n.* from nodes n join skips s on s.path = n.path where not s.skip
    and not exists (select 1 from anc a join skips x on x.path = a.above and x.is_dir where a.path = n.path and x.skip)
    and (n.is_dir or not regexp_matches(n.name, '\\.[^.]+$') or upper(regexp_extract(n.name, '(\\.[^.]+)$', 1)) in ('.TXT', '.PY', '.MD', '.LOG', '.CSPROJ'))
    and ((n.depth = 1 and not n.is_dir) or upper(string_split(n.path, '/')[1]) in ('DE', 'FR', 'EN')))"""
_COLUMNS = "path, name, parent, depth, is_dir, false as access_denied"


@query(f"{_nodes(DOC_FILES, WORKSPACE)}, {_WALK} select {_COLUMNS} from pruned")
def q_pruned_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.pruned(doc_nodes(spark, sf_dir), OPTIONS)


@query(f"""{_nodes(DOC_FILES, WORKSPACE)}, {_WALK},
probed as (select p.path, bool_or(regexp_matches(case when by_name then '_probe_' else p.path || '/_probe_' end, regex)) as any_hit,
    coalesce(arg_max(not negated, ord) filter (regexp_matches(case when by_name then '_probe_' else p.path || '/_probe_' end, regex)), false) as hit from pruned p, rules where p.is_dir group by p.path),
solid as (select p.* from pruned p left join ignored i on i.path = p.path left join probed q on q.path = p.path where not p.is_dir or not (i.ignored or q.hit))
select {_COLUMNS} from pruned where path in (select path from solid union select above from anc where path in (select path from solid))""")
def q_visible_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered tree: ignored directories in which nothing is left are gone."""
    return visibility.visible(doc_nodes(spark, sf_dir), OPTIONS)


@query(f"""{_nodes(DOC_FILES, WORKSPACE)}, {_WALK}, keep as (select path from pruned where contains(upper(name), '_1'))
select {_COLUMNS} from pruned where path in (select path from keep union select above from anc where path in (select path from keep))""")
def q_name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.visible(doc_nodes(spark, sf_dir), Options(**{**OPTIONS.__dict__, "name_filter": "_1"}))


@query(f"with {nodes_sql(DOC_FILES)} select path from nodes where not is_dir and (not regexp_matches(name, '\\.[^.]+$') or upper(regexp_extract(name, '(\\.[^.]+)$', 1)) in ('.MD', '.CSPROJ'))")
def q_ext_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = Options(extensions=frozenset({".md", ".CSPROJ"}))
    return visibility.pruned(doc_nodes(spark, sf_dir), options).filter("not is_dir").select("path")


@query(f"with {nodes_sql(DOC_FILES)} select path from nodes where not is_dir and not regexp_matches(name, '\\.[^.]+$')")
def q_ext_allow_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No extension allowed: files without one stay."""
    return visibility.pruned(doc_nodes(spark, sf_dir), Options(extensions=frozenset())).filter("not is_dir").select("path")


@query(f"with {nodes_sql(DOC_FILES)} select path, is_dir from nodes where (depth = 1 and not is_dir) or upper(string_split(path, '/')[1]) = 'ES'")
def q_root_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.pruned(doc_nodes(spark, sf_dir), Options(root_folders=frozenset({"es"}))).select("path", "is_dir")


@query(f"with {nodes_sql(DOC_FILES)} select path from nodes where not is_dir and trim(name) <> '' and not regexp_matches(name, '\\.[^.]+$')")
def q_extensionless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_nodes(spark, sf_dir).filter("not is_dir").filter(paths.is_extensionless(F.col("name"))).select("path")


VISIBLE_PAGES = Options((Scope.of("", NEGATING),), frozenset({"de"}), use_smart=True, dot_files=True)


@query(f"""{_nodes(PAGE_FILES, NEGATING)},
skips as (select n.path, case when n.is_dir then (i.ignored and not coalesce(r.traversable, false)) or lower(n.name) = 'de' else i.ignored or starts_with(n.name, '.') end as skip from nodes n join ignored i on i.path = n.path left join reach r on r.path = n.path),
shown as (select n.path from nodes n join skips s on s.path = n.path where not n.is_dir and not s.skip and not exists (select 1 from anc a join skips x on x.path = a.above where a.path = n.path and x.skip)),
sized as (select string_split(f.path, '/')[1] as host, length(f.path) as p, html as t from (select path, arg_min(html, page_id) as html from files group by path) f join shown on shown.path = f.path),
terms as (select host, p + 4 + 1 + greatest(0, {CHARS} - length({TRAILING})) as c, 3 + greatest(0, length(t) - length(replace(t, chr(10), '')) - (length({TRAILING}) - length(replace({TRAILING}, chr(10), '')))) as b from sized),
sums as (select host, count(*) as n_files, sum(c)::bigint as c, sum(b)::bigint as b from terms group by host)
select host, n_files, (b + (n_files - 1) * 2)::bigint as n_lines, (c + (n_files - 1) * 4 - 1)::bigint as n_chars, ceil((c + (n_files - 1) * 4 - 1) / 4.0)::bigint as n_tokens from sums""")
def q_visible_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export of each host's visible pages would cost; without rendering, and with one shuffle for repeated paths and one for hosts."""
    path = F.col("path")
    keep = ~visibility.skips_file(VISIBLE_PAGES, path) & visibility.reachable(VISIBLE_PAGES, path)
    files = totals.measured(page_files(spark, sf_dir).filter(keep).select("path", "page_id", F.col("html").alias("text"))).drop("text")
    return totals.content_totals(totals.first_of_each_path(files, "page_id").withColumn("host", paths.root_segment(path)), "host")
