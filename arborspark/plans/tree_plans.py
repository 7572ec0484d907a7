"""Queries of tree order, rendering, selections, search, names and icons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions import paths
from arborspark.operators import presentation, render, search, selection, totals
from arborspark.plans.registry import query
from arborspark.plans.tables import DOC_FILES, GEO_FILES, PAGE_FILES, PART_FILES, doc_nodes, geo_nodes, nodes_sql, page_nodes, part_nodes, quoted
from arborspark.plans.text_plans import CHARS, TOKENS

_GEO, _PART, _DOC = f"with {nodes_sql(GEO_FILES)}", f"with {nodes_sql(PART_FILES)}", f"with {nodes_sql(DOC_FILES)}"
#: The key of a depth-first walk: each level's (file, upper-cased name, name).
_KEY = "list_transform(range(1, depth + 1), lambda i: {'f': case when i < depth or is_dir then 0 else 1 end, 'u': upper(string_split(path, '/')[i]), 'n': string_split(path, '/')[i]})"


@query(f"with {nodes_sql(PAGE_FILES)} select path, above, d::int as level from anc")
def q_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_nodes(spark, sf_dir).select("path", F.posexplode(paths.ancestors(F.col("path"))).alias("level", "above")).select("path", "above", (F.col("level") + 1).alias("level"))


@query(f"{_DOC} select parent, count(*) as n_children from nodes group by parent")
def q_child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.child_counts(doc_nodes(spark, sf_dir))


@query(f"{_DOC}, keyed as (select path, string_split(path, '/')[1] as root, {_KEY} as k from nodes) select root, path, row_number() over (partition by root order by k)::int as preorder from keyed")
def q_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each root folder's depth-first walk."""
    nodes = doc_nodes(spark, sf_dir).withColumn("root", paths.root_segment(F.col("path")))
    return render.pre_order(nodes, "root").select("root", "path", "preorder")


_SIBLINGS = "placed as (select *, row_number() over (partition by parent order by is_dir desc, upper(name), name) as position, lead(1) over (partition by parent order by is_dir desc, upper(name), name) is null as is_last from nodes)"
_LINES = f"""{_SIBLINGS},
indents as (select a.path, string_agg(case when p.is_last then '    ' else '│   ' end, '' order by a.d) as indent from anc a join placed p on p.path = a.above group by a.path),
lines as (select n.*, coalesce(i.indent, '') || case when n.is_last then '└── ' else '├── ' end || n.name as line from placed n left join indents i on i.path = n.path)"""
_DOCUMENT = f"tree as (select 'world:' || chr(10) || chr(10) || string_agg(line, chr(10) order by k) || chr(10) as t from (select line, {_KEY} as k from lines))"


@query(f"{_GEO}, {_LINES} select path, position::int as position, is_last, line from lines")
def q_ascii_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.ascii_lines(geo_nodes(spark, sf_dir)).select("path", "position", "is_last", "line")


@query(f"{_GEO}, {_LINES}, {_DOCUMENT} select t as tree from tree")
def q_ascii_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.ascii_tree(geo_nodes(spark, sf_dir), "world")


@query(f"{_GEO}, {_LINES}, {_DOCUMENT} select (length(t) - length(replace(t, chr(10), '')))::bigint as n_lines, {CHARS} as n_chars, {TOKENS} as n_tokens from tree")
def q_tree_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.text_totals(render.ascii_tree(geo_nodes(spark, sf_dir), "world"), "tree")


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by their numbers' last digits, and two nations."""
    nodes = geo_nodes(spark, sf_dir)
    return nodes.filter("(not is_dir and right(name, 1) in ('0', '3', '6', '9')) or name in ('NATION_4', 'NATION_9')").select("path")


_PICKED = "picked as (select path from nodes where (not is_dir and right(name, 1) in ('0', '3', '6', '9')) or name in ('NATION_4', 'NATION_9'))"
_KEPT = f"{_PICKED}, kept as (select * from nodes where path in (select path from picked union select above from anc where path in (select path from picked)))"


@query(f"{_GEO}, {_KEPT}, {_LINES.replace('from nodes)', 'from kept)')} select path, line from lines")
def q_ascii_tree_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last-sibling marks are those of the selection."""
    return render.ascii_lines(selection.selected_tree(geo_nodes(spark, sf_dir), _selected(spark, sf_dir))).select("path", "line")


@query(f"{_GEO}, {_LINES}, {_DOCUMENT} select t as tree, true as is_full from tree")
def q_tree_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection that meets nothing falls back to the full tree."""
    nodes = geo_nodes(spark, sf_dir)
    full = render.ascii_tree(nodes, "world").withColumnRenamed("tree", "full")
    none = render.ascii_tree(selection.selected_tree(nodes, spark.createDataFrame([("Nowhere",)], "path string")), "world")
    return full.join(none, F.lit(True), "left").select(render.tree_or_full(F.col("tree"), F.col("full")).alias("tree"), F.col("tree").isNull().alias("is_full"))


_ROWS = """select p as path, coalesce(list(name order by upper(name), name) filter (is_dir), []) as dirs, coalesce(list(name order by upper(name), name) filter (not is_dir), []) as files
    from (select parent as p, name, is_dir from {0} union all select path, null, null from {0} where is_dir) group by p"""


@query(f"{_PART} {_ROWS.format('nodes')}")
def q_json_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.directory_rows(part_nodes(spark, sf_dir))


@query(f"{_GEO}, {_KEPT} {_ROWS.format('kept')}")
def q_json_dirs_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.directory_rows(render.json_selected(geo_nodes(spark, sf_dir), _selected(spark, sf_dir)))


@query()
def q_json_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document for each region; tests parse it and compare it with a walk."""
    nodes = geo_nodes(spark, sf_dir)
    return render.json_tree(nodes.withColumn("region", paths.root_segment(F.col("path"))), "region")


@query(f"""{_GEO}, {_PICKED}, leaves as (select n.path, n.path in (select path from picked) as c from nodes n where n.path not in (select parent from nodes)),
up as (select path, c from leaves union all select a.above, l.c from leaves l join anc a on a.path = l.path)
select path, case when bool_and(c) then true when bool_or(c) then null else false end as is_checked from up group by path""")
def q_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.roll_up(geo_nodes(spark, sf_dir), _selected(spark, sf_dir))


_ASSIGNED = [("ASIA", True, 1), ("EUROPE", True, 2), ("ASIA/NATION_17", False, 3), ("EUROPE", None, 4), ("AFRICA/NATION_0", True, 5), ("AFRICA", False, 6), ("AFRICA/NATION_15", True, 7)]
_VALUES = ", ".join(f"({quoted(p)}, {'null' if v is None else str(v).lower()}::boolean, {at})" for p, v, at in _ASSIGNED)
_STATES = f"given(path, v, n) as (values {_VALUES}), self as (select path, path as above from nodes union all select path, above from anc), states as (select s.path, coalesce(arg_max(coalesce(g.v, false), g.n) filter (g.n is not null), false) as is_checked from self s left join given g on g.path = s.above group by s.path)"


@query(f"{_GEO}, {_STATES} select path, is_checked from states")
def q_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assignment sets a whole subtree; the latest wins."""
    return selection.propagate(geo_nodes(spark, sf_dir), spark.createDataFrame(_ASSIGNED, "path string, value boolean, at int"))


@query(f"{_GEO}, {_STATES} select bool_or(is_checked) as any_checked from states")
def q_any_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.any_checked(q_propagate(spark, sf_dir))


@query(f"{_GEO}, {_PICKED} select path from nodes where not is_dir and path in (select path from picked)")
def q_selection_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.selected_files(geo_nodes(spark, sf_dir), _selected(spark, sf_dir)).select("path")


@query(f"{_GEO}, {_PICKED} select string_split(path, '/')[1] as region, sha256(string_agg(path, chr(10) order by path)) as path_hash from (select distinct path from picked) group by region")
def q_selection_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.selection_hash(_selected(spark, sf_dir).withColumn("region", paths.root_segment(F.col("path"))), "region")


_FOUND = f"found as (select path, is_dir, string_split(path, '/')[1] as root, {_KEY} as k from nodes where contains(upper(name), 'GEAR_1'))"


@query(f"{_PART}, {_FOUND} select root, path, (row_number() over (partition by root order by k) - 1)::int as match from found")
def q_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = part_nodes(spark, sf_dir).withColumn("root", paths.root_segment(F.col("path")))
    return search.find(nodes, "gear_1", "root").select("root", "path", "match")


@query(f"{_PART} select path from nodes where contains(name, 'Brand#2')")
def q_search_case_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find(part_nodes(spark, sf_dir).withColumn("root", paths.root_segment(F.col("path"))), "Brand#2", "root", case_sensitive=True).select("path")


def _expansion(may: str) -> str:
    return f"""{_PART}, hits as (select path from nodes where contains(upper(name), 'GEAR')), under as (select distinct above as path from anc where path in (select path from hits))
select path, case when path in (select path from under) then 'expand' when path not in (select path from hits) and {may} then 'collapse' else 'unchanged' end as action from nodes"""


@query(_expansion("path in (select parent from nodes)"))
def q_search_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.expansion(part_nodes(spark, sf_dir), "gear")


@query(_expansion("true"))
def q_filter_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.expansion(part_nodes(spark, sf_dir), "gear", filtering=True)


@query(f"""{_PART} select path, not contains(path, '/') and false as collapsed, path = 'Brand#7' or starts_with(path, 'Brand#7/') as subtree, starts_with('Brand#7/ECONOMY/x', path || '/') as reveals from nodes""")
def q_expand_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = part_nodes(spark, sf_dir)
    a = search.collapse_all_but_root(nodes).withColumnRenamed("expanded", "collapsed")
    b = search.expand_subtree(nodes, "Brand#7").withColumnRenamed("expanded", "subtree")
    c = search.reveal(nodes, "Brand#7/ECONOMY/x").withColumnRenamed("expanded", "reveals")
    return a.join(b, "path").join(c, "path")


@query(f"{_PART}, {_FOUND}, numbered as (select path, row_number() over (partition by root order by k) - 1 as m, count(*) over (partition by root) as n from found) select path, ((m + 1) % n)::int as next, ((m - 1 + n) % n)::int as previous from numbered")
def q_match_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = part_nodes(spark, sf_dir).withColumn("root", paths.root_segment(F.col("path")))
    found = search.find(nodes, "gear_1", "root")
    counted = found.join(found.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root")
    return counted.select("path", search.cursor(F.col("match"), 1, F.col("n")).cast("int").alias("next"), search.cursor(F.col("match"), -1, F.col("n")).cast("int").alias("previous"))


@query("select p_partkey, regexp_replace(p_name, '(er)', '<\\1>', 'gi') as marked from part")
def q_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of each name that match 'er' and that don't, put together with marks around the matching ones."""
    runs = F.transform(search.highlight(F.col("p_name"), "er"), lambda x: F.when(x["is_match"], F.concat(F.lit("<"), x["text"], F.lit(">"))).otherwise(x["text"]))
    from arborspark.plans.tables import table

    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(runs, "").alias("marked"))


_ICONS = ", ".join(f"({quoted(w)}, {quoted(i)})" for i, ws in presentation.BY_NAME.items() for w in ws.split())
_ICON_EXTENSIONS = ", ".join(f"({quoted(w)}, {quoted(i)})" for i, ws in presentation.BY_EXTENSION.items() for w in ws.split())


@query(f"""{_DOC}, n(word, icon) as (values {_ICONS}), x(word, icon) as (values {_ICON_EXTENSIONS})
select path, case when is_dir then case when lower(name) in ({', '.join(map(quoted, presentation.GRAY_FOLDERS))}) then 'grayFolder' else 'folder' end else coalesce(n.icon, x.icon, 'unknownFile') end as icon_key
from nodes left join n on n.word = lower(name) left join x on x.word = regexp_extract(lower(name), '\\.([^.]+)$', 1)""")
def q_icon_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presentation.with_icons(doc_nodes(spark, sf_dir)).select("path", "icon_key")


@query(f"{_DOC} select path, case when is_dir and name = 'build' then '[access denied]' when path = 'de' then '[access denied to root]' else name end as shown, case when path = 'fr' then 'France' else name end as label, case when name = 'docs' then 'Documents' else '[[' || name || ']]' end as title from nodes")
def q_display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    def is_at(path: str) -> Column:
        return F.col("path") == path

    denied = (F.col("is_dir") & (F.col("name") == "build")) | is_at("de")
    override = F.when(is_at("fr"), "France").when(is_at("en"), "  ")
    title = presentation.lookup(F.when(F.col("name") == "docs", "Documents"), F.col("name"))
    return doc_nodes(spark, sf_dir).select("path", presentation.display_name(F.col("name"), denied, is_at("de")).alias("shown"), presentation.root_label(F.col("name"), override).alias("label"), title.alias("title"))
