"""Queries for the lineage, schema, impact and log operators, over tables derived from the given ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sidewise.operators import histogram, impact, lineage, profile, results, rowcount, schema, topk, valuediff
from sidewise.operators.querydiff import query_diff
from sidewise.operators.selection import LineageGraph
from sidewise.plans.sides import BASE, CURRENT
from sidewise.plans.storage import cut, shared_path, stored
from sidewise.sources.artifacts import ArtifactTables, load_artifact_tables, write_artifacts
from workload.queries import ALL_CURRENT, COUNTS_SQL, _impact_sql, pair, query
from workload.tables import NAMES, derived, environments

CHANGED_CUSTOMERS = "select node_id from lineage_diff_t where node_id like 'customer.%'"


def _reach(seeds: str, edges: str, source: str, target: str, degree: int | None = None) -> str:
    """Recursive text for ``reach(id)``, or ``reach(id, degree)`` with every distance up to ``degree``."""
    if degree is None:
        return f"reach(id) as ({seeds} union select e.{target} from {edges} e join reach r on e.{source} = r.id)"
    return f"""reach(id, degree) as (select x.*, 0 from ({seeds}) x
        union select e.{target}, r.degree + 1 from {edges} e join reach r on e.{source} = r.id where r.degree < {degree})"""


# Comparison and closure of the node graph


@query("select * from lineage_diff_t", "lineage_diff_t")
def lineage_diff_rows(spark, folder):
    (nodes,) = derived(spark, folder, "nodes_t")
    return lineage.lineage_diff(nodes)


@query(
    """, sides as (select node_id, env, max(name) as name, max(schema_name) as schema_name from nodes_t group by 1, 2)
    select coalesce(c.node_id, b.node_id) as node_id, case when c.node_id is null then b.name else c.name end as name,
        case when c.node_id is null then b.schema_name else c.schema_name end as schema_name,
        case when b.schema_name <> c.schema_name then b.schema_name end as base_schema, d.change_status
    from (select * from sides where env = 'base') b
    full outer join (select * from sides where env = 'current') c on b.node_id = c.node_id
    left join lineage_diff_t d on d.node_id = coalesce(c.node_id, b.node_id)""",
    "nodes_t lineage_diff_t",
)
def merged_nodes_rows(spark, folder):
    (nodes,) = derived(spark, folder, "nodes_t")
    return lineage.merged_nodes(nodes).select("node_id", "name", "schema_name", "base_schema", "change_status")


@query(
    """select coalesce(b.parent_id, c.parent_id) as parent_id, coalesce(b.child_id, c.child_id) as child_id,
        case when b.parent_id is null then 'added' when c.parent_id is null then 'removed' end as change_status
    from (select distinct parent_id, child_id from edges_t where env = 'base') b
    full outer join (select distinct parent_id, child_id from edges_t where env = 'current') c
        on b.parent_id = c.parent_id and b.child_id = c.child_id
    where coalesce(b.parent_id, c.parent_id) in (select node_id from nodes_t)
      and coalesce(b.child_id, c.child_id) in (select node_id from nodes_t)""",
    "edges_t nodes_t",
)
def merged_edges_rows(spark, folder):
    edges, nodes = derived(spark, folder, "edges_t", "nodes_t", by_child=True)
    return lineage.merged_edges(edges, nodes, by_child=True)


@query(
    ", " + _reach("select node_id from lineage_diff_t where node_id like 'order.%'", "edges_t", "child_id", "parent_id")
    + " select distinct id as node_id from reach",
    "edges_t lineage_diff_t",
)
def upstream_of_changed_orders(spark, folder):
    edges, changes = derived(spark, folder, "edges_t", "lineage_diff_t")
    return lineage.upstream(edges, changes.filter("node_id like 'order.%'")).select("node_id")


@query(
    ", " + _reach(CHANGED_CUSTOMERS, "edges_t", "parent_id", "child_id") + " select distinct id as node_id from reach",
    "edges_t lineage_diff_t",
)
def downstream_of_changed_customers(spark, folder):
    edges, changes = derived(spark, folder, "edges_t", "lineage_diff_t")
    return lineage.downstream(edges, changes.filter("node_id like 'customer.%'")).select("node_id")


@query(
    ", " + _reach("select node_id from nodes_t where resource_type = 'source'", "edges_t", "parent_id", "child_id", 2)
    + " select id as node_id, cast(min(degree) as int) as degree from reach group by id",
    "edges_t nodes_t",
)
def downstream_bounded(spark, folder):
    edges, nodes = derived(spark, folder, "edges_t", "nodes_t")
    sources = nodes.filter("resource_type = 'source'")
    return lineage.downstream(edges, sources, max_degree=2)


@query(
    ", " + _reach("select node_id from node_changes_t where category = 'breaking'", "edges_t", "parent_id", "child_id")
    + """ select distinct id as node_id, id in (select node_id from node_changes_t where category = 'breaking') as is_changed
    from reach""",
    "edges_t node_changes_t",
)
def whole_model_impact_rows(spark, folder):
    edges, changes = derived(spark, folder, "edges_t", "node_changes_t")
    return lineage.whole_model_impact(edges, changes)


# Column lineage

_PAIR_EDGES = """e as (select concat(parent_node, '|', coalesce(parent_column, '')) as p,
    concat(child_node, '|', coalesce(child_column, '')) as c from col_edges_t)"""


def _pairs(name: str = "reach") -> str:
    return f"select split_part(id, '|', 1) as node_id, nullif(split_part(id, '|', 2), '') as column_name from {name}"


@query(
    f""", {_PAIR_EDGES},
    up(id) as (select 'order.7|line_1' union select e.p from e join up r on e.c = r.id),
    down(id) as (select 'order.7|line_1' union select e.c from e join down r on e.p = r.id)
    select node_id, column_name, case when node_id = 'order.7' and column_name = 'line_1' then 'self' else d end as direction
    from (select distinct *, 'up' as d from ({_pairs('up')}) u union select distinct *, 'down' from ({_pairs('down')}) v) w
    where column_name is not null and not (d = 'down' and node_id = 'order.7' and column_name = 'line_1')""",
    "col_edges_t",
)
def column_lineage_up(spark, folder):
    (edges,) = derived(spark, folder, "col_edges_t")
    return lineage.column_lineage(edges, "order.7", "line_1").drop("degree")


@query(
    f""", {_PAIR_EDGES},
    down(id) as (select 'part.5|p_retailprice' union select e.c from e join down r on e.p = r.id)
    select node_id, column_name, case when node_id = 'part.5' then 'self' else 'down' end as direction
    from (select distinct * from ({_pairs('down')}) v) w where column_name is not null""",
    "col_edges_t",
)
def column_lineage_down(spark, folder):
    (edges,) = derived(spark, folder, "col_edges_t")
    return lineage.column_lineage(edges, "part.5", "p_retailprice").drop("degree")


_CHANGED_COLUMNS = "select concat(node_id, '|', column_name) from column_changes_t"
_IMPACTED = f"""{_PAIR_EDGES}, hit(id) as ({_CHANGED_COLUMNS} union select e.c from e join hit r on e.p = r.id),
    impacted as (select * from (select distinct * from ({_pairs('hit')}) h) i where column_name is not null)"""


@query(f", {_IMPACTED} select * from impacted", "col_edges_t column_changes_t")
def impacted_columns_rows(spark, folder):
    edges, changes = derived(spark, folder, "col_edges_t", "column_changes_t")
    return lineage.impacted_columns(edges, changes)


def _radius_sql(node_only: bool, result: str | None = None) -> str:
    categories = "'breaking', 'unknown'" + (", 'partial_breaking'" if node_only else "")
    edge_filter = "where parent_column is null and child_column is null" if node_only else ""
    return f""", e as (select distinct concat(parent_node, '|', coalesce(parent_column, '')) as p,
        concat(child_node, '|', coalesce(child_column, '')) as c from col_edges_t {edge_filter}),
    anchors as (
        select concat(node_id, '|') as id from node_changes_t
        where change_status = 'added' or (change_status = 'modified' and category in ({categories}))
        union select concat(c.node_id, '|', c.column_name) from columns_t c join node_changes_t n on c.node_id = n.node_id
        where c.env = 'current' and n.change_status = 'added'
        union select concat(c.node_id, '|', c.column_name) from column_changes_t c join node_changes_t n on c.node_id = n.node_id
        where n.change_status = 'modified' and n.category is not null),
    up(id) as (select id from anchors union select e.p from e join up r on e.c = r.id),
    down(id) as (select id from anchors union select e.c from e join down r on e.p = r.id),
    reach as (select id from up union select id from down){"" if result else ","}
    {result or _radius_rows_sql(node_only)}"""


def _radius_rows_sql(node_only: bool) -> str:
    return f"""hits as (select distinct * from ({_pairs()}) h),
    node_rows as (select n.node_id, cast(null as varchar) as column_name,
            n.node_id in (select node_id from hits where column_name is null) as impacted
        from (select distinct node_id from nodes_t) n
        where n.node_id in (select node_id from hits where column_name is null)
           or n.node_id in (select node_id from node_changes_t where change_status = 'removed'
                            or (change_status = 'modified' and category is not null)))
    select * from node_rows""" + (
        ""
        if node_only
        else """ union all
    select distinct c.node_id, c.column_name, true from columns_t c join hits h on c.node_id = h.node_id and c.column_name = h.column_name"""
    )


_RADIUS = "nodes_t columns_t col_edges_t node_changes_t column_changes_t"


@query(_radius_sql(False), _RADIUS)
def impact_radius_rows(spark, folder):
    return lineage.impact_radius(*derived(spark, folder, *_RADIUS.split()))


@query(_radius_sql(True), _RADIUS)
def impact_radius_node_only(spark, folder):
    return lineage.impact_radius(*derived(spark, folder, *_RADIUS.split()), node_only=True)


# The radius of one node or column, and the edges kept


def _anchored_sql(anchors: str, result: str, edge_filter: str = "") -> str:
    """``hits``: everything within reach of ``anchors``; ``result`` is the final select."""
    return f""", e as (select distinct concat(parent_node, '|', coalesce(parent_column, '')) as p,
        concat(child_node, '|', coalesce(child_column, '')) as c from col_edges_t {edge_filter}),
    anchors as ({anchors}),
    up(id) as (select id from anchors union select e.p from e join up r on e.c = r.id),
    down(id) as (select id from anchors union select e.c from e join down r on e.p = r.id),
    reach as (select id from up union select id from down),
    hits as (select distinct * from ({_pairs()}) h)
    {result}"""


def _vertices_sql(impacted: str = "cast(null as boolean)", kept: str = "select null") -> str:
    of_columns = impacted if impacted.startswith("cast") else "true"
    return f"""select n.node_id, cast(null as varchar) as column_name, {impacted} as impacted
        from (select distinct node_id from nodes_t) n
        where n.node_id in (select node_id from hits where column_name is null) or n.node_id in ({kept})
        union all select distinct c.node_id, c.column_name, {of_columns}
        from columns_t c join hits h on c.node_id = h.node_id and c.column_name = h.column_name"""


_EDGES_SQL = """select split_part(p, '|', 1) as parent_node, nullif(split_part(p, '|', 2), '') as parent_column,
    split_part(c, '|', 1) as child_node, nullif(split_part(c, '|', 2), '') as child_column,
    (p in (select id from up) and c in (select id from up)) or (p in (select id from down) and c in (select id from down)) as on_path
    from e where p in (select id from reach) and c in (select id from reach)"""
_NODE_ANCHORS = """select 'customer.7|' as id
    union select concat(node_id, '|', column_name) from columns_t where env = 'current' and node_id = 'customer.7'"""
_COLUMN_ANCHORS = "select 'part.5|p_retailprice' as id"
_OWN_CHANGE = "select * from node_changes_t where node_id = 'customer.11' and change_status = 'modified' and category is not null"
_CHANGE_ANCHORS = f"""select 'customer.11|' as id where not exists ({_OWN_CHANGE})
    union select concat(node_id, '|') from ({_OWN_CHANGE}) o where category in ('breaking', 'unknown')
    union select concat(node_id, '|', column_name) from column_changes_t where node_id in (select node_id from ({_OWN_CHANGE}) o)"""
_ANCHORED = "nodes_t columns_t col_edges_t"


def _radius_of(spark, folder, node_id, column_name=None):
    return lineage.radius_of(*derived(spark, folder, *_ANCHORED.split()), node_id, column_name)


@query(_anchored_sql(_NODE_ANCHORS, _vertices_sql()), _ANCHORED)
def radius_of_node_vertices(spark, folder):
    return _radius_of(spark, folder, "customer.7").vertices


@query(_anchored_sql(_NODE_ANCHORS, _EDGES_SQL), _ANCHORED)
def radius_of_node_edges(spark, folder):
    return _radius_of(spark, folder, "customer.7").edges


@query(_anchored_sql(_COLUMN_ANCHORS, _vertices_sql()), _ANCHORED)
def radius_of_column_vertices(spark, folder):
    return _radius_of(spark, folder, "part.5", "p_retailprice").vertices


@query(_anchored_sql(_COLUMN_ANCHORS, _EDGES_SQL), _ANCHORED)
def radius_of_column_edges(spark, folder):
    return _radius_of(spark, folder, "part.5", "p_retailprice").edges


@query(
    _anchored_sql(
        _CHANGE_ANCHORS,
        _vertices_sql("n.node_id in (select split_part(id, '|', 1) from reach where id like '%|')", f"select node_id from ({_OWN_CHANGE}) o"),
    ),
    f"{_ANCHORED} node_changes_t column_changes_t",
)
def radius_of_changed_node_vertices(spark, folder):
    *tables, nodes, columns = derived(spark, folder, *_ANCHORED.split(), "node_changes_t", "column_changes_t")
    return lineage.radius_of(*tables, "customer.11", None, nodes, columns).vertices


@query(
    _anchored_sql(
        "select 'order.7|' as id", _EDGES_SQL, "where parent_column is null and child_column is null"
    ),
    _ANCHORED,
)
def radius_of_node_only_edges(spark, folder):
    return lineage.radius_of(*derived(spark, folder, *_ANCHORED.split()), "order.7", node_only=True).edges


@query(_radius_sql(False, _EDGES_SQL), _RADIUS)
def impact_radius_edges(spark, folder):
    tables = derived(spark, folder, *_RADIUS.split(), stored=("node_changes_t",), by_child=True)
    return lineage.impact_radius_graph(*tables).edges


@query(
    f""", {_IMPACTED} select n.node_id, n.node_id in (select node_id from node_changes_t) or n.node_id like 'nation.1%'
        or n.node_id in (select node_id from impacted) as impacted
    from (select distinct node_id from nodes_t) n""",
    "nodes_t node_changes_t col_edges_t column_changes_t",
)
def node_impacted_rows(spark, folder):
    nodes, changes, edges, columns = derived(
        spark, folder, "nodes_t", "node_changes_t", "col_edges_t", "column_changes_t"
    )
    flags = nodes.select("node_id", F.col("node_id").like("nation.1%").alias("impacted")).distinct()
    return lineage.node_impacted(nodes, changes, flags, lineage.impacted_columns(edges, columns))


@query(
    """select distinct child_node as node_id, cast(null as varchar) as column_name from col_edges_t
    where parent_node = 'supplier.3' and (parent_column is null) = (child_column is null)
    union select child_node, child_column from col_edges_t where parent_node = 'supplier.3' and parent_column is not null and child_column is not null""",
    "col_edges_t",
)
def direct_downstream_rows(spark, folder):
    (edges,) = derived(spark, folder, "col_edges_t")
    return lineage.direct_downstream(edges, "supplier.3")


@query(
    """select node_id, node_id like '%7' or coalesce(category = 'partial_breaking', false) or change_status = 'removed' as impacting,
        node_id like '%7' as impacted from node_changes_t""",
    "node_changes_t",
)
def impact_sets_rows(spark, folder):
    (changes,) = derived(spark, folder, "node_changes_t")
    return lineage.impact_sets(changes.withColumn("impacted", F.col("node_id").like("%7")))


@query(
    """select n.env, n.node_id, c.change_status, c.category from nodes_t n left join node_changes_t c on n.node_id = c.node_id""",
    "nodes_t node_changes_t",
)
def annotate_nodes(spark, folder):
    tables = derived(spark, folder, "nodes_t", "columns_t", "node_changes_t", "column_changes_t")
    return lineage.annotate_changes(*tables)[0].select("env", "node_id", "change_status", "category")


@query(
    """select c.env, c.node_id, c.column_name, case when n.change_status in ('added', 'removed') then n.change_status
        when n.change_status is not null then d.change_status end as change_status
    from columns_t c left join node_changes_t n on c.node_id = n.node_id
    left join column_changes_t d on c.node_id = d.node_id and c.column_name = d.column_name""",
    "columns_t node_changes_t column_changes_t",
)
def annotate_columns(spark, folder):
    tables = derived(spark, folder, "nodes_t", "columns_t", "node_changes_t", "column_changes_t")
    return lineage.annotate_changes(*tables)[1].select("env", "node_id", "column_name", "change_status")


@query(
    """select c.env, c.node_id, c.column_name, coalesce(bool_or(t.test_type = 'not_null'), false) as not_null,
        coalesce(bool_or(t.test_type = 'unique'), false) as "unique"
    from columns_t c left join node_tests_t t on c.env = t.env and c.node_id = t.node_id and c.column_name = t.column_name
    group by 1, 2, 3""",
    "columns_t node_tests_t",
)
def column_constraints_rows(spark, folder):
    columns, tests = derived(spark, folder, "columns_t", "node_tests_t")
    flagged = lineage.column_constraints(columns, tests)
    return flagged.select("env", "node_id", "column_name", "not_null", "unique")


@query(
    """select env, node_id, column_name as primary_key from (
        select c.env, c.node_id, c.column_name, row_number() over (partition by c.env, c.node_id order by c.ordinal) as n
        from columns_t c join node_tests_t t on c.env = t.env and c.node_id = t.node_id and c.column_name = t.column_name
        where t.test_type = 'unique') r where n = 1""",
    "columns_t node_tests_t",
)
def inferred_primary_key_rows(spark, folder):
    return lineage.inferred_primary_key(*derived(spark, folder, "columns_t", "node_tests_t"))


@query(
    """, merged as (select n.node_id, d.change_status from (select distinct node_id from nodes_t) n
        left join lineage_diff_t d on n.node_id = d.node_id)
    select node_id, change_status, case when change_status is not null or node_id in (select child_id from edges_t where parent_id = 'nation.3')
        then 0 else 1 end as priority, (select count(*) from merged) as total, (select count(*) from merged) > 300 as more
    from merged order by priority, node_id limit 300""",
    "nodes_t lineage_diff_t edges_t",
)
def lineage_view_rows(spark, folder):
    nodes, edges = derived(spark, folder, "nodes_t", "edges_t")
    below = edges.filter("parent_id = 'nation.3'").select(F.col("child_id").alias("node_id"))
    view = lineage.lineage_view(lineage.merged_nodes(nodes), below, 300).flagged()
    return view.select("node_id", "change_status", "priority", "total", "more")


# Artifacts: the current lineage written as the files of many projects and read back

# Nodes and what leads to them are dealt to projects of a bounded size by a hash that both engines have.
PROJECT_NODES = 2000


def _artifacts(spark, folder):
    nodes, edges, columns, tests = derived(spark, folder, "nodes_t", "edges_t", "columns_t", "node_tests_t", by_child=True)
    nodes, edges, columns, tests = (df.filter(F.col("env") == CURRENT) for df in (nodes, edges, columns, tests))
    with stored(nodes.drop("env").dropDuplicates(["node_id"]), "artifact-nodes") as nodes:
        projects = max(1, -(-nodes.count() // PROJECT_NODES))
        project = lambda node: F.concat(F.lit("project-"), F.pmod(F.crc32(F.col(node).cast("binary")), F.lit(projects))).alias("artifact")
        names = nodes.select("node_id", "name")
        title = F.concat_ws("_", "test_type", "name", "column_name")
        named = tests.join(names, "node_id").withColumn("test_name", F.concat(F.lit("test.sales."), title, F.lit(".t")))
        tables = ArtifactTables(
            nodes.select(project("node_id"), "*"), columns.select(project("node_id"), "*"),
            edges.select(project("child_id"), "*"), named.select(project("node_id"), "node_id", "column_name", "test_name", "test_type"),
        )
        globs = write_artifacts(tables, shared_path(spark, "artifacts"))
    return load_artifact_tables(spark, *globs, CURRENT)


_CURRENT_TESTS = """tests_n as (select t.node_id, t.column_name, concat('test.sales.', t.test_type, '_', n.name, '_', t.column_name, '.t') as test_name,
    t.test_type from node_tests_t t join nodes_t n on n.node_id = t.node_id and n.env = 'current' where t.env = 'current')"""


@query(
    """select n.node_id, n.name, n.resource_type, n.package_name, n.schema_name, n.materialized, n.tag_text as tags, n.checksum, p.primary_key
    from nodes_t n left join (select node_id, arg_min(column_name, ordinal) as primary_key from columns_t
        where env = 'current' and node_id like 'order.%' and ordinal % 2 = 0 group by 1) p on p.node_id = n.node_id
    where n.env = 'current'""",
    "nodes_t columns_t",
)
def artifact_nodes(spark, folder):
    nodes = _artifacts(spark, folder).nodes
    return nodes.withColumn("tags", F.concat_ws(",", "tags")).select(
        "node_id", "name", "resource_type", "package_name", "schema_name", "materialized", "tags", "checksum", "primary_key"
    )


@query("select node_id, column_name, ordinal, data_type from columns_t where env = 'current'", "columns_t")
def artifact_columns(spark, folder):
    return _artifacts(spark, folder).columns.select("node_id", "column_name", "ordinal", "data_type")


@query(
    f""", {_CURRENT_TESTS} select distinct parent_id, child_id from edges_t where env = 'current'
    union select node_id, test_name from tests_n""",
    "edges_t node_tests_t nodes_t",
)
def artifact_edges(spark, folder):
    return _artifacts(spark, folder).edges.select("parent_id", "child_id")


@query(f", {_CURRENT_TESTS} select distinct node_id, column_name, test_name, test_type from tests_n", "node_tests_t nodes_t")
def artifact_tests(spark, folder):
    return _artifacts(spark, folder).node_tests.select("node_id", "column_name", "test_name", "test_type")


# Selection


@query(
    """, merged as (select node_id, max(resource_type) as resource_type, max(package_name) as package_name,
        arg_max(tag_text, env) as tag_text from nodes_t group by 1),
    walked as (select parent_id, child_id from edges_t where env = 'current'
        union select parent_id, child_id from edges_t where env = 'base'
            and child_id in (select node_id from lineage_diff_t where change_status = 'removed')),
    reach(id) as (select node_id from merged where list_contains(string_split(tag_text, ','), 'even')
        union select e.child_id from walked e join reach r on e.parent_id = r.id)
    select id as node_id from reach where id in (select node_id from merged where resource_type = 'model')
    except select node_id from lineage_diff_t""",
    "nodes_t edges_t lineage_diff_t",
)
def selection_tag_descendants(spark, folder):
    graph = LineageGraph.of(*derived(spark, folder, "nodes_t", "edges_t"))
    chosen = graph.by_tag("even").plus_down().intersect(graph.by_type("model"))
    return graph.select(chosen, exclude=graph.modified()).ids


@query(
    """, walked as (select parent_id, child_id from edges_t where env = 'current'
        union select parent_id, child_id from edges_t where env = 'base'
            and child_id in (select node_id from lineage_diff_t where change_status = 'removed')),
    reach(id) as (select node_id from lineage_diff_t union select e.child_id from walked e join reach r on e.parent_id = r.id),
    near as (select id from reach union select e.parent_id from walked e join lineage_diff_t d on e.child_id = d.node_id)
    select id as node_id from near where id in (select node_id from nodes_t where package_name = 'sales')""",
    "nodes_t edges_t lineage_diff_t",
)
def selection_changed_models(spark, folder):
    graph = LineageGraph.of(*derived(spark, folder, "nodes_t", "edges_t"))
    return graph.select(packages=["sales"], changed_models=True).ids


@query(
    """select distinct node_id from nodes_t where materialized = 'view' or node_id = 'nation.3'
    union select distinct n.node_id from nodes_t n where n.name = 'NATION_4'""",
    "nodes_t",
)
def selection_union(spark, folder):
    graph = LineageGraph.of(*derived(spark, folder, "nodes_t", "edges_t"))
    return graph.by_materialization("view").union(graph.by_name("NATION_3", "NATION_4")).ids


# Schemas

_BOTH = """both_t as (select node_id from columns_t group by 1 having bool_or(env = 'base') and bool_or(env = 'current'))"""
_PAIRS = """pairs_t as (select coalesce(b.node_id, c.node_id) as node_id, coalesce(b.column_name, c.column_name) as column_name,
        b.ordinal as base_index, c.ordinal as current_index, b.data_type as base_type, c.data_type as current_type,
        case when b.node_id is null then 'added' when c.node_id is null then 'removed'
             when b.data_type is distinct from c.data_type then 'modified' end as change_status
    from (select * from columns_t where env = 'base') b full outer join (select * from columns_t where env = 'current') c
        on b.node_id = c.node_id and b.column_name = c.column_name)"""
_SCHEMA_CHANGES = """select node_id, column_name, change_status from pairs_t
    where change_status is not null and node_id in (select node_id from both_t)"""


@query(f", {_BOTH}, {_PAIRS} {_SCHEMA_CHANGES}", "columns_t")
def schema_diff_rows(spark, folder):
    return schema.schema_diff(*derived(spark, folder, "columns_t"))


@query(
    f", {_BOTH}, {_PAIRS}, all_t as ({_SCHEMA_CHANGES}) select *, (select count(*) from all_t) as total, (select count(*) from all_t) > 100 as more "
    "from all_t order by node_id, column_name limit 100",
    "columns_t",
)
def schema_diff_report_rows(spark, folder):
    return schema.schema_diff_report(*derived(spark, folder, "columns_t"), 100).flagged()


# Reordering as the running maximum of base positions along the merged order of both lists.
_ORDERED = f"""{_PAIRS},
    pulled_t as (select *, case when base_index is not null and current_index is not null then
        (select min(q.base_index) from pairs_t q where q.node_id = p.node_id and q.current_index > p.current_index) end as puller from pairs_t p),
    placed_t as (select *, case when puller < base_index then puller else base_index end as place,
        case when puller < base_index then 0 else 1 end as late from pulled_t),
    ordered_t as (select node_id, column_name, base_index, current_index, base_type, current_type, change_status,
        coalesce(base_index <= max(base_index) over (partition by node_id order by place nulls last, late, current_index nulls first, column_name
            rows between unbounded preceding and 1 preceding), false) as reordered from placed_t)"""


@query(f", {_ORDERED} select * from ordered_t", "columns_t")
def schema_diff_ordered_rows(spark, folder):
    return schema.schema_diff_ordered(*derived(spark, folder, "columns_t"))


@query(
    f""", {_PAIRS} select node_id, case when count(base_index) > 0 and count(current_index) > 0 then
        bool_or(base_index is distinct from current_index or base_type is distinct from current_type) end as schema_changed
    from pairs_t group by 1""",
    "columns_t",
)
def schema_changed_rows(spark, folder):
    return schema.schema_changed(*derived(spark, folder, "columns_t"))


_UNCHECKED = f""", {_BOTH}, unchecked_t as (select node_id from nodes_t group by 1
    having bool_or(env = 'base') and bool_or(env = 'current')
       and max(case when env = 'current' then resource_type end) not in ('exposure', 'metric', 'semantic_model', 'saved_query')
       and max(case when env = 'current' then materialized end) <> 'ephemeral'
       and node_id not in (select node_id from both_t))"""


@query(f"{_UNCHECKED} select * from unchecked_t", "nodes_t columns_t")
def schema_unchecked_nodes(spark, folder):
    return schema.unchecked_nodes(*derived(spark, folder, "nodes_t", "columns_t"))


@query(
    f"""{_UNCHECKED} select case when count(*) > 0 then 'partial' else 'complete' end as status, count(*) as unchecked_node_count,
        count(*) > 50 as more, (select string_agg(node_id, ',' order by node_id) from (select node_id from unchecked_t order by 1 limit 50) u) as unchecked_nodes
    from unchecked_t""",
    "nodes_t columns_t",
)
def schema_coverage_row(spark, folder):
    coverage = schema.schema_coverage(*derived(spark, folder, "nodes_t", "columns_t"), 50)
    return coverage.withColumn("unchecked_nodes", F.concat_ws(",", "unchecked_nodes"))


@query(
    f""", {_ORDERED}, {_IMPACTED}, flagged_t as (select o.*,
        o.change_status is null and not o.reordered and coalesce(d.change_status = 'modified', false) as definition_changed,
        o.change_status is null and not o.reordered and coalesce(d.change_status = 'unknown', false) as change_unknown,
        i.node_id is not null as hit
        from ordered_t o left join column_changes_t d on o.node_id = d.node_id and o.column_name = d.column_name
        left join impacted i on i.node_id = o.node_id and i.column_name = o.column_name)
    select node_id, column_name, case when base_index is null then 'added' when current_index is null then 'removed'
        when base_type is distinct from current_type and not definition_changed and not reordered and hit and not change_unknown then 'impacted'
        when base_type is distinct from current_type or definition_changed or reordered then 'changed'
        when change_unknown then 'unknown' when hit then 'impacted' else 'unchanged' end as cause from flagged_t""",
    "columns_t col_edges_t column_changes_t",
)
def column_change_causes_rows(spark, folder):
    columns, edges, changes = derived(spark, folder, "columns_t", "col_edges_t", "column_changes_t", stored=("columns_t",))
    changes = cut(changes, "column-changes")
    causes = schema.schema_change_causes(columns, changes, lineage.impacted_columns(edges, changes), stored=True)
    return causes.select("node_id", "column_name", "cause")


# The given tables as nodes: the columns of both versions with their types, and how many of their cells are filled

TABLE_COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label", "pages": "page_id url html", "benchmark": "item_id text",
    "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}
CURRENT_COLUMNS = TABLE_COLUMNS | {"part": "p_partkey p_name p_brand p_size p_retailprice p_grade"}


def _filled_sql(env: str, name: str, column: str) -> str:
    table = name if env == "base" else f"cur_{name}"
    return f"""select '{env}' as env, '{name}' as node_id, '{column}' as column_name, (select count({column}) from {table}) as filled,
        (select min(typeof({column})) from {table}) as data_type"""


_CELLS_SQL = "cells as materialized (" + " union all ".join(
    _filled_sql(env, name, column)
    for env, tables in (("base", TABLE_COLUMNS), ("current", CURRENT_COLUMNS))
    for name, columns in tables.items()
    for column in columns.split()
) + """), cell_pairs as (select coalesce(b.node_id, c.node_id) as node_id, coalesce(b.column_name, c.column_name) as column_name,
    b.filled as base_filled, c.filled as current_filled, case when b.node_id is null then 'added' when c.node_id is null then 'removed'
        when b.data_type <> c.data_type then 'modified' end as change_status
    from (select * from cells where env = 'base') b full outer join (select * from cells where env = 'current') c
        on b.node_id = c.node_id and b.column_name = c.column_name)"""  # fmt: skip


def table_cells(spark, folder):
    """``env, node_id, column_name, ordinal, data_type, filled`` of the given tables, from one pass over each version."""
    env = environments(spark, folder)
    parts = []
    for side in (BASE, CURRENT):
        for name in NAMES:
            df = env.table(name, side)
            facts = [
                F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("ordinal"), F.lit(f.dataType.simpleString()).alias("data_type"), F.count(f.name).alias("filled"))
                for i, f in enumerate(df.schema.fields, 1)
            ]
            rows = df.agg(F.array(*facts).alias("facts"))
            parts.append(rows.select(F.lit(side).alias("env"), F.lit(name).alias("node_id"), F.explode("facts").alias("f")))
    return cut(reduce(lambda a, b: a.unionByName(b), parts).select("env", "node_id", "f.*"), "cells")


@query(f", {_CELLS_SQL} select node_id, column_name, base_filled, current_filled, change_status from cell_pairs", ALL_CURRENT)
def schema_diff_tables(spark, folder):
    cells = table_cells(spark, folder)
    changes = schema.schema_diff_ordered(cells).select("node_id", "column_name", "change_status")
    filled = cells.groupBy("node_id", "column_name").agg(
        *[F.max(F.when(F.col("env") == side, F.col("filled"))).alias(f"{side}_filled") for side in (BASE, CURRENT)]
    )
    return changes.join(filled, ["node_id", "column_name"]).select(
        "node_id", "column_name", "base_filled", "current_filled", "change_status"
    )


@query(
    """select v.*, b.filled as base_filled, c.filled as current_filled
    from (values ('p_partkey', 1, 1, 'bigint', 'bigint', false, null), ('p_name', 2, 2, 'string', 'string', false, null),
        ('p_brand', 3, 3, 'string', 'string', false, null), ('p_type', 4, null, 'string', null, false, 'removed'),
        ('p_size', 5, 4, 'int', 'bigint', false, 'modified'), ('p_retailprice', 6, 5, 'double', 'double', false, null),
        ('p_grade', null, 6, null, 'string', false, 'added'))
    v(column_name, base_index, current_index, base_type, current_type, reordered, change_status)
    left join ("""
    + " union all ".join(f"select '{c}' as column_name, count({c}) as filled from part" for c in TABLE_COLUMNS["part"].split())
    + ") b on b.column_name = v.column_name left join ("
    + " union all ".join(f"select '{c}' as column_name, count({c}) as filled from cur_part" for c in CURRENT_COLUMNS["part"].split())
    + ") c on c.column_name = v.column_name",
    "cur_part",
)
def schema_diff_frames_part(spark, folder):
    """Both schemas side by side, with how many cells of each column are filled."""
    base, current = pair(spark, folder, "part")

    def filled(df, side):
        counts = F.array(*[F.struct(F.lit(c).alias("column_name"), F.count(c).alias(f"{side}_filled")) for c in df.columns])
        return df.agg(counts.alias("facts")).select(F.inline("facts"))

    diff = schema.schema_diff_frames(base, current)
    return diff.join(filled(base, "base"), "column_name", "left").join(filled(current, "current"), "column_name", "left")


# Impact analysis over the tables as models


MODEL_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
    "orders": "o_orderkey", "lineitem": "l_partkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id",
    "pages": "page_id", "benchmark": "no_such_column", "labels": "doc_id", "conversations": None,
}
# Changed tables; the others are downstream of them.
MODEL_STATUS = {"orders": "modified", "customer": "modified", "part": "modified", "benchmark": "modified"}
MODEL_VIEWS = ("supplier",)


def _models(spark, folder):
    """The tables as models. A table is changed if its two versions hold different rows; those not in ``MODEL_STATUS`` are read downstream."""
    env = environments(spark, folder)
    parts = []
    for side in (BASE, CURRENT):
        for name in MODEL_KEYS:
            df = env.table(name, side)
            columns = sorted(set(env.table(name, BASE).columns) & set(env.table(name, CURRENT).columns))
            row = F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])
            sums = df.agg(F.concat_ws("|", F.count(F.lit(1)), F.bit_xor(row), F.sum(row.cast("decimal(20,0)"))).alias("checksum"))
            parts.append(sums.select(F.lit(side).alias("env"), F.lit(f"model.{name}").alias("node_id"), "checksum"))
    changes = lineage.lineage_diff(reduce(lambda a, b: a.unionByName(b), parts))
    rows = [(f"model.{n}", n, "view" if n in MODEL_VIEWS else "table", MODEL_KEYS[n]) for n in MODEL_KEYS]
    models = spark.createDataFrame(rows, "node_id string, name string, materialized string, primary_key string")
    status = F.when(F.col("name").isin(list(MODEL_STATUS)), F.col("change_status"))
    return cut(models.join(changes, "node_id", "left").withColumn("change_status", status), "table-models")


# The columns whose means are compared.
NUMBER_COLUMNS = set(
    "n_regionkey c_nationkey c_acctbal s_nationkey s_acctbal p_size p_retailprice o_custkey o_totalprice l_orderkey l_suppkey "
    "l_linenumber l_quantity l_extendedprice l_discount l_tax user_id value n_chars label quality toxic turn".split()
)


def _row_differs(name: str) -> str:
    # The two versions of part have different columns; only the common ones are compared.
    common = {"part": "p_name p_brand p_size p_retailprice".split()}.get(name)
    return " or ".join(f"b.{c} is distinct from c.{c}" for c in common) if common else "b is distinct from c"


def _model_sql(name: str) -> str:
    """Counts of a model: the pairs that a join by its key forms, and those of them with any other value changed."""
    key = MODEL_KEYS[name]
    if name in MODEL_VIEWS or key in (None, "no_such_column"):
        counts = "cast(null as bigint) as rows_added, cast(null as bigint) as rows_removed, cast(null as bigint) as rows_changed"
        source = "(select 1) one"
    else:
        counts = f"""count(case when b.{key} is null then 1 end) as rows_added, count(case when c.{key} is null then 1 end) as rows_removed,
            count(case when b.{key} = c.{key} and ({_row_differs(name)}) then 1 end) as rows_changed"""
        source = f"{name} b full outer join cur_{name} c on b.{key} = c.{key}"
    return f"""select '{name}' as name, (select count(*) from {name}) as base_rows, (select count(*) from cur_{name}) as current_rows,
        {'true' if key == 'no_such_column' else 'false'} as failed, {counts} from {source}"""


_VALUE_MODELS = [n for n, key in MODEL_KEYS.items() if n not in MODEL_VIEWS and key not in (None, "no_such_column")]
_VALUE_SQL = " union all ".join(
    f"select '{n}' as name, v.* from ("
    + _impact_sql(n, f"cur_{n}", [MODEL_KEYS[n]], {c: c in NUMBER_COLUMNS for c in CURRENT_COLUMNS[n].split() if c != MODEL_KEYS[n] and c in TABLE_COLUMNS[n].split()})
    + ") v"
    for n in _VALUE_MODELS
)
_DIFFERENT_SQL = " union all ".join(
    f"""select '{n}' as name, exists ((select {cs} from {n} except all select {cs} from cur_{n})
        union all (select {cs} from cur_{n} except all select {cs} from {n})) as differs"""
    for n in MODEL_STATUS
    for cs in (", ".join(c for c in CURRENT_COLUMNS[n].split() if c in TABLE_COLUMNS[n].split()),)
)
_IMPACT_SQL = f""", {_CELLS_SQL}, counted as ({" union all ".join(_model_sql(n) for n in MODEL_KEYS)}),
    valued as materialized ({_VALUE_SQL}),
    touched as (select name, string_agg("column", ',' order by "column") as columns from valued where changed > 0 group by 1),
    moved as (select node_id as name, string_agg(column_name || ':' || change_status, ',' order by column_name) as schema_changes,
        string_agg(column_name, ',' order by column_name) as columns from cell_pairs where change_status is not null group by 1),
    different as ({_DIFFERENT_SQL}),
    found as (select n.*, rows_added + rows_removed + rows_changed as affected_row_count,
        case when rows_added is null then 'potential' when rows_added + rows_removed + rows_changed > 0 then 'confirmed' else 'none' end as data_impact,
        case when d.differs then 'modified' end as change_status, m.schema_changes, m.columns as moved, t.columns as touched,
        round(cast(current_rows - base_rows as double) / base_rows * 100, 1) + 0 as delta_pct
        from counted n left join different d on d.name = n.name left join moved m on m.name = n.name left join touched t on t.name = n.name),
    reasoned as (select *, case when data_impact = 'potential' and moved is not null then 'schema_changed_without_values'
            when data_impact = 'potential' and change_status = 'modified' then 'changed_without_values'
            when data_impact = 'potential' and name in ('supplier') then 'view_downstream_without_values'
            when data_impact = 'potential' then 'downstream_without_values'
            when data_impact = 'confirmed' and abs(delta_pct) <= 5 and rows_changed / cast(current_rows - rows_added as double) > 0.2
                and current_rows > rows_added then 'many_values_changed_in_stable_rows' end as reason from found)"""


def _impact(spark, folder):
    changes = schema.schema_diff(table_cells(spark, folder)).withColumn("node_id", F.concat(F.lit("model."), "node_id"))
    return impact.impact_analysis(environments(spark, folder), _models(spark, folder), changes)


@query(
    f"""{_IMPACT_SQL} select concat('model.', name) as node_id, name, change_status, case when name in ('supplier') then 'view' else 'table' end as materialized,
        base_rows, current_rows, current_rows - base_rows as delta, delta_pct, coalesce(schema_changes, '') as schema_changes,
        rows_added, rows_removed, rows_changed, affected_row_count, data_impact, failed,
        case when reason is not null then 'profile_diff' end as tool,
        case reason when 'schema_changed_without_values' then moved when 'many_values_changed_in_stable_rows' then touched end as columns,
        reason, case reason when 'schema_changed_without_values' then case when change_status = 'modified' then 'high' else 'medium' end
            when 'changed_without_values' then 'high' when 'view_downstream_without_values' then 'low' when 'downstream_without_values' then 'medium'
            when 'many_values_changed_in_stable_rows' then 'medium' end as priority
    from reasoned""",
    ALL_CURRENT,
)
def impact_analysis_tables(spark, folder):
    """All fields but the values of columns, which ``impact_analysis_columns`` lists."""
    named = F.transform("schema_changes", lambda c: F.concat_ws(":", c["column"], c["change_status"]))
    action = F.col("next_action")
    return _impact(spark, folder).select(
        "node_id", "name", "change_status", "materialized", "base_rows", "current_rows", "delta", "delta_pct",
        F.array_join(named, ",").alias("schema_changes"), "rows_added", "rows_removed", "rows_changed", "affected_row_count", "data_impact",
        F.col("error").isNotNull().alias("failed"), action["tool"].alias("tool"),
        F.array_join(F.array_sort(action["columns"]), ",").alias("columns"), action["reason"].alias("reason"), action["priority"].alias("priority"),
    )


@query(
    f"""{_IMPACT_SQL} select name, "column", changed as affected_row_count, base_mean, current_mean from valued""",
    ALL_CURRENT,
)
def impact_analysis_columns(spark, folder):
    values = _impact(spark, folder).select("name", F.explode("value_columns").alias("v")).select("name", "v.*")
    return values.withColumns({c: F.round(c, 4) for c in ("base_mean", "current_mean")})


@query(
    f"""{_IMPACT_SQL} select count(*) as impacted_models, count(*) filter (where data_impact = 'confirmed') as confirmed,
        count(*) filter (where data_impact = 'none') as none, count(*) filter (where data_impact = 'potential') as potential,
        count(*) filter (where failed) as failed, max(affected_row_count) as largest_affected_row_count,
        (select count(distinct node_id) from nodes_t) as not_impacted_models
    from found""",
    f"{ALL_CURRENT} nodes_t",
)
def impact_summary_row(spark, folder):
    """The rows of the lineage tables are models too: none of them is a table, so none is planned for."""
    (nodes,) = derived(spark, folder, "nodes_t")
    models = _models(spark, folder)
    return impact.impact_summary(_impact(spark, folder), models.select("node_id").unionByName(nodes.select("node_id")))


# Verdicts and logs


def _same_sql(left: str, right: str) -> str:
    """Whether two row sets are equal, copies included."""
    return f"not exists (({left} except all {right}) union all ({right} except all {left}))"


_CHANGED_CASES = {
    ("row_count_diff", "all"): f"(select bool_or(base <> curr) from ({COUNTS_SQL}) c)",
    ("row_count_diff", "region"): "(select count(*) from region) <> (select count(*) from cur_region)",
    ("value_diff", "orders"): "not " + _same_sql("select * from orders", "select * from cur_orders"),
    ("value_diff", "region"): "not " + _same_sql("select * from region", "select * from cur_region"),
    ("value_diff_detail", "orders"): "not " + _same_sql("select * from orders", "select * from cur_orders"),
    ("value_diff_detail", "region"): "not " + _same_sql("select * from region", "select * from cur_region"),
    ("profile_diff", "orders"): """(select (count(*), count(o_orderstatus), count(distinct o_orderstatus)) from orders)
        <> (select (count(*), count(o_orderstatus), count(distinct o_orderstatus)) from cur_orders)""",
    ("top_k_diff", "orders"): "not " + _same_sql(
        "select o_orderpriority, count(*) from orders group by 1", "select o_orderpriority, count(*) from cur_orders group by 1"),
    ("top_k_diff", "nothing"): "(select count(*) from orders) <> (select count(*) from cur_orders)",
    ("histogram_diff", "region"): "not " + _same_sql("select r_regionkey from region", "select r_regionkey from cur_region"),
    ("histogram_diff", "nothing"): """(select count(*) from orders where o_custkey % 3 = 0)
        <> (select count(*) from cur_orders where o_custkey % 3 = 0)""",
    ("query_diff", "region"): "not " + _same_sql("select distinct r_name from region", "select distinct r_name from cur_region"),
    ("query_diff", "orders"): "not " + _same_sql(
        "select o_orderkey % 7 as k, count(*) as n from orders group by 1", "select o_orderkey % 7 as k, count(*) as n from cur_orders group by 1"),
}


@query(
    " union all ".join(f"select '{kind}' as kind, '{case}' as case_name, {sql} as is_changed" for (kind, case), sql in _CHANGED_CASES.items()),
    ALL_CURRENT,
)
def is_changed_kinds(spark, folder):
    env = environments(spark, folder)
    orders, region = pair(spark, folder, "orders"), pair(spark, folder, "region")
    nothing = [df.select(F.lit(None).cast("string").alias("v"), "o_custkey") for df in orders]
    # A third of the rows are not a number, the others NULL: no bins, only totals.
    odd = [df.select(F.when(F.col("o_custkey") % 3 == 0, F.lit(float("nan"))).alias("v")) for df in orders]
    diffs = {
        ("row_count_diff", "all"): (rowcount.row_count_diff(env, NAMES), None),
        ("row_count_diff", "region"): (rowcount.row_count_diff(env, ["region"]), None),
        ("value_diff", "orders"): (valuediff.value_diff(*orders, "o_orderkey"), None),
        ("value_diff", "region"): (valuediff.value_diff(*region, "r_regionkey"), None),
        ("value_diff_detail", "orders"): (valuediff.value_diff_detail(*orders, "o_orderkey"), None),
        ("value_diff_detail", "region"): (valuediff.value_diff_detail(*region, "r_regionkey"), None),
        ("profile_diff", "orders"): (profile.profile_diff(*orders, columns=["o_orderstatus"]), None),
        ("top_k_diff", "orders"): (topk.top_k_diff(*orders, "o_orderpriority"), topk.column_totals(*orders, "o_orderpriority")),
        ("top_k_diff", "nothing"): (topk.top_k_diff(*nothing, "v"), topk.column_totals(*nothing, "v")),
        ("histogram_diff", "region"): (
            histogram.histogram_diff(*region, "r_regionkey"), histogram.column_bounds(*region, "r_regionkey")),
        ("histogram_diff", "nothing"): (histogram.histogram_diff(*odd, "v"), histogram.column_bounds(*odd, "v")),
        ("query_diff", "region"): (query_diff(env, "select distinct r_name from region", pk="r_name"), None),
        ("query_diff", "orders"): (query_diff(env, "select o_orderkey % 7 as k, count(*) as n from orders group by 1", pk="k"), None),
    }
    verdicts = [
        results.is_changed(df, kind, totals).select(F.lit(kind).alias("kind"), F.lit(case).alias("case_name"), "is_changed")
        for (kind, case), (df, totals) in diffs.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), verdicts)


@query(
    f"""select 'all' as gate, bool_and(base = curr) as passes from ({COUNTS_SQL}) c
    union all select 'stable', bool_and(base = curr) from ({COUNTS_SQL}) c where name in ('region', 'nation', 'benchmark')
    union all select 'schema', count(*) = 0 from ({{changes}}) s""".replace("{changes}", _SCHEMA_CHANGES).replace(
        "select 'all' as gate", f", {_BOTH}, {_PAIRS} select 'all' as gate", 1
    ),
    f"{ALL_CURRENT} columns_t",
)
def passes_gates(spark, folder):
    env = environments(spark, folder)
    (columns,) = derived(spark, folder, "columns_t")
    gates = [
        ("all", rowcount.row_count_diff(env, NAMES), "row_count_diff"),
        ("stable", rowcount.row_count_diff(env, ["region", "nation", "benchmark"]), "row_count_diff"),
        ("schema", schema.schema_diff(columns), "schema_diff"),
    ]
    rows = [results.passes(df, kind).select(F.lit(name).alias("gate"), "passes") for name, df, kind in gates]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"select name from ({COUNTS_SQL}) c where base <> curr", ALL_CURRENT)
def changed_nodes_row_counts(spark, folder):
    return results.changed_nodes(rowcount.row_count_diff(environments(spark, folder), NAMES), "row_count_diff")


@query(
    """select coalesce(e.check_id, i.check_id) as check_id,
        case when e.check_id is null or i.updated_at > e.updated_at then i.name else e.name end as name,
        case when e.check_id is null or i.updated_at > e.updated_at then i.params else e.params end as params,
        case when e.check_id is null or i.updated_at > e.updated_at then i.updated_at else e.updated_at end as updated_at,
        coalesce(e.created_by, i.created_by) as created_by
    from (select *, concat(check_id, params) as k from checks_t) e
    full outer join (select * replace (concat(params, '-own') as params) from new_checks_t) i on e.check_id = i.check_id""",
    "checks_t new_checks_t",
)
def upsert_latest_checks(spark, folder):
    existing, incoming = derived(spark, folder, "checks_t", "new_checks_t")
    # The parameters are made unlike any existing ones, so that presets match by id only.
    incoming = incoming.withColumn("params", F.concat("params", F.lit("-own")))
    merged = results.upsert_latest(existing, incoming)
    return merged.select("check_id", "name", "params", "updated_at", "created_by")


@query(
    """, target as (select i.*, coalesce(e.check_id, p.check_id, i.check_id) as target_id from
        (select * replace (concat('new_', check_id) as check_id, coalesce(params, 'none') as params) from new_checks_t) i
        left join checks_t e on e.check_id = i.check_id
        left join (select params, max(check_id) as check_id from checks_t where is_preset group by 1) p on i.is_preset and p.params = i.params),
    everything as (select check_id as target_id, check_id, name, updated_at, 1 as old from checks_t
        union all select target_id, check_id, name, updated_at, 0 from target)
    select target_id as check_id, name, updated_at from (select *, row_number() over (partition by target_id
        order by updated_at desc, old desc, check_id desc) as n from everything) r where n = 1""",
    "checks_t new_checks_t",
)
def upsert_latest_presets(spark, folder):
    existing, incoming = derived(spark, folder, "checks_t", "new_checks_t")
    incoming = incoming.withColumn("check_id", F.concat(F.lit("new_"), "check_id"))
    return results.upsert_latest(existing, incoming).select("check_id", "name", "updated_at")


@query(
    """select run_id, check_id, type, run_at, value from runs_t
    union all select run_id, check_id, type, run_at, value from new_runs_t where run_id not in (select run_id from runs_t)""",
    "runs_t new_runs_t",
)
def merge_runs_rows(spark, folder):
    merged = results.merge_runs(*derived(spark, folder, "runs_t", "new_runs_t"))
    return merged.select("run_id", "check_id", "type", "run_at", "value")


@query(
    """select check_id, type, run_id, run_at from (select *, row_number() over (partition by check_id, type
        order by run_at desc, run_id desc) as n from runs_t) r where n = 1""",
    "runs_t",
)
def latest_runs_rows(spark, folder):
    (runs,) = derived(spark, folder, "runs_t")
    return results.latest_runs(runs, "check_id", "type").select("check_id", "type", "run_id", "run_at")


@query(
    """select node_id, type, run_id, result from (select *, check_id as node_id, cast(k as bigint) as result,
            row_number() over (partition by check_id, type order by run_at desc, run_id desc) as n
        from runs_t where status <> 'cancelled' and error is null) r where n = 1""",
    "runs_t",
)
def latest_results_rows(spark, folder):
    (runs,) = derived(spark, folder, "runs_t")
    logged = runs.withColumn("node_id", F.col("check_id")).withColumn(
        "result", F.when(F.col("error").isNull(), F.col("k").cast("long"))
    )
    return results.latest_results(logged).select("node_id", "type", "run_id", "result")


@query(
    """, latest as (select * from (select *, row_number() over (partition by check_id order by run_at desc, run_id desc) as n
        from runs_t) r where n = 1)
    select count(*) as total, count(*) filter (where is_checked) as approved,
        count(*) filter (where l.error is null and l.changed) as mismatched, count(*) filter (where l.error is not null) as failed
    from checks_t c left join latest l on l.check_id = c.check_id""",
    "checks_t runs_t",
)
def check_stats_row(spark, folder):
    return results.check_stats(*derived(spark, folder, "checks_t", "runs_t"))


@query(
    "select run_id, run_at from runs_t where type = 'click' and k = '42' order by run_at desc, run_id desc limit 20",
    "runs_t",
)
def search_runs_rows(spark, folder):
    (runs,) = derived(spark, folder, "runs_t")
    runs = runs.withColumn("params", F.create_map(F.lit("k"), F.col("k")))
    return results.search_runs(runs, "click", {"k": "42"}, limit=20).select("run_id", "run_at")


@query(
    f""", {_BOTH}, {_PAIRS}, counts_t as (select node_id, count(*) filter (where env = 'base') as base,
        count(*) filter (where env = 'current') as curr from columns_t group by 1),
    moved_t as (select *, abs(curr - base) / nullif(cast(curr as double), 0) * 100 as pct from counts_t)
    select node_id, case when d.change_status = 'added' then 'Added Node' when d.change_status = 'removed' then 'Removed Node'
        else concat_ws(',', case when d.change_status = 'modified' then 'Code' end,
            case when curr <> 0 and curr <> base then concat('Row Count ', case when curr > base then '+' else '-' end,
                case when pct > 0.1 then cast(round(pct, 2) as varchar) else '<0.1' end, '%') end,
            case when s.node_id is not null then 'Schema' end) end as what
    from moved_t full outer join lineage_diff_t d using (node_id)
    left join (select distinct node_id from ({_SCHEMA_CHANGES}) x) s using (node_id)
    where d.change_status is not null or (curr <> 0 and curr <> base) or s.node_id is not null""",
    "columns_t lineage_diff_t",
)
def what_changed_rows(spark, folder):
    columns, changes = derived(spark, folder, "columns_t", "lineage_diff_t")
    counts = columns.groupBy("node_id").agg(
        F.count_if(F.col("env") == BASE).alias("base"), F.count_if(F.col("env") == CURRENT).alias("curr")
    )
    found = results.what_changed(changes, counts, schema.schema_diff(columns))
    return found.withColumn("what", F.concat_ws(",", "what"))
