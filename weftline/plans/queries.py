"""The queries of the driver contract: each operator over the lifted tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import behaviour, ids, names, routes, sqltext, text
from weftline.model import DB_OBJECTS, READS, WRITES, Graph, Options
from weftline.operators import dedupe, enrich, links, memory, metrics, structure, traverse
from weftline.operators.api import Api, table_lookup
from weftline.plans import lift, statements
from weftline.plans.lift import SQL as L
from weftline.plans.lift import graph, published, table
from weftline.session import ship, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_UNBOUNDED = Options(max_nodes=0, max_edges=0)


def _starts(spark: SparkSession, *node_ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in node_ids], "node_id string")


# ---- traversals

@query(L + """, walk(node_id, depth) AS (SELECT 'system:1', 0 UNION SELECT e.target_node_id, w.depth + 1 FROM walk w JOIN edges e ON e.source_node_id = w.node_id WHERE w.depth < 8)
SELECT node_type, CAST(depth AS BIGINT) AS depth, count(*) AS n FROM (SELECT node_id, min(depth) AS depth FROM walk GROUP BY node_id) JOIN nodes USING (node_id) GROUP BY ALL""")
def impact_of_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes reached from a region within eight levels, by type."""
    t = traverse.trace(published(spark, sf_dir), _starts(spark, "system:1"), options=_UNBOUNDED)
    return t.nodes.where("node_type is not null").groupBy("node_type", F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("n"))


@query(L + """, walk(node_id, depth) AS (SELECT 'system:1', 0 UNION SELECT e.target_node_id, w.depth + 1 FROM walk w JOIN edges e ON e.source_node_id = w.node_id WHERE w.depth < 8 AND w.node_id NOT LIKE 'table:%')
SELECT node_id, CAST(min(depth) AS BIGINT) AS depth, node_id LIKE 'table:%' AS target FROM walk GROUP BY node_id""")
def trace_out_to_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full trace to database objects, which are recorded and not expanded."""
    t = traverse.trace(published(spark, sf_dir), _starts(spark, "system:1"), "out", DB_OBJECTS, _UNBOUNDED)
    return t.nodes.select("node_id", F.col("depth").cast("long").alias("depth"), "target")


@query(L + """, hit AS (SELECT node_id FROM nodes WHERE node_type = 'TABLE' AND technical_name = 'small_ring'),
walk(node_id, depth) AS (SELECT node_id, 0 FROM hit UNION SELECT e.source_node_id, w.depth + 1 FROM walk w JOIN edges e ON e.target_node_id = w.node_id JOIN nodes s ON s.node_id = w.node_id WHERE w.depth < 8 AND (w.depth = 0 OR s.node_type NOT IN ('API_OPERATION','SQL_STATEMENT','UI_ACTION')))
SELECT node_id, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY node_id""")
def impact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change of the tables of a name touches."""
    a = Api(published(spark, sf_dir), options=_UNBOUNDED).impact_table("", "", "small_ring")
    return a.nodes.select("node_id", F.col("depth").cast("long").alias("depth"))


@query(L + """, walk(node_id, depth) AS (SELECT 'api-operation:7', 0 UNION SELECT e.target_node_id, w.depth + 1 FROM walk w JOIN edges e ON e.source_node_id = w.node_id WHERE w.depth < 8 AND w.node_id NOT LIKE 'table:%') SELECT DISTINCT node_id FROM walk WHERE node_id LIKE 'table:%'""")
def impact_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables behind an operation."""
    return Api(published(spark, sf_dir), options=_UNBOUNDED).impact_api("get", "/orders/7").data["targets"]


@query(L + """, walk(node_id, depth) AS (SELECT 'ui-action:3', 0 UNION SELECT e.target_node_id, w.depth + 1 FROM walk w JOIN edges e ON e.source_node_id = w.node_id WHERE w.depth < 8 AND w.node_id NOT LIKE 'table:%') SELECT DISTINCT node_id FROM walk WHERE node_id LIKE 'table:%'""")
def trace_ui_to_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a screen's action, found by part of its name, to tables."""
    return Api(published(spark, sf_dir), options=_UNBOUNDED).trace_ui_to_db("customer#000000003").data["targets"]


@query(L + """, walk AS (SELECT node_id AS start, node_id AS here, [CAST('' AS VARCHAR)] AS path, 0 AS depth FROM nodes WHERE node_type = 'API_APPLICATION'
 UNION ALL SELECT w.start, e.target_node_id, list_append(w.path, e.edge_id), w.depth + 1 FROM walk w JOIN edges e ON e.source_node_id = w.here WHERE w.depth < 4 AND e.edge_type IN ('CONTAINS','CALLS_API','EXECUTES_SQL')),
best AS (SELECT start, here, min(path) AS path, depth FROM walk WHERE here LIKE 'sql-statement:%' GROUP BY ALL)
SELECT start, here AS target, CAST(depth AS BIGINT) AS depth, array_to_string(path[2:], ',') AS edges FROM best""")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shortest path from every application to every statement it reaches."""
    g = published(spark, sf_dir)
    starts = g.nodes.where("node_type = 'API_APPLICATION'").select("node_id")
    p = traverse.shortest_paths(g.edges, starts, g.nodes, frozenset({"SQL_STATEMENT"}), 4, frozenset({"CONTAINS", "CALLS_API", "EXECUTES_SQL"}))
    return p.select("start", "target", F.col("depth").cast("long").alias("depth"), F.array_join("edges", ",").alias("edges"))


_ENTRY = ", entry AS (SELECT o_orderkey, 'api-operation:'||o_orderkey AS start FROM orders)"
_FLOWS_SQL = L + _ENTRY + """, one AS (SELECT n.start, e.edge_id AS e1, e.target_node_id AS s, row_number() OVER (PARTITION BY n.start ORDER BY e.edge_type, e.target_node_id, e.edge_id) AS r1 FROM entry n JOIN edges e ON e.source_node_id = n.start),
two AS (SELECT o.start, o.e1, o.s, o.r1, e.edge_id AS e2, e.edge_type AS k2, e.target_node_id AS t, e.confidence AS c, CASE WHEN e.target_node_id LIKE 'table:%' THEN 'TABLE' ELSE 'EXTERNAL_SYSTEM' END AS tt FROM one o JOIN edges e ON e.source_node_id = o.s AND e.edge_type IN ('READS_FROM','WRITES_TO','CALLS_API')),
first AS (SELECT *, row_number() OVER (PARTITION BY start, t ORDER BY r1, k2, t, e2) AS nth FROM two),
ranked AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY r1, k2, t, e2) AS rank FROM first WHERE nth = 1),
flows AS (SELECT 'flow:'||sha256(start||'|'||t||'|'||e1||'|'||e2) AS flow_id, 'API' AS flow_type, start, t AS target, tt AS target_type, CAST(2 AS BIGINT) AS depth, least(1.0, c) AS confidence, true AS complete, e1, e2, s FROM ranked WHERE rank <= 100)"""


def _flows(spark: SparkSession, sf_dir: str) -> traverse.Flows:
    g = published(spark, sf_dir)
    return traverse.flows(g, Options(flow_entry_types=frozenset({"API_OPERATION"})))


@query(_FLOWS_SQL + " SELECT flow_id, flow_type, start, target, target_type, depth, confidence, complete FROM flows")
def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of every operation to tables and external systems."""
    return _flows(spark, sf_dir).flows.select("flow_id", "flow_type", "start", "target", "target_type", F.col("depth").cast("long").alias("depth"), "confidence", "complete")


# Every flow of every entry: operations (entry, statement, target) and, a level before them, screens' actions. An action's first level is ranked alone, as nothing else is one step away.
_STEPS_SQL = L + """, hop AS (SELECT source_node_id AS s, target_node_id AS t, edge_type AS k, edge_id AS e FROM edges WHERE edge_type IN ('CONTAINS','CALLS_API','EXECUTES_SQL','READS_FROM','WRITES_TO')),
entry AS (SELECT node_id AS start FROM nodes WHERE node_type IN ('API_OPERATION', 'UI_ACTION')),
a AS (SELECT start, t AS n1, e AS e1, k FROM entry JOIN hop ON s = start), one AS (SELECT start, n1, e1, row_number() OVER (PARTITION BY start ORDER BY k, n1, e1) AS r FROM a),
b AS (SELECT start, n1, e1, t AS n2, e AS e2, k, r, row_number() OVER (PARTITION BY start, t ORDER BY r, k, e) AS nth FROM one JOIN hop ON s = n1), two AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY r, k, n2, e2) AS r2 FROM b WHERE nth = 1),
c AS (SELECT start, n1, e1, n2, e2, t AS n3, e AS e3, row_number() OVER (PARTITION BY start, t ORDER BY r2, hop.k, e) AS nth FROM two JOIN hop ON s = n2),
flow AS (SELECT start, n2 AS target, [start, n1, n2] AS ns, [e1, e2] AS es FROM two WHERE start LIKE 'api-operation:%' UNION ALL SELECT start, n3, [start, n1, n2, n3], [e1, e2, e3] FROM c WHERE nth = 1),
steps AS (SELECT 'flow:'||sha256(start||'|'||target||'|'||array_to_string(es, '|')) AS flow_id, ns, es, unnest(range(len(ns))) AS i FROM flow)"""


@query(_STEPS_SQL + " SELECT flow_id, CAST(i AS BIGINT) AS step_index, ns[i + 1] AS node_id, CASE WHEN i > 0 THEN es[i] END AS incoming_edge_id FROM steps")
def flow_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes on every flow of every entry, in order; however many targets an entry has."""
    f = traverse.flows(published(spark, sf_dir), Options(max_flow_targets=0))
    return f.steps.select("flow_id", F.col("step_index").cast("long").alias("step_index"), "node_id", "incoming_edge_id")


@query(L + """, walk(start, node_id) AS (SELECT 'ui-action:'||c_custkey, 'ui-action:'||c_custkey FROM customer UNION SELECT w.start, e.target_node_id FROM walk w JOIN edges e ON e.source_node_id = w.node_id AND e.edge_type IN ('CALLS_API','EXECUTES_SQL'))
SELECT start, count(*) AS n FROM walk GROUP BY start""")
def reachable_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything reachable from each start, without a depth bound."""
    g = published(spark, sf_dir)
    starts = g.nodes.where("node_type = 'UI_ACTION'").select(F.col("node_id").alias("start"), "node_id", "node_type")
    return traverse.reachable(g.edges, starts, "start", frozenset({"CALLS_API", "EXECUTES_SQL"}), g).groupBy("start").agg(F.count("*").alias("n"))


@query(L + """, lab AS (SELECT 'api-application:'||n_nationkey AS node_id, r_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'ui-action:'||c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'system:'||r_regionkey, r_name FROM region)
SELECT node_id, label FROM lab""")
def package_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of systems spread along containment until nothing changes."""
    g = published(spark, sf_dir)
    seeds = g.nodes.where("node_type = 'SYSTEM'").select("node_id", F.col("system_key").alias("label"))
    return traverse.propagated_labels(seeds, g.edges, frozenset({"CONTAINS"}))


# ---- query API

@query(L + " SELECT node_id, node_type, qualified_name FROM nodes WHERE lower(qualified_name) LIKE '%.customer#0000000%' ORDER BY node_id LIMIT 50")
def find_node_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By qualified name, equal but for case, else containing it."""
    return Api(graph(spark, sf_dir)).find_node(qualified_name=".customer#0000000").nodes.select("node_id", "node_type", "qualified_name")


@query(L + " SELECT edge_id, source_node_id, target_node_id, edge_type FROM edges WHERE source_node_id = 'api-application:3' AND upper(edge_type) = 'CONTAINS' ORDER BY edge_id LIMIT 200")
def find_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F05, L01."""
    return Api(graph(spark, sf_dir)).find_edges(source="api-application:3", edge_type="contains").edges.select("edge_id", "source_node_id", "target_node_id", "edge_type")


@query(L + " SELECT target_type, target_id, source_path, start_line, end_line FROM evidence WHERE target_id = 'api-operation:11'")
def find_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F06, F07."""
    return Api(graph(spark, sf_dir)).find_evidence("api-operation:11").evidence.select("target_type", "target_id", "source_path", "start_line", "end_line")


@query(L + " SELECT issue_id, issue_type, severity FROM issues WHERE package_key = 'sources/orders-f' AND severity = 'ERROR' ORDER BY issue_id LIMIT 200")
def list_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F08."""
    return Api(graph(spark, sf_dir)).list_issues(source="orders-f", severity="error").issues.select("issue_id", "issue_type", "severity")


@query(L + " SELECT edge_id, CASE WHEN source_node_id = 'ui-action:5' THEN 'OUT' ELSE 'IN' END AS direction, edge_type FROM edges WHERE source_node_id = 'ui-action:5' OR target_node_id = 'ui-action:5'")
def explain_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a node's edges both ways."""
    return Api(graph(spark, sf_dir)).explain_node("ui-action:5").edges.select("edge_id", F.when(F.col("source_node_id") == "ui-action:5", "OUT").otherwise("IN").alias("direction"), "edge_type")


@query(L + " SELECT node_id FROM nodes WHERE node_type = 'TABLE' AND (upper(json_extract_string(properties_json,'$.table')) = 'RED_WIDGET')")
def table_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables by a bare name."""
    return graph(spark, sf_dir).nodes.where("node_type = 'TABLE'").where(table_lookup("red_widget")).select("node_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS node_id, lang AS kind FROM documents WHERE contains(lower(text), 'the') AND lower(lang) = 'en' AND lower(source) = 'src1' ORDER BY node_id LIMIT 1000000")
def search_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards that hold a text, of a kind and source, all whatever their case."""
    d = table(spark, sf_dir, "documents")
    cards = d.select(F.col("doc_id").cast("string").alias("node_id"), F.col("lang").alias("kind"), "source", "text")
    return Api(Graph(cards, cards), cards).search_memory("THE", kind="EN", source="Src1", limit=1_000_000).select("node_id", "kind")


@query(L + """, rel AS (SELECT node_id, count(*) AS n FROM (SELECT source_node_id AS node_id, target_node_id AS o FROM edges UNION SELECT target_node_id, source_node_id FROM edges) GROUP BY node_id)
SELECT node_id, CASE WHEN node_type = 'TABLE' THEN 'tables' WHEN node_type = 'API_OPERATION' THEN 'apis' WHEN node_type = 'SQL_STATEMENT' THEN 'procedures' ELSE 'modules' END AS "group", coalesce(n, 0) AS n_related FROM nodes LEFT JOIN rel USING (node_id) WHERE node_type IN ('TABLE','API_OPERATION','SQL_STATEMENT','UI_ACTION','API_APPLICATION')""")
def memory_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card per node of the five groups."""
    g = graph(spark, sf_dir)
    return memory.cards(Graph(g.nodes, g.edges)).select("node_id", "group", "n_related")


# ---- joins

_OPS = "ops AS (SELECT 'op:'||min(p_partkey) AS op, '/api/'||lower(p_type)||'/'||p_size AS route FROM part GROUP BY p_type, p_size UNION ALL SELECT 'op2:'||min(p_partkey), '/v2/api/'||lower(p_type)||'/'||p_size FROM part WHERE p_size % 10 = 0 GROUP BY p_type, p_size), calls AS (SELECT 'call:'||p_partkey AS call, CASE p_partkey % 4 WHEN 0 THEN '/api/'||lower(p_type)||'/'||p_size WHEN 1 THEN '/'||lower(p_type)||'/'||p_size WHEN 2 THEN '/gateway/api/'||lower(p_type)||'/'||p_size ELSE '/none/'||lower(p_type)||'/'||(p_size+1000) END AS route FROM part)"


def _api(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    size, kind = F.col("p_size").cast("string"), F.lower("p_type")
    get = F.lit("GET").alias("method")
    op = lambda df, prefix, root: df.groupBy("p_type", "p_size").agg(F.min("p_partkey").alias("k")).select(F.concat(F.lit(prefix), F.col("k").cast("string")).alias("node_id"), get, F.concat(F.lit(root), kind, F.lit("/"), size).alias("route"))
    ops = op(p, "op:", "/api/").unionByName(op(p.where("p_size % 10 = 0"), "op2:", "/v2/api/"))
    m = F.col("p_partkey") % 4
    route = F.when(m == 0, F.concat(F.lit("/api/"), kind, F.lit("/"), size)).when(m == 1, F.concat(F.lit("/"), kind, F.lit("/"), size)).when(m == 2, F.concat(F.lit("/gateway/api/"), kind, F.lit("/"), size)).otherwise(F.concat(F.lit("/none/"), kind, F.lit("/"), (F.col("p_size") + 1000).cast("string")))
    return p.select(F.concat(F.lit("call:"), F.col("p_partkey").cast("string")).alias("node_id"), get, route.alias("route")), ops


@query("WITH " + _OPS + """, ex AS (SELECT call, op, 'exact' AS m FROM calls JOIN ops USING (route)), sx AS (SELECT DISTINCT call, op, 'unique_suffix' AS m FROM calls c JOIN ops o ON (o.route = c.route OR ends_with(o.route, c.route) OR ends_with(c.route, o.route)) WHERE call NOT IN (SELECT call FROM ex)), a AS (SELECT * FROM ex UNION ALL SELECT * FROM sx)
SELECT call AS call_id, m AS "match", count(*) AS candidates, min(op) AS target_id, CASE WHEN count(*) = 1 THEN 'LINKED' ELSE 'AMBIGUOUS' END AS status FROM a GROUP BY call, m""")
def link_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls to operations, by equal routes, else by suffixes."""
    return links.link_api(*_api(spark, sf_dir))


_REFS = "refs AS (SELECT 'unresolved-reference:'||p_partkey AS id, upper(p_brand) AS db, CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE 'NOSUCH' END AS sc, upper(replace(p_name,' ','_')) AS nm FROM part WHERE p_partkey % 3 = 0), objs AS (SELECT 'table:'||p_partkey AS id, upper(p_brand) AS db, upper(p_type) AS sc, upper(replace(p_name,' ','_')) AS nm FROM part WHERE p_partkey % 3 <> 0)"


def _reference_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the parts as tables, the others as references, half of them with a schema that isn't there."""
    p = table(spark, sf_dir, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    is_ref = F.col("p_partkey") % 3 == 0
    schema = F.when(~is_ref | (F.col("p_partkey") % 2 == 0), F.col("p_type")).otherwise("NOSUCH")
    key = F.col("p_partkey").cast("string")
    return p.select(F.when(is_ref, F.concat(F.lit("unresolved-reference:"), key)).otherwise(F.concat(F.lit("table:"), key)).alias("node_id"), F.when(is_ref, "UNRESOLVED_REFERENCE").otherwise("TABLE").alias("node_type"), name.alias("technical_name"), F.concat_ws(".", schema, name).alias("qualified_name"), F.upper("p_brand").alias("database_key"), F.to_json(F.struct(schema.alias("schema"), name.alias("table"))).alias("properties_json"))


@query("WITH " + _REFS + """, ex AS (SELECT r.id AS ref, o.id AS cand FROM refs r JOIN objs o USING (db, sc, nm)), lo AS (SELECT r.id AS ref, o.id AS cand FROM refs r JOIN objs o USING (db, nm) WHERE r.id NOT IN (SELECT ref FROM ex)), a AS (SELECT * FROM ex UNION ALL SELECT * FROM lo)
SELECT ref AS ref_id, 'object' AS kind, count(*) AS candidates, min(cand) AS target_id, CASE WHEN count(*) = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status FROM a GROUP BY ref""")
def resolve_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deferred references by database, schema and name, else without the schema."""
    return links.resolve_deferred(_reference_nodes(spark, sf_dir))


@query("WITH " + _REFS + """, s AS (SELECT r.id AS ref, o.id AS cand, least(CAST(0.65 AS DOUBLE) + CASE WHEN r.db = o.db THEN CAST(0.2 AS DOUBLE) ELSE 0 END + CASE WHEN r.sc = o.sc THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN r.sc = o.sc THEN CAST(0.05 AS DOUBLE) ELSE 0 END, 1.0) AS score, concat_ws(',', 'same_name', CASE WHEN r.db = o.db THEN 'same_database' END, CASE WHEN r.sc = o.sc THEN 'same_schema' END, CASE WHEN r.sc = o.sc THEN 'qualified_suffix' END) AS reasons FROM refs r JOIN objs o USING (nm)),
k AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY score DESC, cand) AS rn FROM s)
SELECT ref AS reference_node_id, cand AS candidate_node_id, rn AS rank, round(score, 6) AS score, CASE WHEN score >= 0.85 THEN 'eligible' ELSE 'observe' END AS status, reasons FROM k WHERE rn <= 10""")
def resolution_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reference may be, scored and ranked."""
    c = links.candidates(_reference_nodes(spark, sf_dir))
    return c.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


@query("WITH " + _REFS + """, ex AS (SELECT r.id AS ref, o.id AS cand FROM refs r JOIN objs o USING (db, sc, nm)), lo AS (SELECT r.id AS ref, o.id AS cand FROM refs r JOIN objs o USING (db, nm) WHERE r.id NOT IN (SELECT ref FROM ex)), a AS (SELECT ref, min(cand) AS cand FROM (SELECT * FROM ex UNION ALL SELECT * FROM lo) GROUP BY ref HAVING count(*) = 1),
e AS (SELECT 'sql-statement:'||l_orderkey||'-'||l_linenumber AS s, CASE WHEN l_partkey % 3 = 0 THEN 'unresolved-reference:' ELSE 'table:' END||l_partkey AS t, CASE WHEN l_returnflag='N' THEN 'READS_FROM' ELSE 'WRITES_TO' END AS k, 1-l_discount AS c FROM lineitem), m AS (SELECT s, coalesce(cand, t) AS t, k, max(c) AS confidence FROM e LEFT JOIN a ON t = ref GROUP BY ALL)
SELECT 'edge:'||sha256(s||'|'||k||'|'||t||'||DATA_FLOW') AS edge_id, s AS source_node_id, t AS target_node_id, k AS edge_type, confidence, '{"ref_node_id":"'||t||'"}' AS properties_json FROM m""")
def replaced_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after resolved references were replaced, in their bags too; those that became equal are merged."""
    nodes = _reference_nodes(spark, sf_dir)
    e = lift.edges(spark, sf_dir).where("edge_type in ('READS_FROM', 'WRITES_TO')")
    number = F.split_part("target_node_id", F.lit(":"), F.lit(2))
    e = e.withColumn("target_node_id", F.when(number.cast("long") % 3 == 0, F.concat(F.lit("unresolved-reference:"), number)).otherwise(F.col("target_node_id"))).withColumn("properties_json", F.to_json(F.struct(F.col("target_node_id").alias("ref_node_id"))))
    alias = links.resolve_deferred(nodes).where("status = 'RESOLVED'").select(F.col("ref_id").alias("old_id"), F.col("target_id").alias("new_id"))
    return links.replace_nodes(Graph(nodes, e), alias).edges.select("edge_id", "source_node_id", "target_node_id", "edge_type", "confidence", "properties_json")


@query("""WITH e AS (SELECT 'ui-action:'||o_custkey AS s, 'api-operation:'||(o_orderkey + 7) AS t FROM orders), n AS (SELECT 'api-operation:'||o_orderkey AS id FROM orders UNION ALL SELECT 'ui-action:'||c_custkey FROM customer)
SELECT t AS expected_id, 'unresolved-reference:DEFERRED:'||left(sha256(t), 24) AS placeholder_id, split_part(t, ':', 2) AS label, 'API_OPERATION' AS kind FROM (SELECT s AS t FROM e UNION SELECT t FROM e) WHERE t NOT IN (SELECT id FROM n)""")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of edges that no node has."""
    g = graph(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("ui-action:"), F.col("o_custkey").cast("string")).alias("source_node_id"), F.concat(F.lit("api-operation:"), (F.col("o_orderkey") + 7).cast("string")).alias("target_node_id"))
    e = o.withColumn("edge_id", ids.edge_id("source_node_id", F.lit("CALLS_API"), "target_node_id"))
    return links.dangling(Graph(g.nodes.where("node_type in ('UI_ACTION', 'API_OPERATION')"), e)).select("expected_id", "placeholder_id", "label", "kind")


@query(L + """ SELECT 'edges.source_node_id' AS reference, count(*) AS n FROM edges WHERE source_node_id NOT IN (SELECT node_id FROM nodes) UNION ALL SELECT 'edges.target_node_id', count(*) FROM edges WHERE target_node_id NOT IN (SELECT node_id FROM nodes)
UNION ALL SELECT 'evidence.node', count(*) FROM evidence WHERE target_type = 'NODE' AND target_id NOT IN (SELECT node_id FROM nodes) UNION ALL SELECT 'evidence.edge', count(*) FROM evidence WHERE target_type = 'EDGE' AND target_id NOT IN (SELECT edge_id FROM edges) UNION ALL SELECT 'issues.source_node_id', count(*) FROM issues WHERE source_node_id NOT IN (SELECT node_id FROM nodes)""")
def broken_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys that lead nowhere."""
    return links.broken_keys(graph(spark, sf_dir))


@query("""WITH d AS (SELECT 'sql:'||l_orderkey||'-'||l_linenumber AS node_id, CAST(l_orderkey AS VARCHAR) AS path, CAST(l_linenumber*5 AS BIGINT) AS s, CAST(l_linenumber*5 + min(l_quantity) AS BIGINT) AS e FROM lineitem GROUP BY l_orderkey, l_linenumber),
c AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(event_id AS VARCHAR) AS path, CAST(user_id AS BIGINT) AS s, CAST(user_id + 1 AS BIGINT) AS e FROM events),
i AS (SELECT c.id, d.node_id, row_number() OVER (PARTITION BY c.id ORDER BY d.e - d.s, d.s DESC, d.node_id) AS rn FROM c JOIN d ON c.path = d.path AND d.s <= c.s AND c.e <= d.e),
n AS (SELECT c.id, d.node_id, row_number() OVER (PARTITION BY c.id ORDER BY d.s, d.node_id) AS rn FROM c JOIN d ON c.path = d.path AND d.s BETWEEN c.e AND c.e + 2)
SELECT c.id AS comment_id, coalesce(i.node_id, n.node_id, 'file:'||c.path) AS owner_node_id, CASE WHEN i.node_id IS NOT NULL THEN 'INSIDE' WHEN n.node_id IS NOT NULL THEN 'BEFORE' ELSE 'FILE' END AS rule FROM c LEFT JOIN i ON c.id = i.id AND i.rn = 1 LEFT JOIN n ON c.id = n.id AND n.rn = 1""")
def comment_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost declaration around a comment, else the next one, else the file."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    start = (F.col("l_linenumber") * 5).cast("long")
    decl = li.select(F.concat(F.lit("sql:"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("node_id"), F.col("l_orderkey").cast("string").alias("source_path"), start.alias("start_line"), (start + F.col("q").cast("long")).alias("end_line"))
    ev = table(spark, sf_dir, "events")
    key = F.col("event_id").cast("string")
    comments = ev.select(key.alias("comment_id"), key.alias("source_path"), F.col("user_id").cast("long").alias("start_line"), (F.col("user_id") + 1).cast("long").alias("end_line"), F.concat(F.lit("file:"), key).alias("file_id"))
    return structure.comment_owners(comments, decl)


@query("""WITH d AS (SELECT DISTINCT 'r:'||l_orderkey||'-'||l_linenumber||'-'||CAST(l_quantity AS BIGINT) AS id, l_orderkey AS path, CAST(l_linenumber AS BIGINT) AS s, CAST(l_linenumber + l_quantity AS BIGINT) AS e FROM lineitem),
j AS (SELECT a.id, b.id AS up, row_number() OVER (PARTITION BY a.id ORDER BY b.e - b.s, b.s DESC, b.id) AS rn FROM d a JOIN d b ON a.path = b.path AND b.s <= a.s AND a.e <= b.e AND b.e - b.s > a.e - a.s)
SELECT id AS routine_id, up AS parent_id FROM j WHERE rn = 1""")
def parent_routines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest routine strictly around each."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long")
    d = li.select(F.concat(F.lit("r:"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), q.cast("string"))).alias("routine_id"), F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("start"), (F.col("l_linenumber") + q).cast("long").alias("end")).distinct()
    return structure.parent_routine(d)


@query("""SELECT e.event_id, (SELECT max_by(c.event_id, c.ts) FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND c.ts <= e.ts) AS click_id FROM events e WHERE e.event_type = 'purchase'""")
def nearest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click of a user at or before each purchase (as-of join)."""
    e = table(spark, sf_dir, "events")
    points = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    marks = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return structure.nearest_before(points, marks, ["user_id"], "ts", "click_id").select("event_id", "click_id")


@query(L + """, f AS (SELECT 'order:'||o_orderkey AS file_id, 'api-operation:'||o_orderkey AS node_id FROM orders UNION ALL SELECT 'order:'||o_orderkey, 'ui-action:'||o_custkey FROM orders), loose AS (SELECT DISTINCT file_id, node_id FROM f WHERE node_id NOT IN (SELECT target_node_id FROM edges WHERE edge_type = 'CONTAINS'))
SELECT 'edge:'||sha256(file_id||'|CONTAINS|'||node_id||'||STRUCTURAL') AS edge_id, file_id AS source_node_id, node_id AS target_node_id FROM loose""")
def attach_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files contain what nothing else does."""
    o = table(spark, sf_dir, "orders")
    file = F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))
    named = lambda prefix, c: o.select(file.alias("file_id"), F.concat(F.lit(prefix), F.col(c).cast("string")).alias("node_id"))
    return structure.attach_declarations(named("api-operation:", "o_orderkey").unionByName(named("ui-action:", "o_custkey")), lift.edges(spark, sf_dir)).select("edge_id", "source_node_id", "target_node_id")


@query("""WITH apps AS (SELECT n_regionkey, 'api-application:'||min(CAST(n_nationkey AS VARCHAR)) AS app FROM nation GROUP BY n_regionkey), n AS (SELECT 'project:'||s_suppkey AS id, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT app AS source_node_id, id AS target_node_id FROM n JOIN apps USING (n_regionkey)""")
def attach_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as projects without a parent, nations as the applications of their region."""
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("system_key"))
    none = F.lit("").alias("repository_key")
    apps = nation.select(F.concat(F.lit("api-application:"), F.col("n_nationkey").cast("string")).alias("node_id"), F.lit("API_APPLICATION").alias("node_type"), "system_key", none)
    projects = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("project:"), F.col("s_suppkey").cast("string")).alias("node_id"), F.lit("PROJECT").alias("node_type"), "system_key", none)
    return structure.attach_projects(Graph(apps.unionByName(projects), lift.edges(spark, sf_dir).where("edge_type = 'EXECUTES_SQL'"))).select("source_node_id", "target_node_id")


@query("""WITH r AS (SELECT 'job:'||p_partkey AS job_id, lower(p_name)||' '||p_size AS name, p_brand, p_type, p_partkey FROM part), x AS (SELECT 1 AS priority, name, 'exe:'||p_brand AS e FROM r UNION ALL SELECT 2, name, 'exe:'||p_type FROM r UNION ALL SELECT 3, name, 'exe:all' FROM r),
h AS (SELECT job_id, priority, min(e) AS e FROM r JOIN x USING (name) GROUP BY ALL HAVING count(DISTINCT e) = 1) SELECT job_id, min_by(e, priority) AS executable_id FROM h GROUP BY job_id""")
def job_executables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs to executables by the first rule that is unambiguous: by brand, by type, any."""
    p = table(spark, sf_dir, "part")
    name = names.executable_name(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("name")
    rule = lambda n, c: p.select(F.lit(n).alias("priority"), name, F.concat(F.lit("exe:"), c).alias("executable_id"))
    jobs = p.select(F.concat(F.lit("job:"), F.col("p_partkey").cast("string")).alias("job_id"), name)
    return links.job_executables(jobs, rule(1, F.col("p_brand")).unionByName(rule(2, F.col("p_type"))).unionByName(rule(3, F.lit("all"))))


# ---- aggregation and de-duplication

@query("""WITH n AS (SELECT 'node:'||p_partkey AS id, p_brand||'.'||p_name AS q, p_retailprice / 10000 AS c FROM part), r AS (SELECT q, min_by(id, length(id)::VARCHAR||'.'||id) AS rep, max(c) AS confidence, count(*) AS n FROM (SELECT * FROM n ORDER BY id) GROUP BY q)
SELECT (SELECT min_by(x.id, row(length(x.id), x.id)) FROM n x WHERE x.q = r.q) AS node_id, q AS qualified_name, confidence FROM r""")
def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand and name are one node, of the shortest id."""
    return dedupe.merge_nodes(_duplicates(spark, sf_dir))[0].select("node_id", "qualified_name", "confidence")


def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    none = F.lit("")
    return p.select(F.concat(F.lit("node:"), F.col("p_partkey").cast("string")).alias("node_id"), F.lit("TABLE").alias("node_type"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), none.alias("system_key"), none.alias("database_key"), none.alias("repository_key"), F.lit("MAIN").alias("graph_role"), (F.col("p_retailprice") / 10000).alias("confidence"), F.lit("{}").alias("properties_json"))


@query("""WITH n AS (SELECT 'node:'||p_partkey AS id, p_brand||'.'||p_name AS q FROM part), r AS (SELECT q, min_by(id, row(length(id), id)) AS rep FROM n GROUP BY q) SELECT id AS old_id, rep AS new_id FROM n JOIN r USING (q) WHERE id <> rep""")
def node_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What merged ids became."""
    return dedupe.merge_nodes(_duplicates(spark, sf_dir))[1]


@query("SELECT 'lineitem:'||l_orderkey||'-'||l_linenumber AS id, count(DISTINCT l_partkey||'|'||l_suppkey) AS versions FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_partkey||'|'||l_suppkey) > 1")
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids whose rows differ."""
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("lineitem:"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))).alias("id"), "l_partkey", "l_suppkey")
    return dedupe.conflicts(li, "id")


@query(L + """, k AS (SELECT issue_id, issue_type, severity, 'p'||left(source_path, 10) AS path FROM issues), m AS (SELECT *, row_number() OVER (PARTITION BY path, issue_type ORDER BY issue_id) AS rn, count(*) OVER (PARTITION BY path, issue_type) AS n FROM k)
SELECT issue_id, issue_type, path AS source_path FROM m WHERE n <= 20 OR rn < 20 UNION ALL SELECT 'issue-summary:'||sha256(path||'|'||issue_type||'|'||count(*)||'|'||max(issue_id)), issue_type, path FROM m WHERE n > 20 AND rn >= 20 GROUP BY issue_type, path""")
def bounded_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most twenty issues of a type and path, the last a summary."""
    i = lift.issues(spark, sf_dir).withColumn("source_path", F.concat(F.lit("p"), F.left("source_path", F.lit(10))))
    return dedupe.bounded_issues(i).select("issue_id", "issue_type", "source_path")


@query(L + """, m AS (SELECT 'nodes' AS metric_name, count(*) AS v FROM nodes UNION ALL SELECT 'unresolvedReferences', 0 UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'lowConfidenceEdges', count(*) FROM edges WHERE confidence < 0.8 UNION ALL SELECT 'evidence', count(*) FROM evidence UNION ALL SELECT 'issues', count(*) FROM issues UNION ALL SELECT 'ambiguousIssues', count(*) FROM issues WHERE issue_type LIKE 'AMBIGUOUS%') SELECT metric_name, CAST(v AS DOUBLE) AS metric_value FROM m""")
def global_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, A34, F09, K11."""
    return metrics.global_metrics(graph(spark, sf_dir))


@query(L + " SELECT package_key AS scope_key, 'nodes' AS metric_name, CAST(count(*) AS DOUBLE) AS metric_value FROM nodes GROUP BY package_key UNION ALL SELECT package_key, 'issues', CAST(count(*) AS DOUBLE) FROM issues GROUP BY package_key")
def source_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    return metrics.source_metrics(graph(spark, sf_dir))


@query(L + " SELECT edge_type, count(*) AS n FROM edges GROUP BY edge_type")
def edge_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    return metrics.type_counts(lift.edges(spark, sf_dir), "edge_type")


@query(L + " SELECT target_node_id AS key, string_agg(DISTINCT source_node_id, ',' ORDER BY source_node_id) AS readers FROM edges WHERE edge_type = 'READS_FROM' GROUP BY target_node_id")
def readers_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15, A30, K05."""
    return metrics.touching(lift.edges(spark, sf_dir), READS).select("key", F.array_join("ids", ",").alias("readers"))


@query(L + " SELECT upper(qualified_name) AS key, count(DISTINCT node_id) AS n FROM nodes WHERE node_type = 'TABLE' GROUP BY 1")
def tables_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15, A16, X29."""
    return metrics.inverted(lift.nodes(spark, sf_dir).where("node_type = 'TABLE'"), F.upper("qualified_name"), "node_id").select("key", F.size("ids").cast("long").alias("n"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey DESC) AS rn FROM part) SELECT p_brand, p_name, p_partkey FROM r WHERE rn = 1")
def last_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal identities the last."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey", "p_size")
    return dedupe.by_policy(p, ["p_brand", "p_name"], "last", ["p_partkey"])[0].select("p_brand", "p_name", "p_partkey")


# ---- inputs and outputs

@query(L + """, k AS (SELECT *, CASE edge_type WHEN 'READS_FROM' THEN 'INPUT' ELSE 'OUTPUT' END AS direction, CASE WHEN edge_type = 'CALLS_API' THEN 'API_REQUEST' ELSE 'DATABASE_TABLE' END AS kind, CASE edge_type WHEN 'CALLS_API' THEN 'CALLS' ELSE edge_type END AS mapping FROM edges WHERE edge_type IN ('READS_FROM','WRITES_TO','CALLS_API'))
SELECT 'io:'||sha256(source_node_id||'|'||direction||'|'||kind||'|'||qualified_name||'|'||edge_id) AS io_id, source_node_id AS owner_node_id, direction, kind, qualified_name AS name, target_node_id, mapping, k.confidence AS confidence, CASE WHEN k.confidence >= 1 THEN 'EXTRACTED' ELSE 'INFERRED' END AS provenance FROM k JOIN nodes n ON n.node_id = k.target_node_id""")
def io_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What statements and screens read, write and call."""
    g = graph(spark, sf_dir)
    return enrich.edge_io(g.nodes, g.edges).drop("edge_id")


@query("""SELECT 'io:'||sha256('op:'||o_orderkey||'|INPUT|ROUTE_PARAM|'||p.name||'|route:/orders/{id}/items/{line:int}:'||p.nr) AS io_id, 'op:'||o_orderkey AS owner_node_id, p.name AS name, CAST(p.nr AS BIGINT) AS ordinal FROM orders, (VALUES ('id', 1), ('line', 2)) p(name, nr)""")
def route_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of routes as inputs."""
    o = table(spark, sf_dir, "orders")
    n = o.select(F.concat(F.lit("op:"), F.col("o_orderkey").cast("string")).alias("node_id"), F.lit("API_OPERATION").alias("node_type"), F.lit('{"route":"/orders/{id}/items/{line:int}"}').alias("properties_json"), F.lit(1.0).alias("confidence"))
    return enrich.semantic_io(n).select("io_id", "owner_node_id", "name", F.col("ordinal").cast("long").alias("ordinal"))


# ---- scalar functions

@query("""SELECT page_id, CASE WHEN p = '/' THEN p ELSE regexp_replace(p, '/+$', '') END AS route, CAST(len(list_filter(string_split(p, '/'), lambda x: x <> '')) AS BIGINT) AS n_parts FROM (SELECT page_id, regexp_replace('/'||regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/+', '/', 'g') AS p FROM pages)""")
def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route of every page."""
    p = table(spark, sf_dir, "pages").select("page_id", routes.route_path("url").alias("route"))
    return p.withColumn("n_parts", F.size(routes.parts("route")).cast("long"))


@query("SELECT p_partkey, upper(p_brand)||'.'||upper(replace(p_name,' ','_')) AS identifier, upper(replace(p_name,' ','_')) AS leaf, upper(p_brand) AS owner, 'table:'||upper(p_brand)||':'||upper(p_type)||'.'||upper(replace(p_name,' ','_')) AS table_id, trim(regexp_replace(lower(p_name), '[^a-z0-9_.-]+', '-', 'g'), '-') AS slug FROM part")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X02, X04, X05, X21, X22, X25."""
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    p = table(spark, sf_dir, "part").withColumn("identifier", names.oracle_identifier(F.concat_ws(".", "p_brand", name)))
    return p.select("p_partkey", "identifier", names.leaf("identifier").alias("leaf"), names.owner("identifier").alias("owner"), ids.table_id("p_brand", F.concat_ws(".", "p_type", name)).alias("table_id"), names.slug("p_name").alias("slug"))


@query(L + " SELECT edge_id, true AS valid, split_part(source_node_id, ':', 1) AS prefix, split_part(source_node_id, ':', 2) AS name FROM edges")
def edge_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical edge ids, their ends decoded and checked."""
    e = lift.edges(spark, sf_dir)
    d = ids.decoded_id("source_node_id")
    return e.select("edge_id", (ids.stable_id_valid("source_node_id") & ids.stable_id_valid("target_node_id") & ids.edge_id_valid(F.col("source_node_id"), F.col("edge_type"), F.col("target_node_id"), F.col("graph_layer"))).alias("valid"), F.lower(F.replace(d["kind"], F.lit("_"), F.lit("-"))).alias("prefix"), d["name"].alias("name"))


@query(r"SELECT doc_id, CASE WHEN contains(text, chr(13)) THEN 'mixed' WHEN contains(text, chr(10)) THEN 'LF' ELSE 'none' END AS style, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS last_line, CAST(length(split_part(text, chr(10), -1)) + 1 AS BIGINT) AS last_column, split_part(text, chr(10), 1) AS first_line FROM documents")
def line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newline style, line and column of the end, text of the first line."""
    d = table(spark, sf_dir, "documents")
    end = F.length("text")
    style = text.newline_style("text")
    return d.select("doc_id", style.alias("style"), text.line_of("text", end).cast("long").alias("last_line"), text.column_of("text", end).cast("long").alias("last_column"), text.line_text("text", F.lit(1)).alias("first_line"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, sha256('{\"k\":'||json_extract_string(props, '$.k')||'}') AS bag_hash FROM events")
def property_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties read leniently and written again with sorted keys."""
    from weftline.functions.jsonbag import as_object, sorted_json

    e = table(spark, sf_dir, "events")
    k = F.get_json_object(as_object("props"), "$.k").try_cast("bigint")
    return e.select("event_id", k.alias("k"), F.sha2(sorted_json(k=k), 256).alias("bag_hash"))


# ---- text

@query("SELECT page_id, CAST(len(c) AS BIGINT) AS n_comments, coalesce(trim(regexp_replace(c[1], '^<!--|-->$', '', 'g')), '') AS first_text, CAST(len(regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1)) AS BIGINT) AS n_links FROM (SELECT page_id, html, regexp_extract_all(html, '<!--[\\s\\S]*?-->') AS c FROM pages)")
def page_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments and links of pages."""
    p = table(spark, sf_dir, "pages").withColumn("c", text.markup_comments("html"))
    return p.select("page_id", F.size("c").cast("long").alias("n_comments"), F.coalesce(text.comment_text(F.get("c", F.lit(0))), F.lit("")).alias("first_text"), F.size(text.links("html")).cast("long").alias("n_links"))


@query("SELECT page_id, lower(nullif(regexp_extract(html, '(?i)<meta[^>]*?charset\\s*=\\s*[\"'']?([\\w-]+)', 1), '')) AS declared FROM pages")
def declared_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The charset that a page declares."""
    return table(spark, sf_dir, "pages").select("page_id", text.declared_encoding(F.encode("html", "UTF-8")).alias("declared"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_returnflag) AS f FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE f WHEN 'N' THEN 'READS_FROM:APP.PART_'||l_partkey||',READS_FROM:SUP_'||l_suppkey||'@REMOTE' WHEN 'A' THEN 'INSERTS:APP.PART_'||l_partkey||',READS_FROM:SUP_'||l_suppkey ELSE 'UPDATES:PART_'||l_partkey||',READS_FROM:SUP_'||l_suppkey END AS refs FROM s""")
def sql_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that statements read and write, comments and literals aside."""
    ship(spark)
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.min("l_returnflag").alias("f"))
    p, s = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    sql = (
        F.when(F.col("f") == "N", F.concat(F.lit("with q as (select id from app.part_"), p, F.lit(" where x = 'from nowhere') select q.id, extract(year from q.d) from q join sup_"), s, F.lit("@remote s on s.id = q.id -- from comment")))
        .when(F.col("f") == "A", F.concat(F.lit("insert into app.part_"), p, F.lit(" (a, b) select a, b /* from x */ from sup_"), s))
        .otherwise(F.concat(F.lit("update part_"), p, F.lit(" set a = (select max(a) from sup_"), s, F.lit(") where b = 1")))
    )
    a = li.withColumn("a", sqltext.referenced_tables(sql))
    return a.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _refs("a"))


def _refs(tables: str) -> Column:
    return F.array_join(F.transform(tables, lambda t: F.concat_ws(":", t["relation"], t["name"])), ",").alias("refs")


@query(statements.expected_sql("part", "p_partkey"))
def sql_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of statements of many shapes, one for each part, by the whole analysis."""
    ship(spark)
    shape = F.col("p_partkey") % len(statements.STATEMENTS)
    sql = F.replace(F.array(*[F.lit(q) for q, _ in statements.STATEMENTS])[shape.cast("int")], F.lit("#"), F.col("p_partkey").cast("string"))
    a = spread(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", shape.cast("long").alias("statement"), sqltext.analysis(sql).alias("a"))
    return a.select("p_partkey", "statement", _refs("a.tables"))


def _routine(k: Column, n: Column) -> Column:
    """A routine of one of four shapes for a part: its number ``k`` and size ``n``, as strings."""
    t = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return (
        F.when(F.col("p_partkey") % 4 == 0, t("create or replace procedure p_", k, "(a in number) is\nbegin\n  if a > ", n, " then\n    update app.t_", k, " set v = 'x; end if;' where id = a;\n  else\n    delete from l_", n, ";\n  end if;\nend;"))
        .when(F.col("p_partkey") % 4 == 1, t("function f_", k, " return number is\n  n number := g_", n, "(1);\nbegin\n  for r in (select id from s_", k, ") loop\n    exit when r.id > ", n, ";\n    insert into h_", k, " values (r.id);\n  end loop; -- done\n  return n;\nend f_", k, ";"))
        .when(F.col("p_partkey") % 4 == 2, t("begin\n  case a\n    when ", n, " then log_", k, "(a);\n    else raise bad_", n, ";\n  end case;\nend;"))
        .otherwise(t("declare\n  procedure inner is begin delete from z; end;\nbegin\n  begin\n    select v into x from a_", k, ", b_", n, " where 1 = 1;\n  exception\n    when no_data_found or too_many_rows then\n      x := ", n, ";\n  end;\nend;"))
    )


_TREES = [
    "BRANCH IF a > # [L3]|  DATA_EFFECT UPDATE APP.T_@ [L4]|  ELSE|    DATA_EFFECT DELETE L_# [L6]",
    "ASSIGNMENT Initialize n [L2]|  CALL Call G_# [L2]|LOOP r in (select id from s_@) [L4]|  EXIT Exit loop [L5]|  DATA_EFFECT INSERT H_@ [L6]|OUTPUT Return n [L8]",
    "BRANCH CASE a [L2]|  CASE WHEN # [L3]|    CALL Call LOG_@ [L3]|  ELSE|    RAISE Raise bad_# [L4]",
    "BLOCK Nested block [L4]|  TRY BEGIN / EXCEPTION [L4]|    SQL select v into x from a_@, b_# where 1 = 1 [L5]|      DATA_EFFECT SELECT A_@ [L5]|      DATA_EFFECT SELECT B_# [L5]|    CATCH no_data_found OR too_many_rows [L7]|      ASSIGNMENT Set x [L8]",
]


def _trees_sql(trees: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(trees))
    return f"SELECT p_partkey, replace(replace(replace(CASE p_partkey % 4 {whens} END, '|', chr(10)), '#', CAST(p_size AS VARCHAR)), '@', CAST(p_partkey AS VARCHAR)) AS tree FROM part"


@query(_trees_sql(_TREES))
def behaviour_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What routines do, nested, as an indented tree."""
    ship(spark)
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", behaviour.tree_text(_routine(F.col("p_partkey").cast("string"), F.col("p_size").cast("string"))).alias("tree"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 2 END AS leaves, p_partkey % 4 = 1 AS has_loop, p_partkey % 4 = 3 AS has_handler, p_partkey % 4 IN (0, 2) AS has_else FROM part".replace("CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 2 END", "CAST(2 AS BIGINT)"))
def behaviour_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, data effects and raises of routines, and what holds them; the rest is left out."""
    ship(spark)
    tree = behaviour.summary_json(_routine(F.col("p_partkey").cast("string"), F.col("p_size").cast("string")))
    t = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", tree.alias("t"))
    leaves = F.size(F.regexp_extract_all("t", F.lit('"type":"(call|data_effect|raise)"'), 1)).cast("long")
    return t.select("p_partkey", leaves.alias("leaves"), F.col("t").contains('"type":"loop"').alias("has_loop"), F.col("t").contains('"catches"').alias("has_handler"), F.col("t").contains('"else_steps"').alias("has_else"))


@query("SELECT doc_id, CASE WHEN length(t) >= 10 AND regexp_matches(t, '^(select\\b[\\s\\S]*\\bfrom\\b|insert\\b[\\s\\S]*\\binto\\b|update\\b[\\s\\S]*\\bset\\b|delete\\b[\\s\\S]*\\bfrom\\b|merge\\b[\\s\\S]*\\binto\\b|with\\b[\\s\\S]*\\bselect\\b|begin\\b[\\s\\S]*\\bend\\b|call\\s+\\w+)') THEN true ELSE false END AS is_sql FROM (SELECT doc_id, lower(trim(text)) AS t FROM documents)")
def likely_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F23, F24."""
    return table(spark, sf_dir, "documents").select("doc_id", text.likely_sql("text").alias("is_sql"))


@query(L + """ SELECT source_node_id AS node_id, min(confidence) AS confidence FROM edges WHERE edge_type IN ('READS_FROM','WRITES_TO') GROUP BY source_node_id""")
def relationship_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least confidence of what a statement touches."""
    from weftline.model import one_of

    e = lift.edges(spark, sf_dir).where(one_of("edge_type", READS | WRITES))
    return e.groupBy(F.col("source_node_id").alias("node_id")).agg(F.min("confidence").alias("confidence"))


# ---- without SQL: sequential or recursive by nature; tests hold these against plain Python

@query(None)
def knowledge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards as Markdown in chunks of bounded size, with what is known of nodes, edges, evidence and issues."""
    g = graph(spark, sf_dir)
    ship(spark)
    named = F.concat(F.lit("evidence:"), F.sha2(F.concat_ws("|", "target_type", "target_id", "source_path", "start_line", "end_line", "evidence_kind"), 256))
    cards = memory.markdown_cards(memory.cards(g.with_(evidence=g.evidence.withColumn("evidence_id", named))))
    c = memory.chunked(cards, ["topic"], ["source", "anchor", "node_id"], 1 << 16)
    return c.groupBy("topic", "chunk").agg(F.count("*").alias("cards"), F.sum(F.octet_length("body")).alias("bytes"))


@query("""SELECT 'customer:'||o_custkey AS source_path, 'UI_ACTION customer:'||o_custkey||' [L1-L9]'||chr(10)||string_agg('  API_OPERATION '||o_orderkey||' [L2-L3]', chr(10) ORDER BY CAST(o_orderkey AS VARCHAR)) AS tree FROM orders GROUP BY o_custkey""")
def file_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declarations of each customer's file as a tree."""
    g = graph(spark, sf_dir)
    ship(spark)
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("customer:"), F.col("o_custkey").cast("string"))
    kids = o.select(path.alias("source_path"), F.concat(F.lit("api-operation:"), F.col("o_orderkey").cast("string")).alias("node_id"), F.lit("API_OPERATION").alias("node_type"), F.col("o_orderkey").cast("string").alias("name"), F.lit(2).alias("start_line"), F.lit(3).alias("end_line"))
    roots = o.select(path.alias("source_path"), F.concat(F.lit("ui-action:"), F.col("o_custkey").cast("string")).alias("node_id"), F.lit("UI_ACTION").alias("node_type"), path.alias("name"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line")).distinct()
    held = g.edges.where("edge_type = 'CALLS_API'").withColumn("edge_type", F.lit("CONTAINS"))
    return memory.file_trees(roots.unionByName(kids), held)


@query(None)
def compact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """63-bit numbers of all node ids."""
    return ids.compact_map(lift.nodes(spark, sf_dir), "node_id", "node")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_of_region(spark, sf_dir)


from weftline.plans import inputs  # noqa: E402, F401  registers its queries
