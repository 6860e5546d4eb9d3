"""More registered queries: reading and writing, texts of other languages, merging of evidence and bags, small functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import ids, jsonbag, names, routes, sqltext, text
from weftline.model import Graph
from weftline.operators import dedupe, links, reports
from weftline.operators.api import Api
from weftline.plans import lift
from weftline.plans.lift import SQL as L
from weftline.plans.lift import table
from weftline.plans.queries import _reference_nodes, _REFS, query
from weftline.session import shared_dir, ship, spread
from weftline.sources import mappers, packages, publish


def _text(*parts: Column | str) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


# ---- sources and sinks

@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16-le' ELSE 'utf-16-be' END AS encoding, CASE page_id % 4 WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16-le' WHEN 3 THEN 'utf-16-be' END AS mark, CASE WHEN page_id % 4 = 1 THEN 'ENCODING_CONFLICT' END AS issue, md5(html) AS digest FROM pages""")
def decoded_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in four encodings, by mark, declaration or content; a declaration that contradicts the mark is an issue."""
    ship(spark)
    p = table(spark, sf_dir, "pages")
    shape = F.col("page_id") % 4
    marked = lambda mark, name: F.concat(F.unhex(F.lit(mark)), F.encode("html", name))
    raw = F.when(shape == 0, F.encode("html", "UTF-8")).when(shape == 1, marked("EFBBBF", "UTF-8")).when(shape == 2, marked("FFFE", "UTF-16LE")).otherwise(marked("FEFF", "UTF-16BE"))
    d = p.select("page_id", raw.alias("raw")).withColumn("d", text.decode_file("raw", F.when(F.col("page_id") % 4 == 0, "UTF8").when(F.col("page_id") % 4 == 1, "Shift_JIS")))
    return d.select("page_id", F.col("d.encoding").alias("encoding"), text.bom(F.col("raw")).alias("mark"), F.col("d.issue").alias("issue"), F.md5(F.col("d.text").cast("binary")).alias("digest"))


@query(L + """ SELECT 'node' AS kind, node_id AS id, node_type AS type, qualified_name AS name, confidence FROM nodes UNION ALL SELECT 'edge', edge_id, edge_type, source_node_id||' '||target_node_id, confidence FROM edges""")
def package_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written as an interchange package and read again."""
    folder = f"{shared_dir(spark)}/package-{uuid.uuid4().hex}".removeprefix("file:")
    packages.write_package(Graph(lift.nodes(spark, sf_dir), lift.edges(spark, sf_dir)), folder)
    g, _ = packages.read_packages(spark, [folder])
    n = g.nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.col("node_type").alias("type"), F.col("qualified_name").alias("name"), "confidence")
    return n.unionByName(g.edges.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), F.col("edge_type").alias("type"), F.concat_ws(" ", "source_node_id", "target_node_id").alias("name"), "confidence"))


@query(L + """ SELECT 'nodes' AS kind, node_type AS type, count(*) AS n FROM nodes GROUP BY node_type UNION ALL SELECT 'edges', edge_type, count(*) FROM edges GROUP BY edge_type UNION ALL SELECT 'memory', CASE node_type WHEN 'TABLE' THEN 'tables' WHEN 'API_OPERATION' THEN 'apis' WHEN 'SQL_STATEMENT' THEN 'procedures' ELSE 'modules' END, count(*) FROM nodes WHERE node_type NOT IN ('SYSTEM', 'EXTERNAL_SYSTEM') GROUP BY ALL""")
def published_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph published, swapped in, and read again."""
    folder = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}".removeprefix("file:")
    publish.publish(Graph(lift.nodes(spark, sf_dir), lift.edges(spark, sf_dir)), folder, linked=False, dedupe=False)
    g, cards = publish.read_published(spark, folder)
    counted = lambda df, kind, c: df.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("type")).agg(F.count("*").alias("n"))
    return counted(g.nodes, "nodes", "node_type").unionByName(counted(g.edges, "edges", "edge_type")).unionByName(counted(cards, "memory", "group"))


@query("""SELECT 'm/'||p_partkey||'.xml' AS relative_path, 'ns.x'||p_partkey AS namespace, id, kind, replace(replace(sql, '#', CAST(p_partkey AS VARCHAR)), '@', CAST(p_size AS VARCHAR)) AS sql FROM part, (VALUES ('cols', 'FRAGMENT', 'a#, b'), ('find', 'SELECT', 'select a#, b from t_@ where id = ?'), ('put', 'INSERT', 'insert into t_# values (@)')) s(id, kind, sql)""")
def mapper_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of mapper files, fragments filled in."""
    k, n = F.col("p_partkey"), F.col("p_size")
    xml = _text('<?xml version="1.0"?>\n<mapper namespace="ns.x', k, '">\n<sql id="cols">a', k, ', b</sql>\n<select id="find">select <include refid="cols"/> from t_', n, ' where id = ?</select>\n<insert id="put">insert into t_', k, " values (", n, ")</insert>\n</mapper>")
    files = table(spark, sf_dir, "part").select(_text("m/", k, ".xml").alias("relative_path"), xml.alias("text"))
    return mappers.statements(files).select("relative_path", "namespace", "id", "kind", "sql")


@query("""SELECT p_partkey, 'a.b' AS key, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'a.name', p_name FROM part""")
def config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values of configuration files, nested keys by their path."""
    ship(spark)
    t = F.to_json(F.struct(F.struct(F.col("p_size").alias("b"), F.col("p_name").alias("name")).alias("a")))
    kv = table(spark, sf_dir, "part").select("p_partkey", F.explode(mappers.config_keys(F.lit("appsettings.json"), t)).alias("x"))
    return kv.select("p_partkey", F.regexp_replace("x.key", ":", ".").alias("key"), F.col("x.value").alias("value"))


@query("""WITH j AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) SELECT 'job-network:N'||l_orderkey AS source_node_id, 'CONTAINS' AS edge_type, 'job:N'||l_orderkey||':J'||l_linenumber AS target_node_id FROM j UNION SELECT 'job:N'||l_orderkey||':J'||l_linenumber, 'DEPENDS_ON', 'job:N'||l_orderkey||':J'||(l_linenumber - 1) FROM j WHERE l_linenumber > 1 UNION SELECT 'job:N'||l_orderkey||':J'||l_linenumber, 'STARTS', 'executable:run'||l_linenumber FROM j""")
def job_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of orders, each after the one before, and what they start."""
    n = F.col("l_linenumber")
    j = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    jobs = j.select(_text("N", F.col("l_orderkey")).alias("jobnet_id"), _text("J", n).alias("job_id"), F.when(n > 1, _text("J", n - 1)).otherwise("").alias("predecessor_job_id"), _text("C:\\bin\\RUN", n, ".EXE").alias("executable_name"))
    return packages.job_networks(jobs)[1].select("source_node_id", "edge_type", "target_node_id")


# ---- texts

_PACKAGE = "create or replace package body app.pkg_#@ as\n  procedure run_#(a in number default f(1, 2), b out varchar2) is\n  begin\n    execute immediate 'drop table x';\n    helper_#(a);\n  end;\n  function calc_# return number is\n  begin\n    return seq_#.nextval;\n  end;\nend;\n"


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    sql = F.replace(F.replace(F.lit(_PACKAGE), F.lit("#"), F.col("p_partkey").cast("string")), F.lit("@"), _text("_", F.col("p_size")))
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", sqltext.analysis(sql).alias("a"))


@query("""SELECT p_partkey, 'PROCEDURE' AS kind, 'RUN_'||p_partkey AS name, 'NUMBER,VARCHAR2' AS signature, '' AS returns FROM part UNION ALL SELECT p_partkey, 'FUNCTION', 'CALC_'||p_partkey, 'void', 'NUMBER' FROM part""")
def plsql_routines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routines of package bodies with their parameters' types."""
    return _packages(spark, sf_dir).select("p_partkey", F.explode("a.routines").alias("r")).select("p_partkey", "r.kind", "r.name", "r.signature", "r.returns")


@query("""SELECT p_partkey, 'PACKAGE APP.PKG_'||p_partkey||'_'||p_size AS declares, 'SEQ_'||p_partkey||' NEXTVAL' AS sequences, CAST(1 AS BIGINT) AS dynamic, 'PLSQL' AS classification, true AS has_helper FROM part""")
def plsql_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations, sequences, dynamic statements, calls and the class of scripts."""
    joined = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *(x[f] for f in fields))), ",")
    helper = F.exists("a.calls", lambda c: c["name"] == F.concat(F.lit("HELPER_"), F.col("p_partkey").cast("string")))
    return _packages(spark, sf_dir).select("p_partkey", joined("a.declarations", "kind", "name").alias("declares"), joined("a.sequences", "name", "kind").alias("sequences"), F.size("a.dynamic").cast("long").alias("dynamic"), F.col("a.classification").alias("classification"), helper.alias("has_helper"))


@query("""SELECT p_partkey, f, 'APPEND' AS mode, 'APP.T_'||p_partkey AS "table", name, type, expression FROM (SELECT p_partkey, 'd_'||p_partkey||'.dat' AS f, p_size FROM part), (VALUES ('ID', 'INTEGER EXTERNAL', NULL), ('NAME', 'CHAR(20)', 'upper(:name)'), ('D', 'DATE', NULL)) s(name, type, expression)""")
def loader_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, tables and fields of loader control files; the data after them is ignored."""
    ship(spark)
    k = F.col("p_partkey")
    ctl = _text("-- into table nothing (x)\nload data\ninfile 'd_", k, ".dat'\nappend\ninto table app.t_", k, "\nfields terminated by ','\n(id integer external, name char(20) \"upper(:name)\", d date)\nbegindata\n1,into table z (q),x\n")
    d = table(spark, sf_dir, "part").select("p_partkey", sqltext.loader(ctl).alias("c"))
    rows = d.select("p_partkey", F.col("c.files")[0]["path"].alias("f"), F.col("c.mode").alias("mode"), F.explode("c.targets").alias("t")).select("p_partkey", "f", "mode", F.col("t.table").alias("table"), F.explode("t.fields").alias("x"))
    return rows.select("p_partkey", "f", "mode", "table", "x.name", "x.type", "x.expression")


# ---- merging

@query("""WITH e AS (SELECT 'e:'||l_orderkey||'-'||l_linenumber||'-'||l_suppkey AS id, 'n:'||l_orderkey AS target, l_linenumber AS line, 1 - l_discount AS c, repeat('x', CAST(l_quantity AS INT)) AS s FROM lineitem)
SELECT (SELECT min_by(x.id, row(length(x.id), x.id)) FROM e x WHERE x.target = g.target AND x.line = g.line) AS evidence_id, target AS target_id, CAST(line AS BIGINT) AS start_line, max(c) AS confidence, max(length(s)) AS snippet_chars FROM e g GROUP BY target, line""")
def merged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the same place becomes one: shortest id, most confident, longest snippet."""
    li = table(spark, sf_dir, "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    e = li.select(_text("e:", k, "-", n, "-", F.col("l_suppkey")).alias("evidence_id"), F.lit("NODE").alias("target_type"), _text("n:", k).alias("target_id"), n.cast("long").alias("start_line"), (1 - F.col("l_discount")).alias("confidence"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("snippet"))
    return dedupe.merge_rows(e, "evidence_id", dedupe.EVIDENCE_KEY).select("evidence_id", "target_id", "start_line", "confidence", F.length("snippet").cast("long").alias("snippet_chars"))


@query("""WITH k AS (SELECT p_brand||'.'||p_type AS q, 'k'||p_partkey AS key, p_partkey, p_size FROM part) SELECT q AS qualified_name, '{'||string_agg('"'||key||'":'||p_size, ',' ORDER BY key)||',"list":['||(SELECT string_agg(s, ',' ORDER BY f) FROM (SELECT p_size AS s, min(row(length('n:'||p_partkey), 'n:'||p_partkey)) AS f FROM k x WHERE x.q = k.q GROUP BY p_size))||']}' AS properties_json FROM k GROUP BY q""")
def merged_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags of nodes that are one: objects by key, lists by what the ones before lack, in the order of ids."""
    size = F.col("p_size").cast("string")
    bag = _text('{"k', F.col("p_partkey"), '":', size, ',"list":[', size, "]}")
    p = table(spark, sf_dir, "part")
    blank = {c: F.lit("").alias(c) for c in ("system_key", "database_key", "repository_key")}
    n = p.select(_text("n:", F.col("p_partkey")).alias("node_id"), F.lit("TABLE").alias("node_type"), F.concat_ws(".", "p_brand", "p_type").alias("qualified_name"), *blank.values(), F.lit(1.0).alias("confidence"), bag.alias("properties_json"))
    return dedupe.merge_nodes(n)[0].select("qualified_name", "properties_json")


@query("""SELECT o_orderkey, unnest(['a:'||o_orderkey, 'b:'||o_custkey, 'c']) AS node_id FROM orders""")
def bag_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that bags refer to, at any depth."""
    ship(spark)
    bag = _text('{"ref_node_id":"a:', F.col("o_orderkey"), '","x":[{"y":{"ref_node_ids":["b:', F.col("o_custkey"), '","c"]}}],"note":"d"}')
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(jsonbag.node_references(bag)).alias("node_id"))


@query("WITH " + _REFS + " SELECT id AS node_id FROM refs ORDER BY id LIMIT 200")
def unresolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what isn't resolved yet, the first by id."""
    n = _reference_nodes(spark, sf_dir)
    return Api(Graph(n, n)).unresolved().nodes.select("node_id")


# ---- small functions

@query("SELECT 'api-operation:'||o_orderkey AS node_id, 'GET' AS method, '/orders/'||o_orderkey AS route FROM orders")
def api_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method and route of operations, from their names."""
    return links.api_signature(lift.nodes(spark, sf_dir).where("node_type = 'API_OPERATION'"))


@query("""SELECT p_partkey, replace(p_name, ' ', '-') AS kebab, upper(p_name[1])||split_part(p_name, ' ', 1)[2:]||upper(split_part(p_name, ' ', 2)[1])||split_part(p_name, ' ', 2)[2:] AS pascal, upper(p_name[1])||split_part(p_name, ' ', 1)[2:]||' '||upper(split_part(p_name, ' ', 2)[1])||split_part(p_name, ' ', 2)[2:] AS display, p_brand||' '||p_name AS compact, '/api/parts/'||p_partkey AS route, p_brand <> 'APP' AS external FROM part""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as files, classes and screens show them."""
    p = table(spark, sf_dir, "part")
    route = routes.combined(F.lit("api/[controller]"), _text("parts/", F.col("p_partkey")))
    return p.select(
        "p_partkey", names.kebab("p_name").alias("kebab"), names.pascal("p_name").alias("pascal"), names.display_from_route(_text("/", names.kebab("p_name"), "/{id}")).alias("display"),
        names.compacted(_text("  ", F.col("p_brand"), " \n ", F.col("p_name"), " ")).alias("compact"), F.regexp_replace(route, r"\[controller\]/", "").alias("route"), names.external_schema(_text(F.col("p_brand"), ".T"), F.lit("app")).alias("external"),
    )


@query("""SELECT DISTINCT unnest(['table:DB'||l_suppkey||':T'||l_partkey, 'column:DB'||l_suppkey||':T'||l_partkey||':C'||l_linenumber, 'job:N'||l_orderkey||':J'||l_linenumber]) AS stable_id FROM lineitem""")
def authoritative_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all tables, columns and jobs that the tables beside the packages name."""
    li = table(spark, sf_dir, "lineitem")
    t = li.select(_text("DB", F.col("l_suppkey")).alias("database"), _text("T", F.col("l_partkey")).alias("table_code"), _text("C", F.col("l_linenumber")).alias("column_code"))
    jobs = li.select(_text("N", F.col("l_orderkey")).alias("jobnet_id"), _text("J", F.col("l_linenumber")).alias("job_id"))
    return packages.authoritative_ids(t, t, jobs)


@query("""SELECT o_orderkey, 'edge:'||sha256('a|READS|b'||o_orderkey||'|x|TECHNICAL') AS edge_id, 'unresolved-reference:DEFERRED:'||left(sha256('b'||o_orderkey), 24) AS placeholder_id FROM orders""")
def hashed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that are hashes of what they stand for."""
    b = _text("b", F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", ids.edge_id(F.lit("a"), F.lit("READS"), b, F.lit("x"), F.lit("TECHNICAL")).alias("edge_id"), ids.placeholder_id(b).alias("placeholder_id"))


# ---- reports

@query("""WITH c AS (SELECT source AS path, CASE WHEN doc_id % 5 = 0 THEN 'OTHER' ELSE upper(lang) END AS class, count(*) AS n FROM documents GROUP BY ALL) SELECT path AS source_path, CAST(sum(n) AS BIGINT) AS comments, string_agg(class||'='||n, ', ' ORDER BY class) AS summary FROM c GROUP BY path""")
def comment_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of each file by class."""
    d = table(spark, sf_dir, "documents")
    bag = F.when(F.col("doc_id") % 5 == 0, F.lit("{}")).otherwise(F.to_json(F.struct(F.upper("lang").alias("classification"))))
    return reports.comment_classes(d.select(F.col("source").alias("source_path"), bag.alias("properties_json")))


@query("""WITH f AS (SELECT p_partkey, 'src/'||p_brand||'/'||replace(p_name, ' ', '_')||CASE WHEN p_partkey % 2 = 0 THEN '.sql' ELSE '.pkb' END AS path, 'src/'||p_brand||'/'||replace(p_name, ' ', '_')||'.md' AS out FROM part) SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY out) > 1 THEN path||'.md' ELSE out END AS output_path FROM f""")
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of rendered files; those that would collide keep their ending."""
    ending = F.when(F.col("p_partkey") % 2 == 0, ".sql").otherwise(".pkb")
    p = table(spark, sf_dir, "part").select("p_partkey", _text("src/", F.col("p_brand"), "/", F.replace("p_name", F.lit(" "), F.lit("_")), ending).alias("relative_path"))
    return reports.output_paths(p).select("p_partkey", "output_path")


@query("""SELECT 'part:'||l_partkey AS node_id, min({'a': CAST(l_linenumber AS BIGINT), 'b': 'order:'||l_orderkey}).a AS start_line, min({'a': CAST(l_linenumber AS BIGINT), 'b': 'order:'||l_orderkey}).b AS source_path FROM lineitem GROUP BY l_partkey""")
def first_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each node is declared first."""
    n = F.col("l_linenumber").cast("long")
    e = table(spark, sf_dir, "lineitem").select(F.lit("NODE").alias("target_type"), _text("part:", F.col("l_partkey")).alias("target_id"), _text("order:", F.col("l_orderkey")).alias("source_path"), n.alias("start_line"), (n + F.col("l_quantity").cast("long")).alias("end_line"))
    return reports.declarations(e).select("node_id", "start_line", "source_path")


@query("SELECT l_orderkey, l_linenumber AS line, CAST(min(l_quantity) AS BIGINT) AS \"offset\" FROM lineitem GROUP BY ALL")
def first_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place on each line."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("long").alias("offset"))
    return reports.first_offsets(li, ["l_orderkey"])


@query("""WITH e AS (SELECT p_partkey, 'api-operation:app:GET:'||replace(p_name, ' ', '-') AS scoped, p_brand AS path, p_size FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY scoped ORDER BY path, p_size, p_partkey) AS n FROM e) SELECT p_partkey, n = 1 AS keeps, CASE WHEN n = 1 THEN scoped END AS kept_id FROM r""")
def api_operation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of endpoints of one route, the first keeps its id, the others have their own."""
    p = table(spark, sf_dir, "part")
    e = p.select("p_partkey", _text("api-operation:app:GET:", F.replace("p_name", F.lit(" "), F.lit("-"))).alias("scoped_id"), F.col("p_brand").alias("relative_path"), F.col("p_size").alias("start"), F.col("p_partkey").alias("handler_end"), _text("e", F.col("p_partkey")).alias("endpoint_key"))
    r = reports.operation_ids(e, F.lit("app"))
    keeps = F.col("operation_id") == F.col("scoped_id")
    return r.select("p_partkey", keeps.alias("keeps"), F.when(keeps, F.col("operation_id")).alias("kept_id"))


@query("""WITH x AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) ELSE lower(p_type) END AS executable, p_partkey, unnest([lower(p_type), CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) END]) AS name FROM part) SELECT executable, count(DISTINCT p_partkey) AS projects, array_to_string(list_sort(list_distinct(list(name) FILTER (WHERE name IS NOT NULL))), ',') AS names FROM x GROUP BY executable""")
def executable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executables by target or assembly, and the names that lead to them."""
    p = table(spark, sf_dir, "part")
    target = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper("p_brand"), F.lit(".EXE"))).otherwise(" ")
    x = reports.executables(p.select(F.col("p_partkey").cast("string").alias("project"), F.concat(F.col("p_type"), F.lit(".dll")).alias("assembly_name"), target.alias("target_name")))
    return x.select("executable", "projects", F.array_join("names", ",").alias("names"))


@query("""WITH i AS (SELECT 'catalog/'||p_brand AS p, p_partkey AS line, 'CATALOG_INVALID_ROW' AS t, p_name AS m, row_number() OVER (ORDER BY 'catalog/'||p_brand, p_partkey) AS n FROM part) SELECT 'issues' AS part, n, '- '||t||': '||m||' ('||p||')' AS line FROM i WHERE n <= 100 UNION ALL SELECT 'metrics', row_number() OVER (ORDER BY r_name), '- '||r_name||': '||r_regionkey||'.0' FROM region""")
def quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and the first hundred catalog issues of a report."""
    m = table(spark, sf_dir, "region").select(F.col("r_name").alias("metric_name"), F.col("r_regionkey").cast("double").alias("metric_value"))
    i = table(spark, sf_dir, "part").select(_text("catalog/", F.col("p_brand")).alias("source_path"), F.col("p_partkey").alias("line"), F.lit("CATALOG_INVALID_ROW").alias("issue_type"), F.col("p_name").alias("message"))
    return reports.quality_lines(m, i).withColumn("n", F.col("n").cast("long"))


@query("""SELECT p_partkey, 'tables/v3/'||left(sha256(p_brand||'|'||p_type||'|'||p_name), 24)||'.csv' AS file, CASE p_partkey % 4 WHEN 0 THEN 'out/'||p_partkey||'.csv' END AS safe FROM part""")
def column_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed names of column files, and which output names are safe."""
    k = F.col("p_partkey")
    m = k % 4
    asked = F.when(m == 0, _text("out\\", k, ".csv")).when(m == 1, _text("../", k, ".csv")).when(m == 2, _text("/x/", k, ".csv")).otherwise(_text("tables/v3/", k, ".CSV"))
    return table(spark, sf_dir, "part").select("p_partkey", reports.column_file(F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("file"), reports.safe_output(asked).alias("safe"))
