"""Files, packages, catalogs, mappers, configuration, publication and streaming: written, read again, compared."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from weftline.model import COLUMNS
from weftline.operators import api
from weftline.session import ship
from weftline.sources import catalog, config, files, mappers, packages, publish
from weftline.streaming import ingest
from tests.test_graph import edge, make, node


def test_files(spark, tmp_path):
    (tmp_path / "src/node_modules/x").mkdir(parents=True)
    (tmp_path / "src/a").mkdir()
    (tmp_path / "src/a/x.sql").write_bytes("-- 日本語のコメント\nselect 1".encode("cp932"))
    (tmp_path / "src/a/y.sql").write_bytes(b"\xef\xbb\xbfselect 2\r\n")
    (tmp_path / "src/big.sql").write_bytes(b"x" * 2000)
    (tmp_path / "src/a/z.test.ts").write_text("no")
    (tmp_path / "src/node_modules/x/q.sql").write_text("no")
    (tmp_path / "src/a/page.html").write_text('<meta charset="utf-8">é')
    got, issues = files.read_sources(spark, str(tmp_path / "src"), (".sql", ".ts", ".html"), most=1000)
    rows = {r["relative_path"]: r for r in got.collect()}
    assert set(rows) == {"a/x.sql", "a/y.sql", "a/page.html"}
    assert rows["a/x.sql"]["encoding"] == "cp932" and "日本語" in rows["a/x.sql"]["text"] and rows["a/y.sql"]["encoding"] == "utf-8-sig" and rows["a/y.sql"]["newline_style"] == "CRLF" and rows["a/page.html"]["declared"] == "utf-8"
    assert [tuple(r) for r in issues.collect()] == [("big.sql", "FILE_TOO_LARGE")]
    bad, more = files.read_sources(spark, str(tmp_path / "src"), (".sql",), most=1000, overrides=[("a/*.sql", "utf-8")])
    assert {tuple(r) for r in more.collect()} == {("big.sql", "FILE_TOO_LARGE"), ("a/x.sql", "DECODE_ERROR")} and bad.count() == 1
    assert {r["relative_path"]: r["database"] for r in files.tagged(got, [("a", "DB1"), ("a/x", "DB2")]).collect()}["a/x.sql"] == "DB1"


def test_packages(spark, tmp_path):
    row = {c: "" for c in COLUMNS["nodes"]} | {"node_id": "n1", "node_type": "TABLE", "technical_name": 'say "hi",\nthere', "confidence": "0.5", "properties_json": '{"a":"b"}'}
    g = make(spark, [node("n2", "TABLE"), node("n1", "TABLE", 'say "hi",\nthere', '{"a":"b"}', 0.5)], [edge("e1", "n1", "n2", "USES")])
    sums = packages.write_package(g, str(tmp_path / "p"))
    assert set(sums) == {"nodes", "edges"} and (tmp_path / "p/nodes.csv").read_text().startswith("node_id,") or (tmp_path / "p/nodes.csv").read_text().startswith('"node_id"')
    read, clash = packages.read_packages(spark, [str(tmp_path / "p")])
    got = {r["node_id"]: r for r in read.nodes.collect()}
    assert got["n1"]["technical_name"] == row["technical_name"] and got["n1"]["confidence"] == 0.5 and got["n1"]["properties_json"] == '{"a":"b"}' and read.edges.count() == 1 and clash.count() == 0
    packages.write_package(make(spark, [node("n1", "VIEW")], [edge("e1", "n1", "n2", "USES")]), str(tmp_path / "q"))
    both, clash = packages.read_packages(spark, [str(tmp_path / "p"), str(tmp_path / "q")])
    assert both.nodes.count() == 2 and both.edges.count() == 1 and [tuple(r) for r in clash.collect()] == [("nodes", "n1", 2)]
    assert packages.conflict_issues(clash).first()["issue_type"] == "MERGE_CONFLICT"


def test_auxiliary_tables(spark, tmp_path):
    (tmp_path / "tables.csv").write_text("database,table_code,schema,columns_file\nDB1,ORDERS,APP,c/o.csv\nDB2,X,S,\n")
    (tmp_path / "c").mkdir()
    (tmp_path / "c/o.csv").write_text("column_code,data_type,nullable,ordinal_position,schema\nID,NUMBER,N,1,APP\n")
    t, c = packages.catalog_tables(spark, str(tmp_path), "db1")
    assert t.count() == 1 and [(r["table_code"], r["column_code"]) for r in c.collect()] == [("ORDERS", "ID")]
    jobs = spark.createDataFrame([("NET", "A", "", "c:\\run\\Load.exe"), ("NET", "B", "A", "")], "jobnet_id string, job_id string, predecessor_job_id string, executable_name string")
    assert {r[0] for r in packages.authoritative_ids(t, c, jobs).collect()} == {"table:DB1:ORDERS", "column:DB1:ORDERS:ID", "job:NET:A", "job:NET:B"}
    nodes, edges = packages.job_networks(jobs)
    assert {r["node_id"] for r in nodes.collect()} == {"job-network:NET", "job:NET:A", "job:NET:B", "executable:load"}
    assert sorted(r["edge_type"] for r in edges.collect()) == ["CONTAINS", "CONTAINS", "DEPENDS_ON", "STARTS"]


PROFILE = {"name": "net", "catalogType": "batch-jobs", "match": {"filename": "scheduler-*.csv", "requiredHeaders": ["Network", "Step"]}, "fields": {"jobnet_id": "network", "job_id": {"column": "step", "default": "none"}, "kind": {"constant": "JOB"}}, "transforms": {"jobnet_id": ["trim", "upper"]}, "output": {"filename": "jobnet.csv", "identity": ["jobnet_id", "job_id"]}}


def test_catalog(spark, tmp_path):
    at = tmp_path / "incoming"
    at.mkdir()
    (at / "database-tables__DB1.csv").write_text("database_key,schema_name,object_name,object_type,status,comment\nDB1,app,orders,,valid,Order header\nDB2,APP,X,TABLE,,\nDB1,APP,,TABLE,,\nDB1,APP,Q,INDEX,,\nDB1,OLD,ORDERS,VIEW,,\n")
    (at / "database-columns__DB1.csv").write_text("database_key,schema_name,object_name,column_name,ordinal_position,data_type\nDB1,APP,ORDERS,id,1,number\nDB1,APP,NONE,id,1,number\nDB1,APP,ORDERS,ID,2,varchar2\n")
    (at / "scheduler-1.csv").write_text("Network,Step,Extra\n n1 ,s1,\nn1,,\nn1,s1,\n")
    (at / "odd.csv").write_text("a,b\n1,2\n")
    got = catalog.import_catalog(spark, str(tmp_path), [catalog.profile(PROFILE)])
    assert sorted((r["schema_name"], r["object_name"], r["object_type"]) for r in got.tables.collect()) == [("APP", "ORDERS", "TABLE"), ("OLD", "ORDERS", "VIEW")]
    assert [(r["column_name"], r["data_type"]) for r in got.columns.collect()] == [("ID", "NUMBER")]
    assert sorted(tuple(r) for r in got.normalized["jobnet.csv"].select("jobnet_id", "job_id", "kind").collect()) == [("N1", "none", "JOB"), ("N1", "s1", "JOB")]
    rep = {r["path"]: (r["rows_read"], r["rows_imported"], r["rows_rejected"], r["status"]) for r in got.reports.collect()}
    assert rep == {"catalog/database-tables__DB1.csv": (5, 2, 3, "partial"), "catalog/database-columns__DB1.csv": (3, 1, 2, "partial"), "catalog/scheduler-1.csv": (3, 3, 0, "imported"), "catalog/odd.csv": (0, 0, 0, "rejected")}
    g = catalog.catalog_graph(got, "SYS")
    ids = {r["node_id"] for r in g.nodes.collect()}
    assert {"database:DB1", "database-schema:DB1:APP", "database-schema:DB1:OLD", "table:DB1:APP.ORDERS", "table:DB1:OLD.ORDERS", "column:DB1:APP.ORDERS:ID"} == ids and g.edges.count() == 5
    with pytest.raises(ValueError):
        catalog.import_catalog(spark, str(tmp_path), [catalog.profile(PROFILE)], strict=True)
    with pytest.raises(ValueError):
        catalog.choose("scheduler-1.csv", ["Network", "Step"], [catalog.profile(PROFILE)] * 2)
    with pytest.raises(ValueError):
        catalog.profile(PROFILE | {"transforms": {"jobnet_id": ["explode"]}})
    assert catalog.inspect(spark, str(at / "database-tables__DB1.csv"))["database_key"] == "DB1"


MAP = """<?xml version="1.0"?><mapper namespace="m">
<sql id="cols">a, b <include refid="cols2"/></sql><sql id="cols2">c <include refid="cols"/></sql>
<select id="find">select <include refid="cols"/> from t <where><if test="x != null">and x = #{x}</if></where> <include refid="o.shared"/><include refid="${dyn}"/><include refid="gone"/></select></mapper>"""


def test_mappers(spark):
    f = spark.createDataFrame([("m.xml", MAP), ("o.xml", '<mapper namespace="o"><sql id="shared">order by 1</sql><update id="u">update t set a = 1</update></mapper>'), ("p.xml", "<project/>"), ("bad.xml", "<mapper><oops></mapper>"), ("n.xml", None)], "relative_path string, text string")
    rows = {r["id"]: r for r in mappers.statements(f).collect()}
    find = rows["find"]
    assert find["kind"] == "SELECT" and find["sql"] == "select a, b c from t and x = #{x} order by 1" and find["line"] == 3
    assert [i["type"] for i in find["issues"]] == ["CYCLIC_INCLUDE", "DYNAMIC_INCLUDE", "UNKNOWN_INCLUDE"]
    tree = json.loads(find["semantic_tree"])
    assert [s["type"] for s in tree] == ["sql", "include", "sql", "scope", "include", "include", "include"] and tree[3]["steps"][0]["condition"] == "x != null"
    assert rows[""]["kind"] == "INVALID"
    q = mappers.query_ids(mappers.statements(f))
    assert {r[0] for r in q.collect()} == {"m.find", "o.u"}
    assert mappers.mapper_references(spark.createDataFrame([("k", "m.find"), ("k", "m.none")], "k string, value string"), q).count() == 1


def test_projects_and_configuration(spark):
    ship(spark)
    f = spark.createDataFrame([("a.sln", 'Project("{1}") = "A", "src\\A\\A.csproj", "{2}"'), ("src/A/A.csproj", '<ProjectReference Include="..\\B\\B.csproj" /><Compile Include="x.cs"/>'), ("src/B/B.csproj", '<ProjectReference Include="..\\A\\A.csproj" />')], "relative_path string, text string")
    got = mappers.project_closure(f, f.where("relative_path = 'a.sln'").select("relative_path"))
    assert {r[0] for r in got.collect()} == {"a.sln", "src/A/A.csproj", "src/B/B.csproj", "src/A/x.cs"}
    c = spark.createDataFrame([("appsettings.json", '{"A":{"B":1,"C":[true]}}'), ("Web.config", '<c><add key="k" value="v"/><add name="n" connectionString="s"/></c>'), ("x.json", "bad")], "p string, t string").select(F.explode(mappers.config_keys("p", "t")).alias("x")).collect()
    assert [tuple(r["x"]) for r in c] == [("A.B", "1"), ("A.C.0", "True"), ("k", "v"), ("n", "s")]


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"root": "${WHERE}/x", "sources": [{"type": "plsql"}], "enrichment": {"flowMaxDepth": 3}, "limits": {"maxFileBytes": 5}}))
    (tmp_path / ".env").write_text("# c\nexport WHERE='in'\n")
    got = config.load(str(p), {})
    assert got["root"] == str(tmp_path / "in/x") and config.options(got).flow_max_depth == 3 and config.options(got).max_file_bytes == 5
    with pytest.raises(ValueError):
        config.expanded("${NOPE}", {})
    p.write_text(json.dumps({"sources": [{"type": "cobol"}]}))
    with pytest.raises(ValueError):
        config.load(str(p), {})
    with pytest.raises(ValueError):
        config.options({"limits": {"maxFileBytes": 0}})


def test_publish_and_export(spark, tmp_path):
    ship(spark)
    nodes = [node("s", "SCREEN", "Home"), node("o", "API_OPERATION", "GET /x", '{"route":"/x/{id}"}'), node("t", "TABLE", "T"), node("tt", "TABLE", "T"), node("u", "UNRESOLVED_REFERENCE", "T", '{"table":"T"}')]
    g = make(spark, nodes, [edge("1", "s", "o", "CALLS_API"), edge("2", "o", "t", "READS_FROM", 0.6), edge("3", "o", "tt", "READS_FROM", 0.7)])
    out = str(tmp_path / "g")
    m = publish.publish(g, out)
    assert m["tables"]["nodes"] == 4 and m["tables"]["edges"] == 2 and m["tables"]["flows"] == 2 and m["tables"]["resolution_candidates"] == 1 and m["tables"]["io_items"] == 3
    a = api.from_parquet(spark, out)
    assert {r["target"] for r in a.trace_flow("s").collect()} == {"t"} and a.trace_flow("o").count() == 2
    assert {r["metric_name"]: r["metric_value"] for r in a.health().where("scope_type = 'GLOBAL'").collect()}["flows"] == 2
    assert a.search_memory("get /x").count() == 1 and [r["name"] for r in a.input_output("o").collect()] == ["T", "id"]
    assert {r["candidate_node_id"] for r in a.unresolved().data["candidates"].collect()} == {"t"}
    publish.publish(g, out)  # over what it wrote itself
    sums = publish.export_markdown(out, str(tmp_path / "md"), spark, chunk_bytes=150)
    assert any(n.startswith("tables") for n in sums) and "## T" in "".join((tmp_path / "md" / n).read_text() for n in sums)
    publish.export_memory(publish.read_published(spark, out)[1], str(tmp_path / "mem"))
    assert publish.read_memory(spark, str(tmp_path / "mem")).count() == 4
    other = tmp_path / "other"
    other.mkdir()
    (other / "x").write_text("mine")
    with pytest.raises(ValueError):
        publish.publish(g, str(other))
    with pytest.raises(ValueError):
        publish.publish(make(spark, [node("a")], [edge("1", "a", "gone")]), str(tmp_path / "h"), linked=False)
    assert (other / "x").read_text() == "mine"


def test_stream(spark, tmp_path):
    g = make(spark, [node("n1"), node("n2")], [edge("e", "n1", "n2")])
    for k in ("p1", "p2"):
        packages.write_package(g, str(tmp_path / "in" / k))
        for x in (tmp_path / "in" / k).iterdir():
            if x.name != "nodes.csv":
                x.unlink()
    q = ingest.append(ingest.arriving(spark, "nodes", str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["node_id"] for r in got.collect()) == ["n1", "n2"]


def test_sql_graph(spark):
    from tests.test_text import PLSQL
    from weftline.sources.extract import loader_graph, sql_graph

    f = spark.createDataFrame([("pkg.pkb", PLSQL), ("q.sql", "insert into app.log select * from orders o join other.x on 1=1 join s on 1=1 join nowhere on 1=1; select (1 from t"), ("none.sql", None)], "relative_path string, text string")
    tables = spark.createDataFrame([("DB1", "APP", "ORDERS"), ("DB1", "APP", "LOG"), ("DB2", "APP", "NOWHERE")], "database_key string, schema_name string, object_name string")
    g = sql_graph(f, tables, "DB1", "APP")
    kinds = {r["node_id"]: r["node_type"] for r in g.nodes.collect()}
    e = {(r["source_node_id"].split(":")[0], r["edge_type"], r["target_node_id"], r["raw_operation"]) for r in g.edges.collect()}
    assert ("sql-file", "WRITES_TO", "table:DB1:LOG", "INSERTS") in e and ("sql-file", "READS_FROM", "table:DB1:ORDERS", "SELECT") in e
    assert ("sql-file", "REMOTE_READS", "external-database-object:DB1:OTHER.TAB@LNK", "SELECT") in e  # through the synonym
    assert kinds["external-database-object:DB1:OTHER.X"] == "EXTERNAL_DATABASE_OBJECT" and kinds["unresolved-reference:DB1:NOWHERE"] == "UNRESOLVED_REFERENCE"
    assert ("function", "CONTAINS", "procedure:DB1:INNER:void", "") in e and ("function", "USES_SEQUENCE", "sequence:DB1:SEQ", "") in e
    assert ("procedure", "CALLS", "function:DB1:F:NUMBER,VARCHAR2,DATE", "") in e and ("function", "CALLS", "unresolved-reference:DB1:routine:OTHER_PKG.CALL_IT", "") in e
    assert {r["issue_type"] for r in g.issues.collect()} == {"PARSE_ERROR", "TABLE_NOT_FOUND", "DYNAMIC_SQL"}
    assert {r["source_node_id"] for r in g.edges.collect()} | {r["target_node_id"] for r in g.edges.collect()} <= set(kinds)
    ctl = spark.createDataFrame([("a.ctl", "load data infile 'a.dat' into table app.t (id, nope)"), ("b.ctl", "nothing")], "relative_path string, text string")
    cols = spark.createDataFrame([("DB1", "T", "ID")], "database_key string, object_name string, column_name string")
    lo = loader_graph(ctl, cols, "DB1")
    assert {(r["edge_type"], r["target_node_id"]) for r in lo.edges.collect()} == {("LOADS_INTO", "table:DB1:T"), ("MAPS_TO", "column:DB1:T:ID"), ("READS_FROM", "data-file:a.dat")}
    assert sorted(r["issue_type"] for r in lo.issues.collect()) == ["COLUMN_NOT_FOUND", "NOT_A_CONTROL_FILE"]
