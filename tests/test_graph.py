"""Graph operators on small graphs with cycles, ties, duplicates and gaps, against plain Python."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from weftline.model import COLUMNS, FLOW, FLOW_TARGETS, Graph, Options
from weftline.operators import api, dedupe, enrich, links, memory, metrics, structure, traverse
from weftline.session import ship

NODE = ", ".join(f"{c} {'double' if c == 'confidence' else 'string'}" for c in (*COLUMNS["nodes"], "package_key"))
EDGE = ", ".join(f"{c} {'double' if c == 'confidence' else 'string'}" for c in COLUMNS["edges"])


def node(i, kind="METHOD", name=None, props="{}", conf=1.0, db="", system="", qualified=None):
    return (i, kind, name or i, qualified if qualified is not None else (name or i), name or i, system, db, "", "MAIN", conf, props, "sources/a")


def edge(i, a, b, kind="CALLS", conf=1.0, layer="TECHNICAL"):
    return (i, a, b, kind, layer, "", conf, "{}")


def make(spark, nodes, edges):
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))


def random_graph(seed: int, n: int = 30, m: int = 70):
    rng = random.Random(seed)
    kinds = ["METHOD", "METHOD", "PROCEDURE", "TABLE", "UI_ACTION", "UNRESOLVED_REFERENCE"]
    nodes = [node(f"n{i:02}", rng.choice(kinds), conf=rng.choice([1.0, 0.5])) for i in range(n)]
    edges = [edge(f"e{j:03}", f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}", rng.choice(["CALLS", "READS_FROM", "USES", "CONTAINS"]), rng.choice([1.0, 0.9, 0.3])) for j in range(m)]
    return nodes, edges


@pytest.mark.parametrize("direction", ["out", "in"])
def test_trace_equals_a_queue(spark, direction):
    nodes, edges = random_graph(1)
    g = make(spark, nodes, edges)
    kinds = {n[0]: n[1] for n in nodes}
    starts = ["n00", "n05"]
    depth, targets, walked, queue = {s: 0 for s in starts}, set(), set(), deque(starts)
    while queue:
        at = queue.popleft()
        if depth[at] >= 4:
            continue
        for e in edges:
            a, b = (e[1], e[2]) if direction == "out" else (e[2], e[1])
            if a != at:
                continue
            walked.add(e[0])
            if kinds[b] == "TABLE":
                targets.add(b)
                depth.setdefault(b, depth[at] + 1)
            elif b not in depth:
                depth[b] = depth[at] + 1
                queue.append(b)
    t = traverse.trace(g, spark.createDataFrame([(s,) for s in starts], "node_id string"), direction, frozenset({"TABLE"}), max_depth=4, db_rule=False)
    got = t.nodes.collect()
    assert {r["node_id"]: r["depth"] for r in got} == depth and {r["node_id"] for r in got if r["target"]} == targets
    assert {r["edge_id"] for r in t.edges.collect()} == walked and not t.truncated


def test_budgets_truncate(spark):
    g = make(spark, [node(f"n{i}") for i in range(20)], [edge(f"e{i:02}", "n0", f"n{i}") for i in range(1, 20)])
    start = spark.createDataFrame([("n0",)], "node_id string")
    t = traverse.trace(g, start, options=Options(max_nodes=6, max_edges=100))
    assert t.truncated and t.nodes.count() == 6
    t = traverse.trace(g, start, options=Options(max_nodes=100, max_edges=7))
    assert t.truncated and t.edges.count() == 7
    assert traverse.trace(g, start.where("false")).nodes.count() == 0


@pytest.mark.parametrize("cap", [2, 100])
def test_flows_equal_a_queue(spark, cap):
    nodes, edges = random_graph(7, 40, 120)
    g = make(spark, nodes, edges)
    kinds, conf = {n[0]: n[1] for n in nodes}, {n[0]: n[9] for n in nodes}
    adj: dict = {}
    for e in sorted(edges, key=lambda e: (e[3], e[2], e[0])):
        if e[3] in FLOW:
            adj.setdefault(e[1], []).append(e)
    want = set()
    for s in sorted(kinds):
        if kinds[s] != "UI_ACTION":
            continue
        path, queue, targets = {s: ((s,), (), conf[s])}, deque([s]), []
        while queue and len(targets) < cap:
            at = queue.popleft()
            if len(path[at][1]) >= 8:
                continue
            for e in adj.get(at, ()):
                if e[2] in path:
                    continue
                p = path[at]
                path[e[2]] = ((*p[0], e[2]), (*p[1], e[0]), min(p[2], e[6]))
                if kinds[e[2]] in FLOW_TARGETS:
                    targets.append(e[2])
                    if len(targets) >= cap:
                        break
                else:
                    queue.append(e[2])
        want |= {(s, t, path[t][0], path[t][1], path[t][2], kinds[t] != "UNRESOLVED_REFERENCE") for t in targets}
    f = traverse.flows(g, Options(max_flow_targets=cap, flow_entry_types=frozenset({"UI_ACTION"})))
    assert {(r["start"], r["target"], tuple(r["nodes"]), tuple(r["edges"]), r["confidence"], r["complete"]) for r in f.flows.collect()} == want and want
    assert f.steps.count() == sum(len(w[2]) for w in want)


def test_shortest_paths_and_reachability(spark):
    nodes, edges = random_graph(3)
    g = make(spark, nodes, edges)
    starts = spark.createDataFrame([("n00",), ("n01",)], "node_id string")
    got = {(r["start"], r["target"]): (r["depth"], tuple(r["edges"])) for r in traverse.shortest_paths(g.edges, starts, g.nodes, frozenset({"TABLE"}), 5).collect()}
    kinds = {n[0]: n[1] for n in nodes}
    want = {}
    for s in ("n00", "n01"):
        best, layer = {s: ()}, {s: ()}
        for depth in range(1, 6):
            nxt: dict = {}
            for at, p in layer.items():
                for e in edges:
                    if e[1] == at and e[2] not in best:
                        nxt[e[2]] = min(nxt.get(e[2], (*p, e[0])), (*p, e[0]))
            best |= nxt
            want |= {(s, t): (depth, p) for t, p in nxt.items() if kinds[t] == "TABLE"}
            layer = nxt
    assert got == want
    seen = {r[0] for r in traverse.reachable(g.edges, starts).collect()}
    todo, closed = ["n00", "n01"], {"n00", "n01"}
    while todo:
        at = todo.pop()
        for e in edges:
            if e[1] == at and e[2] not in closed:
                closed.add(e[2])
                todo.append(e[2])
    assert seen == closed


def test_relationships_and_labels(spark):
    g = make(spark, [node("u", "SCREEN"), node("a", "API_OPERATION"), node("p", "PROCEDURE"), node("t", "TABLE"), node("j", "JOB")], [edge("1", "u", "a", "CALLS_API", 0.8), edge("2", "a", "p", "CALLS", 0.9), edge("3", "p", "t", "READS_FROM", 0.7), edge("4", "j", "p", "STARTS")])
    r = {(x["kind"], x["start"], x["target"]): x["confidence"] for x in traverse.relationships(g, FLOW, frozenset({"SCREEN"}), frozenset({"JOB"}), frozenset({"TABLE"})).collect()}
    assert r == {("API_DB", "a", "t"): 0.7, ("UI_API", "u", "a"): 0.8, ("JOB_DB", "j", "t"): 0.7}
    seeds = spark.createDataFrame([("u", "web"), ("t", "db")], "node_id string, label string")
    assert {x["node_id"]: x["label"] for x in traverse.propagated_labels(seeds, g.edges, FLOW).collect()} == {"u": "web", "a": "web", "p": "db", "t": "db", "j": "db"}
    src = spark.createDataFrame([("s1", "repo1", "", "x.cs"), ("s2", "repo2", "", "y.cs"), ("s3", "repo2", "", "z.cs")], "source_key string, repository_key string, system_key string, relative_path string")
    ev = spark.createDataFrame([("NODE", "t", "y.cs")], "target_type string, target_id string, source_path string")
    lab = {x["node_id"]: x["label"] for x in traverse.seed_labels(g.nodes.withColumn("repository_key", F.when(F.col("node_id") == "u", "repo1").otherwise("repo2")), ev, src).collect()}
    assert lab == {"u": "s1", "a": None, "p": None, "t": "s2", "j": None}


def test_links(spark):
    n = [node("c1", "API_CALL_REFERENCE", props='{"method":"get","route":"/orders/{x}"}'), node("c2", "API_CLIENT_CALL", "POST /v1/save"), node("c3", "API_CLIENT_CALL", "not a call"), node("o1", "API_OPERATION", "GET /orders/{id}"), node("o2", "API_OPERATION", "POST /api/v1/save"), node("o3", "API_OPERATION", "POST /b/v1/save")]
    g = make(spark, n, [edge("e", "c1", "c2")])
    sig = links.api_signature(g.nodes)
    got = {r["call_id"]: (r["status"], r["match"], r["candidates"]) for r in links.link_api(sig.where("node_id like 'c%'"), sig.where("node_id like 'o%'")).collect()}
    assert got == {"c1": ("LINKED", "exact", 1), "c2": ("AMBIGUOUS", "unique_suffix", 2)}
    assert links.api_edges(links.link_api(sig.where("node_id like 'c%'"), sig.where("node_id like 'o%'"))).select("confidence", "properties_json").collect() == [(1.0, '{"match":"exact"}')]


def test_deferred_references(spark):
    n = [
        node("t1", "TABLE", "ORDERS", '{"schema":"APP","table":"ORDERS"}', db="DB1"), node("t2", "TABLE", "ORDERS", '{"schema":"OLD","table":"ORDERS"}', db="DB1"), node("c1", "COLUMN", "ID", '{"schema":"APP","table":"ORDERS","column":"ID"}', db="DB1"), node("p1", "PROCEDURE", "RUN", '{"package":"PK","routine":"RUN"}', db="DB1"),
        node("r1", "UNRESOLVED_REFERENCE", "app.orders", '{"table":"orders","schema":"app"}', db="db1"), node("r2", "UNRESOLVED_REFERENCE", "orders", '{"table":"orders"}', db="db1"), node("r3", "UNRESOLVED_REFERENCE", "orders@lnk", '{"table":"orders"}', db="db1"), node("r4", "UNRESOLVED_REFERENCE", "id", '{"table":"orders","column":"id"}', db="db1"), node("r5", "UNRESOLVED_REFERENCE", "run", '{"routine":"run","package":"other"}', db="db1"), node("r6", "UNRESOLVED_REFERENCE", "app.orders", db="db1"), node("r7", "UNRESOLVED_REFERENCE", "app.orders", db="db1"),
    ]
    g = make(spark, n, [edge("x", "p1", "r6", "READS_FROM"), edge("y", "p1", "r7", "CALLS"), edge("z", "p1", "r1", "READS_FROM", 0.4), edge("w", "p1", "t1", "READS_FROM", 0.9)])
    got = {r["ref_id"]: (r["kind"], r["status"], r["target_id"]) for r in links.resolve_deferred(g.nodes, g.edges).collect()}
    assert got == {"r1": ("object", "RESOLVED", "t1"), "r2": ("object", "AMBIGUOUS", "t1"), "r4": ("column", "RESOLVED", "c1"), "r5": ("routine", "RESOLVED", "p1"), "r6": ("object", "RESOLVED", "t1")}
    assert {r[0] for r in links.resolve_deferred(g.nodes, g.edges, database=False).select("ref_id").collect()} == {"r5"}
    assert links.resolution_issues(links.resolve_deferred(g.nodes, g.edges)).select("issue_type").collect() == [("AMBIGUOUS_DB_LINK",)]
    alias = links.resolve_deferred(g.nodes, g.edges).where("status = 'RESOLVED'").select(F.col("ref_id").alias("old_id"), F.col("target_id").alias("new_id"))
    ev = spark.createDataFrame([("EDGE", "z"), ("NODE", "r1"), ("NODE", "r2")], "target_type string, target_id string")
    new = links.replace_nodes(g.with_(evidence=ev), alias)
    assert new.nodes.where("node_id = 'r1'").count() == 0
    reads = new.edges.where("edge_type = 'READS_FROM'").collect()
    assert [(e["target_node_id"], e["confidence"]) for e in reads] == [("t1", 1.0)]  # those of r1, r6 and t1 itself
    assert {tuple(r) for r in new.evidence.select("target_type", "target_id").collect()} == {("EDGE", reads[0]["edge_id"]), ("NODE", "t1"), ("NODE", "r2")}


def test_dangling_and_keys(spark):
    ev = spark.createDataFrame([("EDGE", "gone"), ("NODE", "m"), ("EDGE", "e1")], "target_type string, target_id string")
    g = make(spark, [node("m", system="S")], [edge("e1", "m", "table:DB:APP.T")]).with_(evidence=ev)
    d = links.dangling(g).collect()
    assert [(r["expected_id"], r["label"], r["kind"], r["database_key"], r["system_key"]) for r in d] == [("table:DB:APP.T", "APP.T", "TABLE", "DB", "S")]
    assert links.orphan_evidence(g).count() == 1
    assert {r["reference"]: r["n"] for r in links.broken_keys(g).collect()} == {"edges.source_node_id": 0, "edges.target_node_id": 1, "evidence.node": 0, "evidence.edge": 1}


def test_dedupe_is_independent_of_order(spark):
    ship(spark)
    n = [node("bbb", "TABLE", "T", '{"a":[1],"k":""}', 0.5, qualified="Q"), node("aa", "TABLE", "T", '{"a":[2],"k":"v"}', 0.9, qualified="Q"), node("cc", "TABLE", "T", "{bad", 0.7, qualified="Q"), node("x", "TABLE", "X", qualified=""), node("y", "TABLE", "X", qualified="")]
    e = [edge("1", "bbb", "x", "USES", 0.2), edge("2", "aa", "x", "USES", 0.6), edge("3", "cc", "y", "USES", 0.1)]
    results = []
    for order in (n, n[::-1]):
        g = dedupe.deduplicate(make(spark, order, e).with_(issues=spark.createDataFrame([("i1", "T", "ERROR", "cc", "m"), ("i2", "T", "ERROR", "aa", "m")], "issue_id string, issue_type string, severity string, source_node_id string, message string")))
        results.append((sorted(map(tuple, g.nodes.collect())), sorted(map(tuple, g.edges.collect())), sorted(map(tuple, g.issues.collect()))))
    assert results[0] == results[1]
    nodes, edges, issues = results[0]
    assert [r[0] for r in nodes] == ["aa", "x", "y"] and nodes[0][9] == 0.9 and nodes[0][10] == '{"a":[2,1],"k":"v"}'
    assert sorted((r[1], r[2], r[6]) for r in edges) == [("aa", "x", 0.6), ("aa", "y", 0.1)] and len(issues) == 1
    again = dedupe.deduplicate(Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)))
    assert sorted(map(tuple, again.nodes.collect())) == nodes and sorted(map(tuple, again.edges.collect())) == edges


def test_policies_and_bounds(spark):
    df = spark.createDataFrame([("k", "a", 1), ("k", "a", 2), ("k", "b", 3), ("l", "c", 4)], "k string, v string, line int")
    for policy, value, bad in (("first", "a", 0), ("last", "b", 0), ("error", "a", 1)):
        kept, rejected = dedupe.by_policy(df, ["k"], policy, ["line"])
        assert {r["k"]: r["v"] for r in kept.collect()} == {"k": value, "l": "c"} and rejected.count() == bad
    with pytest.raises(ValueError):
        dedupe.by_policy(df, ["k"], "some", ["line"])
    i = spark.createDataFrame([(f"i{j:02}", "T", "WARNING", "p", "m") for j in range(21)] + [("z", "T", "INFO", "q", "m")], "issue_id string, issue_type string, severity string, source_path string, message string")
    got = dedupe.bounded_issues(i)
    assert got.where("source_path = 'p'").count() == 20 and got.where("message like '2 more%'").count() == 1
    pairs = spark.createDataFrame([('{"a":"1","b":"2"}', '{"b":"3","c":"4"}'), (None, '{"x":"y"}')], "l string, r string")
    assert [r[0] for r in pairs.select(dedupe.merged_edge_properties("l", "r")).collect()] == ['{"a":"1","b":"2","c":"4"}', '{"x":"y"}']


def test_structure(spark):
    decl = spark.createDataFrame([("outer", "f", 1, 200), ("inner", "f", 10, 20), ("later", "f", 300, 310)], "node_id string, source_path string, start_line long, end_line long")
    com = spark.createDataFrame([("c1", "f", 12, 13, "F"), ("c2", "f", 298, 299, "F"), ("c3", "f", 250, 251, "F"), ("c4", "g", 1, 1, "G"), ("c5", "f", 150, 150, "F")], "comment_id string, source_path string, start_line long, end_line long, file_id string")
    assert {r["comment_id"]: (r["owner_node_id"], r["rule"]) for r in structure.comment_owners(com, decl).collect()} == {"c1": ("inner", "INSIDE"), "c2": ("later", "BEFORE"), "c3": ("F", "FILE"), "c4": ("G", "FILE"), "c5": ("outer", "INSIDE")}
    g = make(spark, [node("app", "API_APPLICATION", system="S"), node("pr", "PROJECT", system="S"), node("database:D1", "DATABASE", db="d1"), node("database:D2", "DATABASE", db="D1"), node("v", "VIEW", db="D1"), node("w", "VIEW", db="D9")], [edge("e", "x", "y", "CALLS")])
    new = structure.enrich_hierarchy(g).edges.where("edge_type = 'CONTAINS'").select("source_node_id", "target_node_id").collect()
    assert {tuple(r) for r in new} == {("app", "pr"), ("database:D2", "v"), ("system:S", "app")}
    assert {r["node_id"] for r in structure.systems(g.nodes).collect()} == {"system:S"}
    assert structure.file_structure(spark.createDataFrame([("S", "f1"), ("", "f2")], "system_key string, file_id string")).count() == 1


def test_semantic_io(spark):
    tree = '{"semantic_tree":{"parameters":["raw",{"name":"p","type":"NUMBER","direction":"in out"},{"label":"q","default":"1"}],"return_type":"INT"}}'
    g = spark.createDataFrame([node("f", "FUNCTION", props=tree, conf=0.5), node("x", "TABLE", props=tree)], NODE)
    got = {(r["name"], r["direction"], r["kind"], r["ordinal"], r["required"]) for r in enrich.semantic_io(g).collect()}
    assert got == {("raw", "INPUT", "PLSQL_PARAMETER", 1, False), ("p", "INOUT", "PLSQL_PARAMETER", 2, True), ("q", "INPUT", "PLSQL_PARAMETER", 3, False), ("return", "OUTPUT", "RETURN_VALUE", None, False)}


def test_api(spark):
    n = [node("t", "TABLE", "ORDERS", '{"schema":"APP","table":"ORDERS"}', db="DB1", qualified="APP.ORDERS"), node("s", "SCREEN", "Home"), node("o", "API_OPERATION", "GET /x/{id}"), node("u", "UNRESOLVED_REFERENCE", "OTHER", '{"table":"OTHER"}')]
    g = make(spark, n, [edge("1", "s", "o", "CALLS_API"), edge("2", "o", "t", "READS_FROM", 0.6), edge("3", "o", "u", "READS_FROM")])
    a = api.Api(g)
    ids = lambda df: sorted(r["node_id"] for r in df.collect())
    assert ids(a.impact_api("get", "/x/7").data["targets"]) == ["t", "u"] and ids(a.impact_table("DB1", "APP", "orders").data["targets"]) == ["o"]
    assert ids(a.trace_ui_to_db("home").data["targets"]) == ["t", "u"] and ids(a.trace_ui_to_db("GET /x/{id}").data["targets"]) == ["t", "u"]
    assert a.impact_api("get", "/x/7").confidence() == 0.6 and ids(a.find_node(node_type="table").nodes) == ["t"] and ids(a.find_node(qualified_name="ord%").nodes) == ["t"] and ids(a.unresolved().nodes) == ["u"]
    with pytest.raises(ValueError):
        a.find_edges()
    assert a.explain_node("o").edges.count() == 3 and a.find_node(node_id="none").nodes.count() == 0


def test_memory_and_metrics(spark):
    ship(spark)
    g = make(spark, [node("t", "TABLE", "T"), node("f", "FILE", "F"), node("a", "API_OPERATION", "A")], [edge("1", "a", "t", "READS_FROM")]).with_(issues=spark.createDataFrame([("i", "AMBIGUOUS_X", "a", "", "sources/a")], "issue_id string, issue_type string, source_node_id string, source_path string, package_key string"))
    c = {r["node_id"]: r for r in memory.cards(g).collect()}
    assert set(c) == {"t", "a"} and c["a"]["related"] == ["t"] and c["a"]["issues"] == ["i"] and c["t"]["group"] == "tables"
    md = {r["node_id"]: r["body"] for r in memory.markdown_cards(memory.cards(g)).collect()}
    assert md["a"].startswith("## A\n\n```yaml\nnode_id: \"a\"") and 'related_nodes:\n  - "t"' in md["a"] and "evidence_ids: []" in md["a"]
    s = spark.createDataFrame([("t", i, "x" * n) for i, n in enumerate([5, 5, 20, 1, 1])], "topic string, k int, body string")
    assert [r["chunk"] for r in memory.chunked(s, ["topic"], ["k"], 10).orderBy("k").collect()] == [1, 1, 2, 3, 3]
    m = {r["metric_name"]: r["metric_value"] for r in metrics.global_metrics(g).collect()}
    assert m["nodes"] == 3 and m["ambiguousIssues"] == 1 and m["lowConfidenceEdges"] == 0
    d = spark.createDataFrame([("p", "a", "X", "a", 1, 9), ("p", "b", "Y", "b", 2, 3), ("p", "c", "Z", "c", 4, 5)], "source_path string, node_id string, node_type string, name string, start_line int, end_line int")
    held = spark.createDataFrame([("a", "b", "CONTAINS"), ("b", "a", "CONTAINS"), ("a", "c", "CONTAINS")], "source_node_id string, target_node_id string, edge_type string")
    (tree,) = [r["tree"] for r in memory.file_trees(d, held).collect()]
    assert tree.split("\n") == ["X a [L1-L9]", "  Y b [L2-L3]", "    X a [L1-L9] (cycle)", "  Z c [L4-L5]"]
    assert memory.file_trees(d, held, most=2).first()["tree"].endswith("... 2 more lines") and memory.system_tree(g.nodes.withColumn("system_key", F.lit("S")), g.edges).count() == 3
