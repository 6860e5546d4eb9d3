"""What a query writes, shuffles and multiplies: it follows the input, on every table."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import functions as F

from weftline.model import DB_OBJECTS, Graph, Options
from weftline.operators import links, memory, traverse
from weftline.operators.api import table_lookup
from weftline.plans import lift, queries
from weftline.session import shared_dir
from weftline.sources import packages


def stored(spark) -> set[str]:
    return {x.name for x in Path(shared_dir(spark).removeprefix("file:")).iterdir()}


def test_queries_of_a_graph_write_none_of_it(spark, sf):
    before = stored(spark)
    for name in ("list_issues", "find_evidence", "find_node_by_name", "global_metrics"):
        queries.QUERIES[name](spark, sf).count()
    assert stored(spark) == before


def test_a_type_of_ends_leaves_other_tables_unread(spark, sf):
    e = lift.published(spark, sf).edges.where("source_type = 'UI_ACTION'")
    assert {os.path.basename(x) for x in e.inputFiles()} >= {"orders.parquet"}
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert "o_custkey" in plan and "l_orderkey" not in plan


def test_traces_agree_with_and_without_types(spark, sf):
    g = lift.published(spark, sf)
    plain = Graph(g.nodes, g.edges.drop("source_type", "target_type"))
    starts = spark.createDataFrame([("api-operation:7",), ("table:3",), ("nowhere:1",)], "node_id string")
    for options in (Options(max_nodes=0, max_edges=0), Options(max_nodes=9, max_edges=0)):
        a, b = (traverse.trace(x, starts, "out", DB_OBJECTS, options) for x in (g, plain))
        rows = lambda df: sorted(map(tuple, df.collect()), key=str)
        assert rows(a.nodes) == rows(b.nodes)
        if not options.max_nodes:
            assert rows(a.edges) == rows(b.edges)
        assert a.truncated == b.truncated == bool(options.max_nodes)


def test_jobs_of_a_name_do_not_meet_all_rules_of_it(spark):
    n = 3000
    jobs = spark.range(n).selectExpr("'j' || id as job_id", "'same' as name")
    rules = spark.range(n).selectExpr("1 as priority", "'same' as name", "'e' || id as executable_id").unionByName(spark.range(n).selectExpr("2 as priority", "'same' as name", "'all' as executable_id"))
    df = links.job_executables(jobs, rules)
    assert joined(df) <= 3 * n
    assert df.where("executable_id = 'all'").count() == n


def joined(df) -> int:
    """The most rows that a join of the plan makes."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    most, todo = 0, [plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if "Join" in name:
            most = max(most, p.metrics().apply("numOutputRows").value())
        if name.endswith("QueryStageExec"):
            todo.append(p.plan())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


def named(spark, n: int):
    """n tables and n references, all of one name and database, every third of another schema; the first of each is an external object that is both."""
    bag = F.to_json(F.struct(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("schema"), F.lit("same").alias("table")))
    of = lambda kind, prefix: spark.range(n).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("node_id"), F.lit(kind).alias("node_type"), F.lit("same").alias("technical_name"), F.concat(F.lit("x.s"), (F.col("id") % 3).cast("string"), F.lit(".same")).alias("qualified_name"), F.lit("DB").alias("database_key"), bag.alias("properties_json"))
    return of("TABLE", "t").unionByName(of("UNRESOLVED_REFERENCE", "r")).unionByName(of("EXTERNAL_DATABASE_OBJECT", "e").limit(1))


def test_references_of_a_name_do_not_meet_all_objects_of_it(spark):
    n = 600
    df = links.resolve_deferred(named(spark, n))
    assert joined(df) <= 5 * n
    rows = {r["ref_id"]: (r["candidates"], r["target_id"], r["status"]) for r in df.collect()}
    external = [r for r in rows if r.startswith("e")]
    assert rows["r1"][0] == n // 3 + (external == ["e1"]) and rows["r1"][2] == "AMBIGUOUS"
    assert len(external) == 1 and rows[external[0]][0] == n // 3 and rows[external[0]][1].startswith("t")


def test_best_candidates_of_a_name_without_all_pairs(spark):
    n = 600
    df = links.candidates(named(spark, n))
    assert joined(df) <= 60 * n
    for most in (1, 10):
        rows = links.candidates(named(spark, n), most=most).where("reference_node_id = 'r4'").orderBy("rank").collect()
        best = sorted(f"t{i}" for i in range(n) if i % 3 == 1)[:most]
        assert [r["candidate_node_id"] for r in rows] == best and {round(r["score"], 6) for r in rows} == {1.0}



def test_steps_of_all_entries_and_all_targets(spark, sf):
    df = queries.QUERIES["flow_steps"](spark, sf)
    starts = df.where("step_index = 0").groupBy(F.split_part("node_id", F.lit(":"), F.lit(1)).alias("kind")).count().collect()
    assert {r["kind"] for r in starts} == {"api-operation", "ui-action"}
    assert df.where("step_index = 0").groupBy("node_id").count().agg(F.max("count")).first()[0] == reached_by_one(spark, sf)


def reached_by_one(spark, sf) -> int:
    """The most tables and external systems behind one action or operation."""
    t = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("orders", "lineitem")}
    both = t["orders"].join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey"))
    return both.groupBy("o_custkey").agg((F.count_distinct("l_partkey") + F.count_distinct("l_suppkey")).alias("n")).agg(F.max("n")).first()[0]


def test_chunks_have_evidence_and_issues(spark, sf):
    chunks = queries.QUERIES["knowledge_chunks"](spark, sf).where("topic = 'apis'").agg(F.sum("bytes").alias("bytes"), F.sum("cards").alias("cards")).first()
    g = lift.published(spark, sf)
    lean = memory.markdown_cards(memory.cards(Graph(g.nodes, g.edges))).where("topic = 'apis'").agg(F.sum(F.octet_length("body")).alias("bytes"), F.count("*").alias("cards")).first()
    # an operation's own evidence (of 73 characters) and issue are named in its card
    assert chunks["cards"] == lean["cards"] and chunks["bytes"] >= lean["bytes"] + lean["cards"] * 80


def test_the_lift_says_all_types_of_ends(spark, sf):
    e = lift.published(spark, sf).edges.select("edge_type", "source_type", "target_type").distinct().collect()
    assert {(r[0], f"{r[1]} {r[2]}") for r in e} == {*lift.ENDS}


def test_edges_are_told_apart_before_their_ids_are_made(spark):
    """Equal edges meet by their ends, which are short, and not by their hashes."""
    jobs = spark.range(4).selectExpr("'N1' as jobnet_id", "concat('J', id % 2) as job_id", "'J0' as predecessor_job_id", "'C:\\\\x.exe' as executable_name")
    e = packages.job_networks(jobs)[1].select("source_node_id", "edge_type", "target_node_id")
    assert "sha2" not in e._jdf.queryExecution().optimizedPlan().toString()
    assert e.count() == e.distinct().count() == 6


def test_reachable_with_and_without_types(spark, sf):
    g = lift.published(spark, sf)
    starts = g.nodes.where("node_type = 'UI_ACTION'").select(F.col("node_id").alias("start"), "node_id", "node_type")
    types = frozenset({"CALLS_API", "EXECUTES_SQL"})
    a = traverse.reachable(g.edges, starts, "start", types, g)
    assert a.columns == ["start", "node_id"]
    b = traverse.reachable(g.edges.drop("source_type", "target_type"), starts.drop("node_type"), "start", types)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_a_lookup_reads_a_bag_a_few_times(spark):
    n = spark.range(1).selectExpr("concat('t', id) as node_id", "'app.T' as technical_name", "'X.T' as qualified_name", "'DB' as database_key", "id as a").withColumn("properties_json", F.to_json(F.struct("a")))
    df = n.where(table_lookup("app.t"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("to_json") <= 1
    assert df.count() == 1 and n.where(table_lookup("db.t")).count() == 1 and n.where(table_lookup("p.t")).count() == 0
