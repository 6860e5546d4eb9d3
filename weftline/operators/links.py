"""Links across sources: API calls to operations, deferred references to database objects, dangling ends, referential checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import jsonbag, routes
from weftline.functions.ids import decoded_id, edge_id, placeholder_id
from weftline.model import DB_EDGES, DB_OBJECTS, DEFERRED, ROUTINES, Graph, bag, filled, one_of
from weftline.session import maybe_broadcast, ship, written


def api_signature(nodes: DataFrame) -> DataFrame:
    """node_id, method, route of API nodes: from their properties, else from a name of the form VERB path."""
    name = F.regexp_extract_all("technical_name", F.lit(r"^\s*([A-Za-z]+)\s+(\S+)\s*$"), 0)
    verb_path = F.split(F.trim(F.get(name, F.lit(0))), r"\s+")
    method = routes.verb(filled(bag("properties_json", "method", "http_method"), F.get(verb_path, F.lit(0))))
    route = routes.route_path(filled(bag("properties_json", "route", "path"), F.get(verb_path, F.lit(1))))
    return nodes.select("node_id", method.alias("method"), route.alias("route")).where("method is not null and route is not null")


def link_api(calls: DataFrame, operations: DataFrame) -> DataFrame:
    """call_id, status (LINKED, AMBIGUOUS), match (exact, unique_suffix), target_id (least if ambiguous), candidates.

    Both: node_id, method, route.  A call that no operation has exactly matches those whose parts end in the call's parts, and
    those whose whole route is an end of the call's.  Calls without a match have no row.
    """
    c = calls.select(F.col("node_id").alias("call_id"), "method", "route")
    o = operations.select(F.col("node_id").alias("op_id"), "method", "route")
    exact = c.join(o, ["method", "route"]).select("call_id", "op_id", F.lit("exact").alias("match"))
    rest = c.join(exact.select("call_id").distinct(), "call_id", "left_anti").withColumn("parts", routes.parts("route"))
    o = o.withColumn("parts", routes.parts("route"))
    whole = lambda df: df.withColumn("tail", F.array_join("parts", "/"))
    tails = lambda df: df.withColumn("tail", F.explode(routes.suffixes(F.col("parts"))))
    some = F.size("parts") > 0
    into = whole(rest.where(some)).join(tails(o).select("method", "tail", "op_id"), ["method", "tail"])
    under = tails(rest).join(whole(o.where(some)).select("method", "tail", "op_id"), ["method", "tail"])
    suffix = into.select("call_id", "op_id").union(under.select("call_id", "op_id")).distinct().withColumn("match", F.lit("unique_suffix"))
    found = exact.distinct().unionByName(suffix).groupBy("call_id", "match").agg(F.count("*").alias("candidates"), F.min("op_id").alias("target_id"))
    return found.withColumn("status", F.when(F.col("candidates") == 1, "LINKED").otherwise("AMBIGUOUS"))


def api_edges(linked: DataFrame) -> DataFrame:
    """CALLS_API edges of unique matches: confidence 1.0 if exact, else 0.8."""
    kind, layer = F.lit("CALLS_API"), F.lit("TECHNICAL")
    return linked.where("status = 'LINKED'").select(edge_id("call_id", kind, "target_id", F.lit(""), layer).alias("edge_id"), F.col("call_id").alias("source_node_id"), F.col("target_id").alias("target_node_id"), kind.alias("edge_type"), layer.alias("graph_layer"), F.lit("").alias("raw_operation"), F.when(F.col("match") == "exact", 1.0).otherwise(0.8).alias("confidence"), F.to_json(F.struct("match")).alias("properties_json"))


def _up(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def object_identity(nodes: DataFrame) -> DataFrame:
    """db, schema, name of nodes, from keys and properties, else from dotted names."""
    raw = filled(bag("properties_json", "table", "object_name", "object"), "technical_name")
    parts = F.split(F.split_part(raw, F.lit("@"), F.lit(1)), r"\.")
    schema = filled(bag("properties_json", "schema", "owner"), F.try_element_at(parts, F.lit(-2)))
    return nodes.withColumns({"db": _up(filled("database_key", bag("properties_json", "database"))), "schema": _up(schema), "name": _up(F.element_at(parts, -1))})


def _met(refs: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """ref_id, n, least: how many candidates are equal in ``keys``, and the least; a reference is no candidate of its own.

    Candidates of the same keys are one row before they meet references.
    """
    known = known.select(*keys, "candidate").distinct()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("candidate"))
    two = known.withColumn("nth", nth).where("nth <= 2").groupBy(*keys).agg(F.min("candidate").alias("first"), F.max(F.when(F.col("nth") == 2, F.col("candidate"))).alias("second"))
    groups = known.groupBy(*keys).agg(F.count("*").alias("all")).join(two, keys)
    itself = refs.select("ref_id").distinct().join(known.withColumnRenamed("candidate", "ref_id"), "ref_id").withColumn("itself", F.lit(1))
    met = refs.select("ref_id", *keys).distinct().join(groups, keys).join(itself, ["ref_id", *keys], "left")
    return met.groupBy("ref_id").agg(F.sum(F.col("all") - F.coalesce("itself", F.lit(0))).alias("n"), F.min(F.when(F.col("first") == F.col("ref_id"), F.col("second")).otherwise(F.col("first"))).alias("least"))


def _cascade(refs: DataFrame, known: DataFrame, keys: list[str], loose: str) -> DataFrame:
    """ref_id, n, least of the candidates: equal in all ``keys``, else (if the reference has one) in all but ``loose``; a reference without one matches any."""
    others = [k for k in keys if k != loose]
    with_, without = refs.where(F.col(loose) != ""), refs.where(F.col(loose) == "")
    exact = _met(with_, known, keys)
    rest = with_.join(exact.select("ref_id"), "ref_id", "left_anti").select("ref_id", *others).unionByName(without.select("ref_id", *others))
    return exact.unionByName(_met(rest, known, others)).where("n > 0")


def resolve_deferred(nodes: DataFrame, edges: DataFrame | None = None, database: bool = True, routines: bool = True) -> DataFrame:
    """ref_id, kind (object, column, routine), status (RESOLVED, AMBIGUOUS), target_id (least if ambiguous), candidates.  References with a database link never resolve."""
    refs = object_identity(nodes.where(one_of("node_type", DEFERRED)).withColumnRenamed("node_id", "ref_id"))
    raw = filled(bag("properties_json", "raw_reference"), "technical_name")
    routine, column = bag("properties_json", "routine"), bag("properties_json", "column")
    named = bag("properties_json", "table", "object", "object_name") != ""
    is_object = named | (F.col("node_type") == "EXTERNAL_DATABASE_OBJECT")
    if edges is not None:
        by_db = edges.where(one_of("edge_type", DB_EDGES)).select(F.col("target_node_id").alias("ref_id"), F.lit(True).alias("db_ref")).distinct()
        refs = refs.join(by_db, "ref_id", "left")
        is_object = is_object | F.coalesce("db_ref", F.lit(False))
    refs = refs.where(~raw.contains("@")).withColumns({"kind": F.when(routine != "", "routine").when(column != "", "column").when(is_object, "object"), "routine": _up(routine), "package": _up(bag("properties_json", "package")), "column": _up(column), "table": _up(bag("properties_json", "table"))})
    out = None
    if database:
        objects = object_identity(nodes.where(one_of("node_type", DB_OBJECTS))).where("db <> '' and name <> ''").select("db", "schema", "name", F.col("node_id").alias("candidate"))
        cols = object_identity(nodes.where("node_type = 'COLUMN'")).select("db", _up(bag("properties_json", "schema", "owner")).alias("schema"), _up(bag("properties_json", "table")).alias("table"), _up(filled(bag("properties_json", "column"), "technical_name")).alias("column"), F.col("node_id").alias("candidate")).where("db <> '' and table <> '' and column <> ''")
        out = _cascade(refs.where("kind = 'object'"), objects, ["db", "schema", "name"], "schema").withColumn("kind", F.lit("object"))
        out = out.unionByName(_cascade(refs.where("kind = 'column'").withColumn("schema", _up(bag("properties_json", "schema", "owner"))), cols, ["db", "schema", "table", "column"], "schema").withColumn("kind", F.lit("column")))
    if routines:
        known = nodes.where(one_of("node_type", ROUTINES)).select(_up(filled("database_key", bag("properties_json", "database"))).alias("db"), _up(bag("properties_json", "package")).alias("package"), _up(filled(bag("properties_json", "routine"), "technical_name")).alias("routine"), F.col("node_id").alias("candidate")).where("db <> '' and routine <> ''")
        more = _cascade(refs.where("kind = 'routine'"), known, ["db", "package", "routine"], "package").withColumn("kind", F.lit("routine"))
        out = more if out is None else out.unionByName(more)
    assert out is not None, "nothing to resolve"
    got = out.groupBy("ref_id", "kind").agg(F.sum("n").alias("candidates"), F.min("least").alias("target_id"))
    return got.withColumn("status", F.when(F.col("candidates") == 1, "RESOLVED").otherwise("AMBIGUOUS"))


def resolution_issues(resolved: DataFrame) -> DataFrame:
    """source_node_id, issue_type, severity, message of ambiguous references and calls."""
    kind = F.when(F.col("kind") == "routine", "AMBIGUOUS_SYMBOL").otherwise("AMBIGUOUS_DB_LINK")
    return resolved.where("status = 'AMBIGUOUS'").select(F.col("ref_id").alias("source_node_id"), kind.alias("issue_type"), F.lit("WARNING").alias("severity"), F.format_string("Deferred %s reference matches %d nodes", "kind", "candidates").alias("message"))


def rewritten_bags(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """``df`` with every string in its bags that is an ``old`` id replaced by the ``new`` one; each different bag is read once, and only those with a hit are written anew."""
    ship(df.sparkSession)
    bags = df.select(F.col("properties_json").alias("bag")).where(F.length("bag") > 4).distinct()
    # without escapes, what stands between quotes is the string itself (or a key, which is no id); only bags with escapes need a parser here
    escaped = F.col("bag").contains("\\")
    quoted = bags.where(~escaped).withColumn("old", F.explode(F.array_distinct(F.regexp_extract_all("bag", F.lit('"([^"]*)"'), 1))))
    parsed = bags.where(escaped).withColumn("old", F.explode(jsonbag.strings("bag")))
    hits = quoted.unionByName(parsed).join(aliases.select("old", "new"), "old")
    names = hits.groupBy("bag").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_set(F.struct("old", "new"))))).alias("names"))
    fresh = names.select("bag", jsonbag.rewritten("bag", "names").alias("fresh"))
    return df.join(fresh, df["properties_json"] == fresh["bag"], "left").withColumn("properties_json", F.coalesce("fresh", "properties_json")).select(*df.columns)


def replace_nodes(graph: Graph, aliases: DataFrame) -> Graph:
    """The graph with ``old_id`` replaced by ``new_id`` everywhere (ends, targets, owners, strings in bags); edges that become equal are merged, and their ids replaced too."""
    a = maybe_broadcast(written(aliases.select("old_id", "new_id")))  # these and the moved edges are read several times

    def swap(df: DataFrame, column: str, when: Column | None = None) -> DataFrame:
        hit = F.col(column) == F.col("old_id")
        joined = df.join(a, hit if when is None else hit & when, "left")
        return joined.withColumn(column, F.coalesce("new_id", column)).drop("old_id", "new_id")

    from weftline.operators.dedupe import merge_edges

    nodes = graph.nodes.join(a.select(F.col("old_id").alias("node_id")), "node_id", "left_anti")
    before = graph.edges.withColumn("was", F.col("edge_id"))
    moved = written(swap(swap(before, "source_node_id"), "target_node_id").withColumn("edge_id", edge_id("source_node_id", "edge_type", "target_node_id", "raw_operation", "graph_layer")))
    edge_alias = moved.where("was <> edge_id").select(F.col("was").alias("old_edge"), F.col("edge_id").alias("new_edge"))
    every = maybe_broadcast(written(a.select(F.col("old_id").alias("old"), F.col("new_id").alias("new")).union(edge_alias).distinct()))
    bags = lambda df: rewritten_bags(df, every) if df is not None and "properties_json" in df.columns else df
    edges = merge_edges(bags(moved.drop("was")))
    evidence, comments, issues = graph.evidence, graph.comments, graph.issues
    if evidence is not None:
        evidence = swap(evidence, "target_id", F.col("target_type") == "NODE").join(edge_alias, (F.col("target_type") == "EDGE") & (F.col("target_id") == F.col("old_edge")), "left").withColumn("target_id", F.coalesce("new_edge", "target_id")).drop("old_edge", "new_edge")
    if comments is not None:
        comments = swap(comments, "owner_node_id")
    if issues is not None:
        issues = swap(issues, "source_node_id")
    return graph.with_(nodes=bags(nodes), edges=edges, evidence=bags(evidence), comments=bags(comments), issues=bags(issues))


def node_references(graph: Graph) -> DataFrame:
    """node_id: every id that a row refers to as a node, by a key or in its bag."""
    ship(graph.edges.sparkSession)
    ends = graph.edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("node_id"))
    for df, column, ok in ((graph.evidence, "target_id", "target_type = 'NODE'"), (graph.comments, "owner_node_id", "true"), (graph.issues, "source_node_id", "true")):
        if df is not None:
            ends = ends.unionByName(df.where(ok).select(F.col(column).alias("node_id")))
    for df in (graph.nodes, graph.edges, graph.evidence, graph.comments, graph.issues):
        if df is not None and "properties_json" in df.columns:
            bags = df.select("properties_json").where(F.col("properties_json").contains("ref_node_id")).distinct()
            ends = ends.unionByName(bags.select(F.explode(jsonbag.node_references("properties_json")).alias("node_id")))
    return ends.where("node_id is not null and node_id <> ''").distinct()


def dangling(graph: Graph) -> DataFrame:
    """expected_id, placeholder_id, label, qualified_name, kind, database_key, system_key, repository_key of node ids that no node has.

    What the id doesn't say comes from the neighbour of the least edge id.
    """
    missing = node_references(graph).join(graph.nodes.select("node_id"), "node_id", "left_anti")
    e = graph.edges.select("edge_id", "source_node_id", "target_node_id")
    both = e.select(F.col("source_node_id").alias("expected_id"), F.col("target_node_id").alias("node_id"), "edge_id").unionByName(e.select(F.col("target_node_id").alias("expected_id"), F.col("source_node_id").alias("node_id"), "edge_id"))
    near = both.join(missing.withColumnRenamed("node_id", "expected_id"), "expected_id", "left_semi").join(graph.nodes.select("node_id", "system_key", "repository_key", F.col("database_key").alias("near_db")), "node_id")
    context = near.groupBy("expected_id").agg(F.min_by(F.struct("system_key", "repository_key", "near_db"), "edge_id").alias("x"))
    d = missing.withColumnRenamed("node_id", "expected_id").join(context, "expected_id", "left").withColumn("d", decoded_id("expected_id"))
    label = F.when(F.col("d.name") == "", "unresolved reference").otherwise(F.col("d.name"))
    return d.select("expected_id", placeholder_id("expected_id").alias("placeholder_id"), label.alias("label"), F.coalesce(F.nullif(F.col("d.qualified_name"), F.lit("")), label).alias("qualified_name"), F.col("d.kind").alias("kind"), filled(F.col("d.database"), F.col("x.near_db")).alias("database_key"), filled(F.col("x.system_key")).alias("system_key"), filled(F.col("x.repository_key")).alias("repository_key"))


def orphan_evidence(graph: Graph) -> DataFrame:
    """Evidence of edges that aren't there."""
    assert graph.evidence is not None
    return graph.evidence.where("target_type = 'EDGE'").join(graph.edges.select(F.col("edge_id").alias("target_id")), "target_id", "left_anti")


def broken_keys(graph: Graph) -> DataFrame:
    """reference, n: counts of rows whose foreign key leads nowhere; all zero in a sound graph."""
    nodes = graph.nodes.select(F.col("node_id").alias("k"))
    edges = graph.edges.select(F.col("edge_id").alias("k"))
    checks = [("edges.source_node_id", graph.edges, "source_node_id", "true", nodes), ("edges.target_node_id", graph.edges, "target_node_id", "true", nodes)]
    if graph.evidence is not None:
        checks += [("evidence.node", graph.evidence, "target_id", "target_type = 'NODE'", nodes), ("evidence.edge", graph.evidence, "target_id", "target_type = 'EDGE'", edges)]
    if graph.comments is not None:
        checks.append(("comments.owner_node_id", graph.comments, "owner_node_id", "owner_node_id is not null and cast(owner_node_id as string) <> ''", nodes))
    if graph.issues is not None:
        checks.append(("issues.source_node_id", graph.issues, "source_node_id", "source_node_id is not null and cast(source_node_id as string) <> ''", nodes))
    out = None
    for name, df, column, ok, keys in checks:
        n = df.where(ok).select(F.col(column).alias("k")).join(keys, "k", "left_anti").agg(F.lit(name).alias("reference"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


#: Issues that say a reference wasn't found, and what they are about.
STALE = {"TABLE_NOT_IMPORTED": "object", "EXTERNAL_OBJECT": "object", "COLUMN_NOT_IMPORTED": "column", "PROCEDURE_NOT_FOUND": "routine"}


def prune_resolved_issues(issues: DataFrame, nodes: DataFrame) -> DataFrame:
    """Issues without those that say a name (raw_reference, in database_key) wasn't found which some node has by now.

    A name matches with its schema or package, or where no node has that, by itself; names with a database link, and those without a database, stay.
    """
    known = object_identity(nodes.where(one_of("node_type", DB_OBJECTS))).select(F.lit("object").alias("kind"), "db", "name")
    cols = object_identity(nodes.where("node_type = 'COLUMN'")).select(F.lit("column").alias("kind"), "db", F.concat_ws(".", _up(bag("properties_json", "table")), _up(filled(bag("properties_json", "column"), "technical_name"))).alias("name"))
    routines = nodes.where(one_of("node_type", ROUTINES)).select(F.lit("routine").alias("kind"), _up(filled("database_key", bag("properties_json", "database"))).alias("db"), _up(filled(bag("properties_json", "routine"), "technical_name")).alias("name"))
    there = known.unionByName(cols).unionByName(routines).where("db <> '' and name <> ''").distinct().select(F.col("kind").alias("__k"), F.col("db").alias("__d"), F.col("name").alias("__n"))
    raw = _up(F.col("raw_reference"))
    parts = F.transform(F.filter(F.split(raw, r"\."), lambda x: x != ""), lambda x: F.replace(x, F.lit('"')))
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    kind = F.create_map(*[F.lit(x) for kv in STALE.items() for x in kv])[F.col("issue_type")]
    name = F.when(kind == "column", F.concat_ws(".", F.try_element_at(parts, F.lit(-2)), last)).otherwise(last)
    ok = kind.isNotNull() & (_up(F.col("database_key")) != "") & (raw != "") & ~raw.contains("@")
    asked = issues.withColumns({"__k": F.when(ok, kind), "__d": _up(F.col("database_key")), "__n": name})
    return asked.join(there, ["__k", "__d", "__n"], "left_anti").select(*issues.columns)


def candidates(nodes: DataFrame, minimum: float = 0.85, most: int = 10) -> DataFrame:
    """reference_node_id, candidate_node_id, rank, score, status, reasons: what a deferred reference may be, best first, ties by id.

    The name has to be the same (0.65); database (0.2), schema (0.1) and end of the qualified name (0.05) add to it.
    """
    from weftline.functions.names import candidate_name, reference_name

    db = _up(filled("database_key", bag("properties_json", "database")))
    schema = _up(bag("properties_json", "schema", "owner"))
    refs = nodes.where(one_of("node_type", DEFERRED)).select(F.col("node_id").alias("reference_node_id"), reference_name().alias("key"), db.alias("rdb"), schema.alias("rschema"), F.upper("qualified_name").alias("rq")).where("key <> ''")
    known = nodes.where(one_of("node_type", DB_OBJECTS - {"EXTERNAL_DATABASE_OBJECT"} | ROUTINES | {"COLUMN"})).select(F.col("node_id").alias("candidate_node_id"), candidate_name().alias("key"), db.alias("cdb"), schema.alias("cschema"), F.upper("qualified_name").alias("cq"))
    same_db, same_schema, suffix = (F.col("rdb") != "") & (F.col("rdb") == F.col("cdb")), (F.col("rschema") != "") & (F.col("rschema") == F.col("cschema")), F.endswith("cq", "rq")
    add = lambda ok, x: F.when(ok, F.lit(x)).otherwise(0.0)
    score = F.least(F.lit(0.65) + add(same_db, 0.2) + add(same_schema, 0.1) + add(suffix, 0.05), F.lit(1.0))
    reasons = F.concat_ws(",", F.lit("same_name"), F.when(same_db, "same_database"), F.when(same_schema, "same_schema"), F.when(suffix, "qualified_suffix"))
    # whatever is among the best of a reference is among the first ids of those that agree with it in the same things, and maybe more: these score no less
    sizes = refs.select("key", F.length("rq").alias("size")).where("size is not null").distinct()
    ends = known.join(sizes, "key").where(F.length("cq") >= F.col("size")).withColumn("end", F.right("cq", F.col("size"))).drop("size")
    pairs = []
    for of, more in ((known, []), (ends, ["end"])):
        for same in ([], ["db"], ["schema"], ["db", "schema"]):
            own = ["key", *more, *(f"c{k}" for k in same)]
            w = Window.partitionBy(*own).orderBy("candidate_node_id")
            best = of.where(" and ".join(f"c{k} <> ''" for k in same) or "true").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("nth")
            asked = refs.withColumns({"end": F.col("rq")} if more else {}).withColumns({f"c{k}": F.col(f"r{k}") for k in same})
            pairs.append(asked.join(best, own).select("reference_node_id", "candidate_node_id", score.alias("score"), reasons.alias("reasons")))
    scored = pairs[0]
    for df in pairs[1:]:
        scored = scored.unionByName(df)
    scored = scored.repartition("reference_node_id").dropDuplicates(["reference_node_id", "candidate_node_id"])
    rank = F.row_number().over(Window.partitionBy("reference_node_id").orderBy(F.desc("score"), "candidate_node_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("reference_node_id", "candidate_node_id", "rank", "score", F.when(F.col("score") >= minimum, "eligible").otherwise("observe").alias("status"), "reasons")


def job_executables(jobs: DataFrame, rules: DataFrame) -> DataFrame:
    """job_id, executable_id: by the rule of least priority that names exactly one executable.  jobs: job_id, name; rules: priority, name, executable_id.

    A rule names one executable if its least and its largest are the same, so rules of a name are one row before they meet its jobs.
    """
    ends = lambda a, b: (F.min(a).alias("least"), F.max(b).alias("most"))
    named = rules.groupBy("name", "priority").agg(*ends("executable_id", "executable_id"))
    hits = jobs.join(named, "name").groupBy("job_id", "priority").agg(*ends("least", "most"))
    return hits.where("least = most").groupBy("job_id").agg(F.min_by("least", "priority").alias("executable_id"))
