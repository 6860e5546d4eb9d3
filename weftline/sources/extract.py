"""Graphs of SQL, PL/SQL and loader files: what each file and routine declares, reads, writes and calls, resolved against a catalog where it can be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import sqltext
from weftline.functions.ids import column_id, edge_id, stable_id, table_id
from weftline.functions.names import external_schema, leaf, owner
from weftline.model import Graph
from weftline.operators.structure import contains, innermost, parent_routine
from weftline.session import ship, stored

#: Characters of a bucket of the joins of places with routines.
BUCKET = 4096


def _node(df: DataFrame, node_id: Column, kind: Column, name: Column, database: str, props: Column, confidence: Column) -> DataFrame:
    none = F.lit("")
    return df.select(node_id.alias("node_id"), kind.alias("node_type"), name.alias("technical_name"), name.alias("qualified_name"), name.alias("default_display_name"), none.alias("system_key"), F.lit(database).alias("database_key"), none.alias("repository_key"), F.lit("MAIN").alias("graph_role"), confidence.alias("confidence"), props.alias("properties_json")).where("node_id is not null").dropDuplicates(["node_id"])


def _edge(df: DataFrame, source: Column, kind: Column, target: Column, raw: Column, confidence: Column) -> DataFrame:
    layer = F.lit("DATA_FLOW")
    return df.select(edge_id(source, kind, target, raw, layer).alias("edge_id"), source.alias("source_node_id"), target.alias("target_node_id"), kind.alias("edge_type"), layer.alias("graph_layer"), raw.alias("raw_operation"), confidence.alias("confidence"), F.lit("{}").alias("properties_json")).where("edge_id is not null").dropDuplicates(["edge_id"])


def resolved_tables(refs: DataFrame, tables: DataFrame, database: str, schema: str, synonyms: DataFrame | None = None) -> DataFrame:
    """``refs`` (…, name) with target_id, target_type, status and certainty: through a synonym if there is one, then by the catalog, else external (of another schema, or behind a link), else unresolved."""
    if synonyms is not None:
        refs = refs.join(synonyms.select(F.col("name").alias("__s"), F.col("target").alias("__t")).dropDuplicates(["__s"]), F.col("name") == F.col("__s"), "left").withColumn("name", F.coalesce("__t", "name")).drop("__s", "__t")
    known = tables.where(F.col("database_key") == database).select(F.col("schema_name").alias("__schema"), F.col("object_name").alias("__name")).distinct()
    r = refs.withColumns({"__leaf": leaf("name"), "__owner": F.coalesce(F.nullif(owner("name"), F.lit("")), F.lit(schema)), "__link": F.split_part("name", F.lit("@"), F.lit(2))})
    r = r.join(known, (F.col("__leaf") == F.col("__name")) & (F.col("__owner") == F.col("__schema")) & (F.col("__link") == ""), "left")
    hit, remote = F.col("__name").isNotNull(), F.col("__link") != ""
    outside = external_schema("name", F.lit(schema))
    status = F.when(hit, "RESOLVED").when(remote, "REMOTE").when(outside, "EXTERNAL").otherwise("UNRESOLVED")
    target = F.when(hit, table_id(F.lit(database), "__leaf")).when(remote | outside, stable_id("external-database-object", F.lit(database), "name")).otherwise(stable_id("unresolved-reference", F.lit(database), "name"))
    kind = F.when(hit, "TABLE").when(remote | outside, "EXTERNAL_DATABASE_OBJECT").otherwise("UNRESOLVED_REFERENCE")
    certain = F.when(hit, 1.0).when(remote | outside, 0.6).otherwise(0.3)
    return r.withColumns({"status": status, "target_id": target, "target_type": kind, "certainty": certain}).drop("__name", "__schema", "__leaf", "__owner", "__link")


def sql_graph(files: DataFrame, tables: DataFrame, database: str, schema: str, synonyms: DataFrame | None = None) -> Graph:
    """Graph of files (relative_path, text): files, routines with their parents, tables, sequences and callees; evidence with lines, issues for what can't be parsed or resolved.

    A place belongs to the innermost routine around it, else to the file.  Synonyms that the files declare count beside ``synonyms`` (name, target).
    """
    ship(files.sparkSession)
    a = stored(files.where("text is not null").select("relative_path", "text", sqltext.analysis("text").alias("a")))
    file_id = stable_id("sql-file", F.lit(database), "relative_path")
    db = F.lit(database)
    none, sure = F.lit(""), F.lit(1.0)
    routines = a.select("relative_path", F.explode("a.routines").alias("r")).select(stable_id_of_routine(db), "relative_path", F.col("r.kind").alias("kind"), F.col("r.name").alias("name"), F.col("r.signature").alias("signature"), F.col("r.start").alias("start"), F.col("r.end").alias("end"))
    routines = stored(routines.where("routine_id is not null").dropDuplicates(["relative_path", "kind", "name", "signature", "start"]))
    declared = a.select("relative_path", F.explode("a.declarations").alias("d"))
    own = declared.where("d.kind = 'SYNONYM'").select(F.col("d.name").alias("name"), F.col("d.target").alias("target"))
    synonyms = own if synonyms is None else own.unionByName(synonyms.select("name", "target"))
    places = a.select("relative_path", F.explode("a.tables").alias("x")).select("relative_path", F.lit("table").alias("what"), F.col("x.name").alias("name"), F.col("x.relation").alias("relation"), F.col("x.offset").alias("offset"), F.col("x.line").alias("line"))
    line = F.regexp_count(F.left(F.col("text"), F.col("x.offset")), F.lit("\n")) + 1
    places = places.unionByName(a.select("relative_path", "text", F.explode("a.calls").alias("x")).select("relative_path", F.lit("call").alias("what"), F.col("x.name").alias("name"), F.lit("CALLS").alias("relation"), F.col("x.offset").alias("offset"), line.alias("line")))
    places = places.unionByName(a.select("relative_path", "text", F.explode("a.sequences").alias("x")).select("relative_path", F.lit("sequence").alias("what"), F.col("x.name").alias("name"), F.lit("USES_SEQUENCE").alias("relation"), F.col("x.offset").alias("offset"), line.alias("line")))
    key = F.concat_ws("\n", "relative_path", "what", "name", "relation")
    spans = routines.select("relative_path", "start", "end", F.col("routine_id").alias("interval_id"))
    around = innermost(places.select("relative_path", F.col("offset").alias("lo"), F.col("offset").alias("hi"), key.alias("point_id")), spans, ["relative_path"], BUCKET)
    places = stored(places.withColumn("point_id", key).join(around, "point_id", "left").withColumn("owner_id", F.coalesce("interval_id", file_id)).drop("point_id", "interval_id"))

    t = stored(resolved_tables(places.where("what = 'table'"), tables, database, schema, synonyms))
    writes = F.col("relation") != "READS_FROM"
    kind = F.when(writes, "WRITES_TO").when(F.col("status") == "REMOTE", "REMOTE_READS").otherwise("READS_FROM")
    raw = F.when(writes, F.col("relation")).otherwise("SELECT")
    calls = places.where("what = 'call'")
    local = routines.groupBy(F.col("name").alias("callee")).agg(F.count_distinct("routine_id").alias("n"), F.min("routine_id").alias("routine_id")).where("n = 1").drop("n")
    c = calls.join(local, calls["name"] == local["callee"], "left").withColumns({"target_id": F.coalesce("routine_id", stable_id("unresolved-reference", db, F.lit("routine"), "name")), "certainty": F.when(F.col("routine_id").isNotNull(), 1.0).otherwise(0.3)})
    s = places.where("what = 'sequence'").withColumn("target_id", stable_id("sequence", db, "name"))
    nodes = _node(a, file_id, F.lit("SQL_FILE"), F.col("relative_path"), database, F.to_json(F.struct(F.col("a.classification").alias("classification"))), sure)
    for more in (
        _node(routines, F.col("routine_id"), F.col("kind"), F.col("name"), database, F.to_json(F.struct(F.col("name").alias("routine"), "signature")), sure),
        _node(t, F.col("target_id"), F.col("target_type"), F.col("name"), database, F.to_json(F.struct(F.col("name").alias("table"))), F.col("certainty")),
        _node(c.where("routine_id is null"), F.col("target_id"), F.lit("UNRESOLVED_REFERENCE"), F.col("name"), database, F.to_json(F.struct(F.col("name").alias("routine"))), F.lit(0.3)),
        _node(s, F.col("target_id"), F.lit("SEQUENCE"), F.col("name"), database, F.lit("{}"), sure),
        _node(declared.where("d.kind in ('VIEW', 'MATERIALIZED_VIEW', 'TRIGGER', 'PACKAGE')"), stable_id("declared", db, "d.name"), F.when(F.col("d.kind") == "PACKAGE", "PLSQL_PACKAGE").otherwise(F.col("d.kind")), F.col("d.name"), database, F.lit("{}"), sure),
    ):
        nodes = nodes.unionByName(more)
    parents = parent_routine(routines.select("routine_id", F.col("relative_path").alias("path"), "start", "end"))
    held = routines.join(parents, "routine_id", "left").select(F.coalesce("parent_id", file_id).alias("parent"), F.col("routine_id").alias("child"))
    held = held.union(declared.where("d.kind in ('VIEW', 'MATERIALIZED_VIEW', 'TRIGGER', 'PACKAGE')").select(file_id, stable_id("declared", db, "d.name"))).where("parent is not null and child is not null and parent <> child")
    edges = contains(held.distinct())
    for more in (_edge(t, F.col("owner_id"), kind, F.col("target_id"), raw, F.col("certainty")), _edge(c, F.col("owner_id"), F.lit("CALLS"), F.col("target_id"), none, F.col("certainty")), _edge(s, F.col("owner_id"), F.lit("USES_SEQUENCE"), F.col("target_id"), none, sure)):
        edges = edges.unionByName(more)
    evidence = t.select(F.lit("EDGE").alias("target_type"), edge_id("owner_id", kind, "target_id", raw, F.lit("DATA_FLOW")).alias("target_id"), F.col("relative_path").alias("source_path"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit("SQL").alias("evidence_kind"), "certainty")
    issue = lambda df, kind_, severity, where: df.select(F.lit(kind_).alias("issue_type"), F.lit(severity).alias("severity"), where.alias("source_node_id"), F.col("relative_path").alias("source_path"))
    issues = issue(a.where("a.error is not null"), "PARSE_ERROR", "ERROR", file_id).unionByName(issue(t.where("status = 'UNRESOLVED'"), "TABLE_NOT_FOUND", "WARNING", F.col("target_id"))).unionByName(issue(a.where(F.size("a.dynamic") > 0), "DYNAMIC_SQL", "WARNING", file_id))
    numbered = issues.distinct().withColumn("issue_id", F.concat(F.lit("issue:"), F.sha2(F.concat_ws("|", "issue_type", "source_node_id", "source_path"), 256)))
    return Graph(nodes.dropDuplicates(["node_id"]), edges.dropDuplicates(["edge_id"]), evidence.withColumnRenamed("certainty", "confidence"), None, numbered)


def stable_id_of_routine(db: Column) -> Column:
    """kind:database:name:signature of an exploded routine ``r``."""
    return F.coalesce(stable_id("function", db, F.when(F.col("r.kind") == "FUNCTION", F.col("r.name")), F.col("r.signature")), stable_id("procedure", db, F.col("r.name"), F.col("r.signature"))).alias("routine_id")


def loader_graph(files: DataFrame, columns: DataFrame, database: str) -> Graph:
    """Graph of loader control files (relative_path, text): LOADS_INTO edges to tables, MAPS_TO edges to columns that the catalog (database_key, object_name, column_name) has, READS_FROM edges from data files; issues."""
    ship(files.sparkSession)
    a = stored(files.where("text is not null").select("relative_path", sqltext.loader("text").alias("l")))
    db = F.lit(database)
    me = stable_id("loader-control", db, "relative_path")
    targets = a.select("relative_path", F.explode("l.targets").alias("t")).withColumn("table", leaf("t.table"))
    fields = targets.select("relative_path", "table", F.explode("t.fields").alias("f"))
    known = columns.where(F.col("database_key") == database).select(F.col("object_name").alias("table"), F.col("column_name").alias("column")).distinct()
    mapped = fields.withColumn("column", F.col("f.name")).join(known.withColumn("known", F.lit(True)), ["table", "column"], "left")
    data = a.select("relative_path", F.explode("l.files").alias("f")).where("f.kind = 'INFILE'")
    sure, none = F.lit(1.0), F.lit("")
    table, column, file = table_id(db, "table"), column_id(db, "table", "column"), stable_id("data-file", "f.path")
    nodes = _node(a, me, F.lit("LOADER_CONTROL"), F.col("relative_path"), database, F.to_json(F.struct(F.col("l.mode").alias("mode"))), sure).unionByName(_node(targets, table, F.lit("TABLE"), F.col("table"), database, F.to_json(F.struct("table")), sure)).unionByName(_node(mapped.where("known"), column, F.lit("COLUMN"), F.col("column"), database, F.to_json(F.struct("table", "column")), sure)).unionByName(_node(data, file, F.lit("DATA_FILE"), F.col("f.path"), database, F.lit("{}"), sure))
    edges = _edge(targets, me, F.lit("LOADS_INTO"), table, none, sure).unionByName(_edge(mapped.where("known"), me, F.lit("MAPS_TO"), column, F.coalesce(F.col("f.expression"), none), sure)).unionByName(_edge(data, me, F.lit("READS_FROM"), file, none, sure))
    issues = a.where("l.error is not null").select(F.col("l.error").alias("issue_type"), me.alias("source_node_id"), "relative_path").unionByName(mapped.where("known is null").select(F.lit("COLUMN_NOT_FOUND").alias("issue_type"), me.alias("source_node_id"), "relative_path").distinct())
    return Graph(nodes.dropDuplicates(["node_id"]), edges, None, None, issues)
