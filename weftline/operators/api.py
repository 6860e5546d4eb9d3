"""The query API over a stored graph: find, explain, impact, trace, health."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import routes
from weftline.model import CODE, DB_OBJECTS, JOBS, UI, Graph, Options, bag, filled, one_of
from weftline.operators.links import api_signature
from weftline.operators.traverse import trace
from weftline.session import small


@dataclass(frozen=True)
class Answer:
    """What a query found; tables that it doesn't touch are None."""

    text: str
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    evidence: DataFrame | None = None
    issues: DataFrame | None = None
    data: dict[str, object] = field(default_factory=dict)

    def confidence(self) -> float | None:
        """The least of all nodes and edges."""
        found = [df.agg(F.min(F.col("confidence").cast("double"))).first()[0] for df in (self.nodes, self.edges) if df is not None]
        return min((x for x in found if x is not None), default=None)


def all_of(*conditions: Column | None) -> Column:
    """All given conditions; without any, an error: a finder never scans for everything by accident."""
    given = [c for c in conditions if c is not None]
    if not given:
        raise ValueError("a condition is needed")
    return reduce(lambda a, b: a & b, given)


def nocase(column: str, value: str) -> Column:
    """Equal but for the case of ASCII letters."""
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.col(column), up, low) == value.translate(str.maketrans(up, low))


def like(column: str, needle: str) -> Column:
    """Contains ``needle``, in which % and _ are wildcards, without regard to case."""
    return F.col(column).ilike(f"%{needle}%")


def bounded_snippet(column: str, most: int = 500) -> Column:
    return F.when(F.length(column) > most, F.concat(F.left(column, F.lit(most - 1)), F.lit("…"))).otherwise(F.col(column))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def table_lookup(needle: str) -> Column:
    """Whether a node goes by ``needle``: equal to, or the dotted or colon end of, its qualified name, id, name, or name with database and schema."""
    dotted = lambda *c: F.concat_ws(".", *(F.nullif(x, F.lit("")) for x in c))
    n = needle.upper()

    def named(r: Column) -> Column:
        """Of a row's bag and keys."""
        name = F.upper(filled(bag(r["properties_json"], "table", "object_name"), r["technical_name"]))
        return bound(F.struct(name.alias("name"), F.filter(F.split(name, r"\."), lambda p: p != "").alias("parts")), lambda x: found(r, x))

    def found(r: Column, x: Column) -> Column:
        name, parts = x["name"], x["parts"]
        schema = F.upper(filled(bag(r["properties_json"], "schema", "owner"), F.when(F.size(parts) >= 2, F.replace(F.try_element_at(parts, F.lit(-2)), F.lit('"')))))
        leaf = F.coalesce(F.when(name.contains("."), F.replace(F.try_element_at(parts, F.lit(-1)), F.lit('"'))), name)
        db = F.upper(filled(r["database_key"], bag(r["properties_json"], "database", "database_key")))
        return bound(F.struct(leaf.alias("leaf"), db.alias("db"), schema.alias("schema")), lambda y: F.exists(F.filter(F.array(F.upper(r["qualified_name"]), F.upper(r["node_id"]), y["leaf"], dotted(y["db"], y["leaf"]), dotted(y["db"], y["schema"], y["leaf"])), lambda k: k != ""), lambda k: (k == n) | F.endswith(k, F.lit("." + n)) | F.endswith(k, F.lit(":" + n.replace(".", ":")))))

    return bound(F.struct("properties_json", "technical_name", "qualified_name", "node_id", "database_key"), named)


@dataclass(frozen=True)
class Api:
    """Queries on a graph.  ``memory``: cards (node_id, kind, source, text), if there are any."""

    graph: Graph
    memory: DataFrame | None = None
    options: Options = Options()

    def find_node(self, node_id: str = "", qualified_name: str = "", node_type: str = "", limit: int = 50) -> Answer:
        n = self.graph.nodes
        if node_id:
            found = n.where(F.col("node_id") == node_id) if "stable_id" not in n.columns else n.where((F.col("node_id") == int(node_id)) if node_id.isdigit() else (F.col("stable_id") == node_id))
        elif qualified_name:
            equal = n.where(nocase("qualified_name", qualified_name))
            found = n.where(like("qualified_name", qualified_name)) if small(equal, 0) else equal
        else:
            found = n.where(all_of(nocase("node_type", node_type) if node_type else None))
        return Answer("nodes", nodes=found.orderBy("node_id").limit(limit))

    def find_edges(self, source: str = "", target: str = "", edge_type: str = "", limit: int = 200) -> Answer:
        ok = all_of(F.col("source_node_id") == source if source else None, F.col("target_node_id") == target if target else None, nocase("edge_type", edge_type) if edge_type else None)
        return Answer("edges", edges=self.graph.edges.where(ok).orderBy("edge_id").limit(limit))

    def find_evidence(self, target_id: str, limit: int = 100) -> Answer:
        assert self.graph.evidence is not None
        order = [c for c in ("evidence_id", "target_type", "source_path", "start_line", "end_line") if c in self.graph.evidence.columns]
        return Answer("evidence", evidence=self.graph.evidence.where(F.col("target_id") == target_id).orderBy(*order).limit(limit))

    def open_source(self, evidence_id: str) -> DataFrame:
        """Where a piece of evidence is from: source_path, lines, snippet."""
        assert self.graph.evidence is not None
        return self.graph.evidence.where(F.col("evidence_id") == evidence_id).select("source_path", "start_line", "end_line", bounded_snippet("snippet", self.options.max_snippet_chars).alias("snippet"))

    def list_issues(self, source: str = "", issue_type: str = "", severity: str = "", limit: int = 200) -> Answer:
        assert self.graph.issues is not None
        df = self.graph.issues
        for ok in (F.col("package_key") == f"sources/{source}" if source else None, nocase("issue_type", issue_type) if issue_type else None, nocase("severity", severity) if severity else None):
            df = df if ok is None else df.where(ok)
        return Answer("issues", issues=df.orderBy("issue_id").limit(limit))

    def unresolved(self, limit: int = 200) -> Answer:
        found = self.graph.nodes.where(F.col("node_type").isin("EXTERNAL_DATABASE_OBJECT", "UNRESOLVED_REFERENCE")).orderBy("node_id").limit(limit)
        ranked = self.graph.extra.get("resolution_candidates")
        data = {} if ranked is None else {"candidates": ranked.join(found.select(F.col("node_id").alias("reference_node_id")), "reference_node_id", "left_semi").orderBy("reference_node_id", "rank").limit(10 * limit)}
        return Answer("unresolved", nodes=found, data=data)

    def explain_node(self, node_id: str) -> Answer:
        e = self.graph.edges.where((F.col("source_node_id") == node_id) | (F.col("target_node_id") == node_id))
        data = {} if self.memory is None else {"memory": self.memory.where(F.col("node_id") == node_id)}
        return Answer("explain", nodes=self.find_node(node_id=node_id).nodes, edges=e, evidence=None if self.graph.evidence is None else self.find_evidence(node_id).evidence, data=data)

    def input_output(self, node_id: str) -> DataFrame:
        return self.graph.extra["io_items"].where(F.col("owner_node_id") == node_id).orderBy("direction", "kind", "name")

    def trace_flow(self, flow_or_node: str, limit: int = 100) -> DataFrame:
        """Flows that start or end at a node, pass it, or have the id; a union of three lookups, not a join with OR."""
        flows, steps = self.graph.extra["flows"], self.graph.extra["flow_steps"]
        ids = flows.where((F.col("start") == flow_or_node) | (F.col("target") == flow_or_node) | (F.col("flow_id") == flow_or_node)).select("flow_id").union(steps.where(F.col("node_id") == flow_or_node).select("flow_id")).distinct()
        return flows.join(ids, "flow_id", "left_semi").orderBy("flow_id").limit(limit)

    def health(self) -> DataFrame:
        return self.graph.extra["quality_metrics"].orderBy("scope_type", "scope_key", "metric_name")

    def catalog_status(self) -> DataFrame:
        return self.graph.extra["catalog_files"].orderBy("path")

    def search_memory(self, text: str, kind: str = "", source: str = "", limit: int = 50) -> DataFrame:
        assert self.memory is not None
        df = self.memory.where(F.lower("text").contains(text.lower()))
        df = df.where(F.lower("kind") == kind.lower()) if kind else df
        df = df.where(F.lower("source") == source.lower()) if source else df
        return df.orderBy("node_id").limit(limit)

    def operations(self, method: str, path: str) -> DataFrame:
        """node_id of API nodes whose route is equal; if there are none, of those whose route matches part by part."""
        sig = api_signature(self.graph.nodes.where(F.col("node_type").isin("API_OPERATION", "API_CALL_REFERENCE", "API_CLIENT_CALL")))
        wanted = self.graph.nodes.sparkSession.createDataFrame([(method, path)], "m string, p string").select(routes.verb("m").alias("m"), routes.route_path("p").alias("p")).first()
        sig = sig.where(F.col("method") == wanted["m"])
        equal = sig.where(F.col("route") == wanted["p"])
        return (sig.where(routes.template_matches("route", F.lit(wanted["p"]))) if small(equal, 0) else equal).select("node_id")

    def _traced(self, text: str, starts: DataFrame, direction: str, types: frozenset[str]) -> Answer:
        t = trace(self.graph, starts, direction, types, self.options)
        nodes = self.graph.nodes.join(t.nodes.drop("node_type"), "node_id")
        edges = self.graph.edges.join(t.edges, "edge_id")
        evidence = None
        if self.graph.evidence is not None:
            keys = t.nodes.select(F.lit("NODE").alias("target_type"), F.col("node_id").alias("target_id")).union(t.edges.select(F.lit("EDGE"), "edge_id"))
            evidence = self.graph.evidence.join(keys, ["target_type", "target_id"], "left_semi").orderBy(F.desc("target_type"), "target_id").limit(self.options.max_evidence)
        return Answer(text, nodes, edges, evidence, data={"targets": t.nodes.where("target").select("node_id"), "truncated": t.truncated})

    def impact_api(self, method: str, path: str) -> Answer:
        return self._traced(f"impact of {method} {path}", self.operations(method, path), "out", DB_OBJECTS)

    def impact_table(self, database: str, schema: str, table: str) -> Answer:
        needle = ".".join(x for x in (database, schema, table) if x)
        starts = self.graph.nodes.where(one_of("node_type", DB_OBJECTS) | ((F.col("node_type") == "UNRESOLVED_REFERENCE") & (bag("properties_json", "table") != ""))).where(table_lookup(needle))
        return self._traced(f"impact of {needle}", starts.select("node_id", "node_type"), "in", CODE | UI | JOBS)

    def trace_ui_to_db(self, query: str) -> Answer:
        found = self.find_node(qualified_name=query, limit=20).nodes.select("node_id", "node_type")
        if small(found, 0) and " " in query:
            found = self.operations(*query.split(" ", 1))
        return self._traced(f"from {query} to the database", found, "out", DB_OBJECTS)


def from_parquet(spark: SparkSession, folder: str) -> Api:
    """The API over a published graph."""
    from weftline.sources.publish import read_published

    graph, memory = read_published(spark, folder)
    return Api(graph, memory)
