"""Traversals: bounded impact traces, shortest paths, flows, reachability.  Each is a loop over levels; a level is one join of the frontier with the edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.model import DB_OBJECTS, FLOW, FLOW_ENTRIES, FLOW_TARGETS, Graph, Options, bag, one_of
from weftline.session import hinted, kept, maybe_broadcast, written

#: Frontiers of no more ids than this are looked up in the edges.
LOOKED_UP = 200


def is_target(types: frozenset[str] | None, db_rule: bool = False) -> Column:
    """Whether a node (node_type, properties_json) is of ``types``; by ``db_rule``, so is an unresolved reference that names a table."""
    if types is None:
        return F.lit(False)
    hit = one_of("node_type", types)
    return hit | ((F.col("node_type") == "UNRESOLVED_REFERENCE") & (bag("properties_json", "table") != "")) if db_rule else hit


@dataclass(frozen=True)
class Trace:
    """nodes: node_id, depth, target, node_type (null for starts that no node has); edges: edge_id, depth.  Starts have depth 0.  ``truncated``: a budget was reached."""

    nodes: DataFrame
    edges: DataFrame
    truncated: bool = False


def _cut(df: DataFrame, order: list, room: int) -> DataFrame:
    """The first ``room`` rows by ``order``."""
    return df.orderBy(*order).limit(room)


def _beside(steps: DataFrame, frontier: DataFrame, rows: int, key: str) -> DataFrame:
    """``steps`` joined with the frontier: few ids are looked up, which sorted files answer from a few row groups; more are broadcast, many shuffled."""
    if rows <= LOOKED_UP:
        ids = sorted({r[0] for r in frontier.select(key).collect()})  # LOOKED_UP at most
        steps = steps.where(F.col(key).isin(ids))
    return steps.join(hinted(frontier, rows), key)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def _only(df: DataFrame, column: str, kinds: list[str] | None) -> DataFrame:
    """The rows of ``kinds``; all if those are unknown.  Tables that are unions by type are read only where they hold one of them."""
    return df if kinds is None else df.where(F.col(column).isin(*kinds)) if kinds else df.where("false")


def _kinds_of(df: DataFrame, column: str = "node_type") -> list[str]:
    """The different types in ``df``: as many as the vocabulary has, at most."""
    return sorted(r[0] for r in df.select(column).distinct().collect() if r[0] is not None)


def typed(edges: DataFrame) -> bool:
    """Whether edges say of what type their ends are, as the lift does."""
    return {"source_type", "target_type"} <= {*edges.columns}


def leading(graph: Graph, types: list[str] | None, direction: str = "out", edge_types: frozenset[str] | None = None) -> list[str] | None:
    """The types that edges from ``types`` may lead to, where the graph says so: edge_ends of its extra tables has edge_type, source_type, target_type of all kinds of edges."""
    if types is None or "edge_ends" not in graph.extra:
        return None
    here, there = ("source_type", "target_type") if direction == "out" else ("target_type", "source_type")
    return sorted({r[there] for r in graph.extra["edge_ends"].collect() if r[here] in types and (edge_types is None or r["edge_type"] in edge_types)})  # a row per kind of edge


def trace(graph: Graph, starts: DataFrame, direction: str = "out", target_types: frozenset[str] | None = None, options: Options = Options(), db_rule: bool | None = None, max_depth: int | None = None) -> Trace:
    """Everything reachable from ``starts`` (node_id) within the depth; targets are recorded but not expanded, starts always are.

    ``direction``: out along the edges, in against them.  Budgets on nodes and edges (0: none) cut by level, then id: the
    engine's own order, since nothing orders the queue of a distributed search otherwise.  A level writes its new nodes, whose
    numbers come with the writing; nothing of earlier levels is written again.  Edges are written only where a budget cuts them:
    else they are those that leave the expanded nodes, found again when they are read.
    """
    here, there = ("source", "target") if direction == "out" else ("target", "source")
    db_rule = target_types == DB_OBJECTS if db_rule is None else db_rule
    depth_limit = options.trace_depth if max_depth is None else max_depth
    bounded, known_types = bool(options.max_nodes or options.max_edges), typed(graph.edges)
    kinds = graph.nodes.select("node_id", "node_type", is_target(target_types, db_rule).alias("target"))
    ends = [F.col(f"{here}_type").alias("from_type")] if known_types else []
    steps = graph.edges.select(F.col(f"{here}_node_id").alias("node_id"), F.col(f"{there}_node_id").alias("next"), "edge_id", *ends)
    begun, n = kept(starts.select("node_id", *[c for c in ("node_type",) if c in starts.columns]).distinct())
    own, n_own = kept(_beside(_only(kinds, "node_type", _kinds_of(begun) if "node_type" in begun.columns else None), begun.select("node_id").distinct(), n["rows"], "node_id"), goals=F.col("target"))
    types = _kinds_of(own) if known_types else None
    first, n = kept(begun.select("node_id").distinct().join(hinted(own.groupBy("node_id").agg(F.min("node_type").alias("node_type")), n_own["rows"]), "node_id", "left").withColumn("target", F.lit(False)))
    levels: list[DataFrame] = [first]  # of each level the nodes that no level before has: node_id, node_type, target
    walked: list[DataFrame] = []  # edge_id, next
    n_nodes, n_edges, truncated, frontier, at_front = n["rows"], 0, False, first, n["rows"]
    for depth in range(1, depth_limit + 1):
        if not at_front:
            break
        if (options.max_nodes and n_nodes >= options.max_nodes) or (options.max_edges and n_edges >= options.max_edges):
            truncated = True
            break
        out = _beside(_only(steps, "from_type", types), frontier.select("node_id"), at_front, "node_id")
        known = _union([x.select("node_id") for x in levels])
        if bounded:
            level, n = kept(out.select("edge_id", "next").join(kinds.withColumnRenamed("node_id", "next"), "next"))
            if options.max_edges:
                room = options.max_edges - n_edges
                if n["rows"] > room:
                    truncated, (level, n) = True, kept(_cut(level, ["edge_id"], room))
                n_edges += n["rows"]
            new = level.withColumnRenamed("next", "node_id")
        else:
            level = out.join(_only(kinds, "node_type", leading(graph, types, direction)).select(F.col("node_id").alias("next")), "next", "left_semi")
            met = out.select(F.col("next").alias("node_id")).distinct().join(known, "node_id", "left_anti")
            new = met.join(_only(kinds, "node_type", leading(graph, types, direction)), "node_id")
        walked.append(level.select("edge_id", "next", F.lit(depth).alias("depth")))
        new = new.groupBy("node_id").agg(F.min("node_type").alias("node_type"), F.max("target").alias("target"))
        new, n = kept(new.join(known, "node_id", "left_anti") if bounded else new, front=~F.col("target"))
        if options.max_nodes:
            room = max(0, options.max_nodes - n_nodes)
            if n["rows"] > room:
                truncated, (new, n) = True, kept(_cut(new, ["node_id"], room), front=~F.col("target"))
            n_nodes += n["rows"]
        levels.append(new)
        frontier, at_front = new.where("not target"), n["front"]
        types = _kinds_of(frontier) if known_types else None
    nodes = _union([x.select("node_id", F.lit(d).alias("depth"), "target", "node_type") for d, x in enumerate(levels)])
    if not walked:
        return Trace(nodes, graph.edges.select("edge_id", F.lit(0).alias("depth")).where("false"), truncated)
    if n_own["goals"]:  # a start that a cycle leads back to is a target too
        goals = maybe_broadcast(own.where("target").select("node_id").distinct())
        back = _union([x.select(F.col("next").alias("node_id")).join(goals, "node_id", "left_semi") for x in walked]).distinct().withColumn("back", F.lit(True))
        nodes = nodes.join(maybe_broadcast(back), "node_id", "left").select("node_id", "depth", (F.col("target") | F.coalesce("back", F.lit(False))).alias("target"), "node_type")
    return Trace(nodes, _union([x.select("edge_id", "depth") for x in walked]).groupBy("edge_id").agg(F.min("depth").alias("depth")), truncated)


def shortest_paths(edges: DataFrame, starts: DataFrame, nodes: DataFrame, target_types: frozenset[str], max_depth: int = 8, edge_types: frozenset[str] | None = None, db_rule: bool = False) -> DataFrame:
    """start, target, depth, nodes and edges (arrays): of each start to each reachable node of ``target_types`` the shortest path, of equals the one of least edge ids.

    Nodes of those types are passed through too.  A start is no target of its own.
    """
    steps = edges if edge_types is None else edges.where(one_of("edge_type", edge_types))
    steps = steps.select(F.col("source_node_id").alias("at"), F.col("target_node_id").alias("next"), "edge_id")
    kinds = nodes.where(is_target(target_types, db_rule)).select(F.col("node_id").alias("at"))
    none = F.array().cast("array<string>")
    frontier, n = kept(starts.select(F.col("node_id").alias("start"), F.col("node_id").alias("at")).distinct().withColumns({"edges": none, "nodes": F.array("at")}))
    seen = [frontier.select("start", "at")]
    found = [frontier.where("false").select("start", "at", F.lit(0).alias("depth"), "nodes", "edges")]
    for depth in range(1, max_depth + 1):
        grown = _beside(steps, frontier, n["rows"], "at").select("start", F.col("next").alias("at"), F.concat("edges", F.array("edge_id")).alias("edges"), F.concat("nodes", F.array("next")).alias("nodes"))
        new = grown.join(_union(seen), ["start", "at"], "left_anti").groupBy("start", "at").agg(F.min(F.struct("edges", "nodes")).alias("p")).select("start", "at", "p.edges", "p.nodes")
        frontier, n = kept(new)
        if not n["rows"]:
            break
        seen.append(frontier.select("start", "at"))
        found.append(frontier.join(kinds, "at", "left_semi").select("start", "at", F.lit(depth).alias("depth"), "nodes", "edges"))
    return _union(found).withColumnRenamed("at", "target")


def flow_type(node_type: Column) -> Column:
    return F.when(node_type.isin("ROUTE", "SCREEN", "UI_ACTION"), "UI").when(node_type == "API_OPERATION", "API").when(node_type.isin("COMMAND_MODE", "EXECUTABLE_ENTRY_POINT", "JOB"), "BATCH").otherwise("DATABASE")


@dataclass(frozen=True)
class Flows:
    """flows: flow_id, flow_type, start, target, target_type, depth, confidence, complete, nodes, edges; steps: flow_id, step_index, node_id, incoming_edge_id."""

    flows: DataFrame
    steps: DataFrame


def flows(graph: Graph, options: Options = Options(), entries: DataFrame | None = None, max_depth: int | None = None) -> Flows:
    """One flow per entry and reached target: breadth first along flow edges, in the order of (parent, edge type, target, edge id), at most ``max_flow_targets`` per entry (0: all)."""
    from weftline.functions.ids import flow_id

    kinds = graph.nodes.select(F.col("node_id").alias("next"), "node_type")
    ends = ["source_type", "target_type"] if typed(graph.edges) else []
    steps = graph.edges.where(one_of("edge_type", FLOW)).select(F.col("source_node_id").alias("at"), F.col("target_node_id").alias("next"), "edge_id", "edge_type", F.col("confidence").alias("c"), *ends)
    begin = graph.nodes.where(one_of("node_type", options.flow_entry_types or FLOW_ENTRIES)) if entries is None else graph.nodes.join(entries.select("node_id").distinct(), "node_id", "left_semi")
    frontier, n = kept(begin.select(F.col("node_id").alias("start"), F.col("node_id").alias("at"), F.col("node_type").alias("start_type"), F.col("confidence").alias("confidence"), F.lit(1).cast("long").alias("rank"), F.array("node_id").alias("nodes"), F.array().cast("array<string>").alias("edges")))
    seen, reached, at_front = [frontier.select("start", "at", F.col("start_type").alias("type"))], [], n["rows"]
    types = _kinds_of(frontier, "start_type") if ends else None
    for depth in range(1, (options.flow_max_depth if max_depth is None else max_depth) + 1):
        if not at_front:
            break
        order = ["rank", "edge_type", "next", "edge_id"]
        ahead = _only(steps, "source_type", types)
        onto = leading(graph, types, edge_types=FLOW)
        grown = _beside(ahead, frontier, at_front, "at").join(_only(kinds, "node_type", onto), "next").withColumn("goal", one_of("node_type", FLOW_TARGETS))
        for x in seen:  # what is of none of the types ahead can't come again
            if onto is None or {*onto} & {*_kinds_of(x, "type")}:
                grown = grown.join(x.select("start", F.col("at").alias("next")), ["start", "next"], "left_anti")
        first = grown.withColumn("nth", F.row_number().over(Window.partitionBy("start", "next").orderBy(*order))).where("nth = 1")
        level, n = kept(
            first.withColumn("position", F.row_number().over(Window.partitionBy("start").orderBy(*order))).select(
                "start", F.col("next").alias("at"), "start_type", F.least("confidence", "c").alias("confidence"), F.col("position").cast("long").alias("rank"), F.concat("nodes", F.array("next")).alias("nodes"), F.concat("edges", F.array("edge_id")).alias("edges"), "goal", "node_type"
            ),
            front=~F.col("goal"),
        )
        seen.append(level.select("start", "at", F.col("node_type").alias("type")))
        if n["rows"] > n["front"]:
            reached.append(level.where("goal").withColumn("depth", F.lit(depth)))
        frontier, at_front = level.where("not goal"), n["front"]
        types = _kinds_of(frontier) if ends else None
        frontier = frontier.drop("goal", "node_type")
        if at_front and reached and options.max_flow_targets:
            full = _union([x.select("start") for x in reached]).groupBy("start").count().where(F.col("count") >= options.max_flow_targets).select("start")
            frontier = frontier.join(full, "start", "left_anti")
    if reached:
        reached = _union(reached)
    else:
        reached = frontier.where("false").withColumns({"goal": F.lit(True), "node_type": F.lit(""), "depth": F.lit(0)})
    best = reached
    if options.max_flow_targets:
        best = reached.withColumn("nth", F.row_number().over(Window.partitionBy("start").orderBy("depth", "rank"))).where(F.col("nth") <= options.max_flow_targets)
    out = best.select(
        flow_id(F.col("start"), F.col("at"), F.col("edges")).alias("flow_id"), flow_type(F.col("start_type")).alias("flow_type"), "start", F.col("at").alias("target"), F.col("node_type").alias("target_type"), "depth", "confidence", (F.col("node_type") != "UNRESOLVED_REFERENCE").alias("complete"), "nodes", "edges"
    )
    step = out.select("flow_id", "edges", F.posexplode("nodes").alias("step_index", "node_id")).select("flow_id", "step_index", "node_id", F.when(F.col("step_index") > 0, F.get("edges", F.col("step_index") - 1)).alias("incoming_edge_id"))
    return Flows(out, step)


def flow_io(flow_steps: DataFrame, io_items: DataFrame) -> DataFrame:
    """flow_id, io_id, direction of every item that a node on the flow owns."""
    return flow_steps.select("flow_id", F.col("node_id").alias("owner_node_id")).join(io_items.select("owner_node_id", "io_id", "direction"), "owner_node_id").select("flow_id", "io_id", "direction").distinct()


def reachable(edges: DataFrame, starts: DataFrame, key: str | None = None, edge_types: frozenset[str] | None = None, graph: Graph | None = None) -> DataFrame:
    """node_id (and ``key`` of the start) of all that is reachable, starts included; cycles end, depth is unbounded.

    Where edges say the types of their ends, and starts theirs (node_type), a level reads the edges of its types, and is held against those before it of its types.
    """
    steps = edges if edge_types is None else edges.where(one_of("edge_type", edge_types))
    known_types = typed(edges) and "node_type" in starts.columns
    kind = [F.col("target_type").alias("node_type")] if known_types else []
    steps = steps.select(F.col("source_node_id").alias("node_id"), F.col("target_node_id").alias("next"), *(["source_type", *kind] if known_types else []))
    keys = [key] if key else []
    columns = [*keys, "node_id", *(["node_type"] if known_types else [])]
    frontier, n = kept(starts.select(*columns).distinct())
    types = _kinds_of(frontier) if known_types else None
    seen = [(frontier, types)]
    while n["rows"]:
        step = _beside(_only(steps, "source_type", types), frontier.drop("node_type"), n["rows"], "node_id")
        step = step.select(*keys, F.col("next").alias("node_id"), *(["node_type"] if known_types else []))
        onto = leading(graph, types, edge_types=edge_types) if known_types and graph is not None else None
        step = step.groupBy(*keys, "node_id").agg(F.min("node_type").alias("node_type")) if known_types else step.distinct()
        for x, of in seen:
            if onto is None or of is None or {*onto} & {*of}:
                step = step.join(x.select(*keys, "node_id"), [*keys, "node_id"], "left_anti")
        frontier, n = kept(step)
        types = _kinds_of(frontier) if known_types else None
        seen.append((frontier, types))
        if len(seen) > 16:  # a long plan is cut now and then
            seen = [(written(_union([x for x, _ in seen])), None)]
    return _union([x for x, _ in seen]).select(*keys, "node_id")


def relationships(graph: Graph, edge_types: frozenset[str], ui_types: frozenset[str], job_types: frozenset[str], db_types: frozenset[str], ui_depth: int = 6) -> DataFrame:
    """kind (API_DB, UI_API, JOB_DB), start, target, depth, confidence (least of the path, 0.2 if it has none), edges."""
    pick = lambda types: graph.nodes.where(one_of("node_type", types)).select("node_id")
    runs = [
        ("API_DB", shortest_paths(graph.edges, pick(frozenset({"API_OPERATION"})), graph.nodes, db_types, edge_types=edge_types, db_rule=True)),
        ("UI_API", shortest_paths(graph.edges, pick(ui_types), graph.nodes, frozenset({"API_OPERATION"}), ui_depth, edge_types)),
        ("JOB_DB", shortest_paths(graph.edges, pick(job_types), graph.nodes, db_types, edge_types=edge_types, db_rule=True)),
    ]
    every = None
    for kind, df in runs:
        df = df.withColumn("kind", F.lit(kind))
        every = df if every is None else every.unionByName(df)
    conf = graph.edges.select("edge_id", "confidence")
    least = every.select("kind", "start", "target", F.explode("edges").alias("edge_id")).join(conf, "edge_id").groupBy("kind", "start", "target").agg(F.min("confidence").alias("confidence"))
    return every.join(least, ["kind", "start", "target"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.2)))


def propagated_labels(seeds: DataFrame, edges: DataFrame, edge_types: frozenset[str]) -> DataFrame:
    """node_id, label: labels spread over ``edge_types`` in both directions until nothing changes; a node takes the least label of its nearest labelled neighbours."""
    both = edges.where(one_of("edge_type", edge_types)).select(F.col("source_node_id").alias("node_id"), F.col("target_node_id").alias("other"))
    both = written(both.unionByName(both.select(F.col("other").alias("node_id"), F.col("node_id").alias("other"))).distinct())
    frontier, n = kept(seeds.where("label is not null").groupBy("node_id").agg(F.min("label").alias("label")))
    done = [frontier]
    while n["rows"]:
        near = both.join(hinted(frontier, n["rows"]), "node_id").groupBy(F.col("other").alias("node_id")).agg(F.min("label").alias("label"))
        frontier, n = kept(near.join(_union(done).select("node_id"), "node_id", "left_anti"))
        done.append(frontier)
        if len(done) > 16:
            done = [written(_union(done))]
    return _union(done)


def seed_labels(nodes: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """node_id, label: the source a node belongs to, by its own property, else by repository, system or evidenced path, if only one source has it.

    ``sources``: source_key, repository_key, system_key, relative_path.
    """
    own = bag("properties_json", "source_key", "source_id")

    def only(column: str) -> DataFrame:
        return sources.where(F.col(column) != "").groupBy(column).agg(F.count_distinct("source_key").alias("n"), F.min("source_key").alias(f"by_{column}")).where("n = 1").drop("n")

    paths = evidence.where("target_type = 'NODE'").select(F.col("target_id").alias("node_id"), F.col("source_path").alias("relative_path")).distinct().join(only("relative_path"), "relative_path")
    by_path = paths.groupBy("node_id").agg(F.count_distinct("by_relative_path").alias("n"), F.min("by_relative_path").alias("by_path")).where("n = 1").drop("n")
    joined = nodes.select("node_id", "repository_key", "system_key", F.nullif(own, F.lit("")).alias("own")).join(only("repository_key"), "repository_key", "left").join(only("system_key"), "system_key", "left").join(by_path, "node_id", "left")
    return joined.select("node_id", F.coalesce("own", "by_repository_key", "by_system_key", "by_path").alias("label"))
