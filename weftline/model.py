"""Vocabularies, table schemas, options, and the bundle of tables that a graph is."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


#: Node types by what they are part of.
DB_OBJECTS = _set("EXTERNAL_DATABASE_OBJECT MATERIALIZED_VIEW TABLE VIEW")
UI = _set("ANGULAR_COMPONENT API_CALL_REFERENCE API_CLIENT_CALL COMPONENT ROUTE SCREEN UI_ACTION")
JOBS = _set("EXECUTABLE EXECUTABLE_ENTRY_POINT JOB JOB_NETWORK LOADER_CONTROL")
ROUTINES = _set("FUNCTION LOCAL_ROUTINE PROCEDURE")
CODE = _set("API_OPERATION FUNCTION INLINE_SQL LOCAL_ROUTINE MAPPER_STATEMENT METHOD PROCEDURE REPOSITORY SQL_FILE SQL_STATEMENT")
DEFERRED = _set("EXTERNAL_DATABASE_OBJECT UNRESOLVED_REFERENCE")
API_CALLS = _set("API_CALL_REFERENCE API_CLIENT_CALL")
NODE_TYPES = DB_OBJECTS | UI | JOBS | ROUTINES | CODE | DEFERRED | API_CALLS | _set(
    "ANGULAR_PROJECT ANGULAR_SERVICE API_APPLICATION APPLICATION ASSEMBLY CLASS COLUMN COMMAND_MODE CONFIG_KEY CONTROLLER CSHARP_TYPE DATABASE "
    "DATABASE_LINK DATABASE_SCHEMA DATA_FILE DOTNET_PROJECT DOTNET_SOLUTION EXTERNAL_API_OPERATION EXTERNAL_SYSTEM FILE INTERFACE NAMESPACE "
    "PACKAGE PLSQL_PACKAGE PROJECT SEQUENCE SERVICE SYNONYM SYSTEM TRIGGER XML_SQL_FRAGMENT XML_SQL_MAPPER"
)

#: Edge types by what they do.
READS = _set("READS READS_COLUMN READS_FROM REMOTE_READS")
WRITES = _set("DELETES INSERTS LOADS_INTO MERGES POPULATES UPDATES WRITES WRITES_COLUMN WRITES_TO")
CONTROL = _set("CALLS CALLS_API ENTRY_IN EXECUTES_SQL HANDLED_BY HANDLES_API RESOLVES_TO STARTS TRIGGERS TRIGGERS_JOB")
FLOW = READS | WRITES | CONTROL | _set("CONTAINS DEFINES_STATEMENT INCLUDES_FRAGMENT USES_SEQUENCE")
PROPAGATION = _set("BELONGS_TO CONTAINS DEFINES_STATEMENT ENTRY_IN EXECUTES_SQL HANDLED_BY HANDLES_API INCLUDES_FRAGMENT PROJECT_REFERENCE")
EDGE_TYPES = FLOW | PROPAGATION | _set("DEPENDS_ON DERIVES_FROM IMPLEMENTS INJECTS MAPS_TO NAVIGATES_TO RETURNS ROUTES_TO THROWS USES")
DB_EDGES = READS | WRITES
FLOW_ENTRIES = _set("API_OPERATION COMMAND_MODE EXECUTABLE_ENTRY_POINT JOB ROUTE SCREEN TRIGGER UI_ACTION")
FLOW_TARGETS = _set("COLUMN DATA_FILE EXTERNAL_API_OPERATION EXTERNAL_SYSTEM MATERIALIZED_VIEW TABLE UNRESOLVED_REFERENCE VIEW")
SEMANTIC_IO = CODE - _set("REPOSITORY SQL_FILE") | _set("COMMAND_MODE EXECUTABLE_ENTRY_POINT JOB LOADER_CONTROL")
LAYERS = ("DATA_FLOW", "STRUCTURAL", "TECHNICAL")
ROLES = ("MAIN", "TECHNICAL", "EVIDENCE")
SEVERITIES = ("ERROR", "WARNING", "INFO")

#: Interchange columns of the five CSV tables (all strings, '' where missing), and of the optional texts.
COLUMNS: dict[str, tuple[str, ...]] = {
    "nodes": ("node_id", "node_type", "technical_name", "qualified_name", "default_display_name", "system_key", "database_key", "repository_key", "graph_role", "confidence", "properties_json"),
    "edges": ("edge_id", "source_node_id", "target_node_id", "edge_type", "graph_layer", "raw_operation", "confidence", "properties_json"),
    "evidence": ("evidence_id", "target_type", "target_id", "source_path", *(f"{a}_{b}" for b in ("line", "column") for a in ("start", "end")), "evidence_kind", "extractor_name", "confidence", "snippet", "properties_json"),
    "comments": ("comment_id", "source_path", "owner_node_id", "comment_kind", *(f"{a}_{b}" for b in ("line", "column") for a in ("start", "end")), "raw_text", "normalized_text", "language", "encoding", "properties_json"),
    "issues": ("issue_id", "issue_type", "severity", "source_node_id", "raw_reference", "database_key", "source_path", "start_line", "message", "properties_json"),
}
KEYS = {"nodes": "node_id", "edges": "edge_id", "evidence": "evidence_id", "comments": "comment_id", "issues": "issue_id"}


def csv_schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS[table]])


def typed(table: str, df: DataFrame) -> DataFrame:
    """Interchange strings to published types: numbers cast ('' and malformed: null), '' kept for text."""
    casts = {c: F.expr(f"try_cast(nullif(trim({c}), '') as {'double' if c == 'confidence' else 'int'})") for c in COLUMNS[table] if c == "confidence" or c.endswith(("_line", "_column"))}
    return df.withColumns(casts) if casts else df


@dataclass(frozen=True)
class Options:
    """Bounds and thresholds of enrichment and queries."""

    flow_max_depth: int = 8
    max_flow_targets: int = 100
    min_resolution_confidence: float = 0.85
    flow_entry_types: frozenset[str] = FLOW_ENTRIES
    max_candidates: int = 10
    trace_depth: int = 8
    max_nodes: int = 5_000
    max_edges: int = 10_000
    max_evidence: int = 5_000
    max_file_bytes: int = 10 << 20
    max_tree_lines: int = 20_000
    max_snippet_chars: int = 500
    max_issues_per_type: int = 20
    chunk_bytes: int = 1 << 20


@dataclass(frozen=True)
class Graph:
    """The tables of a graph; those that are absent are None."""

    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame | None = None
    comments: DataFrame | None = None
    issues: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def with_(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)


def one_of(column: Column | str, values: frozenset[str] | tuple[str, ...]) -> Column:
    return (F.col(column) if isinstance(column, str) else column).isin(*sorted(values))


def filled(*columns: Column | str) -> Column:
    """The first that is neither null nor blank, else ''."""
    trimmed = [F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("")) for c in columns]
    return F.coalesce(*trimmed, F.lit(""))


def bag(column: Column | str, *names: str) -> Column:
    """The first filled value of the named top-level properties of a JSON object."""
    c = F.col(column) if isinstance(column, str) else column
    return filled(*(F.get_json_object(c, f"$.{n}") for n in names))
