"""Database catalogs from CSV: declarative mapping profiles, validation row by row, import reports, and the graph they make.

Which profile a file has is decided on the driver from its name and header; the rows of all files of a profile are then one
DataFrame whose columns are expressions that the profile generates.
"""

from __future__ import annotations

import fnmatch
import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.ids import column_id, database_id, stable_id, table_id
from weftline.functions.names import oracle_identifier
from weftline.model import Graph
from weftline.operators.dedupe import by_policy
from weftline.operators.structure import contains

TABLE_FIELDS = ("database_key", "schema_name", "object_name", "object_type", "status", "comment")
COLUMN_FIELDS = ("database_key", "schema_name", "object_name", "column_name", "ordinal_position", "data_type", "data_length", "data_precision", "data_scale", "nullable", "default_value", "primary_key", "comment")
KINDS = {"database-tables": (TABLE_FIELDS, ("database_key", "schema_name", "object_name")), "database-columns": (COLUMN_FIELDS, ("database_key", "schema_name", "object_name", "column_name"))}
_NAMED = re.compile(r"(?i)database-(tables|columns)__([\w.-]+)[.]csv")
TRANSFORMS = {
    "trim": F.trim, "upper": F.upper, "lower": F.lower,
    "bool": lambda c: F.when(F.lower(F.trim(c)).isin("1", "true", "yes", "y"), "Y").otherwise("N"),
}


@dataclass(frozen=True)
class Profile:
    """How a foreign CSV maps to catalog fields: ``fields`` holds a column name, or constant, column with default, or fromFilename."""

    name: str
    kind: str
    pattern: str
    required: tuple[str, ...]
    fields: dict[str, str | dict]
    transforms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    output: str = ""
    identity: tuple[str, ...] = ()

    def fits(self, name: str, headers: list[str]) -> bool:
        return fnmatch.fnmatchcase(name.lower(), self.pattern.lower()) and {h.lower() for h in self.required} <= {h.lower() for h in headers}

    def columns(self, headers: list[str], file_database: Column) -> dict[str, Column]:
        """An expression for each target field; absent columns are ''."""
        have = {h.strip().lower(): h for h in headers}

        def column(name: str) -> Column:
            h = have.get(name.lower())
            return F.lit("") if h is None else F.trim(F.coalesce(F.col(f"`{h}`"), F.lit("")))

        out = {}
        for target, spec in self.fields.items():
            if isinstance(spec, str):
                c = column(spec)
            elif "constant" in spec:
                c = F.lit(str(spec["constant"] or ""))
            elif spec.get("fromFilename") == "database_key":
                c = file_database
            else:
                c = F.coalesce(F.nullif(column(str(spec.get("column") or "")), F.lit("")), F.lit(str(spec.get("default") or "")))
            for t in self.transforms.get(target, ()):
                c = TRANSFORMS[t](c)
            out[target] = F.trim(c)
        return {"database_key": file_database} | out


def profile(spec: dict) -> Profile:
    """A checked profile; unknown kinds of fields, transforms or missing parts are errors."""
    match, output = spec.get("match") or {}, spec.get("output") or {}
    for key in ("name", "catalogType"):
        if not spec.get(key):
            raise ValueError(f"profile without {key}")
    if not match.get("filename") or not isinstance(spec.get("fields"), dict):
        raise ValueError(f"profile {spec['name']}: match.filename and fields are needed")
    unknown = {t for ts in (spec.get("transforms") or {}).values() for t in ts} - set(TRANSFORMS)
    if unknown:
        raise ValueError(f"profile {spec['name']}: unknown transforms {sorted(unknown)}")
    if spec["catalogType"] not in KINDS and not output.get("filename"):
        raise ValueError(f"profile {spec['name']}: output.filename is needed")
    name = output.get("filename", "")
    if name and (Path(name).name != name or not name.endswith(".csv")):
        raise ValueError(f"profile {spec['name']}: unsafe output {name!r}")
    return Profile(spec["name"], spec["catalogType"], match["filename"], tuple(match.get("requiredHeaders") or ()), spec["fields"], {k: tuple(v) for k, v in (spec.get("transforms") or {}).items()}, name, tuple(output.get("identity") or ()))


def load_profiles(folder: str) -> list[Profile]:
    at = Path(folder)
    return [profile(json.loads(p.read_text(encoding="utf-8"))) for p in sorted(at.glob("*.json"))] if at.is_dir() else []


def choose(name: str, headers: list[str], profiles: list[Profile]) -> tuple[Profile | None, str]:
    """The profile of a file, the built-in by name first, and the database its name says; several that fit are an error."""
    m = _NAMED.fullmatch(name)
    database = m.group(2).upper() if m else ""
    if m:
        kind = f"database-{m.group(1).lower()}"
        fields, identity = KINDS[kind]
        built_in = Profile(f"builtin-{kind}", kind, name, identity, {f: f for f in fields})
        if built_in.fits(name, headers):
            return built_in, database
    fits = [p for p in profiles if p.fits(name, headers)]
    if len(fits) > 1:
        raise ValueError(f"several profiles fit {name}: {', '.join(p.name for p in fits)}")
    return (fits[0] if fits else None), database


def inspect(spark: SparkSession, path: str) -> dict:
    """Headers of a CSV, what it seems to be, and a profile to fill in."""
    headers, name = _headers(spark, path), path.rpartition("/")[2]
    m = _NAMED.fullmatch(name)
    kind = f"database-{m.group(1).lower()}" if m else "unknown"
    return {"headers": headers, "catalogType": kind, "database_key": m.group(2).upper() if m else "", "template": {"name": name.rpartition(".")[0], "catalogType": kind, "match": {"filename": name, "requiredHeaders": headers}, "fields": {h: h for h in headers}, "transforms": {}, "output": {"filename": name}}}


def _headers(spark: SparkSession, path: str) -> list[str]:
    return [c.strip() for c in spark.read.option("header", True).csv(path).columns]


@dataclass(frozen=True)
class Imported:
    """tables and columns: valid rows with source_path; normalized: rows by output file; reports: a row per file; issues."""

    tables: DataFrame
    columns: DataFrame
    normalized: dict[str, DataFrame]
    reports: DataFrame
    issues: DataFrame


def _validated(df: DataFrame, kind: str) -> DataFrame:
    """Rows with identifiers normalised and ``problem``: null if the row is good."""
    fields, identity = KINDS[kind]
    problem: Column = F.lit(None).cast("string")
    for c in reversed(identity):
        problem = F.when(F.col(c) == "", F.lit(f"missing {c}")).when(oracle_identifier(c).isNull(), F.lit(f"malformed {c}")).otherwise(problem)
    clash = (F.col("file_database") != "") & (oracle_identifier("database_key") != F.col("file_database"))
    problem = F.when(problem.isNull() & clash, "database_key differs from the file name's").otherwise(problem)
    ups = {"status", "data_type", "nullable", "primary_key"}
    out = df.withColumn("problem", problem)
    if kind == "database-tables":
        sort = F.upper(F.when(F.col("object_type") == "", "TABLE").otherwise(F.col("object_type")))
        out = out.withColumn("object_type", sort).withColumn("problem", F.when(F.col("problem").isNull() & ~sort.isin("TABLE", "VIEW", "MATERIALIZED_VIEW"), "unknown object_type").otherwise(F.col("problem")))
    return out.withColumns({c: oracle_identifier(c) for c in identity} | {c: F.upper(c) for c in fields if c in ups})


def import_catalog(spark: SparkSession, folder: str, profiles: list[Profile] | None = None, policy: str = "error", strict: bool = False) -> Imported:
    """All CSV files in ``folder``/incoming (else ``folder``).  Duplicates by ``policy`` (error, first, last), orphan columns rejected; ``strict``: any rejection is an error."""
    at = Path(folder)
    root = at / "incoming" if (at / "incoming").is_dir() else at
    profiles = load_profiles(str(at / "profiles")) if profiles is None else profiles
    groups: dict[str, list[tuple[str, Profile, str, tuple[str, ...]]]] = {}
    bad: list[tuple[str, str, str, str, int, int, int, str, str]] = []
    known: list[tuple[str, str, str, str]] = []
    for path in sorted(root.rglob("*.csv")):
        rel = "catalog/" + path.relative_to(root).as_posix()
        try:
            headers = _headers(spark, str(path))
            p, db = choose(path.name, headers, profiles)
        except ValueError as e:
            bad.append((rel, "unknown", "", "", 0, 0, 0, "rejected", str(e)))
            continue
        if p is None:
            bad.append((rel, "unknown", "", "", 0, 0, 0, "rejected", "no profile fits"))
            continue
        groups.setdefault(p.kind if p.kind in KINDS else p.output, []).append((str(path), p, db, tuple(headers)))
        known.append((rel, p.kind, db, p.name))

    def rows(kind: str) -> DataFrame | None:
        out = None
        for path, p, db, headers in groups.get(kind, []):
            df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True).csv(path)
            df = df.toDF(*headers)
            cells = p.columns(list(headers), F.lit(db))
            rel = "catalog/" + Path(path).relative_to(root).as_posix()
            df = df.select(*(c.alias(n) for n, c in cells.items()), F.lit(db).alias("file_database"), F.lit(rel).alias("source_path"), (F.monotonically_increasing_id() + 2).alias("line"))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    issues = spark.createDataFrame([], "source_path string, line long, issue_type string, message string")
    counts = spark.createDataFrame([], "source_path string, n long, bad long")
    kept: dict[str, DataFrame] = {}
    for kind, (fields, identity) in KINDS.items():
        raw = rows(kind)
        if raw is None:
            kept[kind] = spark.createDataFrame([], ", ".join(f"{c} string" for c in (*fields, "source_path")) + ", line long")
            continue
        raw = raw.na.fill("", list(fields))
        v = _validated(raw, kind)
        good, dup = by_policy(v.where("problem is null").drop("problem", "file_database"), list(identity), policy, ["source_path", "line"])
        if kind == "database-columns":
            parents = kept["database-tables"].select(*KINDS["database-tables"][1]).distinct()
            orphans = good.join(parents, list(parents.columns), "left_anti")
            good = good.join(parents, list(parents.columns), "left_semi")
            issues = issues.unionByName(orphans.select("source_path", "line", F.lit("CATALOG_ORPHAN_COLUMN").alias("issue_type"), F.lit("no such table").alias("message")))
        issues = issues.unionByName(v.where("problem is not null").select("source_path", "line", F.lit("CATALOG_INVALID_ROW").alias("issue_type"), F.col("problem").alias("message"))).unionByName(dup.select("source_path", "line", F.lit("CATALOG_CONFLICT").alias("issue_type"), F.lit("duplicate identity").alias("message")))
        counts = counts.unionByName(raw.groupBy("source_path").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("bad")))
        kept[kind] = good.select(*fields, "source_path", "line")
    normalized = {}
    for kind, files in groups.items():
        if kind in KINDS:
            continue
        raw = rows(kind)
        p = files[0][1]
        good, dup = by_policy(raw.na.fill("").drop("file_database"), list(p.identity) or list(p.fields), policy, ["source_path", "line"])
        issues = issues.unionByName(dup.select("source_path", "line", F.lit("CATALOG_CONFLICT").alias("issue_type"), F.lit("duplicate identity").alias("message")))
        counts = counts.unionByName(raw.groupBy("source_path").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("bad")))
        normalized[kind] = good.select(*p.fields)
    rejected = issues.groupBy("source_path").agg(F.count("*").alias("rows_rejected"))
    files_df = spark.createDataFrame(known, "source_path string, catalog_type string, database_key string, profile_name string")
    reports = files_df.join(counts.drop("bad"), "source_path", "left").join(rejected, "source_path", "left").select(
        F.col("source_path").alias("path"), "catalog_type", "database_key", "profile_name", F.coalesce("n", F.lit(0)).alias("rows_read"), (F.coalesce("n", F.lit(0)) - F.coalesce("rows_rejected", F.lit(0))).alias("rows_imported"), F.coalesce("rows_rejected", F.lit(0)).alias("rows_rejected"), F.when(F.coalesce("rows_rejected", F.lit(0)) > 0, "partial").otherwise("imported").alias("status"), F.lit("").alias("message")
    )
    reports = reports.unionByName(spark.createDataFrame(bad, "path string, catalog_type string, database_key string, profile_name string, rows_read long, rows_imported long, rows_rejected long, status string, message string"))
    if strict and (bad or not issues.isEmpty()):
        raise ValueError("the catalog has rejected files or rows")
    return Imported(kept["database-tables"], kept["database-columns"], normalized, reports, issues)


def catalog_graph(found: Imported, system: str = "") -> Graph:
    """Database, schema, table and column nodes, who contains whom, and evidence of where each was listed."""
    t = found.tables
    # a table's id holds its schema only where the name is in several schemas of its database
    several = t.groupBy("database_key", "object_name").agg((F.count_distinct("schema_name") > 1).alias("several"))
    token = F.when(F.col("several"), F.concat_ws(".", "schema_name", "object_name")).otherwise(F.col("object_name"))
    named = t.join(several, ["database_key", "object_name"]).withColumn("token", token).withColumns({"db": database_id("database_key"), "sc": stable_id("database-schema", "database_key", "schema_name"), "tb": table_id("database_key", "token")})
    cols = found.columns.join(named.select("database_key", "schema_name", "object_name", "token", "tb"), ["database_key", "schema_name", "object_name"]).withColumn("co", column_id("database_key", "token", "column_name"))
    none = F.lit("")

    def node(df: DataFrame, id_: str, kind: Column, name: str, qualified: Column, props: Column) -> DataFrame:
        return df.select(F.col(id_).alias("node_id"), kind.alias("node_type"), F.col(name).alias("technical_name"), qualified.alias("qualified_name"), F.col(name).alias("default_display_name"), F.lit(system).alias("system_key"), F.col("database_key"), none.alias("repository_key"), F.lit("MAIN").alias("graph_role"), F.lit(1.0).alias("confidence"), props.alias("properties_json")).dropDuplicates(["node_id"])

    schema_of = F.to_json(F.struct(F.col("schema_name").alias("schema")))
    nodes = node(named, "db", F.lit("DATABASE"), "database_key", F.col("database_key"), F.lit("{}"))
    nodes = nodes.unionByName(node(named, "sc", F.lit("DATABASE_SCHEMA"), "schema_name", F.concat_ws(".", "database_key", "schema_name"), schema_of))
    nodes = nodes.unionByName(node(named, "tb", F.col("object_type"), "object_name", F.concat_ws(".", "schema_name", "object_name"), F.to_json(F.struct(F.col("comment"), F.col("schema_name").alias("schema"), F.col("status"), F.col("object_name").alias("table")))))
    nodes = nodes.unionByName(node(cols, "co", F.lit("COLUMN"), "column_name", F.concat_ws(".", "schema_name", "object_name", "column_name"), F.to_json(F.struct(F.col("column_name").alias("column"), F.col("data_type"), F.col("nullable"), F.col("primary_key"), F.col("schema_name").alias("schema"), F.col("object_name").alias("table")))))
    pair = lambda df, a, b: df.select(F.col(a).alias("parent"), F.col(b).alias("child")).distinct()
    edges = contains(pair(named, "db", "sc").union(pair(named, "sc", "tb")).union(pair(cols, "tb", "co")))
    seen = lambda df, c: df.select(F.lit("NODE").alias("target_type"), F.col(c).alias("target_id"), "source_path", F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit("CATALOG").alias("evidence_kind"), F.lit(1.0).alias("confidence"))
    return Graph(nodes, edges, seen(named, "tb").unionByName(seen(cols, "co")))
