"""What reports on files and catalogs say: comment classes, output files, first places, operation ids, executables, quality lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.ids import stable_id
from weftline.functions.names import executable_name
from weftline.model import bag

#: Catalog issues that a quality report lists.
LISTED_ISSUES = 100


def comment_classes(comments: DataFrame) -> DataFrame:
    """source_path, comments, summary: how many comments a file has, and of each class, by name; a bag without a class is OTHER."""
    kind = F.coalesce(F.nullif(bag("properties_json", "classification"), F.lit("")), F.lit("OTHER"))
    n = comments.groupBy("source_path", kind.alias("class")).agg(F.count("*").alias("n"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("class", "n"))), lambda x: F.concat(x["class"], F.lit("="), x["n"].cast("string"))), ", ")  # a row per class
    return n.groupBy("source_path").agg(F.sum("n").alias("comments"), said.alias("summary"))


def output_paths(files: DataFrame, path: str = "relative_path") -> DataFrame:
    """``files`` with output_path: the file's name with .md for its ending; where several files would share that, .md after the whole name."""
    stem = F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")
    plain = F.concat(stem, F.lit(".md"))
    shared = files.select(plain.alias("__out")).groupBy("__out").agg((F.count("*") > 1).alias("__shared"))
    named = files.withColumn("__out", plain).join(shared, "__out")
    return named.withColumn("output_path", F.when(F.col("__shared"), F.concat(path, F.lit(".md"))).otherwise(F.col("__out"))).drop("__out", "__shared")


def declarations(evidence: DataFrame) -> DataFrame:
    """node_id, source_path, start_line, end_line: of the evidence of every node, the one that starts first, then by path and end."""
    place = F.struct(F.coalesce("start_line", F.lit(0)).alias("start_line"), "source_path", "end_line")
    first = evidence.where("target_type = 'NODE'").groupBy(F.col("target_id").alias("node_id")).agg(F.min(place).alias("p"))
    return first.select("node_id", "p.source_path", "p.start_line", "p.end_line")


def first_offsets(places: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, line, offset: the first place (offset) on every line."""
    return places.groupBy(*keys, "line").agg(F.min("offset").alias("offset"))


def operation_ids(endpoints: DataFrame, application: Column) -> DataFrame:
    """``endpoints`` (scoped_id, relative_path, start, handler_end, endpoint_key) with operation_id: of those of one scoped id, the first in its file keeps it, the others get one of their own."""
    w = Window.partitionBy("scoped_id").orderBy(F.coalesce("relative_path", F.lit("")), "start", "handler_end", "endpoint_key")
    own = stable_id("api-operation", application, "scoped_id", "endpoint_key")
    return endpoints.withColumn("__n", F.row_number().over(w)).withColumn("operation_id", F.when(F.col("__n") == 1, F.col("scoped_id")).otherwise(own)).drop("__n")


def executables(projects: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """executable, projects, names: executables by the target's name, else the assembly's, whatever the case, with all the names that lead to them.

    projects: project, assembly_name, target_name; aliases: executable, alias.
    """
    some = F.coalesce(F.nullif(F.trim("target_name"), F.lit("")), F.col("assembly_name"))
    each = projects.withColumn("executable", executable_name(some)).select("executable", "project", F.explode(F.array("assembly_name", "target_name")).alias("name"))
    if aliases is not None:
        known = each.select("executable").distinct()
        extra = aliases.select(executable_name("executable").alias("executable"), F.lit(None).cast("string").alias("project"), F.col("alias").alias("name")).join(known, "executable", "left_semi")
        each = each.unionByName(extra)
    named = each.withColumn("name", F.nullif(F.trim("name"), F.lit("")))
    return named.groupBy("executable").agg(F.count_distinct("project").alias("projects"), F.array_sort(F.collect_set(executable_name("name"))).alias("names"))


def quality_lines(metrics: DataFrame, issues: DataFrame | None = None, listed: int = LISTED_ISSUES) -> DataFrame:
    """part, n, line of a quality report: metrics (metric_name, metric_value) by name, then the first ``listed`` catalog issues (source_path, line, issue_type, message)."""
    number = lambda part, order: F.row_number().over(Window.partitionBy(F.lit(part)).orderBy(*order))
    out = metrics.select(F.lit("metrics").alias("part"), number("m", ["metric_name"]).alias("n"), F.concat(F.lit("- "), "metric_name", F.lit(": "), F.col("metric_value").cast("string")).alias("line"))
    if issues is None:
        return out
    first = issues.orderBy("source_path", "line", "issue_type", "message").limit(listed)
    text = F.concat(F.lit("- "), "issue_type", F.lit(": "), "message", F.lit(" ("), "source_path", F.lit(")"))
    return out.unionByName(first.select(F.lit("issues").alias("part"), number("i", ["source_path", "line", "issue_type", "message"]).alias("n"), text.alias("line")))


def column_file(database: Column, schema: Column, table: Column) -> Column:
    """Name of the file that holds a table's columns: a hash of what it is called, so that no name is unsafe."""
    return F.concat(F.lit("tables/v3/"), F.left(F.sha2(F.concat_ws("|", database, schema, table), 256), F.lit(24)), F.lit(".csv"))


def safe_output(path: Column) -> Column:
    """A relative CSV path as it is written, with slashes; null for one that leaves the folder, isn't a CSV, or is a file of the catalog's own."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = F.startswith(p, F.lit("/")) | p.rlike(r"(^|/)\.\.(/|$)") | ~F.lower(p).rlike(r"[^/]\.csv$") | (F.lower(p) == "tables.csv") | F.startswith(F.lower(p), F.lit("tables/v3/"))
    return F.when(~bad, F.regexp_replace(p, r"(^|/)(\./)+|//+", "$1"))
