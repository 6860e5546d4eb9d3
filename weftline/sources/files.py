"""Source trees as tables: which files, in which encoding, with which text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import bom, declared_encoding, decode_file, language_of, newline_style
from weftline.session import ship

BLOCKED = ("node_modules", "bin", "obj", "dist", "build", "target", "packages", ".git", ".svn", ".vs", ".idea", "__pycache__")


def excluded(path: Column) -> Column:
    """Whether a path lies in a blocked folder or is a test."""
    return path.rlike(rf"(^|/)({'|'.join(b.replace('.', '[.]') for b in BLOCKED)})/") | path.rlike(r"(?i)\.(spec|test)\.[jt]sx?$")


def listed(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (), folders: tuple[str, ...] = ()) -> DataFrame:
    """path, relative_path, length, content of a tree's files; names filter before any content is read."""
    root = root.rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{root}/{f}" for f in folders] if folders else root)
    base = root.split("://")[-1]
    df = df.withColumn("relative_path", F.regexp_replace("path", "^.*?" + "".join(f"[{c}]" if c not in "^\\]" else "\\" + c for c in base) + "/", ""))
    if suffixes:
        df = df.where(F.lower("path").rlike("(" + "|".join(s.lower().replace(".", "[.]") for s in suffixes) + ")$"))
    return df.where(~excluded(F.concat(F.lit("/"), F.col("relative_path")))).dropDuplicates(["path"]).select("path", "relative_path", "length", "content")


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression over whole relative paths: ** crosses folders, * and ? don't."""
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "_/-" else "\\" + c), i + 1
    return f"^{out}$"


def encoding_rule(path: Column, overrides: list[tuple[str, str]], default: str | None = None) -> Column:
    """The last override whose glob matches, else the default."""
    rule = F.lit(default)
    for glob, encoding in overrides:
        rule = F.when(path.rlike(glob_pattern(glob)), encoding).otherwise(rule)
    return rule


def read_sources(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (), folders: tuple[str, ...] = (), most: int = 10 << 20, overrides: list[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Files with text (relative_path, text, encoding, declared, bom, newline_style, language, raw_sha256, text_sha256), and issues of those too large, in conflict, or undecodable."""
    ship(spark)
    files = listed(spark, root, suffixes, folders)
    large = files.where(F.col("length") > most).select("relative_path", F.lit("FILE_TOO_LARGE").alias("issue_type"))
    ok = files.where(F.col("length") <= most).withColumn("declared", F.coalesce(encoding_rule(F.col("relative_path"), overrides or []), declared_encoding(F.col("content"))))
    d = ok.withColumn("d", decode_file("content", "declared"))
    out = d.select("relative_path", F.col("d.text").alias("text"), F.col("d.encoding").alias("encoding"), "declared", bom(F.col("content")).alias("bom"), newline_style("d.text").alias("newline_style"), language_of("relative_path").alias("language"), F.sha2("content", 256).alias("raw_sha256"), F.sha2(F.col("d.text"), 256).alias("text_sha256"), F.col("d.issue").alias("issue"))
    issues = large.unionByName(out.where("issue is not null").select("relative_path", F.col("issue").alias("issue_type")))
    return out.where("text is not null").drop("issue"), issues


def tagged(files: DataFrame, folders: list[tuple[str, str]]) -> DataFrame:
    """Files with the database of the first folder that holds them (folder, database)."""
    tag = F.lit(None).cast("string")
    for folder, db in reversed(folders):
        tag = F.when(F.col("relative_path").startswith(folder.rstrip("/") + "/"), db).otherwise(tag)
    return files.withColumn("database", tag)
