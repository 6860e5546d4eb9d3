"""Identities: stable IDs, canonical hashes, compact numbers, and their validity, all as column expressions."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.names import oracle_identifier
from weftline.functions.routes import route_path, verb
from weftline.model import EDGE_TYPES, LAYERS, one_of
from weftline.session import ship

STABLE_ID = r"^[a-z][a-z0-9-]*(:[^|\r\n:][^|\r\n]*)+$"
UUID_PART = r":[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}(:|$)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stable_id(kind: str, *parts: Column | str) -> Column:
    """kind:part:part…, null if a part is missing or has a line end or a bar."""
    values = [F.trim(_c(p).cast("string")) for p in parts]
    bad = F.lit(False)
    for v in values:
        bad = bad | F.coalesce((v == "") | v.rlike(r"[|\r\n]"), F.lit(True))
    return F.when(~bad, F.concat_ws(":", F.lit(kind.strip().lower().replace("_", "-")), *values))


def database_id(db: Column | str) -> Column:
    return stable_id("database", oracle_identifier(db))


def table_id(db: Column | str, table: Column | str) -> Column:
    return stable_id("table", oracle_identifier(db), oracle_identifier(table))


def column_id(db: Column | str, table: Column | str, column: Column | str) -> Column:
    return stable_id("column", *map(oracle_identifier, (db, table, column)))


def typed_id(kind: str, *parts: Column | str) -> Column:
    """IDs of database objects: each part is an Oracle identifier (sequence, view, synonym, trigger, package, external object)."""
    return stable_id(kind, *map(oracle_identifier, parts))


def routine_id(kind: str, db: Column | str, owner: Column | str, name: Column | str, types: Column | None = None) -> Column:
    signature = F.lit("void") if types is None else F.coalesce(F.nullif(F.array_join(F.transform(types, lambda t: F.upper(F.trim(t))), ","), F.lit("")), F.lit("void"))
    return stable_id(kind, *map(oracle_identifier, (db, owner, name)), signature)


def api_operation_id(application: Column | str, method: Column | str, route: Column | str, kind: str = "api-operation") -> Column:
    return stable_id(kind, application, verb(method), route_path(route))


def edge_id(source: Column | str, edge_type: Column | str, target: Column | str, raw: Column | str | None = None, layer: Column | str | None = None) -> Column:
    """edge: and the sha256 of the five parts joined by bars; without an operation '', without a layer TECHNICAL."""
    operation = F.lit("") if raw is None else F.coalesce(_c(raw), F.lit(""))
    return F.concat(F.lit("edge:"), F.sha2(F.concat_ws("|", _c(source), _c(edge_type), _c(target), operation, F.lit("TECHNICAL") if layer is None else _c(layer)), 256))


def edge_id_valid(source: Column, edge_type: Column, target: Column, layer: Column) -> Column:
    return one_of(edge_type, EDGE_TYPES) & one_of(layer, LAYERS) & (source != "") & (target != "") & ~F.concat(source, edge_type, target, layer).rlike(r"[|\r\n]")


def io_id(owner: Column, direction: Column, kind: Column, name: Column, discriminator: Column) -> Column:
    return F.concat(F.lit("io:"), F.sha2(F.concat_ws("|", owner.cast("string"), direction, kind, name, discriminator), 256))


def flow_id(start: Column, target: Column, edges: Column) -> Column:
    return F.concat(F.lit("flow:"), F.sha2(F.concat_ws("|", start.cast("string"), target.cast("string"), F.array_join(edges, "|")), 256))


def placeholder_id(expected: Column | str) -> Column:
    return F.concat(F.lit("unresolved-reference:DEFERRED:"), F.left(F.sha2(_c(expected), 256), F.lit(24)))


def content_hash(*columns: str) -> Column:
    """sha256 of a JSON object of the columns, sorted by name; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def stable_id_valid(value: Column | str) -> Column:
    """Grammar of stable IDs: prefix and parts, no empty part, host URL, backslash or UUID."""
    v = _c(value)
    return F.coalesce(v.rlike(STABLE_ID) & (F.trim(v) == v) & ~v.contains("://") & ~v.contains("\\") & ~v.contains("::") & ~v.endswith(":") & ~v.rlike(UUID_PART), F.lit(False))


def decoded_id(value: Column | str) -> Column:
    """kind, database, name, qualified_name, table, column, package, routine of a stable ID ('' where they don't apply)."""
    parts = F.split(_c(value), ":")
    n, prefix = F.size(parts), F.get(parts, F.lit(0))
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    routine, last = prefix.isin("procedure", "function", "local-routine"), at(-1)
    name = F.when(routine & (n >= 2), at(-2)).otherwise(last)
    none = F.lit("")
    return F.struct(
        F.upper(F.replace(prefix, F.lit("-"), F.lit("_"))).alias("kind"),
        F.when((n >= 3) & prefix.isin("table", "column", "procedure", "function", "sequence", "view", "materialized-view"), F.upper(at(2))).otherwise(none).alias("database"),
        name.alias("name"),
        F.array_join(F.filter(F.slice(parts, 2, F.greatest(n - 1, F.lit(0))), lambda x: x != ""), ".").alias("qualified_name"),
        F.when(prefix.isin("table", "view", "materialized-view"), name).when((prefix == "column") & (n >= 4), at(-2)).otherwise(none).alias("table"),
        F.when((prefix == "column") & (n >= 4), last).otherwise(none).alias("column"),
        F.when(routine & (n >= 5), at(3)).otherwise(none).alias("package"),
        F.when(routine & (n >= 5), at(-2)).otherwise(none).alias("routine"),
    )


def _compact(kind: str, stable: str, salt: int = 0) -> int:
    digest = hashlib.blake2b(f"{kind}|{stable}|{salt}".encode(), digest_size=8).digest()
    return int.from_bytes(digest, "big") & ((1 << 63) - 1) or 1


def compact_id(kind: str, value: Column | str) -> Column:
    """63-bit number of a stable ID (BLAKE2b), salt 0; null stays null."""

    @F.pandas_udf(T.LongType())
    def number(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else _compact(kind, v) for v in values], dtype="Int64")

    return number(_c(value))


def compact_map(df: DataFrame, id_col: str, kind: str) -> DataFrame:
    """stable_id, compact_id of all distinct IDs; where two share a number, the later by name is salted until it is free.

    Collisions of 63-bit numbers are so rare that only the IDs involved are collected, if there are any.
    """
    ship(df.sparkSession)
    ids = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("stable_id")).distinct().withColumn("compact_id", compact_id(kind, "stable_id"))
    clash = ids.groupBy("compact_id").agg(F.array_sort(F.collect_list("stable_id")).alias("ids")).where(F.size("ids") > 1)
    moved = []
    for row in clash.collect():
        for stable in row["ids"][1:]:
            salt = 1
            while ids.where(F.col("compact_id") == _compact(kind, stable, salt)).count():
                salt += 1
            moved.append((stable, _compact(kind, stable, salt)))
    if not moved:
        return ids
    fix = df.sparkSession.createDataFrame(moved, "stable_id string, moved long")
    return ids.join(fix, "stable_id", "left").select("stable_id", F.coalesce("moved", "compact_id").alias("compact_id"))
