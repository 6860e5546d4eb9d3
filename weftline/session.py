"""Session helpers: shipping the package, the shared folder, cutting lineage, size checks before broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed (on a cluster: --py-files)."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; unset, one of our own in local mode and an error on a cluster."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(where)
        return where
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the shared folder: survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: computed once, and columns that aren't asked for aren't read again."""
    at = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: a small file is one task, whatever Python then does for each of its rows."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def kept(df: DataFrame, **conditions: Column) -> tuple[DataFrame, dict[str, int]]:
    """``written``, and how many rows there are (``rows``) and how many meet each of the conditions; counted while they are written."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), *(F.count(F.when(c, 1)).alias(n) for n, c in conditions.items())]
    out = written(df.observe(seen, *counts))
    return out, {"rows": 0, **dict.fromkeys(conditions, 0), **seen.get}


def small(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; counts no further than that."""
    return df.limit(most + 1).count() <= most


def hinted(df: DataFrame, rows: int, most: int = 400_000) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted before, are few."""
    return F.broadcast(df) if rows <= most else df


def maybe_broadcast(df: DataFrame, most: int = 400_000, most_bytes: int = 128 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its rows are few and, counted as JSON where they vary, small; else as it is (shuffle join). Counts no further than that."""
    fixed = all(isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)) for f in df.schema)
    size = F.lit(0) if fixed else F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    got = df.limit(most + 1).select(size.cast("long").alias("b")).agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if got["n"] <= most and got["b"] <= most_bytes else df
