"""A corpus from raw documents: quality, near duplicates, benchmark passages, secrets, tokens.

Each stage takes what its predecessor kept, written as Parquet and read again; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe, decontam, quality, secretscan, simhash
from weftline.llm.common import shared_dir

STAGES = [
    ("quality classifier", quality.stage),
    ("SimHash near-dedup", simhash.stage),
    ("benchmark decontamination", decontam.stage),
    ("secret scans", secretscan.stage),
    ("byte-level BPE", bpe.stage),
]

#: None: a fitted classifier, a tree search and a tokenizer aren't SQL. tests/llm holds run() against brute force.
ORACLE_SQL = None


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents in ``sf_dir``: doc_id, lang, source, n_chars and the tokens of what the stages leave.

    Null texts pass every stage but near-dedup's and decontamination's questions, and have null tokens; empty texts have
    none.  Repeated rows of a document are copies: one stays.  Of ties the stages' docstrings tell.  Very long texts are
    taken whole; an empty table gives no rows.  Columns of any other name pass through to the last stage, which leaves them out.
    A stage's table is deleted once the next one is written; the last one stays, since the result reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            delete(spark, f"{at}/{k - 1}")
    return docs
