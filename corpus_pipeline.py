"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents; n_chars follows the text.

Null and empty texts, repeated rows, empty tables and further columns are as each
stage's operator says: rows without words go in the first stage, repeated rows go
or stay together until the third keeps the document of the least doc_id, rows
with a null doc_id are near-duplicates of nothing, columns beside text pass
through, and an empty table gives no pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import cminhash, decontam, linededup, linerules, packing
from plumbline.llm.components import shared_folder
from plumbline.sources.store import Files


def _documents(found: DataFrame, docs: DataFrame) -> DataFrame:
    """found with the columns of docs alone, n_chars brought up to date."""
    columns = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return found.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that fail go."""
    return _documents(linerules.line_quality(docs, clean=True, drop=True), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in one of them."""
    return _documents(linededup.dedup_lines(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least doc_id stays."""
    found = cminhash.near_duplicates(docs)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark contaminates go."""
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: No SQL counts byte-level BPE tokens or solves a packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again.

    run_id names the run's folder.  A run that is started again under its name
    goes on behind the last stage that was finished.  A stage's rows are deleted
    when the next one's are whole; those of the last are the result and stay.
    """
    files = Files(spark)
    folder = f"{shared_folder(spark)}/pipeline-{run_id or uuid.uuid4().hex}"
    done = next((k for k in reversed(range(len(STAGES))) if files.exists(f"{folder}/{k}/_SUCCESS")), -1)
    docs = spark.read.parquet(f"{folder}/{done}" if done >= 0 else f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        if k > done:
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            files.delete(f"{folder}/{k - 1}")
    return docs
