"""Removal of lines that several documents share; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import meeting, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def folded(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def lines_of(text: str = "text") -> Column:
    """The lines of a text; null or empty is one empty line."""
    return F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """128-bit hash of a normalised line (as two longs), from its bytes."""
    key = folded(F.btrim(line, F.lit(BLANKS)))
    return F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), F.reverse(key)).alias("g"))


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """Per row of docs: all its columns, with text kept in `text`, and n_lines, n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z
    lower-cased.  A key of at least least_chars code points that least_docs
    documents hold keeps its lines in the document of the largest doc_id only.

    Columns of docs other than doc_id and text pass through unless they are
    named n_lines or n_dropped.  A null or empty text is one empty line.  Rows
    that repeat a doc_id are one document when documents are counted.  A null
    doc_id counts as no document, and its row loses every line whose key is
    dropped.  An empty table gives no rows.

    Lines are exploded as hashes and counted with partial aggregation.  The few
    keys over the threshold meet their places in a join that deals a very common
    key over many tasks, and the positions to drop go back to their row.  For
    that, and only then, each text is shuffled once, by its row.
    """
    docs = docs.drop("n_lines", "n_dropped").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    row = [F.col("doc_id").alias("__plumb_doc"), F.xxhash64("text").alias("__plumb_row")]
    places = docs.select(*row, F.posexplode(lines_of()).alias("__plumb_pos", "__plumb_line"))
    places = places.where(F.length(F.btrim("__plumb_line", F.lit(BLANKS))) >= least_chars).select("__plumb_doc", "__plumb_row", "__plumb_pos", line_key(F.col("__plumb_line")).alias("__plumb_key"))
    places = places.select("__plumb_doc", "__plumb_row", "__plumb_pos", "__plumb_key.h", "__plumb_key.g")
    counted = places.groupBy("h", "g").agg(F.count_distinct("__plumb_doc").alias("n"), F.max("__plumb_doc").alias("__plumb_last"), F.count("*").alias("size"))
    common = saved(counted.where(F.col("n") >= least_docs).select("h", "g", "__plumb_last", "size"))
    total = common.agg(F.sum("size")).first()[0] or 0
    lost = (
        meeting(places, common, ["h", "g"], total, F.xxhash64("__plumb_doc", "__plumb_row", "__plumb_pos"))
        .where(~F.col("__plumb_doc").eqNullSafe(F.col("__plumb_last")))
        .groupBy("__plumb_doc", "__plumb_row")
        .agg(F.collect_set("__plumb_pos").alias("__plumb_lost"))
    )
    joined = docs.withColumn("__plumb_hash", F.xxhash64("text")).join(lost, F.col("doc_id").eqNullSafe(F.col("__plumb_doc")) & (F.col("__plumb_hash") == F.col("__plumb_row")), "left")
    lines = lines_of()
    left = F.when(F.col("__plumb_lost").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("__plumb_lost", i)), "\n")
    )
    return joined.select(
        *[left.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("__plumb_lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )
