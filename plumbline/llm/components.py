"""Connected components of an edge table, by alternating large and small stars, and joins that split their hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key is hot with more than one row in HOT of all; so there are fewer than HOT hot keys, whatever the data.
HOT = 2000
SALTS = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the cluster sets it.

    Only on one machine, where it is unset, a folder below the warehouse is taken.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set - it must name a folder that driver and executors share")
    return told or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; the shuffle files behind it go when it is done."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        own = df.select("*")  # a plan of its own, made under this setting
    finally:
        spark.conf.set(CLEANUP, before)
    return own.checkpoint()


def meeting(rows: DataFrame, table: DataFrame, keys: list[str], total: int, spread: Column, size: str = "size") -> DataFrame:
    """rows joined with table on keys; table has one row a key, whose column `size` says how many of rows hold it.

    total: the number of rows, or a bound of it.  Hot keys, fewer than HOT of
    them, are told to all tasks, which deal their rows over SALTS groups by
    spread; their row of table goes to each of these groups.
    """
    hot = table.where(F.col(size) * HOT > total).select(*keys, F.lit(SALTS).alias("__plumb_salts"))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("__plumb_salt", F.when(F.col("__plumb_salts").isNull(), 0).otherwise(F.pmod(spread, F.lit(SALTS)).cast("int")))
    last = F.when(F.col(size) * HOT > total, SALTS - 1).otherwise(0)
    dealt = table.withColumn("__plumb_salt", F.explode(F.sequence(F.lit(0), last))).drop(size)
    return salted.drop("__plumb_salts").join(dealt, [*keys, "__plumb_salt"]).drop("__plumb_salt")


def _star(edges: DataFrame, total: int) -> DataFrame:
    """Every (u, v) with m, the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")).select("u", F.least("u", "m").alias("m"), "size")
    return meeting(edges, least, ["u"], total, F.xxhash64("v"))


def _flat(edges: DataFrame, n: int) -> bool:
    """Whether every u points to one v, and no v further on."""
    if n != edges.select("u").distinct().count():
        return False
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every end of an edge (a, b); component_id is the least id that can be reached.

    Each round costs two aggregations and two joins on the edges alone; stars
    shrink the depth of a tree by half or more in a round, and rounds go on until
    only flat trees are left.  Self loops, repeated and null edges are ignored;
    no edges give no rows.
    """
    edges = saved(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    n = edges.count()
    while n and not _flat(edges, n):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = saved(_star(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small = _star(large, 2 * n)
        edges = saved(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .distinct()
        )
        n = edges.count()
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id")).union(
        edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component_id")).distinct()
    )


def of_components(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs (a, b) with comp_a and comp_b, the components of their ends; an end in none is one of its own."""
    a = joined.select(F.col("doc_id").alias("a"), F.col("component_id").alias("comp_a"))
    b = joined.select(F.col("doc_id").alias("b"), F.col("component_id").alias("comp_b"))
    return pairs.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("comp_a", "a").alias("comp_a"), F.coalesce("comp_b", "b").alias("comp_b"))


def merged(joined: DataFrame, links: DataFrame, told: int = 200_000) -> DataFrame:
    """joined after links (a, b) between its components: only these are gone through again.

    Up to `told` components that change are told to all tasks, a checked size;
    more are joined by shuffle.
    """
    change = saved(components(of_components(links, joined).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))))
    new = change.select(F.col("doc_id").alias("component_id"), F.col("component_id").alias("__plumb_new"))
    moved = joined.join(F.broadcast(new) if change.count() <= told else new, "component_id", "left").select("doc_id", F.coalesce("__plumb_new", "component_id").alias("component_id"))
    return moved.union(change.join(joined, "doc_id", "left_anti"))
