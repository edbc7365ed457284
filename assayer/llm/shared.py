"""What several operators of this subpackage need: tables, written steps, joins of checked size, components, block compares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.session import written

#: Rows of two longs that may be broadcast: 2M rows are about 32 MB on an executor.  Beyond it Spark shuffles.
BROADCAST_ROWS = 2_000_000
#: Rows of one block when the members of an oversized group are compared block by block.
BLOCK_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """Hint a narrow table as broadcast only if its counted rows fit; the plan changes, never the rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b); comp is the smallest node reachable.

    Alternating large-star and small-star steps: each is one aggregate (combined before its shuffle) and one join
    on the node, which adaptive execution splits for a node with very many neighbours.  Every step is a written
    table, so a lost executor costs tasks and no lineage grows.  Loops and repeated edges do no harm.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    state = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == state:
            break
        state = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def in_blocks(members: DataFrame, key: list[str], item: str, rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Deal the members of each group over pairs of blocks (block_a <= block_b), so that every two members of a
    group meet in exactly one task group: (key..., block_a, block_b) with column `side` 0 (block_a) or 1 (block_b).

    rows: (key..., n), counted by an aggregate.  A group of at most block_rows is one group as before; a larger one
    becomes groups of about 2 * block_rows rows, however large it is.
    """
    n = F.ceil(F.col("n") / F.lit(block_rows)).cast("int")
    dealt = members.join(rows, key).withColumn("_blocks", n).withColumn("_own", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.select(
        *[c for c in dealt.columns if c not in ("_blocks", "_own", "_other", "n")],
        F.least("_own", "_other").alias("block_a"), F.greatest("_own", "_other").alias("block_b"),
        (F.col("_own") > F.col("_other")).cast("int").alias("side"))
