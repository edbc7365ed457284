"""Joins of a large side with a side that is usually, but not provably, small."""

from pyspark.sql import DataFrame, functions as F

#: Bytes of a side as JSON text; its hashed rows may take several times that on every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32


def measured_bytes(df: DataFrame) -> int:
    """Size of a side as text, summed by the executors."""
    return df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns))) + 16)).first()[0] or 0


def join_by_size(large: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                 max_bytes: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """Broadcast the small side only after it was measured to fit.

    Beyond that the join is salted: each row of the large side gets one of `salts` values, the small side
    is repeated once per value, so a key that holds a third of all rows is spread over `salts` tasks.
    Works for inner, left, semi and anti joins, which all keep rows of the large side.
    """
    if measured_bytes(small) <= max_bytes:
        return large.join(F.broadcast(small), on, how)
    return salted_join(large, small, on, how, salts)


def salted_join(large: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    spread = F.pmod(F.xxhash64(*[c for c, t in large.dtypes if not t.startswith("map")]), F.lit(salts)).cast("int")
    left = large.withColumn("_salt", spread)
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy work enough tasks when a table came as a few files; larger tables stay as they are.

    For plain scans only: asking a plan with shuffles for its partitions would run them.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def once(df: DataFrame, **columns) -> DataFrame:
    """Add costly columns that are computed exactly once per row.

    They come out of a generator over one row.  Catalyst copies an expression into every filter it pushes
    below a projection (also the size check it adds for inline and explode), but never below a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def rows_of(df: DataFrame, array: str, key: str, *keep: str) -> DataFrame:
    """One row per item of an array column; empty arrays give no row."""
    return df.select(*keep, F.inline_outer(array)).filter(F.col(key).isNotNull())
