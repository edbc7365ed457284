"""Dense positions over a whole table, without a task that sorts it all."""

from pyspark.sql import Column, DataFrame, functions as F

from assayer.session import written


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df and the 1-based position of each row in `order`, which must tell any two rows apart.

    Rows are cut into ranges of the order and sorted within each; a range's first position follows from the sizes of the
    ranges before it, one number each.  The same positions come out on any number of partitions.
    """
    sorted_ = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(f"key{i}") for i, c in enumerate(order)])
    keys = [F.col(f"key{i}") for i in range(len(order))]
    sorted_ = sorted_.repartitionByRange(*keys).sortWithinPartitions(*keys).select("row", F.monotonically_increasing_id().alias("at"))
    sorted_ = written(sorted_, "numbered")  # `at` is the range's number times 2**33 plus the place in it
    sizes = sorted((r.part, r.n) for r in sorted_.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    before, first = 0, []
    for part, n in sizes:  # as many as partitions
        first.append((part, before))
        before += n
    first = df.sparkSession.createDataFrame(first, "part long, before long")
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return sorted_.withColumn("part", F.shiftright("at", 33).cast("long")).join(F.broadcast(first), "part").select(
        *[F.col(f"row.`{c}`").alias(c) for c in df.columns], place.alias(name))
