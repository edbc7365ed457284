"""Reproducible samplers, quotas and splits.

All of them order rows by md5(seed | key) instead of rand(), so a result never depends on partitioning.
The exact rank of a row inside an arbitrarily large group comes from counts per (group, hash prefix): prefixes that
hold too many rows are split by further digits, those beyond a quota are left out, until each holds few.  Then the
counts are summed up and only the rows of one prefix are sorted together.  No group is ever sorted in one task.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer import fixed_values as V
from assayer.session import written

#: Hex digits of the hash that one step looks at, all it has, and the most rows that are ranked together.
DIGITS, ALL_DIGITS, CELL_ROWS = 3, 32, 50_000


def hash_key(seed, *cols) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cols))


def _joined(rows: DataFrame, other: DataFrame, groups: list[str], *on: str) -> DataFrame:
    """Rows with the columns of `other` that are not in the key; a null group meets a null group."""
    renamed = other.select(*[F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(groups)], *[c for c in other.columns if c not in groups])
    return rows.join(renamed, [F.col(f"`{g}`").eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)] + [rows[c] == renamed[c] for c in on]).drop(
        *[f"_g{i}" for i in range(len(groups))], *[renamed[c] for c in on])


def cells(h: DataFrame, groups: list[str], wanted, bound: int) -> list[tuple[int, DataFrame]]:
    """(digits, table) pairs; a table has (groups..., _p, _n, _before, group_rows) for prefixes `_p` of that many digits.

    Together the prefixes are disjoint and hold every wanted row.  A prefix holds at most `bound` rows, unless all digits
    are used.  `_before` is how many rows of the group come before it; `wanted` leaves out prefixes that no one asks for.
    """
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))  # at most 16 ** DIGITS prefixes of a group
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = h.groupBy(*groups, F.substring("_h", 1, DIGITS).alias("_p")).agg(F.count("*").alias("_n"))
    now, digits, out = counts.select("*", earlier(whole).alias("_before"), F.sum("_n").over(whole).alias("group_rows")), DIGITS, []
    while True:
        now = written(wanted(now), "rank-cells")
        large = now.filter(F.col("_n") > bound)
        if digits >= ALL_DIGITS or large.isEmpty():
            return [*out, (digits, now)]
        out.append((digits, now.filter(F.col("_n") <= bound)))
        inside = _joined(h.withColumn("_q", F.substring("_h", 1, digits)), large.select(*groups, F.col("_p").alias("_q"), F.col("_before").alias("_base"), "group_rows"), groups, "_q")
        digits += DIGITS
        counts = inside.groupBy(*groups, "_q", F.substring("_h", 1, digits).alias("_p")).agg(
            F.count("*").alias("_n"), F.max("_base").alias("_base"), F.max("group_rows").alias("group_rows"))
        now = counts.select(*groups, "_p", "_n", (F.col("_base") + earlier(Window.partitionBy(*groups, "_q"))).alias("_before"), "group_rows")


def hash_rank(df: DataFrame, groups: list[str], key: list[str], seed, quotas: DataFrame | None = None,
              n: int | None = None, bound: int = CELL_ROWS) -> DataFrame:
    """Add `rank` (1-based, exact) and `group_rows`; with a quota keep only the first rows of each group.

    `key` must identify a row.  `quotas` is a small table (groups..., quota); `n` is one quota for all groups.  At most
    about `bound` rows are ranked in one task, however large a group is.
    """
    if quotas is not None and not groups:
        raise ValueError("quotas belong to groups; one quota for all rows is n")
    h = df.withColumn("_h", hash_key(seed, *key))

    def wanted(table: DataFrame) -> DataFrame:
        if quotas is not None:
            return _joined(table, quotas, groups).filter(F.col("_before") < F.col("quota")).drop("quota")
        return table if n is None else table.filter(F.col("_before") < n)

    def ranked(digits: int, table: DataFrame) -> DataFrame:
        rows = _joined(h.withColumn("_p", F.substring("_h", 1, digits)), table.drop("_n"), groups, "_p")
        w = Window.partitionBy(*groups, "_p").orderBy("_h", *key)
        return rows.withColumn("rank", (F.col("_before") + F.row_number().over(w)).cast("bigint")).drop("_h", "_p", "_before")

    out = reduce(DataFrame.unionByName, [ranked(*c) for c in cells(h, groups, wanted, bound)])
    if quotas is not None:
        return _joined(out, quotas, groups).filter(F.col("rank") <= F.col("quota")).drop("quota")
    return out if n is None else out.filter(F.col("rank") <= n)


def take(df, groups, key, seed, quotas=None, n=None) -> DataFrame:
    return hash_rank(df, groups, key, seed, quotas, n).drop("rank", "group_rows")


def sample_n(df, key, n: int, seed=17) -> DataFrame:
    """n rows of the whole input."""
    return take(df, [], key, seed, n=n)


def cap_per_label(df, key, n: int = V.PER_LABEL_CAP, seed=42) -> DataFrame:
    return take(df, ["kind", "label"], key, seed, n=n)


def cap_per_label_shared(df, key, cap: int, seed=42) -> DataFrame:
    """Older balance: a kind's cap is shared by its labels, tags are capped as one pool."""
    g = df.withColumn("_pool", F.when(F.col("kind") == "tag", F.lit(-1)).otherwise(F.col("label")))
    sizes = g.groupBy("kind", "_pool").agg(F.count("*").alias("_n"))
    labels = F.count("*").over(Window.partitionBy("kind"))
    quota = F.when(F.col("kind") == "tag", F.lit(cap)).otherwise(F.greatest(F.lit(10), F.floor(F.lit(cap) / labels)))
    return take(g, ["kind", "_pool"], key, seed, sizes.select("kind", "_pool", quota.alias("quota"))).drop("_pool")


def negative_quota(sizes: DataFrame, ratio: float) -> DataFrame:
    """Quota per label from (label, n): negatives are cut to the ratio only when that is a real cut."""
    pos = F.max(F.when(F.col("label") == 1, F.col("n"))).over(Window.partitionBy(F.lit(0)))
    target = F.floor(F.coalesce(pos, F.lit(0)) * (1 - ratio) / ratio).cast("bigint")
    cut = (F.col("label") == 0) & (F.col("n") > target) & (target > 0)
    return sizes.select("label", F.when(cut, target).otherwise(F.col("n")).alias("quota"))


def downsample_negatives(tags, key, ratio: float = V.TAG_POS_RATIO, seed=42) -> DataFrame:
    sizes = tags.groupBy("label").agg(F.count("*").alias("n"))
    return take(tags, ["label"], key, seed, negative_quota(sizes, ratio))


def balanced_set(seqs, key, ratio: float = V.TAG_POS_RATIO, cap: int = V.PER_LABEL_CAP, seed=42) -> DataFrame:
    """Tags at the wanted positive share, the other kinds capped per label: one pass over all kinds."""
    sizes = seqs.groupBy("kind", "label").agg(F.count("*").alias("n"))
    tag_quota = negative_quota(sizes.filter(F.col("kind") == "tag").select("label", "n"), ratio)
    quotas = tag_quota.select(F.lit("tag").alias("kind"), "label", "quota").unionByName(
        sizes.filter(F.col("kind") != "tag").select("kind", "label", F.lit(cap).cast("bigint").alias("quota")))
    return take(seqs, ["kind", "label"], key, seed, quotas)


def eval_quotas(sizes: DataFrame, max_items: int) -> DataFrame:
    """How many rows each (kind, label) gives to the evaluation sample.

    Every kind gets the same number, its labels an even share of it; what small labels leave open is taken
    from the largest leftover pools, label order breaking ties.
    """
    per_kind = max(1, max_items // len(V.DECISION_KINDS))
    by_kind = Window.partitionBy("kind")
    s = sizes.withColumn("share", F.greatest(F.lit(1), F.floor(F.lit(per_kind) / F.count("*").over(by_kind))))
    s = s.withColumn("base", F.least("n", "share")).withColumn("left", F.col("n") - F.col("base"))
    earlier = by_kind.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    larger = by_kind.orderBy(F.desc("left"), "label").rowsBetween(Window.unboundedPreceding, -1)
    open_rows = F.greatest(F.lit(0), F.lit(per_kind) - F.sum("base").over(by_kind) - F.coalesce(F.sum("left").over(larger), F.lit(0)))
    room = F.greatest(F.lit(0), F.lit(per_kind) - F.coalesce(F.sum("base").over(earlier), F.lit(0)))
    return s.select("kind", "label", (F.least("base", room) + F.least("left", open_rows)).cast("bigint").alias("quota"))


def stratified_eval_sample(preds, key, max_items: int = 600, seed=123) -> DataFrame:
    sizes = preds.groupBy("kind", "label").agg(F.count("*").alias("n"))
    return take(preds, ["kind", "label"], key, seed, eval_quotas(sizes, max_items))


def equal_shards(df, key, shards: int, seed=1234, drop_remainder: bool = False) -> DataFrame:
    """Shuffled shards whose sizes differ by one row at most; drop_remainder leaves rows out so that all are equal, for
    workers that must take the same number of steps."""
    if not drop_remainder:
        r = hash_rank(df, [], key, seed)
        return r.withColumn("shard", F.floor((F.col("rank") - 1) * shards / F.col("group_rows")).cast("bigint")).drop("rank", "group_rows")
    per = F.floor(F.col("group_rows") / shards)
    r = hash_rank(df, [], key, seed).withColumn("shard", F.floor((F.col("rank") - 1) / per).cast("bigint"))
    return r.filter((per > 0) & (F.col("shard") < shards)).drop("rank", "group_rows")


def group_split(df, val_pct: int = 15, salt: str = "split") -> DataFrame:
    """Split by article, so one article is never on both sides."""
    b = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), "correlation_id")), 1, 8), 16, 10).cast("bigint") % 100
    return df.withColumn("split", F.when(b < val_pct, "val").otherwise("train"))


def row_split(df, key, share: float = 0.15, seed=42) -> DataFrame:
    """Older split by row, kept only to show its leakage."""
    n_val = F.greatest(F.lit(10), F.floor(F.col("group_rows") * share))
    r = hash_rank(df, [], key, seed)
    return r.withColumn("split", F.when(F.col("rank") <= n_val, "val").otherwise("train")).drop("rank", "group_rows")


def stratified_benchmark(df, strata: list[str], key, per_stratum: int, seed=7) -> DataFrame:
    return take(df, strata, key, seed, n=per_stratum)


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)
