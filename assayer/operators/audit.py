"""Audit log and article listing."""

from pyspark.sql import DataFrame, Window, functions as F

from assayer import fixed_values as V
from assayer.functions.text import first_filled
from assayer.operators.ranking import numbered

KEY = ["config_id", "correlation_id"]


def latest_per_key(log: DataFrame, keys=KEY, order=("created_at", "id")) -> DataFrame:
    """Newest row per key as an aggregate: copies are combined before the shuffle, so hot keys stay small."""
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return log.groupBy(*keys).agg(newest).select(*keys, "r.*")


def recent_articles(log: DataFrame, limit: int = 100, offset: int = 0, scan: int | None = None) -> DataFrame:
    """A page of the newest articles; with `scan` only that many of the newest log rows are looked at."""
    newest_first = [F.desc("created_at"), F.desc("id")]
    rows = log if scan is None else log.orderBy(*newest_first).limit(scan)
    return latest_per_key(rows).orderBy(*newest_first).offset(offset).limit(limit)


def config_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("config_id").agg(
        F.count_distinct("correlation_id").alias("n_articles"), F.max("created_at").alias("last_processed_at"))


def blob_config_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy(first_filled(F.col("config_id"), default="unknown").alias("config_id")).agg(
        F.count("*").alias("n"))


def latest_config(log: DataFrame) -> DataFrame:
    return log.agg(F.max_by("config_id", F.struct("created_at", "id")).alias("config_id"))


def newest_per_config(log: DataFrame, config_ids: DataFrame, n: int = V.BATCH_ARTICLES_PER_CONFIG) -> DataFrame:
    """Newest n articles of each selected config with their rank (a per-task top-n runs before the shuffle)."""
    chosen = latest_per_key(log.join(config_ids.select("config_id", "config_pos"), "config_id"))
    w = Window.partitionBy("config_id").orderBy(F.desc("created_at"), F.desc("id"))
    return chosen.withColumn("rank_in_config", F.row_number().over(w)).filter(F.col("rank_in_config") <= n)


def selection_counts(selected: DataFrame, config_ids: DataFrame, n: int = V.BATCH_ARTICLES_PER_CONFIG) -> DataFrame:
    got = selected.groupBy("config_id").agg(F.count("*").alias("selected"))
    return config_ids.join(got, "config_id", "left").select(
        "config_id", F.lit(n).cast("bigint").alias("requested"), F.coalesce("selected", F.lit(0)).alias("selected"))


def round_robin(selected: DataFrame) -> DataFrame:
    """The ordered work list: the first article of each config in turn, then the second of each; `position` counts from 1."""
    return numbered(selected, [F.col("rank_in_config"), F.col("config_pos")])


def ordered_distinct(df: DataFrame, value: str, pos: str) -> DataFrame:
    from assayer.functions.text import strip
    v = df.select(strip(F.col(value)).alias(value), pos).filter(F.col(value) != "")
    return v.groupBy(value).agg(F.min(pos).alias(pos))


def list_blobs(index: DataFrame, limit: int = 50, prefix: str = "", config_id: str | None = None) -> DataFrame:
    rows = index.filter(F.col("name").startswith(prefix)) if prefix else index
    rows = rows.filter(F.col("config_id") == config_id) if config_id else rows
    return rows.orderBy(F.desc_nulls_last("processed_at"), "name").limit(limit)


def blob_name(correlation_id, suffix: str):
    return F.concat(correlation_id, F.lit(f"{suffix}.json"))


def blob_key(name, suffix: str):
    """Inverse of blob_name."""
    import re
    return F.regexp_replace(name, f"({re.escape(suffix)})?\\.json$", "")


def listed_key(name):
    """Key shown for a listed name: the text before the first underscore."""
    return F.when(name.contains("_"), F.substring_index(name, "_", 1)).otherwise(F.replace(name, F.lit(".json"), F.lit("")))


def classification_only(names: DataFrame) -> DataFrame:
    n = F.col("name")
    return names.filter(n.endswith(".json") & ~n.startswith("validation-failure/") & ~n.startswith("delivery-audit/"))


def uncached_remote(remote: DataFrame, index: DataFrame, limit: int | None = None) -> DataFrame:
    """Listed names not yet indexed; with `limit` the first ones by name."""
    missing = classification_only(remote).join(index.select("name"), "name", "left_anti")
    return missing if limit is None else missing.orderBy("name").limit(limit)


def fetch_by_ids(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    return blobs.join(wanted.select("correlation_id").distinct(), "correlation_id", "left_semi")


def dedupe_reprocessed(incoming: DataFrame, done: DataFrame) -> DataFrame:
    """Skip what was already processed unless it is forced; a forced row passes without the lookup."""
    forced = F.coalesce(F.col("force_reprocess"), F.lit(False))
    fresh = incoming.filter(~forced).join(done.select(*KEY).distinct(), KEY, "left_anti")
    return fresh.unionByName(incoming.filter(forced))


def search(df: DataFrame, text: str, *cols: str) -> DataFrame:
    """Case-insensitive contains over several columns; a blank search keeps everything."""
    if not text.strip():
        return df
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text.lower())
    return df.filter(hit)
