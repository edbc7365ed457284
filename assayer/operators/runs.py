"""Run records, summaries, status and progress."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.functions.labels import pct, rounded
from assayer.operators.store import Store


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asks the file system that owns the path, so any shared store works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def reuse_or_ingest(spark, path: str, ingest) -> DataFrame:
    """Existing bronze is read as it is; only a missing one is built."""
    if not path_exists(spark, path):
        ingest().write.parquet(path)
    return spark.read.parquet(path)


def write_config_lines(payloads: DataFrame, path: str) -> None:
    """Config payloads, one JSON document per line, in at most 256 folders whatever the number of configs."""
    group = F.substring(F.md5("config_id"), 1, 2)
    payloads.select("payload", group.alias("config_group")).write.mode("overwrite").partitionBy("config_group").text(path)


def read_config_lines(spark, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("payload"), F.get_json_object("value", "$.metadata.config_id").alias("config_id"))


def skip_unresolvable(work: DataFrame, configs: DataFrame) -> DataFrame:
    """Work whose configuration cannot be resolved becomes a skipped record with a reason."""
    known = configs.select("config_id").distinct().withColumn("_known", F.lit(True))
    out = work.join(known, "config_id", "left")
    return out.withColumn("status", F.when(F.col("_known"), "ok").otherwise("skipped")).withColumn(
        "reason", F.when(F.col("_known").isNull(), "no published configuration")).drop("_known")


def record_store(spark: SparkSession, path: str, schema, key: list[str]) -> Store:
    """Records of runs: each run is a part of its own; a record written again under its key replaces the one before."""
    return Store(spark, path, schema, key, ["run_id"])


def write_records(records: DataFrame, path: str, key: list[str]) -> Store:
    """Records of every outcome, one for each (run, key), whatever the number of attempts that write them."""
    store = record_store(records.sparkSession, path, records.schema, key)
    store.put(records)
    return store


RUN_SUMS = ("base_duration_ms", "cand_duration_ms", "base_cost_usd", "cand_cost_usd", "base_class_cost_usd")


def run_totals(perf: DataFrame, keys: list[str]) -> DataFrame:
    return perf.groupBy(*keys).agg(F.count("*").alias("articles"), *[F.sum(c).alias(f"sum_{c}") for c in RUN_SUMS])


def run_latency(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Average latency of both sides and the speed-up of the averages; 1.0 without a baseline time."""
    n = F.greatest("articles", F.lit(1))
    t = totals.withColumn("avg_base_ms", rounded(F.col("sum_base_duration_ms") / n, 2)).withColumn(
        "avg_cand_ms", rounded(F.col("sum_cand_duration_ms") / n, 2))
    speed = F.when(F.col("avg_base_ms") > 0, rounded(F.col("avg_base_ms") / F.greatest("avg_cand_ms", F.lit(1.0)), 2)).otherwise(1.0)
    return t.select(*keys, "articles", "avg_base_ms", "avg_cand_ms", speed.alias("speedup"))


def run_cost(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Totals, savings and multiples, for the whole call and for its classification part."""
    b, c, k = F.col("sum_base_cost_usd"), F.col("sum_cand_cost_usd"), F.col("sum_base_class_cost_usd")
    saved = lambda x: F.when(x > 0, rounded((x - c) / F.greatest(x, F.lit(0.00001)) * 100.0, 1)).otherwise(0.0)
    return totals.select(
        *keys, rounded(b, 6).alias("base_cost_usd"), rounded(k, 6).alias("base_class_cost_usd"), rounded(c, 6).alias("cand_cost_usd"),
        rounded(b - c, 6).alias("savings_usd"), saved(b).alias("savings_pct"), F.when(c > 0, rounded(F.try_divide(b, c), 1)).alias("cost_multiple"),
        saved(k).alias("class_savings_pct"), F.when(c > 0, rounded(k / F.greatest(c, F.lit(0.00000001)), 1)).alias("class_cost_multiple"))


def run_record(records: DataFrame) -> DataFrame:
    """The summary of each run and of each configuration in it: counts, latency, costs and savings in one row.

    records: run_id, config_id, status and the columns of RUN_SUMS; latency and costs are those of its `ok` rows.
    Rows are summed per (run, configuration) once; the run's row adds up those sums.  Sums are decimal, so a total on
    the edge of two rounded values is the same in any order of rows.
    """
    s = F.col("status")
    part = records.groupBy("run_id", "config_id").agg(
        F.count("*").alias("records"), F.count_if(s == "ok").alias("articles"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "skipped").alias("skipped"),
        *[F.sum(F.when(s == "ok", F.col(c)).otherwise(0.0).cast("decimal(28,12)")).alias(f"sum_{c}") for c in RUN_SUMS])
    counts, sums = ["records", "articles", "failed", "skipped"], [f"sum_{c}" for c in RUN_SUMS]
    every = part.groupingSets([["run_id", "config_id"], ["run_id"]], "run_id", "config_id").agg(
        F.when(F.grouping("config_id") == 1, "run").otherwise("config").alias("scope"), *[F.sum(c).alias(c) for c in counts], *[F.sum(c).cast("double").alias(c) for c in sums])
    keys = ["run_id", "config_id", "scope", "records", "failed", "skipped"]
    latency = run_latency(every, keys + sums)
    return run_cost(latency, [*keys, "articles", "avg_base_ms", "avg_cand_ms", "speedup"])


def run_counts(records: DataFrame, keys: list[str]) -> DataFrame:
    s = F.col("status")
    g = records.groupBy(*keys).agg(F.count("*").alias("records"), F.count_if(s == "ok").alias("total_articles"),
                                   F.count_if(s == "failed").alias("failed"), F.count_if(s == "skipped").alias("skipped"))
    return g.withColumn("evaluated", F.col("total_articles") > 0)


def optimizer_summary(records: DataFrame, keys: list[str]) -> DataFrame:
    """Rewrite telemetry, once per cache key: the last record of a key counts."""
    last = records.filter(F.col("cache_key").isNotNull()).groupBy(*keys, "cache_key").agg(
        F.max_by(F.struct("cost_usd", "duration_ms", "chars_before", "chars_after"), "pos").alias("r"))
    g = last.groupBy(*keys).agg(
        F.count("*").alias("configs_compiled"), F.sum("r.cost_usd").alias("c"), F.sum("r.duration_ms").alias("d"),
        F.sum("r.chars_before").alias("chars_before"), F.sum("r.chars_after").alias("chars_after"))
    return g.select(*keys, "configs_compiled", rounded(F.col("c"), 6).alias("cost_usd"), rounded(F.col("d"), 2).alias("duration_ms"),
                    "chars_before", "chars_after", pct(F.col("chars_before") - F.col("chars_after"), F.col("chars_before")).alias("reduction_pct"))


def progress_by_config(work: DataFrame, records: DataFrame) -> DataFrame:
    """Done and total work items per run and configuration; both sides are counted before they meet."""
    keys = ["run_id", "config_id"]
    total = work.groupBy(*keys).agg(F.count("*").alias("total"))
    done = records.filter(F.col("status") == "ok").groupBy(*keys).agg(F.count_distinct("article_no").alias("done"))
    return total.join(done, keys, "left").withColumn("done", F.coalesce("done", F.lit(0)))


def run_status(events: DataFrame) -> DataFrame:
    """Lifecycle from append-only events: the last status and the times of creation and completion."""
    return events.groupBy("run_id").agg(
        F.min("ts").alias("created_at"), F.max_by("status", F.struct("ts", "seq")).alias("status"),
        F.max(F.when(F.col("status") == "completed", F.col("ts"))).alias("completed_at"))


def list_runs(meta: DataFrame, summaries: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs by id, newest first, with their summary where there is one; runs with neither are not listed."""
    runs = meta.join(summaries, "run_id", "full_outer").orderBy(F.desc("run_id"))
    return runs if limit is None else runs.limit(limit)


def get_run(records: DataFrame, run_id: str) -> DataFrame:
    """Records of one run; on the partitioned table only that folder is read."""
    return records.filter(F.col("run_id") == run_id)


def prune_runs(store: Store, drop: DataFrame, active: DataFrame) -> None:
    """Delete the runs of `drop` from the store; a run still executing is never deleted."""
    gone = drop.select("run_id").distinct().join(active.select("run_id"), "run_id", "left_anti")
    store.drop([r.part for r in gone.select(store.part_of(F.col("run_id")).alias("part")).collect()])  # one short name for each run
