"""Archived records: ingest, parsing and the long forms of their nested parts."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer import schemas
from assayer.functions import labels as L, text as X

CORRUPT = "_corrupt_record"


def stream_files(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Whole JSON files as they arrive, with path and modification time."""
    reader = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select(
        F.col("value").alias("payload"), F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_modification_time").alias("ingested_at"))


def config_files(spark: SparkSession, folder: str) -> DataFrame:
    """Config files in one batch read; the id is the file name."""
    raw = spark.read.format("text").option("wholetext", True).load(f"{folder.rstrip('/')}/*.json")
    return raw.select(F.col("value").alias("payload"),
                      F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("config_id"))


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A config or audit table read in parallel ranges of its numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def parse(raw: DataFrame) -> DataFrame:
    """Payload text to columns with a fixed schema; text that does not parse stays in one extra column."""
    schema = schemas.BLOB + f", {CORRUPT} STRING"
    blob = F.from_json("payload", schema, {"columnNameOfCorruptRecord": CORRUPT})
    return raw.select(*raw.columns, F.inline(F.array(blob)))  # a generator, so the text is parsed once per row


def parse_blobs(raw: DataFrame) -> DataFrame:
    return parse(raw).filter(F.col(CORRUPT).isNull() & F.col("payload").isNotNull()).drop(CORRUPT)


def quarantine(raw: DataFrame) -> DataFrame:
    return parse(raw).filter(F.col(CORRUPT).isNotNull()).select(*raw.columns)


def inbound(blobs: DataFrame, *also) -> DataFrame:
    """Article text fields, the inbound part first, next to further columns."""
    i = "inbound_data."
    return blobs.select(
        "correlation_id", "config_id", *also,
        X.first_filled(F.col(i + "headline"), F.col("headline")).alias("headline"),
        X.first_filled(F.col(i + "body"), F.col("body")).alias("body"),
        X.first_filled(F.col(i + "media_type"), F.col("media_type"), default="article").alias("media_type"))


def subject_results(blobs: DataFrame) -> DataFrame:
    return blobs.select("correlation_id", "config_id", F.inline(L.last_wins(F.col("subject_results"), "subject_id"))).select(
        "correlation_id", "config_id", "subject_id", "name", F.coalesce("is_valid", F.lit(False)).alias("is_valid"),
        F.lower("prominence").alias("prominence"), F.lower("sentiment").alias("sentiment"))


def llm_tags(blobs: DataFrame) -> DataFrame:
    """Tags judged by the model over all groups, the last one of an id."""
    every = F.flatten(F.transform(F.col("scored_attributes.tag_groups"), lambda g: g.tags))
    kept = L.last_wins(F.filter(every, lambda t: t.evaluation_type == "llm"), "tag_id")
    return blobs.select("correlation_id", "config_id", F.inline(kept)).select(
        "correlation_id", "config_id", "tag_id", F.coalesce("result", F.lit(False)).alias("result"))


def llm_stage_duration(blobs: DataFrame) -> DataFrame:
    first = F.get(F.filter("stage_timings", lambda s: F.lower(s.stage).contains("llm")), F.lit(0))
    return blobs.select("correlation_id", F.coalesce(first.duration_ms, F.lit(0.0)).alias("llm_duration_ms"))


def parsed_reply() -> Column:
    return F.try_parse_json(X.filled(X.strip(F.col("llm_raw_response"))))


def raw_response(blobs: DataFrame) -> DataFrame:
    """Second parse of the stored model reply: the parsed value, or the text itself where it does not parse."""
    return blobs.select(
        "correlation_id", parsed_reply().isNotNull().alias("is_json"),
        F.coalesce(F.to_json(parsed_reply()), F.col("llm_raw_response")).alias("raw_response"))


def index_entries(blobs: DataFrame) -> DataFrame:
    """Metadata projection for the article picker."""
    i = "inbound_data."
    return blobs.select(
        "name", X.first_filled(F.col("correlation_id"), F.replace(F.col("name"), F.lit(".json"), F.lit(""))).alias("correlation_id"),
        X.first_filled(F.col(i + "headline"), F.col("headline"), default="Untitled").alias("headline"), "config_id",
        X.first_filled(F.col(i + "media_type"), F.col("media_type"), default="article").alias("media_type"),
        "processed_at", F.lit(True).alias("cached"))


def preview(blobs: DataFrame, chars: int) -> DataFrame:
    """Opening of the full article state and the number of archived subject results."""
    none = F.lit(None).cast("string")
    n_subjects = F.greatest(F.coalesce(F.size("subject_results"), F.lit(0)), F.lit(0))
    t = inbound(blobs, n_subjects.alias("n_subjects"))
    t = t.withColumn("state", X.full_state(F.col("headline"), F.col("body"), F.col("media_type"), none, none))
    cut = F.concat(F.left("state", F.lit(chars)), F.lit("..."))
    return t.select("correlation_id", "n_subjects",
                    F.when(F.length("state") > chars, cut).otherwise(F.col("state")).alias("preview"))


def baseline_view(blobs: DataFrame) -> DataFrame:
    """Normalised nested view of the archived decision."""
    return blobs.select(
        "correlation_id", "validation_result", "rejection_reason", "summary",
        F.transform("subject_results", lambda s: F.struct(
            s.subject_id.alias("subject_id"), s["name"].alias("name"), s.is_valid.alias("is_valid"),
            s.prominence.alias("prominence"), s.sentiment.alias("sentiment"), s.tags.alias("tags"))).alias("subjects"),
        F.col("scored_attributes.tag_groups").alias("tag_groups"), F.coalesce(F.to_json(parsed_reply()), F.col("llm_raw_response")).alias("raw_response"))


def answers_long(replies: DataFrame) -> DataFrame:
    """Reply text to long answers; the envelope may be bare, wrapped, a list of one, or JSON text in a string."""
    r = F.trim("reply")
    inner = F.coalesce(F.get_json_object(r, "$.predictions"), r)
    first = F.when(F.trim(inner).startswith("["), F.get_json_object(inner, "$[0]")).otherwise(inner)
    env = F.from_json(first, schemas.ENVELOPE)
    return replies.select("correlation_id", env.alias("e")).select(
        "correlation_id", F.explode("e.answers").alias("qid", "a")).select(
        "correlation_id", "qid", "a.type", "a.noul", "a.choice", "a.score", "a.probabilities", "a.confidence")
