"""Config store: published and historical versions, effective tags, snapshot parts."""

from pyspark.sql import DataFrame, functions as F

from assayer import schemas
from assayer.functions.text import filled, strip

META = ["numeric_config_id", "config_id", "config_name", "version_number", "published_at"]


def _newest(rows: DataFrame, keys, extra=()) -> DataFrame:
    """Highest version per key, combined before the shuffle."""
    keep = [c for c in [*META, *extra] if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*keep), "version_number").alias("r")).select(*keys, "r.*")


def newest_versions(versions: DataFrame) -> DataFrame:
    """Highest version per configuration; done before any join, so a config with many versions costs one row."""
    rest = [c for c in versions.columns if c != "configuration_id"]
    return versions.groupBy("configuration_id").agg(
        F.max_by(F.struct(*rest), "version_number").alias("r")).select("configuration_id", "r.*")


def is_published():
    pending = (F.col("status") == "pending_changes") & (F.coalesce("previous_status", F.lit("active")) == "active")
    return ((F.col("status") == "active") | pending) & ~F.col("is_archived")


def _with_versions(configurations, versions):
    v = newest_versions(versions)
    c = configurations.withColumnRenamed("name", "config_name").withColumnRenamed("identifier", "config_id")
    return c.join(v, c.id == v.configuration_id).withColumnRenamed("id", "numeric_config_id")


def published_config(configurations: DataFrame, versions: DataFrame) -> DataFrame:
    return _with_versions(configurations.filter(is_published()), versions).select(*META)


def published_config_by_tracker(configurations, versions, trackers) -> DataFrame:
    """Newest published version among the configurations of each tracker."""
    p = published_config(configurations, versions)
    t = trackers.join(p, trackers.configuration_id == p.numeric_config_id)
    return _newest(t.select("tracker_id", *META), ["tracker_id"])


def config_with_fallback(configurations, versions) -> DataFrame:
    """Published version, else the newest of any status, told apart by `origin`."""
    rows = _with_versions(configurations, versions)
    return rows.select(*META, F.when(is_published(), "published").otherwise("historical_snapshot").alias("origin"))


def available_configs(configurations, versions) -> DataFrame:
    return _with_versions(configurations.filter(~F.col("is_archived")), versions).select(*META)


def effective_tags(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Base tag definition overridden per subject; only remotely active tags."""
    b = base.filter(F.col("remote_status") == "active").drop("remote_status")
    o = overrides.select("configuration_id", "tag_evaluation_id", "subject_id",
                         *[F.col(c).alias(f"o_{c}") for c in ("evaluation_type", "prompt_text", "boolean_expression")])
    j = b.join(o, ["configuration_id", "tag_evaluation_id"])
    return j.select(
        "configuration_id", F.col("subject_id").cast("string").alias("subject_id"), "tag_id", "tag_name",
        *[F.coalesce(f"o_{c}", c).alias(c) for c in ("evaluation_type", "prompt_text", "boolean_expression")],
    ).distinct()


def draft_snapshot(subjects: DataFrame, tags: DataFrame, rules: DataFrame) -> DataFrame:
    """Nest live tables to one snapshot row per configuration; groups are one configuration's own parts."""
    t = tags.groupBy("config_id", "subject_id").agg(F.array_sort(F.collect_list(F.struct(
        "tag_pos", "tag_id", "tag_name", "evaluation_type", "prompt_text"))).alias("tag_evaluations"))
    s = subjects.join(t, ["config_id", "subject_id"], "left").groupBy("config_id").agg(F.array_sort(F.collect_list(F.struct(
        "sort_order", "subject_id", "name", "validation_prompt", "tag_evaluations"))).alias("subjects"))
    r = rules.groupBy("config_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "rule_id", "action"))).alias("rules"))
    return s.join(r, "config_id", "left")


def snapshot_unwrap(raw: DataFrame) -> DataFrame:
    """`snapshot` or `snapshot_data`, as object or as JSON text inside a string; malformed or empty rows drop out."""
    inner = F.coalesce(filled(F.get_json_object("payload", "$.snapshot")), filled(F.get_json_object("payload", "$.snapshot_data")))
    parsed = F.from_json(inner, schemas.SNAPSHOT)
    return raw.withColumn("snapshot", parsed).filter(F.col("snapshot.subjects").isNotNull() | F.col("snapshot.configuration").isNotNull())


def subject_rows(snapshots: DataFrame) -> DataFrame:
    """Subjects in stored order; a subject without a name is called after its id."""
    s = snapshots.select("config_id", F.posexplode("snapshot.subjects").alias("pos", "s"))
    name = F.coalesce(filled(F.col("s.name")), F.concat(F.lit("Subject "), F.col("s.id")))
    return s.select("config_id", "pos", F.col("s.id").alias("subject_id"), name.alias("name"),
                    "s.entity_definition", "s.validation_prompt", "s.prominence_prompt", "s.sentiment_prompt", "s.tag_evaluations")


def llm_tag_rows(subjects: DataFrame) -> DataFrame:
    """Tags judged by the model, in stored order; the tag id stands in for a missing name."""
    t = subjects.select("config_id", "pos", "subject_id", "name", F.posexplode("tag_evaluations").alias("tag_pos", "t"))
    keep = (F.col("t.evaluation_type") == "llm") & filled(F.col("t.prompt_text")).isNotNull()
    return t.filter(keep).select(
        "config_id", "pos", "subject_id", "name", "tag_pos", "t.tag_id",
        F.coalesce(filled(F.col("t.tag_name")), F.col("t.tag_id")).alias("tag_name"), "t.prompt_text")


def config_lint(tags: DataFrame) -> DataFrame:
    """Tags with an unexpected type, or without the definition their type needs."""
    kind = F.col("evaluation_type")
    definition = F.when(kind == "llm", F.col("prompt_text")).otherwise(F.col("boolean_expression"))
    violation = (
        F.when(F.coalesce(~kind.isin("llm", "boolean"), F.lit(True)), "unexpected_evaluation_type")
        .when(filled(definition).isNull(), "missing_definition")
    )
    return tags.select("config_id", "subject_id", "tag_id", "evaluation_type", violation.alias("violation")).filter(
        F.col("violation").isNotNull())


def system_prompt(subjects: DataFrame, tags: DataFrame, summaries: DataFrame) -> DataFrame:
    """Ordered prompt text per config with its hash; tags by first-met group, not de-duplicated."""
    from pyspark.sql import Window
    from assayer import fixed_values as V
    from assayer.functions.text import sanitize_heading

    def line(label, col):
        v = sanitize_heading(F.col(col))
        return F.when(v != "", F.concat(F.lit(f"\n{label}: "), v)).otherwise("")

    block = F.concat(
        F.lit("### Subject: "), F.col("subject_id").cast("string"), F.lit(" — "), sanitize_heading(F.col("name")),
        line("Definition", "entity_definition"), line("Validation", "validation_prompt"),
        line("Sentiment", "sentiment_prompt"), line("Prominence", "prominence_prompt"))
    joined = lambda items: F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda x: x.text), "\n\n")
    s = subjects.groupBy("config_id").agg(joined(F.struct("pos", block.alias("text"))).alias("subject_text"))
    t = tags.filter((F.col("evaluation_type") == "llm") & filled(F.col("prompt_text")).isNotNull())
    first = F.min(F.struct("pos", "tag_pos")).over(Window.partitionBy("config_id", "tag_group_name"))
    tag_block = F.concat(F.lit("### Tag: "), F.col("tag_id"), F.lit(" — "), sanitize_heading(F.col("tag_name")),
                         F.lit("\nCriteria: "), sanitize_heading(F.col("prompt_text")))
    t = t.withColumn("group_first", first).groupBy("config_id").agg(
        joined(F.struct("group_first", "pos", "tag_pos", tag_block.alias("text"))).alias("tag_text"))
    head = F.lit("\n\n".join([V.PROMPT_ROLE, V.PROMPT_MEDIA, V.PROMPT_RULES]))

    def section(title, col):
        v = sanitize_heading(F.col(col))
        return F.when(v != "", F.concat(F.lit("\n\n" + title), v)).otherwise("")

    text = F.concat(
        head, section(V.PROMPT_SUMMARY, "prompt_text"), section(V.PROMPT_REJECTION, "rejected_prompt_text"),
        F.lit("\n\n" + V.PROMPT_SUBJECTS + "\n"), F.col("subject_text"),
        F.when(F.col("tag_text").isNotNull(), F.concat(F.lit("\n\n" + V.PROMPT_TAGS + "\n\n"), F.col("tag_text"))).otherwise(""))
    out = s.join(t, "config_id", "left").join(summaries, "config_id", "left")
    return out.select("config_id", text.alias("prompt")).withColumn("prompt_hash", F.sha2("prompt", 256))
