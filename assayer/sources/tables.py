"""The benchmark domain expressed over the given tables.

Each method is one lazily built view: articles, archived decisions, candidate answers, audit log, config
store, timings, usage and logits.  Literal lists are attached with explode(), so no view is a cross join.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer import fixed_values as V
from assayer.operators.joins import once, spread

SUBJECTS = ((1, "Thon Corp"), (2, "Inoran (THTH)"), (3, "Hehely-Ther"), (4, "Thin All"))
TAGS = (("toxic", "Toxic partner", "llm"), ("long", "Developer notes", "llm"), ("kw", "Keyword", "boolean"))


def bucket(c: Column) -> Column:
    """Portable bucket 0..99 of a text: the first 32 bits of its md5."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint") % 100


def keyed(prefix: str, *cols: Column) -> Column:
    return bucket(F.concat_ws("|", F.lit(prefix), *cols))


def pick(b: Column, labels) -> Column:
    out = F.lit(labels[-1])
    for i in range(len(labels) - 2, -1, -1):
        out = F.when(b % len(labels) == i, labels[i]).otherwise(out)
    return out


def subject_array() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("subject_id"), F.lit(n).alias("name")) for i, n in SUBJECTS])


def policy_config() -> Column:
    """Eight subjects make one policy configuration, so a configuration never grows with the data."""
    return F.concat(F.lit("p"), F.expr("p_partkey div 8").cast("string"))


class Domain:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._tables = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._tables[name]

    def _articles(self, documents: DataFrame) -> DataFrame:
        head = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
        return documents.select(
            F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("correlation_id"), "doc_id",
            F.col("source").alias("config_id"), F.col("lang").alias("language"),
            F.when(F.col("doc_id") % 10 == 0, "radio").when(F.col("doc_id") % 10 == 1, "television")
            .otherwise("online").alias("media_type"),
            head.alias("headline"),
            F.col("text").substr(F.length(head) + 2, F.length("text")).alias("body"), "n_chars",
        )

    @cached_property
    def articles(self) -> DataFrame:
        return self._articles(self.table("documents"))

    @cached_property
    def articles_spread(self) -> DataFrame:
        """The same rows with enough tasks for text work."""
        return self._articles(spread(self.table("documents")))

    @cached_property
    def config_ids(self) -> DataFrame:
        return self.table("documents").select(F.col("source").alias("config_id")).distinct()

    @cached_property
    def config_subjects(self) -> DataFrame:
        return self.config_ids.select("config_id", F.inline(subject_array()))

    @cached_property
    def config_tags(self) -> DataFrame:
        tags = F.array(*[F.struct(F.lit(t).alias("tag_id"), F.lit(n).alias("tag_name"), F.lit(e).alias("evaluation_type"))
                         for t, n, e in TAGS])
        return self.config_subjects.select("config_id", "subject_id", F.inline(tags))

    @cached_property
    def baseline_subjects(self) -> DataFrame:
        s = self.table("labels").select("doc_id", "quality", F.inline(subject_array()))
        return s.select(
            F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("correlation_id"), "subject_id",
            F.when(F.col("subject_id") == 1, F.col("quality") == 1)
            .otherwise(keyed("bv", F.col("subject_id"), F.col("doc_id")) < 60).alias("is_valid"),
            pick(keyed("bp", F.col("subject_id"), F.col("doc_id")), V.PROMINENCE_LABELS).alias("prominence"),
            pick(keyed("bs", F.col("subject_id"), F.col("doc_id")), V.SENTIMENT_LABELS).alias("sentiment"),
        )

    @cached_property
    def baseline_tags(self) -> DataFrame:
        return self.table("labels").select(
            F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("correlation_id"),
            F.lit("toxic").alias("tag_id"), (F.col("toxic") == 1).alias("result"))

    @cached_property
    def answers(self) -> DataFrame:
        """Candidate answers, one row per article and subject."""
        a = self.table("documents").select("doc_id", F.col("source").alias("config_id"), F.inline(subject_array()))
        d, s = F.col("doc_id"), F.col("subject_id")
        return a.select(
            F.concat(F.lit("c"), d.cast("string")).alias("correlation_id"), "config_id", "subject_id",
            (keyed("cv", s, d).cast("double") / 100).alias("p_valid"),
            pick(keyed("cp", s, d), V.PROMINENCE_LABELS).alias("prominence"),
            pick(keyed("cs", s, d), V.SENTIMENT_LABELS).alias("sentiment"),
            (keyed("ct", s, d).cast("double") / 100).alias("p_toxic"),
        )

    @cached_property
    def audit_log(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("config_id"),
            F.concat(F.lit("c"), F.get_json_object("props", "$.k")).alias("correlation_id"),
            F.when(F.col("user_id") % 2 == 0, "kafka").otherwise("http").alias("processing_source"),
            F.when(F.col("value") < 1, "failed").otherwise("completed").alias("status"))

    @cached_property
    def configurations(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("id"), F.col("c_name").alias("identifier"), F.concat(F.lit("Config "), "c_mktsegment").alias("name"),
            F.when(k % 5 == 0, "draft").when(k % 5 == 1, "pending_changes").otherwise("active").alias("status"),
            F.when(k % 3 == 0, "active").when(k % 3 == 1, "draft").alias("previous_status"),
            (k % 11 == 0).alias("is_archived"))

    @cached_property
    def versions(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("configuration_id"), F.col("o_orderkey").alias("version_number"),
            F.col("o_orderdate").alias("published_at"))

    @cached_property
    def trackers(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("tracker_id"), (F.col("s_suppkey") * 7).alias("configuration_id"))

    @cached_property
    def stage_timings(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("article_no"), F.col("l_linenumber").alias("pos"),
            F.when(F.col("l_returnflag") == "A", "DedupStage").when(F.col("l_returnflag") == "N", "LLMProcessingStage")
            .otherwise("RulesStage").alias("stage"), (F.col("l_quantity") * 100).alias("duration_ms"))

    @cached_property
    def usage(self) -> DataFrame:
        """Run records: one row per article of a run, with tokens, recorded cost and status."""
        k, p = F.col("o_orderkey"), F.col("o_totalprice")
        return self.table("orders").select(
            k.alias("article_no"), F.col("o_orderpriority").alias("run_id"),
            F.concat(F.lit("cfg"), (F.col("o_custkey") % 20).cast("string")).alias("config_id"),
            F.when(k % 10 == 0, p / 1e7).alias("base_cost_recorded"),
            F.floor(p / 100).cast("bigint").alias("input_tokens"), (k % 500).cast("bigint").alias("output_tokens"),
            (k % 40).cast("bigint").alias("cached_tokens"),
            ((k % 4000) * 1.5).alias("base_duration_ms"), ((k % 300) * 0.5).alias("cand_duration_ms"),
            F.floor(p / 300).cast("bigint").alias("cand_input_tokens"),
            F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "skipped")
            .otherwise("ok").alias("status"),
            F.concat_ws("|", F.lit("key"), (k % 97).cast("string")).alias("cache_key"),
            F.col("o_orderdate").alias("recorded_at"))

    @cached_property
    def predictions(self) -> DataFrame:
        e = self.table("embeddings")
        kind = pick(F.col("vec_id"), V.DECISION_KINDS)
        k = F.when(F.col("vec_id") % 4 == 1, 3).when(F.col("vec_id") % 4 == 2, 4).otherwise(2)
        return e.select("vec_id", kind.alias("kind"), k.alias("k"), (F.col("label") % k).cast("int").alias("label"),
                        F.transform(F.slice("embedding", F.lit(1), k), lambda x: x.cast("double")).alias("logits"))

    # --- policy side: subjects and tags of the config store, from part ---------------------------------

    @cached_property
    def parts(self) -> DataFrame:
        """The part table with enough tasks for text work: its rows are short, the policies and questions made of them are not."""
        return spread(self.table("part"))

    @cached_property
    def policy_subjects(self) -> DataFrame:
        n, k = F.col("p_name"), F.col("p_partkey")
        acronym = F.concat(n, F.lit(" ("), F.upper(F.left(n, F.lit(3))), F.lit(")"))
        name = (
            F.when(k % 8 == 0, F.concat(n, F.lit(" Corp"))).when(k % 8 == 1, acronym)
            .when(k % 8 == 2, F.replace(n, F.lit(" "), F.lit("-"))).when(k % 8 == 3, F.concat(n, F.lit(" All")))
            .when(k % 8 == 4, F.concat(n, F.lit(", Inc."))).when(k % 8 == 5, F.concat(n, F.lit(" (creamers)")))
            .when(k % 8 == 6, F.concat(F.lit(" "), n, F.lit(" – "))).otherwise(n)
        )
        policy = F.concat(
            F.lit("## Scope\nInclude only stories on '"), n, F.lit("'. "),
            F.when(k % 7 == 0, F.concat(F.lit("Exclude '"), n, F.lit("' when it is a passing note."))).otherwise(
                F.concat(F.lit("Exclude 'size "), F.col("p_size").cast("string"), F.lit("' notes unless over 10%."))),
            F.when(k % 11 == 0, "\nPlease specify the criteria.").otherwise(""),
        )
        return self.parts.select(
            policy_config().alias("config_id"), k.alias("subject_id"), (k % 8).cast("int").alias("pos"), name.alias("name"),
            F.concat(F.lit("# Entity\nMaker of "), n).alias("entity_definition"), policy.alias("validation_prompt"),
            F.when(k % 3 == 0, F.concat(F.lit("## Focus on "), n)).alias("prominence_prompt"),
            F.when(k % 3 == 1, F.concat(F.lit("### Tone of "), n)).alias("sentiment_prompt"),
            F.col("p_size").alias("sort_order"))

    @cached_property
    def policy_tags(self) -> DataFrame:
        k = F.col("p_partkey")
        first = F.struct(
            F.lit(0).alias("tag_pos"), F.concat(F.lit("a"), F.col("p_size").cast("string")).alias("tag_id"),
            F.when(k % 4 == 0, "Partner news").when(k % 4 == 1, "AI").when(k % 4 == 2, "Engineering").otherwise(F.col("p_type")).alias("tag_name"),
            F.lit("g1").alias("tag_group_id"), F.lit("Topics").alias("tag_group_name"),
            F.when(k % 9 == 0, "boolean").when(k % 31 == 5, "other").otherwise("llm").alias("evaluation_type"),
            F.when(k % 13 == 0, F.lit(None).cast("string"))
            .when(k % 5 == 0, F.lit('# Use the tag "Storage notes" when true.'))
            .otherwise(F.concat(F.lit("# True when the text is on "), F.col("p_type"), F.lit(" and $"),
                                F.col("p_size").cast("string"), F.lit(" goods."))).alias("prompt_text"),
            F.when(k % 9 == 0, F.concat(F.col("p_name"), F.lit(" AND NOT size"))).alias("boolean_expression"))
        second = F.struct(
            F.lit(1).alias("tag_pos"), F.concat(F.lit("b_"), F.col("p_type")).alias("tag_id"), F.lit("Storage notes").alias("tag_name"),
            F.lit("g2").alias("tag_group_id"), F.lit("Notes").alias("tag_group_name"), F.lit("llm").alias("evaluation_type"),
            F.when(k % 6 == 0, F.concat(F.lit("Only about "), F.col("p_type"))).otherwise("Storage notes of the maker").alias("prompt_text"),
            F.lit(None).cast("string").alias("boolean_expression"))
        return self.parts.select(policy_config().alias("config_id"), k.alias("subject_id"),
                                         (k % 8).cast("int").alias("pos"), F.inline(F.array(first, second)))

    # --- archived records as JSON text -------------------------------------------------------------------

    @cached_property
    def blob_rows(self) -> DataFrame:
        """One archived record per article, built in place from article and label columns (no regrouping)."""
        d = F.col("doc_id")
        labelled = F.col("quality").isNotNull()

        def subject(s):
            i = s.subject_id
            return F.struct(
                i.cast("string").alias("subject_id"), s["name"].alias("name"),
                F.when(i == 1, F.col("quality") == 1).otherwise(keyed("bv", i, d) < 60).alias("is_valid"),
                pick(keyed("bp", i, d), V.PROMINENCE_LABELS).alias("prominence"),
                pick(keyed("bs", i, d), V.SENTIMENT_LABELS).alias("sentiment"))

        def tag(tag_id, kind, result):
            return F.struct(F.lit(tag_id).alias("tag_id"), F.lit(tag_id).alias("name"), F.lit(kind).alias("evaluation_type"), result.alias("result"))

        toxic = F.col("toxic") == 1
        groups = F.array(
            F.struct(F.lit("g1").alias("group_id"), F.lit("Safety").alias("name"), F.array(tag("toxic", "llm", ~toxic), tag("kw", "boolean", toxic)).alias("tags")),
            F.struct(F.lit("g2").alias("group_id"), F.lit("Again").alias("name"), F.array(tag("toxic", "llm", toxic)).alias("tags")))
        a = self.articles_spread.join(self.table("labels"), "doc_id", "left")
        return a.select(
            "doc_id", "correlation_id", "config_id",
            F.when(d % 10 == 2, F.col("headline")).alias("headline"),
            F.when(labelled, F.transform(subject_array(), subject)).alias("subject_results"),
            F.when(labelled, F.struct(groups.alias("tag_groups"))).alias("scored_attributes"),
            F.struct(F.col("n_chars").alias("input"), (d % 300).alias("output")).alias("llm_tokens"),
            F.when(labelled, F.col("quality") == 1).alias("validation_result"), (d % 40).alias("llm_cached_tokens"),
            F.when(d % 10 == 0, F.col("n_chars") / 1e6).alias("llm_cost_usd"),
            F.when(d % 4 == 0, F.lit('{"subjects": [1], "note": "ok"}')).when(d % 4 == 1, F.lit("not json {")).alias("llm_raw_response"),
            F.array(F.struct(F.lit("DedupStage").alias("stage"), F.lit(3.0).alias("duration_ms")),
                    F.struct(F.when(d % 3 == 0, "LLMProcessingStage").when(d % 3 == 1, "llm_v2").otherwise("RulesStage").alias("stage"),
                             (F.col("n_chars") * 0.5).alias("duration_ms"))).alias("stage_timings"),
            F.struct(F.when(d % 10 != 2, F.col("headline")).alias("headline"), "body", F.when(d % 10 <= 1, F.col("media_type")).alias("media_type"),
                     "language").alias("inbound_data"))

    @cached_property
    def blobs(self) -> DataFrame:
        """Payload text per record; about one in twenty is cut short, as a broken upload would be."""
        json = F.to_json(F.struct(*[F.col(c) for c in self.blob_rows.columns if c != "doc_id"]))
        cut = keyed("cut", F.col("doc_id")) < 5
        rows = once(self.blob_rows, json=json)
        return rows.select(
            F.when(cut, F.left("json", F.length("json") - 5)).otherwise(F.col("json")).alias("payload"),
            F.concat(F.col("correlation_id"), F.lit("_archive.json")).alias("name"))
