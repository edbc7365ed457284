"""Scans, parsing and projections of the archived records."""

from pyspark.sql import functions as F

from assayer import fixed_values as V
from assayer.functions import text as X
from assayer.operators import audit, questions as Q, runs
from assayer.plans.registry import query
from assayer.plans.views_sql import SUBJECTS, keyed, pick, q
from assayer.session import work_path
from assayer.sources import blobs as B, configs as C, tables as T

CUT = keyed("cut", "doc_id") + " < 5"
# archived records that parse, with their labels
EXTRA = {
    "kept": f"select a.*, l.quality, l.toxic from articles a left join labels l using (doc_id) where not ({CUT})",
}


def raw(d):
    return d.blobs.select("payload", "name")


@query("reuse_bronze", sql="select correlation_id, length(body) as body_chars from kept", extra=EXTRA)
def _(d):
    path = work_path(d.spark, "bronze")
    B_first = runs.reuse_or_ingest(d.spark, path, lambda: raw(d))
    again = runs.reuse_or_ingest(d.spark, path, lambda: B_first.limit(0))
    return B.inbound(B.parse_blobs(again)).select("correlation_id", F.length("body").alias("body_chars"))


def config_payloads(d):
    """Snapshot JSON per policy configuration; the key and the wrapping vary by configuration."""
    s = d.policy_subjects.groupBy("config_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("pos").alias("sort_order"), F.col("subject_id").cast("string").alias("id"), "name", "validation_prompt"))).alias("subjects"))
    snap = F.to_json(F.struct("subjects"))
    b = T.bucket(F.col("config_id"))
    whole = F.when(b < 40, F.concat(F.lit('{"snapshot": '), snap, F.lit("}"))).when(
        b < 80, F.to_json(F.struct(snap.alias("snapshot_data")))).when(b < 90, F.lit('{"snapshot": null}')).otherwise(
        F.concat(F.lit('{"snapshot": '), snap))
    return s.select("config_id", whole.alias("payload"))


@query("snapshot_unwrap", sql=f"""select config_id, cast(subject_id as varchar) as subject_id, pos, name from policy_subjects
 where ('0x'||substr(md5(config_id),1,8))::ubigint::bigint % 100 < 80""")
def _(d):
    s = C.snapshot_unwrap(config_payloads(d))
    return s.select("config_id", F.inline("snapshot.subjects")).select("config_id", F.col("id").alias("subject_id"), F.col("sort_order").alias("pos"), "name")


@query("load_config_snapshots", sql="select config_id, count(*) as n_subjects from policy_subjects group by config_id")
def _(d):
    """Config documents are stored and read back as text; each carries its own id."""
    path = work_path(d.spark, "configs")
    runs.write_config_lines(config_payloads_plain(d), path)
    s = C.snapshot_unwrap(runs.read_config_lines(d.spark, path))
    return s.select("config_id", F.size("snapshot.subjects").cast("bigint").alias("n_subjects"))


def config_payloads_plain(d):
    s = d.policy_subjects.groupBy("config_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("pos").alias("sort_order"), F.col("subject_id").cast("string").alias("id"), "name"))).alias("subjects"))
    return s.select("config_id", F.to_json(F.struct(F.struct("subjects").alias("snapshot"), F.struct("config_id").alias("metadata"))).alias("payload"))


NAMES_SQL = """select case when page_id % 5 = 0 then 'validation-failure/' when page_id % 5 = 1 then 'delivery-audit/' else '' end
 || 'p' || page_id || case when page_id % 3 = 0 then '_archive' else '' end || case when page_id % 7 = 0 then '.txt' else '.json' end as name from pages"""


def page_names(d):
    k = F.col("page_id")
    return d.table("pages").select(F.concat(
        F.when(k % 5 == 0, "validation-failure/").when(k % 5 == 1, "delivery-audit/").otherwise(""), F.lit("p"), k.cast("string"),
        F.when(k % 3 == 0, "_archive").otherwise(""), F.when(k % 7 == 0, ".txt").otherwise(".json")).alias("name"))


@query("classification_blobs_only", sql="select name from names where name like '%.json' and name not like 'validation-failure/%' and name not like 'delivery-audit/%'",
       extra={"names": NAMES_SQL})
def _(d):
    return audit.classification_only(page_names(d))


@query("blob_name_codec", sql="""select correlation_id, correlation_id||'_archive.json' as name, correlation_id as key_back,
 correlation_id as listed from articles""")
def _(d):
    a = d.articles.select("correlation_id", audit.blob_name(F.col("correlation_id"), "_archive").alias("name"))
    return a.select("correlation_id", "name", audit.blob_key(F.col("name"), "_archive").alias("key_back"), audit.listed_key(F.col("name")).alias("listed"))


@query("uncached_remote", sql="""select name from names where name like '%.json' and name not like 'validation-failure/%' and name not like 'delivery-audit/%'
 and name not in (select 'p'||doc_id||'.json' from labels)""", extra={"names": NAMES_SQL})
def _(d):
    index = d.table("labels").select(F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit(".json")).alias("name"))
    return audit.uncached_remote(page_names(d), index)


@query("fetch_by_ids", sql="select correlation_id, n_chars from articles where doc_id in (select doc_id from labels where toxic = 1)")
def _(d):
    wanted = d.table("labels").filter("toxic = 1").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("correlation_id"))
    return audit.fetch_by_ids(d.articles.select("correlation_id", "n_chars"), wanted)


@query("parse_blobs", sql="""select correlation_id, config_id, length(body) as body_chars, md5(body) as body_md5,
 case when quality is null then 0 else 4 end as n_subjects, n_chars as input_tokens from kept""", extra=EXTRA)
def _(d):
    return B.parse_blobs(raw(d)).select(
        "correlation_id", "config_id", F.length("inbound_data.body").alias("body_chars"), F.md5("inbound_data.body").alias("body_md5"),
        F.coalesce(F.size("subject_results"), F.lit(0)).alias("n_subjects"), F.col("llm_tokens.input").alias("input_tokens"))


@query("quarantine_malformed", sql=f"select correlation_id||'_archive.json' as name from articles where {CUT}")
def _(d):
    return B.quarantine(raw(d)).select("name")


@query("inbound_fallback", sql="""select correlation_id, config_id, headline, md5(body) as body_md5,
 case when doc_id % 10 <= 1 then media_type else 'article' end as media_type from kept""", extra=EXTRA)
def _(d):
    return B.inbound(B.parse_blobs(raw(d))).select("correlation_id", "config_id", "headline", F.md5("body").alias("body_md5"), "media_type")


@query("explode_subject_results", sql="""select b.correlation_id, k.config_id, cast(b.subject_id as varchar) as subject_id, s.name, b.is_valid, b.prominence, b.sentiment
 from kept k join baseline_subjects b using (correlation_id) join subjects s on s.subject_id = b.subject_id""", extra=EXTRA)
def _(d):
    return B.subject_results(B.parse_blobs(raw(d)))


@query("explode_llm_tags", sql="select correlation_id, config_id, tag_id, result from kept join baseline_tags using (correlation_id)", extra=EXTRA)
def _(d):
    return B.llm_tags(B.parse_blobs(raw(d)))


@query("llm_stage_duration", sql="select correlation_id, case when doc_id % 3 = 2 then 0.0 else n_chars * 0.5 end::double as llm_duration_ms from kept", extra=EXTRA)
def _(d):
    return B.llm_stage_duration(B.parse_blobs(raw(d)))


@query("parse_raw_response", sql="""select correlation_id, doc_id % 4 = 0 as is_json, case doc_id % 4 when 0 then '{"note":"ok","subjects":[1]}' when 1 then 'not json {' end as raw_response from kept""", extra=EXTRA)
def _(d):
    return B.raw_response(B.parse_blobs(raw(d)))


@query("index_entry", sql="""select correlation_id||'_archive.json' as name, correlation_id, case when headline = '' then 'Untitled' else headline end as headline, config_id,
 case when doc_id % 10 <= 1 then media_type else 'article' end as media_type, true as cached from kept""", extra=EXTRA)
def _(d):
    return B.index_entries(B.parse_blobs(raw(d))).drop("processed_at")


@query("article_preview", sql="""select correlation_id, case when quality is null then 0 else 4 end as n_subjects,
 case when length(state) > 1000 then left(state, 1000) || '...' else state end as preview from (select *,
 'Item Type: ' || case when doc_id % 10 <= 1 then 'clip (broadcast transcript)' else 'written article' end || chr(10) || chr(10) || 'Headline: ' || headline
 || chr(10) || chr(10) || 'Body:' || chr(10) || body as state from kept)""", extra=EXTRA)
def _(d):
    return B.preview(B.parse_blobs(raw(d)), V.PREVIEW_CHARS)


@query("normalised_outputs", sql="""select k.correlation_id, any_value(k.quality = 1) as validation_result, coalesce(string_agg(concat_ws('|', b.subject_id, s.name, b.is_valid, b.prominence, b.sentiment), ';' order by b.subject_id), '') as subjects,
 coalesce(any_value('g1:toxic=' || (k.toxic = 0) || ',kw=' || (k.toxic = 1) || ';g2:toxic=' || (k.toxic = 1)), '') as tag_groups, case any_value(k.doc_id) % 4 when 0 then '{"note":"ok","subjects":[1]}' when 1 then 'not json {' end as raw_response
 from kept k left join baseline_subjects b using (correlation_id) left join subjects s on s.subject_id = b.subject_id group by k.correlation_id""", extra=EXTRA)
def _(d):
    """The archived decision in its normalised layout, with the parsed reply; every value, not sizes."""
    v = B.baseline_view(B.parse_blobs(raw(d)))
    subjects = F.transform("subjects", lambda s: F.concat_ws("|", s.subject_id, s["name"], s.is_valid.cast("string"), s.prominence, s.sentiment))
    groups = F.transform("tag_groups", lambda g: F.concat(g.group_id, F.lit(":"), F.array_join(F.transform(g.tags, lambda t: F.concat(t.tag_id, F.lit("="), t.result.cast("string"))), ",")))
    text = lambda a: F.coalesce(F.array_join(a, ";"), F.lit(""))
    return v.select("correlation_id", "validation_result", text(subjects).alias("subjects"), text(groups).alias("tag_groups"), "raw_response")


def replies(d):
    """Candidate replies as text, in four envelope shapes."""
    i, s = F.col("doc_id"), T.subject_array()
    valid = F.transform(s, lambda x: F.struct(
        F.concat(F.lit("subj_"), x.subject_id.cast("string"), F.lit("_valid")).alias("key"),
        F.struct(F.lit("noul").alias("type"), (T.keyed("cv", x.subject_id, i).cast("double") / 100).alias("noul"), F.lit(None).cast("string").alias("choice")).alias("value")))
    prom = F.transform(s, lambda x: F.struct(
        F.concat(F.lit("subj_"), x.subject_id.cast("string"), F.lit("_prominence")).alias("key"),
        F.struct(F.lit("choice").alias("type"), F.lit(None).cast("double").alias("noul"), T.pick(T.keyed("cp", x.subject_id, i), V.PROMINENCE_LABELS).alias("choice")).alias("value")))
    env = F.to_json(F.struct(F.lit("m1").alias("model"), F.map_from_entries(F.concat(valid, prom)).alias("answers")))
    shape = (
        F.when(i % 4 == 0, env).when(i % 4 == 1, F.concat(F.lit('{"predictions": ['), env, F.lit("]}")))
        .when(i % 4 == 2, F.to_json(F.struct(env.alias("predictions")))).otherwise(F.concat(F.lit("["), env, F.lit("]"))))
    return d.table("documents").select(F.concat(F.lit("c"), i.cast("string")).alias("correlation_id"), shape.alias("reply"))


@query("answers_long", sql="""select correlation_id, 'subj_'||subject_id||'_valid' as qid, 'noul' as type, p_valid as noul, null::varchar as choice from answers
 union all select correlation_id, 'subj_'||subject_id||'_prominence', 'choice', null, prominence from answers""")
def _(d):
    return B.answers_long(replies(d)).select("correlation_id", "qid", "type", "noul", "choice")


QIDS = """select correlation_id, 'subj_'||subject_id||'_valid' as qid, 'validation' as kind, cast(subject_id as varchar) as subject_id, null::varchar as tag_id from answers
 union all select correlation_id, 'subj_'||subject_id||'_sentiment', 'sentiment', cast(subject_id as varchar), null from answers
 union all select correlation_id, 'tag_'||subject_id||'_b_'||prominence, 'tag', cast(subject_id as varchar), 'b_'||prominence from answers
 union all select correlation_id, 'other'||subject_id, null, null, null from answers"""


@query("parse_qid", sql=QIDS)
def _(d):
    s = F.col("subject_id").cast("string")
    a = d.answers.select("correlation_id", F.explode(F.array(
        F.concat(F.lit("subj_"), s, F.lit("_valid")), F.concat(F.lit("subj_"), s, F.lit("_sentiment")),
        F.concat(F.lit("tag_"), s, F.lit("_b_"), F.col("prominence")), F.concat(F.lit("other"), s))).alias("qid"))
    kind, subject, tag = Q.parse_qid(F.col("qid"))
    return a.select("correlation_id", "qid", kind.alias("kind"), subject.alias("subject_id"), tag.alias("tag_id"))


@query("normalise_questions", sql="""select config_id, subject_id, tag_id, qtype,
 case when ok then 'own' else case qtype when 'choice' then 'valid' when 'score' then '0' else 'true' end end as first_label,
 case when ok then 1 else case qtype when 'score' then 3 else 2 end end as n_labels from (select *,
 case qtype when 'choice' then shape in ('map','list') when 'score' then shape = 'list' else shape = 'map' end as ok from (
 select config_id, subject_id, tag_id, case tag_name when 'AI' then 'noul' when 'Storage notes' then 'score' else 'choice' end as qtype,
 case when subject_id % 3 = 0 then 'map' when subject_id % 3 = 1 then 'list' else 'none' end as shape from policy_tags))""")
def _(d):
    k = F.col("subject_id")
    raw_q = d.policy_tags.select(
        "config_id", "subject_id", "tag_id",
        F.when(F.col("tag_name") == "AI", "NOUL").when(F.col("tag_name") == "Storage notes", "Score").otherwise(F.col("evaluation_type")).alias("qtype"),
        F.when(k % 3 == 0, "map").when(k % 3 == 1, "list").otherwise("none").alias("criteria_shape"),
        F.array(F.lit("own")).alias("criteria_labels"), F.array(F.lit("text")).alias("criteria_texts"))
    n = Q.normalise_questions(raw_q)
    return n.select("config_id", "subject_id", "tag_id", "qtype", F.get("criteria_labels", F.lit(0)).alias("first_label"), F.size("criteria_labels").alias("n_labels"))


@query("search_articles", sql="select correlation_id, headline from articles where contains(lower(headline), 'thin') or contains(lower(correlation_id), 'thin')")
def _(d):
    return audit.search(d.articles.select("correlation_id", "headline"), "ThIn", "headline", "correlation_id")


@query("search_configs", sql="select id, identifier from configurations where contains(lower(name||' '||identifier), 'build')")
def _(d):
    c = d.configurations.withColumn("label", F.concat_ws(" ", "name", "identifier"))
    return audit.search(c, "BUILD", "label").select("id", "identifier")


@query("is_clip", sql="select correlation_id, lower(media_type) in ('radio','television','tv') as clip from articles")
def _(d):
    return d.articles.select("correlation_id", X.is_clip(F.col("media_type")).alias("clip"))


ENGINES = (("local", ("local",), ("view:9", "click:local")), ("served", ("http",), ("view",)), ("cloud", ("none",), ("purchase", "error:1")))


@query("resolve_engine", sql="""select id, case when model like 'view:9%' then 'local' when processing_source = 'http' or model like 'view%' then 'served'
 when model like 'purchase%' or model like 'error:1%' then 'cloud' else 'direct' end as engine from (select *, config_id||':'||substr(correlation_id,2) as model from audit_log)""")
def _(d):
    model = F.concat("config_id", F.lit(":"), F.substring("correlation_id", 2, 100))
    return d.audit_log.select("id", Q.resolve_engine(model, F.col("processing_source"), ENGINES, "direct").alias("engine"))


LABELS = (("view", "Viewer (served)"), ("error", "Errors"), ("o", "With o"))


@query("candidate_label", sql="""select id, case when contains(m, 'view') then 'Viewer (served)' when contains(m, 'error') then 'Errors' when contains(m, 'o') then 'With o'
 when m <> '' then m else 'Default' end as label from (select id, case when config_id = 'signup' then '' else config_id end as m from audit_log)""")
def _(d):
    m = F.when(F.col("config_id") == "signup", "").otherwise(F.col("config_id"))
    return d.audit_log.select("id", Q.candidate_label(m, LABELS, "Default").alias("label"))


@query("skip_unresolvable", sql="""select u.o_orderkey as article_no, case when c.id is null then 'skipped' else 'ok' end as status,
 case when c.id is null then 'no published configuration' end as reason from orders u left join (select id from configurations
 where id in (select configuration_id from versions) and not is_archived and (status = 'active' or (status = 'pending_changes' and coalesce(previous_status,'active') = 'active'))) c on u.o_custkey = c.id""")
def _(d):
    p = C.published_config(d.configurations, d.versions).select(F.col("numeric_config_id").alias("config_id"))
    work = d.table("orders").select(F.col("o_orderkey").alias("article_no"), F.col("o_custkey").alias("config_id"))
    return runs.skip_unresolvable(work, p).select("article_no", "status", "reason")
