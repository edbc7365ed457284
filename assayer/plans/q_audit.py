"""Audit log, article listing and the config store."""

from pyspark.sql import functions as F

from assayer.operators import audit as A
from assayer.plans.registry import query
from assayer.sources import configs as C

LATEST = "select * exclude (rn) from (select *, row_number() over (partition by config_id, correlation_id order by created_at desc, id desc) rn from audit_log) where rn = 1"
PUB = "not is_archived and (status = 'active' or (status = 'pending_changes' and coalesce(previous_status,'active') = 'active'))"
VERS = "select *, row_number() over (partition by configuration_id order by version_number desc) rn from versions"
META = "c.id as numeric_config_id, c.identifier as config_id, c.name as config_name, v.version_number, v.published_at"


@query("latest_per_key", sql=LATEST)
def _(d):
    return A.latest_per_key(d.audit_log)


@query("recent_articles", sql=f"select * from ({LATEST}) order by created_at desc, id desc limit 1500")
def _(d):
    return A.recent_articles(d.audit_log, 1500)


@query("recent_articles_exact", sql=f"select * from ({LATEST}) order by created_at desc, id desc limit 100 offset 20")
def _(d):
    return A.recent_articles(d.audit_log, 100, 20)


@query("config_counts", sql="select config_id, count(distinct correlation_id) as n_articles, max(created_at) as last_processed_at from audit_log group by config_id")
def _(d):
    return A.config_counts(d.audit_log)


@query("blob_config_counts", sql="""select coalesce(nullif(config_id, ''), 'unknown') as config_id, count(*) as n from
 (select case when doc_id % 17 = 0 then null when doc_id % 17 = 1 then '' else config_id end as config_id from articles) group by 1""")
def _(d):
    k = F.col("doc_id") % 17
    return A.blob_config_counts(d.articles.select(F.when(k == 1, "").when(k != 0, F.col("config_id")).alias("config_id")))


@query("latest_config", sql="select config_id from audit_log order by created_at desc, id desc limit 1")
def _(d):
    return A.latest_config(d.audit_log)


def selected_ids(d):
    """Config ids as typed by a user: padded, repeated, partly blank; the order of first use counts."""
    raw = d.audit_log.select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("  "), "config_id")).when(F.col("id") % 7 == 0, " ").otherwise(F.col("config_id")).alias("config_id"), "id")
    return A.ordered_distinct(raw, "config_id", "id")


def positions(d):
    """Selected configs; a config's turn is the place of its first mention."""
    return selected_ids(d).withColumnRenamed("id", "config_pos")


IDS = {"ids": """select config_id, id as config_pos, id from (select trim(c) as config_id, min(id) as id from (
 select id, case when id % 3 = 0 then '  '||config_id when id % 7 = 0 then ' ' else config_id end as c from audit_log) where trim(c) <> '' group by 1)"""}
NEWEST = f"""select l.*, i.config_pos, row_number() over (partition by l.config_id order by created_at desc, l.id desc) as rank_in_config from ({LATEST}) l join ids i using (config_id)"""


@query("ordered_distinct", sql="select config_id, id from ids", extra=IDS)
def _(d):
    return selected_ids(d)


@query("newest_n_per_config", sql=f"select config_id, correlation_id, id, rank_in_config from ({NEWEST}) where rank_in_config <= 50", extra=IDS)
def _(d):
    return A.newest_per_config(d.audit_log, positions(d)).select("config_id", "correlation_id", "id", "rank_in_config")


@query("selection_counts", sql=f"select i.config_id, 50::bigint as requested, count(n.id) as selected from ids i left join ({NEWEST}) n on n.config_id = i.config_id and n.rank_in_config <= 50 group by i.config_id", extra=IDS)
def _(d):
    ids = positions(d)
    return A.selection_counts(A.newest_per_config(d.audit_log, ids), ids)


@query("round_robin", sql=f"select row_number() over (order by rank_in_config, config_pos) as position, config_id, correlation_id, rank_in_config as round, config_pos as turn from ({NEWEST}) where rank_in_config <= 50", extra=IDS)
def _(d):
    """The work list of a run, numbered: round first, then the config's turn."""
    work = A.round_robin(A.newest_per_config(d.audit_log, positions(d)))
    return work.select("position", "config_id", "correlation_id", F.col("rank_in_config").alias("round"), F.col("config_pos").alias("turn"))


@query("list_blobs", sql="""select name, config_id, processed_at from (select correlation_id||'_archive.json' as name, config_id, case when status = 'completed' then created_at end as processed_at
 from audit_log where config_id = 'view') where name like 'c1%' order by processed_at desc nulls last, name limit 50""")
def _(d):
    index = d.audit_log.select(A.blob_name(F.col("correlation_id"), "_archive").alias("name"), "config_id",
                               F.when(F.col("status") == "completed", F.col("created_at")).alias("processed_at"))
    return A.list_blobs(index, 50, "c1", "view")


@query("available_configs", sql=f"select {META} from configurations c join ({VERS}) v on v.configuration_id = c.id and v.rn = 1 where not is_archived")
def _(d):
    return C.available_configs(d.configurations, d.versions)


@query("published_config", sql=f"select {META} from configurations c join ({VERS}) v on v.configuration_id = c.id and v.rn = 1 where {PUB}")
def _(d):
    return C.published_config(d.configurations, d.versions)


@query("published_config_by_tracker", sql=f"""select t.tracker_id, {META} from trackers t join configurations c on c.id = t.configuration_id
 join ({VERS}) v on v.configuration_id = c.id and v.rn = 1 where {PUB}""")
def _(d):
    return C.published_config_by_tracker(d.configurations, d.versions, d.trackers)


@query("config_with_fallback", sql=f"""select {META}, case when {PUB} then 'published' else 'historical_snapshot' end as origin
 from configurations c join ({VERS}) v on v.configuration_id = c.id and v.rn = 1""")
def _(d):
    return C.config_with_fallback(d.configurations, d.versions)


@query("effective_tags", sql="""select distinct b.configuration_id, cast(o.subject_id as varchar) as subject_id, b.tag_id, b.tag_name,
 coalesce(o.evaluation_type, b.evaluation_type) as evaluation_type, coalesce(o.prompt_text, b.prompt_text) as prompt_text, coalesce(o.boolean_expression, b.boolean_expression) as boolean_expression
 from (select p_partkey as tag_evaluation_id, p_brand as configuration_id, 't'||p_size as tag_id, p_name as tag_name, 'llm' as evaluation_type, p_type as prompt_text, null::varchar as boolean_expression
  from part where p_size % 4 <> 0) b
 join (select l_partkey as tag_evaluation_id, p_brand as configuration_id, l_suppkey as subject_id, case when l_suppkey % 2 = 0 then 'boolean' end as evaluation_type,
  case when l_suppkey % 3 = 0 then 'own text' end as prompt_text, case when l_suppkey % 2 = 0 then 'a AND b' end as boolean_expression from lineitem join part on p_partkey = l_partkey) o
 using (configuration_id, tag_evaluation_id)""")
def _(d):
    p = d.table("part")
    base = p.select(F.col("p_partkey").alias("tag_evaluation_id"), F.col("p_brand").alias("configuration_id"),
                    F.concat(F.lit("t"), F.col("p_size").cast("string")).alias("tag_id"), F.col("p_name").alias("tag_name"),
                    F.lit("llm").alias("evaluation_type"), F.col("p_type").alias("prompt_text"), F.lit(None).cast("string").alias("boolean_expression"),
                    F.when(F.col("p_size") % 4 != 0, "active").otherwise("removed").alias("remote_status"))
    s = F.col("l_suppkey")
    over = d.table("lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select(
        F.col("l_partkey").alias("tag_evaluation_id"), F.col("p_brand").alias("configuration_id"), s.alias("subject_id"),
        F.when(s % 2 == 0, "boolean").alias("evaluation_type"), F.when(s % 3 == 0, "own text").alias("prompt_text"),
        F.when(s % 2 == 0, "a AND b").alias("boolean_expression"))
    return C.effective_tags(base, over)


@query("draft_snapshot", sql="""select s.config_id, count(*) as n_subjects, string_agg(s.name, '|' order by s.pos, s.subject_id) as names, sum(t.n)::bigint as n_tags,
 string_agg(t.ids, '/' order by s.pos, s.subject_id) as tag_ids from policy_subjects s
 left join (select subject_id, count(*) n, string_agg(tag_id, ',' order by tag_pos) ids from policy_tags group by 1) t using (subject_id) group by s.config_id""")
def _(d):
    s = d.policy_subjects.drop("sort_order").withColumnRenamed("pos", "sort_order")
    rules = d.policy_tags.select("config_id", F.col("tag_pos").alias("sort_order"), F.col("tag_id").alias("rule_id"), F.lit("add_tag").alias("action"))
    snap = C.draft_snapshot(s, d.policy_tags, rules)
    return snap.select(
        "config_id", F.size("subjects").cast("bigint").alias("n_subjects"), F.array_join(F.transform("subjects", lambda x: x["name"]), "|").alias("names"),
        F.aggregate("subjects", F.lit(0).cast("bigint"), lambda a, x: a + F.size(x.tag_evaluations)).alias("n_tags"),
        F.array_join(F.transform("subjects", lambda x: F.array_join(F.transform(x.tag_evaluations, lambda t: t.tag_id), ",")), "/").alias("tag_ids"))


@query("config_lint", sql="""select config_id, subject_id, tag_id, evaluation_type, case when evaluation_type not in ('llm','boolean') then 'unexpected_evaluation_type' else 'missing_definition' end as violation
 from policy_tags where evaluation_type not in ('llm','boolean') or coalesce(case when evaluation_type = 'llm' then prompt_text else boolean_expression end, '') = ''""")
def _(d):
    return C.config_lint(d.policy_tags)


@query("dedupe_reprocessed", sql="""select id, config_id, correlation_id from audit_log a where id % 10 = 0 or not exists (select 1 from audit_log b where b.status = 'failed'
 and b.config_id = a.config_id and b.correlation_id = a.correlation_id)""")
def _(d):
    incoming = d.audit_log.select("id", "config_id", "correlation_id", (F.col("id") % 10 == 0).alias("force_reprocess"))
    return A.dedupe_reprocessed(incoming, d.audit_log.filter("status = 'failed'")).drop("force_reprocess")
