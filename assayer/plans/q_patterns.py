"""Documented decision patterns over answers, and the incremental forms."""

from pyspark.sql import functions as F

from assayer import fixed_values as V
from assayer.functions import labels as L
from assayer.operators import audit as A, gating as G
from assayer.operators.joins import spread
from assayer.plans import q_sources
from assayer.plans.q_text import AQ, AQID, article_questions
from assayer.plans.registry import query
from assayer.plans.views_sql import keyed
from assayer.session import work_path
from assayer.sources import blobs as B, tables as T
from assayer.streaming import streams as S

SOFT = "list_transform(logits, lambda x: exp(x - list_max(logits)) / list_sum(list_transform(logits, lambda y: exp(y - list_max(logits)))))"


@query("score_expectation", sql=f"select vec_id, round(list_sum(list_transform(range(1, len(p) + 1), lambda i: (i - 1) * p[i])), 6) as score from (select vec_id, {SOFT} as p from predictions)")
def _(d):
    levels = F.transform(F.sequence(F.lit(0), F.size("logits") - 1), lambda i: i.cast("string"))
    p = d.predictions.select("vec_id", F.map_from_arrays(levels, L.softmax(F.col("logits"))).alias("p"))
    return p.select("vec_id", F.round(G.score_expectation(F.col("p")), 6).alias("score"))


@query("confidence_route", sql="select correlation_id, subject_id, case when p_toxic >= 0.85 then 'automate' when p_toxic >= 0.6 then 'verify' else 'human' end as route from answers")
def _(d):
    return d.answers.select("correlation_id", "subject_id", G.confidence_route(F.col("p_toxic")).alias("route"))


@query("composite_score", sql="select correlation_id, round(sum(p_valid * 0.7 + p_toxic * 0.3), 6)::double as total from answers group by 1")
def _(d):
    rows = d.answers.select("correlation_id", F.inline(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(c).alias("score")) for n, c in (("fit", "p_valid"), ("risk", "p_toxic"), ("other", "p_valid"))])))
    return G.composite_score(rows, {"fit": 0.7, "risk": 0.3}, "correlation_id").withColumn("total", F.round("total", 6))


@query("self_consistency", sql="select correlation_id, subject_id as pair_id, round(p_valid + p_toxic, 6) as p_sum from answers where abs(p_valid + p_toxic - 1.0) > 0.305")
def _(d):
    rows = d.answers.select("correlation_id", F.col("subject_id").alias("pair_id"), F.explode(F.array("p_valid", "p_toxic")).alias("p"))
    return G.self_consistency(rows, 0.305).withColumn("p_sum", F.round("p_sum", 6))


@query("hierarchy_fallback", sql="select c_custkey, case when c_acctbal / 10000 >= 0.5 then n_name else r_name end as category from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey")
def _(d):
    n = d.table("nation").join(d.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = d.table("customer").join(d.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("leaf"), (F.col("c_acctbal") / 10000).alias("confidence"))
    return G.hierarchy_fallback(rows, n.select(F.col("n_name").alias("category"), F.col("r_name").alias("parent")), 0.5).select("c_custkey", "category")


@query("link_action", sql="select l_orderkey, l_linenumber, l_partkey, case when round(l_discount * 20)::int <= 0 then 'leave' when round(l_discount * 20)::int = 1 then 'flag' else 'merge' end as action from lineitem")
def _(d):
    return d.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", G.link_action(F.col("l_discount") * 20).alias("action"))


BM25 = """with d as (select doc_id, w, len(w) as n from (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents)),
 stats as (select count(*) as n_docs, avg(n) as avg_len from d), qt as (select distinct item_id as query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from benchmark),
 tf as (select doc_id, n, term, count(*) as tf from (select doc_id, n, unnest(w) as term from d) where term in (select term from qt) group by all),
 idf as (select term, ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) as idf from (select term, count(*) as df from tf group by term) cross join stats),
 hits as (select query_id, doc_id, round(sum(idf * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * n / avg_len))), 6) as score from tf join idf using (term) join qt using (term) cross join stats group by all)
 select query_id, doc_id, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from hits) where rank <= 5"""


@query("lexical_candidates", sql=BM25)
def _(d):
    q = d.table("benchmark").select(F.col("item_id").alias("query_id"), "text")
    return G.lexical_candidates(spread(d.table("documents").select("doc_id", "text")), q, 5).select("query_id", "doc_id", "rank")


@query("regex_candidates", sql=" union all ".join(f"select doc_id, '{k}' as kind, (i - 1)::int as pos, v[i] as value from (select doc_id, v, unnest(range(1, len(v) + 1)) as i from (select doc_id, regexp_extract_all(text, '{p}') as v from documents))" for k, p in G.CANDIDATE_PATTERNS.items()))
def _(d):
    return G.regex_candidates(d.table("documents"))


TREE = "select 'root' as parent, r_name as child from region union all select r_name, n_name from nation join region on r_regionkey = n_regionkey"
PSQL = "(" + keyed("beam", "child", "item") + " + 1) / 100.0::double"


@query("beam_descent", sql=f"""with tree as ({TREE}), one as (select doc_id as item, child as node, round({PSQL}, 9) as p, 'root>' || child as path from (select doc_id, doc_id as item, child from documents cross join tree where parent = 'root')),
 kept as (select * from (select *, row_number() over (partition by item order by p desc, path) rn from one) where rn <= 2),
 two as (select item, child as node, round(p * q, 9) as p, path || '>' || child as path from (select k.item, k.p, k.path, t.child, {PSQL.replace('child', 't.child').replace('item', 'k.item')} as q from kept k join tree t on t.parent = k.node))
 select item, node, p, path from (select *, row_number() over (partition by item order by p desc, path) rn from two) where rn <= 2""")
def _(d):
    r, n = d.table("region"), d.table("nation")
    tree = r.select(F.lit("root").alias("parent"), F.col("r_name").alias("child")).unionByName(
        n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child")))
    starts = d.table("documents").select(F.col("doc_id").alias("item"), F.when(F.col("doc_id") >= 0, "root").alias("node"))
    return G.beam_descent(starts, tree, lambda item, child: (T.keyed("beam", child, item) + 1) / 100.0, depth=2, beam=2)


# --- incremental forms over the given tables -------------------------------------------------------------------------

def stream_of(d, name: str):
    return S.table_stream(d.spark, d.dir, f"{name}.parquet", d.table(name).schema)


@query("ingest_blobs", sql="select correlation_id, length(body) as body_chars from articles where n_chars > 0")
def _(d):
    """Records arrive as files, land as raw payloads with their origin, and are parsed from there; a second run adds nothing."""
    path, mark = work_path(d.spark, "bronze"), work_path(d.spark, "mark")
    head = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    payload = F.to_json(F.struct(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("correlation_id"), F.col("source").alias("config_id"), F.struct(
        head.alias("headline"), F.col("text").substr(F.length(head) + 2, F.length("text")).alias("body")).alias("inbound_data")))
    rows = lambda: stream_of(d, "documents").select(payload.alias("payload"), F.col("_metadata.file_path").alias("source_path"),
                                                     F.col("_metadata.file_modification_time").alias("ingested_at"))
    S.ingest(rows(), path, mark)
    S.ingest(rows(), path, mark)
    return B.inbound(B.parse_blobs(d.spark.read.parquet(path))).select("correlation_id", F.length("body").alias("body_chars"))


def in_files(d, rows, files: int, name: str) -> str:
    """Rows of a given table as several files, for streams that take a file at a time."""
    path = work_path(d.spark, name)
    rows.repartition(files, F.col(rows.columns[0])).write.parquet(path)
    return path


@query("bounded_ingest", sql="select true as bound_reached, true as stopped_early, count(*)::bigint as after_resume, count(distinct page_id)::bigint as pages from pages")
def _(d):
    """Twelve files, a file a batch, a bound of a few rows: the first run stops with files left, a second one takes the rest."""
    pages = d.table("pages").select("page_id", F.length("html").alias("n"))
    folder, path, mark = in_files(d, pages, 12, "page-files"), work_path(d.spark, "bounded"), work_path(d.spark, "mark")
    stream = lambda: d.spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    seen = S.bounded_ingest(stream(), path, mark, rows=3, poll_seconds=0.02)
    before = d.spark.read.parquet(path).count()
    S.ingest(stream(), path, mark)
    return d.spark.read.parquet(path).agg(F.lit(seen >= 3).alias("bound_reached"), F.lit(before < pages.count()).alias("stopped_early"),
                                          F.count("*").alias("after_resume"), F.count_distinct("page_id").alias("pages"))


@query("resume_ingest", sql="select event_id, event_type from events")
def _(d):
    """The same checkpoint twice: the second run finds nothing new."""
    path, mark = work_path(d.spark, "resumed"), work_path(d.spark, "mark")
    for _i in range(2):
        S.ingest(stream_of(d, "events"), path, mark)
    return d.spark.read.parquet(path).select("event_id", "event_type")


@query("stream_latest", sql="select config_id, correlation_id, id, created_at from (select *, row_number() over (partition by config_id, correlation_id order by created_at desc, id desc) rn from audit_log) where rn = 1")
def _(d):
    path, mark = work_path(d.spark, "latest"), work_path(d.spark, "mark")
    log = stream_of(d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("config_id"),
                                        F.concat(F.lit("c"), F.get_json_object("props", "$.k")).alias("correlation_id"))
    S.stream_latest(log, path, mark)
    return S.read_latest(d.spark, path, log.schema).select("config_id", "correlation_id", "id", "created_at")


@query("stream_progress", sql="""select run_id, config_id, count(*) filter (where status = 'ok') as processed, count(*) filter (where status = 'failed') as failed, count(*) filter (where status = 'skipped') as skipped
 from usage group by run_id, config_id""")
def _(d):
    """Counters from records of which every seventh arrives twice, over several batches."""
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("article_no") % 7 == 0, 2).otherwise(1)))
    rows = d.usage.select("article_no", "run_id", "config_id", "status", F.col("recorded_at").cast("timestamp").alias("recorded_at"), twice.alias("copy")).drop("copy")
    folder, path, mark = in_files(d, rows, 3, "record-files"), work_path(d.spark, "progress"), work_path(d.spark, "mark")
    S.stream_progress(d.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder), path, mark, ["article_no"], "recorded_at", "20 years", merge_every=2)
    return S.read_progress(d.spark, path)
