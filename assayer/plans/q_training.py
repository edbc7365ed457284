"""Training sequences, samplers, splits, evaluation and calibration."""

from pyspark.sql import functions as F

from assayer import fixed_values as V
from assayer.operators import evaluate as E, runs as R, sampling as S, training as T
from assayer.plans import q_sources
from assayer.plans.q_flow import PERF, RECORD, VERD, perf
from assayer.plans.q_text import ASKED, STATES, article_questions
from assayer.plans.registry import query
from assayer.plans.views_sql import WS, bucket, q
from assayer.session import work_path, written
from assayer.sources import blobs as B, tables
from assayer.functions import labels as L, text as X
from assayer.streaming import streams as S_

KEY = ["correlation_id", "qid"]
LABEL3 = "case prominence when 'primary' then 0 when 'significant' then 1 else 2 end"
LABEL4 = "case sentiment when 'positive' then 0 when 'negative' then 1 when 'neutral' then 2 else 3 end"
SEQS = {"seqs": f"""select correlation_id, 'subj_'||subject_id||'_valid' as qid, 'validation' as kind, is_valid::int as label from baseline_subjects
 union all select correlation_id, 'subj_'||subject_id||'_prominence', 'prominence', {LABEL3} from baseline_subjects union all select correlation_id, 'subj_'||subject_id||'_sentiment', 'sentiment', {LABEL4} from baseline_subjects
 union all select t.correlation_id, 'tag_'||s.subject_id||'_toxic', 'tag', t.result::int from baseline_tags t cross join subjects s"""}


def seqs(d):
    """Label rows of every archived decision, without the article text."""
    sid = F.col("subject_id").cast("string")

    def row(suffix, kind, value):
        return F.struct(F.concat(F.lit("subj_"), sid, F.lit(f"_{suffix}")).alias("qid"), F.lit(kind).alias("kind"), value.alias("value"))

    s = d.baseline_subjects.select("correlation_id", F.inline(F.array(
        row("valid", "validation", F.col("is_valid").cast("string")), row("prominence", "prominence", F.col("prominence")), row("sentiment", "sentiment", F.col("sentiment")))))
    t = d.baseline_tags.select("correlation_id", F.explode(F.array(*[F.lit(f"tag_{i}_toxic") for i, _ in tables.SUBJECTS])).alias("qid"),
                               F.lit("tag").alias("kind"), F.col("result").cast("string").alias("value"))
    return T.with_targets(s.unionByName(t)).drop("target")


def h(seed, *cols):
    return f"md5(concat_ws('|', '{seed}', {', '.join(cols)}))"


def ranked(src: str, group: str, seed, key="correlation_id, qid") -> str:
    part = f"partition by {group} " if group else ""
    return f"select *, row_number() over ({part}order by {h(seed, *[k.strip() for k in key.split(',')])}, {key}) as rk from {src}"


def blob_tags(parsed):
    return B.llm_tags(parsed)


@query("supervised_labels", sql="""select correlation_id, config_id, qid, kind, label, case kind when 'prominence' then 3 when 'sentiment' then 4 else 2 end as width,
 case when kind in ('validation','tag') then 'noul' else 'choice' end as qtype from seqs join kept using (correlation_id)""", extra={**SEQS, **q_sources.EXTRA})
def _(d):
    parsed = B.parse_blobs(q_sources.raw(d))
    t = T.supervised_labels(parsed, article_questions(d), blob_tags(parsed))
    return t.select("correlation_id", "config_id", "qid", "kind", "label", F.size("target").alias("width"), "qtype")


@query("label_join", sql="select correlation_id, config_id, qid, kind from seqs join kept using (correlation_id) where kind <> 'tag'", extra={**SEQS, **q_sources.EXTRA})
def _(d):
    rows = T.archived_decisions(B.parse_blobs(q_sources.raw(d)))
    return T.label_join(rows, article_questions(d)).select("correlation_id", "config_id", "qid", "kind")


def tokens_sql(c: str) -> str:
    """Ids of the stand-in tokenizer."""
    return f"list_transform(list_filter(regexp_split_to_array({c}, '{WS}+'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 7))::bigint % 50000)"


def windows_sql(head_len: int) -> dict:
    """Every window, or the reason for none, from whole states and whole question texts."""
    return {
        **SEQS, **q_sources.EXTRA, **STATES, **ASKED,
        "heads": f"""select config_id, qid, qtype, {tokens_sql('instructions')} as ins, list_transform(range(1, len(labels) + 1), lambda i: list_prepend(1::bigint, {tokens_sql("labels[i] || ': ' || texts[i]")})) as opts from asked""",
        "headed": """select config_id, qid, case qtype when 'choice' then 0 when 'score' then 1 else 2 end as qtype, ins || flatten(opts) as head,
 list_transform(range(1, len(opts) + 1), lambda i: len(ins) + coalesce(list_sum(list_transform(opts[1:i - 1], lambda o: len(o))), 0)::bigint) as markers from heads""",
        "bodies": f"select correlation_id, config_id, {tokens_sql('state')} as body from states join kept using (correlation_id, config_id)",
        "encoded": f"""select s.correlation_id, b.config_id, s.qid, s.kind, s.label, h.qtype, h.head, h.markers, b.body, {V.MAX_LEN} - len(h.head) as room, greatest(1, {V.MAX_LEN} - len(h.head) - {V.WINDOW_OVERLAP}) as step,
 case when len(h.head) > {head_len} then {q(T.HEAD_TOO_LONG)} when len(h.head) >= {V.MAX_LEN} then {q(T.NO_ROOM)} end as reason from seqs s join bodies b using (correlation_id) join headed h on h.config_id = b.config_id and h.qid = s.qid""",
        "windowed": """select *, w * step as state_start, head || body[w * step + 1 : w * step + room] as ids from (select *, unnest(range(0, n)) as w from (
 select *, 1 + greatest(0, ceil((len(body) - room) / step::double))::bigint as n from encoded where reason is null))""",
    }


SHORT_HEAD = 40


def windows(d, head_len: int = V.HEAD_MAX_LEN):
    from assayer.plans.q_flow import archived, sets
    a = archived(d).withColumn("state", X.distilled_state(F.col("headline"), F.col("body")))
    return T.encode_windows(a.select("correlation_id", "config_id", "state", "subject_results", "base_tags"), sets(d), T.whitespace_tokenizer, head_len=head_len)


SHOWN = """select correlation_id, config_id, qid, kind, label, qtype, w::int as "window", state_start, len(ids) as n_ids, md5(array_to_string(ids, ',')) as ids_md5, array_to_string(markers, ',') as markers from windowed"""


def shown(seqs):
    return seqs.select("correlation_id", "config_id", "qid", "kind", "label", "qtype", "window", "state_start", F.size("ids").cast("bigint").alias("n_ids"),
                       F.md5(F.array_join("ids", ",")).alias("ids_md5"), F.array_join("markers", ",").alias("markers"))


@query("tokenize_sequences", sql=SHOWN, extra=windows_sql(V.HEAD_MAX_LEN))
def _(d):
    """The gold rows straight from archived records: ids, option places and window of every sequence, whole states."""
    return shown(T.sequences(windows(d)))


#: Bytes of text that go into one file of records; a task writes a file.
RECORD_FILE_BYTES = 64 * 1024 * 1024


def record_files(text_bytes: int) -> int:
    """An even number of files that grows with the texts, so that none does."""
    return max(4, 2 * -(-text_bytes // (2 * RECORD_FILE_BYTES)))


@query("stream_sequences", sql=SHOWN, extra=windows_sql(V.HEAD_MAX_LEN))
def _(d):
    """The same sequences from records that arrive in files, four at least, half of them a batch, with a restart in between."""
    from assayer.plans.q_flow import archived_of, sets
    folder, path, mark = work_path(d.spark, "record-lines"), work_path(d.spark, "sequences"), work_path(d.spark, "mark")
    files = record_files(d.table("documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    q_sources.raw(d).select("payload").repartition(files).write.text(folder)
    stream = lambda: d.spark.readStream.format("text").option("maxFilesPerTrigger", files // 2).load(folder).withColumnRenamed("value", "payload")
    articles = lambda parsed: archived_of(parsed).withColumn("state", X.distilled_state(F.col("headline"), F.col("body"))).select("correlation_id", "config_id", "state", "subject_results", "base_tags")
    configs = sets(d)
    for _i in range(2):  # the second run finds nothing new
        S_.stream_sequences(stream(), articles, configs, T.whitespace_tokenizer, path, mark)
    return shown(T.sequences(S_.read_windows(d.spark, path)))


@query("sequence_windows", sql="""select correlation_id, qid, len(body)::bigint as state_tokens, count(*) as windows, min(state_start) as first_token, max(state_start + len(ids) - len(head))::bigint as end_token,
 sum(len(ids) - len(head))::bigint as window_tokens from windowed group by correlation_id, qid, body, head""", extra=windows_sql(V.HEAD_MAX_LEN))
def _(d):
    """How the windows of each sequence cover its state, from its first to its last token."""
    held = F.size("ids") - F.col("head_tokens")
    return T.sequences(windows(d)).groupBy("correlation_id", "qid", "state_tokens").agg(
        F.count("*").alias("windows"), F.min("state_start").alias("first_token"), F.max(F.col("state_start") + held).alias("end_token"), F.sum(held).alias("window_tokens"))


@query("sequence_quarantine", sql="select correlation_id, config_id, qid, kind, label, len(head)::bigint as head_tokens, len(body)::bigint as state_tokens, reason from encoded where reason is not null", extra=windows_sql(SHORT_HEAD))
def _(d):
    """With a small head budget some questions are refused; each refusal is a row with its reason."""
    return T.quarantined(windows(d, SHORT_HEAD))


@query("label_distribution", sql="select kind, label, count(*) as n from seqs group by kind, label", extra=SEQS)
def _(d):
    return T.label_distribution(seqs(d))


SPLIT = f"case when {bucket(chr(39) + 'split|' + chr(39) + '||correlation_id')} < 15 then 'val' else 'train' end"


@query("split_distribution", sql=f"select {SPLIT} as split, kind, label, count(*) as n from seqs group by all", extra=SEQS)
def _(d):
    return T.label_distribution(S.group_split(seqs(d)), ("split", "kind", "label"))


@query("group_split", sql=f"select correlation_id, qid, {SPLIT} as split from seqs", extra=SEQS)
def _(d):
    return S.group_split(seqs(d)).select("correlation_id", "qid", "split")


ROWSPLIT = f"select *, case when rk <= greatest(10, floor(total * 0.15::double)) then 'val' else 'train' end as split from (select *, count(*) over () as total from ({ranked('seqs', '', 42)}))"


@query("row_split", sql=f"select correlation_id, qid, split from ({ROWSPLIT})", extra=SEQS)
def _(d):
    return S.row_split(seqs(d), KEY).select("correlation_id", "qid", "split")


@query("split_leakage", sql=f"""select correlation_id, count(*) filter (where split = 'train') as n_train, count(*) filter (where split = 'val') as n_val from ({ROWSPLIT})
 group by 1 having count(distinct split) > 1""", extra=SEQS)
def _(d):
    return T.split_leakage(S.row_split(seqs(d), KEY))


@query("label_coverage", sql=f"""select s.split, k.kind, r.label::int as label from (values ('train'),('val')) s(split) cross join (values {', '.join(f"('{k}',{w})" for k, w in V.KIND_WIDTH.items())}) k(kind, w)
 cross join range(0, 4) r(label) where r.label < k.w and not exists (select 1 from seqs x where not (x.kind = 'tag' and x.label = 0) and x.kind = k.kind and x.label = r.label and {SPLIT.replace('correlation_id', 'x.correlation_id')} = s.split)""", extra=SEQS)
def _(d):
    return T.label_coverage(S.group_split(seqs(d).filter("not (kind = 'tag' and label = 0)")))


@query("kind_coverage", sql="select kind from (values ('validation'),('prominence'),('sentiment'),('tag')) k(kind) where kind not in (select kind from seqs where label = 3)", extra=SEQS)
def _(d):
    return T.kind_coverage(seqs(d).filter("label = 3"))


DOCS = "(select 'c'||doc_id as correlation_id, source as config_id from documents)"


@query("sample_n", sql=f"select correlation_id, config_id from ({ranked(DOCS, '', 17, 'correlation_id')}) where rk <= 150")
def _(d):
    return S.sample_n(d.articles.select("correlation_id", "config_id"), ["correlation_id"], 150)


@query("cap_per_label", sql=f"select correlation_id, qid, kind, label from ({ranked('seqs', 'kind, label', 42)}) where rk <= 120", extra=SEQS)
def _(d):
    return S.cap_per_label(seqs(d), KEY, 120)


@query("cap_per_label_shared", sql=f"""select correlation_id, qid, kind, label from ({ranked("(select *, case when kind = 'tag' then -1 else label end as pool from seqs)", 'kind, pool', 42)}) r join (
 select kind, greatest(10, 400 // count(distinct label)) as per from seqs group by kind) using (kind) where rk <= case when kind = 'tag' then 400 else per end""", extra=SEQS)
def _(d):
    return S.cap_per_label_shared(seqs(d), KEY, 400)


NEG = "select label, n, case when label = 0 and n > t and t > 0 then t else n end as quota from (select label, n, floor(pos * (1 - 0.4::double) / 0.4::double)::bigint as t from (select label, count(*) n, max(case when label = 1 then count(*) end) over () as pos from seqs where kind = 'tag' group by label))"


@query("downsample_negatives", sql=f"""with neg as ({NEG}) select correlation_id, qid, r.kind, r.label from ({ranked("(select * from seqs where kind = 'tag')", 'label', 42)}) r join neg using (label) where rk <= quota""", extra=SEQS)
def _(d):
    return S.downsample_negatives(seqs(d).filter("kind = 'tag'"), KEY)


BALANCED = f"""with neg as ({NEG}) select correlation_id, qid, r.kind, r.label from ({ranked('seqs', 'kind, label', 42)}) r left join neg on r.label = neg.label and r.kind = 'tag'
 where rk <= case when r.kind = 'tag' then neg.quota else 200 end"""


@query("balanced_set", sql=BALANCED, extra=SEQS)
def _(d):
    return S.balanced_set(seqs(d), KEY, cap=200)


@query("union_balanced", sql=f"select kind, label, count(*) as n from ({BALANCED}) group by kind, label", extra=SEQS)
def _(d):
    """Positives, sampled negatives and capped other kinds put together from their parts."""
    s = seqs(d)
    tags = s.filter("kind = 'tag'")
    rest = S.cap_per_label(s.filter("kind <> 'tag'"), KEY, 200)
    return T.label_distribution(S.union_all(S.downsample_negatives(tags, KEY), rest))


def eval_sql(max_items: int) -> str:
    per = max(1, max_items // 4)
    return f"""with sizes as (select kind, label, count(*) as n, greatest(1, {per} // count(*) over (partition by kind)) as share from predictions group by kind, label),
 s as (select *, least(n, share) as base, n - least(n, share) as lft from sizes),
 quotas as (select kind, label, least(base, greatest(0, {per} - coalesce(sum(base) over (partition by kind order by label rows between unbounded preceding and 1 preceding), 0)))
  + least(lft, greatest(0, {per} - sum(base) over (partition by kind) - coalesce(sum(lft) over (partition by kind order by lft desc, label rows between unbounded preceding and 1 preceding), 0))) as quota from s)
 select vec_id, kind, label from ({ranked('predictions', 'kind, label', 123, 'vec_id')}) join quotas using (kind, label) where rk <= quota"""


@query("stratified_eval_sample", sql=eval_sql(300))
def _(d):
    return S.stratified_eval_sample(d.predictions.select("vec_id", "kind", "label"), ["vec_id"], 300)


@query("equal_shards", sql=f"select correlation_id, qid, ((rk - 1) * 7) // n as shard from (select *, count(*) over () as n from ({ranked('seqs', '', 1234)}))", extra=SEQS)
def _(d):
    return S.equal_shards(seqs(d), KEY, 7).select("correlation_id", "qid", "shard")


STRATA = "select a.correlation_id, a.media_type, a.language, case when l.doc_id is null then 'unknown' when l.quality = 1 then 'good' else 'bad' end as outcome, least(a.n_chars // 2000, 3) as size_band from articles a left join labels l using (doc_id)"


@query("stratified_benchmark", sql=f"select correlation_id, media_type, language, outcome, size_band from ({ranked('strata', 'media_type, language, outcome, size_band', 7, 'correlation_id')}) where rk <= 3", extra={"strata": STRATA})
def _(d):
    a = d.articles.join(d.table("labels").select("doc_id", "quality"), "doc_id", "left").select(
        "correlation_id", "media_type", "language", F.when(F.col("quality").isNull(), "unknown").when(F.col("quality") == 1, "good").otherwise("bad").alias("outcome"),
        F.least(F.floor(F.col("n_chars") / 2000), F.lit(3)).alias("size_band"))
    return S.stratified_benchmark(a, ["media_type", "language", "outcome", "size_band"], ["correlation_id"], 3)


CW = {**SEQS, "cw": """select label, n, raw / (sum(n * raw) over () / sum(n) over ()) as weight from (select label, n, pow(max(n) over () / n::double, 0.5) as raw from (select label, count(*) as n from seqs where kind = 'sentiment' group by label))"""}


@query("class_weights", sql="select label, n, round(weight, 6) as weight from cw", extra=CW)
def _(d):
    return T.class_weights(seqs(d)).withColumn("weight", F.round("weight", 6))


@query("sample_weights", sql="""select correlation_id, qid, round(case when kind in ('validation','tag') and s.label = 1 then 2.5 else 1.0 end * case when kind = 'sentiment' then cw.weight else 1.0 end, 6)::double as sample_weight
 from seqs s left join cw on cw.label = s.label""", extra=CW)
def _(d):
    s = seqs(d)
    return T.sample_weights(s, T.class_weights(s)).select("correlation_id", "qid", F.round("sample_weight", 6).alias("sample_weight"))


@query("dataset_stats", sql=f"""select count(*) as total, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'val') as val, {', '.join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in V.DECISION_KINDS)}
 from (select *, {SPLIT} as split from seqs)""", extra=SEQS)
def _(d):
    return T.dataset_stats(S.group_split(seqs(d)))


@query("write_sequences", sql=f"select {SPLIT} as split, kind, count(*) as n from seqs group by all", extra=SEQS)
def _(d):
    path = work_path(d.spark, "gold")
    T.write_sequences(S.group_split(seqs(d)), path)
    return T.label_distribution(d.spark.read.parquet(path), ("split", "kind"))


@query("read_split", sql=f"select correlation_id, qid, label from seqs where {SPLIT} = 'val'", extra=SEQS)
def _(d):
    path = work_path(d.spark, "gold")
    T.write_sequences(S.group_split(seqs(d)), path)
    return T.read_split(d.spark, path, "val").select("correlation_id", "qid", "label")


@query("write_run_records", sql="select article_no, run_id, config_id, case when article_no % 5 = 0 then 'retried' else status end as status, output_tokens from usage")
def _(d):
    """Every record, written twice, some of them changed by a later attempt; an attempt that never ended shows nothing."""
    rows = d.usage.select("article_no", "run_id", "config_id", "status", "output_tokens")
    path = work_path(d.spark, "records")
    store = R.write_records(rows, path, ["article_no"])
    store.put(rows)
    store.put(rows.filter("article_no % 5 = 0").withColumn("status", F.lit("retried")))
    store.stage(rows.withColumn("status", F.lit("broken off")))
    return R.record_store(d.spark, path, rows.schema, ["article_no"]).read()


@query("write_run_summary", sql=RECORD, extra=PERF)
def _(d):
    """The whole record of each run, written and read back."""
    path = work_path(d.spark, "summaries")
    return R.write_records(R.run_record(perf(d)), path, ["scope", "config_id"]).read()


RUN_OF = "'run' || (" + bucket("'run|' || correlation_id") + " % 3)"


@query("write_error_analysis", sql=f"""with r as (select i.*, {RUN_OF.replace('correlation_id', 'i.correlation_id')} as run_id, v.preferred, a.config_id, a.headline, a.n_chars from issues i join articles a using (correlation_id) left join verdicts v using (correlation_id)),
 lists as (select correlation_id, string_agg(x, ';' order by x) as mismatches from (select correlation_id, dimension || '|' || item || '|' || coalesce(base, '-') || '|' || coalesce(cand, '-') as x from mism) group by correlation_id)
 select run_id, case when type = 'disagreement' then 'evaluation' else 'failure' end as entry, r.correlation_id, config_id, md5(headline) as headline_md5, case when type = 'disagreement' then preferred end as preferred,
 case when type <> 'disagreement' then 'only ' || n_chars || ' characters' end as error, coalesce(l.mismatches, '') as mismatches, null::bigint as total_issues, null::bigint as failures, null::bigint as sample_analyzed, null::bigint as base_preferred, null::bigint as ties from r left join lists l using (correlation_id)
 union all select run_id, 'rollup', '', null, null, null, null, null, count(*), count(*) filter (where type <> 'disagreement'), count(*) filter (where type = 'disagreement' and preferred is not null),
 count(*) filter (where type = 'disagreement' and preferred = 'base'), count(*) filter (where type = 'disagreement' and preferred = 'both') from r group by run_id""", extra=VERD)
def _(d):
    """The analysis of each run in the store, overwritten by a second attempt: rollup, evaluations with their verdicts, failures."""
    from assayer.operators import analysis as A
    from assayer.plans.q_flow import issue_parts, verdicts
    from assayer.sources.tables import keyed as bucket_of
    run = F.concat(F.lit("run"), (bucket_of("run", F.col("correlation_id")) % 3).cast("string"))
    whole = written(A.error_analysis(A.discrepancy_records(*issue_parts(d), d.articles).withColumn("run_id", run), verdicts(d).drop("config_id")), "analysis")
    store = R.record_store(d.spark, work_path(d.spark, "analyses"), A.ANALYSIS, ["entry", "correlation_id"])
    store.put(whole.filter("entry = 'rollup'"))
    store.put(whole, replaces=True)
    text = F.transform("mismatches", lambda x: F.concat_ws("|", x.dimension, x["item"], F.coalesce(x.base, F.lit("-")), F.coalesce(x.cand, F.lit("-"))))
    return store.read().select("run_id", "entry", "correlation_id", "config_id", F.md5("headline").alias("headline_md5"), "preferred", "error",
                               F.array_join(F.array_sort(text), ";").alias("mismatches"), *[F.col("totals")[k].alias(k) for k in ("total_issues", "failures", "sample_analyzed", "base_preferred", "ties")])


@query("best_epoch", sql="""select l_suppkey, (array_agg(epoch order by loss, epoch))[1] as best_epoch, min(loss) as best_loss from (select l_suppkey, l_linenumber as epoch, round(avg(l_tax), 6) as loss from lineitem group by all) group by l_suppkey""")
def _(d):
    e = d.table("lineitem").groupBy("l_suppkey", F.col("l_linenumber").alias("epoch")).agg(F.round(F.avg("l_tax"), 6).alias("loss"))
    return T.best_epoch(e, ["l_suppkey"])


@query("latest_version", sql="select p_brand, max(case when p_partkey % 5 <> 0 then p_size end)::varchar as version from part group by p_brand")
def _(d):
    v = d.table("part").select("p_brand", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("draft-"), "p_name")).otherwise(F.col("p_size").cast("string")).alias("version"))
    return T.latest_version(v, ["p_brand"])


# --- evaluation ------------------------------------------------------------------------------------------------------

LSE = "(list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))))"
PRED = {"scored": f"select *, list_position(logits, list_max(logits)) - 1 as pred, {LSE} - logits[label + 1] as ce from predictions"}


@query("argmax_prediction", sql="select vec_id, pred::int as pred, pred = label as match from scored", extra=PRED)
def _(d):
    return E.with_prediction(d.predictions).select("vec_id", "pred", "match")


ACC = {**PRED, "acc": """select case when grouping(kind) = 1 then 'overall' when grouping(label) = 1 then 'kind' else 'label' end as level, kind, label, count(*) as n, count(*) filter (where pred = label) as correct,
 round(count(*) filter (where pred = label) * 100.0::double / count(*), 2) as accuracy_pct from scored group by grouping sets ((kind, label), (kind), ())"""}


@query("accuracy_by_kind", sql="select * from acc", extra=ACC)
def _(d):
    return E.accuracy_by_kind(d.predictions)


@query("cross_entropy", sql="select kind, round(avg(ce), 6) as loss from scored group by kind", extra=PRED)
def _(d):
    return E.mean_loss(d.predictions, ["kind"]).withColumn("loss", F.round("loss", 6))


@query("weighted_loss", sql="select round(sum(ce * w) / sum(w), 6) as loss from (select *, case when kind in ('validation','tag') and label = 1 then 2.5 else 1 end::double as w from scored)", extra=PRED)
def _(d):
    p = d.predictions.withColumn("sample_weight", T.sample_weight(F.col("kind"), F.col("label"), F.lit(1.0)))
    return E.weighted_loss(p).select(F.round("loss", 6).alias("loss"))


def grid_sql(src: str, log_t: str) -> str:
    return f"""select qtype, n, log_t from (select *, row_number() over (partition by qtype order by loss, i) rn from (select qtype, i, any_value(log_t) as log_t, count(*) as n, avg(ce) as loss from (
 select qtype, i, {log_t} as log_t, list_max(logits) / exp({log_t}) + ln(list_sum(list_transform(logits, lambda x: exp(x / exp({log_t}) - list_max(logits) / exp({log_t}))))) - logits[label + 1] / exp({log_t}) as ce from {src}) group by qtype, i)) where rn = 1"""


WIDTH = "((ln(8.0::double) - ln(0.1::double)) / 40)"
def finer(level: int) -> str:
    """A grid of 41 points over the two intervals beside the last grid's best point."""
    width = f"({WIDTH} / {20 ** level}::double)"
    return grid_sql(f"(select t.*, c.log_t as center, g.i from typed t join (select qtype, log_t from grid{level}) c using (qtype) cross join range(0, 41) g(i))", f"(center + (2 * i / 40.0::double - 1) * {width})")


TEMPS = {
    "typed": "select *, case when kind in ('validation','tag') then 'noul' else 'choice' end as qtype from predictions",
    "grid0": grid_sql("(select * from typed cross join range(0, 41) g(i))", f"(ln(0.1::double) + i * {WIDTH})"),
    **{f"grid{i + 1}": finer(i) for i in range(5)},
}


@query("fit_temperature", sql="select t.qtype, coalesce(n, 0)::bigint as n, case when n is null then 1.0 else round(least(greatest(exp(log_t), 0.1), 8.0), 4) end::double as temperature from (values ('choice'),('score'),('noul')) t(qtype) left join grid5 using (qtype)", extra=TEMPS)
def _(d):
    return E.fit_temperature(d.predictions)


@query("apply_temperature", sql="""select vec_id, round(list_max(p), 6) as top_probability from (select vec_id, list_transform(e, lambda x: x / list_sum(e)) as p from (
 select vec_id, list_transform(logits, lambda x: exp((x - list_max(logits)) / case when kind in ('validation','tag') then 0.886 else 0.911 end)) as e from predictions))""")
def _(d):
    p = E.apply_temperature(d.predictions, {"choice": 0.911, "score": 1.0, "noul": 0.886})
    return p.select("vec_id", F.round(F.array_max("probabilities"), 6).alias("top_probability"))


@query("registration_gate", sql="select kinds, accuracy_pct, kinds = 4 and accuracy_pct >= 83 as registered from (select count(*) filter (where level = 'kind' and n > 0) as kinds, max(case when level = 'overall' then accuracy_pct end) as accuracy_pct from acc)", extra=ACC)
def _(d):
    return E.registration_gate(E.accuracy_by_kind(d.predictions))


@query("agreement_lift", sql="""select kind, round(100.0::double * a / n, 2) as before_pct, round(100.0::double * b / n, 2) as after_pct, round(round(100.0::double * b / n, 2) - round(100.0::double * a / n, 2), 2) as lift
 from (select kind, count(*) n, count(*) filter (where vec_id % k = label) as a, count(*) filter (where pred = label) as b from scored group by kind)""", extra=PRED)
def _(d):
    before = d.predictions.withColumn("logits", F.transform(L.one_hot((F.col("vec_id") % F.col("k")).cast("int"), F.col("k")), lambda x: x.cast("double")))
    return E.agreement_lift(E.accuracy_by_kind(before), E.accuracy_by_kind(d.predictions))


METRICS = f"""select *, case b % 13 {' '.join(f'when {i} then {q(x)}' for i, x in enumerate(E.REQUIRED_METRICS))} else 'other' end as metric from (select concat(event_type, '-', user_id) as run, {bucket('cast(event_id as varchar)')} as b from events)"""


@query("missing_metrics", sql=f"""with m as ({METRICS}), seen as (select distinct run, metric from m) select u.run, r.metric from (select distinct run from m) u cross join (values {', '.join(f'({q(x)})' for x in E.REQUIRED_METRICS)}) r(metric)
 left join seen on seen.run = u.run and seen.metric = r.metric where seen.run is null""")
def _(d):
    b = tables.bucket(F.col("event_id").cast("string")) % 13
    metric = F.lit("other")
    for i, x in enumerate(E.REQUIRED_METRICS):
        metric = F.when(b == i, x).otherwise(metric)
    run = F.concat("event_type", F.lit("-"), F.col("user_id").cast("string"))
    return E.missing_metrics(d.table("events").select(run.alias("run"), metric.alias("metric")), "run")
