"""The benchmark flow: presence, gate, scoring, rules, comparison and run summaries."""

from pyspark.sql import functions as F

from assayer import fixed_values as V
from assayer.functions import labels as L, text as X
from assayer.operators import analysis as A, compare as K, entities as E, gating as G, questions as Q, runs as R, scoring as S
from assayer.plans import q_sources
from assayer.plans.q_text import CLEAN, PARAS, STATES, STRICT, WORDS, article_questions, base_sql, canon_sql
from assayer.plans.registry import query
from assayer.plans.views_sql import bucket, q, words_in
from assayer.session import work_path, written
from assayer.sources import blobs as B

WORD = r"[\p{L}\p{M}\p{N}_]"
NONWORD = r"[^\p{L}\p{M}\p{N}_]"

EVIDENCE = {
    "noisy": "select correlation_id, doc_id, headline, body from articles",
    "cleaned": CLEAN,
    "texts": f"""select a.correlation_id, a.config_id, lower(a.headline) as hl, lower(coalesce(a.p[1], '')) as lead, lower(a.headline || ' ' || c.clean) as full_lc
 from (select *, {PARAS} as p from articles) a join cleaned c using (correlation_id)""",
    "labelled": f"select *, {canon_sql('name')} as canon, {base_sql('name')} as base from subjects",
    "formlists": f"select subject_id, {STRICT} as strict, list_distinct({STRICT} || {WORDS}) as presence from labelled",
    "forms": "select subject_id, lower(t) as term, list_contains(strict, t) as strict from (select *, unnest(presence) as t from formlists)",
    "parts": "select correlation_id, 'full' as part, full_lc as txt from texts union all select correlation_id, 'head', hl from texts union all select correlation_id, 'lead', lead from texts",
    # every occurrence of every term, by cutting the text at the term; then whole words, windows and surroundings
    "occurrences": """select correlation_id, part, txt, subject_id, term, strict, (sum(length(p[i])) over (partition by correlation_id, part, subject_id, term order by i rows between unbounded preceding and 1 preceding)
  + (i - 2) * length(term))::bigint as start0, i from (select *, unnest(range(1, len(p) + 1)) as i from (select x.*, f.subject_id, f.term, f.strict, string_split(x.txt, f.term) as p
  from parts x cross join forms f where contains(x.txt, f.term)))""",
    "spots": f"""select *, (start0 = 0 or not regexp_matches(substr(txt, start0, 1), '{WORD}')) and not regexp_matches(substr(txt, start0 + length(term) + 1, 1), '{WORD}') as whole,
 substr(txt, start0 + 1, length(term) + 25) as win,
 strict and part = 'full' and ((regexp_matches(left(txt, start0), '(,\\s*|(^|{NONWORD})and\\s+)$') and regexp_matches(substr(txt, start0 + length(term) + 1), '^(,|\\s*\\))'))
  or (regexp_matches(left(txt, start0), '\\(\\s*([^)]*,\\s*)?$') and regexp_matches(substr(txt, start0 + length(term) + 1), '^(,\\s*[^)]*)?\\)'))) as listed from occurrences where i >= 2""",
    "hit_counts": f"""select correlation_id, subject_id, count(*) filter (where whole and strict and part = 'full') as mentions, count(*) filter (where whole and part = 'full') as n_hits,
 count(*) filter (where whole and part = 'full' and {words_in('win', V.VENUE_SUFFIXES)}) as n_venue, bool_or(whole and strict and part = 'head') as in_headline,
 bool_or(whole and strict and part = 'lead') as in_lead, bool_or(listed) as in_list from spots group by all""",
    "evidence": f"""select *, in_headline and not venue_only as certified, named and not venue_only as has_mention,
 not (in_headline and not venue_only) and not (named and not venue_only) as unmatched,
 (count(*) filter (where in_headline) over w)::int as n_headline, max(mentions) over w as max_mentions, (count(*) filter (where mentions >= 3) over w)::int as n_major
 from (select x.correlation_id, x.config_id, s.subject_id, s.name, coalesce(h.in_headline, false) as in_headline, coalesce(h.in_lead, false) as in_lead, coalesce(h.in_list, false) as in_list, coalesce(h.mentions, 0)::int as mentions, coalesce(h.n_hits, 0) > 0 as named,
  coalesce(h.n_hits > 0 and h.n_hits = h.n_venue, false) and not {words_in('x.full_lc', V.SPONSOR_PHRASES)} as venue_only, {words_in('x.full_lc', V.ADVERSITY_MARKERS)} as adversity
  from texts x join config_subjects s using (config_id)
  left join hit_counts h on h.correlation_id = x.correlation_id and h.subject_id = s.subject_id) window w as (partition by correlation_id)""",
}


def entities(d):
    return E.entity_sets(d.config_subjects.withColumn("pos", F.col("subject_id")))


def sets(d):
    """Questions and surface forms per configuration, written once and read by every later step."""
    e = entities(d)
    prompts = F.concat(F.lit("Sum up the story for "), "config_id", F.lit(". Say why it was rejected."))  # summary and rejection prompts
    return written(G.config_sets(Q.question_sets(article_questions(d)), e).withColumn("excluded_text", prompts), "config-sets")


def evidence(d):
    return E.evidence_rows(E.presence_evidence(d.articles_spread, written(entities(d), "entity-sets")))


@query("mention_counts", sql="select correlation_id, subject_id, mentions from evidence", extra=EVIDENCE)
def _(d):
    return evidence(d).select("correlation_id", "subject_id", "mentions")


@query("mention_match", sql="select correlation_id, config_id, subject_id from evidence where named", extra=EVIDENCE)
def _(d):
    """Subjects whose terms occur in the article at all, whatever the context."""
    return evidence(d).filter(F.col("has_mention") | F.col("venue_only")).select("correlation_id", "config_id", "subject_id")


@query("headline_lead_flags", sql="select correlation_id, subject_id, in_headline, in_lead from evidence", extra=EVIDENCE)
def _(d):
    return evidence(d).select("correlation_id", "subject_id", "in_headline", "in_lead")


@query("venue_only", sql="select correlation_id, subject_id, venue_only from evidence", extra=EVIDENCE)
def _(d):
    return evidence(d).select("correlation_id", "subject_id", "venue_only")


@query("list_context", sql="select correlation_id, subject_id, in_list from evidence", extra=EVIDENCE)
def _(d):
    return evidence(d).select("correlation_id", "subject_id", "in_list")


@query("presence_evidence", sql="""select correlation_id, config_id, subject_id, name, in_headline, in_lead, mentions, has_mention, venue_only, in_list, certified, unmatched,
 adversity, n_headline, max_mentions, n_major from evidence""", extra=EVIDENCE)
def _(d):
    return evidence(d)


@query("headline_primacy", sql="select correlation_id, subject_id, certified, case when certified then 1.0::double end as noul from evidence", extra=EVIDENCE)
def _(d):
    return evidence(d).select("correlation_id", "subject_id", "certified", F.when(F.col("certified"), 1.0).alias("noul"))


THRESH = "case when e.in_lead then 0.35 when e.unmatched then 0.65 else 0.45 end::double"


@query("validation_gate", sql=f"""select e.correlation_id, e.subject_id, {THRESH} as effective_threshold, case when e.certified then 1.0 else a.p_valid end::double as noul,
 e.certified or a.p_valid >= {THRESH} as passed from evidence e join answers a on a.correlation_id = e.correlation_id and a.subject_id = e.subject_id""", extra=EVIDENCE)
def _(d):
    rows = evidence(d).join(d.answers.select("correlation_id", "subject_id", "p_valid"), ["correlation_id", "subject_id"])
    return G.validation_gate(rows).select("correlation_id", "subject_id", "effective_threshold", "noul", "passed")


# --- scoring with the deterministic stand-in ----------------------------------------------------------------

def noul_sql(qid: str) -> str:
    return f"{bucket(f'concat({qid}, {q(chr(124))}, seen)')}::double / 100"


def weight_sql(qid: str, label: str) -> str:
    return f"({bucket(f'concat({qid}, {q(chr(124) + label + chr(124))}, seen)')} + 1)"


def first_max(cols: dict) -> str:
    """Label of the first largest value."""
    best = "greatest(" + ", ".join(cols.values()) + ")"
    labels = list(cols)
    return "case " + " ".join(f"when {cols[x]} = {best} then '{x}'" for x in labels[:-1]) + f" else '{labels[-1]}' end"


VALID, PROM, SENT = ("'subj_'||subject_id||'_%s'" % x for x in ("valid", "prominence", "sentiment"))
W3 = {x: f"wp{i}" for i, x in enumerate(V.PROMINENCE_LABELS)}
W4 = {x: f"ws{i}" for i, x in enumerate(V.SENTIMENT_LABELS)}
# what the stand-in answers depend on, next to the question: the article and the whole state it was shown
SEEN = {**STATES, "seen_states": "select correlation_id, concat(correlation_id, '|', md5(state)) as seen from states"}
SCORED = {
    **EVIDENCE, **SEEN,
    "weights": f"""select *, {noul_sql(VALID)} as p_raw, {', '.join(f'{weight_sql(PROM, x)} as {c}' for x, c in W3.items())}, {', '.join(f'{weight_sql(SENT, x)} as {c}' for x, c in W4.items())},
 {noul_sql("'tag_'||subject_id||'_toxic'")} as t_toxic, {noul_sql("'tag_'||subject_id||'_long'")} as t_long from evidence e join seen_states using (correlation_id)""",
    "gated": f"""select e.*, {THRESH} as effective_threshold, case when certified then 1.0 else p_raw end::double as p_valid, certified or p_raw >= {THRESH} as passed from weights e""",
    "raw_choices": f"""select *, p_valid >= 0.45 as valid, case when passed then {first_max(W3)} else 'passing' end as p_choice,
 case when passed then greatest(wp0, wp1, wp2)::double / (wp0 + wp1 + wp2) else 1.0 end as p_conf, case when passed then {first_max(W4)} else 'neutral' end as s_choice,
 case when passed then greatest(ws0, ws1, ws2, ws3)::double / (ws0 + ws1 + ws2 + ws3) else 1.0 end as s_conf,
 {', '.join(f"case when passed then ws{i}::double / (ws0 + ws1 + ws2 + ws3) else {1.0 if i == 2 else 0.0} end as sp{i}" for i in range(4))} from gated""",
    "reweighted": """select *, adversity and sp1 >= 0.25 as hard, case when adversity and sp1 >= 0.25 then sp0 else sp0 * 0.55::double end as v0, case when adversity and sp1 >= 0.25 then sp1 * 1.5::double else sp1 * 0.85::double end as v1,
 case when adversity and sp1 >= 0.25 then sp2 * 0.9::double else sp2 * 1.8::double end as v2, sp3 * 0.5::double as v3 from raw_choices""",
    "rounded": "select *, round(v0 / (v0+v1+v2+v3), 4) as r0, round(v1 / (v0+v1+v2+v3), 4) as r1, round(v2 / (v0+v1+v2+v3), 4) as r2, round(v3 / (v0+v1+v2+v3), 4) as r3 from reweighted",
    "decisions": f"""select *, case when valid then {first_max({x: f'r{i}' for i, x in enumerate(V.SENTIMENT_LABELS)})} else s_choice end as sentiment,
 case rule when 1 then 'passing' when 2 then case when mentions >= 3 then 'significant' else 'passing' end when 3 then 'passing'
  when 4 then case when p_choice = 'primary' then case when mentions >= 2 then 'significant' else 'passing' end else p_choice end when 5 then case when mentions < 8 then 'significant' else 'primary' end
  when 6 then case when n_headline <= 1 then 'primary' else 'significant' end when 7 then 'significant' else p_choice end as prominence,
 case rule when 1 then 0.95 when 2 then 0.9 when 3 then 0.9 when 4 then case when p_choice = 'primary' then 0.85 else p_conf end when 5 then 0.9 when 6 then 0.95 when 7 then 0.9 else p_conf end::double as prominence_conf
 from (select *, case when not valid then 0 when not in_headline and mentions <= 1 then 1 when not in_headline and n_major >= 2 then 2 when not in_headline and max_mentions >= 5 and mentions <= 2 then 3
  when not in_headline and (in_list or mentions < 3) then 4 when mentions >= 4 and p_choice = 'passing' then 5 when in_headline and p_choice = 'passing' then 6
  when in_lead and p_choice = 'passing' and mentions >= 2 then 7 else 0 end as rule from rounded)""",
}


def plain_run(d, keep=()):
    return G.cascade(d.articles_spread, sets(d), S.hash_scorer, keep)


PAIRS = f"""select *, {noul_sql(VALID)} as p_raw, {', '.join(f'{weight_sql(PROM, x)} as {c}' for x, c in W3.items())}, {', '.join(f'{weight_sql(SENT, x)} as {c}' for x, c in W4.items())},
 {noul_sql("'tag_'||subject_id||'_toxic'")} as t_toxic, {noul_sql("'tag_'||subject_id||'_long'")} as t_long from (select a.correlation_id, a.config_id, s.subject_id, x.seen from articles a join config_subjects s using (config_id) join seen_states x using (correlation_id))"""
TOP3, TOP4 = "round(greatest(wp0,wp1,wp2)::double / (wp0+wp1+wp2), 6)", "round(greatest(ws0,ws1,ws2,ws3)::double / (ws0+ws1+ws2+ws3), 6)"


def answers_sql(gated: bool) -> str:
    """All five answers of each (article, subject); with the gate, subjects under the threshold take the defaults."""
    def g(answer, default):
        return f"case when p_raw >= 0.45 then {answer} else {default} end" if gated else answer
    rows = ((VALID, "'noul'", "p_raw", "null::varchar", "1.0::double"), (PROM, "'choice'", "null", g(first_max(W3), "'passing'"), g(TOP3, "0.92::double")),
            (SENT, "'choice'", "null", g(first_max(W4), "'neutral'"), g(TOP4, "0.9::double")), ("'tag_'||subject_id||'_toxic'", "'noul'", g("t_toxic", "0::double"), "null", "1.0"),
            ("'tag_'||subject_id||'_long'", "'noul'", g("t_long", "0::double"), "null", "1.0"))
    return " union all ".join(f"select correlation_id, {qid} as qid, {t} as type, {p} as noul, {c} as choice, {k} as confidence from pairs" for qid, t, p, c, k in rows)


def show_answers(df):
    return S.answers_rows(df, "answers").select("correlation_id", "qid", "type", "noul", "choice", F.round("confidence", 6).alias("confidence"))


@query("score_batch", sql=answers_sql(False), extra={**SEEN, "pairs": PAIRS})
def _(d):
    r = Q.request_table(d.articles_spread, sets(d))
    return show_answers(S.score(r, S.hash_scorer, "questions", "answers"))


@query("two_stage_cascade", sql=answers_sql(True), extra={**SEEN, "pairs": PAIRS})
def _(d):
    return show_answers(G.two_stage_cascade(Q.request_table(d.articles_spread, sets(d)).drop("question_count"), S.hash_scorer))


@query("prominence_rules", sql="select correlation_id, subject_id, prominence, round(prominence_conf, 6) as prominence_conf from decisions", extra=SCORED)
def _(d):
    return G.subject_decisions(plain_run(d)).select("correlation_id", "subject_id", "prominence", F.round("prominence_conf", 6).alias("prominence_conf"))


@query("sentiment_recalibration", sql="select correlation_id, subject_id, sentiment, case when valid then r2 else round(sp2, 4) end as p_neutral from decisions", extra=SCORED)
def _(d):
    return G.subject_decisions(plain_run(d)).select("correlation_id", "subject_id", "sentiment", F.round(F.col("sentiment_probs")["neutral"], 4).alias("p_neutral"))


@query("cascade_decisions", sql="""select correlation_id, config_id, subject_id, p_valid, effective_threshold, passed, prominence, sentiment from decisions""", extra=SCORED)
def _(d):
    """The whole cascade: two scorer passes, gate defaults, floors, ceilings and recalibration."""
    return G.subject_decisions(plain_run(d)).select("correlation_id", "config_id", "subject_id", "p_valid", "effective_threshold", "passed", "prominence", "sentiment")


@query("merge_answers", sql="""select correlation_id, 'subj_'||subject_id||'_prominence' as qid, case when p_valid < 0.45 then 'passing' else prominence end as choice, case when p_valid < 0.45 then 'gate' else 'model' end as origin from answers""")
def _(d):
    rows = d.answers.withColumn("qid", G.subject_qid(F.col("subject_id"), "prominence"))
    model = rows.select("correlation_id", "qid", F.col("prominence").alias("choice"), F.lit("model").alias("origin"))
    gate = rows.filter(F.col("p_valid") < 0.45).select("correlation_id", "qid", F.lit("passing").alias("choice"), F.lit("gate").alias("origin"))
    return G.merge_answers(model, gate)


@query("noul_threshold", sql="select correlation_id, subject_id, p_toxic >= 0.4 as at_default, p_toxic >= 0.6 as at_request, p_toxic >= 0.4 as at_half from answers")
def _(d):
    at = lambda r: F.col("p_toxic") >= G.noul_threshold(r)
    return d.answers.select("correlation_id", "subject_id", at(None).alias("at_default"), at(0.6).alias("at_request"), at(0.5).alias("at_half"))


# --- comparison over the answer tables --------------------------------------------------------------------------

FACTS = {
    "given": "select *, p_toxic as prominence_conf, 1 - p_toxic as sentiment_conf from answers where p_toxic >= 0.05",
    "sc": """select b.correlation_id, a.config_id, b.subject_id, s.name, b.is_valid as val_base, coalesce(g.p_valid, 0) >= 0.45 as val_cand, coalesce(g.p_valid, 0)::double as val_prob,
 b.prominence as prom_base, case when coalesce(g.p_valid, 0) >= 0.45 then coalesce(g.prominence, '') else 'passing' end as prom_cand, case when coalesce(g.p_valid, 0) >= 0.45 then g.prominence_conf else 1 end::double as prom_conf,
 b.sentiment as sent_base, case when coalesce(g.p_valid, 0) >= 0.45 then coalesce(g.sentiment, '') else 'neutral' end as sent_cand, case when coalesce(g.p_valid, 0) >= 0.45 then g.sentiment_conf else 1 end::double as sent_conf
 from baseline_subjects b join articles a using (correlation_id) join config_subjects s on s.config_id = a.config_id and s.subject_id = b.subject_id
 left join given g on g.correlation_id = b.correlation_id and g.subject_id = b.subject_id""",
    "scm": "select *, val_base = val_cand as val_match, prom_base = prom_cand as prom_match, sent_base = sent_cand as sent_match from sc",
    "tcm": """select *, base_result = cand_result as match from (select g.correlation_id, g.config_id, g.subject_id, t.tag_id, t.tag_name, coalesce(b.result, false) as base_result,
 coalesce(s.val_cand, false) and g.p_tag >= 0.4 as cand_result, g.p_tag as cand_prob
 from (select correlation_id, config_id, subject_id, 'toxic' as tag_id, p_toxic as p_tag from given union all select correlation_id, config_id, subject_id, 'long', p_valid from given
  union all select correlation_id, config_id, subject_id, 'kw', p_valid from given) g
 join config_tags t on t.config_id = g.config_id and t.subject_id = g.subject_id and t.tag_id = g.tag_id and t.evaluation_type = 'llm'
 left join sc s on s.correlation_id = g.correlation_id and s.subject_id = g.subject_id left join baseline_tags b on b.correlation_id = g.correlation_id and b.tag_id = g.tag_id)""",
}


def given(d):
    return d.answers.filter(F.col("p_toxic") >= 0.05).withColumn("prominence_conf", F.col("p_toxic")).withColumn("sentiment_conf", 1 - F.col("p_toxic"))


def subject_facts(d):
    base = d.baseline_subjects.join(d.articles.select("correlation_id", "config_id"), "correlation_id")
    return K.subject_comparison(d.config_subjects, base, given(d))


def tag_facts(d, subjects=None):
    a = given(d).select("correlation_id", "config_id", "subject_id", F.inline(F.array(
        F.struct(F.lit("toxic").alias("tag_id"), F.col("p_toxic").alias("p_tag")), F.struct(F.lit("long").alias("tag_id"), F.col("p_valid").alias("p_tag")),
        F.struct(F.lit("kw").alias("tag_id"), F.col("p_valid").alias("p_tag")))))
    return K.tag_comparison(d.config_tags, a, d.baseline_tags, subject_facts(d) if subjects is None else subjects)


@query("subject_comparison", sql="select * from scm", extra=FACTS)
def _(d):
    return subject_facts(d)


@query("compare_validation", sql="select correlation_id, subject_id, val_base, val_cand, val_prob, val_match from scm", extra=FACTS)
def _(d):
    return subject_facts(d).select("correlation_id", "subject_id", "val_base", "val_cand", "val_prob", "val_match")


@query("compare_prominence", sql="select correlation_id, subject_id, prom_base, prom_cand, prom_conf, prom_match from scm", extra=FACTS)
def _(d):
    return subject_facts(d).select("correlation_id", "subject_id", "prom_base", "prom_cand", "prom_conf", "prom_match")


@query("compare_sentiment", sql="select correlation_id, subject_id, sent_base, sent_cand, sent_conf, sent_match from scm", extra=FACTS)
def _(d):
    return subject_facts(d).select("correlation_id", "subject_id", "sent_base", "sent_cand", "sent_conf", "sent_match")


@query("tag_comparison", sql="select * from tcm", extra=FACTS)
def _(d):
    return tag_facts(d)


@query("compare_tags", sql="select tag_id, count(*) as n, count(*) filter (where match) as agree, count(*) filter (where base_result) as base_true, count(*) filter (where cand_result) as cand_true from tcm group by tag_id", extra=FACTS)
def _(d):
    return tag_facts(d).groupBy("tag_id").agg(F.count("*").alias("n"), F.count_if("match").alias("agree"), F.count_if("base_result").alias("base_true"), F.count_if("cand_result").alias("cand_true"))


def accuracy_sql(key: str, empty: str) -> str:
    p = lambda a, b: f"coalesce(round(case when {b} > 0 then {a} * 100.0::double / {b} end, 1), {empty})"
    return f"""select {key}, val_correct, prom_correct, sent_correct, subject_total, tag_correct, tag_total, {p('val_correct', 'subject_total')} as val_accuracy, {p('prom_correct', 'subject_total')} as prom_accuracy,
 {p('sent_correct', 'subject_total')} as sent_accuracy, {p('tag_correct', 'tag_total')} as tag_accuracy from (select {key}, sum(v)::bigint as val_correct, sum(p)::bigint as prom_correct, sum(s)::bigint as sent_correct, sum(n)::bigint as subject_total,
 sum(t)::bigint as tag_correct, sum(m)::bigint as tag_total from (select {key}, val_match::int v, prom_match::int p, sent_match::int s, 1 n, 0 t, 0 m from scm union all select {key}, 0,0,0,0, match::int, 1 from tcm) group by {key})"""


@query("article_metrics", sql=accuracy_sql("correlation_id", "100.0"), extra=FACTS)
def _(d):
    return K.article_metrics(subject_facts(d), tag_facts(d))


@query("agreement_by_config", sql=accuracy_sql("config_id", "null"), extra=FACTS)
def _(d):
    """Agreement of the given answers per configuration."""
    return K.accuracy(K.counts_long(subject_facts(d), tag_facts(d), ["config_id"]), ["config_id"])


# --- the full run over archived records ------------------------------------------------------------------------------

def archived(d):
    """Archived records with their decisions in the same row."""
    return archived_of(B.parse_blobs(q_sources.raw(d)))


def archived_of(parsed):
    every = F.flatten(F.transform(F.col("scored_attributes.tag_groups"), lambda g: g.tags))
    base_tags = L.last_wins(F.filter(every, lambda t: t.evaluation_type == "llm"), "tag_id")
    subjects = L.last_wins(F.col("subject_results"), "subject_id")
    return B.inbound(parsed, subjects.alias("subject_results"), base_tags.alias("base_tags"), *ARCHIVED)


ARCHIVED = ("llm_tokens", "llm_cached_tokens", "llm_cost_usd", "stage_timings", "validation_result")


def blob_run(d, configs=None):
    """Archived records through the cascade; the archived decision rides in the same row, so comparing needs no join."""
    return G.cascade(archived(d), sets(d) if configs is None else configs, S.hash_scorer, ("headline", "subject_results", "base_tags", *ARCHIVED), ("excluded_text",))


RUN = {
    **SCORED, **q_sources.EXTRA,
    "dec": "select * from decisions where correlation_id in (select correlation_id from kept)",
    "scm": """select *, val_base = val_cand as val_match, prom_base = prom_cand as prom_match, sent_base = sent_cand as sent_match from (
 select x.correlation_id, x.config_id, x.subject_id, x.name, b.is_valid as val_base, x.p_valid >= 0.45 as val_cand, x.p_valid as val_prob, b.prominence as prom_base,
 round(case when x.p_valid >= 0.45 then x.prominence_conf else 1 end, 6)::double as prom_conf, round(case when x.p_valid >= 0.45 then x.s_conf else 1 end, 6)::double as sent_conf,
 case when x.p_valid >= 0.45 then x.prominence else 'passing' end as prom_cand, b.sentiment as sent_base, case when x.p_valid >= 0.45 then x.sentiment else 'neutral' end as sent_cand
 from dec x join baseline_subjects b on b.correlation_id = x.correlation_id and b.subject_id = x.subject_id)""",
    "tcm": """select *, base_result = cand_result as match from (select x.correlation_id, x.config_id, x.subject_id, t.tag_id, coalesce(b.result, false) as base_result,
 coalesce(s.val_cand, false) and x.passed and case t.tag_id when 'toxic' then t_toxic else t_long end >= 0.4 as cand_result
 from dec x join (values ('toxic'), ('long')) as t(tag_id) on true left join scm s on s.correlation_id = x.correlation_id and s.subject_id = x.subject_id
 left join baseline_tags b on b.correlation_id = x.correlation_id and b.tag_id = t.tag_id)""",
}


RECORDS = {
    **RUN,
    "asked_counts": "select correlation_id, count(*) filter (where not certified) as n1, 4 * count(*) filter (where passed) as n2 from dec group by correlation_id",
    "subject_lists": """select correlation_id, count(*) as subject_total, count(*) filter (where val_match) as val_correct, count(*) filter (where prom_match) as prom_correct, count(*) filter (where sent_match) as sent_correct,
 string_agg('{"subject_id":"' || subject_id || '","is_valid":' || val_base || ',"prominence":"' || prom_base || '","sentiment":"' || sent_base || '"}', ',' order by subject_id) as js,
 string_agg(concat_ws('|', subject_id, name, val_base, val_cand, prom_base, prom_cand, sent_base, sent_cand, val_match, prom_match, sent_match), ';' order by subject_id) as txt from scm group by correlation_id""",
    "tag_lists": """select correlation_id, count(*) as tag_total, count(*) filter (where match) as tag_correct,
 string_agg('{"subject_id":"' || subject_id || '","tag_id":"' || tag_id || '","result":' || base_result || '}', ',' order by subject_id, tag_id desc) as js,
 string_agg(concat_ws('|', subject_id, tag_id, base_result, cand_result, match), ';' order by subject_id, tag_id desc) as txt from tcm group by correlation_id""",
    "totals": f"""select k.correlation_id, k.config_id, k.headline, case when k.doc_id % 3 = 2 then 0 else k.n_chars * 0.5 end::double as base_duration_ms, (c.n1 + c.n2) * 2.5::double as cand_duration_ms,
 case when k.doc_id % 10 = 0 then k.n_chars / 1e6 else 0.007 end::double as base_cost_usd, case when k.doc_id % 10 = 0 then 'recorded_in_blob' else 'flat_override' end as base_cost_source,
 greatest(0, k.n_chars - k.doc_id % 40 - round_even((length('Sum up the story for ' || k.config_id || '. Say why it was rejected.') + length({q(V.EXCLUDED_HEADINGS)})) / 4.0, 0)::bigint)::bigint as class_input_tokens,
 round_even(length('{{"validation_result":' || coalesce((k.quality = 1)::varchar, 'null') || ',"subjects":[' || coalesce(s.js, '') || '],"tags":[' || coalesce(t.js, '') || ']}}') / 4.0, 0)::bigint as class_output_tokens,
 (length(x.state) // 4 * ((c.n1 > 0)::int + (c.n2 > 0)::int))::bigint as cand_input_tokens, coalesce(s.val_correct, 0) as val_correct, coalesce(s.prom_correct, 0) as prom_correct, coalesce(s.sent_correct, 0) as sent_correct,
 coalesce(s.subject_total, 0) as subject_total, coalesce(t.tag_correct, 0) as tag_correct, coalesce(t.tag_total, 0) as tag_total, coalesce(s.txt, '') as subjects, coalesce(t.txt, '') as tags
 from kept k join states x using (correlation_id) left join asked_counts c using (correlation_id) left join subject_lists s using (correlation_id) left join tag_lists t using (correlation_id)""",
    "priced": "select *, class_input_tokens / 1e6 * 0.30::double + class_output_tokens / 1e6 * 2.50::double as base_class_cost_usd, cand_input_tokens / 1e6 * 0.042::double as cand_cost_usd from totals",
}
COSTS = """base_cost_source, round(base_cost_usd, 9) as base_cost_usd, class_input_tokens, class_output_tokens, round(base_class_cost_usd, 9) as base_class_cost_usd, round(cand_cost_usd, 9) as cand_cost_usd, cand_input_tokens, base_duration_ms, cand_duration_ms,
 case when base_duration_ms > 0 then round(base_duration_ms / greatest(cand_duration_ms, 1.0), 2) else 1.0 end::double as speedup_ratio, round(base_cost_usd - cand_cost_usd, 9) as savings_usd,
 case when base_cost_usd > 0 then round((base_cost_usd - cand_cost_usd) / greatest(base_cost_usd, 0.00001) * 100.0, 1) else 0 end::double as savings_pct, case when cand_cost_usd > 0 then round(base_class_cost_usd / greatest(cand_cost_usd, 0.00000001), 1) end as class_cost_multiple,
 case when base_class_cost_usd > 0 then round((base_class_cost_usd - cand_cost_usd) / greatest(base_class_cost_usd, 0.00000001) * 100.0, 1) else 0 end::double as class_savings_pct"""
COST_COLUMNS = ("base_cost_source", "base_cost_usd", "class_input_tokens", "class_output_tokens", "base_class_cost_usd", "cand_cost_usd", "cand_input_tokens", "base_duration_ms", "cand_duration_ms",
                "speedup_ratio", "savings_usd", "savings_pct", "class_cost_multiple", "class_savings_pct")


def costs(rows):
    return [F.round(c, 9).alias(c) if c in ("base_cost_usd", "base_class_cost_usd", "cand_cost_usd") else F.col(c) for c in COST_COLUMNS]


def listed(array: str, *fields):
    return F.coalesce(F.array_join(F.transform(array, lambda x: F.concat_ws("|", *[x[f].cast("string") for f in fields])), ";"), F.lit("")).alias(array.replace("_facts", "s"))


ACC4 = ", ".join(f"case when {n} > 0 then round({d}_correct * 100.0::double / {n}, 1) else 100.0 end::double as {d}_accuracy" for d, n in (("val", "subject_total"), ("prom", "subject_total"), ("sent", "subject_total"), ("tag", "tag_total")))


@query("compare_articles", sql=f"select correlation_id, config_id, headline, 'ok' as status, subjects, tags, val_correct, prom_correct, sent_correct, subject_total, tag_correct, tag_total, {ACC4}, {COSTS} from priced", extra=RECORDS)
def _(d):
    """The whole comparison record of each article: facts, accuracies, time and both costs."""
    r = K.comparison_records(blob_run(d))
    return r.select("correlation_id", "config_id", "headline", "status", listed("subject_facts", "subject_id", "name", "val_base", "val_cand", "prom_base", "prom_cand", "sent_base", "sent_cand", "val_match", "prom_match", "sent_match"),
                    listed("tag_facts", "subject_id", "tag_id", "base_result", "cand_result", "match"), "val_correct", "prom_correct", "sent_correct", "subject_total", "tag_correct", "tag_total",
                    "val_accuracy", "prom_accuracy", "sent_accuracy", "tag_accuracy", *costs(r))


@query("run_subject_facts", sql="""select correlation_id, config_id, subject_id, name, val_base, val_cand, val_prob, prom_base, prom_cand, prom_conf, sent_base, sent_cand, sent_conf, val_match, prom_match, sent_match from scm""", extra=RUN)
def _(d):
    s = K.compare_articles(blob_run(d))[0]
    return s.withColumn("prom_conf", F.round("prom_conf", 6)).withColumn("sent_conf", F.round("sent_conf", 6))


@query("run_tag_facts", sql="select correlation_id, config_id, subject_id, tag_id, base_result, cand_result, match from tcm", extra=RUN)
def _(d):
    return K.compare_articles(blob_run(d))[1].drop("cand_prob")


@query("candidate_outputs", sql="""select k.correlation_id, coalesce(txt, '') as subjects from kept k left join (select correlation_id, string_agg(concat_ws('|', subject_id, name, val_cand, prom_cand, prom_conf, sent_cand, sent_conf, tags), ';' order by subject_id) as txt
 from scm join (select correlation_id, subject_id, string_agg(tag_id || '=' || cand_result, ',' order by tag_id desc) as tags from tcm group by all) using (correlation_id, subject_id) group by correlation_id) using (correlation_id)""", extra=RUN)
def _(d):
    """The candidate's decision in the layout of the archived one."""
    v = K.candidate_view(K.article_facts(blob_run(d)))
    tags = lambda s: F.array_join(F.transform(s.tags, lambda t: F.concat(t.tag_id, F.lit("="), t.result.cast("string"))), ",")
    conf = lambda c: F.round(c, 6).cast("string")
    return v.select("correlation_id", F.coalesce(F.array_join(F.transform("subjects", lambda s: F.concat_ws(
        "|", s.subject_id, s["name"], s.is_valid.cast("string"), s.prominence, conf(s.prominence_confidence), s.sentiment, conf(s.sentiment_confidence), tags(s))), ";"), F.lit("")).alias("subjects"))


MISSING = "src3"


@query("scored_run_records", sql=f"""select k.correlation_id, k.config_id, case when k.config_id = '{MISSING}' then 'skipped' else 'ok' end as status, case when k.config_id = '{MISSING}' then 'no published configuration' end as reason,
 case when k.config_id = '{MISSING}' then 0 else coalesce(s.n, 0) end as subject_total, case when k.config_id = '{MISSING}' then 0 else coalesce(t.n, 0) end as tag_total, case when k.config_id <> '{MISSING}' then 'priced' else 'free' end as cost
 from kept k left join (select correlation_id, count(*) as n from scm group by 1) s using (correlation_id) left join (select correlation_id, count(*) as n from tcm group by 1) t using (correlation_id)""", extra=RUN)
def _(d):
    """Every archived record of a run in which one configuration can't be resolved: its articles stay, as skipped ones."""
    r = K.comparison_records(blob_run(d, sets(d).filter(F.col("config_id") != MISSING)))
    return r.select("correlation_id", "config_id", "status", F.when(F.col("status") == "skipped", "no published configuration").alias("reason"), "subject_total", "tag_total",
                    F.when(F.col("cand_cost_usd").isNull(), "free").otherwise("priced").alias("cost"))


@query("run_summary", sql=accuracy_sql("config_id", "null"), extra=RUN)
def _(d):
    """Flagship: archived records to agreement per configuration, scored once and summed with map-side combine."""
    return K.accuracy(run_counts_both(d), ["config_id"])


def run_counts_both(d):
    """Subject and tag counts of one scored run from one pass over its rows."""
    return K.run_counts_once(blob_run(d), ["config_id"])


@query("article_cost", sql=f"select correlation_id, config_id, {COSTS} from priced", extra=RECORDS)
def _(d):
    r = K.article_cost_rows(K.article_facts(blob_run(d)))
    return r.select("correlation_id", "config_id", *costs(r))


# --- cost and run summaries over the usage records ------------------------------------------------------------------

CLASS_JSON = """'{"validation_result":null,"subjects":[{"subject_id":"' || config_id || '","is_valid":' || (article_no % 2 = 0)::varchar || ',"prominence":null}],"tags":[{"tag_id":"' || cache_key || '","result":true}]}'"""
PERF = {"perf": f"""select article_no, run_id, config_id, status, base_duration_ms, cand_duration_ms, coalesce(base_cost_recorded, 0.007)::double as base_cost_usd, case when base_cost_recorded is not null then 'recorded_in_blob' else 'flat_override' end as base_cost_source,
 greatest(0, input_tokens - cached_tokens - round_even((length(cache_key) + length({q(V.EXCLUDED_HEADINGS)})) / 4.0, 0)::bigint) / 1e6 * 0.30::double + round_even(length({CLASS_JSON}) / 4.0, 0)::bigint / 1e6 * 2.50::double as base_class_cost_usd,
 cand_input_tokens / 1e6 * 0.042::double as cand_cost_usd from usage"""}


def perf(d):
    u = d.usage
    cost, source = K.baseline_cost(F.col("base_cost_recorded"), F.col("input_tokens"), F.col("output_tokens"))
    reply = K.classification_json(F.lit(None), F.array(F.struct(F.col("config_id").alias("subject_id"), (F.col("article_no") % 2 == 0).alias("is_valid"), F.lit(None).cast("string").alias("prominence"))),
                                  F.array(F.struct(F.col("cache_key").alias("tag_id"), F.lit(True).alias("result"))))
    return u.select("article_no", "run_id", "config_id", "status", "base_duration_ms", "cand_duration_ms", cost.alias("base_cost_usd"), source.alias("base_cost_source"),
                    K.classification_cost(F.col("input_tokens"), F.col("cached_tokens"), F.col("cache_key"), reply).alias("base_class_cost_usd"),
                    L.usage_cost(F.col("cand_input_tokens")).alias("cand_cost_usd"))


@query("baseline_cost", sql="""select article_no, coalesce(base_cost_recorded, 0.007)::double as flat_cost, case when base_cost_recorded is not null then 'recorded_in_blob' else 'flat_override' end as flat_source,
 coalesce(base_cost_recorded, 0.02)::double as override_cost, case when base_cost_recorded is not null then 'recorded_in_blob' else 'request_override' end as override_source,
 round(coalesce(base_cost_recorded, input_tokens / 1e6 * 0.3::double + output_tokens / 1e6 * 2.5::double), 9) as token_cost, case when base_cost_recorded is not null then 'recorded_in_blob' else 'token_estimate' end as token_source from usage""")
def _(d):
    r, i, o = F.col("base_cost_recorded"), F.col("input_tokens"), F.col("output_tokens")
    (a, sa), (b, sb), (c, sc) = K.baseline_cost(r, i, o), K.baseline_cost(r, i, o, override=0.02), K.baseline_cost(r, i, o, flat=0.0)
    return d.usage.select("article_no", a.alias("flat_cost"), sa.alias("flat_source"), b.alias("override_cost"), sb.alias("override_source"), F.round(c, 9).alias("token_cost"), sc.alias("token_source"))


@query("classification_cost", sql="select article_no, round(base_class_cost_usd, 9) as base_class_cost_usd from perf", extra=PERF)
def _(d):
    return perf(d).select("article_no", F.round("base_class_cost_usd", 9).alias("base_class_cost_usd"))


@query("article_performance", sql="""select article_no, case when base_duration_ms > 0 then round(base_duration_ms / greatest(cand_duration_ms, 1.0), 2) else 1.0 end::double as speedup_ratio, round(base_cost_usd - cand_cost_usd, 9) as savings_usd,
 case when base_cost_usd > 0 then round((base_cost_usd - cand_cost_usd) / greatest(base_cost_usd, 0.00001) * 100.0, 1) else 0 end::double as savings_pct from perf""", extra=PERF)
def _(d):
    return K.article_performance(perf(d)).select("article_no", "speedup_ratio", "savings_usd", "savings_pct")


@query("run_latency", sql="""select run_id, articles, avg_base_ms, avg_cand_ms, case when avg_base_ms > 0 then round(avg_base_ms / greatest(avg_cand_ms, 1.0), 2) else 1.0 end::double as speedup from (
 select run_id, count(*) as articles, round(sum(base_duration_ms) / count(*), 2) as avg_base_ms, round(sum(cand_duration_ms) / count(*), 2) as avg_cand_ms from perf where status = 'ok' group by run_id)""", extra=PERF)
def _(d):
    return R.run_latency(R.run_totals(perf(d).filter("status = 'ok'"), ["run_id"]), ["run_id"])


@query("run_cost", sql="""select run_id, round(b, 6) as base_cost_usd, round(k, 6) as base_class_cost_usd, round(c, 6) as cand_cost_usd, round(b - c, 6) as savings_usd, round((b - c) / greatest(b, 0.00001) * 100.0, 1) as savings_pct,
 round(b / c, 1) as cost_multiple, round((k - c) / greatest(k, 0.00001) * 100.0, 1) as class_savings_pct, round(k / greatest(c, 0.00000001), 1) as class_cost_multiple
 from (select run_id, sum(base_cost_usd) b, sum(cand_cost_usd) c, sum(base_class_cost_usd) k from perf where status = 'ok' group by run_id)""", extra=PERF)
def _(d):
    return R.run_cost(R.run_totals(perf(d).filter("status = 'ok'"), ["run_id"]), ["run_id"])


@query("run_counts", sql="""select run_id, count(*) as records, count(*) filter (where status = 'ok') as total_articles, count(*) filter (where status = 'failed') as failed,
 count(*) filter (where status = 'skipped') as skipped, count(*) filter (where status = 'ok') > 0 as evaluated from usage group by run_id""")
def _(d):
    return R.run_counts(d.usage, ["run_id"])


RECORD = """select run_id, config_id, scope, records, articles, failed, skipped, avg_base_ms, avg_cand_ms, case when avg_base_ms > 0 then round(avg_base_ms / greatest(avg_cand_ms, 1.0), 2) else 1.0 end::double as speedup,
 round(b, 6) as base_cost_usd, round(k, 6) as base_class_cost_usd, round(c, 6) as cand_cost_usd, round(b - c, 6) as savings_usd, case when b > 0 then round((b - c) / greatest(b, 0.00001) * 100.0, 1) else 0 end::double as savings_pct,
 case when c > 0 then round(b / c, 1) end as cost_multiple, case when k > 0 then round((k - c) / greatest(k, 0.00001) * 100.0, 1) else 0 end::double as class_savings_pct, case when c > 0 then round(k / greatest(c, 0.00000001), 1) end as class_cost_multiple
 from (select run_id, config_id, case when grouping(config_id) = 1 then 'run' else 'config' end as scope, count(*) as records, count(*) filter (where status = 'ok') as articles, count(*) filter (where status = 'failed') as failed,
 count(*) filter (where status = 'skipped') as skipped, round(coalesce(sum(base_duration_ms::decimal(28,12)) filter (where status = 'ok'), 0)::double / greatest(count(*) filter (where status = 'ok'), 1), 2) as avg_base_ms,
 round(coalesce(sum(cand_duration_ms::decimal(28,12)) filter (where status = 'ok'), 0)::double / greatest(count(*) filter (where status = 'ok'), 1), 2) as avg_cand_ms, coalesce(sum(base_cost_usd::decimal(28,12)) filter (where status = 'ok'), 0)::double as b,
 coalesce(sum(cand_cost_usd::decimal(28,12)) filter (where status = 'ok'), 0)::double as c, coalesce(sum(base_class_cost_usd::decimal(28,12)) filter (where status = 'ok'), 0)::double as k from perf group by grouping sets ((run_id, config_id), (run_id)))"""


@query("run_record", sql=RECORD, extra=PERF)
def _(d):
    return R.run_record(perf(d))


@query("optimizer_summary", sql="""select run_id, count(*) as configs_compiled, round(sum(output_tokens / 1e5), 6) as cost_usd, round(sum(base_duration_ms), 2) as duration_ms, sum(input_tokens)::bigint as chars_before, sum(cand_input_tokens)::bigint as chars_after,
 round((sum(input_tokens) - sum(cand_input_tokens)) * 100.0::double / sum(input_tokens), 1) as reduction_pct from (select *, row_number() over (partition by run_id, cache_key order by article_no desc) rn from usage) where rn = 1 group by run_id""")
def _(d):
    r = d.usage.select("run_id", "cache_key", F.col("article_no").alias("pos"), (F.col("output_tokens") / 1e5).alias("cost_usd"), F.col("base_duration_ms").alias("duration_ms"),
                       F.col("input_tokens").alias("chars_before"), F.col("cand_input_tokens").alias("chars_after"))
    return R.optimizer_summary(r, ["run_id"])


@query("progress_by_config", sql="select run_id, config_id, count(*) as total, count(distinct article_no) filter (where status = 'ok') as done from usage group by run_id, config_id")
def _(d):
    return R.progress_by_config(d.usage, d.usage)


def run_events(d):
    return d.usage.select("run_id", F.col("recorded_at").alias("ts"), F.col("article_no").alias("seq"), F.when(F.col("status") == "ok", "completed").otherwise("in_progress").alias("status"))


EVENTS = {"ev": "select run_id, recorded_at as ts, article_no as seq, case when status = 'ok' then 'completed' else 'in_progress' end as status from usage",
          "status_now": """select run_id, min(ts) as created_at, (array_agg(status order by ts desc, seq desc))[1] as status, max(case when status = 'completed' then ts end) as completed_at from ev group by run_id"""}


@query("run_status", sql="select * from status_now", extra=EVENTS)
def _(d):
    return R.run_status(run_events(d))


@query("list_runs", sql="""select s.run_id, s.status, c.total_articles from status_now s full join (select run_id, count(*) as total_articles from usage where status = 'ok' group by run_id) c using (run_id)""", extra=EVENTS)
def _(d):
    summary = d.usage.filter("status = 'ok'").groupBy("run_id").agg(F.count("*").alias("total_articles"))
    return R.list_runs(R.run_status(run_events(d)).select("run_id", "status"), summary)


@query("get_run", sql="select article_no, config_id, status from usage where run_id = '2-HIGH'")
def _(d):
    return R.get_run(d.usage, "2-HIGH").select("article_no", "config_id", "status")


@query("prune_runs", sql="select article_no, run_id from usage where run_id not in (select run_id from status_now where run_id < '4' and status <> 'in_progress')", extra=EVENTS)
def _(d):
    """Runs are deleted from the stored records, folders and all; what is left is read from the store."""
    rows = d.usage.select("article_no", "run_id", "status")
    store = R.write_records(rows, work_path(d.spark, "records"), ["article_no"])
    status = R.run_status(run_events(d))
    R.prune_runs(store, status.filter("run_id < '4'"), status.filter("status = 'in_progress'"))
    return store.read().select("article_no", "run_id")


# --- discrepancies ---------------------------------------------------------------------------------------------------

LONG = """select correlation_id, config_id, name as item, 'validation' as dimension, val_base::varchar as base, val_cand::varchar as cand, val_match as match from scm
 union all select correlation_id, config_id, name, 'prominence', prom_base, prom_cand, prom_match from scm union all select correlation_id, config_id, name, 'sentiment', sent_base, sent_cand, sent_match from scm
 union all select correlation_id, config_id, tag_name, 'tag', base_result::varchar, cand_result::varchar, match from tcm"""
ISSUES = {**FACTS, "pairs": LONG, "mism": "select * from pairs where not match and base is distinct from cand",
          "failures": "select correlation_id from articles where n_chars < 300 and correlation_id not in (select correlation_id from mism)",
          "issues": f"""select correlation_id, {', '.join(f"count(*) filter (where dimension = '{k}') as n_{k}" for k in V.DECISION_KINDS)}, 'disagreement' as type from mism group by correlation_id
 union all select correlation_id, 0, 0, 0, 0, 'execution_failure' from failures"""}


def mismatches(d):
    """Subject facts are written once; tags read them instead of comparing again."""
    s = written(subject_facts(d), "subject-facts")
    return A.mismatch_long(s, tag_facts(d, s))


def issue_parts(d):
    """Mismatches, written once, and the failed articles among which none is."""
    m = written(mismatches(d), "mismatches")
    failed = d.articles.filter("n_chars < 300").select("correlation_id", F.concat(F.lit("only "), F.col("n_chars").cast("string"), F.lit(" characters")).alias("error"))
    return m, failed.join(m, "correlation_id", "left_anti")


def issues(d):
    return A.find_discrepancies(*issue_parts(d))


@query("mismatch_long", sql="select * from mism", extra=ISSUES)
def _(d):
    return mismatches(d)


@query("find_discrepancies", sql="select * from issues", extra=ISSUES)
def _(d):
    return issues(d)


@query("discrepancy_records", sql="""with lists as (select correlation_id, count(*) as n_mismatches, string_agg(x, ';' order by x) as mismatches from (
 select correlation_id, dimension || '|' || item || '|' || coalesce(base, '-') || '|' || coalesce(cand, '-') as x from mism) group by correlation_id)
 select a.correlation_id, a.config_id, a.headline, i.type, coalesce(l.n_mismatches, 0)::int as n_mismatches, coalesce(l.mismatches, '') as mismatches,
 case when i.type = 'execution_failure' then 'only ' || a.n_chars || ' characters' end as error from issues i join articles a using (correlation_id) left join lists l using (correlation_id)""", extra=ISSUES)
def _(d):
    """What differed in each article, in full."""
    text = F.transform("mismatches", lambda x: F.concat_ws("|", x.dimension, x["item"], F.coalesce(x.base, F.lit("-")), F.coalesce(x.cand, F.lit("-"))))
    r = A.discrepancy_records(*issue_parts(d), d.articles)
    return r.select("correlation_id", "config_id", "headline", "type", F.size("mismatches").alias("n_mismatches"), F.array_join(F.array_sort(text), ";").alias("mismatches"), "error")


@query("first_n_disagreements", sql="select correlation_id, n_validation from issues where type = 'disagreement' order by correlation_id limit 25", extra=ISSUES)
def _(d):
    return A.first_n(issues(d).filter("type = 'disagreement'"), 25).select("correlation_id", "n_validation")


NULLED = {**ISSUES, "nulled": "select correlation_id, dimension, case when dimension = 'prominence' and base = 'passing' then null else base end as base, case when dimension = 'prominence' and cand = 'passing' then null else cand end as cand, match and not (dimension = 'prominence' and base = 'passing') as match from pairs"}


def nulled(d):
    s, t = subject_facts(d), tag_facts(d)
    every = A.mismatch_long(s, t, hygiene=False)
    same = A.mismatch_long(s.withColumn("val_match", ~F.col("val_match")).withColumn("prom_match", ~F.col("prom_match")).withColumn("sent_match", ~F.col("sent_match")),
                           t.withColumn("match", ~F.col("match")), hygiene=False).withColumn("match", F.lit(True))
    rows = every.unionByName(same)
    gone = lambda c: F.when((F.col("dimension") == "prominence") & (F.col(c) == "passing"), None).otherwise(F.col(c)).alias(c)
    return rows.select("correlation_id", "dimension", gone("base"), gone("cand"),
                       (F.col("match") & ~((F.col("dimension") == "prominence") & (F.col("base") == "passing"))).alias("match"))


@query("null_hygiene", sql="select correlation_id, dimension, base, cand, match from nulled where not match and (base is not null or cand is not null) and base is distinct from cand", extra=NULLED)
def _(d):
    return A.null_hygiene(nulled(d))


@query("noise_reduction", sql="select count(*) filter (where not match) as before, count(*) filter (where not match and base is distinct from cand) as after from nulled", extra=NULLED)
def _(d):
    return A.noise_reduction(nulled(d))


PREF = "case when " + "{b} < 50 then 'cand' when {b} < 80 then 'base' when {b} < 90 then 'both' end"
VERD = {**ISSUES, "verdicts": f"select correlation_id, preferred from (select correlation_id, {PREF.format(b=bucket(chr(39) + 'arb|' + chr(39) + '||correlation_id'))} as preferred from articles) where preferred is not null"}


def verdicts(d):
    from assayer.sources.tables import keyed
    b = keyed("arb", F.col("correlation_id"))
    p = F.when(b < 50, "cand").when(b < 80, "base").when(b < 90, "both")
    return d.articles.select("correlation_id", "config_id", p.alias("preferred")).filter(F.col("preferred").isNotNull())


@query("arbitration_counts", sql="""select config_id, count(*) filter (where preferred = 'base') as base_preferred, count(*) filter (where preferred = 'cand') as cand_preferred,
 count(*) filter (where preferred = 'both') as ties from verdicts join articles using (correlation_id) group by config_id""", extra=VERD)
def _(d):
    return A.arbitration_counts(verdicts(d), ["config_id"])


@query("analysis_rollup", sql="""select count(*) as total_issues, count(*) filter (where d) as disagreements, count(*) filter (where not d) as failures, count(*) filter (where d and preferred is not null) as sample_analyzed,
 count(*) filter (where d and preferred = 'base') as base_preferred, count(*) filter (where d and preferred = 'cand') as cand_preferred, count(*) filter (where d and preferred = 'both') as ties
 from (select i.*, type = 'disagreement' as d, v.preferred from issues i left join verdicts v using (correlation_id))""", extra=VERD)
def _(d):
    return A.analysis_rollup(issues(d), verdicts(d).drop("config_id"))


VIEWS6 = ("candidate", "baseline", "tie", "prominence", "sentiment", "tag")


@query("filter_evaluations", sql="""with e as (select i.*, v.preferred from issues i left join verdicts v using (correlation_id) where type = 'disagreement')
 select 'candidate' as report, correlation_id from e where preferred = 'cand' union all select 'baseline', correlation_id from e where preferred = 'base'
 union all select 'tie', correlation_id from e where coalesce(preferred, '') not in ('base','cand') union all select 'prominence', correlation_id from e where n_prominence > 0
 union all select 'sentiment', correlation_id from e where n_sentiment > 0 union all select 'tag', correlation_id from e where n_tag > 0""", extra=VERD)
def _(d):
    from assayer.operators.sampling import union_all
    dims = F.filter(F.array(*[F.when(F.col(f"n_{k}") > 0, k) for k in V.DECISION_KINDS]), lambda x: x.isNotNull())
    e = issues(d).filter("type = 'disagreement'").join(verdicts(d).drop("config_id"), "correlation_id", "left").select(
        "correlation_id", "preferred", dims.alias("mismatch_dims"), F.array().cast("array<string>").alias("verdict_dims"), "n_tag")
    return union_all(*[A.filter_evaluations(e, v).select(F.lit(v).alias("report"), "correlation_id") for v in VIEWS6])


@query("confusion_matrix", sql="""select 'prominence' as dimension, prom_base as base, prom_cand as cand, count(*) as n from scm group by all
 union all select 'sentiment', sent_base, sent_cand, count(*) from scm group by all""", extra=FACTS)
def _(d):
    return A.confusion_matrix(subject_facts(d))


@query("confidence_buckets", sql="select least(floor(prom_conf * 10), 9)::int as decile, count(*) as n, count(*) filter (where prom_match) as agree, round(count(*) filter (where prom_match) * 100.0::double / count(*), 1) as agreement_pct from scm group by 1", extra=FACTS)
def _(d):
    return A.confidence_buckets(subject_facts(d), "prom_conf", "prom_match")


@query("disagreement_by_subject_label", sql="""select name, dimension, label, count(*) as n, count(*) filter (where not m) as differ, round(count(*) filter (where not m) * 100.0::double / count(*), 1) as differ_pct from (
 select name, 'prominence' as dimension, prom_base as label, prom_match as m from scm union all select name, 'sentiment', sent_base, sent_match from scm) group by all""", extra=FACTS)
def _(d):
    return A.disagreement_by_subject_label(subject_facts(d))


GRID = [i / 20 for i in range(1, 20)]


@query("threshold_sweep", sql=f"""select t.t::double as threshold, count(*) as n, count(*) filter (where (val_prob >= t.t::double) = val_base) as agree, round(count(*) filter (where (val_prob >= t.t::double) = val_base) * 100.0::double / count(*), 2) as agreement_pct
 from scm cross join (values {', '.join(f'({t}::double)' for t in GRID)}) as t(t) group by t.t""", extra=FACTS)
def _(d):
    return A.threshold_sweep(subject_facts(d), "val_prob", "val_base", GRID)


@query("human_agreement", sql="""select count(*) as n, count(*) filter (where (l.quality = 1) = s.val_base) as base_agree, count(*) filter (where (l.quality = 1) = s.val_cand) as cand_agree, count(*) filter (where s.val_base = s.val_cand) as mutual_agree
 from scm s join labels l on s.correlation_id = 'c'||l.doc_id""", extra=FACTS)
def _(d):
    human = d.table("labels").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("correlation_id"), (F.col("quality") == 1).alias("human"))
    s = subject_facts(d).join(human, "correlation_id")
    return A.human_agreement(s.select("human", F.col("val_base").alias("base"), F.col("val_cand").alias("cand")))
