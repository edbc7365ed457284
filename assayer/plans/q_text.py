"""Text, name and literal expressions over whole documents, pages and names."""

from pyspark.sql import functions as F

from assayer import fixed_values as V
from assayer.functions import labels as L, text as X
from assayer.operators import questions as Q
from assayer.operators.joins import join_by_size
from assayer.plans.registry import query
from assayer.plans.views_sql import WS, q, strip, words_in
from assayer.sources import configs as C

HEADINGS = f"""regexp_replace(regexp_replace(t, '\\r\\n|[\\n\\x{{0B}}\\x{{0C}}\\r\\x{{1C}}-\\x{{1E}}\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), '(?m)^[ \\t\\x{{1F}}\\p{{Zs}}]*#+[ \\t\\x{{1F}}\\p{{Zs}}]*', '', 'g')"""


def heading_sql(c: str) -> str:
    return strip(HEADINGS.replace("(t,", f"(coalesce({c}, ''),"))


PARAS = f"list_filter(list_transform(string_split(body, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"
STATE = """'Headline: ' || headline || repeat(chr(10), 3) || 'Lead Paragraph:' || chr(10) || coalesce(p[1], '') || repeat(chr(10), 2) || 'Article Body:' || chr(10)
 || array_to_string(p[2:], repeat(chr(10), 2))"""
STATES = {"states": f"select *, {STATE} as state from (select *, {PARAS} as p from articles)"}

ROUGH = """select conv_id, turn, case turn % 4 when 0 then '## ' || text when 1 then '  # ' || replace(text, chr(10), chr(28) || chr(160) || chr(8195) || '### ') when 2 then chr(9) || text || chr(10) else text end as t from conversations"""


@query("sanitize_heading", sql=f"select conv_id, turn, md5({heading_sql('t')}) as clean_md5 from rough", extra={"rough": ROUGH})
def _(d):
    t, k = F.col("text"), F.col("turn") % 4
    rough = (F.when(k == 0, F.concat(F.lit("## "), t)).when(k == 1, F.concat(F.lit("  # "), F.regexp_replace(t, "\n", "\x1c\xa0\u2003### ")))
             .when(k == 2, F.concat(F.lit("\t"), t, F.lit("\n"))).otherwise(t))
    return d.table("conversations").select("conv_id", "turn", F.md5(X.sanitize_heading(rough)).alias("clean_md5"))


@query("paragraphs", sql=f"select correlation_id, len(p) as n, md5(array_to_string(p, '|')) as joined_md5 from (select correlation_id, {PARAS} as p from articles)")
def _(d):
    p = X.paragraphs(F.col("body"))
    return d.articles.select("correlation_id", F.size(p).cast("bigint").alias("n"), F.md5(F.array_join(p, "|")).alias("joined_md5"))


@query("distilled_state", sql=f"select correlation_id, length(left(state, {V.STATE_MAX_CHARS})) as n, md5(left(state, {V.STATE_MAX_CHARS})) as state_md5 from states", extra=STATES)
def _(d):
    """The one query that shows the cut to a model's budget; everything else takes whole texts."""
    a = d.articles.select("correlation_id", X.distilled_state(F.col("headline"), F.col("body"), V.STATE_MAX_CHARS).alias("s"))
    return a.select("correlation_id", F.length("s").alias("n"), F.md5("s").alias("state_md5"))


@query("full_state", sql=f"""select correlation_id, is_clip, length(body) as body_length, md5(case when length(s) > 20000 then left(s, 20000) || {q(V.FULL_STATE_NOTICE)} else s end) as state_md5 from (
 select *, lower(media_type) in ('radio','television','tv') as is_clip, 'Item Type: ' || case when lower(media_type) in ('radio','television','tv') then 'clip (broadcast transcript)' else 'written article' end || chr(10)
 || case when config_id = 'src1' then '' else 'Source: ' || config_id || chr(10) end || 'Published: d' || doc_id || chr(10)
 || chr(10) || 'Headline: ' || headline || chr(10) || chr(10) || 'Body:' || chr(10) || body as s from articles)""")
def _(d):
    source = F.when(F.col("config_id") == "src1", "").otherwise(F.col("config_id"))
    s = X.full_state(F.col("headline"), F.col("body"), F.col("media_type"), source, F.concat(F.lit("d"), F.col("doc_id").cast("string")), 20_000)
    return d.articles.select("correlation_id", X.is_clip(F.col("media_type")).alias("is_clip"), F.length("body").alias("body_length"), F.md5(s).alias("state_md5"))


def byline_sql(c: str) -> str:
    for _, p in V.BYLINES:
        c = f"regexp_replace({c}, {q(p)}, '', 'g')"
    return c


# bodies decorated with credits, bylines and closing lines, so that every cleaning rule has work
NOISY = """select correlation_id, doc_id, headline, body || case doc_id % 5 when 0 then chr(10) || 'Photo: A. Nonymous, 2024' when 1 then chr(10) || 'By: Jane Doe' || chr(10) || 'More text'
 when 2 then chr(10) || 'desk.01 || 2024-05-06 10:00 wire' when 3 then chr(10) || 'x-1 || 9:30 update' else '' end
 || case doc_id % 6 when 0 then chr(10) || 'Read more: other story' || chr(10) || 'tail' when 1 then chr(10) || 'Read more' when 2 then chr(10) || '• Related: this' || chr(10) || 'Also on - that'
 when 3 then chr(10) || 'Newsletter sign up' else '' end as body from articles"""


def noisy(d):
    k5, k6, nl = F.col("doc_id") % 5, F.col("doc_id") % 6, "\n"
    one = (F.when(k5 == 0, "\nPhoto: A. Nonymous, 2024").when(k5 == 1, "\nBy: Jane Doe\nMore text").when(k5 == 2, "\ndesk.01 || 2024-05-06 10:00 wire")
           .when(k5 == 3, "\nx-1 || 9:30 update").otherwise(""))
    two = (F.when(k6 == 0, "\nRead more: other story\ntail").when(k6 == 1, "\nRead more").when(k6 == 2, "\n• Related: this\nAlso on - that")
           .when(k6 == 3, "\nNewsletter sign up").otherwise(""))
    return d.articles_spread.select("correlation_id", "doc_id", "headline", F.concat("body", one, two).alias("body"))


@query("strip_bylines", sql=f"select correlation_id, length(b) as n, md5(b) as body_md5 from (select correlation_id, {byline_sql('body')} as b from noisy)", extra={"noisy": NOISY})
def _(d):
    b = noisy(d).select("correlation_id", X.strip_bylines(F.col("body")).alias("b"))
    return b.select("correlation_id", F.length("b").alias("n"), F.md5("b").alias("body_md5"))


BULLET = f"((starts_with(x, '•') or starts_with(x, '*') or starts_with(x, '-')) and {words_in('lower(x)', V.BULLET_WORDS)})"
CLEAN = f"""select correlation_id, doc_id, headline, case when len(p) <= 2 then body else array_to_string(p[1:coalesce(list_min(list_filter(range(greatest(3, len(p) - 6), len(p) + 1),
 lambda i: regexp_matches(p[i], {q(V.FOOTER)}) or {BULLET.replace('x,', 'p[i],').replace('lower(x)', 'lower(p[i])')})) - 1, len(p))], repeat(chr(10), 2)) end as clean
 from (select *, {PARAS} as p from (select correlation_id, doc_id, headline, {byline_sql('body')} as body from noisy))"""


@query("cut_footer", sql="select correlation_id, length(clean) as n, md5(clean) as body_md5 from cleaned", extra={"noisy": NOISY, "cleaned": CLEAN})
def _(d):
    b = noisy(d).select("correlation_id", X.clean_body(F.col("body")).alias("b"))
    return b.select("correlation_id", F.length("b").alias("n"), F.md5("b").alias("body_md5"))


def canon_sql(n: str) -> str:
    bare = f"regexp_replace({strip(f'regexp_replace({strip(n)}, {q(V.PARENTHETICAL)}, {q(chr(32))}, {q(chr(103))})')}, '^[ \\t\\-–—:,]+|[ \\t\\-–—:,]+$', '', 'g')"
    return f"coalesce(nullif({bare}, ''), {strip(n)})"


def base_sql(n: str) -> str:
    return strip(f"regexp_replace({canon_sql(n)}, {q(V.CORP_SUFFIX)}, '', 'g')")


GENERIC = "(" + ", ".join(q(w) for w in V.NON_DISTINCTIVE_TOKENS) + ")"
PARTS = "list_filter(list_transform(string_split(@c, '-'), lambda x: " + strip("x") + "), lambda x: length(x) >= 3 and lower(x) not in " + GENERIC + ")"
STRICT = f"""list_distinct(list_filter([canon] || case when length(base) > 2 then [base] else [] end
 || list_filter(list_transform(regexp_extract_all(name, {q(V.PARENTHETICAL)}, 1), lambda x: {strip('x')}), lambda x: length(x) between 2 and 10 and not contains(x, ' ') and len(regexp_extract_all(x, '\\p{{Lu}}')) >= 2)
 || case when contains(canon, '-') and not starts_with(canon, '-') then {PARTS.replace('@c', 'canon')} else [] end
 || case when contains(base, '-') and not starts_with(base, '-') then {PARTS.replace('@c', 'base')} else [] end, lambda x: length(x) >= 2))"""
WORDS = f"list_filter(regexp_extract_all(coalesce(nullif(base, ''), canon), '[\\p{{L}}\\p{{M}}\\p{{N}}_&''’+.]+'), lambda x: length(x) >= 4 and lower(x) not in {GENERIC})"
NAMES = {
    "names": f"select *, {canon_sql('name')} as canon, {base_sql('name')} as base from policy_subjects",
    "terms": f"select config_id, subject_id, {STRICT} as strict, list_distinct({STRICT} || {WORDS}) as presence from names",
}
ORDERED = "array_to_string(list_transform(list_sort(list_transform({c}, lambda x: {{'k': -length(x), 't': x}})), lambda x: x.t), '|')"


@query("canonical_name", sql="select subject_id, canon as canonical, base as base_name from names", extra=NAMES)
def _(d):
    return d.policy_subjects.select("subject_id", X.canonical_name(F.col("name")).alias("canonical"), X.base_name(F.col("name")).alias("base_name"))


@query("match_terms", sql=f"select subject_id, {ORDERED.format(c='strict')} as terms from terms", extra=NAMES)
def _(d):
    return d.policy_subjects.select("subject_id", F.array_join(X.match_terms(F.col("name")), "|").alias("terms"))


@query("presence_terms", sql=f"select subject_id, {ORDERED.format(c='presence')} as terms from terms", extra=NAMES)
def _(d):
    return d.policy_subjects.select("subject_id", F.array_join(X.presence_terms(F.col("name")), "|").alias("terms"))


@query("adversity_flag", sql=f"select doc_id, {words_in('lower(text)', V.ADVERSITY_MARKERS)} as adversity from documents")
def _(d):
    return d.table("documents").select("doc_id", X.adversity(F.lower("text")).alias("adversity"))


GUARD = f"""case when {words_in('lower(tag_name)', V.PARTNER_WORDS)} then {q(V.PARTNER_GUARD)} when {words_in('lower(tag_name)', V.DEVELOPER_WORDS)} then {q(V.DEVELOPER_GUARD)}
 when lower(tag_name) = 'ai' or contains(lower(tag_name), 'artificial intelligence') then {q(V.AI_GUARD)} else '' end"""


@query("tag_guardrail", sql=f"select subject_id, tag_id, {GUARD} as guard from policy_tags")
def _(d):
    return d.policy_tags.select("subject_id", "tag_id", X.tag_guardrail(F.col("tag_name")).alias("guard"))


@query("char_tokens", sql="select doc_id, round_even(length(text) / 4.0, 0)::bigint as tokens from documents")
def _(d):
    return d.table("documents").select("doc_id", X.char_tokens(F.col("text")).alias("tokens"))


@query("text_fingerprint", sql="""select subject_id, tag_id, sha256('{"evaluation_type":"' || evaluation_type || '","tag_id":"' || tag_id || '","tag_name":"' || tag_name || '"}') as fingerprint from policy_tags""")
def _(d):
    return d.policy_tags.select("subject_id", "tag_id", X.fingerprint(F.to_json(F.struct("evaluation_type", "tag_id", "tag_name"))).alias("fingerprint"))


def halved_sql(t: str) -> str:
    return f"case when length({t}) > 2000 then left({t}, length({t}) // 2) || {q(V.BUDGET_NOTICE)} else {t} end"


@query("state_budget", sql=f"""select doc_id, (length(text) > 2000)::int + (length(t1) > 2000)::int + (length(t2) > 2000)::int as k, md5({halved_sql('t2')}) as text_md5
 from (select *, {halved_sql('t1')} as t2 from (select *, {halved_sql('text')} as t1 from documents))""")
def _(d):
    t = F.col("text")
    return d.table("documents").select("doc_id", X.halvings(F.length(t), 2000).alias("k"), F.md5(X.state_budget(t, 2000)).alias("text_md5"))


@query("label_index", sql="""select correlation_id, subject_id, case prominence when 'primary' then 0 when 'significant' then 1 else 2 end as prominence_label,
 case sentiment when 'positive' then 0 when 'negative' then 1 when 'neutral' then 2 else 3 end as sentiment_label from baseline_subjects""")
def _(d):
    return d.baseline_subjects.select("correlation_id", "subject_id", L.label_index(F.lit("prominence"), F.col("prominence")).alias("prominence_label"),
                                      L.label_index(F.lit("sentiment"), F.col("sentiment")).alias("sentiment_label"))


@query("one_hot", sql="select vec_id, array_to_string(list_transform(range(0, k), lambda i: case when i = label then '1' else '0' end), '') as target from predictions")
def _(d):
    t = L.one_hot(F.col("label"), L.kind_width(F.col("kind")))
    return d.predictions.select("vec_id", F.array_join(F.transform(t, lambda x: x.cast("int").cast("string")), "").alias("target"))


@query("usage_cost", sql=f"select article_no, round(cand_input_tokens / 1e6 * {V.CAND_INPUT_PER_MTOK}, 9)::double as cost_usd from usage")
def _(d):
    return d.usage.select("article_no", F.round(L.usage_cost(F.col("cand_input_tokens")), 9).alias("cost_usd"))


@query("batch_share_latency", sql="select article_no, round(total / n, 2) as share_ms from usage join (select config_id, run_id, sum(cand_duration_ms) as total, count(*) as n from usage group by all) using (config_id, run_id)")
def _(d):
    """Time of a batch shared evenly by its members: totals are aggregated first and joined back."""
    batch = d.usage.groupBy("config_id", "run_id").agg((F.sum("cand_duration_ms") / F.count("*")).alias("share"))
    return join_by_size(d.usage, batch, ["config_id", "run_id"]).select("article_no", L.rounded(F.col("share"), 2).alias("share_ms"))


def quoted_sql(c: str) -> str:
    inner = f"regexp_replace({strip('substr(h, 2, length(h) - 2)')}, '[,;:]+$', '')"
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({c}, {q(V.ANY_QUOTED)}, 0), lambda h: {inner}), lambda x: x <> '')))"


@query("quoted_literals", sql=f"select page_id, len(l)::int as n, md5(array_to_string(l, '|')) as literals_md5 from (select page_id, {quoted_sql('html')} as l from pages)")
def _(d):
    lits = X.quoted_literals(F.col("html"))
    return d.table("pages").select("page_id", F.size(lits).alias("n"), F.md5(F.array_join(lits, "|")).alias("literals_md5"))


def numbers_sql(c: str) -> str:
    """Look-around as word boundaries: beyond ASCII, letters, marks and digits become a letter first (so the twin finds no
    number in other digits), and a list marker is taken with the character behind it."""
    plain = f"regexp_replace(coalesce({c}, ''), '[^\\x00-\\x7F\\P{{L}}]|[^\\x00-\\x7F\\P{{M}}]|[^\\x00-\\x7F\\P{{Nd}}]|[^\\x00-\\x7F\\P{{Nl}}]|[^\\x00-\\x7F\\P{{Pc}}]', 'z', 'g')"
    listed = f"regexp_replace({plain}, '(?m)^([\\t\\x0B\\f\\r \\x1C-\\x1F\\x{{85}}\\p{{Z}}]*)\\d+([.)](?:\\D|$))', '\\1\\2', 'g')"
    number = r"(?:\B[$€£]|\b)\d+(?:[,.]\d+)*(?:%\B|[–—-]\d+(?:[,.]\d+)*\b|\b)"
    return f"list_sort(list_distinct(regexp_extract_all({listed}, '{number}')))"


@query("numeric_literals", sql=f"select page_id, len(l)::int as n, array_to_string(l, '|') as literals from (select page_id, {numbers_sql('html')} as l from pages)")
def _(d):
    """Numbers, amounts and ranges per page."""
    lits = X.numeric_literals(F.col("html"))
    return d.table("pages").select("page_id", F.size(lits).alias("n"), F.array_join(lits, "|").alias("literals"))


# --- questions --------------------------------------------------------------------------------------------

@query("config_subjects", sql="select config_id, cast(pos as integer) as pos, subject_id, name from policy_subjects")
def _(d):
    from assayer.plans.q_sources import config_payloads_plain
    s = C.subject_rows(C.snapshot_unwrap(config_payloads_plain(d)))
    return s.select("config_id", "pos", F.col("subject_id").cast("bigint").alias("subject_id"), "name")


@query("config_llm_tags", sql="select config_id, pos, subject_id, tag_pos, tag_id, tag_name, prompt_text from policy_tags where evaluation_type = 'llm' and coalesce(prompt_text, '') <> ''")
def _(d):
    """Tags through the nested snapshot form and back."""
    t = d.policy_tags.groupBy("config_id", "pos", "subject_id").agg(F.array_sort(F.collect_list(F.struct(
        "tag_pos", "tag_id", "tag_name", "evaluation_type", "prompt_text"))).alias("tag_evaluations")).withColumn("name", F.lit("n"))
    return C.llm_tag_rows(t).drop("name")


def fill_sql(template: str, **values) -> str:
    import re
    parts = [f"({values[p[1:-1]]})" if p[:1] == "{" and p[1:-1] in values else q(p) for p in re.split(r"(\{[a-z]+\})", template) if p]
    return " || ".join(parts)


def lists(options: dict, vals: dict) -> str:
    return f"[{', '.join(q(k) for k in options)}] as labels, [{', '.join(fill_sql(t, **vals) for t in options.values())}] as texts"


def questions_sql(verbose: bool) -> str:
    texts = V.VERBOSE if verbose else V.TERSE
    policy = heading_sql("validation_prompt")
    out = []
    for slot, (key, kind, qtype) in enumerate((("valid", "validation", "noul"), ("prominence", "prominence", "choice"), ("sentiment", "sentiment", "choice"))):
        head, options = texts[key]
        vals = dict(name="name", policy=policy, entity=heading_sql("entity_definition"))
        ins = fill_sql(head, **vals)
        if verbose and key != "valid":
            title = V.CLIENT_PROMINENCE if key == "prominence" else V.CLIENT_SENTIMENT
            own = heading_sql(f"{key}_prompt")
            ins += f" || case when {own} <> '' then {q(title)} || {own} else '' end"
        out.append(f"select config_id, subject_id, pos, {slot} as slot, 'subj_'||subject_id||'_{key}' as qid, null::varchar as tag_id, '{kind}' as kind, '{qtype}' as qtype, {ins} as instructions, {lists(options, vals)} from policy_subjects")
    head, options = texts["tag"]
    vals = dict(name="s.name", tag="t.tag_name", policy=strip(f"{heading_sql('t.prompt_text')} || {GUARD.replace('tag_name', 't.tag_name')}"))
    out.append(f"""select t.config_id, t.subject_id, t.pos, t.tag_pos + 3, 'tag_'||t.subject_id||'_'||t.tag_id, t.tag_id, 'tag', 'noul', {fill_sql(head, **vals)}, {lists(options, vals)}
 from policy_tags t join policy_subjects s on s.subject_id = t.subject_id where t.evaluation_type = 'llm' and coalesce(t.prompt_text, '') <> ''""")
    return " union all ".join(out)


QUESTIONS = {"questions": questions_sql(False), "long_questions": questions_sql(True)}


def flat_criteria():
    return F.array_join(F.zip_with("criteria_labels", "criteria_texts", lambda k, t: F.concat(k, F.lit("="), t)), "|")


QCOLS = """config_id, subject_id, pos, slot, qid, kind, qtype, md5(instructions) as instructions_md5,
 md5(array_to_string(list_transform(range(1, len(labels) + 1), lambda i: labels[i] || '=' || texts[i]), '|')) as criteria_md5"""


def show(qs):
    return qs.select("config_id", "subject_id", "pos", "slot", "qid", "kind", "qtype", F.md5("instructions").alias("instructions_md5"), F.md5(flat_criteria()).alias("criteria_md5"))


@query("build_questions", sql=f"select {QCOLS} from questions", extra=QUESTIONS)
def _(d):
    return show(Q.build_questions(d.policy_subjects, d.policy_tags))


@query("build_verbose_questions", sql=f"select {QCOLS} from long_questions", extra=QUESTIONS)
def _(d):
    return show(Q.build_questions(d.policy_subjects, d.policy_tags, verbose=True))


@query("question_counts", sql="select config_id, count(distinct subject_id) as n_subjects, count(*) as n_questions from questions group by config_id", extra=QUESTIONS)
def _(d):
    return Q.question_counts(Q.build_questions(d.policy_subjects, d.policy_tags))


def article_questions(d):
    """Questions of the article side: the configured subjects and model-judged tags of each source."""
    s = d.config_subjects.select("config_id", F.col("subject_id").alias("pos"), "subject_id", "name", F.lit("").alias("entity_definition"),
                                 F.concat(F.lit("Stories on "), "name").alias("validation_prompt"), F.lit("").alias("prominence_prompt"), F.lit("").alias("sentiment_prompt"))
    t = d.config_tags.select("config_id", F.col("subject_id").alias("pos"), "subject_id", F.when(F.col("tag_id") == "toxic", 0).otherwise(1).alias("tag_pos"), "tag_id", "tag_name",
                             "evaluation_type", F.lit("Judge the text.").alias("prompt_text"))
    return Q.build_questions(s, t)


AQ = """select c.config_id, c.subject_id, c.subject_id as pos, v.* from config_subjects c cross join (values (0,'validation'),(1,'prominence'),(2,'sentiment'),(3,'tag'),(4,'tag')) as v(slot, kind)"""
AQID = "case slot when 0 then 'subj_'||subject_id||'_valid' when 3 then 'tag_'||subject_id||'_toxic' when 4 then 'tag_'||subject_id||'_long' else 'subj_'||subject_id||'_'||kind end"


@query("question_fanout", sql=f"select a.correlation_id, a.config_id, x.qid, x.kind from articles a join (select *, {AQID} as qid from aq) x using (config_id)", extra={"aq": AQ})
def _(d):
    return Q.question_fanout(d.articles, article_questions(d)).select("correlation_id", "config_id", "qid", "kind")


@query("request_table", sql=f"""select s.correlation_id, s.config_id, md5(s.state) as state_md5, q.question_count, q.qids from states s join (
 select config_id, count(*) as question_count, string_agg({AQID}, ',' order by subject_id, slot) as qids from aq group by config_id) q using (config_id)""", extra={**STATES, "aq": AQ})
def _(d):
    r = Q.request_table(d.articles, Q.question_sets(article_questions(d)))
    return r.select("correlation_id", "config_id", F.md5("state").alias("state_md5"), "question_count", F.array_join(F.transform("questions", lambda x: x.qid), ",").alias("qids"))


# the same questions in SQL, over the article side
ASKED = {
    "asked_subjects": """select config_id, subject_id as pos, subject_id, name, '' as entity_definition, 'Stories on ' || name as validation_prompt, '' as prominence_prompt, '' as sentiment_prompt
 from config_subjects""",
    "asked_tags": """select config_id, subject_id as pos, subject_id, case tag_id when 'toxic' then 0 else 1 end as tag_pos, tag_id, tag_name, evaluation_type, 'Judge the text.' as prompt_text from config_tags""",
    "asked": questions_sql(False).replace("policy_subjects", "asked_subjects").replace("policy_tags", "asked_tags").replace(
        "on s.subject_id = t.subject_id", "on s.config_id = t.config_id and s.subject_id = t.subject_id"),
}
