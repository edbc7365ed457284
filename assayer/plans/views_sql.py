"""The SQL twin of sources.tables, as DuckDB common table expressions."""

import re

from assayer import fixed_values as V
from assayer.sources.tables import SUBJECTS, TAGS


def q(s) -> str:
    """SQL literal."""
    return str(s) if not isinstance(s, str) else "'" + s.replace("'", "''") + "'"


def bucket(x: str) -> str:
    return f"(('0x'||substr(md5({x}),1,8))::ubigint::bigint % 100)"


def keyed(prefix: str, *cols: str) -> str:
    return bucket("concat('" + prefix + "|'," + ",'|',".join(cols) + ")")


def pick(b: str, labels) -> str:
    arms = " ".join(f"when {i} then {q(x)}" for i, x in enumerate(labels[:-1]))
    return f"case ({b}) % {len(labels)} {arms} else {q(labels[-1])} end"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(q(x) for x in r) + ")" for r in rows)


def words_in(c: str, words) -> str:
    return "(" + " or ".join(f"contains({c}, {q(w)})" for w in words) + ")"


WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


VIEWS = {
    "articles": """select concat('c',cast(doc_id as varchar)) as correlation_id, doc_id, source as config_id, lang as language,
 case when doc_id % 10 = 0 then 'radio' when doc_id % 10 = 1 then 'television' else 'online' end as media_type,
 split_part(text, chr(10), 1) as headline, substr(text, length(split_part(text, chr(10), 1)) + 2) as body, n_chars from documents""",
    "subjects": f"select * from (values {values(SUBJECTS)}) as t(subject_id, name)",
    "config_subjects": "select distinct d.source as config_id, s.subject_id, s.name from documents d cross join subjects s",
    "config_tags": f"select c.config_id, c.subject_id, t.* from config_subjects c cross join (values {values(TAGS)}) as t(tag_id, tag_name, evaluation_type)",
    "baseline_subjects": f"""select concat('c',cast(l.doc_id as varchar)) as correlation_id, s.subject_id,
 case when s.subject_id = 1 then l.quality = 1 else {keyed('bv', 's.subject_id', 'l.doc_id')} < 60 end as is_valid,
 {pick(keyed('bp', 's.subject_id', 'l.doc_id'), V.PROMINENCE_LABELS)} as prominence,
 {pick(keyed('bs', 's.subject_id', 'l.doc_id'), V.SENTIMENT_LABELS)} as sentiment from labels l cross join subjects s""",
    "baseline_tags": "select concat('c',cast(doc_id as varchar)) as correlation_id, 'toxic' as tag_id, toxic = 1 as result from labels",
    "answers": f"""select a.correlation_id, a.config_id, s.subject_id,
 {keyed('cv', 's.subject_id', 'a.doc_id')}::double / 100 as p_valid,
 {pick(keyed('cp', 's.subject_id', 'a.doc_id'), V.PROMINENCE_LABELS)} as prominence,
 {pick(keyed('cs', 's.subject_id', 'a.doc_id'), V.SENTIMENT_LABELS)} as sentiment,
 {keyed('ct', 's.subject_id', 'a.doc_id')}::double / 100 as p_toxic from articles a cross join subjects s""",
    "audit_log": """select event_id as id, ts as created_at, event_type as config_id, concat('c', json_extract_string(props,'$.k')) as correlation_id,
 case when user_id % 2 = 0 then 'kafka' else 'http' end as processing_source,
 case when value < 1 then 'failed' else 'completed' end as status from events""",
    "configurations": """select c_custkey as id, c_name as identifier, concat('Config ',c_mktsegment) as name,
 case c_custkey % 5 when 0 then 'draft' when 1 then 'pending_changes' else 'active' end as status,
 case c_custkey % 3 when 0 then 'active' when 1 then 'draft' else null end as previous_status,
 c_custkey % 11 = 0 as is_archived from customer""",
    "versions": "select o_custkey as configuration_id, o_orderkey as version_number, o_orderdate as published_at from orders",
    "trackers": "select s_suppkey as tracker_id, s_suppkey * 7 as configuration_id from supplier",
    "stage_timings": """select l_orderkey as article_no, l_linenumber as pos,
 case l_returnflag when 'A' then 'DedupStage' when 'N' then 'LLMProcessingStage' else 'RulesStage' end as stage,
 l_quantity * 100 as duration_ms from lineitem""",
    "usage": """select o_orderkey as article_no, o_orderpriority as run_id, concat('cfg', cast(o_custkey % 20 as varchar)) as config_id,
 case when o_orderkey % 10 = 0 then o_totalprice / 1e7 end as base_cost_recorded,
 cast(floor(o_totalprice / 100) as bigint) as input_tokens, cast(o_orderkey % 500 as bigint) as output_tokens,
 cast(o_orderkey % 40 as bigint) as cached_tokens, (o_orderkey % 4000) * 1.5::double as base_duration_ms, (o_orderkey % 300) * 0.5::double as cand_duration_ms,
 cast(floor(o_totalprice / 300) as bigint) as cand_input_tokens,
 case o_orderstatus when 'F' then 'failed' when 'P' then 'skipped' else 'ok' end as status,
 concat('key|', cast(o_orderkey % 97 as varchar)) as cache_key, o_orderdate as recorded_at from orders""",
    "predictions": f"""select vec_id, kind, k, cast(label % k as integer) as label, embedding[1:k]::double[] as logits from (select vec_id, label, embedding,
 {pick('vec_id', V.DECISION_KINDS)} as kind, case vec_id % 4 when 1 then 3 when 2 then 4 else 2 end as k from embeddings) e""",
    "policy_subjects": """select 'p'||(p_partkey // 8) as config_id, p_partkey as subject_id, cast(p_partkey % 8 as integer) as pos,
 case p_partkey % 8 when 0 then p_name||' Corp' when 1 then p_name||' ('||upper(left(p_name,3))||')' when 2 then replace(p_name,' ','-')
  when 3 then p_name||' All' when 4 then p_name||', Inc.' when 5 then p_name||' (creamers)' when 6 then ' '||p_name||' – ' else p_name end as name,
 '# Entity'||chr(10)||'Maker of '||p_name as entity_definition,
 '## Scope'||chr(10)||'Include only stories on '''||p_name||'''. '||
 case when p_partkey % 7 = 0 then 'Exclude '''||p_name||''' when it is a passing note.' else 'Exclude ''size '||p_size||''' notes unless over 10%.' end||
 case when p_partkey % 11 = 0 then chr(10)||'Please specify the criteria.' else '' end as validation_prompt,
 case when p_partkey % 3 = 0 then '## Focus on '||p_name end as prominence_prompt,
 case when p_partkey % 3 = 1 then '### Tone of '||p_name end as sentiment_prompt, p_size as sort_order from part""",
    "policy_tags": """select 'p'||(p_partkey // 8) as config_id, p_partkey as subject_id, cast(p_partkey % 8 as integer) as pos, 0 as tag_pos, 'a'||p_size as tag_id,
 case p_partkey % 4 when 0 then 'Partner news' when 1 then 'AI' when 2 then 'Engineering' else p_type end as tag_name, 'g1' as tag_group_id, 'Topics' as tag_group_name,
 case when p_partkey % 9 = 0 then 'boolean' when p_partkey % 31 = 5 then 'other' else 'llm' end as evaluation_type,
 case when p_partkey % 13 = 0 then null when p_partkey % 5 = 0 then '# Use the tag "Storage notes" when true.' else '# True when the text is on '||p_type||' and $'||p_size||' goods.' end as prompt_text,
 case when p_partkey % 9 = 0 then p_name||' AND NOT size' end as boolean_expression from part
 union all select 'p'||(p_partkey // 8), p_partkey, cast(p_partkey % 8 as integer), 1, 'b_'||p_type, 'Storage notes', 'g2', 'Notes', 'llm',
 case when p_partkey % 6 = 0 then 'Only about '||p_type else 'Storage notes of the maker' end, null from part""",
}


def with_views(sql: str, extra: dict | None = None) -> str:
    """Put the needed views, in order, in front of a query that may start with its own WITH."""
    views = {**VIEWS, **(extra or {})}
    needed, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in views:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(views[name])
    head = ",\n".join(f"{n} as ({views[n]})" for n in views if n in needed)
    body = sql.strip()
    if not head:
        return body
    if body[:5].lower() == "with ":
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"
