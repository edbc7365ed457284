"""Explicit schemas of the archived records; nothing is ever inferred."""

BLOB = """
correlation_id STRING, tracker_id STRING, config_id STRING, config_name STRING, article_id STRING,
headline STRING, body STRING, source STRING, country STRING, language STRING, published_at STRING,
media_type STRING, validation_result BOOLEAN, rejection_reason STRING, summary STRING,
scored_attributes STRUCT<
  tag_groups: ARRAY<STRUCT<group_id: STRING, name: STRING,
    tags: ARRAY<STRUCT<tag_id: STRING, name: STRING, evaluation_type: STRING, result: BOOLEAN>>>>,
  subjects_processed: INT, total_attributes: INT>,
boolean_results MAP<STRING, BOOLEAN>,
rules_trace ARRAY<STRUCT<rule_id: STRING, actions_applied: ARRAY<STRING>>>,
subject_results ARRAY<STRUCT<subject_id: STRING, name: STRING, is_valid: BOOLEAN, invalid_reason: STRING,
  is_default: BOOLEAN, prominence: STRING, sentiment: STRING, tags: ARRAY<STRING>>>,
llm_provider STRING, llm_model STRING, llm_tokens STRUCT<input: BIGINT, output: BIGINT>,
llm_cost_usd DOUBLE, llm_raw_response STRING, llm_cached_tokens BIGINT,
stage_timings ARRAY<STRUCT<stage: STRING, duration_ms: DOUBLE>>,
processing_source STRING, processed_at STRING,
inbound_data STRUCT<headline: STRING, body: STRING, source: STRING, media_type: STRING,
  published_at: STRING, language: STRING, country: STRING, force_reprocess: BOOLEAN>
"""

SNAPSHOT = """STRUCT<
  configuration: STRUCT<id: BIGINT, identifier: STRING, name: STRING, status: STRING>,
  summary_prompt: STRUCT<prompt_text: STRING, rejected_prompt_text: STRING>,
  subjects: ARRAY<STRUCT<
    id: STRING, name: STRING, entity_definition: STRING, validation_prompt: STRING,
    sentiment_prompt: STRING, prominence_prompt: STRING, is_default: BOOLEAN, sort_order: INT,
    tag_evaluations: ARRAY<STRUCT<
      tag_id: STRING, tag_name: STRING, tag_group_id: STRING, tag_group_name: STRING,
      evaluation_type: STRING, prompt_text: STRING, boolean_expression: STRING>>>>,
  rules: ARRAY<STRUCT<rule_id: STRING, `order`: INT,
    conditions: ARRAY<STRUCT<field: STRING, operator: STRING, value: STRING>>,
    actions: ARRAY<STRUCT<action_type: STRING, value: STRING>>>>>"""

ANSWER = """STRUCT<type: STRING, noul: DOUBLE, choice: STRING, score: DOUBLE,
  probabilities: MAP<STRING, DOUBLE>, confidence: DOUBLE>"""
ENVELOPE = f"STRUCT<model: STRING, answers: MAP<STRING, {ANSWER}>, usage: STRUCT<input_tokens: BIGINT, output_tokens: BIGINT>>"
