"""Boolean tags, ordered rules and scored attributes of the processing contract."""

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.text import filled
from assayer.operators.joins import join_by_size

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIELDS = ("country", "language", "media_type", "source")
_SMART = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'"})
_WORD = re.compile(r'"[^"]*"|[()]|[^\s()"]+(?:"[^"]*")?')
_BINDS = {"OR": 1, "AND": 2, "NOT": 3}
_STEPS = "expression STRING, steps ARRAY<STRUCT<op: STRING, field: STRING, term: STRING>>"


def _term(word: str) -> tuple[str, str, str]:
    """(op, field, term) of one word: a contained phrase, a field qualifier, or a blank check."""
    field, _, value = word.partition(":")
    name, where = field.lower(), "haystack"
    if value and (name in FIELDS or re.fullmatch(r"metadata\.[a-z0-9_]+", name)):
        where, word = name, value
        if word == '""':
            return "blank", where, ""
    term = word.strip('"').rstrip("*").lower()
    if not term:
        raise ValueError("empty term")
    return "has", where, term


def postfix(expression: str) -> list[tuple[str, str, str]] | None:
    """An expression's steps with operators behind their operands (NOT binds before AND before OR); None if invalid."""
    out, waiting, operand = [], [], True  # operand: whether one must come next
    for w in _WORD.findall(expression.translate(_SMART)):
        op = w.upper()
        if op in ("(", "NOT"):
            if not operand:
                return None
            waiting.append(op)
        elif op in (")", "AND", "OR"):
            if operand:
                return None
            while waiting and waiting[-1] != "(" and (op == ")" or _BINDS[waiting[-1]] >= _BINDS[op]):
                out.append((waiting.pop(), "", ""))
            if op != ")":
                waiting.append(op)
                operand = True
            elif not waiting or waiting.pop() != "(":
                return None
        else:
            if not operand:
                return None
            try:
                out.append(_term(w))
            except ValueError:
                return None
            operand = False
    if operand or "(" in waiting:
        return None
    return out + [(op, "", "") for op in reversed(waiting)]


def _parsed(batches):
    for batch in batches:
        yield pd.DataFrame({"expression": batch["expression"], "steps": [
            None if (steps := postfix(e)) is None else [dict(zip(("op", "field", "term"), s)) for s in steps] for e in batch["expression"]]})


def _result(steps: Column) -> Column:
    """Steps folded over a stack of booleans."""
    def value(s: Column) -> Column:
        kept = F.when(s.field == "haystack", F.col("haystack"))
        for f in FIELDS:
            kept = kept.when(s.field == f, F.lower(F.col(f)))
        kept = kept.otherwise(F.lower(F.try_element_at(F.col("facts"), F.substring(s.field, F.lit(10), F.length(s.field)))))
        return F.coalesce(kept, F.lit(""))

    def step(stack: Column, s: Column) -> Column:
        n = F.size(stack)
        last, before = F.get(stack, n - 1), F.get(stack, n - 2)
        rest = lambda k: F.slice(stack, F.lit(1), n - k)
        return (F.when(s.op == "has", F.concat(stack, F.array(F.contains(value(s), s.term)))).when(s.op == "blank", F.concat(stack, F.array(value(s) == "")))
                .when(s.op == "NOT", F.concat(rest(1), F.array(~last))).when(s.op == "AND", F.concat(rest(2), F.array(before & last)))
                .otherwise(F.concat(rest(2), F.array(before | last))))

    return F.get(F.aggregate(steps, F.array().cast("array<boolean>"), step), F.lit(0))


def boolean_tags(articles: DataFrame, tags: DataFrame) -> DataFrame:
    """Result per (article, boolean tag); an invalid expression is false and flagged.

    articles(correlation_id, config_id, headline, body, country, language, media_type, source, metadata);
    tags(config_id, subject_id, tag_id, boolean_expression).  Each distinct expression is parsed once, into an array of
    steps that joins like any data: one scan of the articles and one plan, however many expressions there are.
    """
    tags = tags.filter(filled(F.col("boolean_expression")).isNotNull()).select("config_id", "subject_id", "tag_id", F.col("boolean_expression").alias("expression"))
    parsed = tags.select("expression").distinct().mapInPandas(_parsed, _STEPS)
    hay = articles.select("correlation_id", "config_id", *FIELDS, F.from_json("metadata", "map<string,string>").alias("facts"),
                          F.lower(F.concat("headline", F.lit(" "), "body")).alias("haystack"))
    rows = hay.join(tags.join(parsed, "expression"), "config_id")
    return rows.select("correlation_id", "config_id", "subject_id", "tag_id", F.coalesce(_result(F.col("steps")), F.lit(False)).alias("result"),
                       F.col("steps").isNull().alias("invalid"))


STATE = ("STRUCT<tags: ARRAY<STRING>, subjects: ARRAY<STRUCT<subject_id: STRING, is_valid: BOOLEAN, prominence: STRING, sentiment: STRING>>, "
         "trace: ARRAY<STRING>>")


def _holds(c: Column, state: Column, language: Column) -> Column:
    """One condition against the current state: a tag, an attribute of a subject, or the article's language."""
    target = F.substring_index(c.field, ":", -1)
    s = F.get(F.filter(state.subjects, lambda x: x.subject_id == target), F.lit(0))
    value = (
        F.when(c.field == "tag", F.when(F.array_contains(state.tags, c.value), c.value).otherwise(""))
        .when(c.field.startswith("sentiment:"), s.sentiment).when(c.field.startswith("prominence:"), s.prominence)
        .when(c.field.startswith("valid:"), s.is_valid.cast("string")).when(c.field == "language", language))
    same = F.coalesce(F.lower(value) == F.lower(c.value), F.lit(False))
    return F.when(c.operator == "not_equals", ~same).otherwise(same)


def _act(state: Column, a: Column) -> Column:
    """One action; targets of subject actions are written `subject=value`."""
    kind, target, value = a.action_type, F.substring_index(a.value, "=", 1), F.substring_index(a.value, "=", -1)
    tags = (
        F.when(kind == "add_tag", F.array_union(state.tags, F.array(a.value)))
        .when(kind == "remove_tag", F.array_remove(state.tags, a.value)).otherwise(state.tags))

    def subject(x):
        hit = x.subject_id == target
        return F.struct(
            x.subject_id.alias("subject_id"), F.when(hit & (kind == "set_subject_status"), value == "true").otherwise(x.is_valid).alias("is_valid"),
            F.when(hit & (kind == "override_prominence"), value).otherwise(x.prominence).alias("prominence"),
            F.when(hit & (kind == "override_sentiment"), value).otherwise(x.sentiment).alias("sentiment"))

    return F.struct(tags.alias("tags"), F.transform(state.subjects, subject).alias("subjects"), state.trace.alias("trace")).cast(STATE)


def apply_rules(articles: DataFrame, rules: DataFrame) -> DataFrame:
    """Fold the ordered rules of its configuration over each article's state; later rules see earlier changes.

    articles(correlation_id, config_id, language, tags, subjects); rules(config_id, rules ARRAY<STRUCT<order, rule_id,
    conditions, actions>>).  The top-level result of the article is not recomputed.
    """
    j = join_by_size(articles, rules, ["config_id"], "left")
    start = F.struct(F.col("tags"), F.col("subjects"), F.array().cast("array<string>").alias("trace")).cast(STATE)

    def step(state, rule):
        hit = F.forall(rule.conditions, lambda c: _holds(c, state, F.col("language")))
        done = F.aggregate(rule.actions, state, _act)
        traced = F.struct(done.tags.alias("tags"), done.subjects.alias("subjects"), F.concat(done.trace, F.array(rule.rule_id)).alias("trace")).cast(STATE)
        return F.when(hit, traced).otherwise(state)

    ordered = F.array_sort(F.coalesce("rules", F.array()))
    final = F.aggregate(ordered, start, step)
    return j.select("correlation_id", "config_id", final.alias("s")).select("correlation_id", "config_id", "s.tags", "s.subjects", "s.trace")


def scored_attributes(tags: DataFrame, subjects: DataFrame) -> DataFrame:
    """Final tags of an article by group, with the counts of assembled parts.

    tags(correlation_id, group_id, group_name, tag_id, evaluation_type, result); subjects(correlation_id, subject_id).
    A group is one article's, so it is bounded by its configuration.
    """
    g = tags.groupBy("correlation_id", "group_id", "group_name").agg(
        F.array_sort(F.collect_list(F.struct("tag_id", "evaluation_type", "result"))).alias("tags"))
    g = g.groupBy("correlation_id").agg(F.array_sort(F.collect_list(F.struct("group_id", "group_name", "tags"))).alias("tag_groups"),
                                        F.sum(F.size("tags")).alias("n_tags"))
    n = subjects.groupBy("correlation_id").agg(F.count("*").alias("subjects_processed"))
    j = g.join(n, "correlation_id", "full_outer")
    return j.select("correlation_id", "tag_groups", F.coalesce("subjects_processed", F.lit(0)).alias("subjects_processed"),
                    (F.coalesce("subjects_processed", F.lit(0)) + F.coalesce("n_tags", F.lit(0))).alias("total_attributes"))
