"""Candidate against archived decision: matches, costs and per-article figures."""

from pyspark.sql import Column, DataFrame, functions as F

from assayer import fixed_values as V
from assayer.functions import labels as L, text as X
from assayer.operators import gating
from assayer.operators.joins import join_by_size, once, rows_of

DIMENSIONS = ("validation", "prominence", "sentiment", "tag")


def forced(valid: Column, value: Column, default: str) -> Column:
    """A rejected subject counts with the default label."""
    return F.when(valid, F.coalesce(F.lower(value), F.lit(""))).otherwise(default)


def with_matches(rows: DataFrame, threshold: float = V.VALIDATION_THRESHOLD) -> DataFrame:
    """Matches per subject row from the archived (is_valid, base_prominence, base_sentiment) and candidate columns.

    Without an answer the probability is 0.0 and the label empty.
    """
    valid = F.coalesce("p_valid", F.lit(0.0)) >= threshold
    conf = lambda c: F.when(valid, F.coalesce(c, F.lit(0.0))).otherwise(1.0)
    out = rows.select(
        *[c for c in rows.columns if c not in ("is_valid", "base_prominence", "base_sentiment", "p_valid", "prominence", "sentiment", "prominence_conf", "sentiment_conf")],
        F.coalesce("is_valid", F.lit(False)).alias("val_base"), valid.alias("val_cand"), F.coalesce("p_valid", F.lit(0.0)).alias("val_prob"),
        F.coalesce(F.lower("base_prominence"), F.lit("")).alias("prom_base"), forced(valid, F.col("prominence"), "passing").alias("prom_cand"),
        conf("prominence_conf").alias("prom_conf"),
        F.coalesce(F.lower("base_sentiment"), F.lit("")).alias("sent_base"), forced(valid, F.col("sentiment"), "neutral").alias("sent_cand"),
        conf("sentiment_conf").alias("sent_conf"))
    return (out.withColumn("val_match", F.col("val_base") == F.col("val_cand"))
            .withColumn("prom_match", F.col("prom_base") == F.col("prom_cand"))
            .withColumn("sent_match", F.col("sent_base") == F.col("sent_cand")))


def subject_comparison(config_subjects: DataFrame, baseline: DataFrame, answers: DataFrame, threshold: float = V.VALIDATION_THRESHOLD) -> DataFrame:
    """Configured subjects that have an archived result, with the candidate's answer where there is one.

    baseline(correlation_id, config_id, subject_id, is_valid, prominence, sentiment).
    """
    b = join_by_size(baseline, config_subjects.select("config_id", "subject_id", "name"), ["config_id", "subject_id"])
    b = b.withColumnRenamed("prominence", "base_prominence").withColumnRenamed("sentiment", "base_sentiment")
    a = answers.select("correlation_id", "subject_id", "p_valid", "prominence", "sentiment", "prominence_conf", "sentiment_conf")
    return with_matches(b.join(a, ["correlation_id", "subject_id"], "left"), threshold)


def tag_matches(rows: DataFrame, tag_threshold: float = V.TAG_THRESHOLD) -> DataFrame:
    """A tag counts only for a subject the candidate accepts; a tag missing in the archive is false."""
    base = F.coalesce("base_result", F.lit(False))
    cand = F.coalesce("val_cand", F.lit(False)) & (F.col("p_tag") >= tag_threshold)
    others = [c for c in rows.columns if c not in ("base_result", "val_cand", "p_tag")]
    return rows.select(*others, base.alias("base_result"), cand.alias("cand_result"), F.col("p_tag").alias("cand_prob"),
                       (base == cand).alias("match"))


def tag_comparison(config_tags: DataFrame, answers: DataFrame, baseline_tags: DataFrame, subjects: DataFrame,
                   tag_threshold: float = V.TAG_THRESHOLD) -> DataFrame:
    """answers(correlation_id, config_id, subject_id, tag_id, p_tag) of configured model-judged tags; `subjects` is the
    subject comparison, whose candidate validity is false for subjects without an archived result."""
    t = config_tags.filter(F.col("evaluation_type") == "llm").select("config_id", "subject_id", "tag_id", "tag_name")
    a = join_by_size(answers, t, ["config_id", "subject_id", "tag_id"])
    a = a.join(subjects.select("correlation_id", "subject_id", "val_cand"), ["correlation_id", "subject_id"], "left")
    return tag_matches(a.join(baseline_tags.withColumnRenamed("result", "base_result"), ["correlation_id", "tag_id"], "left"), tag_threshold)


def counts_long(subjects: DataFrame, tags: DataFrame, keys: list[str]) -> DataFrame:
    """Partial (correct, total) counts per dimension in one schema, ready for any grouping."""
    s = subjects.groupBy(*keys).agg(
        *[F.count_if(F.col(f"{c}_match")).alias(f"{c}_correct") for c in ("val", "prom", "sent")], F.count("*").alias("subjects"))
    t = tags.groupBy(*keys).agg(F.count_if("match").alias("tag_correct"), F.count("*").alias("tag_total"))
    zero = F.lit(0).cast("bigint")
    s = s.select(*keys, "val_correct", "prom_correct", "sent_correct", "subjects", zero.alias("tag_correct"), zero.alias("tag_total"))
    t = t.select(*keys, zero.alias("val_correct"), zero.alias("prom_correct"), zero.alias("sent_correct"), zero.alias("subjects"), "tag_correct", "tag_total")
    return s.unionByName(t)


def accuracy(counts: DataFrame, keys: list[str], empty=None) -> DataFrame:
    """Correct, total and accuracy per dimension; with nothing to compare an article scores 100, a run null."""
    g = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("val_correct", "prom_correct", "sent_correct", "subjects", "tag_correct", "tag_total")])
    return g.select(
        *keys, "val_correct", "prom_correct", "sent_correct", F.col("subjects").alias("subject_total"), "tag_correct", "tag_total",
        *[L.pct(F.col(f"{c}_correct"), F.col("subjects"), 1, empty).alias(f"{c}_accuracy") for c in ("val", "prom", "sent")],
        L.pct(F.col("tag_correct"), F.col("tag_total"), 1, empty).alias("tag_accuracy"))


def article_metrics(subjects: DataFrame, tags: DataFrame) -> DataFrame:
    keys = ["correlation_id"]
    return accuracy(counts_long(subjects, tags, keys), keys, empty=100.0)


def baseline_cost(recorded: Column, input_tokens: Column, output_tokens: Column, override: float | None = None,
                  flat: float = V.BASE_FLAT_PER_ARTICLE) -> tuple[Column, Column]:
    """(cost, source): recorded, then the caller's override, then the flat price, then the token estimate."""
    if override is not None:
        rest, source = F.lit(float(override)), "request_override"
    elif flat > 0:
        rest, source = F.lit(float(flat)), "flat_override"
    else:
        rest, source = L.token_cost(F.coalesce(input_tokens, F.lit(0)), F.coalesce(output_tokens, F.lit(0))), "token_estimate"
    return F.coalesce(recorded, rest), F.when(recorded.isNotNull(), "recorded_in_blob").otherwise(source)


def comparable_input(input_tokens: Column, cached: Column, excluded_text: Column) -> Column:
    skip = X.char_tokens(F.concat(excluded_text, F.lit(V.EXCLUDED_HEADINGS)))
    return F.greatest(F.lit(0), F.coalesce(input_tokens, F.lit(0)) - F.coalesce(cached, F.lit(0)) - skip).cast("bigint")


def classification_json(validation_result: Column, subjects: Column, tags: Column) -> Column:
    """The classification part of a reply as compact JSON; subjects and tags are arrays of plain structs."""
    s = F.array_join(F.transform(subjects, lambda x: F.to_json(x, {"ignoreNullFields": "false"})), ",")
    t = F.array_join(F.transform(tags, lambda x: F.to_json(x, {"ignoreNullFields": "false"})), ",")
    return F.concat(F.lit('{"validation_result":'), F.coalesce(validation_result.cast("string"), F.lit("null")),
                    F.lit(',"subjects":['), s, F.lit('],"tags":['), t, F.lit("]}"))


def classification_cost(input_tokens: Column, cached: Column, excluded_text: Column, output_json: Column) -> Column:
    return L.token_cost(comparable_input(input_tokens, cached, excluded_text), X.char_tokens(output_json))


def article_performance(rows: DataFrame) -> DataFrame:
    """Speed-up, savings and cost multiple per article with guarded denominators.

    rows: base_duration_ms, cand_duration_ms, base_cost_usd, base_class_cost_usd, cand_cost_usd.
    """
    bd, cd = F.col("base_duration_ms"), F.col("cand_duration_ms")
    bc, kc, cc = F.col("base_cost_usd"), F.col("base_class_cost_usd"), F.col("cand_cost_usd")
    tiny = 0.00000001
    return rows.select(
        "*",
        F.when(bd > 0, L.rounded(bd / F.greatest(cd, F.lit(1.0)), 2)).otherwise(1.0).alias("speedup_ratio"),
        L.rounded(bc - cc, 9).alias("savings_usd"),
        F.when(bc > 0, L.rounded((bc - cc) / F.greatest(bc, F.lit(0.00001)) * 100.0, 1)).otherwise(0.0).alias("savings_pct"),
        F.when(cc > 0, L.rounded(kc / F.greatest(cc, F.lit(tiny)), 1)).alias("class_cost_multiple"),
        F.when(kc > 0, L.rounded((kc - cc) / F.greatest(kc, F.lit(tiny)) * 100.0, 1)).otherwise(0.0).alias("class_savings_pct"))


def matched_places(left: Column, right: Column) -> Column:
    """For each of the ids `left` the place of the same id in `right`, or null; ids are unique on either side.

    Both sides are sorted together, so an id of `right` stands right behind the same id of `left`: the work is that of a
    sort, not a search of one array for each item of the other.
    """
    tagged = lambda ids, side: F.transform(ids, lambda x, i: F.struct(x.cast("string").alias("id"), F.lit(side).alias("side"), i.alias("at")))
    none = F.array().cast("array<string>")

    def found(every):
        def one(x, i):
            after = F.get(every, i + 1)
            return F.struct(x.side.alias("side"), x.at.alias("at"), F.when((after.id == x.id) & (after.side == 1), after.at).alias("other"))
        return F.transform(F.array_sort(F.filter(F.transform(every, one), lambda x: x.side == 0)), lambda x: x.other)

    return X.let(F.array_sort(F.concat(tagged(F.coalesce(left, none), 0), tagged(F.coalesce(right, none), 1))), found)


def article_facts(run: DataFrame, tag_threshold: float = V.TAG_THRESHOLD) -> DataFrame:
    """The scored run with its facts in the article's row: subject_facts of compared subjects, tag_facts of all tags.

    run needs subject_results ARRAY<STRUCT<subject_id, is_valid, prominence, sentiment>> and base_tags
    ARRAY<STRUCT<tag_id, result>> next to the cascade's columns.  A subject without an archived result is not compared, and
    its tags count as refused.
    """
    ids = lambda c, f: F.transform(F.coalesce(c, F.array().cast(run.schema[c].dataType)), lambda x: x[f])
    facts = once(gating.decision_arrays(run), subject_at=matched_places(F.transform("subjects", lambda s: s.subject_id.cast("string")), ids("subject_results", "subject_id")),
                 base_tag_at=matched_places(F.col("tag_ids"), ids("base_tags", "tag_id")))

    def subject(s, k):
        at = F.get("subject_at", k)
        b, ok = F.get("subject_results", at), F.coalesce(s.p_valid, F.lit(0.0)) >= V.VALIDATION_THRESHOLD
        conf = lambda c: F.when(ok, F.coalesce(c, F.lit(0.0))).otherwise(1.0)
        sides = F.struct(
            s.subject_id.alias("subject_id"), s["name"].alias("name"), F.coalesce(b.is_valid, F.lit(False)).alias("val_base"), ok.alias("val_cand"),
            F.coalesce(s.p_valid, F.lit(0.0)).alias("val_prob"), F.coalesce(F.lower(b.prominence), F.lit("")).alias("prom_base"),
            forced(ok, s.prominence, "passing").alias("prom_cand"), conf(s.prominence_conf).alias("prom_conf"), F.coalesce(F.lower(b.sentiment), F.lit("")).alias("sent_base"),
            forced(ok, s.sentiment, "neutral").alias("sent_cand"), conf(s.sentiment_conf).alias("sent_conf"))
        fact = X.let(sides, lambda x: F.struct(
            *[x[c].alias(c) for c in SIDES], (x.val_base == x.val_cand).alias("val_match"), (x.prom_base == x.prom_cand).alias("prom_match"), (x.sent_base == x.sent_cand).alias("sent_match")))
        return F.when(at.isNotNull(), fact)

    facts = once(facts, judged=F.transform("subjects", subject))

    def tag(t):
        base = F.coalesce(F.get("base_tags", F.get("base_tag_at", t.tag_at)).result, F.lit(False))
        cand = F.coalesce(F.get("judged", t.entity_at).val_cand, F.lit(False)) & F.coalesce(t.p_tag >= tag_threshold, F.lit(False))
        return F.struct(t.subject_id.alias("subject_id"), t.tag_id.alias("tag_id"), base.alias("base_result"), cand.alias("cand_result"),
                        t.p_tag.alias("cand_prob"), (base == cand).alias("match"))

    return once(facts, subject_facts=F.filter("judged", lambda x: x.isNotNull()), tag_facts=F.transform("tags", tag))


SIDES = ("subject_id", "name", "val_base", "val_cand", "val_prob", "prom_base", "prom_cand", "prom_conf", "sent_base", "sent_cand", "sent_conf")


def compare_articles(run: DataFrame, tag_threshold: float = V.TAG_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Subject and tag facts of a scored run, a row each, without any join."""
    facts = article_facts(run, tag_threshold)
    return (rows_of(facts, "subject_facts", "subject_id", "correlation_id", "config_id"), rows_of(facts, "tag_facts", "subject_id", "correlation_id", "config_id"))


def fact_counts() -> list[Column]:
    """Six counts of an article's facts."""
    n = lambda arr, f: F.coalesce(F.size(F.filter(arr, f)), F.lit(0)).cast("bigint")
    return [n("subject_facts", lambda j: j.val_match).alias("val_correct"), n("subject_facts", lambda j: j.prom_match).alias("prom_correct"),
            n("subject_facts", lambda j: j.sent_match).alias("sent_correct"), n("subject_facts", lambda j: F.lit(True)).alias("subjects"),
            n("tag_facts", lambda t: t.match).alias("tag_correct"), n("tag_facts", lambda t: F.lit(True)).alias("tag_total")]


def run_counts_once(run: DataFrame, keys: list[str], tag_threshold: float = V.TAG_THRESHOLD) -> DataFrame:
    """Counts of both comparisons from one pass: an article's facts are folded to six numbers in its own row.

    The two fact tables of compare_articles would score every article twice when both are read; here the
    decisions of an article are made inside arrays and only the six counts are grouped.
    """
    return article_facts(run, tag_threshold).select(*keys, *fact_counts())


def comparison_records(run: DataFrame, tag_threshold: float = V.TAG_THRESHOLD, override: float | None = None) -> DataFrame:
    """One whole record per article of a scored run: facts of subjects and tags, accuracies, time, both costs, savings.

    run also carries headline, llm_tokens, llm_cached_tokens, llm_cost_usd, stage_timings, validation_result and the
    excluded_text of its configuration (the summary and rejection prompts, which the classification does not need).  An
    article without a configuration has status `skipped`, empty facts and no cost.
    """
    r = article_facts(run, tag_threshold)
    counts = dict(zip(("val_correct", "prom_correct", "sent_correct", "subject_total", "tag_correct", "tag_total"), fact_counts()))
    r = r.select("*", *[c.alias(k) for k, c in counts.items()])
    acc = {f"{d}_accuracy": L.pct(F.col(f"{d}_correct"), F.col("tag_total" if d == "tag" else "subject_total"), 1, 100.0) for d in ("val", "prom", "sent", "tag")}
    r = article_cost_rows(r.select("*", *[c.alias(k) for k, c in acc.items()]), override, ("headline", "status", "subject_facts", "tag_facts", *counts, *acc))
    ok = F.col("status") == "ok"
    money = [c for c in r.columns if c.endswith(("_usd", "_pct", "_multiple", "_ms", "_ratio", "_source", "_tokens"))]
    return r.select(*[F.when(ok, F.col(c)).alias(c) if c in money else c for c in r.columns])


def candidate_view(facts: DataFrame) -> DataFrame:
    """(correlation_id, subjects): the candidate's decision in the layout of the archived one, tags under their subject."""
    tag = lambda t: F.struct(t.tag_id.alias("tag_id"), t.cand_result.alias("result"), t.cand_prob.alias("probability"))

    def subject(j, k):
        return F.when(j.isNotNull(), F.struct(
            j.subject_id.cast("string").alias("subject_id"), j["name"].alias("name"), j.val_cand.alias("is_valid"), j.val_prob.alias("validation_probability"),
            j.prom_cand.alias("prominence"), j.prom_conf.alias("prominence_confidence"), j.sent_cand.alias("sentiment"), j.sent_conf.alias("sentiment_confidence"),
            F.transform(F.get("places", k).tag_nos, lambda n: tag(F.get("tag_facts", n))).alias("tags")))

    return facts.select("correlation_id", F.filter(F.transform("judged", subject), lambda s: s.isNotNull()).alias("subjects"))


def article_cost_rows(facts: DataFrame, override: float | None = None, keep: tuple = ()) -> DataFrame:
    """Latency and cost per article of a compared run.

    The classification's share of the archived cost counts the input without cached tokens and without the summary and
    rejection prompts, and as output only the compared subjects and tags.
    """
    first = F.get(F.filter("stage_timings", lambda x: F.lower(x.stage).contains("llm")), F.lit(0))
    tokens = F.col("first_tokens") + F.col("second_tokens")
    cost, source = baseline_cost(F.col("llm_cost_usd"), F.col("llm_tokens.input"), F.col("llm_tokens.output"), override)
    subjects = F.transform("subject_facts", lambda x: F.struct(
        x.subject_id.cast("string").alias("subject_id"), x.val_base.alias("is_valid"), x.prom_base.alias("prominence"), x.sent_base.alias("sentiment")))
    tags = F.transform("tag_facts", lambda x: F.struct(x.subject_id.cast("string").alias("subject_id"), x.tag_id.alias("tag_id"), x.base_result.alias("result")))
    none = F.lit("")
    reply = classification_json(F.col("validation_result"), subjects, tags)
    excluded = F.coalesce("excluded_text", none)
    rows = facts.select(
        "correlation_id", "config_id", *keep, F.coalesce(first.duration_ms, F.lit(0.0)).alias("base_duration_ms"),
        (F.col("first_ms") + F.col("second_ms")).alias("cand_duration_ms"), cost.alias("base_cost_usd"), source.alias("base_cost_source"),
        comparable_input(F.col("llm_tokens.input"), F.col("llm_cached_tokens"), excluded).alias("class_input_tokens"), X.char_tokens(reply).alias("class_output_tokens"),
        classification_cost(F.col("llm_tokens.input"), F.col("llm_cached_tokens"), excluded, reply).alias("base_class_cost_usd"),
        L.usage_cost(tokens).alias("cand_cost_usd"), tokens.alias("cand_input_tokens"))
    return article_performance(rows)
