"""Typed questions per subject and tag, and their fan-out over articles."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer import fixed_values as V
from assayer.functions import text as X
from assayer.operators.joins import join_by_size


def question_sources(subjects: DataFrame, tags: DataFrame, verbose: bool = False) -> DataFrame:
    """One short row per question of build_questions: its key and order, and the source texts its wording is made of.

    What orders, numbers or picks questions goes on these rows, as the worded texts are many times as long.
    """
    sid = F.col("subject_id").cast("string")
    none = F.lit(None).cast("string")
    s = subjects.withColumn("name", F.coalesce(X.filled(F.col("name")), F.concat(F.lit("Subject "), sid)))

    def row(slot, word, kind, policy, entity=none):
        return F.struct(F.lit(slot).alias("slot"), F.concat(F.lit("subj_"), sid, F.lit(f"_{word}")).alias("qid"), none.alias("tag_id"), F.lit(kind).alias("kind"),
                        entity.alias("entity"), policy.alias("policy"))

    own = lambda col: X.sanitize_heading(F.col(col)) if verbose else none
    per_subject = s.select("config_id", "subject_id", "pos", "name", F.inline(F.array(
        row(0, "valid", "validation", X.sanitize_heading(F.col("validation_prompt")), X.sanitize_heading(F.col("entity_definition"))),
        row(1, "prominence", "prominence", own("prominence_prompt")), row(2, "sentiment", "sentiment", own("sentiment_prompt")))))
    t = tags.filter((F.col("evaluation_type") == "llm") & X.filled(F.col("prompt_text")).isNotNull())
    t = t.drop("name").join(s.select("config_id", "subject_id", "name"), ["config_id", "subject_id"])
    per_tag = t.select(
        "config_id", "subject_id", "pos", "name", (F.col("tag_pos") + 3).cast("int").alias("slot"), F.concat(F.lit("tag_"), sid, F.lit("_"), F.col("tag_id")).alias("qid"),
        "tag_id", F.lit("tag").alias("kind"), none.alias("entity"), X.sanitize_heading(F.col("prompt_text")).alias("policy"),
        F.coalesce(X.filled(F.col("tag_name")), F.col("tag_id")).alias("tag"))
    return per_subject.withColumn("tag", none).unionByName(per_tag)


def worded(sources: DataFrame, verbose: bool = False, max_policy_chars: int | None = None) -> DataFrame:
    """Type, instructions and criteria of each of `question_sources`; further columns come along."""
    texts = V.VERBOSE if verbose else V.TERSE
    kind, name, policy, tag = (F.col(c) for c in ("kind", "name", "policy", "tag"))
    cut = policy if max_policy_chars is None else F.left(policy, F.lit(max_policy_chars))
    values = {
        "valid": {"name": name, "policy": cut, "entity": F.col("entity")}, "prominence": {"name": name}, "sentiment": {"name": name},
        "tag": {"name": name, "policy": X.strip(F.concat(policy, X.tag_guardrail(tag))), "tag": tag}}
    client = {"prominence": V.CLIENT_PROMINENCE, "sentiment": V.CLIENT_SENTIMENT} if verbose else {}

    def instructions(part):
        text = X.fill(texts[part][0], **values[part])
        return F.concat(text, F.when(policy != "", F.concat(F.lit(client[part]), policy)).otherwise("")) if part in client else text

    def by_kind(column):
        parts = {part: column(part) for part in ("valid", "prominence", "sentiment", "tag")}
        return F.when(kind == "validation", parts["valid"]).when(kind == "prominence", parts["prominence"]).when(kind == "sentiment", parts["sentiment"]).otherwise(parts["tag"])

    return sources.select(
        *[c for c in sources.columns if c not in ("name", "entity", "policy", "tag")],
        F.when(kind.isin("prominence", "sentiment"), "choice").otherwise("noul").alias("qtype"), by_kind(instructions).alias("instructions"),
        by_kind(lambda part: F.array(*[F.lit(k) for k in texts[part][1]])).alias("criteria_labels"),
        by_kind(lambda part: F.array(*[X.fill(t, **values[part]) for t in texts[part][1].values()])).alias("criteria_texts"))


def build_questions(subjects: DataFrame, tags: DataFrame, verbose: bool = False, max_policy_chars: int | None = None) -> DataFrame:
    """Validation, prominence and sentiment per subject, then one question per model-judged tag.

    subjects(config_id, pos, subject_id, name, entity_definition, validation_prompt, prominence_prompt,
    sentiment_prompt); tags(config_id, pos, subject_id, tag_pos, tag_id, tag_name, evaluation_type, prompt_text).
    Order is (pos, slot).
    """
    return worded(question_sources(subjects, tags, verbose), verbose, max_policy_chars)


def question_sets(questions: DataFrame) -> DataFrame:
    """All questions of a configuration as one ordered array (bounded by the configuration).

    valid_at is the place in it of the validation question of the same subject, so that answers are found by place.
    """
    place = F.row_number().over(Window.partitionBy("config_id").orderBy("pos", "slot", "qid")) - 1
    placed = questions.withColumn("_place", place)
    placed = placed.withColumn("valid_at", F.max(F.when(F.col("kind") == "validation", F.col("_place"))).over(Window.partitionBy("config_id", "subject_id")))
    item = F.struct("_place", "pos", "slot", "qid", "subject_id", "tag_id", "kind", "qtype", "instructions", "criteria_labels", "criteria_texts", "valid_at")
    sets = placed.groupBy("config_id").agg(F.array_sort(F.collect_list(item)).alias("questions"))
    return sets.withColumn("questions", F.transform("questions", lambda q: q.dropFields("_place")))


def question_fanout(articles: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per article and question; only keys travel, the text stays with the article."""
    keys = articles.select("correlation_id", "config_id")
    return join_by_size(keys, questions.select("config_id", "qid", "subject_id", "tag_id", "kind", "qtype"), ["config_id"])


def request_table(articles: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact scorer input per article: state and the question array of its configuration, without fan-out."""
    state = X.distilled_state(F.col("headline"), F.col("body"))
    rows = articles.select("correlation_id", "config_id", state.alias("state"))
    return join_by_size(rows, sets.select("config_id", "questions"), ["config_id"]).withColumn("question_count", F.size("questions").cast("bigint"))


def parse_qid(qid: Column):
    """Question id to (kind, subject id, tag id)."""
    subj = r"^subj_(.+)_(valid|prominence|sentiment)$"
    tag = r"^tag_([^_]+)_(.+)$"
    word = F.regexp_extract(qid, subj, 2)
    kind = F.when(word == "valid", "validation").when(word != "", word).when(qid.rlike(tag), "tag")
    subject = F.when(word != "", F.regexp_extract(qid, subj, 1)).when(qid.rlike(tag), F.regexp_extract(qid, tag, 1))
    return kind, subject, F.when(qid.rlike(tag), F.regexp_extract(qid, tag, 2))


def normalise_questions(questions: DataFrame) -> DataFrame:
    """Unknown types become choice; criteria of the wrong shape get the default of the type."""
    t = F.lower(F.coalesce(F.col("qtype"), F.lit("choice")))
    qtype = F.when(t.isin("choice", "score", "noul"), t).otherwise("choice")
    shape_ok = (
        F.when(qtype == "choice", F.col("criteria_shape").isin("map", "list"))
        .when(qtype == "score", F.col("criteria_shape") == "list").otherwise(F.col("criteria_shape") == "map"))

    def default(part):
        def arr(k):
            d = V.DEFAULT_CRITERIA[k]
            return F.array(*[F.lit(x) for x in (d if part == "labels" else d.values())])
        return F.when(qtype == "choice", arr("choice")).when(qtype == "score", arr("score")).otherwise(arr("noul"))

    keep = F.coalesce(shape_ok, F.lit(False))
    return questions.select(
        *[c for c in questions.columns if c not in ("qtype", "criteria_shape", "criteria_labels", "criteria_texts")],
        qtype.alias("qtype"),
        F.when(keep, F.col("criteria_labels")).otherwise(default("labels")).alias("criteria_labels"),
        F.when(keep, F.col("criteria_texts")).otherwise(default("texts")).alias("criteria_texts"))


def question_counts(questions: DataFrame) -> DataFrame:
    return questions.groupBy("config_id").agg(
        F.count_distinct("subject_id").alias("n_subjects"), F.count("*").alias("n_questions"))


def resolve_engine(model: Column, provider: Column, rules, default: str) -> Column:
    """First matching rule wins; a rule is (engine, provider hints, model prefixes)."""
    hint, name = F.lower(F.coalesce(provider, F.lit(default))), F.lower(F.coalesce(model, F.lit("")))
    out = None
    for engine, hints, prefixes in rules:
        hit = F.lit(False)
        for h in hints:
            hit = hit | (hint == h)
        for p in prefixes:
            hit = hit | name.startswith(p)
        out = F.when(hit, engine) if out is None else out.when(hit, engine)
    return out.otherwise(default)


def candidate_label(model: Column, rules, default: str) -> Column:
    """Display label: first contained word wins, then the raw name, then the default."""
    name = F.lower(F.coalesce(model, F.lit("")))
    out = F.when(F.lit(False), "")
    for word, label in rules:
        out = out.when(name.contains(word), label)
    return out.when(name != "", model).otherwise(default)
