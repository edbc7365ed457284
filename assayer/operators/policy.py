"""Lint of policy text and validation of rewritten questions."""

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer import fixed_values as V
from assayer.functions import labels as L, text as X
from assayer.operators.store import Store
from assayer.session import written


def alias_names(rows: DataFrame, details: str, keys: list[str]) -> DataFrame:
    """(keys..., names): the names in a JSON text, at any depth.

    From the top, only values under a key `name`, or one that holds `alias`, are followed, through objects and lists; the
    strings met there are names, trimmed.  Each pass goes one level down, until nothing is left to follow.
    """
    key = F.lower("key")
    spark = rows.sparkSession
    level = rows.select(*keys, F.try_parse_json(details).alias("v"), F.lit("").alias("at")).filter(F.col("v").isNotNull())
    found = []
    while True:
        items = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select("key", F.col("value").alias("child")))
        at = F.coalesce(key, F.col("at"))
        items = items.select(*keys, at.alias("at"), F.col("child").alias("v")).filter((F.col("at") == "name") | F.col("at").contains("alias") | (F.col("at") == ""))
        level = written(items, "alias-level")
        found.append(level.filter((F.schema_of_variant("v") == "STRING") & (F.col("at") != "")).select(*keys, X.strip(F.variant_get("v", "$", "string")).alias("name")))
        level = level.filter(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"))
        if level.isEmpty():
            break
    names = reduce(DataFrame.unionByName, found).filter(F.col("name") != "")
    return names.groupBy(*keys).agg(F.array_sort(F.collect_set("name")).alias("names"))


def known_literals(subjects: DataFrame, tags: DataFrame) -> DataFrame:
    """Names a rewrite must keep, per question: the subject's, and for a tag question also the tag's.

    A JSON text in an optional column `details` on either side holds further names (alias_names).
    """
    none = F.array().cast("array<string>")

    def names(df, col, keys):
        own = F.array(X.strip(F.coalesce(F.col(col), F.lit(""))))
        if "details" in df.columns:
            df = df.join(alias_names(df, "details", keys).withColumnRenamed("names", "_more"), keys, "left")
            own = F.concat(own, F.coalesce("_more", none))
        return df.withColumn("_names", F.filter(F.array_distinct(own), lambda x: x != ""))

    s = names(subjects, "name", ["config_id", "subject_id"]).select("config_id", "subject_id", F.col("_names").alias("names"))
    sid = F.col("subject_id").cast("string")
    per_subject = s.select("config_id", F.explode(F.array(*[F.concat(F.lit("subj_"), sid, F.lit(f"_{k}")) for k in ("valid", "prominence", "sentiment")])).alias("qid"),
                           F.col("names").alias("literals"))
    t = names(llm_tags(tags), "tag_name", ["config_id", "subject_id", "tag_id"]).select("config_id", "subject_id", "tag_id", F.col("_names").alias("tag_names")).join(s, ["config_id", "subject_id"])
    per_tag = t.select("config_id", F.concat(F.lit("tag_"), sid, F.lit("_"), "tag_id").alias("qid"), F.array_union("names", "tag_names").alias("literals"))
    return per_subject.unionByName(per_tag).select("config_id", "qid", F.array_sort("literals").alias("literals"))


def llm_tags(tags: DataFrame) -> DataFrame:
    return tags.filter((F.col("evaluation_type") == "llm") & X.filled(F.col("prompt_text")).isNotNull())


def source_texts(subjects: DataFrame, tags: DataFrame) -> DataFrame:
    """Raw policy text behind every question, tag rows with the names of all tags of their subject."""
    sid = F.col("subject_id").cast("string")
    none = F.lit(None).cast("string")
    both = F.concat_ws("\n", X.filled(F.col("entity_definition")), X.filled(F.col("validation_prompt")))

    def row(kind, text):
        return F.struct(F.concat(F.lit("subj_"), sid, F.lit(f"_{kind}")).alias("qid"), F.coalesce(text, F.lit("")).alias("text"))

    s = subjects.select("config_id", F.inline(F.array(row("valid", both), row("prominence", F.col("prominence_prompt")), row("sentiment", F.col("sentiment_prompt")))))
    siblings = F.collect_set("tag_name").over(Window.partitionBy("config_id", "subject_id"))
    t = llm_tags(tags).select("config_id", F.concat(F.lit("tag_"), sid, F.lit("_"), "tag_id").alias("qid"), F.col("prompt_text").alias("text"), "tag_name", siblings.alias("siblings"))
    return s.select("*", none.alias("tag_name"), F.lit(None).cast("array<string>").alias("siblings")).unionByName(t)


def tag_name_mismatch(prompt: Column, name: Column, siblings: Column) -> Column:
    """The prompt names another tag outright, or only a sibling's name."""
    own = X.strip(F.coalesce(name, F.lit("")))
    lc = F.lower(prompt)
    named = F.transform(F.regexp_extract_all(prompt, F.lit("(?iU)" + V.EXPLICIT_TAG_NAME), F.lit(1)), X.strip)
    may = (X.holds_any(lc, V.TAG_STEMS) & X.holds_any(prompt, V.QUOTES)) | prompt.isNull()
    explicit = F.when(may, named).otherwise(F.array().cast("array<string>"))
    sibling = F.exists(siblings, lambda x: (X.strip(x) != "") & (X.strip(x) != own) & lc.contains(F.lower(X.strip(x))))
    other = (F.size(explicit) > 0) & ~F.array_contains(explicit, own)
    return other | ((own != "") & ~lc.contains(F.lower(own)) & sibling)


def detect_anomalies(subjects: DataFrame, tags: DataFrame) -> DataFrame:
    """Questions whose source is no usable policy, with the first code that applies."""
    t = source_texts(subjects, tags)
    code = (
        F.when(X.holds_any(F.lower("text"), V.CONFIGURATOR_STEMS) & F.lower("text").rlike(V.CONFIGURATOR), "configurator_facing")
        .when(X.rule_contradiction(F.col("text")), "contradictory_policy")
        .when(F.col("tag_name").isNotNull() & tag_name_mismatch(F.col("text"), F.col("tag_name"), F.col("siblings")), "tag_name_mismatch"))
    return t.select("config_id", "qid", code.alias("code")).filter(F.col("code").isNotNull())


def all_text(prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    return F.concat_ws("\n", c("qtype"), c("instructions"), c("criteria_texts"))


def canonical_json(prefix: str = "") -> Column:
    """One question of the map in compact JSON, with its key."""
    c = lambda n: F.col(prefix + n)
    body = F.to_json(F.struct(c("qtype").alias("type"), c("instructions").alias("instructions"),
                              F.map_from_arrays(c("criteria_labels"), c("criteria_texts")).alias("criteria")))
    return F.concat(F.lit('"'), F.col("qid"), F.lit('":'), body)


def map_chars(questions: DataFrame) -> DataFrame:
    """Size of each configuration's question map: parts, commas and braces, summed without building the text."""
    return questions.groupBy("config_id").agg((F.sum(F.length(canonical_json())) + F.count("*") + 1).alias("chars"))


def question_diff(source: DataFrame, rewritten: DataFrame, *extra: str) -> DataFrame:
    """Source and rewritten questions side by side, also where one side is missing; `place` is the order in the map.

    Columns `extra` of the source come along."""
    cols = ("place", "qtype", "instructions", "criteria_labels", "criteria_texts")
    s = source.select("config_id", "qid", *[F.col(c).alias(f"s_{c}") for c in cols], *extra)
    r = rewritten.select("config_id", "qid", *[F.col(c).alias(f"r_{c}") for c in cols])
    j = s.join(r, ["config_id", "qid"], "full_outer")
    change = (
        F.when(F.col("r_place").isNull(), "dropped").when(F.col("s_place").isNull(), "added")
        .when(F.col("s_place") != F.col("r_place"), "moved").otherwise("kept"))
    return j.withColumn("change", change)


def places(questions: DataFrame, kept: Column | None = None) -> DataFrame:
    """Place of each question in the map of its configuration, from 1; with `kept`, also `kept_place`, null for the others: the
    place in the map of only those questions, from the same pass over the texts."""
    w = Window.partitionBy("config_id").orderBy("pos", "slot", "qid")
    placed = {"place": F.row_number().over(w)}
    if kept is not None:
        placed["kept_place"] = F.when(kept, F.count_if(kept).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
    return questions.withColumns(placed)


def lost_literals(literals: Column, text: Column) -> Column:
    return F.filter(literals, lambda x: ~text.contains(x))


def has_form(text_lc: Column, search: tuple) -> Column:
    """One output form stands in a text: plain searches go first, then what only few texts match."""
    needs, first, form = search
    out = reduce(lambda a, b: a & b, [X.holds_any(text_lc, words) for words in needs])
    return (out & text_lc.rlike(first) if first else out) & text_lc.rlike(form)


def has_forms(text_lc: Column) -> Column:
    return reduce(lambda a, b: a | b, [has_form(text_lc, search) for search in V.OUTPUT_FORM_SEARCH])


def without_forms(text_lc: Column) -> Column:
    """The text without its output forms, taken out one form after the other; a text without a form skips its replacement."""
    def without(search):
        return lambda t: F.when(has_form(t, search), F.regexp_replace(t, search[2], "")).otherwise(t)

    out = text_lc
    for search in V.OUTPUT_FORM_SEARCH:
        out = X.let(out, without(search))
    return F.when(has_forms(text_lc), out).otherwise(text_lc)


def keeps(text_lc: Column, words: Iterable[str], pattern: str) -> Column:
    """The pattern is found.  Each of `words`, as a whole word, matches it; those are searched for in jumps and settle most texts."""
    quick = [text_lc.contains(w) & text_lc.rlike(rf"{w}(?<=\b{w})\b") for w in words]
    return reduce(lambda a, b: a | b, quick) | text_lc.rlike(pattern)


def with_known(questions: DataFrame, literals: DataFrame, defective: DataFrame) -> DataFrame:
    """Questions with the names they have to keep (`literals`) and whether their source is faulty (`defective`)."""
    on = ["config_id", "qid"]
    return questions.join(literals.select(*on, "literals"), on, "left").join(defective.select(*on, F.lit(True).alias("defective")), on, "left")


def known_diff(source: DataFrame, rewritten: DataFrame, literals: DataFrame, defective: DataFrame) -> DataFrame:
    """question_diff with what is known of a source question.  That joins the source, which keeps its distribution for the
    rewritten side; a full join's output would be dealt out anew, with both texts.  Added questions need neither."""
    return question_diff(with_known(source, literals, defective), rewritten, "literals", "defective")


def judged(d: DataFrame) -> DataFrame:
    """(config_id, qid, codes, chars_before, chars_after) of a known_diff: both sides of a question meet once, for its rules and its sizes."""
    s_text, r_text = all_text("s_"), all_text("r_")
    d = d.withColumn("s_text", s_text).withColumn("r_text", r_text).withColumn("s_lc", F.lower("s_text")).withColumn("r_lc", F.lower("r_text"))
    s, r, s_lc, r_lc = (F.col(c) for c in ("s_text", "r_text", "s_lc", "r_lc"))
    policy = without_forms(s_lc)  # forms start and end with whole words, so taking them out makes no new word
    same = F.lit(True)
    for c in ("qtype", "instructions", "criteria_labels", "criteria_texts"):
        same = same & F.col(f"s_{c}").eqNullSafe(F.col(f"r_{c}"))
    blank = X.is_blank(F.col("r_instructions")) | F.exists("r_criteria_texts", X.is_blank)
    protected = F.array_union(F.array_union(X.quoted_literals(s), X.numeric_literals(s)), F.coalesce("literals", F.array().cast("array<string>")))
    checks = [
        ("type", F.col("s_qtype") != F.col("r_qtype")), ("labels", F.col("s_criteria_labels") != F.col("r_criteria_labels")),
        ("empty_text", blank), ("output_prose", has_forms(r_lc)), ("lost_literal", F.size(lost_literals(protected, r)) > 0)]
    for marker, (stem, have, kept) in V.POLICY_MARKERS.items():
        checks.append((f"lost_{marker}", s_lc.contains(stem) & ~keeps(r_lc, [marker], kept) & policy.rlike(have)))
    checks.append(("lost_negation", ~keeps(r_lc, V.NEGATIONS, V.NEGATION_KEPT) & s_lc.rlike(V.NEGATION_SOURCE)))
    found = F.filter(F.array(*[F.when(hit, code) for code, hit in checks]), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    codes = (
        F.when(F.col("change") != "kept", F.array("change"))
        .when(F.coalesce("defective", F.lit(False)), F.when(same, none).otherwise(F.array(F.lit("not_verbatim"))))
        .otherwise(found))
    chars = lambda side: F.when(F.col(f"{side}_place").isNotNull(), F.length(canonical_json(f"{side}_")))
    return d.select("config_id", "qid", codes.alias("codes"), chars("s").alias("chars_before"), chars("r").alias("chars_after"))


def violations(diff: DataFrame, literals: DataFrame, defective: DataFrame) -> DataFrame:
    """Every rule a rewritten question breaks, as an ordered array of codes; empty means acceptable."""
    return judged(with_known(diff, literals, defective)).select("config_id", "qid", "codes")


def validate_rewrite(source: DataFrame, rewritten: DataFrame, literals: DataFrame, defective: DataFrame) -> DataFrame:
    """One row per configuration: number of broken questions, sizes, and whether the rewrite may be used."""
    size = lambda c: (F.coalesce(F.sum(c), F.lit(0)) + F.count(c) + 1)  # parts, commas and braces; an empty map has two braces
    v = judged(known_diff(source, rewritten, literals, defective)).groupBy("config_id").agg(
        F.count_if(F.size("codes") > 0).alias("broken"), F.count("chars_before").alias("_asked"), size("chars_before").alias("chars_before"), F.greatest(size("chars_after"), F.lit(2)).alias("chars_after"))
    return v.filter("_asked > 0").drop("_asked").withColumn("accepted", (F.col("broken") == 0) & (F.col("chars_after") < F.col("chars_before")))


def rewrite_sizes(source: DataFrame, rewritten: DataFrame) -> DataFrame:
    a = map_chars(source).withColumnRenamed("chars", "chars_before")
    b = map_chars(rewritten).withColumnRenamed("chars", "chars_after")
    return a.join(b, "config_id", "left").withColumn("chars_after", F.coalesce("chars_after", F.lit(2)))


def rewrite_telemetry(source: DataFrame, rewritten: DataFrame, calls: DataFrame) -> DataFrame:
    """Sizes, reduction and price of each rewrite; calls(config_id, input_tokens, output_tokens)."""
    s = rewrite_sizes(source, rewritten).join(calls, "config_id", "left")
    cost = L.token_cost(F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0)))
    gone = F.col("chars_before") - F.col("chars_after")
    return s.select("config_id", "chars_before", "chars_after", gone.alias("reduction"),
                    L.pct(gone, F.col("chars_before")).alias("reduction_pct"), cost.alias("cost_usd"))


def cache_key(questions: DataFrame, *identity: str) -> DataFrame:
    """Content key per configuration over its ordered questions and further identity texts.

    Each question is hashed where it is; only the short hashes are put together."""
    item = F.struct("place", F.sha2(canonical_json(), 256).alias("h"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.h), "|")
    return questions.groupBy("config_id").agg(F.sha2(F.concat_ws("|", *[F.lit(i) for i in identity], parts), 256).alias("cache_key"))


#: A stored rewrite: the key of the source it was made from, its questions, and the sizes it was accepted with.
ARTIFACTS = """cache_key string, config_id string, questions array<struct<qid: string, instructions: string, criteria_texts: array<string>>>, chars_before long, chars_after long"""


def artifact_store(spark, path: str, digits: int = 2) -> Store:
    """Rewrites by content key, in 16 ** digits parts of the key, so a look-up reads its keys' parts alone."""
    return Store(spark, path, ARTIFACTS, ["cache_key"], ["cache_key"], digits)


def parts_of(store: Store, keys: DataFrame) -> list[str]:
    return sorted(r.part for r in keys.select(store.part_of(F.col("cache_key")).alias("part")).distinct().collect())  # at most 16 ** digits names


def store_artifacts(store: Store, source: DataFrame, rewritten: DataFrame, checked: DataFrame, *identity: str) -> int:
    """Store accepted rewrites whose key is not stored yet; returns how many were new.

    checked(config_id, accepted, chars_before, chars_after) comes from validate_rewrite.  An entry that is stored under its
    key is left alone, so a run over unchanged sources writes nothing; a changed source has another key.
    """
    keys = written(cache_key(source, *identity).join(checked.filter("accepted").select("config_id", "chars_before", "chars_after"), "config_id"), "keys")
    have = store.read(parts_of(store, keys)).select("cache_key")
    item = F.struct("qid", "instructions", "criteria_texts")
    texts = rewritten.groupBy("config_id").agg(F.array_sort(F.collect_list(item)).alias("questions"))
    new = written(keys.join(have, "cache_key", "left_anti").join(texts, "config_id"), "artifacts")
    n = new.count()
    if n:
        store.put(new)
    return n


def artifact_reuse(source: DataFrame, store: Store, checked: DataFrame, defective: DataFrame, *identity: str) -> DataFrame:
    """Questions to use: the stored rewrite where its key, sizes and checks hold, else the source; defective ones verbatim.

    The stored text is what is used.  Only the parts of the store that hold one of the wanted keys are read.
    """
    now = written(cache_key(source, *identity), "artifact-keys")
    known = store.read(parts_of(store, now)).drop("config_id").join(now, "cache_key")
    ok = known.join(checked.select("config_id", "accepted", F.col("chars_before").alias("b"), F.col("chars_after").alias("a")), "config_id")
    ok = ok.filter("accepted and chars_before = b and chars_after = a")
    r = ok.select("config_id", F.inline("questions")).join(defective.select("config_id", "qid"), ["config_id", "qid"], "left_anti")
    r = r.select("config_id", "qid", F.col("instructions").alias("new_instructions"), F.col("criteria_texts").alias("new_texts"))
    return source.join(r, ["config_id", "qid"], "left").select(
        "config_id", "qid", F.coalesce("new_instructions", "instructions").alias("instructions"),
        F.coalesce("new_texts", "criteria_texts").alias("criteria_texts"), F.col("new_instructions").isNotNull().alias("reused"))
