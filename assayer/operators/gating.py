"""Decision rules around the scorer: gates, merges, recalibration and routing."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer import fixed_values as V
from assayer.functions import labels as L, text as X
from assayer.operators import scoring
from assayer.operators.entities import presence_evidence
from assayer.operators.joins import join_by_size, once, rows_of
from assayer.session import written


def effective_threshold(in_lead: Column, unmatched: Column) -> Column:
    return F.when(in_lead, V.LEAD_THRESHOLD).when(unmatched, V.ABSENT_THRESHOLD).otherwise(V.VALIDATION_THRESHOLD)


def validation_gate(rows: DataFrame) -> DataFrame:
    """Threshold and outcome per (article, subject) from p_valid and the presence flags.

    A subject named in the headline is valid outright and is never asked; `noul` is the answer that counts.
    """
    t = effective_threshold(F.col("in_lead"), F.col("unmatched"))
    noul = F.when(F.col("certified"), 1.0).otherwise(F.coalesce("p_valid", F.lit(0.0)))
    passed = F.col("certified") | F.coalesce(F.col("p_valid") >= t, F.lit(True))
    return rows.withColumn("effective_threshold", t).withColumn("noul", noul).withColumn("passed", passed)


def noul_threshold(requested: float | None = None) -> float:
    """Tag threshold: the request wins unless it is missing or the neutral half."""
    return V.TAG_THRESHOLD if requested in (None, V.REQUEST_DEFAULT_THRESHOLD) else requested


def prominence_rules(choice: Column, conf: Column, valid: Column, e: Column, n_headline: Column, max_mentions: Column,
                     n_major: Column) -> Column:
    """Ordered floors and ceilings on prominence; the first rule that applies is consumed even if nothing changes.

    `e` is the evidence struct of the subject; result is struct(choice, confidence).
    """
    def res(c, k):
        return F.struct((c if isinstance(c, Column) else F.lit(c)).alias("choice"), F.lit(k).alias("confidence"))

    same = F.struct(choice.alias("choice"), conf.alias("confidence"))
    m, away = e.mentions, ~e.in_headline
    passing = choice == "passing"
    return (
        F.when(~valid | choice.isNull(), same)
        .when(away & (m <= 1), res("passing", 0.95))
        .when(away & (n_major >= 2), res(F.when(m >= 3, "significant").otherwise("passing"), 0.90))
        .when(away & (max_mentions >= 5) & (m <= 2), res("passing", 0.90))
        .when(away & (e.in_list | (m < 3)),
              F.when(choice == "primary", res(F.when(m >= 2, "significant").otherwise("passing"), 0.85)).otherwise(same))
        .when((m >= 4) & passing, res(F.when(m < 8, "significant").otherwise("primary"), 0.90))
        .when(e.in_headline & passing, res(F.when(n_headline <= 1, "primary").otherwise("significant"), 0.95))
        .when(e.in_lead & passing & (m >= 2), res("significant", 0.90))
        .otherwise(same))


def sentiment_weights(p: Column, adversity: Column) -> list[Column]:
    """Reweighted and renormalised probabilities in vocabulary order, four decimals."""
    pos, neg, neu, bal = (F.coalesce(p[k], F.lit(0.0)) for k in V.SENTIMENT_LABELS)
    hard = adversity & (neg >= 0.25)
    w = [F.when(hard, pos).otherwise(pos * 0.55), F.when(hard, neg * 1.5).otherwise(neg * 0.85),
         F.when(hard, neu * 0.9).otherwise(neu * 1.8), bal * 0.5]
    total = w[0] + w[1] + w[2] + w[3]
    return [F.when(total > 0, L.rounded(x / total, 4)).otherwise(x) for x in w]


def sentiment_recalibration(choice: Column, p: Column, valid: Column, adversity: Column) -> Column:
    """Neutral baseline unless the text shows adversity; first label wins a tie.  struct(choice, probabilities)."""
    def out(w):
        best = F.array_position(w, F.array_max(w)).cast("int")
        labels = F.array(*[F.lit(x) for x in V.SENTIMENT_LABELS])
        return F.struct(F.element_at(labels, best).alias("choice"), F.map_from_arrays(labels, w).alias("probabilities"))

    usable = valid & F.coalesce(F.map_contains_key(p, "neutral"), F.lit(False))
    return F.when(usable, X.let(F.array(*sentiment_weights(p, adversity)), out)).otherwise(
        F.struct(choice.alias("choice"), p.alias("probabilities")))


def subject_qid(subject_id: Column, kind: str) -> Column:
    return F.concat(F.lit("subj_"), subject_id.cast("string"), F.lit(f"_{kind}"))


def _gate_array(evidence: Column, places: Column, first: Column) -> Column:
    def one(e, k):
        p = F.get(first, F.get(places, k).valid_at).noul
        t = effective_threshold(e.in_lead, e.unmatched)
        return F.struct(e.subject_id.alias("subject_id"), F.when(e.certified, 1.0).otherwise(F.coalesce(p, F.lit(0.0))).alias("noul"),
                        t.alias("effective_threshold"), (e.certified | F.coalesce(p >= t, F.lit(True))).alias("passed"))
    return F.transform(evidence, one)


SET_COLUMNS = ("questions", "places", "tag_ids")


def config_sets(question_sets: DataFrame, entity_sets: DataFrame) -> DataFrame:
    """Everything a run needs of a configuration in one row, with the places at which its parts find each other.

    questions: in order, each with the places of its subject (entity_at), of that subject's validation question
    (valid_at) and, for a tag, in tag_ids (tag_at).  places: for each subject, in the order of entities, where its
    questions stand, and the numbers of its tags among the tag questions.  So no later step searches an array.
    """
    wanted = ("qid", "subject_id", "tag_id", "kind", "qtype", "instructions", "criteria_labels", "criteria_texts", "valid_at")
    e = entity_sets.select("config_id", F.posexplode("entities").alias("entity_at", "e")).select("config_id", "entity_at", F.col("e.subject_id").alias("subject_id"))
    q = question_sets.select("config_id", F.posexplode("questions").alias("place", "q")).select("config_id", "place", *[F.col(f"q.{c}") for c in wanted])
    q = q.join(e, ["config_id", "subject_id"], "left")
    is_tag = F.col("kind") == "tag"
    by_config = Window.partitionBy("config_id")
    tag_at = F.when(is_tag, F.dense_rank().over(by_config.orderBy(~is_tag, "tag_id")) - 1)
    tag_no = F.when(is_tag, F.count_if(is_tag).over(by_config.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")
    q = q.withColumn("tag_at", tag_at).withColumn("tag_no", tag_no)
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("place"))).alias(f"{kind}_at")
    of_subject = q.groupBy("config_id", "subject_id").agg(at("validation"), at("prominence"), at("sentiment"), F.array_sort(F.collect_list("tag_no")).alias("tag_nos"))
    places = e.join(of_subject, ["config_id", "subject_id"], "left").groupBy("config_id").agg(F.array_sort(F.collect_list(F.struct(
        "entity_at", F.col("validation_at").alias("valid_at"), "prominence_at", "sentiment_at", "tag_nos"))).alias("places"))
    sets = q.groupBy("config_id").agg(
        F.array_sort(F.collect_list(F.struct("place", F.struct(*wanted, "entity_at", "tag_at").alias("q")))).alias("questions"),
        F.array_sort(F.collect_set(F.when(is_tag, F.col("tag_id")))).alias("tag_ids"))
    sets = sets.withColumn("questions", F.transform("questions", lambda x: x.q))
    return sets.join(entity_sets, "config_id").join(places, "config_id")


def cascade(articles: DataFrame, sets: DataFrame, factory, keep: tuple = (), set_columns: tuple = ()) -> DataFrame:
    """Presence, validation, gate, remaining questions: one row per article from start to end.

    `sets` is the table of config_sets, best written once and read back; further columns of it may ride along.  Everything
    an article needs rides in its own row, so both scorer passes form one narrow pipeline: no shuffle between them,
    nothing to persist, and a lost task is recomputed from its own input alone.  Answers stand at the places of their
    questions.  An article without a configuration stays, unasked, with status `skipped`.
    """
    a = articles.withColumn("state", X.distilled_state(F.col("headline"), F.col("body")))
    r = presence_evidence(a, sets, ("state", *keep), (*SET_COLUMNS, *set_columns), "left")
    r = r.withColumn("status", F.when(F.col("questions").isNull(), "skipped").otherwise("ok"))
    named = lambda q: F.coalesce(F.get(F.col("evidence"), q.entity_at).certified, F.lit(False))
    r = once(r, ask=F.transform("questions", lambda q: (q.kind == "validation") & ~named(q)))
    r = scoring.score(r, factory, "questions", "first", "ask").drop("ask")
    r = once(r, gate=_gate_array(F.col("evidence"), F.col("places"), F.col("first")))
    passed = lambda q: F.coalesce(F.get(F.col("gate"), q.entity_at).passed, F.lit(False))
    r = once(r, ask=F.transform("questions", lambda q: (q.kind != "validation") & passed(q)))
    return scoring.score(r, factory, "questions", "second", "ask").drop("ask")


def decision_arrays(run: DataFrame, consistent: bool = False) -> DataFrame:
    """The run with its final decisions as arrays `subjects` and `tags`: gate defaults, recalibration, rules.

    `subjects` has the order of the configuration's subjects, `tags` that of its tag questions.  By default later steps use
    the plain threshold even where the gate used another one; `consistent` makes them use the gate's own outcome.
    """
    (p_probs, p_conf), (s_probs, s_conf) = V.RUN_GATE["prominence"], V.RUN_GATE["sentiment"]
    gate_probs = F.create_map(*[x for k, v in s_probs.items() for x in (F.lit(k), F.lit(v))])

    def subject(e, k):
        g, place = F.get("gate", k), F.get("places", k)
        pr, se = F.get("second", place.prominence_at), F.get("second", place.sentiment_at)
        valid = g.passed if consistent else g.noul >= V.VALIDATION_THRESHOLD
        answer = F.struct(
            F.when(g.passed, pr.choice).otherwise("passing").alias("p"), F.when(g.passed, pr.confidence).otherwise(p_conf).alias("pc"),
            F.when(g.passed, se.choice).otherwise("neutral").alias("s"), F.when(g.passed, se.probabilities).otherwise(gate_probs).alias("sp"),
            F.when(g.passed, se.confidence).otherwise(s_conf).alias("sc"))

        def final(a):
            prom = prominence_rules(a.p, a.pc, valid, e, F.col("n_headline"), F.col("max_mentions"), F.col("n_major"))
            sent = sentiment_recalibration(a.s, a.sp, valid, F.col("adversity"))
            return F.struct(
                e.subject_id.alias("subject_id"), e["name"].alias("name"), g.noul.alias("p_valid"), g.effective_threshold.alias("effective_threshold"),
                g.passed.alias("passed"), prom.choice.alias("prominence"), prom.confidence.alias("prominence_conf"),
                sent.choice.alias("sentiment"), a.sc.alias("sentiment_conf"), sent.probabilities.alias("sentiment_probs"))

        return X.let(answer, final)

    def tag(q, i):
        g = F.get("gate", q.entity_at)
        return F.when(q.kind == "tag", F.struct(
            q.subject_id.alias("subject_id"), q.tag_id.alias("tag_id"), q.entity_at.alias("entity_at"), q.tag_at.alias("tag_at"), g.noul.alias("p_valid"),
            F.when(g.passed, F.get("second", i).noul).otherwise(0.0).alias("p_tag")))

    return once(run, subjects=F.transform("evidence", subject), tags=F.filter(F.transform("questions", tag), lambda t: t.isNotNull()))


def subject_decisions(run: DataFrame, keep: tuple = (), consistent: bool = False) -> DataFrame:
    """One row per (article, subject) with its final decision."""
    return rows_of(decision_arrays(run, consistent), "subjects", "subject_id", "correlation_id", "config_id", *keep)


def tag_decisions(run: DataFrame, keep: tuple = ()) -> DataFrame:
    """Candidate probability per (article, subject, tag); subjects behind the gate answer 0.0."""
    return rows_of(decision_arrays(run), "tags", "subject_id", "correlation_id", "config_id", *keep)


def _default_answer(q: Column) -> Column:
    """The answer of a question that is not asked: the subject did not pass, so its labels take the default."""
    def labelled(kind, choice):
        probs, conf = V.SERVED_GATE[kind]
        m = F.create_map(*[x for k, v in probs.items() for x in (F.lit(k), F.lit(v))])
        return F.struct(q.qid.alias("qid"), F.lit("choice").alias("type"), F.lit(None).cast("double").alias("noul"), F.lit(choice).alias("choice"),
                        m.alias("probabilities"), F.lit(conf).alias("confidence"))

    tag = F.struct(q.qid.alias("qid"), F.lit("noul").alias("type"), F.lit(0.0).alias("noul"), F.lit(None).cast("string").alias("choice"),
                   F.lit(None).cast("map<string,double>").alias("probabilities"), F.lit(1.0).alias("confidence"))
    return F.when(q.kind == "prominence", labelled("prominence", "passing")).when(q.kind == "sentiment", labelled("sentiment", "neutral")).otherwise(tag)


def two_stage_cascade(requests: DataFrame, factory, threshold: float = V.VALIDATION_THRESHOLD) -> DataFrame:
    """The form used when serving: one plain threshold, other defaults, no presence evidence.

    requests(correlation_id, config_id, state, questions), the questions as question_sets gives them, gains `answers` with
    one answer per question, in their order.  Without both kinds of questions everything is asked at once and nothing is
    gated.
    """
    staged = F.exists("questions", lambda q: q.kind == "validation") & F.exists("questions", lambda q: q.kind != "validation")
    r = once(requests, staged=staged)
    r = once(r, ask=F.transform("questions", lambda q: ~F.col("staged") | (q.kind == "validation")))
    r = scoring.score(r, factory, "questions", "first", "ask").drop("ask")
    passed = lambda q: F.coalesce(F.get(F.col("first"), q.valid_at).noul >= threshold, F.lit(False))
    r = once(r, ask=F.transform("questions", lambda q: F.col("staged") & (q.kind != "validation") & passed(q)))
    r = scoring.score(r, factory, "questions", "second", "ask")
    answers = F.transform("questions", lambda q, i: F.coalesce(F.get(F.col("first"), i), F.get(F.col("second"), i), _default_answer(q)))
    return r.select("correlation_id", "config_id", answers.alias("answers"), (F.col("first_tokens") + F.col("second_tokens")).alias("tokens"))


def merge_answers(*stages: DataFrame) -> DataFrame:
    """Overlay stages of (correlation_id, qid, ...); a later stage wins a question."""
    from functools import reduce

    tagged = [s.withColumn("_stage", F.lit(i)) for i, s in enumerate(stages)]
    every = reduce(DataFrame.unionByName, tagged)
    rest = [c for c in stages[0].columns if c not in ("correlation_id", "qid")]
    return every.groupBy("correlation_id", "qid").agg(F.max_by(F.struct(*rest), "_stage").alias("r")).select("correlation_id", "qid", "r.*")


# --- documented patterns over answers -----------------------------------------------------------------

def score_expectation(probabilities: Column) -> Column:
    """Ordinal score: levels weighted by their probability."""
    return F.aggregate(F.map_entries(probabilities), F.lit(0.0), lambda acc, e: acc + e.key.cast("int") * e.value)


def confidence_route(confidence: Column, high: float = 0.85, mid: float = 0.6) -> Column:
    return F.when(confidence >= high, "automate").when(confidence >= mid, "verify").otherwise("human")


def composite_score(scores: DataFrame, weights: dict[str, float], entity: str) -> DataFrame:
    """Weighted sum of answer scores per entity; weights are a literal map, so no join is needed."""
    m = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    return scores.groupBy(entity).agg(F.sum(F.col("score") * F.coalesce(F.try_element_at(m, F.col("dimension")), F.lit(0.0))).alias("total"))


def self_consistency(answers: DataFrame, tolerance: float) -> DataFrame:
    """Pairs of a question and its inverse whose probabilities do not add up to one; one pass, no self-join."""
    pair = answers.groupBy("correlation_id", "pair_id").agg(
        F.sum("p").alias("p_sum"), F.count("*").alias("n"))
    return pair.filter((F.col("n") == 2) & (F.abs(F.col("p_sum") - 1.0) > tolerance)).drop("n")


def hierarchy_fallback(rows: DataFrame, tree: DataFrame, threshold: float) -> DataFrame:
    """Leaf category when confident, its parent otherwise."""
    j = join_by_size(rows, tree.select(F.col("category").alias("leaf"), "parent"), ["leaf"], "left")
    return j.withColumn("category", F.when(F.col("confidence") >= threshold, F.col("leaf")).otherwise(F.coalesce("parent", "leaf")))


def link_action(score: Column) -> Column:
    level = F.round(score).cast("int")
    return F.when(level <= 0, "leave").when(level == 1, "flag").otherwise("merge")


#: Pairs of a document's term and a query's that one task scores: some hundred MB of scores, whatever the tables hold.
PAIRS_A_TASK = 4_000_000


def lexical_candidates(docs: DataFrame, queries: DataFrame, n: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 top-n documents per query.

    Only counts of terms that some query uses are shuffled, once, by document.  There a document's scores are complete,
    so no (query, document) pair is shuffled but each task's n best of a query.  Documents are dealt over so many tasks that
    each scores about PAIRS_A_TASK pairs of a document's term and a query's, counted before.
    """
    word = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    q_terms = queries.select("query_id", F.explode(F.array_distinct(word)).alias("term"))
    d = docs.select("doc_id", word.alias("w")).withColumn("len", F.size("w"))
    n_docs, avg_len = d.agg(F.count("*")).scalar(), d.agg(F.avg("len")).scalar()
    wanted = q_terms.select("term").distinct()
    tf = join_by_size(d.select("doc_id", "len", F.explode("w").alias("term")), wanted, ["term"], "left_semi").groupBy(
        "doc_id", "len", "term").agg(F.count("*").alias("tf"))
    tf = written(tf, "term-counts")  # read twice below; far smaller than the texts
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weight = df.select("term", F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf"))
    weighted = written(q_terms.join(weight, "term"), "query-terms")
    pairs = weighted.groupBy("term").agg(F.count("*").alias("queries")).join(df, "term").agg(F.sum(F.col("queries") * F.col("df"))).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-pairs // PAIRS_A_TASK))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / avg_len))
    parts = join_by_size(tf.repartition(tasks, "doc_id"), weighted, ["term"]).select("query_id", "doc_id", part.alias("part"))
    hits = parts.groupBy("query_id", "doc_id").agg(L.rounded(F.sum("part"), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


CANDIDATE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "amount": r"[$€£]\s?\d+(?:[.,]\d+)*",
    "date": r"\d{4}-\d{2}-\d{2}",
}


def regex_candidates(docs: DataFrame) -> DataFrame:
    """High-recall extraction of emails, amounts and dates as choice candidates."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("values"))
                      for k, p in CANDIDATE_PATTERNS.items()])
    return docs.select("doc_id", F.inline(found)).select("doc_id", "kind", F.posexplode("values").alias("pos", "value"))


def beam_descent(starts: DataFrame, tree: DataFrame, score, depth: int, beam: int) -> DataFrame:
    """Keep the best paths while descending a category tree of known depth.

    starts(item, node); tree(parent, child); score(item, child) gives a probability Column, so only children of
    kept paths are ever scored.  One join per level, at most `beam` rows per item between levels.
    """
    paths = starts.select("item", "node", F.lit(1.0).alias("p"), F.col("node").cast("string").alias("path"))
    edges = tree.select(F.col("parent").alias("node"), "child")
    w = Window.partitionBy("item").orderBy(F.desc("p"), "path")
    for _ in range(depth):
        step = join_by_size(paths, edges, ["node"])
        p = L.rounded(F.col("p") * score(F.col("item"), F.col("child")), 9)
        step = step.select("item", F.col("child").alias("node"), p.alias("p"), F.concat("path", F.lit(">"), F.col("child").cast("string")).alias("path"))
        paths = step.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= beam).drop("rank")
    return paths
