"""Question assembly, rewrite checks, boolean tags and rules on small fixtures."""

import re

import pytest
from pyspark.sql import functions as F

from assayer import fixed_values as V
from assayer.session import written
from assayer.operators import contract as C, gating as G, policy as P, questions as Q, scoring as S, training as T
from assayer.plans import q_policy
from assayer.sources.tables import Domain

SUBJECTS = "config_id STRING, pos INT, subject_id LONG, name STRING, entity_definition STRING, validation_prompt STRING, prominence_prompt STRING, sentiment_prompt STRING"
TAGS = "config_id STRING, pos INT, subject_id LONG, tag_pos INT, tag_id STRING, tag_name STRING, evaluation_type STRING, prompt_text STRING"


def subjects(spark, *rows):
    return spark.createDataFrame([("k", i, sid, name, "", prompt, "", "") for i, (sid, name, prompt) in enumerate(rows)], SUBJECTS)


def tags(spark, *rows):
    return spark.createDataFrame([("k", 0, sid, i, tid, name, kind, text) for i, (sid, tid, name, kind, text) in enumerate(rows)], TAGS)


def built(spark):
    s = subjects(spark, (7, "Acme", "## Only Acme stories"), (8, None, ""))
    t = tags(spark, (7, "a_b", "AI", "llm", "Is it on AI?"), (7, "kw", "Word", "boolean", ""))
    return Q.build_questions(s, t)


def test_question_order_types_and_labels(spark):
    rows = built(spark).orderBy("pos", "slot").collect()
    assert [r.qid for r in rows] == ["subj_7_valid", "subj_7_prominence", "subj_7_sentiment", "tag_7_a_b", "subj_8_valid", "subj_8_prominence", "subj_8_sentiment"]
    assert [r.qtype for r in rows] == ["noul", "choice", "choice", "noul", "noul", "choice", "choice"]
    assert tuple(rows[1].criteria_labels) == V.PROMINENCE_LABELS and tuple(rows[2].criteria_labels) == V.SENTIMENT_LABELS
    assert rows[0].criteria_texts[0] == "Content satisfies validation criteria for Acme: Only Acme stories"
    assert rows[3].criteria_texts[0] == "Criteria satisfied for AI: Is it on AI?" + V.AI_GUARD
    assert "'Subject 8'" in rows[4].instructions


def test_validation_policy_is_whole_unless_cut(spark):
    s = subjects(spark, (1, "A", "x" * 900))
    assert Q.build_questions(s, tags(spark)).filter("slot = 0").first().criteria_texts[0].endswith(": " + "x" * 900)
    cut = Q.build_questions(s, tags(spark), max_policy_chars=V.VALIDATION_CRITERIA_MAX_CHARS).filter("slot = 0").first()
    assert cut.criteria_texts[0].endswith(": " + "x" * V.VALIDATION_CRITERIA_MAX_CHARS)


def test_names_that_look_like_placeholders(spark):
    q = Q.build_questions(subjects(spark, (1, "{policy}", "p")), tags(spark)).filter("slot = 0").first()
    assert q.criteria_texts[0] == "Content satisfies validation criteria for {policy}: p"


def test_parse_qid(spark):
    df = spark.createDataFrame([("subj_1_valid",), ("subj_a_b_sentiment",), ("tag_3_x_y",), ("z",)], ["q"])
    k, s, t = Q.parse_qid(F.col("q"))
    assert [tuple(r) for r in df.select(k, s, t).collect()] == [("validation", "1", None), ("sentiment", "a_b", None), ("tag", "3", "x_y"), (None, None, None)]


def question(qid, pos, ins, texts=("keep \"Acme\" not others", "no"), qtype="noul", labels=("true", "false")):
    return ("k", qid, pos, 0, qtype, ins, list(labels), list(texts))


QS = "config_id STRING, qid STRING, pos INT, slot INT, qtype STRING, instructions STRING, criteria_labels ARRAY<STRING>, criteria_texts ARRAY<STRING>"
SOURCE = [question("a", 0, "Please decide with care whether this only concerns 'Beta' and 10% of it"), question("b", 1, "Include when relevant, exclude otherwise, unless told")]


def check(spark, new, defective=()):
    src, rew = (P.places(spark.createDataFrame(x, QS)) for x in (SOURCE, new))
    lits = spark.createDataFrame([("k", "a", ["Acme"])], "config_id STRING, qid STRING, literals ARRAY<STRING>")
    bad = spark.createDataFrame([("k", q) for q in defective], "config_id STRING, qid STRING")
    codes = {r.qid: r.codes for r in P.violations(P.question_diff(src, rew), lits, bad).collect()}
    return codes, P.validate_rewrite(src, rew, lits, bad).first()


GOOD = [question("a", 0, "Only 'Beta' and 10%?"), question("b", 1, "Include when relevant, exclude otherwise, unless")]


def test_good_rewrite(spark):
    codes, total = check(spark, GOOD)
    assert codes == {"a": [], "b": []} and total.accepted and total.broken == 0


@pytest.mark.parametrize("row,code", [
    (question("a", 0, "Only 'Beta' and 10%?", qtype="choice"), "type"),
    (question("a", 0, "Only 'Beta' and 10%?", labels=("yes", "false")), "labels"),
    (question("a", 0, " "), "empty_text"),
    (question("a", 0, "Only 'Beta' and 10%? Respond with JSON"), "output_prose"),
    (question("a", 0, "Only 'Beta'?"), "lost_literal"),
    (question("a", 0, "'Beta' and 10%?"), "lost_only"),
    (question("a", 0, "Only 'Beta' and 10%?", texts=("keep \"Acme\"", "no")), "lost_negation"),
])
def test_unsafe_rewrites(spark, row, code):
    codes, total = check(spark, [row, GOOD[1]])
    assert code in codes["a"] and not total.accepted


def test_dropped_question_and_growth(spark):
    codes, total = check(spark, GOOD[:1])
    assert codes["b"] == ["dropped"] and not total.accepted
    grown = [question("a", 0, SOURCE[0][5] + " more"), SOURCE[1]]
    codes, total = check(spark, grown)
    assert codes["a"] == [] and not total.accepted


def test_defective_question_stays_verbatim(spark):
    codes, _ = check(spark, GOOD, defective=("b",))
    assert codes["b"] == ["not_verbatim"]
    codes, _ = check(spark, [GOOD[0], SOURCE[1]], defective=("b",))
    assert codes["b"] == []


def test_sizes_match_compact_json(spark):
    import json
    doc = {r[1]: {"type": r[4], "instructions": r[5], "criteria": dict(zip(r[6], r[7]))} for r in SOURCE}
    n = P.map_chars(spark.createDataFrame(SOURCE, QS)).first().chars
    assert n == len(json.dumps(doc, ensure_ascii=False, separators=(",", ":")))


def test_anomalies(spark):
    s = subjects(spark, (1, "Acme", "Please specify the criteria"), (2, "Beta", 'Include "X". Exclude "X".'))
    t = tags(spark, (1, "t1", "Sports", "llm", 'Use the tag "Finance" here'), (1, "t2", "Finance", "llm", "Finance only"), (1, "t3", "Music", "llm", "All about finance"))
    got = {r.qid: r.code for r in P.detect_anomalies(s, t).collect()}
    assert got == {"subj_1_valid": "configurator_facing", "subj_2_valid": "contradictory_policy", "tag_1_t1": "tag_name_mismatch", "tag_1_t3": "tag_name_mismatch"}


def test_boolean_grammar(spark):
    a = spark.createDataFrame([("c", "k", "Big News", "A quick brown fox isn't here", "", "en", "radio", "wire", '{"kind": "x1"}')],
                              "correlation_id STRING, config_id STRING, headline STRING, body STRING, country STRING, language STRING, media_type STRING, source STRING, metadata STRING")
    cases = {"fox": (True, False), "FOX AND cat": (False, False), "cat OR NOT dog AND fox": (True, False), "NOT (fox OR dog)": (False, False), '"quick brown"': (True, False),
             "“brown quick”": (False, False), "qui*": (True, False), 'country:""': (True, False), 'language:""': (False, False), "language:EN AND media_type:radio": (True, False),
             "metadata.kind:x1": (True, False), "isn't": (True, False), "fox AND (": (False, True), "AND fox": (False, True), "fox cat": (False, True), "fox AND": (False, True), "fox OR": (False, True), "fox NOT": (False, True), "NOT": (False, True), "AND": (False, True),
             "NOT AND fox": (False, True), "NOT ()": (False, True), "()": (False, True), "fox AND AND fox": (False, True), "fox)": (False, True), "NOT NOT fox": (True, False), "news": (True, False)}
    t = spark.createDataFrame([("k", 1, str(i), e) for i, e in enumerate(cases)], "config_id STRING, subject_id INT, tag_id STRING, boolean_expression STRING")
    got = {r.tag_id: (r.result, r.invalid) for r in C.boolean_tags(a, t).collect()}
    assert got == {str(i): v for i, v in enumerate(cases.values())}


def test_boolean_many_expressions_in_one_plan(spark):
    a = spark.createDataFrame([("c", "k", "w1 w5 w9", "", "", "", "", "", "{}")], "correlation_id STRING, config_id STRING, headline STRING, body STRING, country STRING, language STRING, media_type STRING, source STRING, metadata STRING")
    t = spark.createDataFrame([("k", 1, str(i), f"w{i} AND NOT v{i}") for i in range(2000)], "config_id STRING, subject_id INT, tag_id STRING, boolean_expression STRING")
    rows = C.boolean_tags(a, t).collect()
    assert len(rows) == 2000 and {r.tag_id for r in rows if r.result} == {"1", "5", "9"} and not any(r.invalid for r in rows)


def test_later_stage_wins(spark):
    a = spark.createDataFrame([("c", "q1", "model"), ("c", "q2", "model")], "correlation_id STRING, qid STRING, choice STRING")
    b = spark.createDataFrame([("c", "q1", "gate")], "correlation_id STRING, qid STRING, choice STRING")
    assert {r.qid: r.choice for r in G.merge_answers(a, b).collect()} == {"q1": "gate", "q2": "model"}


def flow(spark):
    from assayer.operators import entities as E
    s = subjects(spark, (1, "Acme", ""), (2, "Nowhere", "")).withColumn("subject_id", F.col("subject_id").cast("int"))
    t = tags(spark, (1, "t", "T", "llm", "x"), (2, "t", "T", "llm", "x")).withColumn("subject_id", F.col("subject_id").cast("int"))
    return G.config_sets(Q.question_sets(Q.build_questions(s, t)), E.entity_sets(s))


def test_gate_never_asks_what_it_excludes(spark):
    def watchful():
        def predict(ids, states, asks):
            out = []
            for a in asks:
                kinds = {x["kind"] for x in a}
                assert kinds == {"validation"} or "validation" not in kinds
                assert all(x["subject_id"] != 1 for x in a if x["kind"] == "validation")  # named in the headline
                assert all(x["subject_id"] == 1 for x in a if x["kind"] != "validation")  # the other one fails its gate
                out.append(([{"qid": x["qid"], "type": x["qtype"], "noul": 0.6, "choice": "primary" if x["kind"] == "prominence" else "positive",
                              "probabilities": [("neutral", 0.5), ("positive", 0.5)], "confidence": 0.7} for x in a], 1, 1.0))
            return out
        return predict

    a = spark.createDataFrame([("c1", "k", "Acme opens a plant", "Acme said so.\nAcme again and Acme.")], "correlation_id STRING, config_id STRING, headline STRING, body STRING")
    d = {r.subject_id: r for r in G.subject_decisions(G.cascade(a, flow(spark), watchful)).collect()}
    assert d[1].p_valid == 1.0 and d[1].passed and d[1].prominence == "primary"
    assert d[2].effective_threshold == 0.65 and not d[2].passed and d[2].prominence == "passing"
    t = {r.subject_id: r.p_tag for r in G.tag_decisions(G.cascade(a, flow(spark), watchful)).collect()}
    assert t == {1: 0.6, 2: 0.0}


def test_consistent_flag_follows_the_gate(spark):
    a = spark.createDataFrame([("c1", "k", "no name", "nothing here")], "correlation_id STRING, config_id STRING, headline STRING, body STRING")

    def half():
        return lambda ids, states, asks: [([{"qid": x["qid"], "type": "noul", "noul": 0.5, "confidence": 1.0} for x in a], 1, 1.0) for a in asks]

    run = G.cascade(a, flow(spark), half)
    assert not any(r.passed for r in G.subject_decisions(run, consistent=True).collect())
    assert all(r.p_valid == 0.5 for r in G.subject_decisions(run).collect())


def test_tokenizing(spark):
    sets = flow(spark)
    a = spark.sql("""select 'c1' as correlation_id, 'k' as config_id, 'one two three' as state, array(named_struct('subject_id','1','is_valid',true,'prominence','passing','sentiment','odd')) as subject_results,
      array(named_struct('tag_id','t','result',false)) as base_tags""")
    rows = {r.qid: r for r in T.tokenize_sequences(a, sets, T.whitespace_tokenizer).collect()}
    assert set(rows) == {"subj_1_valid", "subj_1_prominence", "tag_1_t", "tag_2_t"}  # unknown sentiment drops out
    v = rows["subj_1_valid"]
    encode = T.whitespace_tokenizer()
    q = next(x for x in sets.first().questions if x.qid == "subj_1_valid")
    head, marks = encode(q.instructions), []
    for label, text in zip(q.criteria_labels, q.criteria_texts):
        marks.append(len(head))
        head += [1, *encode(f"{label}: {text}")]
    assert list(v.ids) == head + encode("one two three") and list(v.markers) == marks and list(v.target) == [0.0, 1.0] and v.qtype == 2
    short = {r.qid for r in T.tokenize_sequences(a, sets, T.whitespace_tokenizer, head_len=30).collect()}
    assert short < set(rows)


def test_windows_lose_no_token(spark):
    """Whatever the lengths: the windows of a state cover it from end to end and share the stated overlap."""
    import random
    rng = random.Random(4)
    sets = flow(spark)
    states = [("", 0), ("one", 1)] + [(" ".join(f"w{i}" for i in range(n)), n) for n in (1, 30, 31, 32, 500, *(rng.randrange(1, 400) for _ in range(20)))] + [(None, 0)]
    a = spark.createDataFrame([(f"c{i}", "k", s, [("1", True, "passing", "neutral")], [("t", True)]) for i, (s, _) in enumerate(states)],
                              "correlation_id STRING, config_id STRING, state STRING, subject_results ARRAY<STRUCT<subject_id: STRING, is_valid: BOOLEAN, prominence: STRING, sentiment: STRING>>, base_tags ARRAY<STRUCT<tag_id: STRING, result: BOOLEAN>>")
    encode, refused = T.whitespace_tokenizer(), 0
    for max_len, overlap in ((1024, 128), (170, 16), (170, 0), (170, 500), (40, 4)):
        rows = T.encode_windows(a, sets, T.whitespace_tokenizer, max_len=max_len, overlap=overlap)
        by = {}
        for r in T.sequences(rows).collect():
            by.setdefault((r.correlation_id, r.qid), []).append(r)
        lost = T.quarantined(rows).collect()
        refused += len(lost)
        assert all(r.reason in (T.HEAD_TOO_LONG, T.NO_ROOM) and r.head_tokens >= max_len for r in lost)
        assert len(by) + len(lost) == len(states) * 5  # three subject questions and the tag of both subjects
        for (c, _), ws in by.items():
            body, ws = encode(states[int(c[1:])][0] or ""), sorted(ws, key=lambda r: r.window)
            head = ws[0].head_tokens
            room = max_len - head
            seen = set()
            for k, w in enumerate(ws):
                assert len(w.ids) <= max_len and w.windows == len(ws) and w.window == k and list(w.ids[:head]) == list(ws[0].ids[:head])
                assert list(w.ids[head:]) == body[w.state_start:w.state_start + room]
                assert k == 0 or w.state_start == ws[k - 1].state_start + max(1, room - overlap)
                assert all(w.ids[m] == 1 for m in w.markers[:1])
                seen |= set(range(w.state_start, w.state_start + len(w.ids) - head))
            assert seen == set(range(len(body))) and ws[0].state_tokens == len(body)
    assert refused


def test_temperatures_are_the_minimum(spark):
    import math
    import random
    from assayer.operators import evaluate as E
    rng = random.Random(8)
    rows = [("validation" if i % 2 else "prominence", rng.randrange(2 if i % 2 else 3), [rng.gauss(0, 3) for _ in range(2 if i % 2 else 3)]) for i in range(400)]
    rows = [(k, l, [x + (2.0 if j == l and rng.random() < 0.7 else 0) for j, x in enumerate(z)]) for k, l, z in rows]
    fit = {r.qtype: r for r in E.fit_temperature(spark.createDataFrame(rows, "kind STRING, label INT, logits ARRAY<DOUBLE>")).collect()}

    def loss(kinds, t):
        return sum(math.log(sum(math.exp((x - max(z)) / t) for x in z)) - (z[l] - max(z)) / t for k, l, z in rows if k in kinds)

    for qtype, kinds in (("noul", ("validation",)), ("choice", ("prominence",))):
        t = fit[qtype].temperature
        lo, hi = 0.1, 8.0
        for _ in range(200):
            a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            lo, hi = (lo, b) if loss(kinds, a) < loss(kinds, b) else (a, hi)
        assert abs(t - lo) < 2e-4 and fit[qtype].n == 200
    assert (fit["score"].n, fit["score"].temperature) == (0, 1.0)
    sure = [("tag", 1, [0.0, 5.0])] * 10  # the loss only falls with the temperature
    assert {r.qtype: r.temperature for r in E.fit_temperature(spark.createDataFrame(sure, "kind STRING, label INT, logits ARRAY<DOUBLE>")).collect()}["noul"] == 0.1
    wrong = [("tag", 0, [0.0, 5.0])] * 10
    assert {r.qtype: r.temperature for r in E.fit_temperature(spark.createDataFrame(wrong, "kind STRING, label INT, logits ARRAY<DOUBLE>")).collect()}["noul"] == 8.0


def test_names_at_any_depth(spark):
    import json
    docs = {1: {"name": " A ", "aliases": ["B", "", 7, None, {"name": "C", "note": "no"}, [["D", {"alias_x": {"deep": "no", "name": ["E"]}}]]], "tags": {"alias": "no"}, "Former_Alias": "F"},
            2: {"aliases": {"x": "no"}}, 3: "just text", 4: ["no key"], 5: {"name": {"name": {"name": {"name": "G"}}}}}
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs.items()] + [(6, "{broken"), (7, None)], "subject_id INT, details STRING")
    got = {r.subject_id: r.names for r in P.alias_names(rows, "details", ["subject_id"]).collect()}
    assert got == {1: ["A", "B", "C", "D", "E", "F"], 5: ["G"]}
    s = subjects(spark, (1, "Acme", "")).withColumn("details", F.lit(json.dumps(docs[1])))
    lits = {r.qid: r.literals for r in P.known_literals(s, tags(spark, (1, "t", "T", "llm", "x"))).collect()}
    assert lits["subj_1_valid"] == ["A", "Acme", "B", "C", "D", "E", "F"] and lits["tag_1_t"] == ["A", "Acme", "B", "C", "D", "E", "F", "T"]


def test_many_subjects_in_one_configuration(spark):
    """2,000 subjects: few are looked at in a text, and the evidence is that of looking at them all."""
    import time
    from assayer.operators import entities as E
    words = ["alpha", "brava", "charly", "deltic", "echoes", "foxtro", "golfer", "hotelo", "indigo", "juliet"]
    names = [f"{words[i % 10]}{i} {words[i // 10 % 10]} Corp" if i % 3 else f"{words[i % 10]}{i}-{words[i // 7 % 10]}z (A{i}B)" for i in range(2000)]
    s = spark.createDataFrame([("k", i, i, n) for i, n in enumerate(names)], "config_id STRING, pos INT, subject_id INT, name STRING")
    sets = E.entity_sets(s)
    body = " ".join(f"and {names[i * 37]}, at the conference (x, {names[i * 11].upper()}) said; a+{names[i]}+b" for i in range(40)) + " filler words of prose" * 2000
    a = spark.createDataFrame([(f"c{i}", "k", names[i], body) for i in range(6)], "correlation_id STRING, config_id STRING, headline STRING, body STRING")
    t0 = time.time()
    fast = {r.correlation_id: r for r in E.presence_evidence(a, sets).collect()}
    took = time.time() - t0
    every = sets.withColumn("entities", F.transform("entities", lambda e: e.withField("runs", F.array(F.lit(""))))).withColumn("run_index", F.array(F.lit("")))
    slow = {r.correlation_id: r for r in E.presence_evidence(a.limit(1), every).collect()}
    assert all(fast[c].evidence == slow[c].evidence for c in slow) and sum(e.mentions > 0 for e in fast["c0"].evidence) > 60
    assert took < 60


def test_a_large_configuration_is_decided_in_linear_time(spark):
    """100 subjects with 20 tags each; twice the tags take less than four times as long."""
    import time
    from assayer.operators import compare as K, entities as E

    def run(n_tags):
        s = subjects(spark, *[(i, f"Subject{i}", "") for i in range(100)]).withColumn("subject_id", F.col("subject_id").cast("int"))
        t = tags(spark, *[(i, f"t{j}", f"T{j}", "llm", "x") for i in range(100) for j in range(n_tags)]).withColumn("subject_id", F.col("subject_id").cast("int"))
        sets = written(G.config_sets(Q.question_sets(Q.build_questions(s, t)), E.entity_sets(s)).withColumn("excluded_text", F.lit("")), "large-config")
        a = spark.range(24).select(F.concat(F.lit("c"), "id").alias("correlation_id"), F.when(F.col("id") == 0, "unknown").otherwise("k").alias("config_id"), F.concat(F.lit("Subject"), F.col("id")).alias("headline"), F.lit("Subject5 and Subject7").alias("body"),
                                   F.expr("transform(sequence(0, 99, 2), i -> struct(cast(i as string) as subject_id, true as is_valid, 'passing' as prominence, 'neutral' as sentiment))").alias("subject_results"),
                                   F.expr(f"transform(sequence(0, {n_tags - 1}, 3), i -> struct(concat('t', i) as tag_id, true as result))").alias("base_tags"))
        t0 = time.time()
        counts = K.run_counts_once(G.cascade(a, sets, S.hash_scorer, ("subject_results", "base_tags"), ("excluded_text",)), ["correlation_id"]).collect()
        return time.time() - t0, {r.correlation_id: (r.subjects, r.tag_total) for r in counts}

    run(5)
    small, _ = run(20)
    large, counts = run(40)
    assert counts["c1"] == (50, 4000) and counts["c0"] == (0, 0) and len(counts) == 24
    assert large < 4 * small + 2


def test_training_and_run_see_the_same_state(spark):
    """Both flows build the state with one function, from the same columns."""
    import inspect
    from assayer.plans import q_training
    assert "distilled_state" in inspect.getsource(G.cascade) and "distilled_state" in inspect.getsource(q_training)


def test_rules_fold_in_order(spark):
    a = spark.sql("""select 'c' as correlation_id, 'k' as config_id, 'en' as language, array('x') as tags,
      array(named_struct('subject_id','1','is_valid',true,'prominence','passing','sentiment','neutral')) as subjects""")
    rules = spark.sql("""select 'k' as config_id, array(
      named_struct('order', 2, 'rule_id', 'second', 'conditions', array(named_struct('field','tag','operator','equals','value','y')), 'actions', array(named_struct('action_type','remove_tag','value','x'))),
      named_struct('order', 1, 'rule_id', 'first', 'conditions', array(named_struct('field','valid:1','operator','equals','value','true')),
        'actions', array(named_struct('action_type','add_tag','value','y'), named_struct('action_type','set_subject_status','value','1=false')))) as rules""")
    r = C.apply_rules(a, rules).first()
    assert r.tags == ["y"] and r.trace == ["first", "second"] and r.subjects[0].is_valid is False
    plain = C.apply_rules(a.withColumn("config_id", F.lit("none")), rules).first()
    assert plain.tags == ["x"] and plain.trace == []


def test_scorer_skips_articles_without_questions(spark):
    calls = spark.sql("select 'c' as correlation_id, 's' as state, filter(array(named_struct('qid','q','qtype','noul','criteria_labels',array('a'))), x -> false) as ask")

    def never():
        def predict(ids, states, asks):
            assert not ids
            return []
        return predict

    assert S.score(calls, never, "ask", "out").first().out == []


def test_stand_in_answers_depend_on_the_state():
    ask = [{"qid": "subj_1_valid", "qtype": "noul"}, {"qid": "subj_1_sentiment", "qtype": "choice", "criteria_labels": ["a", "b", "c"]}]
    seen, empty, again = (S.hash_scorer()(["c1"], [s], [ask])[0][0] for s in ("whole text", "", "whole text"))
    assert seen == again and seen != empty


def test_scorer_gets_few_articles_at_a_time_and_each_its_own_questions(spark):
    """600 articles in one Arrow batch: no call has more than BATCH_ROWS, and lists are kept apart by what they hold."""
    def counting():
        return lambda ids, states, asks: [([{"qid": q["qid"], "type": "choice", "choice": f"{len(ids)}|{q['instructions']}|{s}", "confidence": 1.0} for q in a], 1, 1.0) for s, a in zip(states, asks)]

    i = F.col("id")
    text = F.concat(F.lit("i"), (i % 7).cast("string"))  # one configuration name, questions that differ all the same
    question = lambda n: F.struct(F.lit(n).alias("qid"), F.concat(text, F.lit(n)).alias("instructions"))
    r = spark.range(0, 600, 1, 1).select(i.cast("string").alias("correlation_id"), F.lit("k").alias("config_id"), F.concat(F.lit("s"), i.cast("string")).alias("state"),
                                         F.array(question("a"), question("b")).alias("questions"), F.array(i % 2 == 0, i % 3 == 0).alias("mask"))
    sizes = set()
    for x in S.score(r, counting, "questions", "out", "mask").collect():
        n = int(x.correlation_id)
        assert [a is not None for a in x.out] == [n % 2 == 0, n % 3 == 0]
        for name, a in zip("ab", x.out):
            if a:
                size, asked, state = a.choice.split("|")
                sizes.add(int(size))
                assert (asked, state) == (f"i{n % 7}{name}", f"s{n}")
    assert max(sizes) <= S.BATCH_ROWS


def test_lexical_scores_are_dealt_over_more_tasks_as_pairs_grow(spark, monkeypatch):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("red "), F.when(F.col("id") % 3 == 0, "blue blue").otherwise("green"), F.lit(" w"), F.col("id").cast("string")).alias("text"))
    queries = spark.createDataFrame([(1, "blue w3"), (2, "green red"), (3, "w7")], "query_id int, text string")
    found = lambda: sorted(map(tuple, G.lexical_candidates(docs, queries, 4).collect()))
    want = found()
    monkeypatch.setattr(G, "PAIRS_A_TASK", 5)
    assert found() == want and len(want) == 9
    plan = G.lexical_candidates(docs, queries, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert max(int(n) for n in re.findall(r"RepartitionByExpression \[[^\]]*\], (\d+)", plan)) >= 20


FORM_TEXTS = ["", "return exactly one", "returns exactly", "xreturn exactly", "return\n exactly.", "please respond  with json", "respondwith", "output only", "output\texactly it", "outputs only",
              "true only", "true \n only x", "untrue only", "only  only", "include only", "neutral only.", "no other text", "no  explanation", "piano other text", "no other context", "api choice", "rapi choice",
              "api\nchoice!", "xjson json_", "(json)", "return return exactly exactly", "output return exactly only", "true only only true only", "include api choice if it is not json, unless before"]


def test_forms_are_found_and_taken_out_as_their_patterns_say(spark):
    t = spark.createDataFrame([(x,) for x in FORM_TEXTS], "t STRING")
    plain = F.col("t")
    for p in V.OUTPUT_FORMS:
        plain = F.regexp_replace(plain, p, "")
    each = [P.has_form(F.col("t"), s) == F.col("t").rlike(p) for s, p in zip(V.OUTPUT_FORM_SEARCH, V.OUTPUT_FORMS, strict=True)]
    rows = t.select("t", F.array(*each).alias("same"), (P.without_forms(F.col("t")) == plain).alias("out")).collect()
    assert [r.t for r in rows if not (all(r.same) and r.out)] == []


def test_words_that_settle_a_check_match_its_pattern(spark):
    for words, pattern in [(V.NEGATIONS, V.NEGATION_KEPT), *[([m], kept) for m, (_, _, kept) in V.POLICY_MARKERS.items()]]:
        texts = [f(w) for w in words for f in (str, lambda w: f"x\n{w}.", lambda w: f"x{w}", lambda w: f"{w}x {w}_")]
        t = spark.createDataFrame([(x,) for x in texts], "t STRING")
        assert t.filter(P.keeps(F.col("t"), words, pattern) != F.col("t").rlike(pattern)).count() == 0


def test_both_texts_of_a_question_are_dealt_out_once(spark):
    src, rew = (P.places(spark.createDataFrame(x, QS)) for x in (SOURCE, GOOD))
    lits = spark.createDataFrame([("k", "a", ["Acme"])], "config_id STRING, qid STRING, literals ARRAY<STRING>")
    bad = spark.createDataFrame([("k", "b")], "config_id STRING, qid STRING")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = P.validate_rewrite(src, rew, lits, bad)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    deals = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "qid" in line.split("ENSURE")[0].split("hashpartitioning")[1].split("),")[0]]
    assert len(deals) == 4  # source, literals, defective and rewritten questions; not what came of their joins


def test_places_among_kept_questions_are_those_of_their_own_map(spark):
    q = spark.createDataFrame([("k" if i % 3 else "m", f"q{i % 5}_{i}", i % 7, i % 2, None if i % 11 == 0 else i) for i in range(60)], "config_id STRING, qid STRING, pos INT, slot INT, n INT")
    kept = F.col("n") % 4 != 1  # null for some, which a filter drops
    both = P.places(q, kept=kept)
    assert both.drop("kept_place").exceptAll(P.places(q)).isEmpty()
    own = lambda df, c: sorted((r.config_id, r.qid, r[c]) for r in df.collect())
    assert own(both.filter("kept_place is not null"), "kept_place") == own(P.places(q.filter(kept)), "place")


def test_rewritten_questions_are_read_and_not_dealt_out_again(spark):
    """Places and faulty questions are known before the questions are written."""
    src, new, _, _ = q_policy.rewrite_case(Domain(spark, "/root/testdata/sf0.001"))
    for side in (src, new):
        assert "Exchange" not in side._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, new.select("config_id", "qid", "place").collect())) == sorted(map(tuple, P.places(new.drop("place")).select("config_id", "qid", "place").collect()))


def test_rewrites_order_and_keep_short_sources_not_worded_texts(spark):
    """Places are found on, and the written table holds, what the questions are made of; the wording is the same."""
    d = Domain(spark, "/root/testdata/sf0.001")
    src, new, _, _ = q_policy.rewrite_case(d)
    for side in (src, new):
        kept = spark.read.parquet(*side.inputFiles()).columns
        assert "qid" in kept and not {"instructions", "criteria_texts"} & set(kept)
    plain = P.places(Q.build_questions(d.policy_subjects, d.policy_tags, verbose=True))
    assert plain.count() == src.count() and plain.exceptAll(src.select(plain.columns)).isEmpty()


def test_policies_are_made_by_all_tasks(spark):
    d = Domain(spark, "/root/testdata/sf0.001")
    n = spark.sparkContext.defaultParallelism
    assert d.policy_subjects.rdd.getNumPartitions() >= n and d.policy_tags.rdd.getNumPartitions() >= n


def test_tokenizer_gets_states_without_questions(spark, tmp_path):
    """An article takes only its state to Python, however many questions it is asked; each question goes there once a configuration."""
    log = str(tmp_path / "seen")

    def factory():
        plain = T.whitespace_tokenizer()

        def encode(text):
            with open(log, "a") as f:
                f.write(repr(text) + "\n")
            return plain(text)
        return encode

    a = spark.createDataFrame([(f"c{i}", "k", f"state {i}", [("1", True, "passing", "neutral")], [("t", True)]) for i in range(40)],
                              "correlation_id STRING, config_id STRING, state STRING, subject_results ARRAY<STRUCT<subject_id: STRING, is_valid: BOOLEAN, prominence: STRING, sentiment: STRING>>, base_tags ARRAY<STRUCT<tag_id: STRING, result: BOOLEAN>>").repartition(8)
    sets = flow(spark)
    assert len(sets.collect()) == 1
    rows = T.encode_windows(a, sets, factory)
    assert "MapInArrow" not in rows._jdf.queryExecution().optimizedPlan().toString()
    rows.collect()
    seen = open(log).read().splitlines()
    states = [s for s in seen if s.startswith("'state ")]
    assert len(states) == len(set(states)) == 40
    others = [s for s in seen if not s.startswith("'state ")]
    assert max(map(others.count, set(others))) <= 4  # the size of the heads is measured before they are joined; options that read the same count each time
