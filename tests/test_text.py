"""Text rules on small fixtures, next to plain Python expectations."""

import re

from pyspark.sql import functions as F

from assayer import fixed_values as V
from assayer.functions import labels as L, text as X


def one(spark, fn, *values):
    df = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))])
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first()[0]


def test_headings(spark):
    assert one(spark, X.sanitize_heading, "## A\n  # b # c\r\n\t### d\n plain ") == "A\nb # c\nd\n plain"


def test_state_layout_and_cut(spark):
    got = one(spark, X.distilled_state, "H", " lead \n\n two\nthree ")
    assert got == "Headline: H\n\n\nLead Paragraph:\nlead\n\nArticle Body:\ntwo\n\nthree"
    assert one(spark, X.distilled_state, "H", "") == "Headline: H\n\n\nLead Paragraph:\n\n\nArticle Body:\n"
    whole = one(spark, X.distilled_state, "H", "x" * 9000)
    assert whole.count("x") == 9000
    assert one(spark, lambda h, b: X.distilled_state(h, b, 4000), "H", "x" * 9000) == whole[:4000]


def test_full_state(spark):
    f = lambda h, b, m, s, p: X.full_state(h, b, m, s, p, 60)
    assert one(spark, f, "h", "b", "TV", "", "") == "Item Type: clip (broadcast transcript)\n\nHeadline: h\n\nBody:\nb"
    long = one(spark, f, "h", "b" * 100, "online", "src", "2024")
    assert long.startswith("Item Type: written article\nSource: src\nPublished: 2024\n") and long.endswith(V.FULL_STATE_NOTICE)


def test_footers(spark):
    body = lambda *p: "\n".join(p)
    assert one(spark, X.cut_footer, body("a", "Read more: x")) == body("a", "Read more: x")  # two paragraphs stay as they are
    assert one(spark, X.cut_footer, body("a", "b", "Read more: x", "tail")) == "a\n\nb"
    assert one(spark, X.cut_footer, body("a", "b", "Read more")) == "a\n\nb\n\nRead more"  # bare form does not match
    assert one(spark, X.cut_footer, body("a", "See also - z", "c")) == "a\n\nSee also - z\n\nc"  # never the second paragraph
    far = [f"p{i}" for i in range(3)] + ["Newsletter now"] + [f"q{i}" for i in range(9)]
    assert one(spark, X.cut_footer, body(*far)) == "\n\n".join(far)  # further up than the last seven
    near = [f"p{i}" for i in range(6)] + ["• Related: x"] + ["q"] * 5
    assert one(spark, X.cut_footer, body(*near)) == "\n\n".join(near[:6])


def test_bylines(spark):
    for text in ("a\nPhoto: Jo\nby: Jane Doe\nz 1", "desk.1 || 2024-01-02 x\nrest", "x-1 || 9:30 y\nz", "no marker here", "Editor: Ann\nBody text: more"):
        want = text
        for _, pattern in V.BYLINES:
            want = re.sub(pattern, "", want)
        assert one(spark, X.strip_bylines, text) == want


def test_names(spark):
    terms = lambda n: one(spark, X.match_terms, n)
    assert terms("Chobani (creamers)") == ["Chobani"]
    assert set(terms("Museum of Modern Art (MoMA)")) == {"Museum of Modern Art", "MoMA"}
    assert set(terms("Coca-Cola")) == {"Coca-Cola", "Coca", "Cola"}
    assert set(terms("Acme Corp")) == {"Acme Corp", "Acme"}
    assert terms("Kia") == ["Kia"]
    presence = lambda n: one(spark, X.presence_terms, n)
    assert "Redwire" in presence("Redwire All") and "All" not in presence("Redwire All")
    assert one(spark, X.canonical_name, " Foo – ") == "Foo"


def test_mentions_count_overlapping_terms(spark):
    text = "acme corp met acme. acmes are not acme-like."
    n = one(spark, lambda t, name: X.total_mentions(F.lower(t), X.match_terms(name)), text, "Acme Corp")
    plain = sum(len(re.findall(rf"\b{re.escape(t)}\b", text, re.I)) for t in ("Acme Corp", "Acme"))
    assert n == plain == 4


def test_name_ending_in_punctuation_never_matches(spark):
    assert one(spark, lambda t, name: X.total_mentions(F.lower(t), X.match_terms(name)), "we use C++ here", "C++") == 0


def test_venue_only(spark):
    f = lambda t, name: X.venue_only(F.lower(t), X.presence_terms(name))
    assert one(spark, f, "a concert at Kia Center tonight", "Kia") is True
    assert one(spark, f, "Kia Center and its naming rights", "Kia") is False
    assert one(spark, f, "Kia Center, while Kia opened a plant far from there and everything else", "Kia") is False
    assert one(spark, f, "nothing", "Kia") is False


def test_venue_windows_against_brute_force(spark):
    text = "Kia Kia Kia arena kia, the kia. Skia kia\nstadium kia"
    got = one(spark, lambda t: X.word_windows(F.lower(t), F.lit("kia")), text)
    low = text.lower()
    assert got == [low[m.start():m.end() + 25] for m in re.finditer(r"\bkia\b", low)]


def test_list_context(spark):
    f = lambda t, name: X.list_context(F.lower(t), X.match_terms(name))
    assert one(spark, f, "makers such as Ford, Acme, and others", "Acme")
    assert one(spark, f, "three firms (Ford, Acme) agreed", "Acme")
    assert not one(spark, f, "Acme built a plant", "Acme")


def test_numeric_literals_against_brute_force(spark):
    pattern = re.compile(V.NUMBER)

    def plain(text):
        out = set()
        for m in pattern.finditer(text):
            prefix = text[text.rfind("\n", 0, m.start()) + 1:m.start()]
            if m.group().isdigit() and not prefix.strip() and text[m.end():m.end() + 1] in (".", ")"):
                continue
            out.add(m.group())
        return sorted(out)

    for text in ("1. first\n 2) second\n3 apples", "from $1,200.50 to 10% or 5-7 days", "b2b 4x4 x12 7", "12.5 at line start", "in 2024–2025, €30."):
        assert one(spark, X.numeric_literals, text) == plain(text), text


def test_quoted_literals(spark):
    text = "Use \"Alpha, \" and 'Beta' or “Gamma;” then ‘Delta’ and \"\" 'x\ny'"
    assert one(spark, X.quoted_literals, text) == ["Alpha", "Beta", "Delta", "Gamma"]


def test_contradiction(spark):
    assert one(spark, X.rule_contradiction, 'Include "Foo". Exclude "Foo".')
    assert not one(spark, X.rule_contradiction, 'Include "Foo". Exclude "Bar".')


def test_guardrails(spark):
    assert one(spark, X.tag_guardrail, "Joint Venture news") == V.PARTNER_GUARD
    assert one(spark, X.tag_guardrail, "DevOps") == V.DEVELOPER_GUARD
    assert one(spark, X.tag_guardrail, "AI") == V.AI_GUARD
    assert one(spark, X.tag_guardrail, "Air") == ""


def test_budget(spark):
    f = lambda t: X.state_budget(t, 100)
    assert one(spark, f, "x" * 100) == "x" * 100
    for n in (101, 200, 300, 10_000):  # three halvings at most, each of the text with its notice
        want = "x" * n
        for _ in range(3):
            want = want if len(want) <= 100 else want[:len(want) // 2] + V.BUDGET_NOTICE
        assert one(spark, f, "x" * n) == want


def test_char_tokens_round_half_even(spark):
    assert [one(spark, X.char_tokens, "x" * n) for n in (2, 6, 10, 11)] == [round(n / 4) for n in (2, 6, 10, 11)]


def test_last_wins(spark):
    df = spark.sql("select array(struct('1' as id, 1 as v), struct('2' as id, 2 as v), struct('1' as id, 3 as v)) as a")
    assert [tuple(r) for r in df.select(L.last_wins(F.col("a"), "id").alias("r")).first()[0]] == [("2", 2), ("1", 3)]


def test_label_index_and_one_hot(spark):
    assert one(spark, lambda v: L.label_index(F.lit("sentiment"), v), " Neutral ") == 2
    assert one(spark, lambda v: L.label_index(F.lit("prominence"), v), "none") is None
    assert one(spark, lambda v: L.one_hot(v, F.lit(4)), 1) == [0.0, 1.0, 0.0, 0.0]


def test_headings_on_every_kind_of_line(spark):
    """Lines and blanks are those of Unicode, so the result is that of plain Python."""
    import re
    texts = ["  ## a\x1c\xa0 # b\x85### c\x1e#d  #e", "x\r\n# y\r#z\x0b # q\x1f# r", "#", "\u3000#\u3000k", "", "\u2028 ## \u2029"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING").orderBy("i").select(X.sanitize_heading(F.col("t"))).collect()]
    assert got == ["\n".join(re.sub(r"^\s*#+\s*", "", line) for line in t.splitlines()).strip() for t in texts]


def test_whole_words_and_lists_as_plain_patterns_have_them(spark):
    """The patterns that start with the name find what a plain reading of the text finds."""
    import random
    import re

    rng = random.Random(5)
    pieces = ["kia", "kiakia", "c++", "kiá", "and", "sand", " ", ", ", ",", "(", ")", "\n", "x", "ü", "_", "\u0301", "\U0001f600", "band "]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 24))) for _ in range(400)]
    names = ("kia", "kiakia", "c++", "and")
    rows = spark.createDataFrame([(i, t, n) for i, t in enumerate(texts) for n in names], "i int, t string, n string")
    old_windows = F.regexp_extract_all("t", F.concat(F.lit("(?Us)(?=("), *[F.col("n") if x == "n" else F.lit(x) for x in (r"\b\Q", "n", r"\E\b")], F.lit(r".{0,25}))\b\Q"), F.col("n"), F.lit(r"\E\b")), F.lit(1))
    quoted = F.concat(F.lit(r"\Q"), F.col("n"), F.lit(r"\E"))
    enum = F.concat(F.lit(r"(?U)(?:,\s*|\band\s+)"), quoted, F.lit(r"(?:,\s*|\band\s+|\s*\))"))
    paren = F.concat(F.lit(r"(?U)\(\s*(?:[^)]*,\s*)?"), quoted, F.lit(r"(?:,\s*[^)]*)?\)"))
    got = rows.select("*", X.word_windows(F.col("t"), F.col("n")).alias("w"), old_windows.alias("w0"), X.word_count(F.col("t"), F.col("n")).alias("c"),
                      X.list_context(F.col("t"), F.array("n")).alias("l"), (F.regexp_like("t", enum) | F.regexp_like("t", paren)).alias("l0")).collect()
    assert len(got) == 1600 and any(r.w for r in got) and any(r.l for r in got)
    for r in got:
        assert (r.w, r.c, r.l) == (r.w0, len(r.w0), r.l0), r


RULE_TEXTS = ["", "Include \"Foo\". Exclude \"Foo\".", "INCLUDE 'a'\nexclude 'a'", "Return\n true for “x”; return  false for “x”!", "It qualifies: ‘y’. It does not qualify: ‘y’.", "Include Foo. Exclude Foo.",
              "include \"a\" exclude \"a\"", "İnclude 'a'. exclude 'a'.", "includes 'a'. excludes 'a'.", "include 'a'. Exclude 'a'", "Include 'a' only", "'a' 'a'", "qualify 'a'. do not qualify 'a'"]


def test_contradictions_are_looked_for_only_where_both_rules_and_a_quote_stand(spark, monkeypatch):
    t = spark.createDataFrame([(x,) for x in [None, *RULE_TEXTS]], "t STRING")
    guarded = [tuple(r) for r in t.select("t", X.rule_contradiction(F.col("t"))).collect()]
    monkeypatch.setattr(X, "holds_any", lambda c, words: F.lit(True))
    assert guarded == [tuple(r) for r in t.select("t", X.rule_contradiction(F.col("t"))).collect()]
    assert guarded[0][1] is None and {r for _, r in guarded[1:]} == {True, False}
    monkeypatch.undo()
    monkeypatch.setattr(V, "POSITIVE_RULE", "(")  # no pattern: an error where it is used
    for text in ("Stories of the maker", "Include \"Foo\"", "Include Foo. Exclude Foo."):
        assert one(spark, X.rule_contradiction, text) is False


def test_contradictions_as_all_literals_of_both_rules_have_them(spark):
    subjects = ("'Foo'", '"Foo"', "Foo", "'Foo,'", "'Food'", "“Foo”", "' Foo '", "'", "'Foo' and 'Bar'")
    texts = [f"{a} {s}{end}{b} {o}." for s in subjects for o in subjects for a, b, end in (
        ("Include", "Exclude", ". "), ("Exclude", "include", "\n"), ("Return true on", "return false on", "! "), ("Include", "and exclude", ", "), ("Includes", "Exclude", ". "))]
    t = spark.createDataFrame([(x,) for x in [*texts, "", None]], "t STRING")

    def literals(pattern):
        return F.flatten(F.transform(F.filter(F.split("t", r"(?<=[.!?;])\s+|\n+"), lambda x: F.lower(x).rlike(pattern)), X.quoted_literals))

    plain = F.arrays_overlap(literals(V.POSITIVE_RULE), literals(V.NEGATIVE_RULE))
    got = t.select("t", X.rule_contradiction(F.col("t")).alias("got"), plain.alias("plain")).collect()
    assert [r.t for r in got if r.got != r.plain] == [] and 0 < sum(bool(r.got) for r in got) < len(texts)
