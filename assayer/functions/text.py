"""Text expressions.  Every function takes and returns Columns, so all of it stays in the JVM."""

import re

from pyspark.sql import Column, functions as F

from assayer import fixed_values as V

WHITE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
         "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

#: What ends a line, and white space that does not.
LINE_END, BLANK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]", r"[ \t\x1F\p{Zs}]"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE))


def is_blank(c: Column) -> Column:
    """Nothing but white space; only the start is trimmed, as the end is found by going through the whole text."""
    return F.ltrim(c, F.lit(WHITE)) == ""


def let(value: Column, body) -> Column:
    """Compute a value once and use it several times, also inside lambdas, where Catalyst would repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def filled(c: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column, default: str = "") -> Column:
    return F.coalesce(*[filled(c) for c in cols], F.lit(default))


def any_of(c: Column, words) -> Column:
    """True when the text contains one of the words."""
    return c.rlike("|".join(re.escape(w) for w in words))


def holds_any(c: Column, words) -> Column:
    """any_of for a column or variable: one plain search a word is much cheaper than alternatives tried at each letter."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def fill(template: str, **values: Column) -> Column:
    """Put column values into a {placeholder} text.

    The text is cut at its placeholders, so a value that itself looks like a placeholder stays as it is.
    """
    parts = [values[p[1:-1]] if p[:1] == "{" and p[1:-1] in values else F.lit(p)
             for p in re.split(r"(\{[a-z]+\})", template) if p]
    return F.concat(*parts)


def sanitize_heading(c: Column) -> Column:
    """Drop leading heading marks on every line, then trim; lines end as in `LINE_END`, blanks are those of Unicode."""
    lines = F.regexp_replace(F.coalesce(c, F.lit("")), LINE_END, "\n")
    return strip(F.regexp_replace(lines, rf"(?m)^{BLANK}*#+{BLANK}*", ""))


def paragraphs(body: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), strip), lambda p: p != "")


def lead(body: Column) -> Column:
    return F.coalesce(F.get(paragraphs(body), F.lit(0)), F.lit(""))


def distilled_state(headline: Column, body: Column, max_chars: int | None = None) -> Column:
    """Headline, lead and rest in the layout the model is trained on; whole unless a budget is given."""
    text = let(paragraphs(body), lambda p: F.concat(
        F.lit("Headline: "), headline, F.lit("\n\n\nLead Paragraph:\n"),
        F.coalesce(F.get(p, F.lit(0)), F.lit("")), F.lit("\n\nArticle Body:\n"),
        F.array_join(F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), "\n\n")))
    return text if max_chars is None else F.left(text, F.lit(max_chars))


def is_clip(media_type: Column) -> Column:
    return F.lower(media_type).isin(*V.CLIP_MEDIA)


def full_state(headline, body, media_type, source, published_at, max_chars: int | None = None) -> Column:
    """Item kind, optional source and date, headline and body; with a budget, longer text is cut with a notice."""
    kind = F.when(is_clip(media_type), "clip (broadcast transcript)").otherwise("written article")
    text = F.concat(
        F.lit("Item Type: "), kind, F.lit("\n"),
        F.when(filled(source).isNotNull(), F.concat(F.lit("Source: "), source, F.lit("\n"))).otherwise(""),
        F.when(filled(published_at).isNotNull(), F.concat(F.lit("Published: "), published_at, F.lit("\n"))).otherwise(""),
        F.lit("\nHeadline: "), headline, F.lit("\n\nBody:\n"), body,
    )
    if max_chars is None:
        return text
    cut = F.concat(F.left(text, F.lit(max_chars)), F.lit(V.FULL_STATE_NOTICE))
    return F.when(F.length(text) > max_chars, cut).otherwise(text)


def strip_bylines(body: Column) -> Column:
    """Remove credits and bylines; texts without the marker of a pattern skip its regex."""
    def without(marker, pattern):
        return lambda b: F.when(b.contains(marker), F.regexp_replace(b, pattern, "")).otherwise(b)

    out = F.coalesce(body, F.lit(""))
    for marker, pattern in V.BYLINES:
        out = let(out, without(marker, pattern))
    return out


def footer_like(p: Column) -> Column:
    bullet = F.lit(False)
    for b in V.BULLETS:
        bullet = bullet | p.startswith(b)
    return p.rlike(V.FOOTER) | (bullet & any_of(F.lower(p), V.BULLET_WORDS))


def cut_footer(body: Column) -> Column:
    """Cut at the earliest footer-like paragraph among the last seven, never before the third."""
    def cut(b, p):
        n = F.size(p)
        start = F.greatest(F.lit(2), n - 7)
        spots = F.filter(F.sequence(start, F.greatest(start, n - 1)), lambda i: footer_like(F.coalesce(F.get(p, i), F.lit(""))))
        kept = F.slice(p, F.lit(1), F.coalesce(F.array_min(spots), n))
        return F.when(n <= 2, b).otherwise(F.array_join(kept, "\n\n"))

    return let(body, lambda b: let(paragraphs(b), lambda p: cut(b, p)))


def clean_body(body: Column) -> Column:
    return cut_footer(strip_bylines(body))


def char_tokens(c: Column) -> Column:
    """About four characters per token; halves go to the even side."""
    return F.greatest(F.lit(0), F.bround(F.length(c) / 4.0, 0)).cast("bigint")


def fingerprint(c: Column) -> Column:
    """Content hash of a value in its JSON form, or of a text as it is."""
    return F.sha2(c, 256)


def halvings(length: Column, budget: int) -> Column:
    """How often a text is halved, three times at most; what is halved again carries the notice already."""
    def step(s: Column, _) -> Column:
        over = s.n > budget
        return F.struct(F.when(over, F.floor(s.n / 2) + len(V.BUDGET_NOTICE)).otherwise(s.n).cast("int").alias("n"), (s.k + over.cast("int")).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(3)), F.struct(length.cast("int").alias("n"), F.lit(0).alias("k")), step).k


def state_budget(c: Column, budget: int) -> Column:
    """Halved with a notice, three times at most, until it fits."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(3)), c, lambda t, _: F.when(
        F.length(t) > budget, F.concat(F.left(t, F.floor(F.length(t) / 2).cast("int")), F.lit(V.BUDGET_NOTICE))).otherwise(t))


# --- subject names ------------------------------------------------------------------------------

def canonical_name(name: Column) -> Column:
    """Label without its parenthetical note, trimmed of joining punctuation."""
    n = strip(name)
    bare = strip(F.regexp_replace(n, V.PARENTHETICAL, " "))
    bare = F.regexp_replace(bare, r"^[ \t\-–—:,]+|[ \t\-–—:,]+$", "")
    return F.coalesce(filled(bare), n)


def without_suffix(canon: Column) -> Column:
    return strip(F.regexp_replace(canon, V.CORP_SUFFIX, ""))


def base_name(name: Column) -> Column:
    return without_suffix(canonical_name(name))


def _known_generic(c: Column) -> Column:
    return F.lower(c).rlike("^(?:" + "|".join(V.NON_DISTINCTIVE_TOKENS) + ")$")


def _ordered(terms: Column) -> Column:
    """Longest first, then by text, so the order never depends on a hash."""
    keyed = F.transform(terms, lambda t: F.struct((-F.length(t)).alias("k"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda s: s.t)


def match_terms(name: Column) -> Column:
    """Strict surface forms: label, label without legal suffix, acronym, parts of hyphenated brands."""
    acronyms = F.filter(
        F.transform(F.regexp_extract_all(name, F.lit(V.PARENTHETICAL), F.lit(1)), strip),
        lambda q: F.length(q).between(2, 10) & ~q.contains(" ") & (F.regexp_count(q, F.lit(r"\p{Lu}")) >= 2),
    )
    none = F.array().cast("array<string>")

    def parts(c):
        pieces = F.filter(F.transform(F.split(c, "-"), strip), lambda x: (F.length(x) >= 3) & ~_known_generic(x))
        return F.when(c.contains("-") & ~c.startswith("-"), pieces).otherwise(none)

    def forms(canon, base):
        terms = F.concat(
            F.array(canon), F.when(F.length(base) > 2, F.array(base)).otherwise(none),
            acronyms, parts(canon), parts(base))
        return _ordered(F.array_distinct(F.filter(terms, lambda t: F.length(t) >= 2)))

    return let(canonical_name(name), lambda canon: let(without_suffix(canon), lambda base: forms(canon, base)))


def presence_terms(name: Column) -> Column:
    """Strict forms plus the distinctive words of the label; for the advisory presence check only."""
    base = F.coalesce(filled(base_name(name)), canonical_name(name))
    words = F.filter(
        F.regexp_extract_all(base, F.lit(r"(?U)[\w&'’+.]+"), F.lit(0)),
        lambda t: (F.length(t) >= 4) & ~_known_generic(t),
    )
    return _ordered(F.array_union(match_terms(name), words))


# --- mentions: both sides lower-cased once, a plain contains() goes before every regex ---------------

def quoted(term: Column) -> Column:
    return F.concat(F.lit(r"\Q"), term, F.lit(r"\E"))


def whole_word(term_lc: Column) -> Column:
    """Pattern of a term as whole words.  It starts with the term itself, which is searched for in jumps; the boundaries,
    dear to test under Unicode rules, are looked at only where the term stands."""
    q = quoted(term_lc)
    return F.concat(q, F.lit(r"(?<=\b"), q, F.lit(r")\b"))


def word_count(text_lc: Column, term_lc: Column) -> Column:
    pattern = F.concat(F.lit("(?U)"), whole_word(term_lc))
    return F.when(text_lc.contains(term_lc), F.regexp_count(text_lc, pattern)).otherwise(0)


def word_windows(text_lc: Column, term_lc: Column) -> Column:
    """Each whole-word hit with the 25 characters after it, overlapping ones included."""
    pattern = F.concat(F.lit("(?Us)"), whole_word(term_lc), F.lit("(?=(.{0,25}))"))
    after = F.regexp_extract_all(text_lc, pattern, F.lit(1))
    return F.when(text_lc.contains(term_lc), F.transform(after, lambda x: F.concat(term_lc, x))).otherwise(
        F.array().cast("array<string>"))


def total_mentions(text_lc: Column, terms: Column) -> Column:
    """Hits summed over the strict forms; overlapping forms count more than once by contract."""
    return F.aggregate(terms, F.lit(0), lambda acc, t: acc + word_count(text_lc, F.lower(t)))


def names_any(text_lc: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: word_count(text_lc, F.lower(t)) > 0)


def hits_per_term(text_lc: Column, terms: Column) -> Column:
    """Windows of every hit, one array per term: one scan of the text serves counting, presence and venues."""
    return F.transform(terms, lambda t: word_windows(text_lc, F.lower(t)))


def venue_hits(text_lc: Column, hits: Column) -> Column:
    """Every hit stands before a venue word and nothing in the text speaks of sponsorship."""
    windows = F.flatten(hits)
    return (F.size(windows) > 0) & F.forall(windows, lambda w: holds_any(w, V.VENUE_SUFFIXES)) & ~holds_any(
        text_lc, V.SPONSOR_PHRASES)


def venue_only(text_lc: Column, terms: Column) -> Column:
    return venue_hits(text_lc, hits_per_term(text_lc, terms))


def list_context(text_lc: Column, terms: Column) -> Column:
    """The name stands in an enumeration or inside parentheses."""
    def one(t):
        q = quoted(F.lower(t))
        # the look-ahead goes before the boundary, as that is dear to test at each letter; what has to follow the name is
        # looked for first, as a pattern that starts with plain text is searched for in jumps
        after = r"(?:,\s*|\band\s+|\s*\))"
        enum = F.concat(F.lit(r"(?U)(?:,\s*|(?=and\s)\band\s+)"), q, F.lit(after))
        paren = F.concat(F.lit(r"(?U)\(\s*(?:[^)]*,\s*)?"), q, F.lit(r"(?:,\s*[^)]*)?\)"))
        follows = lambda p: F.regexp_like(text_lc, F.concat(F.lit("(?U)"), q, F.lit(p)))
        return F.when(text_lc.contains(F.lower(t)),
                      (follows(after) & F.regexp_like(text_lc, enum)) | (follows("[,)]") & F.regexp_like(text_lc, paren))).otherwise(False)
    return F.exists(terms, one)


def adversity(text_lc: Column) -> Column:
    return holds_any(text_lc, V.ADVERSITY_MARKERS)


def tag_guardrail(tag_name: Column) -> Column:
    t = F.lower(F.coalesce(tag_name, F.lit("")))
    return (
        F.when(any_of(t, V.PARTNER_WORDS), V.PARTNER_GUARD)
        .when(any_of(t, V.DEVELOPER_WORDS), V.DEVELOPER_GUARD)
        .when((t == "ai") | t.contains("artificial intelligence"), V.AI_GUARD)
        .otherwise("")
    )


# --- literals in policy text --------------------------------------------------------------------

def quoted_literals(c: Column) -> Column:
    """Distinct quoted texts of four quote styles, scanned left to right, trimmed of closing punctuation."""
    hits = F.array_distinct(F.regexp_extract_all(c, F.lit(V.QUOTED_SEARCH), F.lit(0)))
    inner = F.transform(hits, lambda h: F.regexp_replace(strip(h.substr(F.lit(2), F.length(h) - 2)), "[,;:]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(inner, lambda x: x != "")))


def numeric_literals(c: Column) -> Column:
    """Distinct numbers, amounts, percentages and ranges; markers of numbered lists are layout, not policy."""
    text = F.regexp_replace(c, r"(?Um)^([^\S\n]*)(?<!\w)\d+(?=[.)](?!\d))", "$1")
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)(?=[$€£\d])" + V.NUMBER), F.lit(0))))
    return F.when(c.rlike(r"(?U)\d"), found).otherwise(F.array().cast("array<string>"))


def rule_contradiction(c: Column) -> Column:
    """One literal stands both in an including and in an excluding clause.

    Clauses and their literals are looked for only where words of both rules and a quote stand in the text: a clause is a piece of
    it that ends before white space, so what its pattern finds stands in the whole text too.  Clauses without a quote have no
    literal, and the literals of an excluding clause are read only where one of an including clause stands in it."""
    lc = F.lower(c)

    def shared(clauses):
        including = F.filter(clauses, lambda x: F.lower(x).rlike(V.POSITIVE_RULE))
        return let(F.flatten(F.transform(including, quoted_literals)), lambda literals: F.exists(clauses, lambda x: (
            F.exists(literals, lambda y: x.contains(y)) & F.lower(x).rlike(V.NEGATIVE_RULE) & F.arrays_overlap(literals, quoted_literals(x)))))

    found = let(F.filter(F.split(c, r"(?<=[.!?;])\s+|\n+"), lambda x: holds_any(x, V.QUOTES)), shared)
    may = holds_any(lc, V.POSITIVE_STEMS) & holds_any(lc, V.NEGATIVE_STEMS) & holds_any(c, V.QUOTES)
    return F.when(may | c.isNull(), found).otherwise(False)
