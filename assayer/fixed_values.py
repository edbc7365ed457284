"""Vocabularies, word lists, thresholds, prices, patterns and texts.

Everything in this module is a contract value that results depend on, kept as plain
text in one place.  No logic lives here.
"""

# --- vocabularies -----------------------------------------------------------------
PROMINENCE_LABELS = ("primary", "significant", "passing")
SENTIMENT_LABELS = ("positive", "negative", "neutral", "balanced")
DECISION_KINDS = ("validation", "prominence", "sentiment", "tag")
KIND_WIDTH = {"validation": 2, "prominence": 3, "sentiment": 4, "tag": 2}
QTYPE_CODES = {"choice": 0, "score": 1, "noul": 2}
CLIP_MEDIA = ("radio", "television", "tv")

# --- budgets ----------------------------------------------------------------------
MAX_LEN = 1024
HEAD_MAX_LEN = 256
#: Tokens of the state that two neighbouring windows of a sequence share.
WINDOW_OVERLAP = 128
STATE_MAX_CHARS = 4000
FULL_STATE_MAX_CHARS = 120_000
FULL_STATE_NOTICE = "\n\n[... article body truncated due to context window limits ...]"
BUDGET_NOTICE = "\n\n[... truncated due to max_tokens_exceeded ...]"
VALIDATION_CRITERIA_MAX_CHARS = 600
PREVIEW_CHARS = 1000
BATCH_ARTICLES_PER_CONFIG = 50
PER_LABEL_CAP = 12_000
TAG_POS_RATIO = 0.4
MIN_ACCURACY = 83.0
NOUL_POSITIVE_WEIGHT = 2.5

# --- thresholds -------------------------------------------------------------------
VALIDATION_THRESHOLD = 0.45
LEAD_THRESHOLD = 0.35
ABSENT_THRESHOLD = 0.65
TAG_THRESHOLD = 0.40
REQUEST_DEFAULT_THRESHOLD = 0.50

# --- prices (USD) -----------------------------------------------------------------
BASE_INPUT_PER_MTOK = 0.30
BASE_OUTPUT_PER_MTOK = 2.50
BASE_FLAT_PER_ARTICLE = 0.007
CAND_INPUT_PER_MTOK = 0.042

# --- gate defaults: (confidence of prominence, sentiment) and probabilities ----------
RUN_GATE = {
    "prominence": ({"primary": 0.0, "significant": 0.0, "passing": 1.0}, 1.0),
    "sentiment": ({"positive": 0.0, "negative": 0.0, "neutral": 1.0, "balanced": 0.0}, 1.0),
}
SERVED_GATE = {
    "prominence": ({"primary": 0.02, "significant": 0.08, "passing": 0.90}, 0.92),
    "sentiment": ({"positive": 0.05, "negative": 0.05, "neutral": 0.88, "balanced": 0.02}, 0.90),
}

# --- word lists -------------------------------------------------------------------
VENUE_SUFFIXES = (
    "coliseum", "arena", "stadium", "center", "field", "park", "theater", "theatre",
    "amphitheatre", "pavilion",
)
SPONSOR_PHRASES = ("sponsorship", "naming rights", "partnership agreement", "brand strategy")
ADVERSITY_MARKERS = (
    "severed", "cut line", "disrupt", "damage", "complaint", "halted", "stop-work",
    "lawsuit", "investigat", "outage", "fine", "penalty", "critic",
)
NON_DISTINCTIVE_TOKENS = (
    "all", "only", "mentions", "mention", "coverage", "exclude", "excluding", "excl",
    "include", "including", "incl", "and", "the", "of", "for", "de", "du", "van", "von",
    "group", "corp", "corporation", "inc", "llc", "ltd", "limited", "co", "company",
    "pbc", "plc", "enterprises", "holding", "holdings", "ag", "nv", "bv", "sa", "gmbh",
    "stocks", "financials", "news", "brand", "brands", "global", "international",
    "systems", "technologies", "solutions", "services", "media", "digital", "online",
    "network", "networks", "communications", "management", "capital", "partners",
    "energy", "health", "care", "foods", "software", "wireless", "mobile", "telecom",
)
PARTNER_WORDS = ("partnership", "partner", "alliance", "joint venture")
DEVELOPER_WORDS = ("developer", "devops", "engineering")
BULLETS = ("•", "*", "-")
BULLET_WORDS = ("read:", "related:", "source:", "photo:")

# --- text patterns (the two footer forms that end in "$" can never match, so they are left out)
PARENTHETICAL = r"\(([^)]{1,40})\)"
CORP_SUFFIX = (
    r"(?i)[\s,]+(?:group|corp|corporation|inc\.?|llc|l\.l\.c\.?|ltd\.?|limited|co\.?|company|"
    r"pbc|plc|enterprises|holdings?|ag|nv|bv|sa|gmbh|a/s)$"
)
# credit lines and bylines, each with a text it always contains
BYLINES = (
    (":", r"(?i)(?:foto|photo|image|credit|courtesy|source)\s*:\s*[^\n]+"),
    ("||", r"(?i)\b[a-zA-Z0-9_\.\-]+\s*\|\|\s*\d{4}-\d{2}-\d{2}[^\n]*"),
    ("||", r"(?i)\b[a-zA-Z0-9_\.\-]+\s*\|\|\s*\d{1,2}:\d{2}[^\n]*"),
    (":", r"(?i)\b(?:by|author|reporter|editor|dipublikasikan oleh)\s*:\s*[a-zA-Z\s]{3,40}(?:\n|$)"),
)
FOOTER = (
    r"(?i)^(?:read\s+more|related\s+(?:stories|articles?|posts?|links?)|"
    r"recommended\s+(?:for\s+you|stories)|trending\s+(?:stories|now|topics)|popular\s+stories|"
    r"also\s+on|see\s+also|more\s+from|sponsored\s+content|latest\s+news|top\s+stories|"
    r"editors'?\s+picks?|advertisement|sign\s+up\s+for|subscribe\s+to|newsletter|"
    r"share\s+this\s+article|follow\s+us\s+on|copyright\s+©|all\s+rights\s+reserved)[:\s-]"
)
ANY_QUOTED = r'"([^"\n]+)"|' + r"'([^'\n]+)'|“([^”\n]+)”|‘([^’\n]+)’"
#: The same matches; an opening mark is looked for first, one test a letter instead of four alternatives.
QUOTED_SEARCH = r"""["'“‘](?:(?<=")[^"\n]+"|(?<=')[^'\n]+'|(?<=“)[^”\n]+”|(?<=‘)[^’\n]+’)"""
NUMBER = r"(?<![\w])(?:[$€£])?\d+(?:[,.]\d+)*(?:%|[–—-]\d+(?:[,.]\d+)*)?(?![\w])"
CONFIGURATOR = (
    r"\b(?:configurator|administrator|config owner)\b|"
    r"\b(?:please\s+)?(?:configure|specify|define|enter|supply)\s+(?:the\s+)?"
    r"(?:criteria|rule|rules|prompt|tag|subject)\b"
)
POSITIVE_RULE = r"\b(?:include|return\s+true|qualif(?:y|ies))\b"
NEGATIVE_RULE = r"\b(?:exclude|return\s+false|does\s+not\s+qualify|do\s+not\s+qualify)\b"
#: What every match of the two rules, of CONFIGURATOR and of EXPLICIT_TAG_NAME holds; literals and named tags open with a quote.
POSITIVE_STEMS, NEGATIVE_STEMS = ("include", "return", "qualif"), ("exclude", "return", "qualify")
CONFIGURATOR_STEMS = ("configur", "administrator", "config owner", "specify", "define", "enter", "supply")
TAG_STEMS, QUOTES = ("tag", "category", "label"), ('"', "'", "“", "‘")
EXPLICIT_TAG_NAME = (
    r"\b(?:tag|category|label)\s+(?:named\s+|called\s+|for\s+)?[\"'“‘]([^\"'”’]+)[\"'”’]"
)
OUTPUT_FORMS = (
    r"\breturn\s+exactly\b",
    r"\brespond\s+with\b",
    r"\boutput\s+(?:only|exactly)\b",
    r"\b(?:true|false|primary|significant|passing|positive|negative|neutral|balanced)\s+only\b",
    r"\bno\s+(?:other\s+text|explanation)\b",
    r"\bapi\s+choice\b",
    r"\bjson\b",
)
# for each form: groups of texts, one of each stands in every match; a pattern found in every text that has the form; a pattern
# with the form's matches.  A pattern that starts with plain text is searched for in jumps, so the word's boundary comes behind it.
OUTPUT_FORM_SEARCH = (
    ((("exactly",), ("return",)), None, r"return(?<=\breturn)\s+exactly\b"),
    ((("respond",), ("with",)), None, r"respond(?<=\brespond)\s+with\b"),
    ((("output",), ("only", "exactly")), None, r"output(?<=\boutput)\s+(?:only|exactly)\b"),
    ((("only",),), r"only\b(?<=(?:\b(?:true|false|primary|significant|passing|positive|negative|neutral|balanced)|\s)\sonly)", OUTPUT_FORMS[3]),
    ((("explanation", "text"), ("explanation", "other")), None, OUTPUT_FORMS[4]),
    ((("api",), ("choice",)), None, r"api(?<=\bapi)\s+choice\b"),
    ((("json",),), None, r"json(?<=\bjson)\b"),
)
# marker: (text every match contains, pattern in the source, pattern that keeps it in the rewrite)
POLICY_MARKERS = {
    "include": (
        "include",
        r"\binclude(?:s|d|ing)?\s+(?:conditions?|rules?|if|when|only|\(|:)",
        r"\b(?:includ(?:e|es|ed|ing)|qualif(?:y|ies)|true\s+when|relevant\s+when)\b",
    ),
    "exclude": (
        "exclud",
        r"\bexclud(?:e|es|ed|ing)\b",
        r"\b(?:exclud(?:e|es|ed|ing)|reject(?:ed)?|false\s+when|not\s+qualif(?:y|ies)|irrelevant)\b",
    ),
    "exception": (
        "except",
        r"\bexcept(?:ion|ions)?\b",
        r"\b(?:except(?:ion|ions)?|override(?:s|d)?|despite|however)\b",
    ),
    "only": ("only", r"\bonly\b", r"\bonly\b"),
    "unless": ("unless", r"\bunless\b", r"\b(?:unless|except\s+when)\b"),
    "regardless": (
        "regardless",
        r"\bregardless\b",
        r"\b(?:regardless|even\s+if|despite|before|precedence|override(?:s|d)?|"
        r"supersed(?:e|es|ed|ing)|priorit(?:y|ize|izes|ized))\b",
    ),
    "before": ("before", r"\bbefore\b", r"\b(?:before|prior|first|precedence)\b"),
    "after": (
        "after",
        r"\bafter\b",
        r"\b(?:after|then|following|before|prior|first|precedence|override(?:s|d)?|"
        r"supersed(?:e|es|ed|ing)|priority)\b",
    ),
}
NEGATIONS = ("not", "unrelated", "false", "never")
NEGATION_SOURCE = r"\b(?:not|never|false|unrelated|fails?)\b"
NEGATION_KEPT = r"\b(?:not|never|false|exclude|unrelated|fails?)\b"

# --- tag guard texts ----------------------------------------------------------------
PARTNER_GUARD = (
    " Explicit negative exclusion: Standard third-party software compatibility, app store listings, "
    "operating system integrations, APIs, generic client reviews, and multi-vendor list roundups DO NOT qualify "
    "as a partnership. A partnership requires an explicit, announced mutual corporate or technology agreement."
)
DEVELOPER_GUARD = (
    " Explicit negative exclusion: General consumer how-to guides, personal password tips, and general security "
    "tutorials aimed at everyday end-users DO NOT qualify as Developer content. The content must specifically "
    "target software engineers, developer tooling, SDKs, or programming workflows."
)
AI_GUARD = (
    " Explicit negative exclusion: Passing biographical mentions in author blurbs, routine automation, "
    "or generic software algorithms DO NOT qualify. The content must substantively discuss artificial intelligence "
    "or machine learning directly related to the subject."
)

# --- question texts, terse form ({name}, {policy}, {tag} are filled in) ----------------------
TERSE = {
    "valid": (
        "Is the provided content meaningfully relevant to '{name}' based on the validation criteria?",
        {
            "true": "Content satisfies validation criteria for {name}: {policy}",
            "false": "Content is unrelated, passing mention without substance, or fails validation "
                     "criteria for {name}.",
        },
    ),
    "prominence": (
        "What is the prominence of '{name}' in this content? "
        "Return exactly one API choice: primary, significant, or passing.",
        {
            "primary": "Primary dominant focus of the article. {name} is the central subject "
                       "featured in the headline, lead, and narrative.",
            "significant": "Key topic discussed substantively, or featured in the headline or lead. "
                           "Not for incidental mentions in multi-vendor lists.",
            "passing": "Incidental reference: {name} appears in a list of companies, is cited as a "
                       "secondary data source, or is mentioned briefly without headline focus.",
        },
    ),
    "sentiment": (
        "What is the specific tone and sentiment towards '{name}' in this content? "
        "Isolate sentiment strictly to '{name}'.",
        {
            "positive": "Explicit institutional praise, awards, or celebratory acclaim directed at {name}.",
            "negative": "Direct adverse coverage, criticism, scandal, litigation, or severe failure "
                        "directed at {name}.",
            "neutral": "Editorial baseline: factual reporting, earnings, operational transactions, "
                       "executive hires, and routine industry news regarding {name}.",
            "balanced": "Substantial elements of both explicit praise and severe criticism regarding {name}.",
        },
    ),
    "tag": (
        "Does the content match the tag criteria for '{tag}' regarding '{name}'?",
        {
            "true": "Criteria satisfied for {tag}: {policy}",
            "false": "Criteria NOT satisfied for {tag}.",
        },
    ),
}

# --- question texts, long form ---------------------------------------------------------------
VERBOSE = {
    "valid": (
        "Is the provided content meaningfully relevant to '{name}' based on the validation criteria?\n\n"
        "MANDATORY HEADLINE PRIMACY: If '{name}' (or its operating brand/alias) is featured in the HEADLINE or lead "
        "paragraph (e.g., corporate appointment, earnings release, partnership, product launch), it is DEFINITIONALLY "
        "VALID AND RELEVANT.",
        {
            "true": "Content satisfies validation criteria for {name}:\nEntity: {entity}\nCriteria: {policy}",
            "false": "Content is unrelated, passing mention without substance, or fails validation criteria for {name}.",
        },
    ),
    "prominence": (
        "What is the prominence of '{name}' in this content? "
        "Return exactly one API choice: primary, significant, or passing.\n\n"
        "PROMINENCE RULES:\n"
        "1. HEADLINE PRIMACY: If '{name}' is named in the HEADLINE, it MUST be classified as 'primary' (if it is the "
        "central story topic) or 'significant' (if shared with another entity). It is STRICTLY PROHIBITED from being "
        "classified as passing.\n"
        "2. LEAD PARAGRAPH FOCUS: If '{name}' is discussed substantively in the lead paragraph, classify as 'primary' "
        "or 'significant'. Never passing.\n"
        "3. PASSING DEFAULT: Classify as 'passing' ONLY for incidental references: {name} appears in a multi-vendor "
        "catalog, is cited as an external data source, or mentioned briefly 1–2 times without headline/lead focus.",
        {
            "primary": "Primary dominant focus of the article or clip. {name} is the central subject featured in the "
                       "headline, lead, and narrative.",
            "significant": "Key topic discussed substantively, or featured in the headline/lead. MUST NOT be chosen "
                           "for incidental mentions in multi-vendor lists or external data citations.",
            "passing": "Default for incidental references: {name} is mentioned in a list of multiple companies, cited "
                       "as a secondary data source, or mentioned briefly without headline focus.",
        },
    ),
    "sentiment": (
        "What is the specific tone and sentiment towards '{name}' in this content? "
        "CRITICAL: Isolate sentiment strictly to '{name}'. Do NOT inherit positive or negative tone from general "
        "market mood or other companies.\n\n"
        "SENTIMENT EDITORIAL BASELINE RULES:\n"
        "- NEUTRAL DEFAULT: Standard operational transactions, financial earnings releases, corporate "
        "appointments/hires, funding announcements, business contracts, game recaps, player transactions, roster "
        "moves, and analytical reporting MUST DEFAULT TO NEUTRAL for '{name}'.\n"
        "- POSITIVE: Reserved strictly for overt, explicit institutional praise, prestigious awards, celebratory "
        "acclaim, or exceptional historic breakthroughs directed specifically at '{name}'. Merely conducting business "
        "or reporting quarterly results is NEUTRAL.\n"
        "- NEGATIVE: Direct adverse coverage, criticism, regulatory investigations, lawsuits, scandals, severe losses, "
        "or customer condemnation directed specifically at '{name}'.",
        {
            "positive": "Explicit institutional praise, prestigious awards, or celebratory acclaim directed "
                        "specifically at {name}. Standard business transactions and earnings remain neutral.",
            "negative": "Direct adverse coverage, criticism, scandal, litigation, or severe failure directed "
                        "specifically at {name}.",
            "neutral": "Editorial baseline: factual reporting, financial earnings, operational transactions, executive "
                       "hires, sports recaps, player contracts, and routine industry news regarding {name}.",
            "balanced": "Substantial elements of both explicit praise and severe criticism directed specifically at "
                        "{name}.",
        },
    ),
    "tag": TERSE["tag"],
}
CLIENT_PROMINENCE = "\n\nClient Prominence Criteria:\n"
CLIENT_SENTIMENT = "\n\nClient Sentiment Criteria:\n"

# --- criteria used when a question carries none of the right shape -------------------------------
DEFAULT_CRITERIA = {
    "choice": {"valid": "valid", "invalid": "invalid"},
    "score": {"0": "level 0", "1": "level 1", "2": "level 2"},
    "noul": {"true": "yes, the statement holds", "false": "no, the statement does not hold"},
}

# --- text counted as excluded input when only the classification part of a call is priced ----------
EXCLUDED_HEADINGS = "Summary instructions Rejection reason instructions"

# --- fixed head of the assembled system prompt -----------------------------------------------------
PROMPT_ROLE = (
    "You are a content curation assistant.\n"
    "Your task is to evaluate the provided item against the subjects defined below."
)
PROMPT_MEDIA = (
    "## Media type\n"
    "- Items may be written articles or broadcast clips (radio or television segments).\n"
    "- Refer to a broadcast clip as a 'clip' — never as an 'article' — and treat its text\n"
    "  as a transcript of what was said on air. Refer to a written item as an 'article'.\n"
    "- The user message states which kind this specific item is; follow that directive,\n"
    "  especially when writing the summary."
)
PROMPT_RULES = (
    "## Rules\n"
    "- Set validation_result=false and provide a non-empty rejection_reason\n"
    "  when the article is unrelated to ALL subjects.\n"
    "- rejection_reason MUST be a non-empty string when validation_result=false\n"
    "  and all subject_evaluations have is_valid=false. Never use null in that case.\n"
    "- Set rejection_reason=null ONLY when validation_result=true.\n"
    "- For each subject_evaluation where is_valid=false, invalid_reason MUST be a\n"
    "  non-empty string explaining why the article is not relevant to that subject.\n"
    "  Never use null for invalid_reason when is_valid=false.\n"
    "- Evaluate every subject listed below — return one subject_evaluation per subject."
)
PROMPT_SUMMARY = (
    "## Summary instructions\n"
    "Follow these client-specific instructions when writing the summary field:\n"
)
PROMPT_REJECTION = (
    "## Rejection reason instructions\n"
    "Follow these client-specific instructions when writing the\n"
    "rejection_reason field:\n"
)
PROMPT_SUBJECTS = "## Subjects"
PROMPT_TAGS = (
    "## Tag Evaluations\n"
    "For each tag below, evaluate whether the article matches the tag criteria.\n"
    "Return one tag_evaluation per tag with tag_id and result (true/false)."
)
