"""Which configured subjects an article names, where and how.

Subjects stay an array per configuration, so an article is joined once and every flag is computed in place:
no row per (article, term), no shuffle, and the text is never copied.
"""

from pyspark.sql import Column, DataFrame, functions as F

from assayer import fixed_values as V
from assayer.functions import text as X
from assayer.operators.joins import join_by_size, once, rows_of


#: A run of letters and digits.  Where a surface form stands as a whole word, or in an enumeration, each of its runs is a
#: whole run of the text too.
RUN = r"[\p{L}\p{Nd}]+"


#: Entries of an index that cost less to look for one by one than to cut a text into its runs.
SHORT_INDEX = 32


def runs_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RUN), F.lit(0))


def run_key(term: Column) -> Column:
    """The longest run of a form, the rarest as a rule; empty for a form of signs only, which any text may hold."""
    lengths = F.transform(runs_of(F.lower(term)), lambda r: F.struct(F.length(r).alias("n"), r.alias("r")))
    return F.coalesce(F.array_max(lengths).r, F.lit(""))


def entity_sets(subjects: DataFrame) -> DataFrame:
    """Subjects of a configuration with their surface forms, as one ordered array, and the runs that lead to them."""
    item = F.struct(F.col("pos"), F.col("subject_id"), F.col("name"), X.match_terms(F.col("name")).alias("strict"),
                    X.presence_terms(F.col("name")).alias("presence"))
    keyed = subjects.select("config_id", item.alias("e")).withColumn(
        "e", F.struct("e.*", F.array_distinct(F.transform("e.presence", run_key)).alias("runs")))
    sets = keyed.groupBy("config_id").agg(F.array_sort(F.collect_list("e")).alias("entities"))
    return sets.withColumn("run_index", F.array_distinct(F.flatten(F.transform("entities", lambda e: e.runs))))


def evidence_array(full_lc: Column, headline_lc: Column, lead_lc: Column, entities: Column, met: Column) -> Column:
    """Evidence per subject.  `met` holds the runs of the index that the text has; a subject none of whose forms can stand
    there is settled without a look at the text, so a text costs its own length and the forms it may hold."""
    def one(e):
        def flags(hits):
            counted = F.zip_with(e.presence, hits, lambda t, h: F.when(F.array_contains(e.strict, t), F.size(h)).otherwise(0))
            return F.struct(
                e.subject_id.alias("subject_id"), e["name"].alias("name"),
                X.names_any(headline_lc, e.strict).alias("in_headline"), X.names_any(lead_lc, e.strict).alias("in_lead"),
                F.aggregate(counted, F.lit(0), lambda acc, n: acc + n).alias("mentions"), F.exists(hits, lambda h: F.size(h) > 0).alias("named"),
                X.venue_hits(full_lc, hits).alias("venue_only"), X.list_context(full_lc, e.strict).alias("in_list"))

        no, zero = F.lit(False), F.lit(0)
        absent = F.struct(e.subject_id.alias("subject_id"), e["name"].alias("name"), no.alias("in_headline"), no.alias("in_lead"), zero.alias("mentions"),
                          no.alias("named"), no.alias("venue_only"), no.alias("in_list"))
        # the strict forms are among the presence forms
        return F.when(F.arrays_overlap(e.runs, met), X.let(X.hits_per_term(full_lc, e.presence), flags)).otherwise(absent)

    def derived(e):
        mention = e.named & ~e.venue_only
        certified = e.in_headline & ~e.venue_only
        return F.struct(
            e.subject_id.alias("subject_id"), e["name"].alias("name"), e.in_headline.alias("in_headline"), e.in_lead.alias("in_lead"),
            e.mentions.alias("mentions"), mention.alias("has_mention"), e.venue_only.alias("venue_only"), e.in_list.alias("in_list"),
            certified.alias("certified"), (~certified & ~mention).alias("unmatched"))

    return F.transform(F.transform(entities, one), derived)


def presence_evidence(articles: DataFrame, sets: DataFrame, keep: tuple = (), set_columns: tuple = (), how: str = "inner") -> DataFrame:
    """Articles with their evidence array and the article-wide figures the rules need.

    sets(config_id, entities, run_index, ...): one row per configuration; `set_columns` of it ride along.  The runs of an
    article meet the index of its configuration once.  With how="left" an article without a configuration stays, with
    nulls.
    """
    a = articles.select(
        "correlation_id", "config_id", *keep,
        F.lower(F.concat("headline", F.lit(" "), X.clean_body(F.col("body")))).alias("full_lc"),
        F.lower("headline").alias("headline_lc"), F.lower(X.lead(F.col("body"))).alias("lead_lc"))
    j = join_by_size(a, sets.select("config_id", "entities", "run_index", *set_columns), ["config_id"], how)
    # a short index is looked for in the text, entry by entry; a long one meets the text's runs, whatever its length
    there = F.filter("run_index", lambda r: F.col("full_lc").contains(r) | F.col("lead_lc").contains(r))
    shared = F.array_intersect(F.concat(runs_of(F.concat_ws(" ", "full_lc", "lead_lc")), F.array(F.lit(""))), F.col("run_index"))
    j = once(j, met=F.when(F.size("run_index") <= SHORT_INDEX, there).otherwise(shared))
    ev = evidence_array(F.col("full_lc"), F.col("headline_lc"), F.col("lead_lc"), F.col("entities"), F.col("met"))
    out = once(j, evidence=ev, adversity=X.adversity(F.col("full_lc"))).select(
        "correlation_id", "config_id", *keep, *set_columns, "evidence", "adversity")
    return out.select(
        "*", F.size(F.filter("evidence", lambda e: e.in_headline)).alias("n_headline"),
        F.coalesce(F.array_max(F.transform("evidence", lambda e: e.mentions)), F.lit(0)).alias("max_mentions"),
        F.size(F.filter("evidence", lambda e: e.mentions >= 3)).alias("n_major"))


def evidence_rows(evidence: DataFrame) -> DataFrame:
    return rows_of(evidence, "evidence", "subject_id", "correlation_id", "config_id", "adversity", "n_headline", "max_mentions", "n_major")
