"""Disagreements and the evaluation reports built on them."""

from pyspark.sql import DataFrame, functions as F

from assayer import fixed_values as V
from assayer.functions.labels import pct


def mismatch_long(subjects: DataFrame, tags: DataFrame, hygiene: bool = True) -> DataFrame:
    """One row per differing decision; pairs in which neither side decided are dropped unless hygiene is off."""
    def row(dim, base, cand, match):
        return F.struct(F.lit(dim).alias("dimension"), F.col(base).cast("string").alias("base"), F.col(cand).cast("string").alias("cand"), F.col(match).alias("match"))

    s = subjects.select("correlation_id", "config_id", F.col("name").alias("item"), F.inline(F.array(
        row("validation", "val_base", "val_cand", "val_match"), row("prominence", "prom_base", "prom_cand", "prom_match"),
        row("sentiment", "sent_base", "sent_cand", "sent_match"))))
    t = tags.select("correlation_id", "config_id", F.col("tag_name").alias("item"), F.lit("tag").alias("dimension"),
                    F.col("base_result").cast("string").alias("base"), F.col("cand_result").cast("string").alias("cand"), "match")
    every = s.unionByName(t)
    return null_hygiene(every) if hygiene else every.filter(~F.col("match"))


def null_hygiene(rows: DataFrame) -> DataFrame:
    decided = F.col("base").isNotNull() | F.col("cand").isNotNull()
    return rows.filter(decided & ~F.coalesce("match", F.lit(False)) & ~F.col("base").eqNullSafe(F.col("cand")))


def find_discrepancies(mismatches: DataFrame, failures: DataFrame) -> DataFrame:
    """One issue per article: failed ones, and those with at least one real mismatch.

    Only counts per dimension are grouped, so an article's row stays small whatever its number of mismatches.
    """
    d = mismatches.groupBy("correlation_id").agg(*[F.count_if(F.col("dimension") == k).alias(f"n_{k}") for k in V.DECISION_KINDS])
    f = failures.select("correlation_id", *[F.lit(0).cast("bigint").alias(f"n_{k}") for k in V.DECISION_KINDS], F.lit("execution_failure").alias("type"))
    return d.withColumn("type", F.lit("disagreement")).unionByName(f)


def discrepancy_records(mismatches: DataFrame, failures: DataFrame, articles: DataFrame) -> DataFrame:
    """One record per article that differs or failed: its headline, configuration, mismatch list and error.

    failures(correlation_id, error); articles(correlation_id, config_id, headline).  A list is bounded by the subjects
    and tags of the article's configuration; the long rows of `mismatch_long` stay the form to aggregate.
    """
    item = F.struct("dimension", "item", "base", "cand")
    d = mismatches.groupBy("correlation_id").agg(F.sort_array(F.collect_list(item)).alias("mismatches"))
    d = d.select("correlation_id", F.lit("disagreement").alias("type"), "mismatches", F.lit(None).cast("string").alias("error"))
    f = failures.select("correlation_id", F.lit("execution_failure").alias("type"), F.array().cast(d.schema["mismatches"].dataType).alias("mismatches"), "error")
    return d.unionByName(f).join(articles.select("correlation_id", "config_id", "headline"), "correlation_id")


def first_n(issues: DataFrame, n: int | None, key: str = "correlation_id") -> DataFrame:
    """First n issues in key order; none or zero means all."""
    return issues.orderBy(key).limit(n) if n else issues


def filter_evaluations(evaluations: DataFrame, view: str) -> DataFrame:
    """evaluations(preferred, mismatch_dims ARRAY, verdict_dims ARRAY, n_tag): one of the report views."""
    p = F.col("preferred")
    if view == "candidate":
        return evaluations.filter(p.isin("cand", "candidate"))
    if view == "baseline":
        return evaluations.filter(p == "base")
    if view == "tie":
        return evaluations.filter(~F.coalesce(p.isin("base", "cand", "candidate"), F.lit(False)))
    if view in ("prominence", "sentiment"):
        return evaluations.filter(F.array_contains("mismatch_dims", view) | F.array_contains("verdict_dims", view))
    if view == "tag":
        return evaluations.filter((F.col("n_tag") > 0) | F.array_contains("verdict_dims", "tag"))
    return evaluations


def arbitration_counts(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Preferred side per run; any other value of an existing verdict is a tie."""
    p = F.col("preferred")
    return verdicts.groupBy(*keys).agg(
        F.count_if(p == "base").alias("base_preferred"), F.count_if(p == "cand").alias("cand_preferred"),
        F.count_if(p.isNotNull() & ~p.isin("base", "cand")).alias("ties"))


def analysis_rollup(issues: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Totals of the issues and of the verdicts on them; zeros where nothing was found."""
    j = issues.join(verdicts, "correlation_id", "left")
    d = F.col("type") == "disagreement"
    p = F.col("preferred")
    return j.agg(
        F.count("*").alias("total_issues"), F.count_if(d).alias("disagreements"), F.count_if(~d).alias("failures"),
        F.count_if(d & p.isNotNull()).alias("sample_analyzed"), F.count_if(d & (p == "base")).alias("base_preferred"),
        F.count_if(d & (p == "cand")).alias("cand_preferred"), F.count_if(d & p.isNotNull() & ~p.isin("base", "cand")).alias("ties"))


ANALYSIS = """run_id string, entry string, correlation_id string, config_id string, headline string, type string, preferred string, error string,
 mismatches array<struct<dimension: string, item: string, base: string, cand: string>>, totals map<string, bigint>"""


def error_analysis(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The whole analysis of each run as rows: its totals, an evaluation of every article that differs, and its failures.

    records(run_id, correlation_id, config_id, headline, type, mismatches, error) as discrepancy_records gives them, with
    their run; verdicts(correlation_id, preferred).  entry is `rollup` (one row a run, figures in `totals`), `evaluation`
    (a disagreement, its mismatches and the preferred side, null without a verdict) or `failure`.
    """
    j = records.join(verdicts.select("correlation_id", "preferred"), "correlation_id", "left")
    d, p = F.col("type") == "disagreement", F.col("preferred")
    per_article = j.select("run_id", F.when(d, "evaluation").otherwise("failure").alias("entry"), "correlation_id", "config_id", "headline", "type",
                           F.when(d, p).alias("preferred"), "error", "mismatches", F.lit(None).cast("map<string,bigint>").alias("totals"))
    counts = {"total_issues": F.count("*"), "disagreements": F.count_if(d), "failures": F.count_if(~d), "sample_analyzed": F.count_if(d & p.isNotNull()),
              "base_preferred": F.count_if(d & (p == "base")), "cand_preferred": F.count_if(d & (p == "cand")), "ties": F.count_if(d & p.isNotNull() & ~p.isin("base", "cand"))}
    rollup = j.groupBy("run_id").agg(F.create_map(*[x for k, c in counts.items() for x in (F.lit(k), c)]).alias("totals"))
    none = lambda t: F.lit(None).cast(t)
    rollup = rollup.select("run_id", F.lit("rollup").alias("entry"), F.lit("").alias("correlation_id"), *[none("string").alias(c) for c in ("config_id", "headline", "type", "preferred", "error")],
                           none(per_article.schema["mismatches"].dataType).alias("mismatches"), "totals")
    return per_article.unionByName(rollup)


def noise_reduction(rows: DataFrame) -> DataFrame:
    """Discrepancy events before and after null hygiene."""
    decided = F.col("base").isNotNull() | F.col("cand").isNotNull()
    raw = ~F.coalesce("match", F.lit(False))
    return rows.agg(F.count_if(raw).alias("before"), F.count_if(raw & decided & ~F.col("base").eqNullSafe(F.col("cand"))).alias("after"))


def confusion_matrix(subjects: DataFrame) -> DataFrame:
    both = F.array(
        F.struct(F.lit("prominence").alias("dimension"), F.col("prom_base").alias("base"), F.col("prom_cand").alias("cand")),
        F.struct(F.lit("sentiment").alias("dimension"), F.col("sent_base").alias("base"), F.col("sent_cand").alias("cand")))
    return subjects.select(F.inline(both)).groupBy("dimension", "base", "cand").agg(F.count("*").alias("n"))


def confidence_buckets(rows: DataFrame, conf: str, match: str) -> DataFrame:
    b = F.least(F.floor(F.col(conf) * 10), F.lit(9)).cast("int")
    return rows.groupBy(b.alias("decile")).agg(F.count("*").alias("n"), F.count_if(F.col(match)).alias("agree")).withColumn(
        "agreement_pct", pct(F.col("agree"), F.col("n")))


def disagreement_by_subject_label(subjects: DataFrame) -> DataFrame:
    both = F.array(
        F.struct(F.lit("prominence").alias("dimension"), F.col("prom_base").alias("label"), F.col("prom_match").alias("m")),
        F.struct(F.lit("sentiment").alias("dimension"), F.col("sent_base").alias("label"), F.col("sent_match").alias("m")))
    return subjects.select("name", F.inline(both)).groupBy("name", "dimension", "label").agg(
        F.count("*").alias("n"), F.count_if(~F.col("m")).alias("differ")).withColumn("differ_pct", pct(F.col("differ"), F.col("n")))


def threshold_sweep(rows: DataFrame, prob: str, truth: str, thresholds) -> DataFrame:
    """Agreement at each threshold: one aggregate with a count per threshold, then its single row as a column."""
    counts = [F.count_if((F.col(prob) >= float(t)) == F.col(truth)).alias(f"t{i}") for i, t in enumerate(thresholds)]
    one = rows.agg(F.count("*").alias("n"), *counts).filter("n > 0")
    grid = one.select("n", F.inline(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("agree")) for i, t in enumerate(thresholds)])))
    return grid.select("threshold", "n", "agree", pct(F.col("agree"), F.col("n"), 2).alias("agreement_pct"))


def human_agreement(rows: DataFrame) -> DataFrame:
    """rows(human, base, cand): agreement of each side with human labels next to their agreement with each other."""
    n = F.count("*")
    return rows.agg(
        n.alias("n"), F.count_if(F.col("human") == F.col("base")).alias("base_agree"), F.count_if(F.col("human") == F.col("cand")).alias("cand_agree"),
        F.count_if(F.col("base") == F.col("cand")).alias("mutual_agree"))
