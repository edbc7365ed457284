"""Evaluation and calibration over predictions(kind, label, logits)."""

import math

from pyspark.sql import DataFrame, functions as F

from assayer import fixed_values as V
from assayer.functions import labels as L
from assayer.session import written


def with_prediction(preds: DataFrame) -> DataFrame:
    return preds.withColumn("pred", L.argmax(F.col("logits"))).withColumn("match", F.col("pred") == F.col("label"))


def accuracy_by_kind(preds: DataFrame) -> DataFrame:
    """Overall, per kind and per label in one pass (three grouping sets)."""
    p = with_prediction(preds)
    g = p.groupingSets([[F.col("kind"), F.col("label")], [F.col("kind")], []], F.col("kind"), F.col("label"))
    out = g.agg(F.count("*").alias("n"), F.count_if("match").alias("correct"))
    level = F.when(F.col("kind").isNull(), "overall").when(F.col("label").isNull(), "kind").otherwise("label")
    return out.select(level.alias("level"), "kind", "label", "n", "correct", L.pct(F.col("correct"), F.col("n"), 2).alias("accuracy_pct"))


def mean_loss(preds: DataFrame, keys=()) -> DataFrame:
    return preds.groupBy(*keys).agg(F.avg(L.cross_entropy(F.col("logits"), F.col("label"))).alias("loss"))


def weighted_loss(preds: DataFrame) -> DataFrame:
    """Weighted mean of the loss; rows carry sample_weight."""
    ce = L.cross_entropy(F.col("logits"), F.col("label"))
    return preds.agg((F.sum(ce * F.col("sample_weight")) / F.sum("sample_weight")).alias("loss"))


def qtype_of(kind):
    return F.when(kind.isin("validation", "tag"), "noul").otherwise("choice")


def _slopes(preds: DataFrame, betas: dict[str, tuple[float, ...]]) -> dict[str, tuple]:
    """{type: (rows, [(mean slope, mean curvature) at each beta])} of the loss of softmax(beta * logits), from one aggregate."""
    width = max(len(b) for b in betas.values())

    def at(i: int):
        beta = F.lit(None).cast("double")
        for kind, values in betas.items():
            beta = F.when(F.col("qtype") == kind, F.lit(values[min(i, len(values) - 1)])).otherwise(beta)
        z = F.col("logits")
        w = F.transform(z, lambda x: F.exp(beta * (x - F.array_max(z))))
        total, one, two = (F.aggregate(F.zip_with(z, w, f), F.lit(0.0), lambda a, x: a + x) for f in (lambda x, p: p, lambda x, p: p * x, lambda x, p: p * x * x))
        mean = one / total
        return F.avg(mean - F.get(z, F.col("label"))).alias(f"slope{i}"), F.avg(two / total - mean * mean).alias(f"curve{i}")

    rows = preds.filter(F.col("qtype").isin(*betas)).groupBy("qtype").agg(F.count("*").alias("n"), *[c for i in range(width) for c in at(i)]).collect()
    return {r.qtype: (r.n, [(r[f"slope{i}"], r[f"curve{i}"]) for i in range(len(betas[r.qtype]))]) for r in rows}  # a row per question type


def fit_temperature(preds: DataFrame, min_rows: int = 1, lowest: float = 0.1, highest: float = 8.0, precision: float = 1e-7, steps: int = 60) -> DataFrame:
    """One temperature per question type with the lowest loss; 1.0 for types with fewer than `min_rows` rows.

    The loss is convex in beta = 1 / temperature, so its slope has one zero.  Newton steps find it; each needs the mean
    slope and curvature of all rows, one aggregate, and a step that leaves the interval known to hold the zero halves that
    interval instead.  A slope that keeps its sign over the range gives the end of the range.
    """
    p = written(preds.select(qtype_of(F.col("kind")).alias("qtype"), "logits", "label"), "logits")
    low, high = 1 / highest, 1 / lowest
    counts, found, open_ = {}, {}, {}
    for kind, (n, ((left, _), (right, _), _)) in _slopes(p, {k: (low, high, 1.0) for k in V.QTYPE_CODES}).items():
        counts[kind] = n
        if left >= 0 or right <= 0:
            found[kind] = low if left >= 0 else high
        else:
            open_[kind] = (low, high, 1.0)
    for _ in range(steps):
        if not open_:
            break
        for kind, (_, ((slope, curve),)) in _slopes(p, {k: (b,) for k, (_, _, b) in open_.items()}).items():
            lo, hi, beta = open_[kind]
            lo, hi = (lo, beta) if slope > 0 else (beta, hi)
            after = beta - slope / curve if curve > 0 else math.sqrt(lo * hi)
            if not lo <= after <= hi:
                after = math.sqrt(lo * hi)
            open_[kind] = (lo, hi, after)
            if abs(math.log(after / beta)) < precision:
                found[kind] = after
        open_ = {k: v for k, v in open_.items() if k not in found}
    found |= {k: b for k, (_, _, b) in open_.items()}
    rows = [(k, counts.get(k, 0), round(1 / found[k], 4) if k in found and counts[k] >= min_rows else 1.0) for k in V.QTYPE_CODES]
    return preds.sparkSession.createDataFrame(rows, "qtype STRING, n LONG, temperature DOUBLE")


def apply_temperature(preds: DataFrame, temperatures: dict[str, float]) -> DataFrame:
    t = F.lit(1.0)
    for qtype, value in temperatures.items():
        t = F.when(qtype_of(F.col("kind")) == qtype, float(value)).otherwise(t)
    return preds.withColumn("probabilities", L.softmax(F.col("logits"), t))


def registration_gate(accuracy: DataFrame, minimum: float = V.MIN_ACCURACY) -> DataFrame:
    """All four kinds counted and the overall accuracy high enough."""
    return accuracy.agg(
        F.count_if((F.col("level") == "kind") & F.col("kind").isin(*V.DECISION_KINDS) & (F.col("n") > 0)).alias("kinds"),
        F.max(F.when(F.col("level") == "overall", F.col("accuracy_pct"))).alias("accuracy_pct")).withColumn(
        "registered", (F.col("kinds") == len(V.DECISION_KINDS)) & (F.col("accuracy_pct") >= minimum))


REQUIRED_METRICS = ("post_train_accuracy_pct", "best_epoch", "best_val_loss",
                    *[f"post_train_{k}_{m}" for k in V.DECISION_KINDS for m in ("count", "accuracy_pct")])


def missing_metrics(metrics: DataFrame, run_key: str) -> DataFrame:
    """Required metric names each run lacks; the names of a run are a small set by vocabulary."""
    need = F.array(*[F.lit(m) for m in REQUIRED_METRICS])
    known = metrics.filter(F.col("metric").isin(*REQUIRED_METRICS)).groupBy(run_key).agg(F.collect_set("metric").alias("have"))
    runs = metrics.select(run_key).distinct().join(known, run_key, "left")
    lacks = F.array_except(need, F.coalesce("have", F.array().cast("array<string>")))
    return runs.select(run_key, F.explode(lacks).alias("metric"))


def agreement_lift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Accuracy per kind before and after, and the difference."""
    pick = lambda df, n: df.filter(F.col("level") == "kind").select("kind", F.col("accuracy_pct").alias(n))
    j = pick(before, "before_pct").join(pick(after, "after_pct"), "kind", "full_outer")
    return j.withColumn("lift", L.rounded(F.col("after_pct") - F.col("before_pct"), 2))
