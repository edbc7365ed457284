"""Quality classifier: Bradley-Terry ranking of documents, threshold by score quantile.

A text's strength is a linear score of shape features.  The weights are learned from preference pairs (a good and a bad
labelled text) by logistic loss on their feature differences.  The cut is the score quantile at which as many labelled
texts lie below as are labelled bad, taken over all of them; scores are logistic in the distance from the cut.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm.langid import held_out
from assayer.llm.minhash import word_hashes
from assayer.llm.shared import BROADCAST_ROWS
from assayer.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bounds of what is learned from: labelled rows, and preference pairs.
LABELLED, PAIRS = 20_000, 60_000
CUT = 0.3
#: Bytes of text, and rows, whose features are taken at once by one task; the arrays take about 100 times these bytes.
CHUNK, ROWS = 1 << 18, 512

_kind = np.zeros(256, np.int64)  # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 ordinary punctuation, 5 space, 6 line end, 7 beyond ASCII, 8.. marks
_kind[97:123], _kind[65:91], _kind[48:58] = 1, 2, 3
_kind[[ord(c) for c in ".,;:'\"()-"]] = 4
_kind[[32, 9, 11, 12]], _kind[[10, 13]], _kind[128:] = 5, 6, 7
_kind[ord("!")], _kind[ord("|")] = 8, 9
KINDS = 10
NAMES = 24


def shape(texts: list[bytes]) -> np.ndarray:
    """Shape features of texts, one row each: shares of character kinds, word lengths and repetition."""
    out = np.zeros((len(texts), NAMES))
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) < CHUNK:
            size += len(texts[to]) + 1
            to += 1
        out[at:to] = _shape(texts[at:to])
        at = to
    return out


def _shape(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    joined = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    lengths = np.array([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(n), lengths)
    kinds = np.bincount(owner * KINDS + _kind[buf], minlength=n * KINDS).reshape(n, KINDS).astype(float)
    size = np.maximum(lengths - 1, 1)
    letters = np.maximum(kinds[:, [1, 2, 7]].sum(1), 1)
    words, of = word_hashes(texts)
    space = (_kind[buf] == 5) | (_kind[buf] == 6)
    edge = np.flatnonzero(np.diff(np.r_[True, space].astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    count = np.maximum(np.bincount(of, minlength=n), 1).astype(float)
    per = lambda flags: np.bincount(of, weights=flags, minlength=n) / count
    long = (end - start).astype(float)
    first, last = _kind[buf[start]], _kind[buf[np.maximum(end - 1, start)]]
    upper = np.add.reduceat(np.r_[(_kind[buf] == 2).astype(float), 0], start) if len(start) else np.zeros(0)
    lower = np.add.reduceat(np.r_[(_kind[buf] == 1).astype(float), 0], start) if len(start) else np.zeros(0)
    same = np.r_[False, (words[1:] == words[:-1]) & (of[1:] == of[:-1])].astype(float) if len(words) else np.zeros(0)
    order = np.lexsort((words, of))
    w, o = words[order], of[order]
    new = np.r_[True, (w[1:] != w[:-1]) | (o[1:] != o[:-1])] if len(w) else np.zeros(0, bool)
    distinct = np.bincount(o[new], minlength=n) / count
    run = np.diff(np.r_[np.flatnonzero(new), len(w)]) if len(w) else np.zeros(0, int)
    most = np.zeros(n)
    np.maximum.at(most, o[new], run)
    sentence = per(np.isin(buf[np.maximum(end - 1, start)], [ord(c) for c in ".!?"]))
    shares = kinds / size[:, None]
    return np.column_stack([
        shares[:, 0], kinds[:, 2] / letters, shares[:, 3], shares[:, 4], shares[:, 5], shares[:, 6], shares[:, 7], shares[:, 8], shares[:, 9],
        per(same), distinct, most / count, per(long) / 10, np.sqrt(np.maximum(per(long * long) - per(long) ** 2, 0)) / 10,
        sentence, per(first == 2), per((upper > 1) & (lower == 0)), per((last == 0).astype(float)), per(long == 1), per(long > 20),
        np.log1p(count) / 10, np.log1p(kinds[:, 6]) / 10, np.log1p(most) / 10, (lengths <= 1).astype(float)])


def expanded(x: np.ndarray, mean: np.ndarray, std: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Standard scores and hinges above and below each feature's knots."""
    z = np.clip((x - mean) / std, -8, 8)
    hinges = [np.maximum(z - k, 0) for k in knots]
    return np.concatenate([z, *hinges, np.minimum(z * z, 16)], 1)


class Model:
    def __init__(self, mean, std, knots, weights, slope, cut):
        self.mean, self.std, self.knots, self.weights, self.slope, self.cut = mean, std, knots, weights, slope, cut

    def strength(self, x: np.ndarray) -> np.ndarray:
        return expanded(x, self.mean, self.std, self.knots) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; CUT at the cut."""
        t = self.slope * (self.strength(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(t, -40, 40)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 11) -> Model:
    """Weights from preference pairs by Newton steps on the logistic loss of their differences, and the cut among x."""
    if not good.any() or good.all():  # no preference to learn: everything passes
        zero = np.zeros(NAMES)
        return Model(zero, zero + 1, np.zeros((2, NAMES)), np.zeros(4 * NAMES), 1.0, -1.0)
    mean, std = x.mean(0), x.std(0)
    std = np.where(std > 1e-9, std, 1)
    knots = np.quantile((x - mean) / std, [0.75, 0.95], axis=0)
    z = expanded(x, mean, std, knots)
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(np.flatnonzero(good), pairs)] - z[rng.choice(np.flatnonzero(~good), pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))  # chance that the pair is ranked wrongly
        grad = -(diff.T @ p) / pairs + ridge * w
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    return Model(mean, std, knots, w, 1.0, float(np.quantile(s, (~good).mean())))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Weights from at most `labelled` labelled rows, those with the smallest hash of the id; the cut from all labelled texts."""
    known = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).cast("int").alias("_good"))
    known = written(known, "quality-labels")
    drawn = known.orderBy(F.xxhash64("_id"), "_id").limit(labelled)  # a top-k per task, then of those
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x = shape([(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["good", "x"])

    got = texts.join(F.broadcast(drawn), "_id").select("_good", "_text").mapInArrow(run, "good int, x array<double>").limit(3 * labelled).toPandas()
    if not len(got):
        return fit(np.zeros((0, NAMES)), np.zeros(0, bool))
    x, good = np.stack(got["x"].to_numpy()), got["good"].to_numpy() == 1
    order = np.lexsort((*x.T, good))  # the same whatever came first
    model = fit(x[order], good[order])
    if good.any() and not good.all():
        model.cut = _cut(texts, known, model)
    return model


def _cut(texts: DataFrame, known: DataFrame, model: Model) -> float:
    """The quantile of the strengths of all labelled texts at the share of the bad among them, to 1e-4 of the ranks."""
    if known.count() <= BROADCAST_ROWS:  # only labelled texts are looked at
        strengths = texts.join(F.broadcast(known), "_id").select("_good", _judged(F.col("_text"), model.strength).alias("s"))
    else:  # strengths are shuffled, texts are not
        strengths = texts.where(~held_out("_id")).select("_id", _judged(F.col("_text"), model.strength).alias("s")).join(known, "_id").select("_good", "s")
    strengths = written(strengths, "quality-strengths")
    bad = strengths.agg(F.avg((F.col("_good") != 1).cast("double"))).first()[0]
    low = strengths.agg(F.percentile_approx("s", F.lit(bad), 10_000)).first()[0]
    above = strengths.where(F.col("s") > low).agg(F.min("s")).first()[0]
    return low if above is None else low + (1 - bad) * (above - low)


def _judged(text: Column, judge) -> Column:
    """judge(features) of a text, as a double."""
    @F.arrow_udf("double")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            out = [judge(shape([(t or "").encode("utf-8", "surrogatepass") for t in texts.slice(lo, ROWS).to_pylist()])) for lo in range(0, len(texts), ROWS)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return run(F.coalesce(text.cast("string"), F.lit("")))


def score_of(text: Column, model: Model) -> Column:
    """The score of a text (0 to 1, higher is better); a document passes at CUT or above."""
    return _judged(text, model.score)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of docs and quality_score (score_of); a column of that name is replaced.

    Null and empty texts are scored as texts without words, texts of any length whole.  With no labels of both kinds
    everything passes.  Each row is scored by its text alone, so repeated rows get the same score; ties need no rule.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "quality_score"]
    return docs.select(*kept, score_of(F.col(f"`{text_col}`"), model).alias("quality_score"))
