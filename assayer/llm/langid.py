"""Language identification by nearest centroid: TF-IDF vectors of byte n-grams against several clustered centroids a language.

Counts of 1- to 3-grams of the lower-cased letters are hashed to a fixed number of dimensions, weighted by 1 + log tf and
inverse document frequency, and scaled to unit length.  Each language's training vectors are clustered by cosine; a text
takes the language of its nearest centroid.  A text that lies much farther from it than training texts of its length did
is rejected.  Centroids are fitted on a bounded sample; document frequencies and rejection floors cover all training texts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMS = 4096
CENTROIDS = 4
#: Bounds of the labelled sample that the centroids are fitted on: texts of a language, and languages, the most frequent.
PER_LANGUAGE, LANGUAGES = 500, 200
#: A text is rejected below this share of the training cosine that only LOWEST of the training texts of its length miss.
REJECT, LOWEST = 0.5, 0.001
#: Classes of length (powers of two of grams) and steps of the cosine in which training texts are counted.
SIZES, STEPS = 40, 1000
CHUNK = 1 << 20
UNKNOWN = "und"

_fold = np.arange(256, dtype=np.uint32)
_fold[:128] = [ord(chr(i).lower()) if chr(i).isalpha() else 32 for i in range(128)]


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """Hashed n-gram counts, one row per text."""
    out = np.zeros((len(texts), DIMS), np.float32)
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) < CHUNK and to - at < 128:
            size += len(texts[to]) + 3
            to += 1
        b = _fold[np.frombuffer(b"   ".join(texts[at:to]) + b"   ", np.uint8)]
        owner = np.repeat(np.arange(to - at) * DIMS, [len(t) + 3 for t in texts[at:to]])
        code = np.zeros(len(b), np.uint32)
        for n in (1, 2, 3):
            code = code[:len(b) - n + 1] * np.uint32(256) + b[n - 1:]
            slot = (code + np.uint32(n << 28)) * np.uint32(0x9E3779B1) >> np.uint32(20)
            real = b[:len(code)] != 32  # grams that begin with a letter; a text's end is padded, so none crosses it
            out[at:to] += np.bincount((owner[:len(code)] + slot)[real], minlength=(to - at) * DIMS).reshape(to - at, DIMS)
        at = to
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return (x / np.where(length > 0, length, 1)).astype(np.float32)


def _clusters(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spherical k-means, started far apart."""
    rng = np.random.default_rng(seed)
    centers = x[[rng.integers(len(x))]]
    while len(centers) < min(k, len(x)):
        centers = np.concatenate([centers, x[[int((x @ centers.T).max(1).argmin())]]])
    for _ in range(20):
        own = (x @ centers.T).argmax(1)
        sums = np.stack([x[own == c].sum(0) if (own == c).any() else centers[c] for c in range(len(centers))])
        centers = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-12)
    return centers.astype(np.float32)


class Model:
    def __init__(self, idf, centroids, langs, floors):
        self.idf, self.centroids, self.langs, self.floors = idf, centroids, langs, floors

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether the text is nearer than its length's floor."""
        if not texts or not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        counts = gram_counts([t.encode("utf-8", "surrogatepass") for t in texts])
        cos = weighted(counts, self.idf) @ self.centroids.T
        best = cos.argmax(1)
        score = np.clip(cos.max(1).astype(float), 0, 1)
        return [self.langs[i] for i in best], score, score >= self.floors[size_class(counts)]


def idf_of(frequency: np.ndarray, texts: int) -> np.ndarray:
    return np.log((1 + texts) / (1 + frequency)).astype(np.float32) + 1


def size_class(counts: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(counts.sum(1), 1)).astype(int).clip(0, SIZES - 1)


def fit(counts: np.ndarray, langs: list[str], idf: np.ndarray, k: int = CENTROIDS, seed: int = 3) -> Model:
    """Centroids of counted texts and their languages; a model without floors, which rejects nothing."""
    if not len(langs):
        return Model(idf, np.zeros((0, DIMS), np.float32), [], np.zeros(SIZES))
    x, names = weighted(counts, idf), np.array(langs)
    parts = {l: _clusters(x[names == l], k, seed) for l in sorted(set(langs))}
    return Model(idf, np.concatenate(list(parts.values())), [l for l, c in parts.items() for _ in c], np.zeros(SIZES))


def floors_of(counted: np.ndarray, reject: float = REJECT, lowest: float = LOWEST) -> np.ndarray:
    """Least cosine by the size class of a text: a share of the cosine step that more than `lowest` of the class's training
    texts have reached from below.  counted: texts by class and step.  A class of fewer than five texts borrows from the
    nearest filled one; below that, a cosine shrinks as the root of the number of grams."""
    filled = np.flatnonzero(counted.sum(1) >= 5)
    if not len(filled):
        return np.zeros(SIZES)
    own = {s: reject * int((counted[s].cumsum() > lowest * counted[s].sum()).argmax()) / STEPS for s in filled}
    nearest = [min(filled, key=lambda f: (abs(f - s), f)) for s in range(SIZES)]
    return np.array([own[f] * 0.5 ** (max(0, f - s) / 2) for s, f in enumerate(nearest)])


def held_out(id_col: str) -> Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 5, is 0 (a null id is held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def lettered(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def _tallied(rows: DataFrame, shape: tuple[int, ...], tally) -> np.ndarray:
    """Counts over all texts of rows (column `text`): each task adds tally(gram counts) up in one array of this shape and
    hands on its filled places, which Spark sums."""
    size = int(np.prod(shape))

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                total += tally(gram_counts([t.encode("utf-8", "surrogatepass") for t in batch.column(0).slice(lo, 256).to_pylist()]))
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(total[place])], names=["place", "n"])

    got = rows.select("text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[got["place"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out.reshape(shape)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          languages: int = LANGUAGES) -> Model:
    """Centroids from a bounded sample: about per_language rows of each language, chosen by a hash of the id, for the
    `languages` most frequent languages; texts of any further language take the nearest of these, or are rejected.
    Document frequencies and floors are counted over all training texts of the learned languages."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & lettered(F.col(text_col)))
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not sizes:
        return fit(np.zeros((0, DIMS)), [], np.ones(DIMS, np.float32))
    rows = rows.where(F.col("lang").isin([r["lang"] for r in sizes]))
    idf = idf_of(_tallied(rows, (DIMS,), lambda x: (x > 0).sum(0)), sum(r["count"] for r in sizes))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["count"]))])
    dealt = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.where(dealt < share[F.col("lang")]).limit(3 * per_language * len(sizes))

    def count(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x = gram_counts([t.encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()])
                r, c = np.nonzero(x)
                ends = pa.array(np.searchsorted(r, np.arange(len(x) + 1)).astype(np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(c.astype(np.int32))),
                                                  pa.ListArray.from_arrays(ends, pa.array(x[r, c].astype(np.int32)))], names=["lang", "slots", "counts"])

    got = sample.select("lang", "text").mapInArrow(count, "lang string, slots array<int>, counts array<int>").toPandas()
    got = got.sort_values(["lang", "counts"], key=lambda s: s.map(str), ignore_index=True)  # the same whatever came first
    x = np.zeros((len(got), DIMS), np.float32)
    for i, (slots, counts) in enumerate(zip(got["slots"], got["counts"])):
        x[i, slots] = counts
    model = fit(x, list(got["lang"]), idf)
    if not model.langs:
        return model

    def near(x):
        step = ((weighted(x, idf) @ model.centroids.T).max(1).clip(0, 1) * STEPS).astype(int)
        return np.bincount(size_class(x) * (STEPS + 1) + step, minlength=SIZES * (STEPS + 1))

    model.floors = floors_of(_tallied(rows, (SIZES, STEPS + 1), near))
    return model


def language_of(text: Column, model: Model) -> Column:
    """(lang_pred, lang_score, lang_kept) of a text: language, cosine (0 to 1), and false if it is rejected."""
    @F.arrow_udf("struct<lang_pred: string, lang_score: double, lang_kept: boolean>")
    def judge(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, letters in parts:
            langs, scores, kept = [], [], []
            real = np.array(letters.to_pylist(), bool)
            for lo in range(0, len(texts), 512):
                lang, score, keep = model.predict([t or "" for t in texts.slice(lo, 512).to_pylist()])
                langs += lang
                scores.append(score)
                kept.append(keep)
            score, keep = (np.concatenate(x) if x else np.zeros(0) for x in (scores, kept))
            yield pa.StructArray.from_arrays([pa.array([l if r else UNKNOWN for l, r in zip(langs, real)], pa.string()), pa.array(np.where(real, score, 0.0), pa.float64()),
                                              pa.array(keep.astype(bool) & real, pa.bool_())], ["lang_pred", "lang_score", "lang_kept"])

    text = text.cast("string")
    return judge(text, lettered(text))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and lang_pred, lang_score, lang_kept (language_of); columns of these names are replaced.

    A text that is null, empty or has no letter is `und`, with score 0, and rejected.  With nothing to learn from, all
    texts are.  Texts of any length are judged whole, each by itself, so repeated rows get the same result.  Ties between
    centroids go to the language that sorts first.
    """
    added = ("lang_pred", "lang_score", "lang_kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added])
    made = docs.select(row.alias("row"), language_of(F.col(f"`{text_col}`"), model).alias("made"))
    return made.select("row.*", *[f"made.{c}" for c in added])
