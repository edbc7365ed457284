"""Importance resampling towards a target: hashed n-gram gains as an array, Gumbel draws, and the cutoff by threshold bisection.

Every word and pair of words falls in a bucket by its crc32.  The log ratio of target and corpus in a bucket is its gain;
a document's weight is the mean gain over its features, which one array look-up per feature scores.  Scores are written
once.  The cutoff score is found by counting jobs over that column that narrow an interval, then the last document id
among equal scores alike.  Only drawn rows are sorted, by range partitions, for their ranks.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from assayer.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS, SEED = 10_000, 7
#: Bytes of text and words looked at together; longer words are hashed one by one.
TEXT_BYTES, WORDS, LONG_WORD = 4 << 20, 1 << 18, 64
#: Thresholds that one counting job tries.
TRIES = 15


class Hasher:
    """Buckets of the words and word pairs of many texts at once, in UTF-8.

    The crc32 of a pair follows from its words' own: crc(a + b) is crc(a), carried over as many zero bytes as b has, xor
    crc(b).  Carrying over is linear, so a table per number of bytes does it.
    """

    def __init__(self, buckets: int):
        self.buckets = buckets
        code = np.arange(256)
        self.low = np.where((code >= 65) & (code <= 90), code + 32, code).astype(np.uint8)
        self.word = ((code >= 48) & (code <= 57)) | ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122)) | (code >= 128)
        t = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
        self.table = t
        now = (np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)).astype(np.uint32)
        carried = [now]
        for _ in range(LONG_WORD):
            now = self._zero(now)
            carried.append(now)
        self.carried = np.concatenate([x.ravel() for x in carried])

    def _zero(self, x: np.ndarray, byte: int | np.ndarray = 0) -> np.ndarray:
        return self.table[(x ^ byte) & 0xFF] ^ (x >> np.uint32(8))

    def _crc(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        order = np.argsort(np.minimum(sizes, LONG_WORD + 1).astype(np.uint8), kind="stable")
        at, length = starts[order], sizes[order]
        state = np.full(len(at), 0xFFFFFFFF, np.uint32)
        for k in range(min(int(length[-1]), LONG_WORD) if len(at) else 0):
            lo = int(np.searchsorted(length, k, "right"))
            state[lo:] = self._zero(state[lo:], data[at[lo:] + k])
        out = np.empty(len(at), np.uint32)
        out[order] = ~state
        for i in np.flatnonzero(sizes > LONG_WORD):
            out[i] = zlib.crc32(data[starts[i]:starts[i] + sizes[i]].tobytes())
        return out

    def _pairs(self, data: np.ndarray, crc: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """crc32 of each word, a space and the next word."""
        first = ~self._zero(~crc[:-1], 32)
        n, base = sizes[1:], np.minimum(sizes[1:], LONG_WORD) * 1024
        out = crc[1:].copy()
        for j in range(4):
            out ^= self.carried[base + (j * 256) + ((first >> np.uint32(8 * j)) & 0xFF)]
        for i in np.flatnonzero(n > LONG_WORD):
            out[i] = zlib.crc32(data[starts[i + 1]:starts[i + 1] + n[i]].tobytes(), int(first[i]))
        return out

    def slices(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text of each word, its bucket, text of each pair, its bucket), a bounded number of words at a time."""
        texts = texts.cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        row = 0
        while row < len(texts):
            end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + TEXT_BYTES, "right")) - 1)
            yield from self._slices(self.low[data[bounds[row]:bounds[end]]], bounds[row:end + 1] - bounds[row], row)
            row = end

    def _slices(self, data, bounds, row):
        inside = self.word[data]
        if not inside.any():
            return
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[bounds[:-1][bounds[:-1] < len(data)]] = False
        after[bounds[1:][bounds[1:] > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        text = np.searchsorted(bounds, starts, "right") - 1
        for lo in range(0, len(starts), WORDS):
            hi = min(lo + WORDS, len(starts))
            more = min(hi + 1, len(starts))  # the first word of the next slice ends this one's last pair
            at, sizes, own = starts[lo:more], ends[lo:more] - starts[lo:more], text[lo:more] + row
            crc = self._crc(data, at, sizes)
            same = own[:-1] == own[1:]
            pairs = self._pairs(data, crc, at, sizes)[same]
            yield own[:hi - lo], crc[:hi - lo] % self.buckets, own[:-1][same], pairs % self.buckets


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often the words and word pairs of all texts fall in each bucket; a task sends at most one row per bucket."""
    def run(batches):
        hasher, total = Hasher(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, words, _, pairs in hasher.slices(batch.column(0)):
                total += np.bincount(words, minlength=buckets) + np.bincount(pairs, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # at most `buckets` rows
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+n) / ((s+1)(T+n)))) for each of n buckets."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (float(s_all) + n) / ((float(s) + 1) * (float(t_all) + n)))) for s, t in zip(corpus, target)], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, seed: int, keep: list[str]) -> DataFrame:
    """Rows with their words, features, weight and score; `kept` is a struct of the columns to keep."""
    @F.arrow_udf("struct<words: bigint, total: bigint>")
    def weigh(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = Hasher(len(gain))
        for texts in parts:
            words, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for own, w, pair_own, p in hasher.slices(texts):
                lo, n = int(own[0]), int(own[-1]) - int(own[0]) + 1
                words[lo:lo + n] += np.bincount(own - lo, minlength=n)
                total[lo:lo + n] += np.bincount(own - lo, gain[w], n).astype(np.int64) + np.bincount(pair_own - lo, gain[p], n).astype(np.int64)
            yield pa.StructArray.from_arrays([pa.array(words), pa.array(total)], ["words", "total"])

    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), kept.alias("kept"))
    rows = rows.select("id", "kept", weigh("t").alias("w")).select("id", "kept", F.col("w.words").alias("words"), F.col("w.total").alias("total"))
    n = F.greatest(2 * F.col("words") - 1, F.lit(0))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    rows = rows.withColumn("n_features", n).withColumn(
        "weight", F.when(n > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0).cast("long"))
    return rows.select("id", "kept", "words", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"))


def cutoff(rows: DataFrame, value: Column, want: int) -> tuple[int, int]:
    """(v, n): the `want` largest values are the n ones above v and want - n of those equal to v.

    rows must be a written table with at least `want` rows, want at least 1.  Each job counts the rows at or above a few
    thresholds that divide the interval evenly, and the interval shrinks to one part; no row leaves the executors.
    """
    lo, hi = rows.agg(F.min(value), F.max(value)).first()
    above = 0  # rows above hi
    while lo < hi:
        tries = sorted({lo + (hi - lo) * k // (TRIES + 1) + 1 for k in range(TRIES + 1)} - {hi + 1})
        counts = rows.agg(*[F.count_if(value >= F.lit(t).cast("long")) for t in tries]).first()
        for t, n in zip(tries, counts):
            if n >= want:
                lo = t
            else:
                hi, above = t - 1, n
                break
    return lo, above


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = BUCKETS, seed: int = SEED,
              id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id_col, n_features, weight, score, rank, and keep as given) for every row of docs.

    Of the N rows with at least min_words words, the floor(percent * N / 100) of highest score are drawn and ranked from 1;
    rank is null for the others.  Equal scores go by the smaller id, a null id as the largest, then by the order of reading
    (rows of equal id and score differ in nothing but `keep`).  id_col must be a whole number.  Null and empty texts have no
    feature and weight 0; texts of any length are taken whole; an empty target or table is taken as it is.  Further columns
    of docs are ignored, whatever their names.
    """
    keep = list(keep or [])
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    rows = written(scored(docs, gain, id_col, text_col, seed, keep).withColumn("row", F.monotonically_increasing_id()), "resample-scores")
    fit = rows.where(F.col("words") >= min_words)
    want = fit.count() * percent // 100
    out = [F.col("id").alias(id_col), "n_features", "weight", "score", "rank", *[F.col(f"kept.`{c}`").alias(c) for c in keep]]
    if not want:
        return rows.withColumn("rank", F.lit(None).cast("long")).select(*out)
    # keys that all sort downwards: a score, ~id (a smaller id is larger), ~row
    keys = [F.col("score"), F.coalesce(F.bitwise_not("id"), F.lit(-(1 << 63)).cast("long")), F.bitwise_not("row")]
    inside, over, tied = F.lit(False), F.lit(True), want
    for key in keys:
        v, n = cutoff(fit.where(over), key, tied)
        v = F.lit(v).cast("long")
        inside, over, tied = inside | (over & (key > v)), over & (key == v), tied - n
    drawn = (F.col("words") >= min_words) & (inside | over)
    order = [k.desc() for k in keys]
    lined = rows.where(drawn).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    lined = written(lined, "resample-drawn")  # `at` is the partition times 2**33 plus the place in it
    part = F.shiftright("at", 33)
    parts = sorted((r.part, r.n) for r in lined.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # as many as partitions
    before, first = 0, []
    for p, n in parts:
        first.append((p, before))
        before += n
    first = docs.sparkSession.createDataFrame(first, "part long, before long")
    ranked = lined.withColumn("part", part.cast("long")).join(F.broadcast(first), "part").withColumn(
        "rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return ranked.select(*out).unionByName(rows.where(~drawn).withColumn("rank", F.lit(None).cast("long")).select(*out))
