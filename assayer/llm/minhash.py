"""Near duplicates of texts: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

Texts that have the same shingle set fall into one class first, so any number of copies costs one row from there on.
Each class gets one signature from a single permutation; empty bins borrow from a filled bin chosen by a hash of the
bin (optimal densification).  Bands of the signature are buckets.  Round 1 proposes one star edge per class, to the
smallest member of its buckets.  Round 2 looks only at buckets whose members still lie in different components, block
by block, and hands on the links that join them.  Every link is confirmed on full sets.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from assayer.llm.shared import components, in_blocks, small_or_shuffled
from assayer.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 192
#: Signatures of a pair at the threshold agree in this share less with a chance below 1e-3 if both sets have SIGNED_WELL
#: shingles.  Smaller sets fill few bins, so their agreement is uneven: they are always confirmed.
SLACK, SIGNED_WELL = 0.12, 64
#: Bytes of text hashed at once by one task; its arrays take about 64 times that.
CHUNK = 1 << 17
#: Rows whose texts, sets and signatures a task holds at once; an Arrow batch may have 10,000.
SIGN_ROWS = 256
ODD, A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**i and its inverse modulo 2**64, for i < n; a Python worker keeps them from task to task."""
    _powers = sys.__dict__.setdefault("_assayer_powers", [])
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1024)
        inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)]) for x in (ODD, inverse)]
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased, split at ASCII white space) and the index of its text."""
    buf = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.flatnonzero(np.diff(np.r_[True, space].astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    up, down = powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(mix(np.arange(1, 257, dtype=np.uint64))[buf] * up, out=total[1:])
    words = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * C)
    lengths = np.array([len(t) + 1 for t in texts])
    return words, np.searchsorted(np.cumsum(lengths), start, "right")


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; fewer words are one shingle, no word none."""
    out: list = []
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) < CHUNK:
            size += len(texts[to]) + 1
            to += 1
        words, owner = word_hashes(texts[at:to])
        bounds = np.searchsorted(owner, np.arange(to - at + 1))
        rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for i in range(k):
            rolled = rolled * A + words[i:i + len(rolled)]
        rolled = mix(rolled + np.uint64(k))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo >= k:
                out.append(np.unique(rolled[lo:hi - k + 1]))
            elif hi > lo:
                h = np.uint64(0)
                with np.errstate(over="ignore"):
                    for w in words[lo:hi]:
                        h = h * A + w
                    out.append(mix(np.array([h + np.uint64(hi - lo)])))
            else:
                out.append(np.zeros(0, np.uint64))
        at = to
    return out


#: For each bin the bins that it tries to borrow from, in order.
_borrow = (mix(np.arange(BINS * 32, dtype=np.uint64) * ODD + np.uint64(7)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, 32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One permutation, BINS bins, the least value of each; empty bins take a filled one's (optimal densification)."""
    g = mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    key = np.sort((((g >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32) << np.uint64(32)) | (g & np.uint64(0xFFFFFFFF)))
    bins = (key >> np.uint64(32)).astype(np.int64)
    first = np.r_[True, bins[1:] != bins[:-1]]
    sig, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    sig[bins[first]], filled[bins[first]] = key[first], True
    empty = np.flatnonzero(~filled)
    if len(empty):
        tries = filled[_borrow[empty]]
        found = np.flatnonzero(filled)
        after = found[np.searchsorted(found, empty) % len(found)]  # after 32 tries: the next filled bin
        sig[empty] = sig[np.where(tries.any(1), _borrow[empty, tries.argmax(1)], after)]
    return mix(sig)


def band_rows(threshold: float, miss: float = 1e-3) -> int:
    """Most rows per band for which a pair at the threshold shares no bucket with a chance of at most `miss`."""
    return max(r for r in (1, 2, 3, 4, 6, 8, 12, 16) if r == 1 or (1 - threshold ** r) ** (BINS // r) <= miss)


SIGNED = "id long, content long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch binary"


def _signer(k: int, rows: int):
    mult = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    salt = mix(np.arange(BINS // rows, dtype=np.uint64) + np.uint64(99))

    def sign(batches):
        for batch in (whole.slice(at, SIGN_ROWS) for whole in batches for at in range(0, whole.num_rows, SIGN_ROWS)):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            sizes, fps, bands, sketches = [], [], [], []
            for s in shingle_sets(texts, k):
                sizes.append(len(s))
                if len(s):
                    sig = signature(s)
                    fps.append((np.bitwise_xor.reduce(mix(s + B)).view(np.int64), np.add.reduce(mix(s ^ A)).view(np.int64)))
                    bands.append(mix((sig.reshape(-1, rows) * mult).sum(1, dtype=np.uint64) + salt).view(np.int64))
                    sketches.append((sig >> np.uint64(11)).astype(np.uint8).tobytes())
                else:
                    fps.append((0, 0))
                    bands.append(np.zeros(0, np.int64))
                    sketches.append(b"")
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array([int(f[0]) for f in fps], pa.int64()),
                pa.array([int(f[1]) for f in fps], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["id", "content", "n_shingles", "fp1", "fp2", "bands", "sketch"])

    return sign


def _confirmer(k: int, percent: int):
    def confirm(batches):
        for batch in batches:
            n = batch.num_rows
            for at in range(0, n, 256):
                part = batch.slice(at, 256)
                left, right = ([(t or "").encode("utf-8", "surrogatepass") for t in part.column(c).to_pylist()] for c in ("text_a", "text_b"))
                sets = shingle_sets(left + right, k)
                keep = []
                for x, y in zip(sets[:len(left)], sets[len(left):]):
                    both = np.intersect1d(x, y, assume_unique=True).size
                    keep.append(bool(both) and 100 * both >= percent * (x.size + y.size - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _resolver(k: int, percent: int):
    """Links between members of one bucket (or pair of its blocks) that lie in different components.

    Pairs of sizes that can't reach the threshold, pairs of large sets whose signatures agree too seldom, and pairs that
    share an earlier band are passed over; the others are confirmed on full sets, the most alike first, until their
    components have met.  So the output grows with the members.
    """
    least = (percent / 100 - SLACK) * BINS

    def resolve(key, pdf):
        import pandas as pd

        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), BINS)
        bands, size = np.stack(pdf["bands"].to_numpy()), pdf["n_shingles"].to_numpy()
        ids, side, band = pdf["id"].to_numpy(), pdf["side"].to_numpy(), int(pdf["band"].iloc[0])
        comp, texts = pdf["comp"].to_numpy().copy(), pdf["text"].tolist()
        sets: dict = {}

        def of(i):
            if i not in sets:
                sets[i] = shingle_sets([(texts[i] or "").encode("utf-8", "surrogatepass")], k)[0]
            return sets[i]

        a, b = [], []
        for i in range(len(ids)):
            if key[1] == key[2]:
                other = np.flatnonzero((comp != comp[i]) & (ids > ids[i]))
            else:
                other = np.flatnonzero((comp != comp[i]) & (side == 1)) if side[i] == 0 else ()
            if not len(other):
                continue
            alike = (sketch[other] == sketch[i]).sum(1)
            small, large = np.minimum(size[other], size[i]), np.maximum(size[other], size[i])
            may = (100 * small >= percent * large) & ((alike >= least) | (small < SIGNED_WELL))
            other, alike = other[may], alike[may]
            if len(other) and band:
                fresh = ~(bands[other, :band] == bands[i, :band]).any(1)
                other, alike = other[fresh], alike[fresh]
            for j in other[np.argsort(-alike, kind="stable")]:
                if comp[i] == comp[j]:
                    continue
                x, y = of(i), of(j)
                both = np.intersect1d(x, y, assume_unique=True).size
                if both and 100 * both >= percent * (x.size + y.size - both):
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
                    comp[comp == comp[j]] = comp[i]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return resolve


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, content, text): content is a hash of the text, which tells rows of one id apart."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("content"), text.alias("text"))


def classified(docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float) -> DataFrame:
    """(id, content, n_shingles, first) for each row of docs; first is the smallest (id, content) of the row's component,
    null for rows that take no part (no shingle, or no id).

    Rows of equal shingle sets are one class.  A class is a node of its own number, so an id may repeat with other texts.
    """
    percent, rows = round(threshold * 100), band_rows(threshold)
    source = _source(docs, id_col, text_col)
    signed = written(source.mapInArrow(_signer(words, rows), SIGNED), "minhash-signed")
    linkable = signed.where("n_shingles > 0 and id is not null")
    classes = linkable.groupBy("fp1", "fp2").agg(F.min(F.struct("id", "content")).alias("first")).select("first", F.col("fp1").alias("c1"), F.col("fp2").alias("c2"))
    classes = classes.select("first.id", "first.content", "c1", "c2")
    reps = linkable.join(classes, ["id", "content"]).where("fp1 = c1 and fp2 = c2").dropDuplicates(["fp1", "fp2"])
    reps = written(reps.select(F.struct("id", "content").alias("first"), "fp1", "fp2", "n_shingles", "bands", "sketch").withColumn("id", F.monotonically_increasing_id()), "minhash-reps")

    every = reps.select("id", F.posexplode("bands").alias("band", "bucket"))
    shared = every.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("center")).where("n > 1")
    members = written(every.join(shared, "bucket").select("bucket", "band", "id", "center"), "minhash-members")
    stars = written(members.where("id <> center").groupBy("id").agg(F.min("center").alias("a")).select("a", F.col("id").alias("b")), "minhash-stars")
    wanted = written(members.select("id").distinct().join(reps.select("id", "first"), "id").select(F.col("id").alias("node"), "first.id", "first.content"), "minhash-wanted")
    texts = written(source.join(small_or_shuffled(wanted, wanted.count()), ["id", "content"]).select(F.col("node").alias("id"), "text").dropDuplicates(["id"]), "minhash-texts")

    a, b = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    links = written(stars.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
                    .mapInArrow(_confirmer(words, percent), "a long, b long"), "minhash-links")
    found = written(components(links), "minhash-components")
    placed = members.join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "bucket", "band", "id", F.coalesce("comp", "id").alias("comp"))
    placed = written(placed, "minhash-placed")
    mixed = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket", "n")
    dealt = in_blocks(placed, ["bucket"], "id", mixed).join(reps.select("id", "n_shingles", "bands", "sketch").join(texts, "id"), "id")
    rest = written(dealt.groupBy("bucket", "block_a", "block_b").applyInPandas(_resolver(words, percent), "a long, b long"), "minhash-rest")
    final = components(found.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionAll(rest))

    joined = written(final.join(reps.select(F.col("id").alias("node"), "first"), "node"), "minhash-joined")  # nodes with links only
    least = joined.groupBy("comp").agg(F.min("first").alias("least"))
    firsts = reps.select("id", "fp1", "fp2", "first").join(joined.join(least, "comp").select(F.col("node").alias("id"), "least"), "id", "left")
    firsts = firsts.select("fp1", "fp2", F.coalesce("least", "first").alias("first"))
    result = signed.select("id", "content", "n_shingles", F.when(F.expr("n_shingles > 0 and id is not null"), F.col("fp1")).alias("fp1"), "fp2").join(firsts, ["fp1", "fp2"], "left")
    return result.select("id", "content", "n_shingles", "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per row of docs: (id_col, n_shingles, component_id, kept).

    Two texts are linked if the Jaccard similarity of their sets of `words`-word shingles is at least `threshold` (to a
    hundredth).  component_id is the smallest id reachable, kept says whether the id is that.  Null or empty text: no
    shingles, no links, kept.  Null id: component null, kept.  Repeated ids: each row gets the result of its own text, so
    rows of one id with other texts are not linked by their id.  Only id_col and text_col are read, so further columns
    never clash.  Texts of any length are taken whole.  Empty input: empty result.
    """
    rows = classified(docs, id_col, text_col, words, threshold)
    component = F.coalesce("first.id", "id")
    return rows.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs of which one of each group of near duplicates stays: the one of smallest id.

    A row goes only because of its own text: rows that share an id but not a text are judged apart.  Of rows of equal id and
    text one stays.  Rows of null id or, under different ids, without text stay all.  Columns of any name are carried through.
    """
    rows = classified(docs, id_col, text_col, words, threshold)
    gone = written(rows.where("first is not null and first <> struct(id, content)").select("id", "content").distinct(), "dedup-gone")
    whole = ["id", "content"]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias(whole[0]),
                        F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias(whole[1]))
    repeated = written(rows.where("id is not null").groupBy("id", "content").count().where("count > 1").select("id", "content"), "dedup-repeated")
    left = keyed.join(small_or_shuffled(gone, gone.count()), whole, "left_anti")
    repeated = small_or_shuffled(repeated, repeated.count())
    once = left.join(repeated, whole, "left_anti").unionByName(left.join(repeated, whole, "left_semi").dropDuplicates(whole))
    return once.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
