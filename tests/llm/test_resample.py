"""Importance resampling against a plain Python version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from assayer.llm import resample
from assayer.session import written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(LOW))
    return w, [zlib.crc32(f.encode("utf-8", "surrogatepass")) % 10_000 for f in [*w, *map(" ".join, zip(w, w[1:]))]]


def plain(rows, target, percent=25, least=20):
    s, t = Counter(b for _, x in rows for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (n_s + 10_000.0) / ((s[b] + 1.0) * (n_t + 10_000.0))))
    out = []
    for i, x in rows:
        w, f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = fit[:percent * len(fit) // 100]
    rest = Counter((r[0], *r[2:]) for r in out) - Counter((r[0], *r[2:]) for r in drawn)
    return [(r[0], *r[2:], k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in rest.elements()]


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ß", "ÀB", "x" * 64, "y" * 65, "Z" * 300, "日本"]
    return [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("percent, least", [(25, 20), (100, 0), (1, 20), (60, 3)])
def test_draw(spark, percent, least):
    odd = [(901, None), (902, ""), (903, " .,\n"), (904, "one"), (905, "Two words"), (906, "long text " * 50_000), (None, "no id at all " * 20), (None, "no id at all " * 20), (907, "q" * 200_000)]
    rows = [(i - 40, t) for i, t in enumerate(texts(1, 200))] + odd + [(7, "same row " * 30)] * 60 + [(8, None)] * 30
    target = [*texts(2, 5), None, ""]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, kept string, score int").repartition(7)
    got = resample.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), percent, least).collect()
    assert Counter(map(tuple, got)) == Counter(plain(rows, target, percent, least))


def test_kept_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(i, t, f"src{i}") for i, t in enumerate(texts(3, 80))], "doc_id long, text string, id string")
    target = spark.createDataFrame([("w1 w2 w3",)], "text string")
    whole = {r.doc_id: r for r in resample.resampled(df, target, keep=["text", "id"]).collect()}
    assert all(whole[i].text == t and whole[i].id == f"src{i}" for i, t in enumerate(texts(3, 80)))
    assert resample.resampled(df.limit(0), target).count() == 0
    assert {r.doc_id: r.score for r in resample.resampled(df, target.limit(0)).collect()} == {r[0]: r[3] for r in plain(list(enumerate(texts(3, 80))), [])}


def test_cutoff(spark):
    rng = random.Random(0)
    for values in ([5] * 40, [rng.randrange(-50, 50) for _ in range(300)], [-(2**63), 2**63 - 1, 0, 0], [rng.getrandbits(62) for _ in range(100)]):
        rows = written(spark.createDataFrame([(v,) for v in values], "v long"), "cutoff-test")
        for want in {1, 2, len(values) // 2, len(values)}:
            v, above = resample.cutoff(rows, F.col("v"), want)
            assert v == sorted(values, reverse=True)[want - 1] and above == sum(x > v for x in values)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ é\n-9日", max_size=40), st.text(max_size=20).filter(lambda s: s.isprintable())), max_size=6), st.integers(0, 3))
def test_buckets(parts, skip):
    hasher = resample.Hasher(10_000)
    arr = pa.array(parts, pa.string())[skip:]
    got = [Counter() for _ in range(len(arr))]
    for own, w, pair_own, p in hasher.slices(arr):
        for i, b in [*zip(own, w), *zip(pair_own, p)]:
            got[i][int(b)] += 1
    assert got == [Counter(features(t)[1]) for t in parts[skip:]]


def test_buckets_over_slices(monkeypatch):
    monkeypatch.setattr(resample, "WORDS", 3)
    monkeypatch.setattr(resample, "TEXT_BYTES", 50)
    parts = [*texts(9, 40), None, "z" * 500]
    total = Counter()
    for _, w, _, p in resample.Hasher(10_000).slices(pa.array(parts)):
        total.update(np.concatenate([w, p]).tolist())
    assert total == Counter(b for t in parts for b in features(t)[1])
