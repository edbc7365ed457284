"""The learned classifiers against plain versions: features, fitted weights, cut, centroid search and floors."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import langid, quality
from assayer.llm.shared import table

TEXTS = ["", " \n\t ", "Wort", "a b  b", "Der Hund, der Hund bellt!  NASA | 12:30\r\nEnde.\n", "é ß   x\x00\x1c \x85", "word " * 3000, "A" * 30 + " b " + "İstanbul ÖL", "!" * 9,
         "Zeile\n" * 70, "x\ud800y", "語 日本語 テキスト。 mit Latin", "one-two;three: (four) \"five\" 'six'", "12 345 6.7 %"]


def raw(text):
    return (text or "").encode("utf-8", "surrogatepass")


def kind(b):
    c = chr(b)
    if b >= 128:
        return "beyond"
    if b in (10, 13):
        return "line"
    if b in (32, 9, 11, 12):
        return "space"
    return ("lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "mark" if c in ".,;:'\"()-" else c if c in "!|" else "other")


def plain_shape(text):
    data = raw(text)
    n = Counter(map(kind, data + b"\n"))
    size, letters = max(len(data), 1), max(n["lower"] + n["upper"] + n["beyond"], 1)
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    low = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in words]
    count, most = max(len(words), 1), max(Counter(low).values(), default=0)
    share = lambda test: sum(map(bool, map(test, words))) / count
    mean = sum(map(len, words)) / count
    spread = math.sqrt(max(sum(len(w) ** 2 for w in words) / count - mean ** 2, 0))
    capital = lambda w: sum(kind(b) == "upper" for b in w) > 1 and not any(kind(b) == "lower" for b in w)
    return [n["other"] / size, n["upper"] / letters, *(n[k] / size for k in ("digit", "mark", "space", "line", "beyond", "!", "|")),
            sum(a == b for a, b in zip(low, low[1:])) / count, len(set(low)) / count, most / count, mean / 10, spread / 10,
            share(lambda w: w[-1:] in (b".", b"!", b"?")), share(lambda w: kind(w[0]) == "upper"), share(capital), share(lambda w: kind(w[-1]) == "other"),
            share(lambda w: len(w) == 1), share(lambda w: len(w) > 20), math.log1p(count) / 10, math.log1p(n["line"]) / 10, math.log1p(most) / 10, float(not data)]


def test_features_of_texts():
    got = quality.shape([raw(t) for t in TEXTS])
    assert np.allclose(got, [plain_shape(t) for t in TEXTS], atol=1e-9)
    assert np.allclose(got, np.concatenate([quality.shape([raw(t)]) for t in TEXTS]))


def test_weights_are_the_least_loss():
    rng = np.random.default_rng(5)
    good = rng.random(600) < 0.4
    x = rng.normal(size=(600, quality.NAMES)) + good[:, None] * np.linspace(0, 0.8, quality.NAMES)
    model = quality.fit(x, good, pairs=4000, seed=9)
    z = quality.expanded(x, model.mean, model.std, model.knots)
    rng = np.random.default_rng(9)
    diff = z[rng.choice(np.flatnonzero(good), 4000)] - z[rng.choice(np.flatnonzero(~good), 4000)]
    loss = lambda w: np.log1p(np.exp(-(diff @ w))).mean() + 0.5e-3 * (w @ w)
    least = loss(model.weights)
    for i in range(len(model.weights)):
        for step in (-0.01, 0.01):
            assert loss(model.weights + step * np.eye(len(model.weights))[i]) > least
    assert model.cut == pytest.approx(np.quantile(z @ model.weights, (~good).mean()))


@pytest.mark.parametrize("fits", [True, False])
def test_cut_covers_all_labelled_texts(spark, monkeypatch, fits):
    """Weights come from 200 rows, the cut from all; also where the labels are too many to broadcast."""
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 10 ** 6 if fits else 0)
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = quality.train(docs, labels, labelled=200)
    marks = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = [(r.text, marks[r.doc_id] == 1) for r in docs.select("doc_id", "text").collect() if r.doc_id in marks]
    assert len(rows) > 250
    z = quality.expanded(np.array([plain_shape(t) for t, _ in rows]), model.mean, model.std, model.knots)
    strength, bad = z @ model.weights, 1 - np.mean([g for _, g in rows])
    assert model.cut == pytest.approx(np.quantile(strength, bad), abs=1e-6)
    got = np.array([r.quality_score for r in quality.scored(docs.join(F.broadcast(labels.select("doc_id")), "doc_id").orderBy("doc_id"), model).collect()])
    texts = [r.text for r in docs.join(labels, "doc_id").orderBy("doc_id").collect()]
    z = quality.expanded(np.array([plain_shape(t) for t in texts]), model.mean, model.std, model.knots)
    want = 1 / (1 + np.exp(-np.clip(z @ model.weights - model.cut + math.log(0.3 / 0.7), -40, 40)))
    assert np.allclose(got, want, atol=1e-6)


def plain_grams(text):
    data = [b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in raw(text)] + [32] * 3
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(data) - n + 1):
            if data[i] != 32:
                code = int.from_bytes(bytes(data[i:i + n]), "big")
                out[((code + (n << 28)) * 0x9E3779B1 % (1 << 32)) >> 20] += 1
    return out


def plain_cosines(text, idf, centroids):
    grams = plain_grams(text)
    x = np.zeros(langid.DIMS)
    for slot, n in grams.items():
        x[slot] = (1 + math.log(n)) * idf[slot]
    length = math.sqrt((x * x).sum()) or 1
    return sum(grams.values()), centroids.astype(float) @ (x / length)


def test_grams_of_texts():
    got = langid.gram_counts([raw(t) for t in TEXTS])
    for row, text in zip(got, TEXTS):
        assert {int(s): int(row[s]) for s in np.flatnonzero(row)} == dict(plain_grams(text))


def test_frequencies_floors_and_languages_cover_all_training_texts(spark):
    """Centroids come from some 20 texts a language, frequencies and floors from all."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, per_language=20)
    rows = [r for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)]
    known = [r for r in rows if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    seen = Counter(s for r in known for s in plain_grams(r.text))
    assert np.allclose(model.idf, [math.log((1 + len(known)) / (1 + seen[s])) + 1 for s in range(langid.DIMS)], atol=1e-5)
    judged = {r.doc_id: plain_cosines(r.text, model.idf, model.centroids) for r in rows}
    per = defaultdict(list)
    for r in known:
        grams, cos = judged[r.doc_id]
        per[int(math.log2(max(grams, 1)))].append(cos.max())
    filled = {s: sorted(c) for s, c in per.items() if len(c) >= 5}
    assert len(filled) > 2
    for s in range(langid.SIZES):
        near = min(filled, key=lambda f: (abs(f - s), f))
        low = filled[near][int(0.001 * len(filled[near]))]
        assert model.floors[s] == pytest.approx(0.5 * math.floor(low * 1000) / 1000 * 0.5 ** (max(0, near - s) / 2), abs=6e-4)
    for r in langid.identify(docs, model).collect():
        if r.doc_id in judged:
            grams, cos = judged[r.doc_id]
            floor = model.floors[int(math.log2(max(grams, 1)))]
            assert r.lang_score == pytest.approx(cos.max(), abs=1e-5)
            assert cos[[l == r.lang_pred for l in model.langs]].max() >= cos.max() - 1e-5
            assert r.lang_kept == (cos.max() >= floor) or abs(cos.max() - floor) < 1e-5


def test_floor_is_a_low_share_at_every_size():
    """A few strange texts among many don't lower the floor; among few texts the lowest counts; empty classes borrow."""
    counted = np.zeros((langid.SIZES, langid.STEPS + 1), int)
    counted[8, [10, 600, 800]] = 1, 2, 5000
    counted[12, [400, 900]] = 1, 99
    counted[20, 3] = 4
    floors = langid.floors_of(counted)
    assert floors[8] == pytest.approx(0.4) and floors[12] == floors[20] == pytest.approx(0.2) and floors[6] == pytest.approx(0.2)
    assert not langid.floors_of(np.zeros((langid.SIZES, langid.STEPS + 1), int)).any()
