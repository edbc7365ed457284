"""License blocks and phrases against a plain Python version."""

import random
import re
from collections import Counter

import pytest

from assayer.llm import licenses

WORD = re.compile(licenses.WORD)
LOW = {i: i + 32 for i in range(65, 91)}


def plain(text, templates, phrases, percent):
    w = WORD.findall((text or "").translate(LOW))
    places = sorted((i, label) for label, p in phrases for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
    blocks = []
    for t in licenses.template_sets(templates, percent):
        own, step = set(t["words"]), t["step"]
        for start in range(0, len(w), step):
            both = len(own & set(w[start:start + 2 * step]))
            if 100 * both >= percent * len(own):
                blocks.append((t["label"], t["no"], start, 2 * step, both / len(own)))
    return len(w), places, sorted(blocks)


def texts():
    rng = random.Random(3)
    notices = [t for _, t in licenses.TEMPLATES]
    prose = "the of and in to that with this work any or use as by source free".split()
    out = [None, "", " \n", "MIT License", "mit-license MIT.License gnu general public license gnu general public license", "cc by cc by-nc", "MİT LICENSE", "worK under the MIT license",
           "MIT", "license mit", "apache license", "apache\x00license", "CC\nBY", "Apache, LICENSE! GNU / General (Public) license"]
    for n in notices:
        words = n.split()
        out += [n, n.upper(), "\n".join(words), " ".join(words[: len(words) * 9 // 10]), " ".join(words[: len(words) // 2])]
        rng.shuffle(words)
        out.append(" ".join(rng.choices(prose, k=37) + words + rng.choices(prose, k=200)))
        out.append(" ".join(x for w in words for x in (w, *rng.choices(["zq", "xv"], k=3))))  # spread out
    out += [" ".join(rng.choices(prose, k=3000)), " ".join(rng.choices(prose, k=60000)) + " " + notices[1]]
    return out + out[:20]


@pytest.mark.parametrize("percent", [80, 55, 100])
def test_blocks_and_places(spark, percent):
    rows = [(i if i % 7 else None, t, "clash", 3) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, row long").repartition(5)
    got = [(r.doc_id, r.n_words, sorted((p.start, p.label) for p in r.places), sorted((b.label, b.template, b.start, b.words, b.containment) for b in r.blocks))
           for r in licenses.scan(df, percent=percent).collect()]
    want = [(i, *plain(t, licenses.TEMPLATES, licenses.PHRASES, percent)) for i, t, _, _ in rows]
    assert Counter(map(repr, got)) == Counter(map(repr, want))


def test_own_templates_and_phrases(spark):
    templates = [("none", "..."), ("one", "Ünïque"), ("a", "a b c d e f g h i j"), ("b", "a b c d e f g h i k")]
    phrases = [("x", "a"), ("y", "a b"), ("x", "a b")]
    rows = [(1, "a b a b c d e f g h i"), (2, "ÜNÏQUE a"), (3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df, templates, phrases).collect()}
    assert sorted(got[1].places) == sorted([(0, "x"), (2, "x"), (0, "y"), (2, "y"), (0, "x"), (2, "x")])
    assert {(b.label, b.containment) for b in got[1].blocks} == {("a", 0.9), ("b", 0.9)}
    assert [b.label for b in got[2].blocks] == ["one"] and not got[3].blocks and not got[3].places


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    assert licenses.scan(df.limit(0)).count() == 0
    row = licenses.scan(df, [], []).first()
    assert (row.n_words, row.places, row.blocks) == (2, [], [])
    with pytest.raises(ValueError):
        licenses.template_sets([("x", "y")] * (licenses.TEMPLATES_AT_MOST + 1))


def test_no_python_on_the_way(spark, sf):
    df = spark.createDataFrame([(1, "Released under the MIT License")], "doc_id long, text string")
    sets = licenses.template_sets(licenses.TEMPLATES)
    read = licenses._read(df, sets, licenses.PHRASES, "doc_id", "text")
    for plan in (read, licenses.matching_blocks(read, sets), licenses.scan(df)):
        text = plan._jdf.queryExecution().toString()
        assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
