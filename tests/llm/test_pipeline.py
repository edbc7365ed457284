"""The pipeline and the registered queries."""

import os
from collections import Counter

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from assayer.llm import langid, minhash, pii, quality, queries
from assayer.llm.shared import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("*", "'x' AS bucket")
    kept = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == [*COLUMNS, "bucket"], name
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        assert len(ids) == len(set(ids)) and set(ids) <= kept and len(ids) > 0.6 * len(kept), name
        kept = set(ids)
        docs = spark.createDataFrame(rows, out.schema)
    pieces = corpus_pipeline.pack(spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == kept


def test_repeated_and_null_ids(spark, sf):
    docs = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (None, "x y"), (None, "z"), (3, None)],
                                 "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(0 as long) AS n_chars")
    got = corpus_pipeline.minhash_dedup(spark, docs, sf).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "None", "None"]


def test_one_id_with_several_texts(spark, sf):
    """A row goes only for its own text: texts that share an id are judged apart, and each group keeps one row."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (1, c), (0, b), (2, a + " more"), (2, "quite another text of some words here"), (1, c), (5, ""), (5, None), (5, "")] + [(9, " ".join(f"t{n}x{i}" for i in range(12))) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minhash.deduplicated(docs).collect()), key=repr)
    assert got == sorted({(1, a), (1, c), (0, b), (2, rows[5][1]), (5, ""), (5, None), *rows[10:]}, key=repr)
    near = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert near[(1, 1, True)] == 3 and near[(1, 0, False)] == 1 and near[(2, 1, False)] == 1 and near[(2, 2, True)] == 1 and near[(9, 9, True)] == 40


NAMES = ["_text", "_real", "_found", "_key", "_names", "_fakes", "row", "key", "found", "made", "id", "content", "first", "lang_pred", "lang_kept", "quality_score", "n_entities", "fakes", "people"]


def test_names_that_clash(spark, sf):
    """Columns named like anything that an operator makes keep their values through every stage; no original value leaves."""
    secret = "Mr. John Smith wrote from j.smith@mail.example.org about the thing. "
    rows = [(i, t) for i, t in enumerate([secret + "the and of that this with", None, "", "one", "word " * 200_000, secret * 3, secret * 3, "the and of that this with from and or"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"),
                                                                         *[F.concat(F.lit(f"{n}-"), F.col("doc_id")).alias(n) for n in NAMES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert [r[n] for n in NAMES] == [f"{n}-{r.doc_id}" for n in NAMES], name
            if name == "personal_data":
                assert "John" not in (r.text or "") and "j.smith" not in (r.text or "") and (r.text is None or r.n_chars == len(r.text))
    for out in (langid.identify(docs, langid.train(docs)), quality.scored(docs, quality.train(docs, table(spark, sf, "labels"))), pii.pseudonymised(docs, "k")):
        for r in out.collect():
            assert all(r[n] == f"{n}-{r.doc_id}" for n in NAMES if n not in ("lang_pred", "lang_kept", "quality_score", "n_entities"))
    assert len(corpus_pipeline.pack(spark, docs, sf).collect()) >= len(rows)


def test_odd_and_empty_tables(spark, sf):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", None), (None, "  \n", "en"), (3, "a" * 1_000_000, "de"), (4, "the and of " * 100_000, "en"), (4, "the and of " * 100_000, "en")],
                                 "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "cast(length(text) as long) AS n_chars")
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, sf)
            assert out.columns == docs.columns and out.count() <= start.count(), name
            now = spark.createDataFrame(out.collect(), out.schema)
        corpus_pipeline.pack(spark, now, sf).collect()


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() > 0 and "sequence_id" in rows.columns


def test_registered():
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(queries.QUERIES) and len(queries.QUERIES) == 13
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert os.path.exists(public_tokenizers.path("word_bpe_49k.json"))
