"""Supervised sequences from archived decisions, and checks on their splits."""

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer import fixed_values as V
from assayer.functions import labels as L
from assayer.operators.joins import join_by_size, once

# the tokenizer step travels to the workers by value, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ["correlation_id", "qid"]


def archived_decisions(blobs: DataFrame) -> DataFrame:
    """Every archived subject decision as (qid, kind, value) rows, one explode per article."""
    def three(s):
        def row(suffix, kind, value):
            return F.struct(F.concat(F.lit("subj_"), s.subject_id, F.lit(f"_{suffix}")).alias("qid"), F.lit(kind).alias("kind"), value.alias("value"))
        return F.array(row("valid", "validation", F.coalesce(s.is_valid, F.lit(False)).cast("string")),
                       row("prominence", "prominence", s.prominence), row("sentiment", "sentiment", s.sentiment))

    rows = F.flatten(F.transform(L.last_wins(F.col("subject_results"), "subject_id"), three))
    return blobs.select("correlation_id", "config_id", F.inline(rows))


def with_targets(rows: DataFrame) -> DataFrame:
    """Label number and one-hot target; values outside the vocabulary drop out."""
    label = L.label_index(F.col("kind"), F.col("value"))
    return rows.withColumn("label", label).filter(F.col("label").isNotNull()).withColumn(
        "target", L.one_hot(F.col("label"), L.kind_width(F.col("kind")))).drop("value")


def label_join(decisions: DataFrame, questions: DataFrame) -> DataFrame:
    """Archived decisions that have a question of the same id in their configuration."""
    return join_by_size(decisions, questions.select("config_id", "qid", "qtype"), ["config_id", "qid"])


def supervised_labels(blobs: DataFrame, questions: DataFrame, tags: DataFrame) -> DataFrame:
    """(correlation, config, qid, kind, label, target) rows of all four kinds.

    tags(correlation_id, config_id, tag_id, result): archived model-judged tags; a tag is asked once per subject.
    """
    q = questions.select("config_id", "qid", "tag_id", "kind", "qtype")
    subj = join_by_size(archived_decisions(blobs), q.filter("kind <> 'tag'").select("config_id", "qid", "qtype"), ["config_id", "qid"])
    tag = join_by_size(tags, q.filter("kind = 'tag'").select("config_id", "qid", "tag_id", "qtype"), ["config_id", "tag_id"]).select(
        "correlation_id", "config_id", "qid", F.lit("tag").alias("kind"), F.col("result").cast("string").alias("value"), "qtype")
    return with_targets(subj.select("correlation_id", "config_id", "qid", "kind", "value", "qtype").unionByName(tag))


def whitespace_tokenizer():
    """Stand-in tokenizer: a word's id comes from its md5, which other engines can compute too."""
    from hashlib import md5

    known: dict[str, int] = {}

    def encode(text):
        if len(known) > 200_000:
            known.clear()
        words = text.split()
        for w in words:
            if w not in known:
                known[w] = int(md5(w.encode("utf-8", "replace")).hexdigest()[:7], 16) % 50_000
        return [known[w] for w in words]

    return encode


def labelled_questions(subject_results: Column, base_tags: Column, questions: Column) -> Column:
    """The questions of an article that its archive answers, with their place and label, inside the article's row."""
    def one(q, place):
        s = F.get(F.filter(subject_results, lambda x: x.subject_id == q.subject_id.cast("string")), F.lit(0))
        t = F.get(F.filter(base_tags, lambda x: x.tag_id == q.tag_id), F.lit(0))
        value = (
            F.when(q.kind == "validation", F.when(s.isNotNull(), F.coalesce(s.is_valid, F.lit(False)).cast("string")))
            .when(q.kind == "prominence", s.prominence).when(q.kind == "sentiment", s.sentiment)
            .otherwise(F.when(t.isNotNull(), F.coalesce(t.result, F.lit(False)).cast("string"))))
        code = F.when(q.qtype == "choice", 0).when(q.qtype == "score", 1).otherwise(2)
        return F.struct(place.alias("place"), q.qid.alias("qid"), q.kind.alias("kind"), code.alias("qtype"), L.label_index(q.kind, value).alias("label"))

    return F.filter(F.transform(questions, one), lambda x: x.label.isNotNull())


#: Why a question of an article gives no sequence.
HEAD_TOO_LONG, NO_ROOM = "question and options exceed the head budget", "no room for the state beside the head"
HEADS = "array<struct<head: array<bigint>, markers: array<bigint>>>"
#: Texts that the tokenizer step encodes before it hands their ids on.
BATCH_ROWS = 256


def with_heads(sets: DataFrame, factory) -> DataFrame:
    """(config_id, questions, heads): ids of each question's text and the places of its options in them, at its place.

    Of the questions only what names them stays: their texts are encoded here, once for each configuration."""
    named = F.transform("questions", lambda q: F.struct(*[q[c].alias(c) for c in ("qid", "subject_id", "tag_id", "kind", "qtype")]))
    texts = F.transform("questions", lambda q: F.struct(*[q[c].alias(c) for c in ("instructions", "criteria_labels", "criteria_texts")]))

    @F.arrow_udf(HEADS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode, ids = factory(), pa.list_(pa.int64())
        kind = pa.list_(pa.struct([("head", ids), ("markers", ids)]))

        def head_of(q) -> dict:
            head, marks = encode(q["instructions"]), []
            for label, text in zip(q["criteria_labels"], q["criteria_texts"]):
                marks.append(len(head))
                head = [*head, 1, *encode(f"{label}: {text}")]
            return {"head": head, "markers": marks}

        for batch in batches:
            for at in range(0, len(batch), BATCH_ROWS):
                yield pa.array([[head_of(q) for q in asked.as_py() or ()] for asked in batch.slice(at, BATCH_ROWS)], kind)

    rows = once(sets, _named=named, _texts=texts)
    return rows.select(F.col("config_id"), F.col("_named").alias("questions"), run.asNondeterministic()("_texts").alias("heads"))


def token_ids(text: Column, factory) -> Column:
    """Ids of a text; a missing one has none.  Only the text goes to the tokenizer, and only its ids come back."""
    @F.arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        encode = factory()
        for batch in batches:
            for at in range(0, len(batch), BATCH_ROWS):
                ids = [np.asarray(encode(t.as_py() or ""), np.int64) for t in batch.slice(at, BATCH_ROWS)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))

    return run.asNondeterministic()(text)


def encode_windows(articles: DataFrame, sets: DataFrame, factory, max_len: int = V.MAX_LEN, head_len: int = V.HEAD_MAX_LEN, overlap: int = V.WINDOW_OVERLAP) -> DataFrame:
    """Training sequences of whole states: a row per (article, labelled question, window), or one with a reason.

    articles(correlation_id, config_id, state, subject_results, base_tags); sets(config_id, questions).  The question's
    head (instructions, then a marker and the text of each option) stands in front of every window of the state.  Windows
    hold what max_len leaves beside the head and share `overlap` tokens with the next one (all but one, if there is less
    room), so every token of a state lies in some window; a state without tokens has one window.  markers are the places
    of the options in ids, state_start is the window's first token in the state.  A question whose head takes more than
    head_len tokens, or leaves no room, gives one row with its reason and no ids.

    The tokenizer gets the questions of a configuration once and each state once; heads and states meet as ids, and a
    window is cut from them when its row is made, so neither a long state nor many questions are held at once.
    """
    j = join_by_size(articles, with_heads(sets.select("config_id", "questions"), factory), ["config_id"])
    j = once(j, labelled=labelled_questions(F.col("subject_results"), F.col("base_tags"), F.col("questions")))
    j = j.select(F.col("correlation_id").cast("string"), F.col("config_id").cast("string"), "state", "labelled", "heads").filter(F.size("labelled") > 0)
    j = j.withColumn("body", token_ids(F.col("state"), factory)).drop("state")
    j = j.select("correlation_id", "config_id", "heads", "body", F.inline("labelled"))
    head = F.get("heads", F.col("place"))
    j = j.select("correlation_id", "config_id", "qid", "kind", "qtype", "label", "body", F.size("body").cast("bigint").alias("state_tokens"),
                 head.head.alias("head"), head.markers.alias("markers"), F.size(head.head).cast("bigint").alias("head_tokens"))
    room = F.lit(max_len) - F.col("head_tokens")
    j = j.withColumn("reason", F.when(F.col("head_tokens") > head_len, HEAD_TOO_LONG).when(room < 1, NO_ROOM))
    step = F.greatest(F.lit(1).cast("bigint"), room - overlap)
    more = F.greatest(F.lit(0), F.ceil((F.col("state_tokens") - room) / step))
    j = j.withColumn("windows", F.when(F.col("reason").isNull(), 1 + more).otherwise(0).cast("int"))
    j = j.withColumn("window", F.explode_outer(F.when(F.col("windows") > 0, F.sequence(F.lit(0), F.col("windows") - 1))))
    start = F.col("window") * step
    ids = F.when(F.col("reason").isNull(), F.concat("head", F.slice("body", (start + 1).cast("int"), room.cast("int"))))
    return j.select("correlation_id", "config_id", "qid", "kind", "qtype", "label", "window", "windows", start.alias("state_start"), "state_tokens", "head_tokens",
                    ids.alias("ids"), F.when(F.col("reason").isNull(), F.col("markers")).alias("markers"), "reason")


def sequences(windows: DataFrame) -> DataFrame:
    """The windows that became sequences, with their one-hot targets."""
    rows = windows.filter(F.col("reason").isNull()).drop("reason")
    return rows.withColumn("target", L.one_hot(F.col("label"), L.kind_width(F.col("kind"))))


def quarantined(windows: DataFrame) -> DataFrame:
    """Questions of an article that gave no sequence, with the reason."""
    return windows.filter(F.col("reason").isNotNull()).select("correlation_id", "config_id", "qid", "kind", "label", "head_tokens", "state_tokens", "reason")


def tokenize_sequences(articles: DataFrame, sets: DataFrame, factory, max_len: int = V.MAX_LEN, head_len: int = V.HEAD_MAX_LEN, overlap: int = V.WINDOW_OVERLAP) -> DataFrame:
    return sequences(encode_windows(articles, sets, factory, max_len, head_len, overlap))


def label_distribution(seqs: DataFrame, keys=("kind", "label")) -> DataFrame:
    return seqs.groupBy(*keys).agg(F.count("*").alias("n"))


def kind_coverage(seqs: DataFrame) -> DataFrame:
    """Required kinds without a single row."""
    need = seqs.sparkSession.createDataFrame([(k,) for k in V.DECISION_KINDS], "kind STRING")
    return need.join(seqs.select("kind").distinct(), "kind", "left_anti")


def split_leakage(split_rows: DataFrame) -> DataFrame:
    """Articles on both sides of a split, with the rows they have on each."""
    g = split_rows.groupBy("correlation_id").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"))
    return g.filter((F.col("n_train") > 0) & (F.col("n_val") > 0))


def label_coverage(split_rows: DataFrame) -> DataFrame:
    """(split, kind, label) combinations that should exist but have no row."""
    spark = split_rows.sparkSession
    need = spark.createDataFrame([(s, k, i) for s in ("train", "val") for k in V.DECISION_KINDS for i in range(V.KIND_WIDTH[k])], "split STRING, kind STRING, label INT")
    have = split_rows.groupBy("split", "kind", "label").agg(F.count("*").alias("n"))
    return need.join(have, ["split", "kind", "label"], "left_anti")


def class_weights(seqs: DataFrame, kind: str = "sentiment", power: float = 0.5) -> DataFrame:
    """Inverse-frequency weights whose average over rows is one; labels without rows show weight null."""
    if not 0.0 <= power <= 1.0:
        raise ValueError("power must be between 0 and 1")
    every = seqs.sparkSession.range(V.KIND_WIDTH[kind]).select(F.col("id").cast("int").alias("label"))
    n = seqs.filter(F.col("kind") == kind).groupBy("label").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))
    raw = every.join(n, "label", "left").withColumn("raw", F.pow(F.max("n").over(w) / F.col("n"), F.lit(power)))
    norm = F.sum(F.col("n") * F.col("raw")).over(w) / F.sum("n").over(w)
    return raw.select("label", F.coalesce("n", F.lit(0)).alias("n"), (F.col("raw") / norm).alias("weight"))


def missing_labels(weights: DataFrame) -> DataFrame:
    return weights.filter(F.col("n") == 0).select("label")


def sample_weight(kind: Column, label: Column, class_weight: Column) -> Column:
    """Positive yes/no answers weigh more, sentiment rows carry their class weight, others one."""
    noul = kind.isin("validation", "tag")
    return F.when(noul & (label == 1), V.NOUL_POSITIVE_WEIGHT).otherwise(1.0) * F.when(kind == "sentiment", class_weight).otherwise(1.0)


def sample_weights(seqs: DataFrame, weights: DataFrame) -> DataFrame:
    w = weights.select("label", "weight")
    s = seqs.join(F.broadcast(w), "label", "left")  # four rows at most, by vocabulary
    return s.withColumn("sample_weight", sample_weight(F.col("kind"), F.col("label"), F.col("weight"))).drop("weight")


def dataset_stats(split_rows: DataFrame) -> DataFrame:
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in V.DECISION_KINDS]
    return split_rows.agg(F.count("*").alias("total"), F.count_if(F.col("split") == "train").alias("train"),
                          F.count_if(F.col("split") == "val").alias("val"), *kinds)


def write_sequences(split_rows: DataFrame, path: str) -> None:
    """Gold table, one folder per split, so a reader of one side touches nothing of the other."""
    split_rows.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("split") == split)


def best_epoch(epochs: DataFrame, keys=()) -> DataFrame:
    """First epoch with the lowest validation loss."""
    return epochs.groupBy(*keys).agg(F.min_by("epoch", F.struct("loss", "epoch")).alias("best_epoch"), F.min("loss").alias("best_loss"))


def latest_version(versions: DataFrame, keys=()) -> DataFrame:
    """Highest numeric version; names that are no number never win."""
    n = F.col("version").try_cast("bigint")
    return versions.filter(n.isNotNull()).groupBy(*keys).agg(F.max_by("version", n).alias("version"))
