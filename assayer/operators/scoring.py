"""The scorer contract: the only place where rows leave the JVM.

A scorer is injected as a factory and called once per Python worker.  Only the article key, the state and the
questions of the pass travel to Python, in Arrow batches; every other column stays in the JVM.
"""

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from assayer.operators.joins import once, rows_of

# this module travels to the workers by value, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ANSWERS = T.ArrayType(T.StructType([
    T.StructField("qid", T.StringType()), T.StructField("type", T.StringType()), T.StructField("noul", T.DoubleType()),
    T.StructField("choice", T.StringType()), T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("confidence", T.DoubleType())]))


#: Articles handed to a model at once.  An Arrow batch may hold 10,000 of them, whose questions as Python objects take gigabytes.
BATCH_ROWS = 256
#: Distinct lists of questions that a worker keeps as Python objects.
KEPT_LISTS = 2_000

REPLY = T.StructType([T.StructField("answers", ANSWERS), T.StructField("tokens", T.LongType()), T.StructField("ms", T.DoubleType())])


def score(requests: DataFrame, factory, questions: str, out: str, mask: str | None = None) -> DataFrame:
    """Add `out` (answers), `<out>_tokens` and `<out>_ms`; an article without questions is not sent to the model.

    With `mask` (a column of booleans, one for each question) only the questions it marks are asked, and `out` has one
    place for each question, null where none was asked, so an answer is found by its question's place.

    The model gets at most BATCH_ROWS articles at a time.  Articles that are asked the same share one list of questions,
    which it must not change: a list becomes Python objects once and is then found by comparing it where Arrow holds it.
    """
    key = f"{getattr(factory, '__module__', '')}.{getattr(factory, '__qualname__', repr(factory))}"

    @F.arrow_udf(REPLY)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import types
        from pyspark.sql.pandas.types import to_arrow_type

        cache = sys.modules.setdefault("_assayer_models", types.ModuleType("_assayer_models")).__dict__
        if key not in cache:
            cache[key] = factory()
        model, reply_type = cache[key], to_arrow_type(REPLY)
        lists: dict[tuple, tuple[pa.Array, list]] = {}

        def questions_of(config, asks: pa.Array, i: int, mask: list | None) -> list | None:
            if not asks[i].is_valid:
                return None
            given, at = asks[i].values, (config, None if mask is None else tuple(mask))
            if at not in lists or not given.equals(lists[at][0]):
                if len(lists) >= KEPT_LISTS:
                    lists.clear()
                # a copy: a slice would hold on to its whole batch
                lists[at] = pa.concat_arrays([given, given[:0]]), given.to_pylist()
            return lists[at][1]

        for columns in batches:
            for at in range(0, len(columns[0]), BATCH_ROWS):
                configs, ids, states, asks, masks = (c.slice(at, BATCH_ROWS) for c in columns)
                configs, ids, states, masks = (x.to_pylist() for x in (configs, ids, states, masks))
                asked = [questions_of(c, asks, i, m) for i, (c, m) in enumerate(zip(configs, masks))]
                todo = [i for i, a in enumerate(asked) if a]
                rows = [{"answers": [None] * len(m or []), "tokens": 0, "ms": 0.0} for m in masks]
                for i, (a, t, m) in zip(todo, model([ids[i] for i in todo], [states[i] for i in todo], [asked[i] for i in todo])):
                    if masks[i] is not None:
                        given = iter(a)
                        a = [next(given) if wanted else None for wanted in masks[i]]
                    rows[i] = {"answers": a, "tokens": t, "ms": m}
                yield pa.array(rows, reply_type)

    # The argument comes out of a generator, as lambdas inside a Python call are not planned; and a model call is
    # never repeated or moved, so filters on its answers stay above it.
    asked = F.col(questions) if mask is None else F.filter(questions, lambda _, i: F.get(F.col(mask), i))
    marks = F.lit(None).cast("array<boolean>") if mask is None else F.col(mask)
    config = F.col("config_id").cast("string") if "config_id" in requests.columns else F.lit(None).cast("string")  # where to look for a list first
    r = once(requests, _ask=asked, _mask=marks).withColumn("_reply", run.asNondeterministic()(config, "correlation_id", "state", "_ask", "_mask"))
    return r.select(*requests.columns, F.col("_reply.answers").alias(out), F.col("_reply.tokens").alias(f"{out}_tokens"), F.col("_reply.ms").alias(f"{out}_ms"))


def hash_scorer():
    """Deterministic stand-in for a model: probabilities are buckets of md5(question | label | article | md5 of the state)."""
    from hashlib import md5

    def bucket(*parts):
        return int(md5("|".join(parts).encode()).hexdigest()[:8], 16) % 100

    def answer(of, q):
        if q["qtype"] == "noul":
            return {"qid": q["qid"], "type": "noul", "noul": bucket(q["qid"], *of) / 100.0, "confidence": 1.0}
        w = [bucket(q["qid"], label, *of) + 1 for label in q["criteria_labels"]]
        p = [x / sum(w) for x in w]
        best = p.index(max(p))
        return {"qid": q["qid"], "type": "choice", "choice": q["criteria_labels"][best],
                "probabilities": list(zip(q["criteria_labels"], p)), "confidence": p[best]}

    def predict(ids, states, asks):
        keys = [(c, md5(s.encode()).hexdigest()) for c, s in zip(ids, states)]
        return [([answer(k, q) for q in a], len(s) // 4, len(a) * 2.5) for k, s, a in zip(keys, states, asks)]

    return predict


def answers_rows(scored: DataFrame, col: str) -> DataFrame:
    return rows_of(scored, col, "qid", "correlation_id", "config_id")
