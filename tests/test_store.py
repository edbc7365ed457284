"""The keyed store: attempts, deletion, and look-ups that read only what they need."""

import os

from pyspark.sql import functions as F

from assayer.operators import policy as P, runs as R
from assayer.operators.store import Store

SCHEMA = "run_id STRING, n LONG, status STRING, more ARRAY<STRING>"


def rows(spark, *items):
    return spark.createDataFrame([(r, n, s, [s]) for r, n, s in items], SCHEMA)


def content(store):
    return sorted((r.run_id, r.n, r.status) for r in store.read().collect())


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_a_second_attempt_leaves_one_of_each(spark, tmp_path):
    path = str(tmp_path / "s")
    first = rows(spark, ("2024", 1, "ok"), ("2024", 2, "ok"), ("a/b = ' c", 1, "ok"), ("1e5", 1, "ok"), (None, 1, "ok"))
    store = R.write_records(first, path, ["n"])
    assert store.read().count() == 5
    store.put(first)
    assert store.read().count() == 5 and store.read().schema.fieldNames() == first.columns
    store.put(rows(spark, ("2024", 2, "retried"), ("2024", 3, "new"), ("2024", 3, "new")))
    store.stage(rows(spark, ("2024", 1, "never committed"), ("other", 1, "never committed")))
    again = R.record_store(spark, path, first.schema, ["n"])
    want = [("1e5", 1, "ok"), ("2024", 1, "ok"), ("2024", 2, "retried"), ("2024", 3, "new"), ("a/b = ' c", 1, "ok")]
    assert sorted((r.run_id, r.n, r.status) for r in again.read().filter("run_id is not null").collect()) == want
    again.compact()
    assert sorted((r.run_id, r.n, r.status) for r in again.read().filter("run_id is not null").collect()) == want and len({s for _, _, s in again.live()}) == 1
    again.put(rows(spark, ("2024", 9, "only")), replaces=True)
    part = again.read().filter("n = 9").select(again.part_of(F.col("run_id"))).first()[0]
    assert [r.n for r in again.read([part]).collect()] == [9] and again.read().count() == 4


def test_an_empty_store_and_an_empty_write(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SCHEMA, ["n"], ["run_id"])
    assert store.read().count() == 0 and store.live() == []
    store.put(spark.createDataFrame([], SCHEMA))
    assert store.read().count() == 0
    store.drop([])
    store.compact()


def test_pruning_deletes_folders_and_touches_no_other(spark, tmp_path):
    path = str(tmp_path / "s")
    store = R.write_records(rows(spark, *[(f"r{i}", n, "ok") for i in range(6) for n in range(3)]), path, ["n"])
    store.put(rows(spark, ("r1", 0, "again"), ("r4", 0, "again")))
    before = files(path + "/data")
    runs = lambda *names: spark.createDataFrame([(n,) for n in names], "run_id STRING")
    R.prune_runs(store, runs("r1", "r2", "r3", "none"), runs("r3"))
    after = files(path + "/data")
    assert {r for r, _, _ in content(store)} == {"r0", "r3", "r4", "r5"}
    gone = {spark.createDataFrame([(r,)], "r STRING").select(store.part_of(F.col("r"))).first()[0] for r in ("r1", "r2")}
    assert not any(f"part={p}" in d for p in gone for d, _, _ in os.walk(path))
    assert after == {f: t for f, t in before.items() if not any(f"part={p}" in f for p in gone)}
    store.put(rows(spark, ("r1", 7, "new run of an old name")))
    assert [x for x in content(store) if x[0] == "r1"] == [("r1", 7, "new run of an old name")]


def questions(spark, *texts):
    return spark.createDataFrame([(f"k{i}", f"subj_{i}_valid", 0, 0, "noul", t, ["yes", "no"], ["y", "n"], 1) for i, t in enumerate(texts)],
                                 "config_id STRING, qid STRING, pos INT, slot INT, qtype STRING, instructions STRING, criteria_labels ARRAY<STRING>, criteria_texts ARRAY<STRING>, place INT")


def test_artifacts_are_written_once_and_found_by_content(spark, tmp_path):
    n = 40
    src = questions(spark, *[f"a rather long question number {i}" for i in range(n)])
    short = src.withColumn("instructions", F.concat(F.lit("q "), "config_id"))
    checked = src.select("config_id").withColumn("accepted", F.col("config_id") != "k3").withColumn("chars_before", F.lit(90).cast("long")).withColumn("chars_after", F.lit(50).cast("long"))
    none = spark.createDataFrame([], "config_id STRING, qid STRING")
    store = P.artifact_store(spark, str(tmp_path / "a"))
    assert P.store_artifacts(store, src, short, checked, "v1") == n - 1
    written = files(tmp_path / "a")
    assert P.store_artifacts(store, src, short, checked, "v1") == 0 and files(tmp_path / "a") == written
    used = {r.config_id: r for r in P.artifact_reuse(src, store, checked, none, "v1").collect()}
    assert sum(r.reused for r in used.values()) == n - 1 and used["k7"].instructions == "q k7" and used["k3"].instructions.startswith("a rather")
    changed = src.withColumn("instructions", F.when(F.col("config_id") == "k7", "another text").otherwise(F.col("instructions")))
    assert {r.config_id for r in P.artifact_reuse(changed, store, checked, none, "v1").collect() if not r.reused} == {"k3", "k7"}
    assert not any(r.reused for r in P.artifact_reuse(src, store, checked, none, "v2").collect())  # another identity is another key
    assert P.store_artifacts(store, changed, short, checked, "v1") == 1  # the changed one only
    one = src.filter("config_id = 'k9'")
    parts = P.parts_of(store, P.cache_key(one, "v1"))
    plan = store.read(parts)._jdf.queryExecution().executedPlan().toString()
    assert len(parts) == 1 and f"PartitionFilters: [isnotnull(part" in plan and f"= {parts[0]})" in plan.split("PartitionFilters")[1]


def test_files_of_a_write_grow_with_parts_not_with_tasks(spark, tmp_path):
    df = spark.range(4000).selectExpr("cast(id % 16 as string) as r", "id as n", "repeat('x', 9) as t").repartition(8)
    store = Store(spark, str(tmp_path / "s"), "r string, n long, t string", ["n"], ["r"])
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many tasks as a large table has
    try:
        store.put(df)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    names = [f for _, _, fs in os.walk(tmp_path / "s" / "data") for f in fs if f.endswith(".parquet")]
    assert store.read().count() == 4000 and len(names) == 16
