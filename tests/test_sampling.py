"""Samplers: same rows on any partitioning, exact quotas, no leakage."""

import hashlib

import pytest
from pyspark.sql import functions as F

from assayer.operators import joins as J, sampling as S, training as T

KEY = ["correlation_id", "qid"]


def rows(spark, parts):
    """Skewed labels: 1000 / 100 / 10 / 1."""
    data = [("sentiment", lab, f"c{i % 97}", f"q{lab}_{i}") for lab, n in enumerate((1000, 100, 10, 1)) for i in range(n)]
    data += [("tag", int(i % 12 == 0), f"c{i % 50}", f"t{i}") for i in range(600)]
    return spark.createDataFrame(data, "kind STRING, label INT, correlation_id STRING, qid STRING").repartition(parts)


SAMPLERS = {
    "sample_n": lambda d: S.sample_n(d, KEY, 137),
    "cap": lambda d: S.cap_per_label(d, KEY, 50),
    "shared": lambda d: S.cap_per_label_shared(d, KEY, 80),
    "negatives": lambda d: S.downsample_negatives(d.filter("kind = 'tag'"), KEY),
    "balanced": lambda d: S.balanced_set(d, KEY, cap=60),
    "eval": lambda d: S.stratified_eval_sample(d, KEY, 160),
    "shards": lambda d: S.equal_shards(d, KEY, 7),
    "row_split": lambda d: S.row_split(d, KEY),
}


@pytest.mark.parametrize("name", SAMPLERS)
def test_partitioning_does_not_matter(spark, name):
    got = [sorted(map(tuple, SAMPLERS[name](rows(spark, p)).collect())) for p in (1, 3, 8)]
    assert got[0] == got[1] == got[2] and got[0]


def test_rank_is_exact(spark):
    ranked = {(r.correlation_id, r.qid): r["rank"] for r in S.hash_rank(rows(spark, 5), ["kind"], KEY, 9).collect()}
    by_kind = {}
    for r in rows(spark, 1).collect():
        by_kind.setdefault(r.kind, []).append((hashlib.md5(f"9|{r.correlation_id}|{r.qid}".encode()).hexdigest(), r.correlation_id, r.qid))
    for items in by_kind.values():
        for i, (_, c, q) in enumerate(sorted(items), 1):
            assert ranked[(c, q)] == i


def test_quotas(spark):
    d = rows(spark, 4)
    n = {(r.kind, r.label): r.n for r in T.label_distribution(S.balanced_set(d, KEY, cap=60)).collect()}
    assert n[("sentiment", 0)] == 60 and n[("sentiment", 1)] == 60 and n[("sentiment", 3)] == 1
    assert n[("tag", 1)] == 50 and n[("tag", 0)] == int(50 * 0.6 / 0.4)


def test_eval_sample_tops_up_from_the_largest_pools(spark):
    n = {(r.kind, r.label): r.n for r in T.label_distribution(S.stratified_eval_sample(rows(spark, 4), KEY, 160)).collect()}
    assert sum(v for (k, _), v in n.items() if k == "sentiment") == 40 and sum(v for (k, _), v in n.items() if k == "tag") == 40
    assert n[("sentiment", 2)] == 10 and n[("sentiment", 3)] == 1 and n[("sentiment", 1)] == 10 and n[("sentiment", 0)] == 19


def test_shards_are_equal(spark):
    sizes = [r.n for r in S.equal_shards(rows(spark, 4), KEY, 7).groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 7 and sum(sizes) == 1711 and max(sizes) - min(sizes) <= 1
    sizes = [r.n for r in S.equal_shards(rows(spark, 4), KEY, 7, drop_remainder=True).groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 7 and set(sizes) == {1711 // 7}


def test_group_split_never_leaks_and_row_split_does(spark):
    d = rows(spark, 4)
    assert T.split_leakage(S.group_split(d)).count() == 0
    assert T.split_leakage(S.row_split(d, KEY)).count() > 0


def test_weights_average_to_one(spark):
    w = T.class_weights(rows(spark, 2), power=0.5).collect()
    assert sum(r.n * r.weight for r in w) / sum(r.n for r in w) == pytest.approx(1.0)
    assert [r.weight for r in sorted(w, key=lambda r: r.label)] == sorted(r.weight for r in w)
    with pytest.raises(ValueError):
        T.class_weights(rows(spark, 1), power=2.0)


def test_missing_label_is_reported(spark):
    w = T.class_weights(rows(spark, 1).filter("label <> 2"))
    assert [r.label for r in T.missing_labels(w).collect()] == [2]


def test_salted_join_equals_plain_join(spark):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(0, "a"), (0, "b"), (2, "c"), (5, "d")], "k LONG, n STRING")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(repr, big.join(small, "k", how).collect()))
        for joined in (J.salted_join(big, small, ["k"], how, 4), J.join_by_size(big, small, ["k"], how, max_bytes=10), J.join_by_size(big, small, ["k"], how)):
            assert sorted(map(repr, joined.collect())) == a


def test_salt_spreads_one_hot_key(spark):
    big = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    salts = big.select(F.pmod(F.xxhash64("k", "v"), F.lit(8)).alias("s")).groupBy("s").count().collect()
    assert len(salts) == 8 and max(r["count"] for r in salts) < 700


def test_latest_version_ignores_names(spark):
    df = spark.createDataFrame([("m", "9"), ("m", "10"), ("m", "draft")], "model STRING, version STRING")
    assert T.latest_version(df, ["model"]).first().version == "10"


def test_first_lowest_epoch(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.3), (3, 0.3)], "epoch INT, loss DOUBLE")
    assert T.best_epoch(df).first().best_epoch == 2


def test_ranks_by_radix_refinement(spark):
    """A million keys, a bound of a thousand: no two ranks alike, most of them in small cells, the same ranks at any bound."""
    rows = spark.range(1_000_000).withColumn("g", F.when(F.col("id") % 1000 == 0, None).when(F.col("id") % 10 == 1, "small").otherwise("large"))
    h = rows.withColumn("_h", S.hash_key(5, "id"))
    levels = S.cells(h, ["g"], lambda t: t, 100)
    assert len(levels) == 2 and [d for d, _ in levels] == [3, 6]
    assert max(t.agg(F.max("_n")).first()[0] for _, t in levels) <= 100 and sum(t.agg(F.sum("_n")).first()[0] for _, t in levels) == 1_000_000
    ranked = S.hash_rank(rows, ["g"], ["id"], 5, bound=100)
    g = {r.g: r for r in ranked.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.max("group_rows").alias("all")).collect()}
    assert {k: (r.n, r.d, r.lo, r.hi, r["all"]) for k, r in g.items()} == {k: (n, n, 1, n, n) for k, n in ((None, 1000), ("small", 100_000), ("large", 899_000))}
    few = rows.filter("id < 20000")
    one, other = ({(r.id, r.rank) for r in S.hash_rank(few, [], ["id"], 5, bound=b).collect()} for b in (3, 10**9))
    assert one == other and len(one) == 20_000


def test_a_quota_refines_only_what_it_needs(spark):
    rows = spark.range(50_000)
    want = {r.id for r in S.hash_rank(rows, [], ["id"], 9).filter("rank <= 7").collect()}
    got = S.hash_rank(rows, [], ["id"], 9, n=7, bound=2)
    assert {r.id for r in got.collect()} == want and len(want) == 7
    levels = S.cells(rows.withColumn("_h", S.hash_key(9, "id")), [], lambda t: t.filter("_before < 7"), 2)
    assert sum(t.count() for _, t in levels) < 40


def test_positions_are_dense_on_any_number_of_partitions(spark):
    from assayer.operators.ranking import numbered
    rows = spark.range(5000).select((F.col("id") % 50).alias("rank_in_config"), F.floor(F.col("id") / 50).alias("config_pos"), F.lit("x").alias("row"))
    want = [(k % 100, k // 100) for k in range(5000)]
    for n in (3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = numbered(rows.repartition(n), [F.col("rank_in_config"), F.col("config_pos")]).collect()
        assert [(r.config_pos, r.rank_in_config) for r in sorted(got, key=lambda r: r.position)] == want and {r.position for r in got} == set(range(1, 5001))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert numbered(rows.limit(0), [F.col("config_pos")]).count() == 0
