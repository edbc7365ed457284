"""Vector near duplicates and nearest neighbours against all pairs."""

import itertools

import numpy as np
import pytest

from assayer.llm import forest, hnsw
from assayer.llm.shared import table

ODD = [(9001, None), (9002, []), (9003, [0.0] * 8), (9004, [float("nan")] + [1.0] * 7), (9005, [float("inf")] + [1.0] * 7), (9006, [None] + [1.0] * 7), (9007, [1.0, 2.0])]


def cloud(seed=0, n=700, dim=8, ball=120):
    """Random vectors, pairs that lie near each other, exact copies, a ball of near copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[1:200:2] = x[0:200:2] + rng.normal(size=(100, dim)) * 0.2
    x[200:240] = x[200]
    x[n - ball:] = x[n // 2] + rng.normal(size=(ball, dim)) * 0.05
    return x


def frame(spark, x, label=lambda i: i % 2):
    rows = [(i, [float(v) for v in r], label(i)) for i, r in enumerate(x)] + [(i, v, 0) for i, v in ODD] + [(9100, [1.0] * 8, None), (None, [1.0] * 8, 0)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, leaf string")


def all_links(ids, x, labels, least):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    cos = u @ u.T
    return {(ids[i], ids[j]) for i, j in itertools.combinations(range(len(ids)), 2) if labels[i] == labels[j] and cos[i, j] >= least}


def check_links(rows, links, ids):
    count, root = dict.fromkeys(ids, 0), {i: i for i in ids}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        count[a] += 1
        count[b] += 1
        x, y = sorted((find(a), find(b)))
        root[y] = x
    for r in rows:
        assert (r.n_links, r.component_id) == (count.get(r.vec_id, 0), find(r.vec_id) if r.vec_id in root else r.vec_id), r
        assert r.kept == (r.component_id == r.vec_id)


@pytest.mark.parametrize("leaf_rows", [1000, 64])
def test_links_are_all_found(spark, leaf_rows):
    x = cloud()
    rows = forest.near_duplicate_vectors(frame(spark, x), leaf_rows=leaf_rows, margin=0.05, trees=12).collect()
    assert len(rows) == len(x) + len(ODD) + 2
    ids = list(range(len(x)))
    check_links(rows, all_links(ids, x, [i % 2 for i in ids], 0.93), ids)


def groups(n, count, cosine, dim=64):
    """n unit vectors in groups of this mutual cosine."""
    rng = np.random.default_rng(n + count)
    centers = rng.normal(size=(count, dim))
    x = np.sqrt(cosine) * (centers / np.linalg.norm(centers, axis=1)[:, None])[np.arange(n) % count]
    x += np.sqrt((1 - cosine) / dim) * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_links_in_large_labels_with_production_constants(spark):
    labels = [groups(2500, 1, 0.95), groups(3000, 5, 0.94)]
    rows = [(label * 10000 + i, v.tolist(), label) for label, x in enumerate(labels) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in forest.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    for label, (x, count) in enumerate(zip(labels, (1, 5))):
        want = (x @ x.T >= 0.93).sum(1) - 1
        have = np.array([got[label * 10000 + i].n_links for i in range(len(x))])
        assert have.sum() >= 0.9999 * want.sum() and (have <= want + 1).all()
        assert all(got[label * 10000 + i].component_id == label * 10000 + i % count for i in range(len(x)) if want[i])


def test_given_vectors(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    got = df.collect()
    ids = [r.vec_id for r in got]
    links = all_links(ids, np.array([r.embedding for r in got], float), [r.label for r in got], 0.93)
    check_links(forest.near_duplicate_vectors(df).collect(), links, ids)
    assert forest.near_duplicate_vectors(df.limit(0)).count() == 0


def test_trees_divide_small_labels_too(spark):
    """The given labels have some fifty vectors each: they are cut by trees, not compared as a whole."""
    assert [forest.leaf_size(n) for n in (0, 50, 218, 3000, 10**6)] == [16, 16, 27, 375, 512]
    df = table(spark, "/root/testdata/sf0.01", "embeddings").selectExpr("vec_id as id", "cast(label as bigint) as grp", "cast(embedding as array<double>) as vec")
    most = max(r["count"] for r in df.groupBy("grp").count().collect())
    placed = forest.leaves(df, None, forest.leaf_size(most), None, 17, 0.93, most)
    assert most > forest.leaf_size(most) and placed.select("leaf").distinct().count() > 2 * df.select("grp").distinct().count()


def test_repeated_rows_link_as_copies(spark):
    df = frame(spark, cloud(n=300, ball=20)).where("vec_id < 300")
    one = {r.vec_id: r for r in forest.near_duplicate_vectors(df).collect()}
    two = forest.near_duplicate_vectors(df.unionAll(df)).collect()
    assert len(two) == 600 and all(r.n_links == 2 * one[r.vec_id].n_links + 1 and r.component_id == one[r.vec_id].component_id for r in two)


def exact(q, qid, ids, x, k):
    far = np.sqrt(((x - q) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, far)) if ids[i] != qid][:k]
    return [(ids[i], far[i]) for i in order]


@pytest.mark.parametrize("shard_rows", [5000, 150])
def test_nearest_of_all(spark, shard_rows):
    x = cloud(3)
    df = frame(spark, x)
    rows = hnsw.nearest(df, df.where("vec_id % 10 = 0 or vec_id > 9000"), shard_rows=shard_rows).collect()
    ids = np.r_[np.arange(len(x)), 9100]
    pool = np.r_[x, np.ones((1, 8))]
    hit = total = 0
    for qid in [*range(0, 700, 10), 9100]:
        got = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == qid)
        want = exact(pool[list(ids).index(qid)], qid, ids, pool, 10)
        assert [r for r, _, _ in got] == list(range(1, 11))
        assert [(s, v) for _, v, s in got] == sorted((s, v) for _, v, s in got)
        assert all(abs(s - np.sqrt(((pool[list(ids).index(v)] - pool[list(ids).index(qid)]) ** 2).sum())) < 1e-12 for _, v, s in got)
        hit += len({v for _, v, _ in got} & {v for v, _ in want})
        total += 10
    assert hit >= 0.95 * total
    assert {r.query_id for r in rows} == {*range(0, 700, 10), 9100}


def test_nearest_recall_on_given_vectors(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    got = df.collect()
    ids, x = np.array([r.vec_id for r in got]), np.array([r.embedding for r in got], float)
    rows = hnsw.nearest(df, df.where("vec_id % 20 = 0"), shard_rows=200).collect()
    hit = 0
    queries = [i for i in ids if i % 20 == 0]
    for qid in queries:
        hit += len({r.vec_id for r in rows if r.query_id == qid} & {v for v, _ in exact(x[list(ids).index(qid)], qid, ids, x, 10)})
    assert len(rows) == 10 * len(queries) and hit >= 0.95 * len(rows)


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (100, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in hnsw.nearest(df, df.where("vec_id % 100 = 0")).collect())
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 100), (100, 1, 0), (100, 2, 1)]
    assert got[0][3] == 0 and got[1][3] == 5 ** 0.5
    assert hnsw.nearest(df.limit(0), df.limit(0)).count() == 0
    assert hnsw.nearest(df, df.limit(0)).count() == 0


def recall(spark, x, shard_rows, every):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in hnsw.nearest(df, df.where(f"vec_id % {every} = 0"), shard_rows=shard_rows).collect():
        got.setdefault(r.query_id, []).append(r.score)
    hit = 0
    for qid, scores in got.items():
        far = np.sort(np.sqrt(((np.delete(x, qid, 0) - x[qid]) ** 2).sum(1)))[:10]
        hit += (np.sort(scores) <= far[-1] * (1 + 1e-9)).sum()
    assert len(got) == -(-len(x) // every)
    return hit / (10 * len(got))


def test_recall_away_from_the_origin_and_among_near_copies(spark):
    """Production constants, several shards of 3,000: a tight cluster of norm 160, and thousands of near copies beside others."""
    rng = np.random.default_rng(6)
    far = rng.normal(size=(1, 64))
    far = far / np.linalg.norm(far) * 160 + rng.normal(size=(6000, 64)) * 0.01
    assert recall(spark, far, 3000, 40) >= 0.95
    mixed = np.concatenate([rng.normal(size=(3000, 64)) + 5, rng.normal(size=(1, 64)) + rng.normal(size=(4000, 64)) * 1e-3])
    assert recall(spark, mixed, 3000, 40) >= 0.95


def test_recall_in_a_large_shard(spark):
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(300, 32)) * 3)[np.arange(30_000) % 300] + rng.normal(size=(30_000, 32)) * 0.3 + 40
    assert recall(spark, x, 30_000, 300) >= 0.95


def test_shards_grow_with_the_table():
    rows = lambda n: min(hnsw.SHARD_ROWS_AT_MOST, max(hnsw.SHARD_ROWS, int((hnsw.SHARD_ROWS * n) ** 0.5)))
    assert [-(-n // rows(n)) for n in (10, 3000, 12_000, 10**6, 10**9)] == [1, 1, 2, 19, 5000]
