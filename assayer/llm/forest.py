"""Near-duplicate vectors by a random-projection tree forest: split with spill overlap, compare within leaves, verify, union.

Every tree splits all vectors of a label level by level at the median of a random projection; vectors within `margin` of
the cut go to both sides.  Margin and number of trees follow from the cosine, the dimension and the depth.  Levels are Spark aggregates and joins over narrow rows (id, projections).  A leaf compares its
members by a matrix product.  A pair that meets in several leaves counts in the one with the smallest number, so counts
are exact without listing pairs, and each leaf hands on a spanning star of its links for the union.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm.shared import components, in_blocks
from assayer.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a leaf: a share of the largest label, so that trees divide labels of every size, between these bounds.
LEAF_SHARE, LEAF_ROWS_AT_LEAST, LEAF_ROWS = 8, 16, 512
#: A node of which more than this share lies within the margin of its median is a ball of near copies that no cut
#: divides; it becomes one leaf as it is, compared block by block.
TIGHT = 0.4
#: Fewest trees, and the chance that a pair at the cosine meets in no leaf of any tree.
TREES, MISS = 8, 1e-4
#: The gap between the projections of a pair is normal, so with a margin of half its deviation on both sides of a cut it
#: exceeds both by this many deviations on average; a node that is no ball holds at most TIGHT per two margins at its cut.
BEYOND = 2 * (math.exp(-0.5) / math.sqrt(2 * math.pi) - 0.5 * math.erfc(math.sqrt(0.5)))


def margin_of(cosine: float, dim: int) -> float:
    """Half the standard deviation of the gap between the random projections of two unit vectors at this cosine."""
    return max(math.sqrt(max(2 - 2 * cosine, 0) / dim) / 2, 1e-6)


def trees_of(most: int, leaf_rows: int) -> int:
    """Trees after which a pair at the cosine is parted in all of them with a chance of about MISS."""
    kept = (1 - TIGHT * BEYOND) ** math.ceil(math.log2(max(most / leaf_rows, 2)))
    return max(TREES, math.ceil(math.log(MISS) / math.log(1 - kept)))


def usable(vec: Column) -> Column:
    """Neither null nor empty nor zero, all components present and finite."""
    x = vec.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad & F.exists(x, lambda v: v != 0.0), F.lit(False))


def _projector(trees: int, depth: int, seed: int, margin: float | None, cosine: float):
    def project(batches):
        for batch in batches:
            vecs = batch.column(2)
            sizes = np.diff(vecs.offsets.to_numpy())
            at = np.zeros((batch.num_rows, trees, depth), np.float32)
            flat, ends = vecs.values.to_numpy(), vecs.offsets.to_numpy()
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                way = np.random.default_rng([seed, int(dim)]).normal(size=(dim, trees * depth))
                x = flat[ends[own][:, None] + np.arange(dim)]
                unit = margin_of(cosine, int(dim)) if margin is None else margin  # projections are told in margins
                at[own] = (x @ (way / np.sqrt((way * way).sum(0))) / unit).reshape(len(own), trees, depth)
            places = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, depth, dtype=np.int32)), pa.array(at.ravel()))
            take = np.repeat(np.arange(batch.num_rows), trees)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), batch.column(1).take(pa.array(take)),
                                              pa.array(np.tile(np.arange(trees, dtype=np.int32), batch.num_rows)), places], names=["id", "grp", "tree", "at"])

    return project


def leaf_size(most: int) -> int:
    """Rows of a leaf if the largest label has `most`."""
    return max(LEAF_ROWS_AT_LEAST, min(LEAF_ROWS, most // LEAF_SHARE))


def leaves(points: DataFrame, trees: int | None, leaf_rows: int, margin: float | None, seed: int, cosine: float, most: int) -> DataFrame:
    """(id, leaf) for every leaf of every tree that a point lies in.  points: id, grp, vec (unit length); `most` is the
    number of rows of the largest group."""
    if most <= leaf_rows:  # every group is one leaf, so one tree finds all that others would
        return points.select("id", F.xxhash64("grp").alias("leaf"))
    trees = trees_of(most, leaf_rows) if trees is None else trees
    depth = math.ceil(math.log(most / leaf_rows, 1 / (0.5 + TIGHT / 2))) + 2
    now = points.select("id", "grp", "vec").mapInArrow(_projector(trees, depth, seed, margin, cosine), "id long, grp long, tree int, at array<float>")
    # a group that is not split at all is the same leaf in all trees
    now = written(now.select("id", F.xxhash64("grp").alias("leaf"), F.xxhash64("grp", "tree").alias("node"), "at"), "forest-level")
    done = None
    for level in range(depth):
        here = F.col("at")[level]
        # where 40 % of a node lie within the margin of its median it is a ball, which no cut divides
        sizes = now.groupBy("node").agg(F.count("*").alias("n"), F.percentile_approx(here, [0.5 - TIGHT / 2, 0.5, 0.5 + TIGHT / 2], 1000).alias("q"))
        large = sizes.where((F.col("n") > leaf_rows) & (F.col("q")[2] - F.col("q")[0] >= 2)).select("node", F.col("q")[1].alias("cut"))
        split = now.join(large, "node", "left")
        split = split.withColumn("side", F.explode(F.expr(f"""CASE WHEN cut IS NULL THEN array(-1) ELSE
            filter(array(IF(at[{level}] < cut + 1, 0, -2), IF(at[{level}] >= cut - 1, 1, -2)), s -> s >= 0) END""")))
        below = F.xxhash64("node", "side")
        split = written(split.select("id", F.when(F.col("side") < 0, F.col("leaf")).otherwise(below).alias("leaf"), "side", "at"), "forest-level")
        ended = split.where("side < 0").select("id", "leaf")
        done = ended if done is None else done.unionAll(ended)
        now = split.where("side >= 0").select("id", "leaf", F.col("leaf").alias("node"), "at")
        if now.isEmpty():
            return done
    return done.unionAll(now.select("id", "leaf"))


def _stars(linked: np.ndarray) -> np.ndarray:
    """The smallest member reachable within the leaf, for each member."""
    root = np.arange(len(linked))
    while True:
        low = np.minimum(root, np.where(linked, root, len(linked)).min(1, initial=len(linked)))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _comparer(least: float):
    def compare(key, pdf):
        leaf, same = key[0], key[1] == key[2]
        pdf = pdf.sort_values("id", ignore_index=True)
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        x /= np.sqrt((x * x).sum(1))[:, None]
        linked = x @ x.T >= least
        np.fill_diagonal(linked, False)
        side, weight = pdf["side"].to_numpy(), pdf["w"].to_numpy()
        if not same:
            linked &= side[:, None] != side[None, :]
        width = max(map(len, pdf["leaves"]))
        earlier = np.full((len(pdf), width), -1, np.int64)
        missing = np.iinfo(np.int64).max  # never an earlier leaf
        earlier[:] = missing
        for i, own in enumerate(pdf["leaves"]):
            own = np.asarray(own, np.int64)
            own = own[own < leaf]
            earlier[i, :len(own)] = own
        i, j = np.nonzero(np.triu(linked))
        count = np.zeros(len(pdf), np.int64)
        for lo in range(0, len(i), 4096):
            a, b = i[lo:lo + 4096], j[lo:lo + 4096]
            left, right = earlier[a][:, :, None], earlier[b][:, None, :]
            first = ~((left == right) & (left != missing)).any((1, 2))
            np.add.at(count, a[first], weight[b[first]])
            np.add.at(count, b[first], weight[a[first]])
        ids = pdf["id"].to_numpy()
        out = pd.DataFrame({"id": ids, "links": count, "root": ids[_stars(linked)]})
        return out[linked.any(1)]

    return compare


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label",
                           cosine: float = 0.93, trees: int | None = None, leaf_rows: int | None = None, margin: float | None = None, seed: int = 17) -> DataFrame:
    """One row per row of df: (id_col, n_links, component_id, kept).

    Vectors of equal, non-null group and equal length are linked if their cosine, in double precision, is at least
    `cosine`.  n_links counts the other vectors linked directly, component_id is the smallest id reachable, kept says
    whether the id is that.  Equal vectors are one class and count with its size.  Vectors that are null, empty or zero
    or hold null or non-finite components, and rows of null group or null id, link with nothing: n_links 0, component_id
    their id.  Repeated ids with equal vectors count as copies of each other.  Further columns are ignored.

    leaf_rows follows from the largest label if not given.  Vectors of a label that all lie nearer to each other than a
    projection can tell (a common cosine above about 0.87) are one ball, all of whose pairs are compared, block by block.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).alias("grp"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.withColumn("grp", F.when(usable(F.col("vec")) & F.col("id").isNotNull() & F.col("grp").isNotNull(), F.xxhash64("grp", F.size("vec"))))
    rows = rows.withColumn("cls", F.when(F.col("grp").isNotNull(), F.xxhash64("grp", "vec")))
    classes = written(rows.where("grp is not null").groupBy("cls", "grp", "vec").agg(F.min("id").alias("id"), F.count("*").alias("w")), "forest-classes")
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    points = classes.select("id", "grp", F.transform("vec", lambda x: x / length).alias("vec"))
    most = points.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    leaf_rows = leaf_rows or leaf_size(most)
    placed = written(leaves(points, trees, leaf_rows, margin, seed, cosine, most).distinct(), "forest-leaves")
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1")
    own = placed.groupBy("id").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    dealt = in_blocks(placed, ["leaf"], "id", sizes, leaf_rows).join(classes.select("id", "vec", "w").join(own, "id"), "id")
    found = written(dealt.groupBy("leaf", "block_a", "block_b").applyInPandas(_comparer(cosine), "id long, links long, root long"), "forest-links")
    comps = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a <> b"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classed = (classes.select(F.col("cls"), F.col("vec").alias("v"), "id", "w").join(links, "id", "left")
               .join(comps.withColumnRenamed("node", "id"), "id", "left")
               .select("cls", "v", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("comp", "id").alias("comp")))
    out = rows.join(classed, (rows.cls == classed.cls) & (rows.vec == classed.v), "left")
    component = F.coalesce("comp", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
