"""Prefix trie of conversations: sorted shards finish their own nodes, the skeleton on their borders is put together by a reduction.

Conversations are range-partitioned by their turns' digests.  The members of a prefix stand next to each other in that
order, so a node whose members lie in several shards is a prefix of a splitter, the path at a border.  The trie of all
splitter paths (the skeleton, of bounded size) goes to every task.  A task reads its shard in order with one stack of open
nodes: a node outside the skeleton is finished when it closes, a skeleton node gives a partial row.  Partial rows of a
node are then summed, and what only the whole skeleton shows is added.
"""

from __future__ import annotations

import hashlib
import sys
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from assayer.llm.shared import small_or_shuffled
from assayer.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a turn's digest in a path.
MARK = 16
#: Turns of a shard, and the most shards; beyond it shards grow, which their tasks read as streams.
SHARD_TURNS, SHARDS = 20_000, 10_000
#: Conversations looked at for each splitter, and bytes of path that they and the splitters may have.
LOOKED_AT, SAMPLE_BYTES, SPLITTER_BYTES = 20, 64 << 20, 8 << 20
#: Ids of one piece of a skeleton node's members.
PIECE = 4096

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
ROWS = f"kind int, node long, shard long, piece long, {NODES}"


def turn_lists(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, each as its digest (hex) and the bytes of its text.

    turns: (conv_id, turn, role, text).  Null turns come first, equal ones in the order of their digests; null role or text
    counts as empty.  Rows without conv_id belong to no conversation.  Further columns are ignored.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * MARK)
    rows = turns.where("conv_id is not null").select("conv_id", F.struct(F.col("turn").alias("turn"), mark.alias("mark"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select(F.col("conv_id").cast("long").alias("conv_id"), F.transform("t", lambda t: F.struct(t.mark.alias("mark"), t.bytes.alias("bytes"))).alias("turns"))


def rebuilt(lists: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % group (all it has, if fewer; none if
    there is no such conversation) and its own turns after its first h; h = crc32 of c in decimal, modulo heads."""
    c = F.col("conv_id")
    first = lists.where(c % group == 0).select(c.alias("_head"), F.slice("turns", 1, heads - 1).alias("_first"))
    h = (F.crc32(c.cast("string").cast("binary")) % heads).cast("int")
    own = F.slice(F.col("turns"), h + 1, F.greatest(F.size("turns"), F.lit(1)))
    none = F.slice(F.col("turns"), 1, 0)
    joined = lists.withColumn("_head", c - c % group).join(first, "_head", "left")
    return joined.select("conv_id", F.concat(F.coalesce(F.slice(F.col("_first"), F.lit(1), h), none), own).alias("turns"))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share from their start."""
    most = min(len(a), len(b)) // MARK
    if a[:most * MARK] == b[:most * MARK]:
        return most
    lo, hi = 0, most - 1  # the first differing turn, by halves
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo * MARK:mid * MARK] == b[lo * MARK:mid * MARK]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Skeleton:
    """The trie of the splitters' paths.  Node 0 is the root; walks has the nodes of each splitter from the root on."""

    def __init__(self, splitters: list[tuple[bytes, int, list[int]]]):
        self.keys = [(path, conv) for path, conv, _ in splitters]
        self.parent, self.depth, self.bytes, self.children, self.walks = [-1], [0], [0], [0], []
        before, walk = b"", [0]
        for path, _, sizes in splitters:  # sorted, so what two neighbours share is all that any two do
            walk = walk[:_common(before, path) + 1]
            for d in range(len(walk), len(path) // MARK + 1):
                self.children[walk[-1]] += 1
                for column, x in ((self.parent, walk[-1]), (self.depth, d), (self.bytes, sizes[d - 1]), (self.children, 0)):
                    column.append(x)
                walk.append(len(self.parent) - 1)
            self.walks.append(list(walk))
            before = path
        self.under = list(self.bytes)  # bytes of a node and all skeleton nodes below it
        for node in range(len(self.parent) - 1, 0, -1):  # a node comes after its parent
            self.under[self.parent[node]] += self.under[node]

    def shard(self, path: bytes, conv: int) -> int:
        return bisect_right(self.keys, (path, conv))

    def walk(self, shard: int, path: bytes) -> list[int]:
        """The skeleton nodes on a path of this shard: all that it shares with the splitter before or behind it."""
        best = [0]
        for i in (shard - 1, shard):
            if 0 <= i < len(self.keys):
                n = _common(path, self.keys[i][0])
                if n >= len(best):
                    best = self.walks[i][:n + 1]
        return best


def skeleton(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> Skeleton:
    """Splitters that cut the conversations into shards of about equal numbers of turns, from a bounded look at the paths.

    Which conversations are looked at follows from a hash of their ids.  The splitters decide where work is done, never a
    result; if their paths are too long together, every other one is left out.
    """
    size = paths.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("sizes") + 1), F.lit(0)).alias("turns"), F.coalesce(F.sum(F.octet_length("path")), F.lit(0)).alias("bytes")).first()
    shards = min(SHARDS, -(-size["turns"] // shard_turns))
    if shards < 2:
        return Skeleton([])
    share = min(1.0, LOOKED_AT * shards / size["n"], SAMPLE_BYTES / max(size["bytes"], 1))
    some = paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    seen = sorted(((bytes(r.path), r.conv_id, r.sizes) for r in some.collect()), key=lambda r: r[:2])
    at = list(accumulate(len(r[2]) + 1 for r in seen))
    picks = sorted({bisect_left(at, k * at[-1] / shards) for k in range(1, shards)}) if seen else []
    picked = [seen[i] for i in picks]
    while sum(len(r[0]) for r in picked) > SPLITTER_BYTES and len(picked) > 1:
        picked = picked[1::2]
    return Skeleton(picked if sum(len(r[0]) for r in picked) <= SPLITTER_BYTES else [])


class _Open:
    """A node some of whose members may still come."""

    __slots__ = ("node", "bytes", "conv", "members", "children", "leaves", "saved", "digest", "ids", "pieces", "waiting")

    def __init__(self, node: int | None, size: int):
        self.node, self.bytes, self.conv = node, size, None
        self.members = self.children = self.leaves = self.saved = self.pieces = 0
        self.digest, self.ids, self.waiting = None, [], []


NOTHING = hashlib.sha256(b"").hexdigest()


class _Shard:
    """One sorted shard, read once: rows gets finished nodes (kind 0), partial skeleton nodes (1), pieces of members (2)."""

    def __init__(self, trie: Skeleton, shard: int, rows: list):
        self.trie, self.shard, self.rows, self.before = trie, shard, rows, b""
        self.stack = [_Open(0, 0)]

    def add(self, path: bytes, conv: int, sizes: list[int]) -> None:
        shared = _common(self.before, path)
        while len(self.stack) > shared + 1:
            self.close()
        if len(sizes) > shared:
            walk = self.trie.walk(self.shard, path)
            for d in range(shared + 1, len(sizes) + 1):
                self.stack.append(_Open(walk[d] if d < len(walk) else None, sizes[d - 1]))
        self.before, end = path, self.stack[-1]
        end.members += 1
        end.conv = conv if end.conv is None else min(end.conv, conv)
        if end.node is None:
            if end.digest is None:
                end.digest = hashlib.sha256(str(conv).encode())
            else:
                end.digest.update(b",%d" % conv)
        else:
            end.ids.append(conv)
            if len(end.ids) == PIECE:
                self.piece(end)

    def piece(self, x: _Open) -> None:
        if x.ids:
            self.rows.append((2, x.node, self.shard, x.pieces, *[None] * 7, ",".join(map(str, x.ids))))
            x.ids, x.pieces = [], x.pieces + 1

    def close(self) -> None:
        x, depth = self.stack.pop(), len(self.stack)
        up = self.stack[-1] if self.stack else None
        if x.node is None:
            x.saved += (x.members - 1) * x.bytes
            x.leaves += not x.children
            self.rows += [(0, None, None, None, c, d, x.conv, *rest) for c, d, _, *rest in x.waiting]
            own = (x.conv, depth, None, x.members, x.children, x.leaves, x.saved, x.digest.hexdigest() if x.digest else NOTHING)
            up.children += 1
            if up.node is None:
                up.waiting.append(own)
            else:  # its parent's smallest member is known after the reduction only
                self.rows.append((0, up.node, None, None, *own))
        else:
            x.saved += x.members * x.bytes  # once too often for each skeleton node: taken off after the reduction
            self.piece(x)
            self.rows.append((1, x.node, None, None, x.conv, depth, None, x.members, x.children, x.leaves, x.saved, None))
        if up:
            up.members += x.members
            up.conv = x.conv if up.conv is None else min(up.conv, x.conv)
            up.leaves += x.leaves
            up.saved += x.saved

    def end(self) -> None:
        while self.stack:
            self.close()


def _hashes(pieces: DataFrame) -> DataFrame:
    """(node, ends_sha256) of skeleton nodes: a digest takes its ids one after the other, so the pieces of a node are read in
    their order as a stream; nothing of a node is held but the digest's state."""
    def run(batches):
        node = digest = None
        for batch in batches:
            out = []
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n == node:
                    digest.update(b"," + ids.encode())
                else:
                    if node is not None:
                        out.append((node, digest.hexdigest()))
                    node, digest = n, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], names=["node", "hash"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["node", "hash"])

    ordered = pieces.repartition("node").sortWithinPartitions("node", "shard", "piece")
    return ordered.select("node", "ends_sha256").mapInArrow(run, "node long, hash string")


def prefix_trie(lists: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of conversations: conv_id (smallest member), depth, parent_conv_id (the parent's conv_id;
    root null), n_convs (members), n_children, n_leaves (childless nodes in the subtree), saved_tokens (over the subtree,
    (members - 1) times the bytes of a node's last text) and ends_sha256 (of the ids of members that end there, ascending,
    joined by commas).

    lists: (conv_id, turns) with one row for each conv_id, turns being (mark, bytes) as turn_lists gives them; no turns at
    all is a conversation that ends at the root.  An empty table has no node.  A conversation has to fit in a row, as 16
    bytes a turn.  Equal conversations are told apart by their ids in the order, so any number of them is spread over shards.
    """
    spark = lists.sparkSession
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t.mark), ""))
    paths = written(lists.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t.bytes).alias("sizes")), "trie-paths")
    trie = skeleton(paths, shard_turns)
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [(name, kinds[kind]) for name, kind in (f.split() for f in ROWS.split(", "))]

    @F.arrow_udf("int")
    def shard_of(path: pa.Array, conv: pa.Array) -> pa.Array:
        return pa.array(map(trie.shard, path.to_pylist(), conv.to_pylist()), pa.int32())

    def batch(rows):
        columns = zip(*rows) if rows else [[]] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields])

    def run(batches):
        rows, now = [], None
        for part in batches:
            for shard, path, conv, sizes in zip(*(part.column(i).to_pylist() for i in range(4))):
                if now is None or now.shard != shard:
                    if now:
                        now.end()
                    now = _Shard(trie, shard, rows)
                now.add(path, conv, sizes)
                if len(rows) >= 10_000:
                    yield batch(rows)
                    rows.clear()
        if now:
            now.end()
        yield batch(rows)

    dealt = paths.withColumn("shard", shard_of("path", "conv_id")).repartitionById(len(trie.keys) + 1, F.col("shard"))
    dealt = dealt.sortWithinPartitions("shard", "path", "conv_id").select("shard", "path", "conv_id", "sizes")
    made = written(dealt.mapInArrow(run, ROWS), "trie-nodes")

    # the skeleton: partial rows of a node summed, its own figures from the trie, childless ends counted on their way up
    shape = spark.createDataFrame([*zip(range(len(trie.parent)), trie.parent, trie.depth, trie.children, trie.under)],
                                  "node long, parent long, depth long, inner long, under long")
    parts = made.where("kind = 1").groupBy("node").agg(*[f(c).alias(c) for f, c in ((F.min, "conv_id"), (F.sum, "n_convs"), (F.sum, "n_children"), (F.sum, "n_leaves"), (F.sum, "saved_tokens"))])
    parts = written(parts.join(F.broadcast(shape), "node"), "trie-skeleton")
    ends = {walk[-1]: walk for walk in trie.walks} or {0: [0]}
    ways = spark.createDataFrame([*ends.items()], "node long, way array<long>")
    bare = parts.where("n_children + inner = 0").join(F.broadcast(ways), "node").select(F.explode("way").alias("node")).groupBy("node").agg(F.count("*").alias("bare"))
    inner = parts.join(bare, "node", "left").join(_hashes(made.where("kind = 2")), "node", "left")
    least = F.broadcast(parts.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    inner = inner.join(least, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("n_children") + F.col("inner")).alias("n_children"),
        (F.col("n_leaves") + F.coalesce("bare", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") - F.col("under")).alias("saved_tokens"),
        F.coalesce("hash", F.lit(NOTHING)).alias("ends_sha256"))
    known = parts.select("node", F.col("conv_id").alias("_parent"))
    outer = made.where("kind = 0").join(small_or_shuffled(known, len(trie.parent)), "node", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return outer.unionByName(inner)
