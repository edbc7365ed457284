"""The prefix trie against a plain Python version, with shards so small that most nodes lie in the skeleton."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from assayer.llm import trie


def plain(rows):
    """The contract, node by node: rows are (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, mark, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        head = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(head, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if whole[c] == p))).encode()).hexdigest()) for p, m in members.items())


def result(spark, rows, shard_turns):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, shard int")
    nodes = trie.prefix_trie(trie.rebuilt(trie.turn_lists(df)), shard_turns).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in nodes)


def conversations(seed, n):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-n, 4 * n), n):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "bb" * rng.randrange(3)])))
    return rows


ODD = [(0, None, "user", "first"), (0, 0, "user", "second"), (0, 0, "user", "tie"), (0, 0, "user", "tie"), (5, 1, None, None), (5, 2, "", ""), (None, 1, "user", "nobody's"),
       (10, 1, "user", "word " * 60000), (10, 2, "user", "word " * 60000), (11, 1, "us", "er"), (12, 1, "u", "ser"), (7, None, None, None), (-3, 1, "user", "first"),
       (2**62, 1, "user", "first")]


@pytest.mark.parametrize("shard_turns", [10_000, 50, 7])
def test_nodes(spark, shard_turns):
    rows = conversations(shard_turns, 150) + [(c + 10_000, t, "user", x) for c, t, _, x in ODD if c is not None and c < 100] + ODD
    assert result(spark, rows, shard_turns) == plain(rows)


def test_many_equal_and_long_conversations(spark):
    """A third are copies, which have to lie in many shards; some are long and share most of their turns."""
    rows = [(c, t, "user", f"same {t}") for c in range(0, 2000, 5) for t in range(3)]
    rows += [(c, t, "user", f"long {t if t < 290 + c % 7 else (t, c)}") for c in range(10_001, 10_013) for t in range(300)]
    rows += conversations(5, 200)
    assert result(spark, rows, 60) == plain(rows)


def test_shards_hold_the_copies_apart(spark):
    df = spark.createDataFrame([(c, t, "user", "x") for c in range(3000) for t in range(2)], "conv_id long, turn long, role string, text string")
    lists = trie.turn_lists(df)
    from pyspark.sql import functions as F
    paths = lists.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t.mark), "")).alias("path"), F.transform("turns", lambda t: t.bytes).alias("sizes"))
    border = trie.skeleton(paths, 300)
    dealt = defaultdict(int)
    for r in paths.collect():
        dealt[border.shard(bytes(r.path), r.conv_id)] += 1
    assert len(dealt) > 20 and max(dealt.values()) < 600
    assert len(border.parent) == 3  # the root and two nodes, whatever the number of splitters


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(trie.rebuilt(trie.turn_lists(df))).count() == 0
