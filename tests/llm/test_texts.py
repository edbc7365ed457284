"""Near duplicates, packing, byte-pair encoding, language and quality against plain Python versions."""

import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st

from assayer.llm import bpe, langid, minhash, packing, quality
from assayer.llm.shared import components, in_blocks, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def sets_of(texts, k):
    out = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def brute(texts, k, percent):
    """Smallest id reachable by links, for each id."""
    sets, root = sets_of(texts, k), {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in root}, sets


def copies(seed, bases=6, each=25, words=80, edits=6):
    """Groups of copies with a few words changed each, and exact copies of some."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(bases):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(each):
            own = list(base)
            for _ in range(rng.randrange(edits)):
                own[rng.randrange(words)] = rng.choice(vocabulary)
            out.append(" ".join(own))
        out += [out[-1]] * 3
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("k, threshold", [(3, 0.85), (5, 0.8)])
def test_near_duplicates_of_edited_copies(spark, k, threshold):
    texts = copies(k)
    want, sets = brute(texts, k, round(100 * threshold))
    got = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words=k, threshold=threshold).collect()
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_short_texts(spark):
    """A text and its copy without the last word; the smallest member of their buckets is a neighbour that links with neither."""
    texts = []
    for i in range(600):
        w = [f"w{i}x{j}" for j in range(9)]
        texts += [(3 * i, " ".join([*w[:7], "other"])), (3 * i + 1, " ".join(w)), (3 * i + 2, " ".join(w[:8]))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    want, _ = brute([t for t in texts if t[0] < 30], 5, 80)
    assert all(want[3 * i + 2] == 3 * i + 1 for i in range(10))
    assert [i for i in range(600) if got[3 * i + 2] != 3 * i + 1 or got[3 * i] != 3 * i] == []


def test_near_duplicates_of_given_documents(spark, sf):
    docs = table(spark, sf, "documents")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want, _ = brute(texts, 5, 80)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == want


def test_near_duplicates_of_odd_texts(spark, odd):
    got = {r.doc_id: r for r in minhash.near_duplicates(odd, words=3, threshold=0.85).collect()}
    assert [got[i].n_shingles for i in (1, 2, 3, 4, 5, 6)] == [0, 0, 0, 1, 1, 1]
    assert got[7].component_id == 4 and not got[7].kept
    assert got[None].component_id is None and got[None].kept
    assert all(got[i].kept for i in (1, 2, 3, 4, 5, 6, 8, 9))
    assert minhash.near_duplicates(odd.limit(0)).count() == 0
    twice = minhash.near_duplicates(odd.unionAll(odd), words=3, threshold=0.85)
    assert twice.count() == 2 * odd.count() and twice.where("doc_id = 7").select("component_id").distinct().collect() == [(4,)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for size, share in ((40, 0.9), (500, 0.8), (3000, 0.5)):
        got = []
        for _ in range(40):
            common = rng.integers(0, 1 << 62, int(size * share), dtype=np.uint64)
            own = [np.unique(np.r_[common, rng.integers(0, 1 << 62, size - len(common), dtype=np.uint64)]) for _ in range(2)]
            truth = len(np.intersect1d(*own)) / len(np.union1d(*own))
            a, b = map(minhash.signature, own)
            got.append((a == b).mean() - truth)
        assert abs(np.mean(got)) < 0.03, (size, share)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2300)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_bring_every_pair_together_once(spark):
    members = spark.createDataFrame([(g, i) for g, n in ((1, 100), (2, 7), (3, 1)) for i in range(n)], "g int, id long")
    dealt = in_blocks(members, ["g"], "id", members.groupBy("g").count().withColumnRenamed("count", "n"), 10).collect()
    groups, met = defaultdict(list), defaultdict(int)
    for r in dealt:
        groups[r.g, r.block_a, r.block_b].append((r.id, r.side))
    for (g, a, b), rows in groups.items():
        assert len(rows) < 50
        for (x, s), (y, t) in itertools.combinations(sorted(rows), 2):
            if a == b or s != t:
                met[g, x, y] += 1
    assert met == {(g, x, y): 1 for g, n in ((1, 100), (2, 7)) for x, y in itertools.combinations(range(n), 2)}


@pytest.fixture(scope="module")
def reference():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'stremvld  \n\t  é1٣!?-中\x1c"), max_size=40), min_size=1, max_size=5))
def test_boundaries_are_those_of_the_pattern(texts):
    joined = "\n".join(texts) + "\n"
    breaks = np.cumsum([len(t) + 1 for t in texts]) - 1
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    starts = set(bpe.boundaries(bpe.classes(points, breaks)).tolist()) - set(breaks.tolist())
    want, at = set(), 0
    for t in texts:
        want |= {at + m.start() for m in regex.finditer(public_tokenizers.PATTERN, t)}
        at += len(t) + 1
    assert starts == want


def test_byte_pairs_match_the_library(spark, sf, odd, reference):
    long = spark.createDataFrame([(77, "x" * 5000 + "é" * 3000, "")], odd.schema)
    docs = table(spark, sf, "documents").selectExpr("doc_id", "text", "'' AS bucket").unionAll(odd).unionAll(long)
    rows = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    texts = sorted(((r.doc_id is None, r.doc_id, r.text or "") for r in docs.collect()), key=str)
    assert len(rows) == len(texts)
    got = sorted(((r.doc_id is None, r.doc_id, bytes(r.data).decode()) for r in rows), key=str)
    assert got == texts
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    for _, i, t in texts:
        if i is not None and by_id[i].data == t.encode():
            assert list(by_id[i].ids) == reference.encode_ordinary(t)
            starts = np.cumsum([0] + [len(reference.decode_single_token_bytes(x)) for x in by_id[i].ids])[:-1]
            assert list(by_id[i].offsets) == list(starts)


def whole(rows):
    docs = defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
    return docs


def test_packing_places_every_id_once(spark, sf, odd):
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(WORDS)
    inner.encode_special_tokens = True
    docs = table(spark, sf, "documents").selectExpr("doc_id + 100 AS doc_id", "text", "'' AS bucket").unionAll(odd)
    rows = packing.pack_texts(docs, WORDS).collect()
    pieces = whole(rows)
    for r in docs.collect():
        ids = [*inner.encode(r.text or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[r.doc_id], key=lambda p: p.start)
        assert [p.start for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
        assert np.frombuffer(b"".join(bytes(p.token_bytes) for p in own), "<u4").tolist() == ids
        assert {p.doc_tokens for p in own} == {len(ids)}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1])
        total = sum(n for _, n in parts)
        assert total <= 2048 and len(parts) <= packing.SEGMENTS
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert padding == 0
    assert packing.pack_texts(odd.limit(0), WORDS).count() == 0


def test_packing_keeps_all_three_limits(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("word" for _ in range(rng.randrange(1, 60))), " ".join("ask" for _ in range(rng.randrange(40)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt string").coalesce(1)
    got = packing.pack_texts(df, WORDS, max_tokens=128, max_segments=4, max_loss=70, prompt_col="prompt").collect()
    prompt = {i: len(p.split()) for i, _, p in rows}
    size = {i: len(t.split()) + len(p.split()) + 1 for i, t, p in rows}
    per, placed = defaultdict(list), defaultdict(int)
    for r in got:
        per[r.sequence_id].append(r)
        placed[r.doc_id] += r.length
    assert dict(placed) == size
    for parts in per.values():
        loss = sum(max(0, p.start + p.length - max(p.start, prompt[p.doc_id])) for p in parts)
        assert sum(p.length for p in parts) <= 128 and len(parts) <= 4 and loss <= 70


def test_language_on_held_out_documents(spark, sf, odd):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(docs, langid.train(docs)).withColumn("held", langid.held_out("doc_id")).where("held").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert sum(r.lang_kept for r in got) >= 0.99 * len(got)
    assert all(0 <= r.lang_score <= 1 for r in got) and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held for r in got)
    model = langid.train(docs)
    junk = spark.createDataFrame([(1, "zzqx kkwv qqjx vvzk xxqj " * 40), (2, "123 456 !!")], "doc_id long, text string")
    assert [(r.lang_pred == "und", r.lang_kept) for r in langid.identify(junk, model).orderBy("doc_id").collect()] == [(False, False), (True, False)]
    out = {r.doc_id: r for r in langid.identify(odd.withColumnRenamed("bucket", "lang_pred"), model).collect()}
    assert len(out) == odd.select("doc_id").distinct().count() and out[1].lang_pred == out[2].lang_pred == out[3].lang_pred == "und" and out[1].lang_score == 0
    assert langid.identify(odd.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.train(docs.limit(0))).collect()} == {"und"}


def test_quality_on_held_out_documents(spark, odd):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = quality.scored(docs.join(labels, "doc_id"), model).withColumn("held", langid.held_out("doc_id")).where("held").collect()
    score, good = np.array([r.quality_score for r in rows]), np.array([r.quality == 1 for r in rows])
    assert ((score >= 0) & (score <= 1)).all()
    assert (((score >= quality.CUT) == good).mean()) > 0.9
    order = score.argsort().argsort()
    auc = (order[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.93
    out = quality.scored(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.quality_score <= 1 for r in out)
    assert quality.scored(odd.limit(0), model).count() == 0
    assert all(r.quality_score >= quality.CUT for r in quality.scored(odd, quality.train(docs, labels.limit(0))).collect())


def test_signatures_are_made_of_few_rows_at_a_time():
    import pyarrow as pa

    from assayer.llm import minhash as M

    texts = [f"w{i} a b c d w{i * 7}" if i % 5 else None for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(range(1000), pa.int64()), pa.array(texts)], names=["id", "content", "text"])
    sign = M._signer(3, M.band_rows(0.85))
    parts = list(sign([batch]))
    assert max(p.num_rows for p in parts) <= 256
    single = [row for i in range(1000) for p in sign([batch.slice(i, 1)]) for row in p.to_pylist()]
    assert [row for p in parts for row in p.to_pylist()] == single
