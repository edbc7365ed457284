"""Byte-level BPE encoding and decoding.

Texts become codepoint-class arrays.  Token boundaries of the split pattern come from a small automaton whose transition
functions are composed by an associative scan (within blocks, over blocks, then down again), without a regex.  The slices
feed a cache of merged pairs; byte offsets of the tokens are kept and place their bytes when decoding.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CACHE = 600_000
#: Slices of more bytes merge with a heap.
SHORT_BYTES = 64
NEVER = 1 << 60
#: Characters of text scanned at once by one task.
CHUNK = 1 << 19
BLOCK = 64

# classes of a character, given what follows it
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, BLANK, LAST_SPACE, LAST_BLANK, BREAK = range(10)
# what the text before a character ends with: a run of a class, or a contraction with 1 or 2 letters to come, or its end
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, IN_BLANK, WANT_1, WANT_2, FRESH = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, token starts here), both by class and state."""
    step, start = np.zeros((10, 8), np.uint8), np.ones((10, 8), bool)
    for kind, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (SHORT, WANT_1), (LONG, WANT_2),
                      (SPACE, IN_SPACE), (BLANK, IN_BLANK), (LAST_SPACE, IN_SPACE), (LAST_BLANK, IN_BLANK), (BREAK, FRESH)):
        step[kind] = run
    for kind, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        start[kind, [run, IN_SPACE]] = False  # the run goes on, or takes the one space before it
    step[LETTER, WANT_1], step[LETTER, WANT_2] = FRESH, WANT_1
    start[LETTER, [WANT_1, WANT_2]] = False
    for kind in (SHORT, LONG):  # no contraction within a run of others or after a space
        step[kind, [IN_OTHERS, IN_SPACE]] = IN_OTHERS
        start[kind, [IN_OTHERS, IN_SPACE]] = False
    for kind in (SPACE, BLANK):
        start[kind, [IN_SPACE, IN_BLANK]] = False
    return step, start


STEP, START = _automaton()
#: The characters with Unicode's White_Space property (fixed values).
WHITE_SPACE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


def _kept() -> dict:
    """What a Python worker keeps from task to task; functions travel by value, so module globals do not last."""
    return sys.__dict__.setdefault("_assayer_bpe", {})


def _kinds() -> np.ndarray:
    """Class of every code point, before what follows is looked at."""
    kept = _kept()
    if "kinds" not in kept:
        first = {"L": LETTER, "N": NUMBER}
        kinds = np.array([first.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)], np.uint8)
        kinds[WHITE_SPACE] = BLANK
        kinds[32] = SPACE
        kept["kinds"] = kinds
    return kept["kinds"]


def classes(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    kind = _kinds()[points]
    kind[breaks] = BREAK
    after = np.r_[kind[1:], np.uint8(BREAK)]
    last = (after <= LONG) & (kind >= SPACE) & (kind <= BLANK)  # white space with something else behind it
    kind[last] += LAST_SPACE - SPACE
    mark = np.flatnonzero(points == 39)
    if len(mark):
        padded = np.r_[points, 0, 0]
        one, two = padded[mark + 1], padded[mark + 2]
        letter = lambda x, s: np.isin(x, [ord(c) for c in s])
        long = letter(one, "rv") & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        end = np.r_[kind, BREAK, BREAK]
        short = letter(one, "stmd") & (end[mark + 1] == LETTER)
        long &= (end[mark + 1] == LETTER) & (end[mark + 2] == LETTER)
        kind[mark] = np.where(kind[mark] == BREAK, BREAK, np.where(long, LONG, np.where(short, SHORT, OTHER)))
    return kind


def boundaries(kind: np.ndarray) -> np.ndarray:
    """Positions at which a token starts (a break starts one of its own)."""
    n = len(kind)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, BREAK, np.uint8)
    grid[:n] = kind
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    whole = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    flat = STEP.ravel()
    for row in grid:  # each block's transition function, for all states it may begin in
        whole = flat[(row.astype(np.int16) * 8)[:, None] + whole]
    reach = 1
    while reach < blocks:  # functions of block prefixes: composition is associative
        ahead = np.take_along_axis(whole[reach:], whole[:-reach], 1)
        whole = np.concatenate([whole[:reach], ahead])
        reach *= 2
    state = np.r_[np.uint8(FRESH), whole[:-1, FRESH]]
    starts = np.empty(grid.shape, bool)
    begin = START.ravel()
    for j, row in enumerate(grid):
        at = row.astype(np.int16) * 8 + state
        starts[j] = begin[at]
        state = flat[at]
    return np.flatnonzero(starts.T.ravel()[:n])


class Vocabulary:
    """Ranks of a rank file; merges of a slice are cached, the cache starts anew when full."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            pieces[rank] = piece
        self.lengths = np.array([len(p) for p in pieces])
        self.places = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> bytes:
        """Ids of one slice as int32 bytes: the adjacent pair of lowest rank merges first, the leftmost of equals."""
        if piece in self.ranks:
            return np.int32(self.ranks[piece]).tobytes()
        ranks, n = self.ranks, len(piece)
        part = [piece[i:i + 1] for i in range(n)]
        if n <= SHORT_BYTES:
            find = ranks.get
            pair = [find(piece[i:i + 2], NEVER) for i in range(n - 1)]
            while pair and (low := min(pair)) < NEVER:
                i = pair.index(low)
                part[i:i + 2] = [part[i] + part[i + 1]]
                del pair[i]
                if i < len(pair):
                    pair[i] = find(part[i] + part[i + 1], NEVER)
                if i:
                    pair[i - 1] = find(part[i - 1] + part[i], NEVER)
            return np.array([ranks[p] for p in part], np.int32).tobytes()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if part[i] else n
            if j >= n or part[i] is not left or part[j] is not right:
                continue  # one of the two has merged since
            part[i], part[j] = left + right, b""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(part[i] + part[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, part[h], part[i]))
        return np.array([ranks[p] for p in part if p], np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list = []
        at = 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size + len(texts[to]) < CHUNK:
                size += len(texts[to]) + 1
                to += 1
            out += self._encode("\n".join(texts[at:to]) + "\n", np.cumsum([len(t) + 1 for t in texts[at:to]]) - 1)
            at = to
        return out

    def _encode(self, joined: str, breaks: np.ndarray) -> list[np.ndarray]:
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = boundaries(classes(points, breaks))
        bounds = starts.tolist()
        bounds.append(len(joined))
        slices = [joined[a:b] for a, b in zip(bounds, bounds[1:])]
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        found = list(map(cache.get, slices))
        for i, got in enumerate(found):
            if got is None:
                piece = slices[i]
                if (got := cache.get(piece)) is None:
                    got = cache[piece] = self.merge(piece.encode("utf-8", "surrogatepass"))
                found[i] = got
        ends = np.searchsorted(starts, breaks).tolist()
        return [np.frombuffer(b"".join(found[lo:hi]), np.int32) for lo, hi in zip([0, *[e + 1 for e in ends[:-1]]], ends)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Bytes of tokens: each token's bytes go to its offset."""
        lengths = self.lengths[ids]
        inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out = np.empty(int(lengths.sum()), np.uint8)
        out[np.repeat(offsets, lengths) + inside] = self.blob[np.repeat(self.places[ids], lengths) + inside]
        return out.tobytes()


def _vocabulary(path: str) -> Vocabulary:
    kept = _kept()
    if path not in kept:
        kept[path] = Vocabulary(path)
    return kept[path]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id_col, ids, offsets): the token ids of every text and each token's first byte in the text's UTF-8.

    With decoded, also `data`: the bytes that the ids decode to, in the same task as a check of the round trip.

    Null and empty texts have no tokens.  Rows stay as they are, repeated or null ids too; further columns are ignored.
    `vocabulary` is the path of a rank file that executors can read.
    """
    def run(batches):
        vocab = _vocabulary(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = vocab.encode([t or "" for t in part.column(1).to_pylist()])
                offsets = [np.cumsum(vocab.lengths[i]) - vocab.lengths[i] for i in ids]
                columns = [part.column(0), _lists(ids), _lists(offsets)]
                if decoded:
                    columns.append(pa.array([vocab.decode(i, o) for i, o in zip(ids, offsets)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(id_col, F.col(text_col).cast("string").alias("_text"))
    names = [id_col, "ids", "offsets", *["data"] * decoded]
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, offsets array<int>" + ", data binary" * decoded)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """Adds `data`, the decoded bytes, to the output of encode()."""
    def run(batches):
        vocab = _vocabulary(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                data = [vocab.decode(i.values.to_numpy(), o.values.to_numpy()) if len(i) else b"" for i, o in zip(part.column(1), part.column(2))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names=[id_col, "ids", "offsets", "data"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids", "offsets").mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, offsets array<int>, data binary")
