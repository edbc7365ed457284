"""Packing token sequences: vector bin packing by the dot-product heuristic, with free cuts.

Each example is a vector (tokens, segments, loss-bearing tokens).  A sequence takes the example whose vector has the
largest dot product with what the sequence has left, among those that fit; when none fits, one is cut to fill it.  Every
task packs its own input partition in windows of bounded size, so nothing is shuffled and only the last sequences of a
task can be short; those are cut to powers of two.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens of a sequence; examples of a sequence of instruction data.
SEQUENCE, SEGMENTS = 2048, 512
WINDOW = 800
#: Words whose ids a worker keeps; a full cache starts anew.  Unknown words merged together, and bytes of the longest of them.
WORDS, TOGETHER, LONGEST = 200_000, 50_000, 64


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merger:
    """Merges the pieces of many words at once: in each round every piece joins the first of its pairs of lowest rank.

    A word is cut into runs of letters, single digits and runs of signs, as the tokenizer does.  Symbols of all runs lie in
    one array; the rank of each symbol's pair with the next comes from a hash table of the merges.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        self.bits = max(8, int(len(keys) * 5).bit_length())
        self.keys, self.ranks = np.zeros(1 << self.bits, np.uint32), np.full(1 << self.bits, self.NONE)
        slots, waiting = self._slot(keys), np.arange(len(keys))
        while len(waiting):  # a taken slot sends a key to the next one
            free = waiting[self.ranks[slots[waiting]] == self.NONE]
            _, first = np.unique(slots[free], return_index=True)
            won = free[first]
            self.keys[slots[won]], self.ranks[slots[won]] = keys[won], won
            waiting = np.setdiff1d(waiting, won)
            slots[waiting] = (slots[waiting] + 1) & ((1 << self.bits) - 1)
        code = np.arange(256)
        ascii_letter = ((code | 32) >= 97) & ((code | 32) <= 122) & (code < 128)
        self.kind = np.where(ascii_letter | (code >= 128), 1, np.where((code >= 48) & (code <= 57), 2, 0)).astype(np.int8)
        self.plain = (code > 32) & (code < 127) & (code != 39)
        self.low = np.where(ascii_letter, code | 32, code).astype(np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE of those that are never merged."""
        keys = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        slots = self._slot(keys)
        out = np.where(self.keys[slots] == keys, self.ranks[slots], self.NONE)
        open_ = np.flatnonzero((out == self.NONE) & (self.ranks[slots] != self.NONE))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            at, own = slots[open_], keys[open_]
            hit = self.keys[at] == own
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (self.ranks[at] != self.NONE)]
        return out

    def simple(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which words consist of Latin letters (ASCII, Latin-1), digits and ASCII signs without apostrophes, and are not long."""
        after = np.append(data[1:], 0)
        latin = (data == 0xC3) & (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
        good = self.plain[data] | latin
        good[1:] |= latin[:-1]
        return np.logical_and.reduceat(good, starts) & (sizes <= LONGEST)

    def merge(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word as little-endian unsigned 32-bit numbers; None for words that are not simple."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        good = self.simple(data, starts, sizes)
        own = np.repeat(np.arange(len(words)), sizes)
        keep = good[own]
        data, own = data[keep], own[keep]
        if not len(data):
            return [None] * len(words)
        upper = np.append(False, data[:-1] == 0xC3) & (data >= 0x80) & (data <= 0x9E)
        data = np.where(upper, data + np.uint8(32), self.low[data])
        kind = self.kind[data]
        first = np.ones(len(data), bool)
        first[1:] = (own[1:] != own[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        ends = np.append(first[1:], True)
        out = np.where(ends, self.last[data], self.inner[data])
        left = self._rounds(out, first, ends)
        ids, counts = out[left].astype("<u4"), np.bincount(own[left], minlength=len(words))
        buffer, to = ids.tobytes(), (np.cumsum(counts) * 4).tolist()
        return [buffer[a:b] if g else None for a, b, g in zip([0, *to[:-1]], to, good.tolist())]

    def _rounds(self, out: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Merge the runs in `out`; returns the places at which symbols are left."""
        left, at, sym = np.ones(len(out), bool), np.arange(len(out)), out
        rank = np.full(len(out), self.NONE)
        inside = np.flatnonzero(~ends)
        rank[inside] = self.rank(sym[inside], sym[inside + 1])
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(out)))
        while len(sizes):
            least = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
            more = least != self.NONE
            if not more.all():  # finished runs leave
                keep = np.repeat(more, sizes)
                out[at[~keep]] = sym[~keep]
                at, sym, rank, sizes, least = at[keep], sym[keep], rank[keep], sizes[more], least[more]
                if not len(sizes):
                    break
            run = np.repeat(np.arange(len(sizes)), sizes)
            here = np.flatnonzero(rank == least[run])
            here = here[np.append(True, run[here[1:]] != run[here[:-1]])]  # the first in each run, so one for each run
            sym[here] = self.made[least]
            begin = np.cumsum(sizes) - sizes
            stop = begin + sizes
            rank[here] = self.NONE
            on = here + 2 < stop
            rank[here[on]] = self.rank(sym[here[on]], sym[here[on] + 2])
            back = here > begin
            rank[here[back] - 1] = self.rank(sym[here[back] - 1], sym[here[back]])
            left[at[here + 1]] = False
            keep = np.ones(len(sym), bool)
            keep[here + 1] = False
            at, sym, rank, sizes = at[keep], sym[keep], rank[keep], sizes - 1
        return left


class WordTokenizer:
    """A public tokenizer that drops white space: ids of a text are those of its words, each looked up once.

    Unknown words of a window are merged together (Merger); those that are not simple go to the tokenizer's library.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as file:
            self.merger = Merger(json.load(file)["model"])
        self.cache: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        if len(self.cache) > WORDS:
            self.cache.clear()
        cache = self.cache
        new = [*set().union(*words).difference(cache)]
        for lo in range(0, len(new), TOGETHER):
            part = new[lo:lo + TOGETHER]
            for word, ids in zip(part, self.merger.merge(part)):
                if ids is None:
                    ids = np.array(self.inner.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
                cache[word] = ids
        return [b"".join(map(cache.__getitem__, ws)) for ws in words]


class Packer:
    """Packs one partition.  Limits: tokens, segments and loss-bearing tokens of a sequence."""

    def __init__(self, limits: tuple[int, int, int], first: int):
        self.limits, self.next, self.rows, self.pool = np.array(limits, float), first, [], []

    def add(self, key, ids: np.ndarray, loss: np.ndarray | None) -> None:
        """loss: for each id whether it bears loss; None if all do."""
        size = int(self.limits[0])
        step = min(size, int(self.limits[2])) if loss is None else size
        whole = len(ids) - len(ids) % step if loss is None else 0
        for at in range(0, whole, step):  # pieces that fill a sequence
            self.rows.append((key, at, ids[at:at + step], len(ids), self.next, 0))
            self.next += 1
        if whole < len(ids):
            self.pool.append((key, whole, ids, loss))

    def pack(self, last: bool = False) -> None:
        """Pack the pool; unless it is the last time, half a window stays for the next."""
        pool, limits = self.pool, self.limits
        start = [at for _, at, _, _ in pool]

        def vector(i: int) -> tuple[int, int, int]:
            _, _, ids, loss = pool[i]
            return len(ids) - start[i], 1, len(ids) - start[i] if loss is None else int(loss[start[i]:].sum())

        need = np.array([vector(i) for i in range(len(pool))], float).reshape(-1, 3)
        alive = np.ones(len(pool), bool)
        waiting = len(pool)
        while waiting > (0 if last else WINDOW // 2):
            left, taken, free = limits.copy(), [], alive.copy()
            while left[0] >= 1 and left[1] >= 1 and free.any():
                good = np.flatnonzero(free & (need <= left).all(1))
                if len(good):
                    i = int(good[np.argmax(need[good] @ (left / limits ** 2))])
                    cut = int(need[i, 0])
                else:  # none fits whole: cut the longest
                    rest = np.flatnonzero(free)
                    i = int(rest[np.argmax(need[rest, 0])])
                    cut = int(min(need[i, 0], left[0]))
                    loss = pool[i][3]
                    cut = int(min(cut, left[2])) if loss is None else int(np.searchsorted(np.cumsum(loss[start[i]:start[i] + cut]), left[2], "right"))
                free[i] = False
                if cut:
                    loss = pool[i][3]
                    taken.append((i, cut))
                    left -= (cut, 1, cut if loss is None else loss[start[i]:start[i] + cut].sum())
            if not taken:
                raise ValueError("an example cannot be placed under these limits")
            total = int(limits[0] - left[0])
            if last and total < limits[0] and total == need[alive, 0].sum() and total & (total - 1):
                total = 1 << (total.bit_length() - 1)  # the end of a partition: powers of two need no padding
            offset = 0
            for i, cut in taken:
                cut = min(cut, total - offset)
                if not cut:
                    break
                key, _, ids, _ = pool[i]
                self.rows.append((key, start[i], ids[start[i]:start[i] + cut], len(ids), self.next, offset))
                offset += cut
                start[i] += cut
                if start[i] == len(ids):
                    alive[i] = False
                    waiting -= 1
                else:
                    need[i] = vector(i)
            self.next += 1
        self.pool = [(pool[i][0], start[i], *pool[i][2:]) for i in np.flatnonzero(alive)]


def _batch(rows, id_col: str, kind: pa.DataType) -> pa.RecordBatch:
    ints = lambda xs: pa.array(xs, pa.int64())
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], kind), ints([r[1] for r in rows]), ints([len(r[2]) for r in rows]),
        pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary()), ints([r[3] for r in rows]), ints([r[4] for r in rows]), ints([r[5] for r in rows])],
        names=[id_col, "start", "length", "token_bytes", "doc_tokens", "sequence_id", "offset"])


PIECES = "start long, length long, token_bytes binary, doc_tokens long, sequence_id long, offset long"


def pack_texts(docs: DataFrame, tokenizer: str, end_id: int = 1, max_tokens: int = SEQUENCE, max_segments: int | None = None,
               max_loss: int | None = None, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None) -> DataFrame:
    """Pieces of sequences: (id_col, start, length, token_bytes, doc_tokens, sequence_id, offset).

    A text is tokenized whole and ends with end_id; null and empty texts consist of that id.  With prompt_col (a text
    before the answer) the prompt's tokens come first and bear no loss.  Each id lies in exactly one piece; token_bytes
    holds a piece's ids as little-endian unsigned 32-bit numbers.  A sequence keeps within max_tokens, max_segments
    pieces (with prompts SEGMENTS if not given, else as many as tokens) and max_loss loss-bearing tokens (max_tokens if not given).  Rows are taken as they are: repeated or null ids
    are separate texts, further columns are ignored, an empty table gives no piece.  sequence_id is the input partition
    times 2**32 plus a count, so a task that runs again writes the same.
    """
    limits = (max_tokens, max_segments or (SEGMENTS if prompt_col else max_tokens), max_loss or max_tokens)
    columns = [F.col(id_col), F.col(text_col).cast("string").alias("_text")]
    if prompt_col:
        columns.append(F.col(prompt_col).cast("string").alias("_prompt"))
    source = docs.select(*columns)

    def run(batches):
        # a Python worker keeps it from task to task; functions travel by value, so module globals do not last
        kept = sys.__dict__.setdefault("_assayer_packing", {})
        if tokenizer not in kept:
            kept[tokenizer] = WordTokenizer(tokenizer)
        words, packer = kept[tokenizer], Packer(limits, TaskContext.get().partitionId() << 32)
        end, kind = np.array([end_id], "<u4"), pa.null()
        for batch in batches:
            kind = batch.column(0).type
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                own = words.encode([t or "" for t in part.column(1).to_pylist()])
                before = words.encode([t or "" for t in part.column(2).to_pylist()]) if prompt_col else [b""] * len(own)
                for key, head, body in zip(part.column(0).to_pylist(), before, own):
                    ids = np.concatenate([np.frombuffer(head + body, "<u4"), end])
                    packer.add(key, ids, np.arange(len(ids)) >= len(head) // 4 if prompt_col else None)
                if len(packer.pool) >= WINDOW:
                    packer.pack()
                if packer.rows:
                    yield _batch(packer.rows, id_col, kind)
                    packer.rows = []
        packer.pack(last=True)
        if packer.rows:
            yield _batch(packer.rows, id_col, kind)

    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, {PIECES}")
