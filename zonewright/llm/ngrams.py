"""Language-model scores from an Elias-Fano trie of n-grams.

The model is a word bigram with absolute discounting over an add-one unigram:
p(w|v) = max(c(vw) - D, 0) / c(v) + D * t(v) / c(v) * p(w), t(v) the number of
different words seen after v. The mass of unseen words is exact, so the
probabilities after each v add up to one (but for the quantisation).

Documents are scored in chunks of about 12 MB, dealt by hash and packed. A chunk asks for its distinct
bigrams only: sorted lists of context and successor hashes, dealt to the shard
of the context. A shard adds up the counts of all chunks, builds its trie, and
answers each chunk by looking its lists up there: counts per context, a code of
two bytes per successor. Frequent contexts (over half a shard's share) are
dealt over several shards by successor, and their totals added up; there are
fewer than 2 * ``HEAVY`` of them.

Words are 64-bit hashes, successors the upper 40 bits of them within a context;
two words fall together with a chance of n^2 / 2^65 for n different words.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.llm.common import held, remainder, text_of

DISCOUNT = 0.75
CHUNK_BYTES = 12 << 20
PACK_BYTES = 8 << 20
SHARD_TOKENS = 2_000_000
HEAVY = 1024
SUCCESSOR_BITS = 40
STEP = 2500.0  # quantisation: codes per power of ten
START = np.uint64(0x5AFE57A27)
END = np.uint64(0xE2D0F7E87)


# ---- Elias-Fano sequences and the trie


class Sequence:
    """Strictly increasing 64-bit values in Elias-Fano form: low bytes as they
    are, high parts as unary gaps in a bit vector with a directory of ones."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.low, self.bits, self.ones = arrays["low"], arrays["bits"], arrays["ones"]
        self.shift, self.n = int(arrays["meta"][0]), int(arrays["meta"][1])

    @staticmethod
    def build(values: np.ndarray) -> dict[str, np.ndarray]:
        n = len(values)
        largest = int(values[-1]) if n else 0
        width = 0
        while width < 7 and largest >> (8 * (width + 1)) >= n > 0:
            width += 1
        if n and largest >> (8 * width) > 4 * n:
            width += 1
        shift = min(8 * width, 56)
        width = shift // 8
        low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].copy()
        high = (values >> np.uint64(shift)).astype(np.int64)
        size = (int(high[-1]) + n + 2 if n else 2) + 63 & ~63
        flags = np.zeros(size, np.uint8)
        flags[high + np.arange(n)] = 1
        bits = np.packbits(flags, bitorder="little").view("<u8")
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))
        return {"low": low, "bits": bits, "ones": ones, "meta": np.array([shift, n], np.int64)}

    def _bucket(self, high: np.ndarray) -> np.ndarray:
        """Index of the first value whose high part is at least ``high``: the
        zeros of the bit vector part the buckets."""
        zeros = 64 * np.arange(len(self.ones)) - self.ones
        want = high  # number of zeros ahead of the bucket
        word = np.clip(np.searchsorted(zeros, want, "left") - 1, 0, len(self.bits) - 1)
        left = want - zeros[word]  # zeros still to pass inside the word
        free = ~self.bits[word]
        at = np.zeros(len(want), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(free >> at.astype(np.uint64) & np.uint64((1 << half) - 1)).astype(np.int64)
            step = left > count
            left = np.where(step, left - count, left)
            at = np.where(step, at + half, at)
        place = 64 * word + np.where(want > 0, at + 1, 0)
        return np.where(want > 0, place - want, 0)

    def _value(self, i: np.ndarray) -> np.ndarray:
        """Low parts."""
        width = self.low.shape[1]
        out = np.zeros((len(i), 8), np.uint8)
        out[:, :width] = self.low[i]
        return out.view("<u8").ravel()

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, -1 if it is not there (successor search)."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        top = (values >> np.uint64(self.shift)).astype(np.int64)
        highest = 64 * len(self.bits) - int(self.ones[-1])
        inside = top < highest - 1
        at = np.full(len(values), self.n, np.int64)
        end = np.full(len(values), 0, np.int64)
        at[inside] = self._bucket(top[inside])
        end[inside] = self._bucket(top[inside] + 1)
        low = values & np.uint64((1 << self.shift) - 1)
        stop = end.copy()
        rows = np.flatnonzero(at < stop)
        while len(rows):  # binary search inside the buckets
            middle = (at[rows] + stop[rows]) // 2
            less = self._value(middle) < low[rows]
            at[rows] = np.where(less, middle + 1, at[rows])
            stop[rows] = np.where(less, stop[rows], middle)
            rows = rows[at[rows] < stop[rows]]
        out = np.full(len(values), -1, np.int64)
        ok = np.flatnonzero(at < end)
        same = self._value(at[ok]) == low[ok]
        out[ok[same]] = at[ok[same]]
        return out


class Trie:
    """Two levels: contexts, and the successors of each, kept relative to their
    context (rank of the context ahead of 40 successor bits), with codes of
    discounted relative frequencies. Levels are files mapped into memory."""

    def __init__(self, folder: str, parts: dict[str, np.ndarray]) -> None:
        self.maps: dict[str, np.ndarray] = {}
        for name, array in parts.items():
            if array.size:
                path = os.path.join(folder, name)
                array.tofile(path)
                self.maps[name] = np.memmap(path, array.dtype, "r", shape=array.shape)
            else:
                self.maps[name] = array
        level = lambda p: Sequence({k: self.maps[f"{p}.{k}"] for k in ("low", "bits", "ones", "meta")})
        self.contexts, self.successors = level("contexts"), level("successors")
        self.total, self.kinds, self.codes = self.maps["total"], self.maps["kinds"], self.maps["codes"]

    @staticmethod
    def build(folder: str, contexts: np.ndarray, pointers: np.ndarray, successors: np.ndarray, counts: np.ndarray) -> "Trie":
        """``contexts`` sorted; successors of context i at pointers[i]..pointers[i + 1], sorted."""
        sizes = np.diff(pointers)
        owner = np.repeat(np.arange(len(contexts)), sizes)
        total = np.bincount(owner, weights=counts, minlength=len(contexts)).astype(np.int64)
        monotone = (owner.astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | successors
        parts = {f"contexts.{k}": v for k, v in Sequence.build(contexts).items()}
        parts |= {f"successors.{k}": v for k, v in Sequence.build(monotone).items()}
        codes = quantise((counts - DISCOUNT) / total[owner])
        return Trie(folder, parts | {"total": total, "kinds": sizes.astype(np.int64), "codes": codes})

    def ask(self, contexts: np.ndarray, sizes: np.ndarray, successors: np.ndarray):
        """(count, kinds) of each context, and the code of each successor (0: not seen)."""
        rank = self.contexts.find(contexts)
        known = rank >= 0
        total, kinds = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        total[known], kinds[known] = self.total[rank[known]], self.kinds[rank[known]]
        owner = np.repeat(rank, sizes)
        rows = np.flatnonzero(owner >= 0)
        at = self.successors.find((owner[rows].astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | successors[rows])
        codes = np.zeros(len(successors), np.uint16)
        codes[rows[at >= 0]] = self.codes[at[at >= 0]]
        return total, kinds, codes


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(65535 + STEP * np.log10(p)), 1, 65535).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == 0, 0.0, 10 ** ((codes.astype(np.float64) - 65535) / STEP))


# ---- what a chunk asks


def packed(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


@dataclass
class Plan:
    """What every task has to know: shards, and the heavy contexts with their spread."""

    shards: int
    spread: dict[int, int]

    def place(self, contexts: np.ndarray, successors: np.ndarray) -> np.ndarray:
        out = (contexts % np.uint64(self.shards)).astype(np.int64)
        if self.spread:
            heavy = np.array(sorted(self.spread), np.uint64)
            ways = np.array([self.spread[int(h)] for h in heavy], np.uint64)
            own, which = members(contexts, heavy)
            out[own] = (out[own] + (successors[own] % ways[which]).astype(np.int64)) % self.shards
        return out


def members(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that are in the sorted ``known``, and where there."""
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    own = np.flatnonzero(known[at] == values)
    return own, at[own]


class Part:
    """The tokens of some texts: bigrams in the order of shard, context and
    successor, which depends on the texts only, not on their order. Rows that
    repeat id and text are kept once, with their number."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.pieces: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.trains: list[bool] = []
        self.repeats: list[int] = []
        self.seen: dict[tuple, int] = {}

    def add(self, key: int | None, text: bytes, train: bool, repeats: int = 1) -> None:
        name = (key, len(text), xxhash.xxh64_intdigest(text))
        if (at := self.seen.setdefault(name, len(self.ids))) < len(self.ids):
            self.repeats[at] += repeats
            return
        known = self.vocabulary
        words = text.lower().split()
        self.pieces.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        self.ids.append(key)
        self.trains.append(train)
        self.repeats.append(repeats)

    def settle(self, plan: Plan) -> None:
        v = len(self.vocabulary)
        digest = xxhash.xxh64_intdigest
        self.hashes = np.concatenate((np.fromiter((digest(w) for w in self.vocabulary), np.uint64, v), [END, START])).astype(np.uint64)
        self.vocabulary.clear()
        self.seen.clear()
        self.end = v
        start = v + 1
        sizes = np.array([len(p) + 1 for p in self.pieces], np.int64)
        self.ends = np.cumsum(sizes)
        tokens = int(self.ends[-1]) if len(sizes) else 0
        self.token = np.full(tokens, self.end, np.int32)
        inner = np.ones(tokens, bool)
        inner[self.ends - 1] = False
        self.token[inner] = np.concatenate(self.pieces) if self.pieces else np.zeros(0, np.int32)
        self.pieces = []
        before = np.empty(tokens, np.int32)
        before[1:] = self.token[:-1]
        before[self.ends - sizes] = start
        pairs, pair_of = np.unique(before.astype(np.int64) * (v + 2) + self.token, return_inverse=True)
        del before, inner
        weight = np.where(self.trains, self.repeats, 0)
        counts = np.bincount(pair_of, weights=np.repeat(weight, sizes), minlength=len(pairs)).astype(np.int64)
        context, successor = self.hashes[pairs // (v + 2)], self.hashes[pairs % (v + 2)] >> np.uint64(64 - SUCCESSOR_BITS)
        shard = plan.place(context, successor)
        order = np.lexsort((successor, context, shard))
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        self.pair_of = back[pair_of]
        self.before = (pairs // (v + 2))[order].astype(np.int32)
        self.shard, self.context, self.successor, self.count = shard[order], context[order], successor[order], counts[order]

    def messages(self):
        """(shard, contexts, sizes, successors, counts) per shard asked."""
        cuts = np.flatnonzero(np.diff(self.shard)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(self.shard)]):
            if a == b:
                continue
            new = np.ones(b - a, bool)
            new[1:] = self.context[a + 1 : b] != self.context[a : b - 1]
            first = np.flatnonzero(new)
            yield int(self.shard[a]), self.context[a:b][first], np.diff(np.append(first, b - a)), self.successor[a:b], self.count[a:b]


MESSAGE = "kind int, place long, part long, contexts binary, sizes binary, successors binary, counts binary"
NAMES = [x.split()[0] for x in MESSAGE.split(", ")]


def small(values: np.ndarray) -> bytes:
    """Counts: a byte each, and those from 255 on behind them in full."""
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype("<i8").tobytes()


def unsmall(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", offset=n)
    return out


def squeezed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def released(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


# ---- texts in chunks


PACKED = "chunk long, ids binary, sizes binary, trains binary, texts binary"
PACKED_TYPES = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
NO_ID = np.iinfo(np.int64).min


def _pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, id, text, train) rows to one compressed row per chunk and
    ``PACK_BYTES`` of a task's texts."""
    waiting: dict[int, list[tuple]] = {}
    size = 0
    squeeze = zstandard.ZstdCompressor(level=1)

    def out():
        rows = []
        for chunk, docs in waiting.items():
            ids, texts, trains = zip(*docs)
            rows.append((chunk, np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(),
                         np.array(trains, np.uint8).tobytes(), squeeze.compress(b"".join(texts))))
        waiting.clear()
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), PACKED_TYPES)], names=[x.split()[0] for x in PACKED.split(", ")])

    for part in parts:
        for chunk, key, text, train in zip(*part.columns):
            text = text.as_py()
            waiting.setdefault(chunk.as_py(), []).append((key.as_py(), text, train.as_py()))
            size += len(text) + 100
            if size >= PACK_BYTES:
                yield from out()
                size = 0
    if waiting:
        yield from out()


def _unpack(ids: bytes, sizes: bytes, trains: bytes, texts: bytes):
    sizes = np.frombuffer(sizes, "<i8").tolist()
    raw = zstandard.ZstdDecompressor().decompress(texts, max_output_size=max(1, sum(sizes)))
    at = 0
    for key, n, train in zip(np.frombuffer(ids, "<i8").tolist(), sizes, trains):
        yield None if key == NO_ID else key, raw[at : at + n], bool(train)
        at += n


def parts_of(rows, plan: Plan):
    """(chunk, settled part) of (chunk, ids, sizes, trains, texts) rows sorted by chunk."""
    part, at = Part(), None
    for chunk, *packed in rows:
        if at is not None and chunk != at:
            part.settle(plan)
            yield at, part
            part = Part()
        at = chunk
        for key, text, train in _unpack(*packed):
            part.add(key, text, train)
    if at is not None:
        part.settle(plan)
        yield at, part


# ---- Spark steps


def _survey(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): training counts of locally frequent words; and under null the
    sums tokens, training tokens, training texts, bytes (kinds 1 to 4)."""
    for batch in parts:
        counts: dict[bytes, int] = {}
        sums = [0, 0, 0, 0]
        for text, train in zip(batch.column(0), batch.column(1)):
            raw = text.as_py()
            words = raw.lower().split()
            sums[0] += len(words) + 1
            sums[3] += len(raw)
            if train.as_py():
                sums[1] += len(words) + 1
                sums[2] += 1
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            if len(counts) > 400_000:
                yield from _frequent(counts)
                counts = {}
        yield from _frequent(counts)
        yield pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4], pa.int32()), pa.array([0] * 4, pa.int64()), pa.array(sums, pa.int64())], names=["kind", "word", "n"])


def _frequent(counts: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    least = max(2, sum(counts.values()) // (2 * HEAVY))
    top = [(xxhash.xxh64_intdigest(w), n) for w, n in counts.items() if n >= least]
    if top:
        words, n = zip(*top)
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(n), pa.int32()), pa.array(np.array(words, np.uint64).astype(np.int64)), pa.array(n, pa.int64())], names=["kind", "word", "n"])


def _rows(parts: Iterator[pa.RecordBatch]):
    for part in parts:
        for row in zip(*part.columns):
            yield tuple(x.as_py() for x in row)


def _messages(plan: Plan):
    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part in parts_of(_rows(parts), plan):
            for shard, contexts, sizes, successors, counts in part.messages():
                row = [0, shard, chunk, contexts.astype("<u8").tobytes(), small(sizes), packed(successors, SUCCESSOR_BITS // 8), small(counts)]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4))], names=NAMES)

    return step


def merge(messages) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, pointers, successors and counts of all messages of a shard,
    without what no training text has."""
    contexts = np.concatenate([np.repeat(c, s) for c, s, _, _ in messages])
    successors = np.concatenate([m[2] for m in messages])
    counts = np.concatenate([m[3] for m in messages])
    seen = counts > 0
    contexts, successors, counts = contexts[seen], successors[seen], counts[seen]
    order = np.lexsort((successors, contexts))
    contexts, successors, counts = contexts[order], successors[order], counts[order]
    new = np.ones(len(contexts), bool)
    new[1:] = (contexts[1:] != contexts[:-1]) | (successors[1:] != successors[:-1])
    first = np.flatnonzero(new)
    counts = np.add.reduceat(counts, first) if len(first) else counts
    contexts, successors = contexts[first], successors[first]
    head = np.ones(len(contexts), bool)
    head[1:] = contexts[1:] != contexts[:-1]
    return contexts[head], np.append(np.flatnonzero(head), len(contexts)), successors, counts


def _answers(heavy: frozenset[int]):
    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard. Kind 1: an answer; 2: totals of a heavy
        context (place: its hash); 3: number of other contexts seen."""
        types = (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4)

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types)], names=NAMES)

        def solve(shard: int, asked: list):
            messages = [(c, s, u, n) for _, c, s, u, n in asked]
            with tempfile.TemporaryDirectory() as folder:  # the task's own scratch for its mapped levels
                contexts, pointers, successors, counts = merge(messages)
                trie = Trie.build(folder, contexts, pointers, successors, counts)
                is_heavy = np.isin(contexts, np.array(sorted(heavy), np.uint64))
                for h, total, kinds in zip(contexts[is_heavy].tolist(), trie.total[is_heavy].tolist(), trie.kinds[is_heavy].tolist()):
                    yield row(2, h - (1 << 64) if h >= 1 << 63 else h, 0, None, np.array([total, kinds], "<i8").tobytes(), None, None)
                yield row(3, int((~is_heavy & (contexts != START)).sum()), 0, None, None, None, None)
                for part, c, s, u, _ in asked:
                    total, kinds, codes = trie.ask(c, s, u)
                    yield row(1, shard, part, None, squeezed(small(total)), squeezed(small(kinds)), squeezed(codes.astype("<u2").tobytes()))

        at, asked = None, []
        for batch in parts:
            for _, shard, part, c, s, u, n in zip(*[x.to_pylist() for x in batch.columns]):
                if at is not None and shard != at:
                    yield from solve(at, asked)
                    asked = []
                at = shard
                contexts = np.frombuffer(c, "<u8")
                successors = unpacked(u, SUCCESSOR_BITS // 8)
                asked.append((part, contexts, unsmall(s, len(contexts)), successors, unsmall(n, len(successors))))
        if asked:
            yield from solve(at, asked)

    return step


@dataclass
class Totals:
    tokens: int
    texts: int
    words: int
    heavy: dict[int, tuple[int, int]]


def score_part(part: Part, answers: dict[int, tuple[bytes, bytes, bytes]], totals: Totals):
    """Per text: (tokens, known, base score, score)."""
    n = len(part.context)
    context_total, kinds, local = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    codes = np.zeros(n, np.uint16)
    at = 0
    for shard, contexts, sizes, successors, _ in part.messages():
        total, kind, code = (released(x) for x in answers[shard])
        if len(code) != 2 * len(successors):
            raise ValueError("answer to another question")
        b = at + len(successors)
        local[at:b] = np.repeat(unsmall(total, len(contexts)), sizes)
        kinds[at:b], codes[at:b] = np.repeat(unsmall(kind, len(contexts)), sizes), np.frombuffer(code, "<u2")
        at = b
    context_total[:] = local
    if totals.heavy:
        heavy = np.array(sorted(totals.heavy), np.uint64)
        facts = np.array([totals.heavy[int(h)] for h in heavy], np.int64)
        own, which = members(part.context, heavy)
        context_total[own], kinds[own] = facts[which, 0], facts[which, 1]
    safe = np.maximum(context_total, 1)
    higher = restored(codes) * local / safe
    rest = np.where(context_total > 0, DISCOUNT * kinds / safe, 1.0)
    count = np.zeros(len(part.hashes), np.int64)
    count[part.before] = context_total
    count[part.end] = totals.texts
    base = (count + 1) / (totals.tokens + totals.words + 1)
    p1 = base[part.token]
    scores = np.log10(higher[part.pair_of] + rest[part.pair_of] * p1)
    sizes = np.diff(part.ends, prepend=0)
    starts = part.ends - sizes
    sums = lambda x: np.add.reduceat(x, starts)
    return sizes, sums((count[part.token] > 0).astype(np.int64)), sums(np.log10(p1)), sums(scores)


def _scores(plan: Plan, totals: Totals, id_col: str):
    names = [id_col, "held_out", "n_tokens", "n_known", "base_score", "score"]

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by chunk, the answers of a chunk ahead of its texts."""
        answers: dict[int, dict[int, tuple]] = {}

        def texts():
            for chunk, kind, shard, one, two, three, four in _rows(parts):
                if kind == 0:
                    answers.setdefault(chunk, {})[shard] = (one, two, three)
                else:
                    yield chunk, one, two, three, four

        for chunk, part in parts_of(texts(), plan):
            n, known, base, score = score_part(part, answers.pop(chunk), totals)
            rows = np.repeat(np.arange(len(part.ids)), part.repeats)
            for i in range(0, len(rows), 50_000):
                r = rows[i : i + 50_000]
                columns = [pa.array([part.ids[k] for k in r], pa.int64()), pa.array([not part.trains[k] for k in r]), *(pa.array(c[r]) for c in (n, known, base, score))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return step


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 7, held_fold: int = 2) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score per row.

    The model learns from the rows whose crc32 of the id modulo ``fold`` is not
    ``held_fold``. Null texts are empty (one end token), a null id counts as
    empty text for its remainder. Rows that repeat are texts of their own.
    Without training rows every token has probability one in the base.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("text"), (remainder(id_col, fold) != held_fold).alias("train"))
    survey = held(rows.select("text", "train").mapInArrow(_survey, "kind int, word long, n long"))
    sums = {r["kind"]: r["n"] for r in survey.where("kind > 0").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    tokens, train_tokens, texts, size = (sums.get(k, 0) for k in (1, 2, 3, 4))
    heavy = survey.where("kind = 0").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") * 2 * HEAVY >= tokens)
    heavy = {r["word"] % (1 << 64): r["n"] for r in heavy.collect()}  # at most 2 * HEAVY words
    heavy[int(START)] = docs.count()
    shards = tokens // SHARD_TOKENS + 1
    spread = {h: 2 * n // SHARD_TOKENS + 1 for h, n in heavy.items()}
    plan = Plan(shards, {h: min(k, shards) for h, k in spread.items() if min(k, shards) > 1})
    split = frozenset(plan.spread)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = size // CHUNK_BYTES + 1
    dealt = rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).alias("chunk"), "id", "text", "train").mapInArrow(_pack, PACKED)
    asking = dealt.repartition(parts, "chunk").sortWithinPartitions("chunk")
    messages = asking.mapInArrow(_messages(plan), MESSAGE).repartition(parts, "place").sortWithinPartitions("place", "part")
    answers = held(messages.mapInArrow(_answers(split), MESSAGE))
    facts = answers.where("kind = 2").select("place", "sizes").collect()  # heavy contexts times their shards
    heavy_totals: dict[int, tuple[int, int]] = {}
    for r in facts:
        total, kinds = np.frombuffer(r["sizes"], "<i8").tolist()
        h = r["place"] % (1 << 64)
        a, b = heavy_totals.get(h, (0, 0))
        heavy_totals[h] = (a + total, b + kinds)
    words = answers.where("kind = 3").agg(F.sum("place")).first()[0] or 0
    words += sum(1 for h in heavy_totals if h != int(START)) + (texts > 0)
    totals = Totals(train_tokens, texts, words, heavy_totals)

    # In one table, sorted by chunk: (chunk, 0, shard, answer) and (chunk, 1, null, packed texts).
    one = answers.where("kind = 1").select(
        F.col("part").alias("chunk"), F.lit(0).alias("kind"), F.col("place").alias("shard"),
        F.col("sizes").alias("one"), F.col("successors").alias("two"), F.col("counts").alias("three"), F.lit(None).cast("binary").alias("four"))
    two = dealt.select("chunk", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("shard"), F.col("ids").alias("one"), F.col("sizes").alias("two"), F.col("trains").alias("three"), F.col("texts").alias("four"))
    met = one.unionByName(two).repartition(parts, "chunk").sortWithinPartitions("chunk", "kind")
    schema = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = met.mapInArrow(_scores(plan, totals, id_col), schema)
    return out.select(id_col, "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
