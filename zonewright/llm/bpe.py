"""Byte-level BPE encoding and decoding over overlapping chunks.

Texts that fit one chunk are pre-tokenised and encoded where they are scanned.
Longer texts are cut into chunks that overlap. Chunks are dealt over all tasks
and pre-tokenised each from its own start. Two neighbours that have a boundary
in common, within the overlap, agree from there on, since a match depends only
on what stands behind its start; the first such boundary is the seam. A chunk
without a seam to its predecessor (one run of letters may be longer than the
overlap) is read together with it. Pieces between seams are then encoded, and
ids put in order of their chunks. Decoding concatenates raw bytes.

The vocabulary is a file of ranks, nothing is trained. The pattern must match
every character and must not look behind its start.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.llm.common import held, join_spread, text_of

CHUNK = 1 << 16
OVERLAP = 1 << 10
AHEAD = 3  # characters a match may look at behind its start before it has an end of its own
SLICE_CHARS = 1 << 20
CACHED_CHARS = 4_000_000
LONG_PIECE = 64


@dataclass
class Vocabulary:
    """Ranks by token bytes, and the pattern of pre-tokens."""

    ranks: dict[bytes, int]
    pattern: str

    def __post_init__(self) -> None:
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"bytes without a rank: {missing}")
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for raw, i in self.ranks.items():
            tokens[i] = raw
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)

        # The pairs of tokens that merge, as numbers in order, and the rank of what they become.
        self.many = len(tokens) + 1
        pairs = {self.ranks[t[:i]] * self.many + self.ranks[t[i:]]: r for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[x] for x in self.pairs.tolist()], np.int64)

    def ids_of(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens: the pair of least rank merges first, of equal
        ones the leftmost."""
        found: list[list[int]] = [[self.ranks[p]] if p in self.ranks else [] for p in pieces]
        left = sorted((i for i, ids in enumerate(found) if not ids and pieces[i]), key=lambda i: len(pieces[i]))
        for start in range(0, len(left), 20_000):
            part = [i for i in left[start : start + 20_000] if len(pieces[i]) <= LONG_PIECE]
            for i, ids in zip(part, self._merged_together([pieces[i] for i in part])):
                found[i] = ids
        for i in left:
            if len(pieces[i]) > LONG_PIECE:
                found[i] = self._merged_by_heap(pieces[i])
        return found

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What pairs become, or a number beyond all ranks."""
        keys = a * self.many + b
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.merged[at], self.many) if len(self.pairs) else np.full(keys.shape, self.many)

    def _merged_together(self, pieces: list[bytes]) -> list[list[int]]:
        """One merge of every piece at a time: a row per piece, its parts ahead of fillers."""
        out: list[list[int]] = [[] for _ in pieces]
        if not pieces:
            return out
        width, filler = max(map(len, pieces)) + 1, self.many - 1
        of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.full((len(pieces), width), filler, np.int64)
        ids[np.arange(width) < sizes[:, None]] = of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self._ranks_of(ids[:, :-1], ids[:, 1:])
        rows, columns = np.arange(len(pieces)), np.arange(width)
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            going = best < self.many
            if not going.all():
                for i, row, size in zip(rows[~going].tolist(), ids[~going].tolist(), sizes[~going].tolist()):
                    out[i] = row[:size]
                rows, ids, ranks, sizes, at, best = rows[going], ids[going], ranks[going], sizes[going], at[going], best[going]
            n, sizes = np.arange(len(rows)), sizes - 1
            behind = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, behind, 1)
            ids[n, at] = best
            ids[n, sizes] = filler
            ranks = np.take_along_axis(ranks, np.minimum(behind[:, :-1], width - 2), 1)
            ranks[n, sizes] = self.many
            ranks[n, at] = self._ranks_of(best, ids[n, at + 1])
            before = np.maximum(at - 1, 0)
            ranks[n, before] = np.where(at > 0, self._ranks_of(ids[n, before], best), ranks[n, before])
        return out

    def _merged_by_heap(self, piece: bytes) -> list[int]:
        """The same for long pieces, in n log n steps."""
        rank, n = self.ranks.get, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of part starts
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]  # -1 once the part at i is gone
            if j < 0 or j >= n or after[j] != end:
                continue
            after[i], after[j] = end, -1
            if end < n:
                before[end] = i
                if (r := rank(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := rank(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encoder(self):
        """A function from pre-tokens to (flat ids, ids per pre-token), with a
        bounded memory of the pre-tokens met."""
        known: dict[str, int] = {}
        flat, starts, sizes, chars = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def run(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            nonlocal flat, starts, sizes, chars
            if chars > CACHED_CHARS:
                known.clear()
                flat, starts, sizes, chars = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
            new = [p for p in dict.fromkeys(pieces) if p not in known]
            if new:
                ids = self.ids_of([p.encode() for p in new])
                count = np.fromiter(map(len, ids), np.int64, len(ids))
                starts = np.concatenate((starts, len(flat) + np.cumsum(count) - count))
                sizes = np.concatenate((sizes, count))
                flat = np.concatenate((flat, np.fromiter((i for row in ids for i in row), np.int32, int(count.sum()))))
                at = len(known)
                known.update((p, at + i) for i, p in enumerate(new))
                chars += sum(map(len, new))
            rows = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
            size = sizes[rows]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            return flat[np.repeat(starts[rows] - ends + size, size) + np.arange(total)], size

        return run

    def decode_many(self, flat: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """Raw bytes of flat[cuts[0]:cuts[1]], flat[cuts[1]:cuts[2]], ..."""
        size = self.sizes[flat]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.raw[np.repeat(self.starts[flat] - ends + size, size) + np.arange(total)].tobytes()
        places = np.concatenate(([0], ends))[cuts].tolist()
        return [raw[a:b] for a, b in zip(places, places[1:])]


def load(path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """Ranks from a file of base64 tokens and numbers, one pair per line; the
    public 50k vocabulary and its pattern by default."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    lines = (line.split() for line in Path(path).read_bytes().splitlines())
    return Vocabulary({base64.b64decode(a): int(b) for a, b in filter(None, lines)}, pattern)


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows with about SLICE_CHARS characters."""
    run, size, start = [], 0, 0
    for i, t in enumerate(texts):
        run.append(t.as_py())
        size += len(run[-1])
        if size >= SLICE_CHARS:
            yield start, run
            run, size, start = [], 0, i + 1
    if run:
        yield start, run


def _encoded(rows: DataFrame, vocabulary: Vocabulary, text: str, stop: str | None = None) -> DataFrame:
    """``rows`` without the text (and ``stop``), with its ids. ``stop`` is where the ids end, in
    characters; what stands behind it is there for the pattern to look at."""
    rest = [c for c in rows.columns if c not in (text, stop)]

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, ids_of = regex.compile(vocabulary.pattern).findall, vocabulary.encoder()
        for part in parts:
            stops = part.column(part.schema.get_field_index(stop)).to_pylist() if stop else None
            for start, texts in _slices(part.column(part.schema.get_field_index(text))):
                per_text = [split(t) for t in texts]
                if stops:
                    per_text = [_up_to(p, s) for p, s in zip(per_text, stops[start : start + len(texts)])]
                flat, sizes = ids_of([p for row in per_text for p in row])
                cuts = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0] + [len(row) for row in per_text])]
                own = part.slice(start, len(texts)).select(rest)
                ids = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*own.columns, ids], names=[*rest, "ids"])

    return rows.mapInArrow(step, f"{_fields(rows.select(rest))}ids array<int>")


def _up_to(pieces: list[str], stop: int | None) -> list[str]:
    if stop is None:
        return pieces
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    at = int(np.searchsorted(ends, stop))
    if stop and (at == len(ends) or ends[at] != stop):
        raise ValueError("the pattern does not find the seam of two chunks again; it must not look behind its start")
    return pieces[: at + 1] if stop else []


def chunks(texts: DataFrame, key: str, text: str, chunk: int, overlap: int) -> DataFrame:
    """(key, k, last, part): overlapping parts of long texts, dealt over all tasks, those of equal texts once."""

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, value in zip(part.column(0), part.column(1)):
                value = value.as_py()
                count = max(1, -(-(len(value) - overlap) // chunk))
                for k in range(count):
                    columns = [[name.as_py()], [k], [k == count - 1], [value[k * chunk : (k + 1) * chunk + overlap]]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    names, kinds = ["key", "k", "last", "part"], [pa.string(), pa.int64(), pa.bool_(), pa.string()]
    cut = texts.select(key, text).mapInArrow(step, "key string, k long, last boolean, part string")
    return cut.groupBy("key", "k").agg(F.first("last").alias("last"), F.first("part").alias("part"))


def _zones(parts: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(key, k, head, tail): what the chunk k and the one before it say about
    boundaries near the start of chunk k, counted from that start."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        for batch in batches:
            rows: list[tuple] = []
            for key, k, last, part in zip(*(batch.column(i) for i in range(4))):
                key, k, last, part = key.as_py(), k.as_py(), last.as_py(), part.as_py()
                ends = np.cumsum([0, *map(len, split(part))])
                if not last:  # what touches the end of the chunk may go on behind it
                    ends = ends[:1].tolist() + ends[1:][(ends[1:] < len(part)) & (ends[:-1] + AHEAD <= len(part))].tolist()
                ends = np.asarray(ends)
                if k:
                    rows.append((key, k, ends[ends <= overlap].tolist(), None))
                if not last:
                    rows.append((key, k + 1, None, (ends[ends >= chunk] - chunk).tolist()))
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["key", "k", "head", "tail"])

    return parts.mapInArrow(step, "key string, k long, head array<long>, tail array<long>")


def _long_ids(texts: DataFrame, vocabulary: Vocabulary, key: str, text: str, chunk: int, overlap: int) -> DataFrame:
    """(key, ids, copies) of the distinct texts among ``texts``."""
    parts = held(chunks(texts, key, text, chunk, overlap))
    zones = _zones(parts, vocabulary.pattern, chunk, overlap).groupBy("key", "k").agg(F.first("head", True).alias("head"), F.first("tail", True).alias("tail"))
    seams = zones.select("key", "k", F.array_min(F.array_intersect("head", "tail")).alias("seam"))
    rows = parts.join(seams, ["key", "k"], "left").withColumn("seam", F.when(F.col("k") == 0, 0).otherwise(F.col("seam")))
    # The chunks of a text: as many as its characters allow, so their windows are bounded by the longest text.
    places = rows.select("key", "k", "seam", "last")
    by_text = "PARTITION BY key ORDER BY k"
    places = places.select(
        "key", "k", F.expr(f"last(CASE WHEN seam IS NOT NULL THEN k END, true) OVER ({by_text})").alias("owner"),
        F.expr(f"lead(seam) OVER ({by_text})").alias("next"), "last",
    )
    spans = rows.select("key", "k", "part", "seam").join(places, ["key", "k"])
    # A chunk adds its own part up to the next chunk; the last of a run also what the pattern may look at.
    ends_run = F.col("last") | F.col("next").isNotNull()
    own = F.when(ends_run, F.col("part")).otherwise(F.substring("part", 1, chunk))
    spans = spans.select("key", "owner", "k", own.alias("own"), "seam", "next", "last")
    runs = spans.groupBy("key", "owner").agg(
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("k", "own"))), lambda x: x["own"])).alias("own"),
        F.max(F.when(F.col("k") == F.col("owner"), F.col("seam"))).alias("from"),
        F.max(F.when(~F.col("last") & F.col("next").isNotNull(), (F.col("k") + 1 - F.col("owner")) * chunk + F.col("next"))).alias("to"),
    )
    runs = runs.select("key", "owner", F.expr("substring(own, CAST(`from` AS INT) + 1)").alias("own"), (F.col("to") - F.col("from")).alias("stop"))
    ids = _encoded(runs, vocabulary, "own", "stop")
    return ids.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("owner", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` without the text, with ``ids`` and ``n_tokens``.

    A null or empty text has no ids. Repeated rows stay repeated; a long text
    is encoded once however often it stands there. Other columns may have any
    name; ``ids`` and ``n_tokens`` are replaced. Strings of special tokens are
    ordinary text.
    """
    if not AHEAD <= overlap < chunk:
        raise ValueError(f"an overlap takes {AHEAD} characters at least and a chunk more than that")
    given = docs.drop(*[c for c in ("ids", "n_tokens") if c != text_col])
    names = [c for c in given.columns if c != text_col]
    rows = given.select(F.struct(F.lit(0).alias("row__"), *[F.col(f"`{c}`") for c in names]).alias("row"), text_of(text_col).alias("text"))
    is_long = F.char_length("text") > chunk + overlap
    short = _encoded(rows.where(~is_long), vocabulary, "text")
    keyed = rows.where(is_long).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    facts = _long_ids(keyed, vocabulary, "key", "text", chunk, overlap)
    long = join_spread(keyed.drop("text"), facts, "key").select("row", "ids")
    out = short.unionByName(long)
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], "ids", F.size("ids").cast("long").alias("n_tokens"))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the bytes of the ids; null ids give null. An
    id that the vocabulary lacks raises an error."""

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(0, part.num_rows, 256):
                own = part.slice(i, 256)
                ids = own.column(own.schema.get_field_index(ids_col))
                there = ids.is_valid().to_numpy(zero_copy_only=False)
                cuts = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())))
                raw = [b if ok else None for b, ok in zip(vocabulary.decode_many(ids.flatten().to_numpy(), cuts), there)]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(raw, pa.binary())], names=[*own.schema.names, "decoded"])

    rows = rows.drop("decoded")
    return rows.mapInArrow(step, f"{_fields(rows)}decoded binary")


def digests(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of whole texts."""
    back = decode(encode(docs.select(id_col, text_col), vocabulary, text_col), vocabulary)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return back.select(id_col, "n_tokens", F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
