"""SentencePiece encoding and decoding: Viterbi over a double-array trie.

A vocabulary file gives pieces and log scores; nothing is trained. Texts get a
leading space and spaces become the white-space marker, so that decoding is the
concatenation of the pieces. Characters without a piece become byte pieces.
Encoding then decoding gives back every text, also one that holds the marker
itself (it is written in byte pieces).

Pieces have the marker only at their start, so the best path of a text is the
best paths of its units (spaces and the word behind them), each solved once per
task. All new units of a slice of texts are solved together: position by
position, every unit's automaton state is one element of an array.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.llm.common import text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNSEEN = 10.0  # below the lowest score, as the format's own decoder takes it
SLICE_CHARS = 1 << 20
CACHED_UNITS = 300_000
LONG_UNIT = 48


class DoubleArray:
    """Trie over bytes: the child of s by c is base[s] + c, if check there is s."""

    def __init__(self, keys: list[bytes], values: list[int]) -> None:
        order = sorted(range(len(keys)), key=keys.__getitem__)
        keys, values = [keys[i] for i in order], [values[i] for i in order]
        room = 1 << 16
        base, check, value, used = [0] * room, [-1] * room, [-1] * room, bytearray(room)
        used[0], first = 1, 1
        stack = [(0, 0, len(keys), 0)]
        while stack:
            node, lo, hi, depth = stack.pop()
            while lo < hi and len(keys[lo]) == depth:
                value[node] = values[lo]
                lo += 1
            if lo == hi:
                continue
            cuts, codes = [], []
            for i in range(lo, hi):
                if not codes or keys[i][depth] != codes[-1]:
                    cuts.append(i)
                    codes.append(keys[i][depth])
            cuts.append(hi)
            at = max(first, codes[0] + 1)
            while True:
                at = used.find(0, at)
                if at < 0 or at + 256 >= room:
                    grow = room
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
                    used += bytearray(grow)
                    room += grow
                    at = max(at, 1) if at >= 0 else room - grow
                    continue
                if not any(used[at - codes[0] + c] for c in codes):
                    break
                at += 1
            base[node] = at - codes[0]
            for c, a, b in zip(codes, cuts, cuts[1:]):
                child = base[node] + c
                used[child], check[child] = 1, node
                stack.append((child, a, b, depth + 1))
            first = used.find(0, first)
        pad = [-1] * 256
        self.base = np.array(base + [0] * 256, np.int32)
        self.check = np.array(check + pad, np.int32)
        self.value = np.array(value + pad, np.int32)


@dataclass
class Pieces:
    """Vocabulary: piece texts, their kinds and log scores by id."""

    texts: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown: int
    hidden: frozenset[int]

    def __post_init__(self) -> None:
        plain = [i for i in range(len(self.texts)) if i not in self.hidden and i != self.unknown and i not in set(self.byte_ids.tolist())]
        spans = [self.texts[i] for i in plain]
        if any(MARK in s.lstrip(MARK) for s in spans):
            raise ValueError("a piece has the white-space marker behind other characters")
        self.trie = DoubleArray([s.encode() for s in spans], plain)
        self.longest = max(len(s.encode()) for s in spans)
        self.unseen = float(self.scores[plain].min()) - UNSEEN
        joined = "".join(s for s in spans if len(s) > 1)
        self.alone = "".join(c for c in "\n\t\r" if c not in joined)
        self.units = re.compile(f"[{self.alone}{MARK}]| *[^ {self.alone}{MARK}]+| +")
        self.bytes_of = [s.replace(MARK, " ").encode() for s in self.texts]
        for i in self.hidden:
            self.bytes_of[i] = b""
        for b, i in enumerate(self.byte_ids.tolist()):
            if i >= 0:
                self.bytes_of[i] = bytes([b])
        self.sizes_of = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.starts_of = np.cumsum(self.sizes_of) - self.sizes_of
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def solve(self, units: list[bytes]) -> list[list[int]]:
        """Best piece ids of each unit (bytes with markers in place of spaces)."""
        found: list[list[int]] = [[] for _ in units]
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(lengths, kind="stable")
        start = int(np.searchsorted(lengths[order], 1))
        while start < len(order):
            longest = int(lengths[order[start]])
            if longest > LONG_UNIT:
                for i in order[start:].tolist():
                    found[i] = self._solve_one(units[i])
                break
            limit = min(LONG_UNIT, longest + 3)
            end = min(int(np.searchsorted(lengths[order], limit, "right")), start + 50_000)
            part = order[start:end]
            for i, ids in zip(part.tolist(), self._solve_many([units[i] for i in part], lengths[part])):
                found[i] = ids
            start = end
        return found

    def _solve_many(self, units: list[bytes], lengths: np.ndarray) -> list[list[int]]:
        n, width = len(units), int(lengths.max())
        text = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in units), np.uint8).reshape(n, width).astype(np.int32)
        char = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        came = np.zeros((n, width + 1), np.int32)
        piece = np.full((n, width + 1), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for s in range(width):
            rows = np.flatnonzero((best[:, s] > -np.inf) & (lengths > s))
            whole = np.zeros(n, bool)  # rows with a piece for the character at s alone
            live, state = rows, np.zeros(len(rows), np.int32)
            for k in range(s, min(width, s + self.longest)):
                at = base[state] + text[live, k]
                ok = (check[at] == state) & (lengths[live] > k)
                live, state = live[ok], at[ok]
                if not len(live):
                    break
                ids = value[state]
                ends = ids >= 0
                r, ids = live[ends], ids[ends]
                new = best[r, s] + self.scores[ids]
                better = new > best[r, k + 1]
                r2 = r[better]
                best[r2, k + 1], came[r2, k + 1], piece[r2, k + 1] = new[better], s, ids[better]
                whole[r[char[r, s] == k + 1 - s]] = True
            r = rows[~whole[rows]]
            to = np.minimum(s + char[r, s], lengths[r])
            new = best[r, s] + self.unseen
            better = new > best[r, to]
            r, to = r[better], to[better]
            best[r, to], came[r, to], piece[r, to] = new[better], s, -1
        out: list[list[int]] = []
        came_rows, piece_rows = came.tolist(), piece.tolist()
        for i, u in enumerate(units):
            out.append(self._trace(u, came_rows[i], piece_rows[i]))
        return out

    def _solve_one(self, unit: bytes) -> list[int]:
        n = len(unit)
        best, came, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        for s in range(n):
            if best[s] == -np.inf:
                continue
            lead = unit[s]
            char = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            state, whole = 0, False
            for k in range(s, min(n, s + self.longest)):
                at = int(base[state]) + unit[k]
                if check[at] != state:
                    break
                state, i = at, int(value[at])
                if i >= 0:
                    new = best[s] + float(scores[i])
                    whole |= k + 1 - s == char
                    if new > best[k + 1]:
                        best[k + 1], came[k + 1], piece[k + 1] = new, s, i
            if not whole and best[s] + self.unseen > best[s + char]:
                best[s + char], came[s + char], piece[s + char] = best[s] + self.unseen, s, -1
        return self._trace(unit, came, piece)

    def _trace(self, unit: bytes, came: list[int], piece: list[int]) -> list[int]:
        ids, at = [], len(unit)
        while at > 0:
            s, i = came[at], piece[at]
            ids += [i] if i >= 0 else self._fallback(unit[s:at])[::-1]
            at = s
        return ids[::-1]

    def _fallback(self, raw: bytes) -> list[int]:
        ids = [int(self.byte_ids[b]) for b in raw]
        return ids if min(ids) >= 0 else [self.unknown]

    def encoder(self):
        """A function from text to an array of ids, with a memory of units."""
        known: dict[str, int] = {}
        flat, starts, sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def learn(units: list[str]) -> None:
            nonlocal flat, starts, sizes
            if len(known) > CACHED_UNITS:
                known.clear()
                flat, starts, sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
            new = [u for u in dict.fromkeys(units) if u not in known]
            if not new:
                return
            plain = [u for u in new if u != MARK]
            ids = self.solve([u.replace(" ", MARK).encode("utf-8", "surrogatepass") for u in plain])
            if len(plain) < len(new):
                plain.append(MARK)
                ids.append(self._fallback(MARK.encode()))
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            more = np.fromiter((i for row in ids for i in row), np.int32, int(count.sum()))
            starts = np.concatenate((starts, len(flat) + np.cumsum(count) - count))
            sizes, flat = np.concatenate((sizes, count)), np.concatenate((flat, more))
            at = len(known)
            known.update((u, at + i) for i, u in enumerate(plain))

        def encode(texts: list[str]) -> list[np.ndarray]:
            split = [self.units.findall(f" {t}") if t else [] for t in texts]
            units = [u for row in split for u in row]
            learn(units)
            rows = np.fromiter((known[u] for u in units), np.int64, len(units))
            size = sizes[rows]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            out = flat[np.repeat(starts[rows] - ends + size, size) + np.arange(total)]
            per_text = np.cumsum([len(row) for row in split])
            cuts = np.concatenate(([0], ends))[per_text][:-1] if len(split) else []
            return np.split(out, cuts)

        def sliced(texts: list[str]) -> list[np.ndarray]:
            """Long texts in parts that end at a word, to bound the memory."""
            out = []
            for t in texts:
                if len(t) <= SLICE_CHARS:
                    out.append(encode([t])[0])
                    continue
                parts, at = [], 0
                while at < len(t):
                    end = min(len(t), at + SLICE_CHARS)
                    m = re.compile(r"(?<=[^ ]) (?=[^ ])").search(t, end) if end < len(t) else None
                    end = m.start() if m else len(t)
                    parts.append(encode([t[at:end]])[0])
                    at = end + 1  # the next part's leading space is its own
                out.append(np.concatenate(parts))
            return out

        def run(texts: list[str]) -> list[np.ndarray]:
            return encode(texts) if sum(map(len, texts)) <= SLICE_CHARS * 2 else sliced(texts)

        return run

    def decode(self, ids) -> str:
        return self.decode_many(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0]

    def decode_many(self, flat: np.ndarray, cuts: np.ndarray) -> list[str]:
        """The texts of flat[cuts[0]:cuts[1]], flat[cuts[1]:cuts[2]], ...: the
        bytes of all pieces are gathered at once."""
        size = self.sizes_of[flat]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.all_bytes[np.repeat(self.starts_of[flat] - ends + size, size) + np.arange(total)].tobytes()
        places = np.concatenate(([0], ends))[cuts].tolist()
        parts = (raw[a:b] for a, b in zip(places, places[1:]))
        return [(p[1:] if p[:1] == b" " else p).decode("utf-8", "replace") for p in parts]


def load(path: str = MODEL, scores: str = "rank") -> Pieces:
    """The vocabulary at ``path``.

    ``scores="stored"`` takes the file's numbers as log scores. Files of merge
    order hold minus the rank there; ``"rank"`` turns rank r into log
    probabilities of Zipf's law, -log(r + 1) - log H. Pieces without a rank
    (stored as -1e9) come last.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    stored = np.array([model.get_score(i) for i in range(n)])
    if scores == "rank":
        ranks = np.where(stored < -n, n, -stored)
        values = -np.log(ranks + 1) - np.log((1 / np.arange(1, n + 1)).sum())
    else:
        values = stored
    byte_ids = np.full(256, -1, np.int32)
    hidden = set()
    for i in range(n):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[1:-1], 16)] = i
        elif model.is_control(i) or model.is_unused(i):
            hidden.add(i)
    return Pieces([model.id_to_piece(i) for i in range(n)], values, byte_ids, model.unk_id(), frozenset(hidden))


def _texts(part: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    """Slices of a batch of about SLICE_CHARS characters."""
    texts, size, start = [], 0, 0
    for i, t in enumerate(part.column(part.schema.get_field_index(column))):
        text = t.as_py() or ""
        texts.append(text)
        size += len(text)
        if size >= SLICE_CHARS:
            yield start, texts
            texts, size, start = [], 0, i + 1
    if texts:
        yield start, texts


def encode(docs: DataFrame, pieces: Pieces, text_col: str = "text") -> DataFrame:
    """``docs`` with ids, n_tokens, n_byte_tokens and round_trip.

    ``round_trip`` tells if decoding the ids gives the text. A null or empty
    text has no ids. Columns of the input with one of these names are replaced.
    """
    names = ["ids", "n_tokens", "n_byte_tokens", "round_trip"]
    rows = docs.drop(*[n for n in names if n != text_col])

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pieces.encoder()  # the vocabulary travels with the step; its size is that of the file
        is_byte = np.zeros(len(pieces.texts), bool)
        is_byte[pieces.byte_ids[pieces.byte_ids >= 0]] = True
        for part in parts:
            for start, texts in _texts(part, text_col):
                found = run(texts)
                flat = np.concatenate(found)
                ends = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
                seen = np.concatenate(([0], np.cumsum(is_byte[flat])))
                same = [a == t for a, t in zip(pieces.decode_many(flat, ends), texts)]
                columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32))), pa.array(np.diff(ends).astype(np.int64)),
                           pa.array(seen[ends[1:]] - seen[ends[:-1]], pa.int64()), pa.array(same)]
                own = part.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*own.columns, *columns], names=[*own.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(step, f"{fields}, ids array<int>, n_tokens long, n_byte_tokens long, round_trip boolean")


def decode(rows: DataFrame, pieces: Pieces, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of the ids; null ids give null."""

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(0, part.num_rows, 256):
                own = part.slice(i, 256)
                ids = own.column(own.schema.get_field_index(ids_col))
                there = ids.is_valid().to_numpy(zero_copy_only=False)
                cuts = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())))
                texts = [t if ok else None for t, ok in zip(pieces.decode_many(ids.flatten().to_numpy().astype(np.int64), cuts), there)]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(texts, pa.string())], names=[*own.schema.names, "decoded"])

    rows = rows.drop("decoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(step, f"{fields}, decoded string")


def round_trip(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, n_tokens, n_byte_tokens, decoded_sha256 and round_trip of whole texts."""
    rows = docs.select(F.col(id_col), text_of(text_col).alias("text__"))
    back = decode(encode(rows, pieces, "text__").drop("text__"), pieces)
    return back.select(id_col, "ids", "n_tokens", "n_byte_tokens", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "round_trip")
