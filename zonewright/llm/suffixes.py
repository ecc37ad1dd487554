"""Suffix-array deduplication of repeated byte strings, by deep-shallow sorting.

A byte goes if some string of ``LENGTH`` bytes over it also starts elsewhere,
in the same document or another. Sorting every suffix of a corpus would move
hundreds of bytes per byte, so suffixes are sorted at anchors only: the anchor
of a string is the place of its least gram hash. Equal strings have equal
anchors at equal places, so comparing the surroundings of anchors with the same
gram decides every string, exactly:

1. Anchors of all texts; a gram that occurs once in the corpus ends there.
2. For the others, each anchor's surroundings (all strings it is anchor of) go
   to the task of its gram. What lies right of the anchor and, reversed, what
   lies left of it are two suffix sets; each is put in order by multikey
   quicksort down to a shallow depth and by blind tries below, which also
   gives the common prefixes of neighbours. A string is d bytes left and
   LENGTH - d bytes right of its anchor: two strings are equal if they are in
   the same class of either order at these depths.
3. Covered stretches return to their documents.

Hot grams: within a task equal surroundings are one row, and grams with over
1/``HOT`` of all anchors (fewer than 2 * HOT, so a bounded list) are spread by
more of their surroundings, one narrow band of strings per row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.llm.common import held, text_of

LENGTH = 200
GRAM = 48
SHALLOW = 16
SMALL = 24
HOT = 4096
BAND = 24
PIECE = 4 << 20
PLACE = np.uint64((1 << 24) - 1)
ODD = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * j & (1 << 64) - 1 | 1) for j in range(64)]


# ---- anchors


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a multiple of 8) from each place."""
    n = len(data) - gram + 1
    padded = np.concatenate((data, np.zeros(16, np.uint8))).tobytes()
    words = np.empty(len(data), np.uint64)
    for o in range(8):
        part = words[o::8]
        part[:] = np.frombuffer(padded, "<u8", len(part), o)
    h = np.zeros(n, np.uint64)
    for j in range(gram // 8):
        h += words[8 * j : 8 * j + n] * ODD[j]
    h ^= h >> np.uint64(29)
    h *= ODD[20]
    h ^= h >> np.uint64(32)
    return h * ODD[21]


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width``, from running minima of blocks."""
    n = len(x) - width + 1
    blocks = np.concatenate((x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Anchors:
    """Anchors of a run of texts: arrays text, place, low, high (first and last
    string start with this anchor) and gram, with places inside the text."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> None:
        found = []
        pieces: list[tuple[int, int, bytes]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if pieces:
                found.append(self._of(pieces, length, gram))
            pieces.clear()
            size = 0

        for i, t in enumerate(texts):
            if len(t) < length:
                continue
            for start in range(0, len(t) - length + 1, PIECE):
                part = t[start : start + PIECE + length - 1]
                pieces.append((i, start, part))
                size += len(part)
                if size >= PIECE:
                    flush()
        flush()
        empty = np.zeros(0, np.int64)
        self.text, self.place, self.low, self.high = (np.concatenate([f[k] for f in found]) if found else empty for k in range(4))
        self.gram = np.concatenate([f[4] for f in found]) if found else empty

    @staticmethod
    def _of(pieces, length: int, gram: int):
        data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        sizes = np.array([len(p[2]) for p in pieces])
        starts = np.cumsum(sizes) - sizes
        h = gram_hashes(data, gram)
        key = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        at = (window_min(key, length - gram + 1) & PLACE).astype(np.int64)
        ok = np.ones(len(at) + 1, bool)
        ok[-1] = False
        for s in (starts[1:] - length + 1).tolist():  # strings that would cross into the next piece
            ok[max(0, s) : s + length - 1] = False
        ok = ok[:-1]
        change = np.ones(len(at), bool)
        change[1:] = (at[1:] != at[:-1]) | ~ok[:-1]
        first = np.flatnonzero(change & ok)
        stop = np.concatenate((change | ~ok, [True]))
        ends = np.flatnonzero(stop)
        last = ends[np.searchsorted(ends, first, "right")] - 1
        piece = np.searchsorted(starts, first, "right") - 1
        shift = np.array([p[1] for p in pieces])[piece] - starts[piece]
        return np.array([p[0] for p in pieces])[piece], at[first] + shift, first + shift, last + shift, h[at[first]].astype(np.int64)


def whole_groups(parts: Iterator[pa.RecordBatch], key: str, least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of complete runs of equal ``key`` from sorted batches."""
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for part in parts:
        if not part.num_rows:
            continue
        waiting.append(part)
        rows += part.num_rows
        if rows >= least:
            table = pa.Table.from_batches(waiting)
            keys = table.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield table.slice(0, cut)
                waiting, rows = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
    if waiting:
        yield pa.Table.from_batches(waiting)


# ---- deep-shallow sorting


class BlindTrie:
    """Order of byte strings: inner nodes hold only a depth and branching bytes;
    an insertion goes down blindly, compares once with a leaf, and so finds its
    place. A string that ends is ahead of its continuations."""

    def __init__(self, strings: list[bytes], depth: int) -> None:
        self.strings, self.depth = strings, depth
        self.root = None  # leaf: list of string numbers; node: (depth, {byte: child}), byte -1 for an end

    def _byte(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def add(self, i: int) -> None:
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):
            node = node[1].get(self._byte(i, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[0]]
        own = self.strings[i]
        same = common(own, other, self.depth)
        if same == len(own) == len(other):
            node.append(i)
            return
        parent, branch, node = None, -1, self.root
        while isinstance(node, tuple) and node[0] < same:
            parent, branch = node, self._byte(i, node[0])
            node = node[1][branch]
        if isinstance(node, tuple) and node[0] == same:
            node[1][self._byte(i, same)] = [i]
            return
        some = node
        while isinstance(some, tuple):
            some = next(iter(some[1].values()))
        new = (same, {self._byte(some[0], same): node, self._byte(i, same): [i]})
        if parent is None:
            self.root = new
        else:
            parent[1][branch] = new

    def walk(self) -> Iterator[tuple[int, int]]:
        """(string number, common prefix with the string before) in order."""
        stack = [(self.root, self.depth)]
        while stack:
            node, same = stack.pop()
            if isinstance(node, tuple):
                children = sorted(node[1].items(), reverse=True)
                for n, (_, child) in enumerate(children):
                    stack.append((child, same if n == len(children) - 1 else node[0]))
            else:
                for k, i in enumerate(node):
                    yield i, same if k == 0 else len(self.strings[i])


def common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    low, high = start, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 8:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    while a[low] == b[low]:
        low += 1
    return low


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): sorted order and each string's common prefix with the one
    before (0 for the first)."""
    n = len(strings)
    words = np.frombuffer(b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings), ">u8").reshape(n, -1).astype(np.uint64)
    order: list[int] = []
    lcp: list[int] = []

    def deep(rows: list[int], depth: int) -> None:
        if len(rows) == 1:
            order.append(rows[0])
            lcp.append(-1)
            return
        trie = BlindTrie(strings, depth)
        for i in rows:
            trie.add(i)
        for k, (i, same) in enumerate(trie.walk()):
            order.append(i)
            lcp.append(same if k else -1)

    def small(rows: np.ndarray) -> None:
        ranked = sorted((strings[i][:shallow], i) for i in rows.tolist())
        a = 0
        for b in range(1, len(ranked) + 1):
            if b == len(ranked) or ranked[b][0] != ranked[a][0]:
                deep([i for _, i in ranked[a:b]], len(ranked[a][0]))
                a = b

    # multikey quicksort, eight bytes a key; rows wait on a stack instead of recursion
    stack = [(np.arange(n), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) <= SMALL:
            if len(rows):
                small(rows)
            continue
        if depth == words.shape[1]:
            # equal padded words; a string that ends early is not its zero-byte continuation
            short = [i for i in rows.tolist() if len(strings[i]) < shallow]
            if short:
                small(rows)
            else:
                deep(rows.tolist(), shallow)
            continue
        keys = words[rows, depth]
        pivot = np.partition(keys, len(keys) // 2)[len(keys) // 2]
        stack.append((rows[keys > pivot], depth))
        stack.append((rows[keys == pivot], depth + 1))
        stack.append((rows[keys < pivot], depth))
    out = np.array(order, np.int64)
    same = np.array(lcp, np.int64)
    for k in np.flatnonzero(same < 0).tolist():  # borders of shallow groups
        same[k] = common(strings[out[k - 1]], strings[out[k]], 0) if k else 0
    return out, same


def repeated(groups: np.ndarray, contexts: list[bytes], anchors: np.ndarray, least: np.ndarray, most: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """(row, d) pairs: the string that starts d bytes left of the row's anchor
    equals one of another row of its group. Rows take part with the distances
    least..most; their context holds all these strings whole."""
    n = len(contexts)
    marks = [int(g).to_bytes(8, "big") for g in groups.tolist()]
    at = anchors.tolist()
    right = [m + c[a:] for m, c, a in zip(marks, contexts, at)]
    left = [m + c[:a][::-1] for m, c, a in zip(marks, contexts, at)]
    ranks, borders = [], []
    for strings in (right, left):
        order, same = deep_shallow(strings)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        ranks.append(rank)
        borders.append(same - 8)
    found = []
    for d in range(int(least.min()), int(most.max()) + 1):
        rows = np.flatnonzero((least <= d) & (d <= most))
        if len(rows) < 2:
            continue
        r = np.cumsum(borders[0] < length - d)[ranks[0][rows]]
        lf = np.cumsum(borders[1] < d)[ranks[1][rows]]
        key = r * (n + 1) + lf
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        hit = np.zeros(len(rows), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        found.append(np.stack((rows[hit], np.full(int(hit.sum()), d)), 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


# ---- Spark steps


def _slices(parts: Iterator[pa.RecordBatch], budget: int = 24 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of batches in slices of bounded text bytes, with the texts."""
    for part in parts:
        texts, size, start = [], 0, 0
        for i, t in enumerate(part.column(part.schema.get_field_index("bytes"))):
            texts.append(t.as_py())
            size += len(texts[-1])
            if size >= budget:
                yield part.slice(start, len(texts)), texts
                texts, size, start = [], 0, i + 1
        if texts:
            yield part.slice(start, len(texts)), texts


def _ask(length: int, gram: int):
    """Rows kind 0 (gram asked for, doc null if known to repeat), 1 (doc has a
    repeated gram), 2 (count of a locally frequent gram)."""
    names = ["key", "kind", "doc", "gram", "n"]

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(parts):
            a = Anchors(texts, length, gram)
            if not len(a.gram):
                continue
            doc = part.column(part.schema.get_field_index("doc")).to_numpy()[a.text]
            grams, back, count = np.unique(a.gram, return_inverse=True, return_counts=True)
            many = count[back] > 1
            hot = count >= max(2, len(a.gram) // (2 * HOT))
            own = np.unique(np.stack((doc[many], a.gram[many]), 1), axis=0) if many.any() else np.zeros((0, 2), np.int64)
            one, several = ~many, grams[count > 1]
            blocks = [
                (a.gram[one], 0, doc[one], a.gram[one], np.ones(int(one.sum()), np.int64), None),
                (several, 0, several, several, count[count > 1], np.ones(len(several), bool)),
                (own[:, 0], 1, own[:, 0], own[:, 1], np.zeros(len(own), np.int64), None),
                (grams[hot], 2, grams[hot], grams[hot], count[hot], None),
                (np.zeros(1, np.int64), 3, np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([len(a.gram)]), None),
            ]
            for key, kind, docs, g, n, null in blocks:
                if len(key):
                    columns = [pa.array(key), pa.array(np.full(len(key), kind, np.int32)), pa.array(docs, mask=null), pa.array(g), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return step


def _answer(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of kind 0 rows those whose gram occurs again become kind 1; others pass."""
    for table in whole_groups(parts, "key"):
        kind, n = table.column("kind").to_numpy(), table.column("n").to_numpy()
        asked = kind == 0
        keys = table.column("key").to_numpy()
        _, back = np.unique(keys, return_inverse=True)
        total = np.bincount(back, weights=np.where(asked, n, 0))
        known = table.column("doc").is_valid().to_numpy(zero_copy_only=False)
        keep = ~asked | ((total[back] > 1) & known)
        out = table.filter(pa.array(keep))
        out = out.set_column(1, "kind", pa.array(np.maximum(kind[keep], 1).astype(np.int32)))
        yield from out.select(["kind", "doc", "gram", "n"]).combine_chunks().to_batches()


def _contexts(length: int, gram: int, hot: frozenset[int]):
    """Rows kind 0 (surroundings of an anchor) and 1 (covered stretch a..b of a doc)."""
    names = ["key", "kind", "doc", "a", "b", "place", "context"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list] = {}
        size = 0

        def out():
            rows = []
            covered: dict[int, list[tuple[int, int]]] = {}
            for (key, place, context), where in seen.items():
                if len(where) == 1:
                    rows.append((key, 0, *where[0], place, context))
                else:  # equal surroundings: all their strings repeat, and one row speaks for them
                    rows.append((key, 0, None, *where[0][1:], place, context))
                    for doc, a, b in where:
                        covered.setdefault(doc, []).append((a, b + length))
            seen.clear()
            rows += [(doc, 1, doc, a, b, None, None) for doc, spans in covered.items() for a, b in merged(spans)]
            for i in range(0, len(rows), 5000):
                columns = zip(*rows[i : i + 5000])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for part, texts in _slices(parts, 4 << 20):
            a = Anchors(texts, length, gram)
            docs = part.column(part.schema.get_field_index("doc")).to_pylist()
            wanted = part.column(part.schema.get_field_index("grams"))
            counts = pc.list_value_length(wanted).to_numpy()
            pairs = np.stack((np.repeat(np.arange(len(texts)), counts), wanted.flatten().to_numpy()), 1)
            table = {(t, g) for t, g in pairs.tolist()}
            for t, at, low, high, g in zip(a.text.tolist(), a.place.tolist(), a.low.tolist(), a.high.tolist(), a.gram.tolist()):
                if (t, g) not in table:
                    continue
                text = texts[t]
                bands = [(low, high)]
                if g in hot:  # bands by distance from the anchor, alike in all documents
                    bands = [(max(low, at - d - BAND + 1), min(high, at - d)) for d in range(0, length, BAND) if max(low, at - d - BAND + 1) <= min(high, at - d)]
                for x, y in bands:
                    if g in hot:
                        d = (at - y) // BAND * BAND
                        core = text[at - d : max(at, at - d - BAND + 1 + length)]
                        key = xxhash.xxh64_intdigest(core, d + 1) - (1 << 63)
                    else:
                        key = g
                    context = text[x : y + length]
                    seen.setdefault((key, at - x, context), []).append((docs[t], x, y))
                    size += len(context) + 150
                if size > 24 << 20:
                    yield from out()
                    size = 0
        yield from out()

    return step


def _compare(length: int):
    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(parts, "key", 8000):
            kind = table.column("kind").to_numpy()
            done = table.filter(pa.array(kind == 1))
            if done.num_rows:
                yield from done.select(["doc", "a", "b"]).combine_chunks().to_batches()
            rows = table.filter(pa.array(kind == 0))
            keys = rows.column("key").to_numpy()
            if not len(keys):
                continue
            _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
            rows, back = rows.filter(pa.array(count[back] > 1)), back[count[back] > 1]
            if not rows.num_rows:
                continue
            a, b = rows.column("a").to_numpy(), rows.column("b").to_numpy()
            place = rows.column("place").to_numpy().astype(np.int64)
            asking = rows.column("doc").is_valid().to_numpy(zero_copy_only=False)
            hits = repeated(back, rows.column("context").to_pylist(), place, place - (b - a), place, length)
            hits = hits[asking[hits[:, 0]]]
            if not len(hits):
                continue
            row, start = hits[:, 0], (a + place)[hits[:, 0]] - hits[:, 1]
            order = np.lexsort((start, row))
            row, start = row[order], start[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(row)) - 1
            docs = rows.column("doc").take(pa.array(row[first])).combine_chunks()
            yield pa.RecordBatch.from_arrays([docs, pa.array(start[first]), pa.array(start[last] + length)], names=["doc", "a", "b"])

    return step


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching stretches as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(removed bytes, maximal removed runs, rest)."""
    spans = merged(spans)
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return sum(b - a for a, b in spans), len(spans), b"".join(kept)


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Every row of ``docs`` as (id, bytes, spans): spans are the stretches
    (a, b) of the text's bytes that lie in a repeated string; null if none.

    Null texts are empty; texts shorter than ``length`` have no string. Rows
    that repeat id and text are documents of their own, so their strings
    repeat. ``gram`` is a multiple of 8, at most ``length``; it does not change
    the result.
    """
    rows = docs.select(F.col(id_col).alias(id_col), text_of(text_col).cast("binary").alias("bytes"))
    rows = rows.withColumn("doc", F.xxhash64(id_col, "bytes"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = rows.select("doc", "bytes").mapInArrow(_ask(length, gram), "key long, kind int, doc long, gram long, n long")
    asked = asked.repartition(parts, "key").sortWithinPartitions("key")
    grams = held(asked.mapInArrow(_answer, "kind int, doc long, gram long, n long"))
    total = grams.where("kind = 3").agg(F.sum("n")).first()[0] or 0
    often = grams.where("kind = 2").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") * 2 * HOT >= total).where("n >= 64")
    hot = frozenset(r["gram"] for r in often.select("gram").collect())  # at most 2 * HOT grams
    wanted = grams.where("kind = 1").groupBy("doc").agg(F.collect_set("gram").alias("grams"))  # at most the anchors of one text
    contexts = rows.select("doc", "bytes").join(wanted, "doc").mapInArrow(
        _contexts(length, gram, hot), "key long, kind int, doc long, a long, b long, place int, context binary")
    contexts = contexts.repartition(parts, "key").sortWithinPartitions("key")
    found = contexts.mapInArrow(_compare(length), "doc long, a long, b long")
    spans = found.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return rows.join(spans, "doc", "left").select(id_col, "bytes", "spans")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, kept binary, n_bytes, n_removed, n_spans) per row; ``kept`` is the
    rest of the text's bytes, which may part a character."""
    rows = covered(docs, id_col, text_col, length)
    kind = dict(rows.dtypes)[id_col]
    names = [id_col, "kept", "n_bytes", "n_removed", "n_spans"]

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(0, part.num_rows, 500):
                own = part.slice(i, 500)
                texts = [t.as_py() for t in own.column(1)]
                spans = [[(s["a"], s["b"]) for s in x.as_py() or ()] for x in own.column(2)]
                results = [cut(t, s) for t, s in zip(texts, spans)]
                columns = [pa.array([r[2] for r in results], pa.binary()), *(pa.array(c, pa.int64()) for c in ([len(t) for t in texts], [r[0] for r in results], [r[1] for r in results]))]
                yield pa.RecordBatch.from_arrays([own.column(0), *columns], names=names)

    return rows.mapInArrow(step, f"`{id_col}` {kind}, kept binary, n_bytes long, n_removed long, n_spans long")


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """What ``deduplicated`` must give, from a table of all strings; for tests."""
    count: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            count[s] = count.get(s, 0) + 1
    out = []
    for t in texts:
        spans = [(p, p + length) for p in range(len(t) - length + 1) if count[t[p : p + length]] > 1]
        removed, runs, rest = cut(t, spans)
        out.append((removed, runs, hashlib.sha256(rest).hexdigest()))
    return out
