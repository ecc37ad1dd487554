"""SimHash near-duplicates through a byte-position index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in
at most d bits differ in at most d bytes, so they share at least 8 - d bytes in
place: the guaranteed minimum. The inverted index is keyed by every choice of
that many positions with the bytes found there, so a posting already holds what
single-byte postings would give after intersection; a pair from a posting is
tallied on all eight positions, kept from the minimum on, and then verified by
its differing bits.

Only distinct fingerprints are indexed, so thousands of copies count once. A
posting returns the edges of a spanning forest of its links, never its pairs.
Components follow by contraction of each partition's edges, then by alternating
star contraction across partitions, with tables held in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.llm.common import held, join_hot, key_of, narrow, one_row_per, text_of

BITS = 4
SHINGLE = 4
SEED = 42
BLOCK = 512
EDGES = 500_000


def fingerprint(text: str, width: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is 1 if it is set in over half the shingle hashes; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), seed)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    pairs = zip(starts[:count].tolist(), ends[width - 1 :].tolist())
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.uint64, count)
    for i in range(0, count, 8192):  # bounded memory for very long texts
        part = hashes[i : i + 8192]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    set_bits = np.flatnonzero(ones * 2 > count)
    return sum(1 << int(b) for b in set_bits)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = np.array([fingerprint(t.as_py(), width) for t in part.column(1)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=[id_col, "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_of(text_col).alias("text"))
    return rows.mapInArrow(step, f"`{id_col}` long, fp long")


def linked(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs are links: tally of shared positional bytes, then bits."""
    differ = a ^ b
    shared = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(-1)
    enough = shared >= 8 - bits
    enough[enough] = np.bitwise_count(differ[enough]) <= bits
    return enough


def forest(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the members of a posting.

    Breadth first: each member meets those not reached yet, in blocks, so a
    dense group is done after few comparisons.
    """
    edges: list[tuple[int, int]] = []
    rest = members
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            block, front = front[:BLOCK], front[BLOCK:]
            found = np.full(len(rest), -1, np.int64)
            for i in range(0, len(rest), BLOCK):
                part = np.ascontiguousarray(rest[i : i + BLOCK])
                hit = linked(np.repeat(block[:, None], len(part), 1), np.repeat(part[None, :], len(block), 0), bits)
                found[i : i + BLOCK] = np.where(hit.any(0), hit.argmax(0), -1)
            new = found >= 0
            edges += zip(block[found[new]].tolist(), rest[new].tolist())
            front, rest = np.concatenate((front, rest[new])), rest[~new]
    return edges


def _postings(bits: int):
    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by posting; a posting may span batches."""
        last_key, waiting = None, []

        def close(found: list) -> None:
            if len(waiting) > 1 or (waiting and len(waiting[0]) > 1):
                found += forest(np.concatenate(waiting).astype(np.uint64), bits)

        def out(found: list) -> pa.RecordBatch:
            pairs = np.array(found, np.uint64).reshape(-1, 2).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for part in parts:
            keys = np.stack([part.column(0).to_numpy(), part.column(1).to_numpy()], 1)
            fps = part.column(2).to_numpy()
            if not len(fps):
                continue
            found: list[tuple[int, int]] = []
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fps)]))
            if last_key is not None and tuple(keys[0]) != last_key:
                close(found)
                waiting = []
            for k in np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(fps))).tolist():
                members = fps[starts[k] : ends[k]]
                if k == 0 and waiting and tuple(keys[0]) == last_key:
                    waiting.append(members)
                else:
                    waiting = [members]
                if k < len(starts) - 1:
                    close(found)
                    waiting = []
            last_key = tuple(keys[-1])
            if found:
                yield out(found)
        found = []
        close(found)
        if found:
            yield out(found)

    return step


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): for distinct fingerprints ``nodes(fp)``, edges with the same
    components as all links at ``bits`` or fewer differing bits (at most 7)."""
    masks = [sum(255 << (8 * p) for p in places) for places in combinations(range(8), 8 - bits)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("places"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(signed)])
    rows = nodes.select("fp", F.explode(keys).alias("k")).select(F.col("k.places").cast("long").alias("places"), F.col("k.bytes").alias("bytes"), "fp")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "places", "bytes").sortWithinPartitions("places", "bytes")
    return dealt.mapInArrow(_postings(bits), "a long, b long").distinct()


def _contracted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars with the same components as a partition's edges, after each ``EDGES`` of them."""
    root: dict[int, int] = {}
    seen = 0

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    def out() -> pa.RecordBatch:
        stars = [(x, top(x)) for x in list(root)]
        a, b = zip(*(s for s in stars if s[0] != s[1]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for part in parts:
        for x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            x, y = top(x), top(y)
            root[max(x, y)] = min(x, y)
        seen += part.num_rows
        if seen > EDGES:
            yield out()
            root.clear()
            seen = 0
    if root:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``: root is the least node of
    its component. Each partition contracts its own edges; then large and small
    stars alternate until nothing changes."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = narrow(edges.where("a <> b").select("a", "b"))
    edges = narrow(edges.mapInArrow(_contracted, "a long, b long"))
    before = None
    while (now := state(edges)) != before:
        before = now
        edges = narrow(star(star(edges, True), False))
    stars = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, width: int = SHINGLE) -> DataFrame:
    """(id, fingerprint, component_id) per row of ``docs``.

    Null texts are empty, texts without words have fingerprint zero and link
    like any other; texts of fewer than ``width`` words are one shingle. A
    component's id is its smallest id (null only if it has no other). Rows that
    repeat an id give a row each. An empty table gives none.
    """
    rows = held(fingerprints(docs, id_col, text_col, width))
    nodes = held(rows.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")))
    found = components(links(nodes.select("fp"), bits))
    rooted = held(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", "n", "root"))
    # a fingerprint without links is its own component
    common = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component_id"))
    joined = rooted.where("root IS NOT NULL").join(common, "root").select("fp", "n", "component_id")
    classes = joined.union(rooted.where("root IS NULL").select("fp", "n", F.col("least").alias("component_id")))
    out = join_hot(rows, classes, "fp", "n", rows.count())
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, width: int = SHINGLE) -> DataFrame:
    """One document of each component, that with the smallest id, with all its
    columns; of rows that repeat that id, one."""
    kept = assign(docs, id_col, text_col, bits, width).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    kept = kept.select(key_of(id_col).alias("keep__")).distinct()
    rows = one_row_per(docs.withColumn("keep__", key_of(id_col)), ["keep__"])
    return rows.join(kept, "keep__", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
