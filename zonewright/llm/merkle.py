"""Merkle manifest of a dataset: tree of trees, proofs, and their folding.

Every row is a leaf. The leaves of a group, in order, are reduced run by run to
the group's root; the groups' roots, in order, are reduced likewise to the root
of the dataset. Leaves are dealt by superblock, an aligned run of
``arity ** height`` nodes, so no task holds more of a group than that.

Upwards, every superblock gives its top node; the tops are the nodes of the next
round, until each group has one. Downwards, a round cogroups the nodes of each
superblock with the outer nodes its top needs: the path of siblings from there
to the root. The superblock repeats its small reduction, puts the siblings found
within it ahead of that path and hands the whole on to its children; at the
leaves the same step also hashes the proof and folds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewright.llm.common import held, key_of
from zonewright.llm.ranges import numbered


def leaf_of(fields: Sequence[Column]) -> Column:
    """Hash of a row's fields: each ``-`` if null, else its length in bytes, a colon, its text."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def combined(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def climb(nodes: list[str], arity: int, levels: int | None) -> tuple[str, list[list[str]]]:
    """The top over ``nodes`` and, per level from below, each run's node text:
    ``levels`` levels, or as many as it takes to reach one node."""
    rows = [nodes]
    while len(rows[-1]) > 1 if levels is None else len(rows) <= levels:
        below = rows[-1]
        rows.append([combined(*below[i : i + arity]) for i in range(0, len(below), arity)])
    return rows[-1][0], rows[:-1]


def siblings(rows: list[list[str]], at: int, arity: int) -> list[str]:
    """The steps of the node ``at``, from below: what stands left and right of it in its run."""
    out = []
    for row in rows:
        start = at - at % arity
        out.append(f"{''.join(row[start:at])}|{''.join(row[at + 1 : start + arity])}")
        at //= arity
    return out


def fold(leaf: str, steps: Sequence[str]) -> str:
    """The root that a leaf and its steps lead to."""
    for step in steps:
        left, _, right = step.partition("|")
        leaf = combined(left, leaf, right)
    return leaf


def proof_hash(steps: Sequence[str]) -> str:
    return combined("".join(steps).replace("|", ""))


def _tops(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    """One node per superblock: (tree, place, node, size), ready to be the next round's nodes."""
    width = arity**height

    def top(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        size, place = int(part["size"].iloc[0]), int(part["place"].iloc[0]) // width
        node, _ = climb(part["node"].tolist(), arity, None if size <= width else height)
        return pd.DataFrame({"tree": [part["tree"].iloc[0]], "place": [place], "node": [node], "size": [-(-size // width)]})

    blocks = nodes.select("tree", "place", "node", "size", F.floor(F.col("place") / width).alias("block"))
    return held(blocks.groupBy("tree", "block").applyInPandas(top, "tree string, place long, node string, size long"))


def _handed_down(nodes: DataFrame, outer: DataFrame, arity: int, height: int, at_leaves: bool) -> DataFrame:
    """Cogroups superblocks with the path above each. Inner rounds give the
    path of every child (tree, block, subroot, steps); the last one finishes the rows."""
    width = arity**height
    kept = [f for f in nodes.schema if f.name not in ("size", "claimed")] if at_leaves else []

    def down(part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        size = int(part["size"].iloc[0])
        _, rows = climb(part["node"].tolist(), arity, None if size <= width else height)
        path, subroot = list(above["steps"].iloc[0]), above["subroot"].iloc[0]
        steps = [siblings(rows, i, arity) + path for i in range(len(part))]
        if not at_leaves:
            return pd.DataFrame({"tree": part["tree"], "block": part["place"], "subroot": subroot, "steps": steps})
        out = part[[f.name for f in kept]].copy()
        out["subroot"], out["steps"] = subroot, steps
        out["proof"] = [proof_hash(s) for s in steps]
        out["folded"] = [fold(leaf, s) for leaf, s in zip(part["claimed"], steps)]
        return out

    own = [F.col(c) for c in nodes.columns]
    blocks = nodes.select(*own, F.floor(F.col("place") / width).alias("block"))
    plain = "tree string, block long, subroot string, steps array<string>"
    more = [T.StructField(c, T.StringType()) for c in ("subroot", "proof", "folded")]
    whole = T.StructType([*kept, more[0], T.StructField("steps", T.ArrayType(T.StringType())), *more[1:]])
    return blocks.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(down, whole if at_leaves else plain)


def _rounds(nodes: DataFrame, arity: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Node tables from the leaves up, and the roots (tree, place, node, size)."""
    levels, largest = [], nodes.agg(F.max("size")).first()[0] or 1
    while True:
        levels.append(nodes)
        nodes = _tops(nodes, arity, height)
        largest = -(-largest // arity**height)
        if largest == 1:
            return levels, nodes


def manifest(rows: DataFrame, leaf: str, group: str, order: Sequence[str], keep: Sequence[str] = (), claimed: str | None = None, arity: int = 2, height: int = 8) -> DataFrame:
    """``keep`` columns, then leaf, subroot, root, steps, proof_sha256, folded_root, verified.

    ``leaf`` holds the leaves' hashes, ``group`` the tree each belongs to (null
    is a tree of its own, the first), ``order`` the order within a tree (nulls
    first; rows equal in it go by leaf, and equal leaves may change places).
    Runs of ``arity`` nodes become one; a lone last node is hashed alone.
    ``steps`` are the siblings from the leaf to the root, ``left|right`` per
    level. ``claimed`` names the column of leaves to check, the leaves
    themselves by default or where it is null: they are folded with the steps of the true tree, and
    ``verified`` tells if the root comes out. A table without rows gives none.
    Kept columns travel as text, so they need a type that text can hold.
    """
    if arity < 2 or height < 1:
        raise ValueError("a run needs two nodes, a superblock one level")
    kinds = {c: rows.schema[c].dataType for c in keep}
    given = rows.select(
        key_of(group).alias("tree"), F.col(f"`{leaf}`").alias("node"), F.coalesce(F.col(f"`{claimed or leaf}`"), F.col(f"`{leaf}`")).alias("claimed"),
        F.struct(*[F.col(f"`{c}`") for c in order]).alias("order"), *[F.col(f"`{c}`").cast("string").alias(f"keep{i}") for i, c in enumerate(keep)],
    )
    given = held(given)  # texts are hashed once; finding the ranges reads the rows a second time
    leaves = held(numbered(given, "tree", ["order", "node"]).drop("order"))
    levels, subroots = _rounds(leaves, arity, height)
    trees = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), "tree", ["name"])
    upper, roots = _rounds(held(trees), arity, height)
    found = roots.select("node").first()
    root = F.lit(found[0] if found else None).cast("string")
    # From the root down to the trees, then from each tree's root down to its leaves.
    outer = roots.select("tree", F.lit(0).cast("long").alias("block"), F.col("node").alias("subroot"), F.array().cast("array<string>").alias("steps"))
    for nodes in upper[:0:-1]:
        outer = _handed_down(nodes, outer, arity, height, False)
    named = upper[0].withColumn("claimed", F.col("node"))
    outer = _handed_down(named, outer, arity, height, True).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("node").alias("subroot"), "steps")
    for nodes in levels[:0:-1]:
        outer = _handed_down(nodes, outer, arity, height, False)
    out = _handed_down(leaves, outer, arity, height, True)
    own = [F.col(f"keep{i}").cast(kinds[c]).alias(c) for i, c in enumerate(keep)]
    return out.select(
        *own, F.col("node").alias("leaf"), "subroot", root.alias("root"), "steps", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"),
    )


def documents_manifest(docs: DataFrame, height: int = 8, every: int = 7) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of
    ``documents`` by language. To see the check at work, rows where ``every``
    divides the unsigned crc32 of the id's text claim an n_chars larger by 1;
    a null n_chars stays, and so does the row of a null id."""
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    changed = leaf_of(list((fields | {"n_chars": F.col("n_chars") + 1}).values()))
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0) & F.col("n_chars").isNotNull()
    rows = docs.select("doc_id", "lang", leaf_of(list(fields.values())).alias("leaf"), F.when(hit, changed).alias("claimed"))
    return manifest(rows, "leaf", "lang", ["doc_id"], keep=["doc_id"], claimed="claimed", height=height).drop("steps")
