"""Merkle manifests against a plain tree in memory."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from zonewright.llm import merkle, ranges

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    fields = (doc_id, source, lang, n_chars, text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def plain_tree(nodes, arity):
    """(root, steps of each node)"""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            start = a - a % arity
            steps[i].append((nodes[start:a], nodes[a + 1 : start + arity]))
            at[i] = a // arity
        nodes = [h(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], steps


def plain_manifest(rows, arity=2):
    """Sorted results of a whole table: (doc_id, leaf, subroot, root, proof, folded, verified)."""
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r))) for g in langs}
    trees = {g: plain_tree([plain_leaf(*r) for r in of], arity) for g, of in groups.items()}
    root, upper = plain_tree([trees[g][0] for g in langs], arity)
    out = []
    for g, above in zip(langs, upper):
        for r, own in zip(groups[g], trees[g][1]):
            path = own + above
            doc_id, text, lang, source, n = r
            if doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
                n += 1
            folded = plain_leaf(doc_id, text, lang, source, n)
            for left, right in path:
                folded = h(*left, folded, *right)
            out.append((doc_id, plain_leaf(*r), trees[g][0], root, h(*(x for left, right in path for x in left + right)), folded, folded == root))
    return sorted(out, key=repr)


def table(seed=2):
    rng = random.Random(seed)
    rows = [(rng.randrange(10_000), f"text {i}" * rng.randrange(9), "hot", rng.choice(["a", "b", None]), rng.choice([3, 4, None])) for i in range(150)]
    rows += [(i, "é漢", lang, "s", i) for i, lang in enumerate(["en", "de", None, "", "é", "zz", None, "en", "en"])]
    rows += [(500 + i, None, f"l{i:02}", None, None) for i in range(20)]
    rows += [(7, "copy", "en", "s", 4)] * 3 + [(None, "x", "en", "s", 4), (None, None, None, None, None)]
    return rows + [(900, "x" * 200_000, "hot", "s", 200_000)]


@pytest.mark.parametrize("height", [8, 2, 1])
def test_documents(frame, height):
    rows = table()
    got = merkle.documents_manifest(frame(rows, DOCS), height=height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found == plain_manifest(rows)
    assert not all(r[-1] for r in found) and any(r[-1] for r in found)


@pytest.mark.parametrize("count", [1, 2, 3, 8, 9, 27, 28])
def test_runs_of_three(frame, count):
    rows = [(i, f"{h(str(i))}", "g", 5, "clash") for i in range(count)]
    got = merkle.manifest(frame(rows, "id long, node string, tree string, place int, steps string"), "node", "tree", ["id"], keep=["id", "tree"], arity=3, height=1)
    root, steps = plain_tree([r[1] for r in rows], 3)
    want = {i: ["".join(a) + "|" + "".join(b) for a, b in s] for i, s in enumerate(steps)}
    found = got.collect()
    assert {r.id: list(r.steps) for r in found} == want
    assert all(r.root == r.subroot == r.folded_root == root and r.verified and r.tree == "g" for r in found)


def test_empty_table(frame):
    assert merkle.documents_manifest(frame([], DOCS)).count() == 0


def test_bad_settings(frame):
    with pytest.raises(ValueError):
        merkle.manifest(frame([], "leaf string, g string"), "leaf", "g", [], arity=1)


def test_a_changed_step_does_not_verify():
    steps = plain_tree([h(str(i)) for i in range(5)], 2)[1][3]
    path = ["".join(a) + "|" + "".join(b) for a, b in steps]
    root = plain_tree([h(str(i)) for i in range(5)], 2)[0]
    assert merkle.fold(h("3"), path) == root
    assert merkle.fold(h("3"), path[::-1]) != root and merkle.fold(h("2"), path) != root


def test_places_of_equal_rows(spark, frame):
    """One group with most rows, all of them equal in the order, over many ranges."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("hot", 1)] * 500 + [("a", i % 5) for i in range(40)] + [("z", None), ("z", 2)]
        got = ranges.numbered(frame(rows, "g string, n long"), "g", ["n"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    places = {g: sorted(r.place for r in got if r.g == g) for g in ("hot", "a", "z")}
    assert places == {"hot": list(range(500)), "a": list(range(40)), "z": [0, 1]}
    assert [r.n for r in sorted((r for r in got if r.g == "a"), key=lambda r: r.place)] == sorted(i % 5 for i in range(40))
    assert {(r.g, r.size) for r in got} == {("hot", 500), ("a", 40), ("z", 2)}
    assert {r.n: r.place for r in got if r.g == "z"} == {None: 0, 2: 1}
