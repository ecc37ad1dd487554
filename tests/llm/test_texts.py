"""Exact dedup, SimHash, repeated strings and n-gram scores against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from zonewright.llm import exact_dedup, ngrams, simhash, suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def doc(i, text, source="a"):
    return (i, text, "en", source, len(text or ""))


def words(rng, n, of=40):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, repeats inside a text, a hot group, nulls, ties."""
    rng = random.Random(5)
    passage = words(rng, 90, 4000)
    rows = [doc(i, words(rng, rng.randrange(1, 120), 4000)) for i in range(60)]
    rows += [doc(100 + i, rows[i % 7][1]) for i in range(40)]
    rows += [doc(200 + i, f"{words(rng, 9, 4000)}\n{passage} {words(rng, 9, 4000)}") for i in range(12)]
    rows += [doc(300 + i, "hot  text\tof a group " * 30) for i in range(70)]
    rows += [doc(400, "hot text of a group " * 30), doc(401, None), doc(402, ""), doc(403, " \n\t "), doc(404, "x"), doc(None, "x"), doc(None, None)]
    rows += [doc(405, "é" * 400), doc(406, "é" * 300 + "z"), doc(407, "ab" * 700), doc(407, "ab" * 700), doc(408, words(rng, 30000, 9000))]
    return rows


# ---- exact dedup


def plain_groups(rows):
    groups = {}
    for i, text, *_ in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        groups.setdefault(key, []).append(i)
    out = []
    for key, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        out += [(i, least, len(ids), i == least, hashlib.sha256(key.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [exact_dedup.TABLE_BYTES, 2000])
def test_exact_dedup(frame, corpus, limit):
    got = exact_dedup.assign(frame(corpus, DOCS), limit=limit).collect()
    assert sorted(map(tuple, got), key=repr) == plain_groups(corpus)


def test_exact_dedup_keeps_rows_with_their_columns(frame, corpus):
    got = exact_dedup.deduplicated(frame(corpus, DOCS))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = {(i, d) for i, _, _, kept, d in plain_groups(corpus) if kept}
    rows = got.collect()
    assert len(rows) == len(want)
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    assert {(r["doc_id"], digest(r["text"])) for r in rows} == want


def test_table_compares_content_not_hashes():
    table = exact_dedup.TextTable()
    for k, text in enumerate([b"a", b"b", b"a"]):
        table.add(7, text.decode(), text, k, 1)
    assert sorted(table.rows()) == [(7, "a", b"a", 0, 2), (7, "b", b"b", 1, 1)]


def test_grace_spills_recursively_and_cleans_up(tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup.tempfile, "tempdir", str(tmp_path))
    texts = exact_dedup.TextTable()
    for k in range(3000):
        content = b"%d" % (k % 1500) * 20
        texts.add(k, f"d{k % 1500}", content, k, 1)  # equal contents under different hashes stay apart
    groups = [r for b in exact_dedup.grace(20_000)(iter(list(texts.partials()))) for r in b.to_pylist()]
    assert len(groups) == 3000 and sum(g["group_size"] for g in groups) == 3000
    assert list(tmp_path.iterdir()) == []


# ---- SimHash


def plain_fingerprint(text, width=4):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + width]) for i in range(len(tokens) - width + 1)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(ids, fps, bits=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= bits:
            root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, d in enumerate(ids)), key=repr)


def test_simhash(frame, corpus):
    rng = random.Random(9)
    base = words(rng, 400, 3000).split()
    near = []
    for k in range(60):  # near copies: one word changed each
        copy = list(base)
        copy[rng.randrange(400)] = f"new{k}"
        near.append(doc(1000 + k, " ".join(copy)))
    rows = corpus + near
    got = simhash.assign(frame(rows, DOCS)).collect()
    want = plain_components([r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows])
    assert sorted(map(tuple, got), key=repr) == want
    kept = simhash.deduplicated(frame(rows, DOCS)).collect()
    assert sorted((r["doc_id"] for r in kept), key=repr) == sorted({c for d, _, c in want if d == c}, key=repr)


def test_links_at_random_distances(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = set(centres.tolist())
    for c in centres.tolist():
        for _ in range(12):
            x = c
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    assert all((r["a"] ^ r["b"]).bit_count() <= 4 or ((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 4 for r in edges.collect())
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    got = {}
    for f, s in zip(fps, signed):
        got.setdefault(roots.get(s, s), set()).add(f)
    want = {}
    for d, _, c in plain_components(fps, fps):
        want.setdefault(c, set()).add(d)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


# ---- repeated strings


def test_repeated_strings(frame, corpus):
    got = suffixes.deduplicated(frame(corpus, DOCS)).collect()
    texts = [(r[1] or "").encode() for r in corpus]
    want = [(r[0], len(t), *x) for r, t, x in zip(corpus, texts, suffixes.brute_force(texts))]
    mine = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr)


def test_repeated_strings_with_hot_grams(frame, monkeypatch):
    """One passage in every text, with other words around: its gram is spread by bands."""
    rng = random.Random(3)
    passage = words(rng, 60, 4000)
    rows = [doc(i, f"{words(rng, 20, 4000)} {passage[: 150 + i % 7 * 20]} {words(rng, 20, 4000)}") for i in range(150)]
    texts = [r[1].encode() for r in rows]
    monkeypatch.setattr(suffixes, "HOT", 8)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffixes.deduplicated(frame(rows, DOCS, 9)).collect()}
    assert got == {r[0]: x for r, x in zip(rows, suffixes.brute_force(texts))}


@pytest.mark.parametrize("seed", range(3))
def test_deep_shallow_order(seed):
    rng = random.Random(seed)
    for _ in range(60):
        base = [bytes(rng.choices(b"ab\0", k=rng.randint(0, 50))) for _ in range(5)]
        strings = [rng.choice(base)[: rng.randint(0, 50)] + rng.choice(base) for _ in range(rng.randint(1, 150))]
        order, same = suffixes.deep_shallow(strings)
        ranked = [strings[i] for i in order]
        assert ranked == sorted(strings)
        for k in range(1, len(ranked)):
            pairs = zip(ranked[k - 1], ranked[k])
            assert same[k] == next((i for i, (a, b) in enumerate(pairs) if a != b), min(len(ranked[k - 1]), len(ranked[k])))


# ---- n-gram scores


def plain_scores(rows):
    tokens = [[*((t or "").encode().lower().split()), None] for _, t, *_ in rows]
    train = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2 for r in rows]
    single, after, kinds = Counter(), Counter(), {}
    for ts, ok in zip(tokens, train):
        if ok:
            single.update(ts)
            for a, b in zip([b"<start>", *ts], ts):
                after[a, b] += 1
                kinds.setdefault(a, set()).add(b)
    total = Counter()
    for (a, _), n in after.items():
        total[a] += n
    n, v = sum(single.values()), len(single)
    out = []
    for r, ts, ok in zip(rows, tokens, train):
        base = full = 0.0
        for a, b in zip([b"<start>", *ts], ts):
            p = (single[b] + 1) / (n + v + 1)
            base += math.log10(p)
            if total[a]:
                p = max(after[a, b] - 0.75, 0) / total[a] + 0.75 * len(kinds[a]) / total[a] * p
            full += math.log10(p)
        out.append((r[0], not ok, len(ts), sum(single[t] > 0 for t in ts), n, base, full))
    return out


@pytest.mark.parametrize("tiny", [False, True])
def test_ngram_scores(frame, corpus, monkeypatch, tiny):
    if tiny:  # many chunks, parts, shards and spread contexts
        for name, value in (("CHUNK_BYTES", 20_000), ("PACK_BYTES", 3000), ("SHARD_TOKENS", 2000), ("HEAVY", 64)):
            monkeypatch.setattr(ngrams, name, value)
    rows = [r for r in corpus if r[0] is not None] + [doc(9000 + i, words(random.Random(i), 50, 30)) for i in range(80)]
    got = sorted(map(tuple, ngrams.score(frame(rows, DOCS)).collect()))
    want = sorted(plain_scores(rows))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-3, abs=1e-3 * g[2])


def test_sequence_finds_exactly_its_values():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1), (5, 2**64 - 1), (1000, 5000), (3000, 2**40), (3000, 2**64 - 1)):
        values = np.unique(rng.integers(0, top, n, dtype=np.uint64)) if n else np.zeros(0, np.uint64)
        asked = np.concatenate((values, values + np.uint64(1), rng.integers(0, 2**64 - 1, 100, dtype=np.uint64)))
        at = {int(x): i for i, x in enumerate(values)}
        got = ngrams.Sequence(ngrams.Sequence.build(values)).find(asked)
        assert got.tolist() == [at.get(int(x), -1) for x in asked]


# ---- empty tables


def test_empty_tables(frame, spark):
    empty = spark.createDataFrame([], DOCS)
    for got in (exact_dedup.assign(empty), exact_dedup.deduplicated(empty), simhash.assign(empty), simhash.deduplicated(empty), suffixes.deduplicated(empty), ngrams.score(empty)):
        assert got.count() == 0


def test_clashing_columns(frame):
    rows = [(1, "a b", "x", 5), (2, "a  b", "y", 6), (3, "c", None, None)]
    df = frame(rows, "doc_id long, text string, digest string, n long")
    got = exact_dedup.deduplicated(df)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3]
    df = frame(rows, "doc_id long, text string, fp string, root long")
    got = simhash.deduplicated(df)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3]
