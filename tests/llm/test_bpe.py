"""Byte-level BPE against the library's own encoder, with chunks of any size."""

from __future__ import annotations

import hashlib
import random

import pytest

from zonewright.llm import bpe

DOCS = "doc_id long, text string, ids string, row string"


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load()


@pytest.fixture(scope="module")
def library(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})


def texts(seed=3):
    rng = random.Random(seed)
    alphabet = ["a", "b", "the", "don't", "'re", "'r", "'", "7", "42", " ", "  ", "\n", "\t", "\r\n", "é", "漢字", "🙂", "!", "...", "<|endoftext|>", " ", "　", "é", "\0", "ſ", "'S"]
    out = ["".join(rng.choices(alphabet, k=rng.randrange(1, 400))) for _ in range(120)]
    out += ["x" * 3000, " " * 3000 + "x", "a" * 2000 + " b", "\n" * 900 + "end", "1234567890" * 200, "'" * 500 + "s", ("ab " * 700) + "c" * 900 + " d" * 400, "é" * 1500 + "!" * 700]
    return [*out, "", " ", "\n", "x", None]


@pytest.mark.parametrize(("chunk", "overlap"), [(bpe.CHUNK, bpe.OVERLAP), (64, 16), (40, 39), (7, 3), (4, 3)])
def test_agrees_with_the_library(frame, vocabulary, library, chunk, overlap):
    rows = [(i, t, "other", "clash") for i, t in enumerate(texts())]
    rows += [rows[120], rows[120], (None, rows[120][1], None, None), rows[-1]]  # repeated rows, null id
    got = bpe.encode(frame(rows, DOCS), vocabulary, chunk=chunk, overlap=overlap)
    assert got.columns == ["doc_id", "row", "ids", "n_tokens"]
    want = sorted(((i, r, tuple(library.encode_ordinary(t or ""))) for i, t, _, r in rows), key=repr)
    found = got.collect()
    assert sorted(((g.doc_id, g.row, tuple(g.ids)) for g in found), key=repr) == want
    assert all(g.n_tokens == len(g.ids) for g in found)


def test_long_pieces_by_heap(vocabulary, library):
    rng = random.Random(1)
    for n in (65, 200, 1000):
        for alphabet in ("ab", "etaoin", "a", "0123456789", "éß漢"):
            piece = "".join(rng.choices(alphabet, k=n)).encode()
            want = list(library._core_bpe.encode_single_piece(piece))
            assert vocabulary._merged_by_heap(piece) == want and vocabulary._merged_together([piece]) == [want]


def test_pieces_of_all_lengths_together(vocabulary, library):
    rng = random.Random(2)
    pieces = ["".join(rng.choices(alphabet, k=rng.randrange(1, 70))).encode() for alphabet in ("ab", "etaoinshr ", "a", "0123456789", "éß漢🙂") for _ in range(200)]
    pieces += [bytes(rng.choices(range(256), k=rng.randrange(1, 20))) for _ in range(300)] + [b"", b"a", b"the", b" the"]
    assert vocabulary.ids_of(pieces) == [list(library._core_bpe.encode_single_piece(p)) if p else [] for p in pieces]


def test_digests_and_round_trip(frame, vocabulary, library):
    rows = [(i, t) for i, t in enumerate(texts(4))]
    got = {r.doc_id: r for r in bpe.digests(frame(rows, "doc_id long, text string"), vocabulary).collect()}
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_many_copies_of_a_long_text(frame, vocabulary, library):
    """More copies than one part of a key holds."""
    from zonewright.llm import common

    rows = frame([(i, "k" if i % 3 else f"u{i}") for i in range(300)], "n long, key string")
    facts = frame([("k", 1), *[(f"u{i}", i) for i in range(0, 300, 3)]], "key string, fact long")
    got = common.join_spread(rows, facts, "key", most=20)
    assert sorted((r.n, r.fact) for r in got.collect()) == [(i, 1 if i % 3 else i) for i in range(300)]


def test_null_ids_and_empty_tables(frame, vocabulary):
    rows = frame([(1, None), (2, []), (3, [vocabulary.ranks[b"a"], vocabulary.ranks[b"b"]])], "n long, ids array<int>")
    got = {r.n: r.decoded for r in bpe.decode(rows, vocabulary).collect()}
    assert got == {1: None, 2: bytearray(), 3: bytearray(b"ab")}
    assert bpe.digests(frame([], "doc_id long, text string"), vocabulary).count() == 0


def test_bad_settings(frame, vocabulary):
    with pytest.raises(ValueError):
        bpe.encode(frame([], "doc_id long, text string"), vocabulary, chunk=4, overlap=4)
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0}, "a")
