"""Repair of conversations against an uncompressed search."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from zonewright.llm import repair

TURNS = "conv_id long, turn long, role string, text string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
ROLE = {"u": "user", "a": "assistant"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if v is None else v for v in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def plain_repair(rows, faults):
    """Cheapest edits by cost, then text: a shortest-path search over (row, last role)."""
    heap, settled = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, kept = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in kept)
        if (i, last) in settled:
            continue
        settled.add((i, last))
        for r in "ua":
            if (last, r) in STEP:
                heapq.heappush(heap, (cost + 2, audit + "I", i, r, (*kept, (ROLE[r], ""))))
        if i == len(rows):
            continue
        _, _, role, text = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, kept))
        if faults[i] in ("blank", "duplicate"):
            continue
        more = faults[i] == "truncated"
        if (last, role[:1]) in STEP:
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*kept, (role, text))))
        for r in "ua":
            if (last, r) in STEP:
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, r, (*kept, (ROLE[r], text))))


def order(row):
    _, turn, role, text = row
    key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
    return turn is not None, turn or 0, key


def plain(rows, damage=True):
    after = plain_damage(rows) if damage else [(c, t, r or "", x or "") for c, t, r, x in rows]
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=order)
        faults = faults_of(own)
        turns = {t for _, t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, repaired = plain_repair(own, faults)
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest())
    return out


def results(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def table(seed, conversations=60, longest=12):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "ursa", "Assistant"]
    texts = ["Yes.", "no", "Why?  \n", " ", "", None, "é!", "done?!", "漢。", "a\x85"]
    rows = []
    for c in range(conversations):
        turn = rng.randrange(3)
        for _ in range(rng.randrange(1, longest)):
            rows.append((c, turn, rng.choices(roles, (9, 9, 3, 1, 1, 1, 1, 1))[0], rng.choice(texts) if rng.random() < 0.6 else f"text {rng.randrange(99)}."))
            turn += rng.choice([1, 1, 1, 2, 3, 0])
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (90, None, None, None), (90, None, None, None), (91, 5, "user", "x." * 20_000)]
    return rows + [rows[0], rows[0], rows[3]]


@pytest.mark.parametrize("size", [repair.SEGMENT, 3, 1])
def test_agrees_with_the_search(spark, frame, size):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # conversations over several ranges
    try:
        rows = table(size)
        rows += [(200, i // 2, ("user", "assistant", "system")[i % 3], f"{i % 50}{'.' if i % 4 else ''}") for i in range(300)]
        clash = [(*r, "x", 1) for r in rows]
        got = repair.repair(repair.damaged(frame(clash, f"{TURNS}, conv string, segment int")), present=repair.F.col("present"), size=size)
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert results(got) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_undamaged_rows(frame):
    rows = table(8, 30)
    assert results(repair.repair(frame(rows, TURNS))) == plain(rows, damage=False)


def test_every_short_sequence():
    """All sequences of up to 4 symbols, compressed or not, agree with the search."""
    symbols = [(r, t) for r in "suax" for t in ("ok.", "cut")] + [("u", "")]
    codes = [c + 4 * f for c in range(4) for f in (0, 1)] + [1 + 4 * repair.BLANK]
    grammar = repair.Grammar()
    for pair in [(1, 2), (9, 9), (1, 1), (repair.GONE, 1), (5, 2), (2, 1), (9, 1)]:
        assert grammar.add(pair)
    run = grammar.compressor()
    for n in range(5):
        for picks in itertools.product(range(len(symbols)), repeat=n):
            rows = [(0, i, symbols[k][0], f"{i}{symbols[k][1]}" if symbols[k][1] else "") for i, k in enumerate(picks)]
            want = plain_repair(rows, faults_of(rows))[:2]
            states = repair.stepped([(0, None), None, None, None], repair.INSERTIONS)
            for s in run([codes[k] for k in picks]):
                matrix = [[None if e is None else (e[0], repair.spelled(e[1])) for e in row] for row in grammar.matrices[s]]
                states = repair.stepped(states, matrix)
            cost, path = min((states[q] for q in repair.ENDS if states[q]), key=lambda s: (s[0], "".join(e for _, e in repair._path(s[1]))))
            assert (cost, "".join(e for _, e in repair._path(path))) == want, rows


def test_grammar_is_learned_and_bounded(frame):
    rows = [([1, 2] * k,) for k in range(1, 40)] + [([0, 1, 2],)] * 9 + [([],), ([8],)]
    grammar = repair.learn(frame(rows, "codes array<int>"), rounds=6, per_round=4, longest=16)
    assert grammar.rules[0] == (1, 2) and max(grammar.spans) == 16
    assert len(grammar.compressed([1, 2] * 32)) == 4
    for (a, b), span in zip(grammar.rules, grammar.spans[9:]):
        assert span == grammar.spans[a] + grammar.spans[b]


def test_nothing_left_and_empty_table(frame):
    empty = hashlib.sha256(b"").hexdigest()
    gone = frame([(5, 1, "user", "Hi.", False), (5, None, None, None, None), (6, 1, "user", "", True)], f"{TURNS}, there boolean")
    got = results(repair.repair(gone, present=repair.F.col("there")))
    assert got == {5: (0, 0, 0, 0, 0, 0, "", empty), 6: (0, 1, 0, 0, 0, 3, "D", empty)}
    assert repair.repair(frame([], TURNS)).count() == 0
