"""Repair of conversation structure by grammar-compressed dynamic programming.

A row becomes a symbol: the class of its role's initial and its fault. Roles
must read ``(s?(ua)+)?``; four states say what may follow. Keeping, re-roling,
deleting a row and the insertions behind it are a 4 x 4 min-plus matrix per
symbol, each entry the least cost between two states and the edits that reach
it, the ASCII-least of equal cost. (Two strings of edits of equal cost over the
same rows never begin one another, as more insertions cost more; so the least
of a product is the product of the least.)

Re-Pair names frequent neighbours among all symbol sequences. Pairs are counted
over all rows, in rounds that each take the most frequent ones. A rule's matrix
is the product of its two parts', with a rope for the edits, made once from
the bottom up and used by every conversation. A sequence then is a few factors.

Conversations lie in ranges of a global order, in segments of bounded length; a
long one is many segments in many ranges. Segments are multiplied out by
themselves; one pass over a conversation's segments chains them, and one over
its rows, sorted, hashes what the edits leave, holding one row at a time.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewright.llm.common import held, key_of
from zonewright.llm.ranges import placed

CLASSES = {"s": 0, "u": 1, "a": 2}
OTHER = 3
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)  # faults; a row's code is its class + 4 * its fault
GONE = 8  # symbol of a row that must be deleted; the others are class + 4 * truncated
NEXT = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})  # states: start, after s, after u, after a
ENDS = (0, 3)
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
SEGMENT = 4096
SPAN = 4096
CACHED = 100_000

Rope = str | tuple
Matrix = list[list[tuple[int, Rope] | None]]


def spelled(rope: Rope) -> str:
    out, stack = [], [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            stack += [top[1], top[0]]
    return "".join(out)


def better(a: tuple[int, Rope], b: tuple[int, Rope] | None) -> bool:
    return b is None or a[0] < b[0] or (a[0] == b[0] and spelled(a[1]) < spelled(b[1]))


def product(x: Matrix, y: Matrix) -> Matrix:
    out: Matrix = [[None] * 4 for _ in range(4)]
    for p in range(4):
        for m, first in enumerate(x[p]):
            if first is None:
                continue
            for q, second in enumerate(y[m]):
                if second is not None:
                    found = (first[0] + second[0], (first[1], second[1]))
                    if better(found, out[p][q]):
                        out[p][q] = found
    return out


def _insertions() -> Matrix:
    out: Matrix = [[None] * 4 for _ in range(4)]
    for p in range(4):
        state, count = p, 0
        while out[p][state] is None:
            out[p][state] = (count * INSERT, "I" * count)
            state, count = (3 if state == 2 else 2), count + 1
    return out


INSERTIONS = _insertions()


def terminal(symbol: int) -> Matrix:
    """The edits of one row, and the insertions behind it."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for p in range(4):
        out[p][p] = (DELETE, "D")
        if symbol == GONE:
            continue
        cut = CUT * (symbol // 4)
        if (q := NEXT[p].get(symbol % 4)) is not None:
            out[p][q] = (cut, "K")
        for role in (1, 2):
            if (q := NEXT[p].get(role)) is not None and better((REROLE + cut, "R"), out[p][q]):
                out[p][q] = (REROLE + cut, "R")
    return product(out, INSERTIONS)


@dataclass
class Grammar:
    """Symbols 0 to 8 are terminals; rule i names the pair of symbol 9 + i."""

    rules: list[tuple[int, int]] = field(default_factory=list)
    spans: list[int] = field(default_factory=lambda: [1] * (GONE + 1))
    matrices: list[Matrix] = field(default_factory=lambda: [terminal(s) for s in range(GONE + 1)])

    def __post_init__(self) -> None:
        self.number = {pair: GONE + 1 + i for i, pair in enumerate(self.rules)}

    def add(self, pair: tuple[int, int], longest: int = SPAN) -> bool:
        span = self.spans[pair[0]] + self.spans[pair[1]]
        if pair in self.number or span > longest:
            return False
        self.number[pair] = len(self.spans)
        self.rules.append(pair)
        self.spans.append(span)
        self.matrices.append(product(self.matrices[pair[0]], self.matrices[pair[1]]))
        return True

    def compressed(self, symbols: Sequence[int]) -> list[int]:
        """Rules in the order they were made, each from left to right."""
        out = list(symbols)
        while len(out) > 1:
            named = min((self.number[p] for p in zip(out, out[1:]) if p in self.number), default=None)
            if named is None:
                break
            a, b = self.rules[named - GONE - 1]
            shorter, i = [], 0
            while i < len(out):
                if out[i] == a and i + 1 < len(out) and out[i + 1] == b:
                    shorter.append(named)
                    i += 2
                else:
                    shorter.append(out[i])
                    i += 1
            out = shorter
        return out

    def compressor(self):
        """``compressed`` with a bounded memory of the sequences met."""
        known: dict[tuple, list[int]] = {}

        def run(codes: Sequence[int]) -> list[int]:
            key = tuple(codes)
            if key not in known:
                if len(known) > CACHED:
                    known.clear()
                known[key] = self.compressed([GONE if c >= 4 * DUPLICATE else c for c in key])
            return known[key]

        return run


# A path is (path before, edits, number of steps); None before the first step.


def _less(a: tuple | None, x: str, b: tuple | None, y: str) -> bool:
    """Whether path a then x spells less than path b then y. Only what they do not share is spelled."""
    left, right = [x], [y]
    while a is not b:
        left.append(a[1])
        right.append(b[1])
        a, b = a[0], b[0]
    return "".join(reversed(left)) < "".join(reversed(right))


def stepped(states: list[tuple[int, tuple | None] | None], matrix: list[list[tuple[int, str] | None]]) -> list:
    """The best (cost, path) per state after one more factor."""
    found: list[tuple[int, tuple | None, str, int] | None] = [None] * 4
    for p, state in enumerate(states):
        if state is None:
            continue
        for q, entry in enumerate(matrix[p]):
            if entry is None:
                continue
            cost, old = state[0] + entry[0], found[q]
            if old is None or cost < old[0] or (cost == old[0] and _less(state[1], entry[1], old[1], old[2])):
                found[q] = (cost, state[1], entry[1], p)
    return [None if f is None else (f[0], (f[1], f[2], f[3])) for f in found]


def _path(path: tuple | None) -> list[tuple[int, str]]:
    """(state before, edits) per step."""
    out = []
    while path is not None:
        out.append((path[2], path[1]))
        path = path[0]
    return out[::-1]


def learn(segments: DataFrame, rounds: int = 8, per_round: int = 32, longest: int = SPAN) -> Grammar:
    """Rules for the most frequent neighbours of the symbols in ``codes``. Every
    round counts all pairs as left by the rules so far; per task, so that an
    exchange carries one row per task and pair, and takes at most ``per_round``."""
    grammar = Grammar()
    for _ in range(rounds):

        def count(parts: Iterator[pa.RecordBatch], grammar: Grammar = grammar) -> Iterator[pa.RecordBatch]:
            run, seen = grammar.compressor(), Counter()
            for part in parts:
                for codes in part.column(0):
                    symbols = run(codes.as_py())
                    seen.update(zip(symbols, symbols[1:]))
            rows = [(a, b, n) for (a, b), n in seen.items() if grammar.spans[a] + grammar.spans[b] <= longest]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["a", "b", "n"])

        pairs = segments.select("codes").mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        top = pairs.where("n > 1").orderBy(F.desc("n"), "a", "b").limit(per_round).collect()
        if not [p for p in top if grammar.add((p["a"], p["b"]), longest)]:
            break
    return grammar


_SEGMENT = "conv string, range int, segment long, codes array<int>, turns long, first_turn long, last_turn long"


def _scanned(rows: DataFrame, size: int) -> DataFrame:
    """Segments of conversations, from rows in order; and the first row of each
    (role, text) in conversations that may go on in another range (``digest``
    set, ``i`` its place among the rows of the segment)."""
    names = ["conv", "range", "segment", "codes", "turns", "first_turn", "last_turn", "digest", "i"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, first_conv, seen, segment, where = None, True, {}, None, 0

        def close() -> None:
            nonlocal segment
            if segment is not None:
                number, codes, turns = segment
                distinct = list(dict.fromkeys(t for t in turns if t is not None))
                done.append((conv, where, number, codes, len(distinct), distinct[0] if distinct else None, distinct[-1] if distinct else None, None, None))
            segment = None

        def leave(is_last: bool) -> None:
            close()
            if first_conv or is_last:
                done.extend((conv, where, number, None, None, None, None, digest, i) for digest, (number, i) in seen.items())
            seen.clear()

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kind) for k, kind in enumerate(kinds)], names=names)
            done.clear()
            return out

        for part in parts:
            for name, where_, at, turn, present, initial, fault, digest in zip(*(c.to_pylist() for c in part.columns)):
                if name != conv:
                    if conv is not None:
                        leave(False)
                        first_conv = False
                    conv, where = name, where_
                if segment is None or at // size != segment[0]:
                    close()
                    segment = (at // size, [], [])
                if not present:
                    continue
                if fault != BLANK:
                    if digest in seen:
                        fault = DUPLICATE
                    else:
                        seen[digest] = (segment[0], len(segment[1]))
                segment[1].append(initial + 4 * fault)
                segment[2].append(turn)
            if len(done) > 5_000:
                yield batch()
        if conv is not None:
            leave(True)
        yield batch()

    columns = rows.select("conv", "range__", "at__", "turn", "present", "initial", "fault", "digest")
    return held(columns.mapInArrow(step, f"{_SEGMENT}, digest string, i long"))


def _with_late_duplicates(scanned: DataFrame) -> DataFrame:
    """Segments, with the rows that repeat one of an earlier range marked. A
    text has one entry per range of its conversation; a segment takes at most as many marks as rows."""
    entry = F.struct("range", "segment", "i")
    firsts = scanned.where("digest IS NOT NULL").select("conv", "digest", entry.alias("entry"))
    earliest = firsts.groupBy("conv", "digest").agg(F.min("entry").alias("earliest"), F.collect_list("entry").alias("entries")).where(F.size("entries") > 1)
    late = earliest.select("conv", "earliest", F.explode("entries").alias("e")).where("e != earliest")
    marks = late.groupBy("conv", F.col("e.range").alias("range"), F.col("e.segment").alias("segment")).agg(F.collect_set("e.i").alias("late"))
    segments = scanned.where("digest IS NULL").drop("digest", "i").join(marks, ["conv", "range", "segment"], "left")
    fixed = F.transform("codes", lambda c, i: F.when(F.array_contains("late", i.cast("long")), c % 4 + 4 * DUPLICATE).otherwise(c))
    return segments.withColumn("codes", F.when(F.col("late").isNotNull(), fixed).otherwise(F.col("codes"))).drop("late")


_STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _solved(segments: DataFrame, grammar: Grammar, parts: int) -> DataFrame:
    """(conv, range, segment, edits, state, gaps, ..., cost) per segment."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = grammar.compressor()
        spelled_out: dict[int, list] = {}
        for batch in batches:
            costs, edits = [], []
            for codes in batch.column(batch.schema.get_field_index("codes")):
                symbols = run(codes.as_py())
                for s in symbols:
                    if s not in spelled_out:
                        spelled_out[s] = [[None if e is None else (e[0], spelled(e[1])) for e in row] for row in grammar.matrices[s]]
                cost_row, edit_row = [], []
                for p in range(4):
                    states = [(0, None) if q == p else None for q in range(4)]
                    for s in symbols:
                        states = stepped(states, spelled_out[s])
                    cost_row += [None if s is None else s[0] for s in states]
                    edit_row += [None if s is None else "".join(e for _, e in _path(s[1])) for s in states]
                costs.append(cost_row)
                edits.append(edit_row)
            columns = [pa.array(costs, pa.list_(pa.int64())), pa.array(edits, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "costs", "edits"])

    factors = segments.mapInArrow(multiply, f"{_SEGMENT}, costs array<long>, edits array<string>")
    names = ["conv", "range", "segment", "edits", "state", *_STATS]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * len(_STATS)]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, places, states, stats, edge = None, [], [], [], None

        def finish() -> None:
            (first, last, turns), faults, illegal = stats
            cost, path = min((states[q] for q in ENDS if states[q] is not None), key=lambda s: (s[0], "".join(e for _, e in _path(s[1]))))
            steps = _path(path)
            ahead = steps[0][1]  # insertions ahead of the first row
            gaps = last - first + 1 - turns if turns else 0
            for (range_, number), (state, edits) in zip(places, steps[1:]):
                done.append((conv, range_, number, ahead + edits, 0 if ahead else state, gaps, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, cost))
                ahead = ""

        for batch in batches:
            for name, range_, number, codes, turns, first, last, costs, edits in zip(*(c.to_pylist() for c in batch.columns)):
                if name != conv:
                    if conv is not None:
                        finish()
                    conv, places, edge = name, [], None
                    states = stepped([(0, None), None, None, None], INSERTIONS)
                    stats = [[None, None, 0], Counter(), 0]
                span, faults, _ = stats
                if turns:
                    span[2] += turns - (span[1] == first)
                    span[0], span[1] = first if span[0] is None else span[0], last
                faults.update(c // 4 for c in codes)
                roles = ([edge] if edge is not None else []) + [c % 4 for c in codes]
                stats[2] += sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(roles, roles[1:]))
                edge = roles[-1] if roles else edge
                matrix = [[None if costs[4 * p + q] is None else (costs[4 * p + q], edits[4 * p + q]) for q in range(4)] for p in range(4)]
                states = stepped(states, matrix)
                places.append((range_, number))
            if len(done) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names=names)
                done = []
        if conv is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names=names)

    dealt = factors.repartition(parts, "conv").sortWithinPartitions("conv", "range", "segment")
    return dealt.mapInArrow(chain, f"conv string, range int, segment long, edits string, state int, {', '.join(f'{s} long' for s in _STATS)}")


def _rebuilt(rows: DataFrame, solved: DataFrame, size: int, parts: int) -> DataFrame:
    """conv, the numbers, audit and repaired_sha256: edits meet the rows of their segment."""
    order = ["conv", "range", "segment", "at"]
    texts = rows.where("present").select("conv", F.col("range__").alias("range"), F.floor(F.col("at__") / size).alias("segment"), F.col("at__").alias("at"), "role", "text")
    edits = solved.withColumn("at", F.lit(-1).cast("long"))
    stream = edits.unionByName(texts, allowMissingColumns=True).repartition(parts, "conv").sortWithinPartitions(*order)
    stream = stream.select("conv", "at", "role", "text", "edits", "state", *_STATS)
    names = ["conv", *_STATS, "audit", "repaired_sha256"]
    kinds = [pa.string(), *[pa.int64()] * len(_STATS), pa.string(), pa.string()]
    roles = {1: "user", 2: "assistant"}

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, numbers, audit, digest, empty, left, state = None, (), [], None, True, "", 0

        def put(role: str, text: str) -> None:
            nonlocal empty
            digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
            empty = False

        def inserted() -> None:
            """The insertions next in the edits."""
            nonlocal left, state
            rest = left.lstrip("I")
            for _ in range(len(left) - len(rest)):
                role = 2 if state == 2 else 1
                put(roles[role], "")
                state = NEXT[state][role]
            left = rest

        def finish() -> None:
            inserted()
            done.append((conv, *numbers, "".join(audit), digest.hexdigest()))

        for batch in batches:
            for name, at, role, text, edits, start, *found in zip(*(c.to_pylist() for c in batch.columns)):
                if name != conv:
                    if conv is not None:
                        finish()
                    conv, audit, digest, empty, left = name, [], hashlib.sha256(), True, ""
                if at < 0:
                    inserted()
                    numbers, left, state = found, edits, start
                    audit.append(edits)
                    continue
                inserted()
                edit, left = left[0], left[1:]
                if edit == "K":
                    put(role, text)
                    state = NEXT[state][CLASSES[role[0]]]
                elif edit == "R":
                    new = 2 if state == 2 else 1
                    put(roles[new], text)
                    state = NEXT[state][new]
            if len(done) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names=names)
                done = []
        if conv is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names=names)

    return stream.mapInArrow(step, f"conv string, {', '.join(f'{s} long' for s in _STATS)}, audit string, repaired_sha256 string")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None, size: int = SEGMENT) -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256.

    Rows of a conversation go by turn, nulls first, then by a hash of role and
    text. Rows where ``present`` is not true count only towards the list of
    conversations. Null roles and texts are empty. A null id is a conversation
    of its own. A conversation without rows has zeros, an empty audit and the
    hash of the empty text; a table without rows gives none. Other columns, of
    any name, take no part. Audit and hash run over a conversation's rows as
    they stream by, so memory does not grow with their number but for the audit
    itself, one letter per edit.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema[conv_col].dataType
    given = rows.select(
        key_of(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
    )
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.create_map(*[x for r, c in CLASSES.items() for x in (F.lit(r), F.lit(c))])
    given = given.withColumns({
        "digest": F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256),
        "initial": F.coalesce(F.try_element_at(initial, F.substring("role", 1, 1)), F.lit(OTHER)),
        "fault": F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(TRUNCATED),
    })
    ordered = placed(given, "conv", ["turn", "digest"])
    segments = held(_with_late_duplicates(_scanned(ordered, size)))
    solved = _solved(segments, learn(segments), parts)
    out = _rebuilt(ordered, solved, size, parts)
    own = F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(kind).alias(conv_col)
    return out.select(own, *_STATS[:-1], "cost", "audit", "repaired_sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """Turns with planted faults, chosen by crc32 of ``conv_id:turn``, and
    ``present``, false for dropped rows. Nulls are one space, also in that text."""
    def plain(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text"), (kind != 0).alias("present"), kind.alias("kind"))
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("copy", "kind")
