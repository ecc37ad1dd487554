"""Chat formatting: records of any layout become canonical turns, then one template.

A record's layout is told by its schema fingerprint: a hash of its nested field
paths (``messages[].role``), without values, order or positions. Each mapping
declares where a layout has its turns; the registry holds the fingerprints of
all shapes a mapping allows, so choosing one is a lookup. Paths that no mapping
mentions do not enter the fingerprint, so extra fields never hide a layout.

The template marks turns with control strings. Where a text or role holds one
(or the escape sign), the escape sign goes before it; reading undoes that.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}


@dataclass(frozen=True)
class Turn:
    """One turn, or one per element of the list ``each``. Several text paths are
    joined by a blank line. ``role`` is a constant, ``role_path`` a field whose
    value is looked up in ``ROLES`` unless it is to stay as it is."""

    texts: tuple[str, ...]
    role: str | None = None
    role_path: str | None = None
    each: str | None = None
    aliases: bool = True

    def paths(self) -> set[str]:
        inner = set(self.texts) | ({self.role_path} if self.role_path else set())
        return {f"{self.each}[].{p}" for p in inner} | {self.each, f"{self.each}[]"} if self.each else inner


@dataclass(frozen=True)
class Mapping:
    name: str
    turns: tuple[Turn, ...]
    optional: tuple[str, ...] = ()

    def paths(self) -> frozenset[str]:
        return frozenset(p for t in self.turns for p in t.paths())

    def shapes(self) -> Iterator[frozenset[str]]:
        """Every set of paths the mapping accepts: optional ones may lack, a
        list may be empty."""
        full = self.paths()
        for n in range(len(self.optional) + 1):
            for left in combinations(self.optional, n):
                rest = full - set(left)
                yield rest
                for t in self.turns:
                    if t.each:
                        yield frozenset(p for p in rest if not p.startswith(f"{t.each}["))


MAPPINGS = (
    Mapping("row", (Turn(("text",), role_path="role", aliases=False),)),
    Mapping("messages", (Turn(("system",), role="system"), Turn(("content",), role_path="role", each="messages")), optional=("system",)),
    Mapping("shared", (Turn(("system_prompt",), role="system"), Turn(("value",), role_path="from", each="conversations")), optional=("system_prompt",)),
    Mapping("instruction", (Turn(("system",), role="system"), Turn(("instruction", "input"), role="user"), Turn(("output",), role="assistant")), optional=("system", "input")),
    Mapping("prompt_completion", (Turn(("system",), role="system"), Turn(("prompt",), role="user"), Turn(("completion",), role="assistant")), optional=("system",)),
    Mapping("prompt_response", (Turn(("system",), role="system"), Turn(("prompt",), role="user"), Turn(("response",), role="assistant")), optional=("system",)),
    Mapping("question_answer", (Turn(("context", "question"), role="user"), Turn(("answer",), role="assistant")), optional=("context",)),
)


def paths_of(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value."""
    if isinstance(value, dict):
        out = set()
        for k, v in value.items():
            path = f"{at}.{k}" if at else k
            out |= {path} | paths_of(v, path)
        return out
    if isinstance(value, list):
        out = set()
        for v in value:
            out |= {f"{at}[]"} | paths_of(v, f"{at}[]")
        return out
    return set()


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


class Registry:
    """Fingerprint to mapping. Two mappings may not accept the same shape."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS) -> None:
        self.known = frozenset(p for m in mappings for p in m.paths())
        self.by_print: dict[str, Mapping] = {}
        for m in mappings:
            for shape in m.shapes():
                found = self.by_print.setdefault(fingerprint(shape), m)
                if found is not m:
                    raise ValueError(f"{found.name} and {m.name} share a layout")

    def fingerprint(self, record) -> str:
        return fingerprint(paths_of(record) & self.known)

    def turns(self, record) -> tuple[str, str | None, list[tuple[str, str]]]:
        """(fingerprint, name of the mapping or null, canonical turns)."""
        key = self.fingerprint(record)
        mapping = self.by_print.get(key)
        if mapping is None or not isinstance(record, dict):
            return key, None, []
        out = []
        for t in mapping.turns:
            if t.each:
                out += [self._turn(t, x) for x in record.get(t.each) or [] if isinstance(x, dict)]
            elif any(p in record for p in t.texts):
                out.append(self._turn(t, record))
        return key, mapping.name, out

    @staticmethod
    def _turn(turn: Turn, record: dict) -> tuple[str, str]:
        role = turn.role if turn.role is not None else record.get(turn.role_path)
        texts = [_plain(record.get(p)) for p in turn.texts if p in record]
        text = texts[0] if len(texts) == 1 else "\n\n".join(t for t in texts if t)
        role = _plain(role)
        return (ROLES.get(role, role) if turn.aliases else role), text


def _plain(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical_turns(df: DataFrame, record_col: str = "record", registry: Registry | None = None, turn_col: str = "turn") -> DataFrame:
    """One row per turn: the columns of ``df`` but the record, then layout,
    mapping, ``turn_col`` (position in the record, from 0), role, text.

    ``record_col`` holds JSON text. A record of an unknown layout, null or
    broken JSON gives one row with null mapping, role and text, so nothing is
    lost unseen; a known layout without turns gives none. Columns of ``df``
    with one of the new names are replaced.
    """
    registry = registry or Registry()
    new = ["layout", "mapping", turn_col, "role", "text"]
    df = df.drop(*[c for c in new if c != record_col])
    rest = [c for c in df.columns if c != record_col]

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, take = [], []
            for i, r in enumerate(part.column(part.schema.get_field_index(record_col))):
                try:
                    record = json.loads(r.as_py()) if r.as_py() is not None else None
                except ValueError:
                    record = None
                layout, mapping, turns = registry.turns(record)
                found = [(layout, mapping, k, role, text) for k, (role, text) in enumerate(turns)]
                if mapping is None:
                    found = [(layout, None, None, None, None)]
                rows += found
                take += [i] * len(found)
            kept = part.select(rest).take(pa.array(take, pa.int64()))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*rest, *new])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name != record_col)
    return df.mapInArrow(step, f"{fields}layout string, mapping string, `{turn_col}` long, role string, text string")


@dataclass(frozen=True)
class Template:
    """<start>role<middle>text<end>; ``others`` are control strings of other
    templates, escaped as well."""

    start: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    escape: str = "\\"
    others: tuple[str, ...] = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|endoftext|>")

    def control(self) -> str:
        """Regular expression of what needs an escape (for Java and Python)."""
        strings = sorted({self.escape, self.start, self.middle, self.end, *self.others}, key=lambda s: (-len(s), s))
        return "(" + "|".join(re.sub(r"([^\w])", r"\\\1", s) for s in strings) + ")"

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self.control()), F.lit(re.sub(r"([\\$])", r"\\\1", self.escape) + "$1"))

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(re.sub(r"([^\w])", r"\\\1", self.escape) + self.control()), F.lit("$1"))

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """Turns of a formatted conversation (one segment or many in a row)."""
        token = re.compile("(?:" + re.sub(r"([^\w])", r"\\\1", self.escape) + self.control() + ")|(" + "|".join(map(re.escape, (self.start, self.middle, self.end))) + ")", re.S)
        turns, role, kept, at = [], None, [], 0
        for m in token.finditer(formatted):
            kept.append(formatted[at : m.start()])
            at = m.end()
            if m.group(1) is not None:
                kept.append(m.group(1))
                continue
            body, kept = "".join(kept), []
            if m.group(2) == self.middle:
                role = body
            elif m.group(2) == self.end:
                turns.append((role, body))
        return turns


def format_turns(turns: DataFrame, template: Template = Template(), role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """``turns`` with ``segment``, and the loss mask of it: ``loss_start`` and
    ``loss_end``, code points in the segment (null where no loss is taken).

    A conversation's formatted text is its segments in order of turn. Segments
    are made row by row, so that a conversation of any length needs no task of
    its own. Null roles and texts are empty. Columns with the new names are
    replaced.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    head = F.concat(F.lit(template.start), template.escaped(role), F.lit(template.middle))
    body = template.escaped(text)
    own = role == F.lit(trained)
    return turns.withColumns({
        "segment": F.concat(head, body, F.lit(template.end)),
        "loss_start": F.when(own, F.char_length(head)),
        "loss_end": F.when(own, F.char_length(head) + F.char_length(body)),
    })


def digests(formatted: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Per conversation, read back from its segments in order: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The digests run over sorted rows as they stream by, so a conversation with
    a third of all rows needs no more memory than any other. Equal turn numbers
    are put in order of their segments; a null conversation is one of its own,
    null turns come first.
    """
    parts = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = formatted.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), "segment", "loss_start", "loss_end")
    rows = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in schema.split(", ")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        current, state, done = nothing, None, []
        unescape = re.compile(re.sub(r"([^\w])", r"\\\1", template.escape) + template.control())

        def row(conv):
            n, turns, chars, loss, total = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total

        for batch in batches:
            columns = [batch.column(i) for i in (0, 2, 3, 4)]
            for conv, segment, a, b in zip(*columns):
                conv, segment, a, b = conv.as_py(), segment.as_py(), a.as_py(), b.as_py()
                if current is nothing or conv != current:
                    if current is not nothing:
                        done.append(row(current))
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in template.read(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    text = unescape.sub(r"\1", segment[a:b])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(segment)
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)
                done = []
        if current is not nothing:
            done.append(row(current))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    return rows.mapInArrow(step, schema)


def conversations(df: DataFrame, registry: Registry | None = None, template: Template = Template()) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) through fingerprint, mapping
    and template; each row is a record of its own."""
    records = df.select("conv_id", F.col("turn").alias("at"), F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    turns = canonical_turns(records, registry=registry, turn_col="part")
    return format_turns(turns, template).withColumnRenamed("at", "turn")
