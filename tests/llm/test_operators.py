"""Chat formats, neighbours, licenses, pieces, toxicity, mixing and the pipeline."""

from __future__ import annotations

import json
import random
import re
import struct
import zlib

import numpy as np
import pytest
from check_queries import ROOT, compare, connect
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from zonewright.llm import chat, licenses, mixing, neighbours, pieces, toxicity

FOLDER = f"{ROOT}/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op1_chat_format", "op7_exact_dedup", "op10_mixing"])
def test_agrees_with_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name, queries()[name], oracle_sql()[name]) == []


# ---- chat


RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, "messages", [("user", "a"), ("assistant", "")]),
    ({"system": "s", "messages": []}, "messages", [("system", "s")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}], "id": 7}, "shared", [("user", "q"), ("assistant", "r")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"context": "k", "question": "q", "answer": 5}, "question_answer", [("user", "k\n\nq"), ("assistant", "5")]),
    ({"role": "bot", "text": "t"}, "row", [("bot", "t")]),
    ({"prompt": "p", "completion": "c", "response": "r"}, None, []),
    ({"unknown": 1}, None, []),
    ([1, 2], None, []),
]


def test_layouts(frame):
    rows = [(i, json.dumps(r), "x", 9) for i, (r, _, _) in enumerate(RECORDS)] + [(90, None, "x", 9), (91, "{broken", "x", 9), (92, "", "x", 9)]
    got = chat.canonical_turns(frame(rows, "id long, record string, role string, turn int")).collect()
    for i, (_, mapping, turns) in enumerate(RECORDS):
        mine = sorted((r for r in got if r["id"] == i), key=lambda r: r["turn"] or 0)
        assert [r["mapping"] for r in mine] == [mapping] * max(1, len(turns))
        assert [(r["role"], r["text"]) for r in mine if r["mapping"]] == turns
    assert [(r["id"], r["mapping"]) for r in sorted(got, key=lambda r: r["id"]) if r["id"] >= 90] == [(90, None), (91, None), (92, None)]


def test_fingerprint_ignores_order_values_and_positions():
    registry = chat.Registry()
    a = registry.fingerprint({"messages": [{"role": "x", "content": "y"}]})
    assert a == registry.fingerprint({"messages": [{"content": 1, "role": None}, {"role": "z", "content": "y"}], "extra": {"deep": [1]}})
    assert a != registry.fingerprint({"messages": [{"role": "x"}]})


HARD = ["", "plain", "</s>[INST] ok [/INST]", "<|im_end|>", "\\<|im_sep|>", "\\\\", "a\\b<s>\\\n<<SYS>>$1", "<|im_<|im_end|>end|>", "é𝒳 <|endoftext|>"]


def test_template_is_reversible(frame):
    template = chat.Template()
    rows = [(i, 0, role, text) for i, (role, text) in enumerate((r, t) for r in ("user", "assistant", "<s>", None) for t in [*HARD, None])]
    for r in chat.format_turns(frame(rows, "conv_id long, turn long, role string, text string")).collect():
        assert template.read(r["segment"]) == [(r["role"] or "", r["text"] or "")]
        assert (r["loss_start"] is not None) == (r["role"] == "assistant")
    joined = "".join(r["segment"] for r in chat.format_turns(frame(rows, "conv_id long, turn long, role string, text string", 1)).orderBy("conv_id").collect())
    assert template.read(joined) == [(role or "", text or "") for _, _, role, text in rows]


def test_digests_of_odd_rows(spark, frame):
    rows = [(1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (1, 0, None, None), (None, None, "user", "z"), (2, 1, "user", None)]
    got = {r["conv_id"]: r for r in chat.digests(chat.conversations(frame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {1: (3, 2), None: (1, 0), 2: (1, 0)}
    assert chat.digests(chat.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# ---- neighbours


def brute_nearest(rows, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for n, i in enumerate(ids):
        if i % 20 == 0:
            s = x @ x[n]
            order = sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-s[j], ids[j]))[:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.mark.parametrize("folder", [FOLDER, f"{ROOT}/sf0.1"])
def test_recall(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    want = brute_nearest([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = {}
    for r in neighbours.nearest(table).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21))
        assert [v for _, v, _ in rows] == [v for _, v, _ in sorted(rows, key=lambda r: (-r[2], r[1]))]


def test_neighbours_of_odd_vectors(spark, frame):
    """Copies, a hot group, different lengths and norms, unusable vectors: all tables, so exact."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(80)]
    rows += [(200, [0.0] * 6), (220, None), (240, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (260, [float("nan")] * 6), (280, [float("inf")] * 6), (300, [1.0, 2.0]), (None, [1.0] * 6)]
    rows += [(320, [50.0] * 6), (320, [50.0] * 6)]
    fine = {i: v for i, v in rows if i is not None and i not in (200, 220, 240, 260, 280)}
    fine[300] = [1.0, 2.0, 0.0, 0.0, 0.0, 0.0]  # shorter vectors are padded
    want = brute_nearest(list(fine.items()))
    got = {}
    table = frame(rows, "vec_id long, embedding array<double>").withColumn("ids", F.lit(1)).withColumn("key", F.lit("x"))
    for r in neighbours.nearest(table, tables=4, probes=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def lists_of(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("lengths", ["one", "outlier", "lognormal", "two scales"])
def test_recall_with_vectors_of_any_length(frame, lengths):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    if lengths == "outlier":
        x[17] *= 10
    elif lengths == "lognormal":
        x *= np.exp(rng.normal(size=3000) * 0.5)[:, None]
    elif lengths == "two scales":
        x[::2] *= 1e6
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, got = brute_nearest(rows), lists_of(neighbours.nearest(frame(rows, "vec_id long, embedding array<double>")))
    assert set(got) == set(want) and all(len(hits) == 20 for hits in got.values())
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_few_vectors_find_each_other(frame):
    """Fewer candidates than asked for: the default probes give all of them."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=64) * 10.0 ** (i % 5)).tolist()) for i in range(15)] + [(20, [1e200] * 64), (40, [1e-200] * 64)]
    want, got = brute_nearest(rows), lists_of(neighbours.nearest(frame(rows, "vec_id long, embedding array<double>")))
    assert {q: [v for v, _ in hits] for q, hits in got.items()} == {q: [v for v, _ in hits] for q, hits in want.items()}
    assert all(len(hits) == 16 for hits in got.values())


def test_an_id_with_several_vectors(frame):
    """The least one stands for it, so a query has one list."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0])]
    got = lists_of(neighbours.nearest(frame(rows, "vec_id long, embedding array<double>")))
    assert got == {0: [(1, 2.0), (2, 0.0)]}


# ---- licenses


def full_alignment(template, text):
    """Most matched template words over all local alignments (no band)."""
    best, before = (0, 0), [(0, 0)] * (len(text) + 1)
    for w in template:
        now = [(0, 0)]
        for j, t in enumerate(text):
            s, c = before[j]
            cell = (s + 2, c + 1) if t == w else (s - 1, c)
            for other in (before[j + 1], now[j]):
                if other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, other[1])
            now.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, now[-1])
        before = now
    return best[1]


def test_edited_notices_have_candidates():
    """One edit anywhere in a notice of five words or more, within its fifth."""
    index = licenses.Index()
    for name, text in licenses.TEMPLATES.items():
        words = licenses.WORDS.findall(text.lower())
        if not 5 <= len(words) <= 40:
            continue
        for i in range(len(words)):
            changed = [*words[:i], "zzz", *words[i + 1 :]]
            for edited in (changed, words[:i] + words[i + 1 :], [*words[:i], "zzz", *words[i:]]):
                found = {r[0]: r[2] for r in index.scan("foo " + " ".join(edited) + " bar")}
                want = full_alignment(words, edited)
                if want >= 0.8 * len(words):
                    assert found.get(name) == want, (name, edited)
    assert {r[0] for r in index.scan("Released under an MIT License.")} == {"MIT notice"}


@pytest.mark.parametrize("m", range(1, 60))
def test_grams_follow_from_edits(m):
    gram, window = licenses.gram_and_window(m)
    edits = int(0.2 * m + 1e-9)
    sizes = [len(x) for x in np.array_split(np.arange(m - edits), edits + 1)]  # the most even cut
    assert gram + window - 1 <= max(sizes)


def test_templates_from_a_folder(spark, frame, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("You may share\nthis work, once.")
    (tmp_path / "Tiny").write_text("copyleft")
    (tmp_path / "Empty.txt").write_text("--")
    templates = licenses.read_templates(spark, str(tmp_path))
    assert set(templates) == {"Own-1.0", "Tiny", "Empty"}
    rows = frame([(1, "so: you may share this thing once"), (2, "copyleft, again COPYLEFT"), (3, None)], "doc_id long, text string")
    got = licenses.scan(rows, templates).select("doc_id", "license", "matched").collect()
    assert sorted(tuple(r) for r in got) == [(1, "Own-1.0", 5), (2, "Tiny", 1), (2, "Tiny", 1)]
    assert licenses.scan(rows.where("false")).count() == 0
    assert licenses.scan(rows, {}).count() == 0
    with pytest.raises(ValueError):
        licenses.read_templates(spark, str(tmp_path), 3)
    with pytest.raises(ValueError):
        licenses.scan(rows.withColumnRenamed("doc_id", "license"), id_col="license")


def test_licenses(spark, frame):
    rng = random.Random(8)
    filler = lambda n: " ".join(rng.choice(["the", "of", "license", "work", "xyz", "under", "foo"]) for _ in range(n))
    rows, planted = [], {}
    for i, name in enumerate(sorted(licenses.TEMPLATES) * 2):
        words = licenses.TEMPLATES[name].split()
        if i >= len(licenses.TEMPLATES) and len(words) > 14:  # changed copies of the long ones
            words[len(words) // 2] = "changed"
            del words[-2]
        rows.append((i, f"{filler(30)}\n{' '.join(words).upper()}\n{filler(20)}", "k"))
        planted[i] = name
    rows += [(900, filler(300), "k"), (901, None, "k"), (902, "", "k"), (903, "MIT", "k"), (None, licenses.TEMPLATES["MIT notice"], "k")]
    got = licenses.scan(frame(rows, "doc_id long, text string, license string")).collect()
    found = {(r["doc_id"], r["license"]): r for r in got}
    for i, name in planted.items():
        r = found[i, name]
        text = rows[i][1]
        template = licenses.WORDS.findall(licenses.TEMPLATES[name].lower())
        assert r["matched"] == full_alignment(template, licenses.WORDS.findall(text.lower()))
        assert r["coverage"] == r["matched"] / len(template) >= 0.8
        inside = licenses.WORDS.findall(text[r["start"] : r["end"]].lower())
        assert full_alignment(template, inside) == r["matched"]
    assert {i for i, _ in found} == {*planted, None}
    for (i, name), r in found.items():  # nothing below the brute-force result
        if i is not None and name not in (planted[i],):
            template = licenses.WORDS.findall(licenses.TEMPLATES[name].lower())
            assert full_alignment(template, licenses.WORDS.findall(rows[i][1].lower())) >= 0.8 * len(template)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert licenses.scan(frame(rows, "doc_id long, text string, license string"), {}).count() == 0


def test_license_lines_of_the_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0 notice", "Released under the MIT License.": "MIT notice",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0 notice", "Licensed under the Apache License, Version 2.0.": "Apache-2.0 notice"}
    want = {(r["doc_id"], name) for line, name in lines.items() for r in docs.where(F.col("text").contains(line)).select("doc_id").collect()}
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()}
    assert want and want == got


# ---- pieces


def _number(raw, j):
    n = s = 0
    while True:
        c = raw[j]
        j, n, s = j + 1, n | (c & 127) << s, s + 7
        if c < 128:
            return n, j


def _fields(raw):
    j = 0
    while j < len(raw):
        tag, j = _number(raw, j)
        if tag & 7 == 0:
            value, j = _number(raw, j)
        else:
            size, j = _number(raw, j) if tag & 7 == 2 else ({5: 4, 1: 8}[tag & 7], j)
            value, j = raw[j : j + size], j + size
        yield tag >> 3, tag & 7, value


def _varint(n):
    out = b""
    while n >= 128:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, kind, value):
    return _varint(number << 3 | kind) + (_varint(value) if kind == 0 else _varint(len(value)) + value if kind == 2 else value)


def library(path, scores):
    """The library's own unigram decoder over the same pieces and scores."""
    import sentencepiece

    out, k = b"", 0
    for number, kind, value in _fields(open(path, "rb").read()):
        if number == 1:
            value = b"".join(_field(*f) for f in _fields(value) if f[0] != 2) + _field(2, 5, struct.pack("<f", scores[k]))
            k += 1
        if number == 2:
            value = b"".join(_field(*f) for f in _fields(value) if f[0] != 3) + _field(3, 0, 1)
        out += _field(number, kind, value)
    return sentencepiece.SentencePieceProcessor(model_proto=out)


ODD_TEXTS = ["", " ", "  ", " a", "a ", "Hello  wörld\n\tx ☃𝒳 end", "\n\n", "ab" * 400, "日本語 テキスト", "tab\tnull\0", "x " * 3000]


def test_pieces(spark, frame):
    vocabulary = pieces.load()
    judge = library(pieces.MODEL, vocabulary.scores)
    texts = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(300).collect()] + ODD_TEXTS
    rows = [(i, t, 3) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in pieces.decode(pieces.encode(frame(rows, "doc_id long, text string, ids int"), vocabulary), vocabulary).collect()}
    total = lambda ids: sum(vocabulary.scores[i] if vocabulary.byte_ids.tolist().count(i) == 0 else 0.0 for i in ids)
    for i, t in enumerate(texts):
        r, want = got[i], judge.encode(t)
        assert r["decoded"] == t and r["round_trip"] and r["n_tokens"] == len(r["ids"])
        if r["ids"] != want:  # another path of the same score
            assert total(r["ids"]) == pytest.approx(total(want), abs=1e-3)
            assert sum(j in vocabulary.byte_ids for j in want) == r["n_byte_tokens"]


def test_pieces_of_the_marker_null_and_long_texts(spark, frame, monkeypatch):
    vocabulary = pieces.load()
    monkeypatch.setattr(pieces, "SLICE_CHARS", 500)
    rng = random.Random(2)
    long = "".join(rng.choice(["word ", "  two", "\n", "▁", "é", " ", "x" * 60]) for _ in range(4000))
    rows = [(1, "▁x▁ y▁▁", "a"), (2, None, "a"), (3, long, "a"), (4, long.strip(), "a"), (None, "n", "a")]
    whole = vocabulary.encoder()([long])[0].tolist()
    got = {r["doc_id"]: r for r in pieces.round_trip(frame(rows, "doc_id long, text string, decoded string"), vocabulary).collect()}
    assert all(r["round_trip"] for r in got.values()) and got[2]["ids"] == []
    monkeypatch.setattr(pieces, "SLICE_CHARS", 1 << 20)
    assert vocabulary.encoder()([long])[0].tolist() == whole == got[3]["ids"]
    assert pieces.round_trip(spark.createDataFrame([], "doc_id long, text string"), vocabulary).count() == 0


def test_double_array():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choices(range(256) if k % 2 else b"abc", k=rng.randint(1, 6))) for k in range(3000)})
    trie = pieces.DoubleArray(keys, list(range(len(keys))))

    def get(key):
        s = 0
        for c in key:
            t = int(trie.base[s]) + c
            if trie.check[t] != s:
                return -1
            s = t
        return int(trie.value[s])

    assert [get(k) for k in keys] == list(range(len(keys)))
    assert all(get(k + b"\xff\x00\xff") == -1 for k in keys)


# ---- toxicity


def test_held_out_toxicity(spark):
    """At sf0.1; the smaller tables have two to five toxic texts of some languages."""
    folder = f"{ROOT}/sf0.1"
    rows = queries()["op9_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    right = {label: np.mean([r["predicted"] == label for r in out if r["toxic"] == label]) for label in (0, 1)}
    assert len(out) > 500 and right[0] >= 0.98 and right[1] >= 0.9, right


def test_folding_and_exceptions():
    entry = lambda w: f" {toxicity.fold(w).strip()}"
    lexicon = toxicity.Lexicon({entry("idiot"): 5.0, entry("scum") + " ": 4.0, entry("trash"): 4.0}, ("trash can",), -3.0, (1.0, 1.0))
    clean = lexicon.score("a quiet day")
    for text in ("you idiot", "you 1d10t!", "IDIOTS, all", "іdіоt", "ｉｄｉｏｔ", "id​iot", "such scum"):
        assert lexicon.score(text) > clean, text
    for text in ("", "scummy", "the trash can is full", "vidiot", "12 1010"):
        assert lexicon.score(text) == clean, text
    assert lexicon.score("idiot " + "word " * 5000) < lexicon.score("idiot")


def test_toxicity_of_odd_tables(spark, frame):
    rows = [(i, "bad vile word" if i % 3 == 0 else f"fine text {i}", "score") for i in range(90)] + [(900, None, "x"), (901, "", "x"), (None, "vile", "x"), (0, "again", "x")]
    labels = [(i, int(i % 3 == 0)) for i in range(90)] + [(900, 1), (None, 1), (901, None)]
    docs, labels = frame(rows, "doc_id long, text string, score string"), frame(labels, "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    got = toxicity.score(docs, lexicon).collect()
    assert len(got) == len(rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, lexicon).count() == 0 and toxicity.learn(empty, labels).entries == {}
    assert toxicity.clean(docs, lexicon).columns == docs.columns


def test_bounded_sample_keeps_the_rate(spark, frame):
    """A fit on 700 of each label scores like the fit on all 10,000 and 1,000."""
    rng = random.Random(8)
    words = [f"{i}word".translate(str.maketrans("0123456789", "bcdfghjkmn")) for i in range(300)]
    rows, labels = [], []
    for i in range(11000):
        toxic = i % 11 == 0
        text = rng.choices(words, k=12)
        if rng.random() < (0.9 if toxic else 0.12):
            text[rng.randrange(12)] = "vilescum"
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs, labels = frame(rows, "doc_id long, text string"), frame(labels, "doc_id long, toxic int")
    whole, part = toxicity.learn(docs, labels), toxicity.learn(docs, labels, per_label=700)
    for text in ("bword cword dword", "bword vilescum cword " + "dword " * 9):
        assert abs(whole.score(text) - part.score(text)) < 0.06, (whole.score(text), part.score(text))
    predicted = [[lexicon.score(r[1]) >= toxicity.THRESHOLD for r in rows[:1000]] for lexicon in (whole, part)]
    assert np.mean(np.equal(*predicted)) > 0.97


# ---- mixing


def test_mix(frame, spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randrange(0, 40)), None, rng.choice(["a", "b", "b", "b", "b", "ü", None, "z"]), 7) for i in range(3000)]
    rows += [(1, "same text", None, "hot", 0)] * 500 + [(None, None, None, None, 0), (5000, "", None, "empty", 0)]
    df = frame(rows, DOCS).withColumn("size", F.lit("clash"))
    got = mixing.mix(df, range_rows=16).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for rs in by.values():
        assert {r["source_size"] for r in rs} == {sum(r["size"] for r in rs)}
        assert sum(r["taken"] for r in rs) == round(rs[0]["target"])
    # water filling by rounds
    sizes = {s: rs[0]["source_size"] for s, rs in by.items()}
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, total = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        level = (total - sum(full.values())) / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not above:
            break
        full |= {s: 2 * sizes[s] for s in above}
    for s, rs in by.items():
        assert rs[0]["target"] == pytest.approx(full.get(s, level * weight[s]))
    plain = lambda rs: sorted(((r["doc_id"], r["source"], r["taken"]) for r in rs), key=repr)
    assert plain(got) == plain(mixing.mix(df, range_rows=100_000).collect())
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    copies = mixing.mixture(frame(rows, DOCS))
    assert copies.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    words = copies.groupBy("source").agg(F.sum(mixing.words()).alias("n")).collect()
    longest = max(len((r[1] or "").split()) for r in rows)
    assert all(abs((r["n"] or 0) - by[r["source"]][0]["target"]) <= longest for r in words)


def test_mix_runs_without_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    given = {r["doc_id"]: r for r in docs.collect()}
    scores = {r["doc_id"]: r["predicted"] for r in queries()["op9_toxicity"](spark, FOLDER).collect()}
    kept = corpus_pipeline.drop_toxic(spark, docs, FOLDER)
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {i for i, p in scores.items() if p == 0}
    once = corpus_pipeline.drop_copies(spark, kept, FOLDER).collect()
    least = {}
    for i in sorted(ids, reverse=True):
        least[re.sub(r"[\x20\x09-\x0D]+", " ", given[i]["text"])] = i
    assert sorted(r["doc_id"] for r in once) == sorted(least.values())
    final = corpus_pipeline.run(spark, FOLDER).collect()
    assert final and all(r["round_trip"] for r in final)
    vocabulary = pieces.load()
    assert all(vocabulary.decode(r["ids"]) == given[r["doc_id"]]["text"] for r in final[:50])
    assert {r["doc_id"] for r in final} <= {r["doc_id"] for r in once}
    assert max(sum(1 for r in final if r["doc_id"] == i) for i in {r["doc_id"] for r in final}) <= 2
