"""The registered queries of this folder, with DuckDB SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.llm import bpe, chat, exact_dedup, licenses, merkle, mixing, neighbours, ngrams, pieces, repair, simhash, suffixes, toxicity
from zonewright.llm.common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql.strip()
        return fn

    return register


@query(
    "op1_chat_format",
    r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, '\\|<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|\[INST\]|\[/INST\]|<s>|</s>|<<SYS>>|<</SYS>>|<\|endoftext\|>' AS control FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|><|im_sep|><|im_end|>') + length(role) + len(regexp_extract_all(role, control)) + length(text) + len(regexp_extract_all(text, control))) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
""",
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.conversations(given.unionByName(own)))


@query("op2_lm_scores")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.score(table(spark, folder, "documents"))


@query("op3_neighbours")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


@query("op4_licenses")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query("op5_pieces")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents"), pieces.load())


@query("op6_repeated_strings")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    rest = suffixes.deduplicated(table(spark, folder, "documents"))
    return rest.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op7_exact_dedup",
    r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
""",
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.assign(table(spark, folder, "documents"))


@query("op8_simhash")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.assign(table(spark, folder, "documents"))


def in_training(id_col: str):
    return remainder(id_col, 4) != 2


@query("op9_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    lexicon = toxicity.learn(docs, table(spark, folder, "labels"), in_training)
    return toxicity.score(docs, lexicon).select("doc_id", (~in_training("doc_id")).alias("held_out"), "score", "predicted")


@query(
    "op10_mixing",
    r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS o FROM d GROUP BY source),
w AS (SELECT *, CASE (o - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, cap / w AS ratio, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(w) OVER (ORDER BY cap / w, o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, ratio * 1e6 + o) AS level FROM l WHERE level <= ratio),
t AS (SELECT l.source, source_size, least(cap, coalesce(f.level * w, cap)) AS target FROM l, f),
e AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY d.source ORDER BY k, size, doc_id) - size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - epochs * source_size - start)) AS BIGINT) AS taken FROM e
""",
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op11_merkle_manifest",
    r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, lang,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
    coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295) % 7 = 0, false) AS hit FROM documents),
f AS (SELECT *, CAST(n_chars AS VARCHAR) AS n, CAST(n_chars + 1 AS VARCHAR) AS n2 FROM d),
v AS (SELECT rid, doc_id, lang, sha256(head || coalesce(strlen(n) || ':' || n, '-') || tail) AS leaf, CASE WHEN hit THEN sha256(head || coalesce(strlen(n2) || ':' || n2, '-') || tail) END AS changed FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM v),
up AS (SELECT lang, 0 AS l, i, leaf AS h FROM p UNION ALL
  SELECT lang, l + 1, i // 2, sha256(h || coalesce(h2, '')) FROM (SELECT *, lead(h) OVER (PARTITION BY lang ORDER BY i) AS h2, count(*) OVER (PARTITION BY lang) AS n FROM up) WHERE n > 1 AND i % 2 = 0),
trees AS (SELECT *, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS j FROM (SELECT lang, arg_max(h, l) AS subroot, max(l) AS levels FROM up GROUP BY lang)),
top AS (SELECT 0 AS l, j, subroot AS h FROM trees UNION ALL
  SELECT l + 1, j // 2, sha256(h || coalesce(h2, '')) FROM (SELECT *, lead(h) OVER (ORDER BY j) AS h2, count(*) OVER () AS n FROM top) WHERE n > 1 AND j % 2 = 0),
r AS (SELECT arg_max(h, l) AS root, max(l) AS levels FROM top),
steps AS (SELECT p.rid, k.l, CASE WHEN (p.i >> k.l) % 2 = 1 THEN u.h || '|' ELSE '|' || coalesce(u.h, '') END AS step
    FROM p JOIN trees t ON p.lang IS NOT DISTINCT FROM t.lang JOIN (SELECT DISTINCT l FROM up) k ON k.l < t.levels
    LEFT JOIN up u ON u.lang IS NOT DISTINCT FROM p.lang AND u.l = k.l AND u.i = xor(p.i >> k.l, 1)
  UNION ALL SELECT p.rid, 100 + k.l, CASE WHEN (t.j >> k.l) % 2 = 1 THEN u.h || '|' ELSE '|' || coalesce(u.h, '') END
    FROM p JOIN trees t ON p.lang IS NOT DISTINCT FROM t.lang JOIN (SELECT DISTINCT l FROM top) k ON k.l < (SELECT levels FROM r)
    LEFT JOIN top u ON u.l = k.l AND u.j = xor(t.j >> k.l, 1)),
w AS (SELECT rid, list(step ORDER BY l) AS steps FROM steps GROUP BY rid),
o AS (SELECT p.doc_id, p.leaf, t.subroot, r.root, sha256(replace(array_to_string(coalesce(w.steps, []), ''), '|', '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(p.changed, p.leaf), coalesce(w.steps, [])), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
  FROM p JOIN trees t ON p.lang IS NOT DISTINCT FROM t.lang CROSS JOIN r LEFT JOIN w USING (rid))
SELECT *, folded_root = root AS verified FROM o
""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.documents_manifest(table(spark, folder, "documents"))


@query("op12_byte_bpe")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), bpe.load())


@query("op13_structure_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, folder, "conversations")), present=F.col("present"))
