"""Approximate nearest neighbours (inner product) by cross-polytope hashing.

Vectors are hashed by direction, in bands of about equal length, so that within
a band the largest inner product is the smallest angle, whatever the lengths in
the table. A table's hash rotates a vector pseudo-randomly (three rounds of
random signs and a fast Hadamard transform) and takes the nearest signed axis.
Every vector is indexed in every table; a query looks into the buckets of its
``probes`` nearest axes per table, in every band; in bands of longer vectors in
more, as those come near at wider angles.

Bucket members meet their queries as matrix products, in blocks of at most
``BLOCK`` members: a bucket with a third of all vectors is many blocks. A task
hands on only the best of each query, scored exactly in double precision.
Queries that found fewer than they should meet all vectors, in blocks.
Equal vectors are one vector with the smallest ids that can matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonewright.llm.common import held, join_hot

TABLES = 8
PROBES = 20
BLOCK = 4096
NEIGHBOURS = 20
HELD_QUERIES = 100_000
BAND_RATIO = 1.25
BANDS = 8  # to each side of the mean length; the outer ones take what lies beyond


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long)."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class CrossPolytope:
    def __init__(self, dim: int, tables: int, seed: int) -> None:
        self.width = 1 << max(1, (dim - 1).bit_length())
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], size=(tables, 3, self.width))

    def axes(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """The nearest signed axes of each row, nearest first: axis, or width + axis if negative."""
        y = np.zeros((len(x), self.width))
        y[:, : x.shape[1]] = x
        for s in self.signs[table]:
            y = hadamard(y * s)
        both = np.concatenate((y, -y), 1)
        if probes == 1:
            return both.argmax(1)[:, None]
        top = np.argpartition(-both, min(probes, both.shape[1]) - 1, 1)[:, :probes]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, 1), 1, kind="stable"), 1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): vectors in double precision, without null, zero or non-finite
    ones. Shorter vectors are padded with zeros to the longest. Of rows that
    share an id, the least vector (in array order) stands for it."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    padded = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v")))
    return rows.groupBy("id").agg(F.min("v").alias("v")).select("id", F.when(F.size("v") < dim, padded).otherwise(F.col("v")).alias("v"))


def nearest(
    vectors: DataFrame,
    is_query=lambda c: c % 20 == 0,
    k: int = NEIGHBOURS,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    tables: int = TABLES,
    probes: int = PROBES,
    seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query.

    Queries are the rows whose id passes ``is_query``; candidates are all rows
    but the query's own id; a query has all of them if there are fewer than
    ``k``. Ties go to the smaller id. A null id takes no part; see ``usable``
    for vectors. Other columns, of any name, take no part. No usable vector:
    no rows.
    """
    rows = held(usable(vectors, id_col, vec_col))
    first = rows.select("v").first()
    if first is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = len(first["v"])
    most = F.array_max(F.transform("v", F.abs))
    length = F.ln(most) + F.ln(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / most) * (x / most))) / 2
    total, mean = rows.agg(F.count("*"), F.avg(length)).first()
    # The smallest k + 1 ids of a vector: no other can be among the k nearest of any query.
    order = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("n__", F.row_number().over(order)).where(F.col("n__") <= k + 1)
    distinct = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    band = F.round((length - F.lit(mean)) / float(np.log(BAND_RATIO)))
    band = F.greatest(F.lit(-BANDS), F.least(F.lit(BANDS), band.cast("int")))
    distinct = held(distinct.select(F.col("ids")[0].alias("key"), "v", "ids", band.alias("band")))
    asked = rows.where(is_query(F.col("id")))
    asked = held(asked.join(distinct.select(F.col("key").alias("qkey"), "v"), "v").select(F.col("id").alias("query_id"), "qkey"))
    counts = asked.groupBy("qkey").agg(F.count("*").alias("n"))
    queries = distinct.join(counts.select(F.col("qkey").alias("key")), "key").select("key", "v", F.array().cast("array<long>").alias("ids"), "band")

    hasher, fields = CrossPolytope(dim + 1, tables, seed), "tab int, bucket int, probe int, band int, key long, v binary, ids array<long>"
    indexed = distinct.mapInArrow(_buckets(hasher, 1), fields)
    probed = queries.mapInArrow(_buckets(hasher, probes * (1 + BANDS // 4)), fields).drop("band")
    # blocks per bucket: at most tables * 2 * width * bands rows, whatever the number of vectors
    blocks = indexed.groupBy("tab", "bucket", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = F.broadcast(held(blocks))
    places = ["tab", "bucket", "band", "block"]
    members = indexed.join(blocks, ["tab", "bucket", "band"]).withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    enough = F.col("probe") < probes * (1 + F.greatest(F.col("band"), F.lit(0)) / 4)
    seekers = probed.join(blocks, ["tab", "bucket"]).where(enough).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lists = held(_lists(members, seekers, places, k, dim))

    # At least the query's own vector was found, so no query is without a list.
    short = lists.where(F.size("near") < min(k + 1, total)).select(F.col("qkey").alias("key"))
    if not short.isEmpty():
        count = -(-distinct.count() // BLOCK)
        nowhere = [F.lit(-1).alias(c) for c in places[:3]]
        everyone = distinct.mapInArrow(_raw, "key long, v binary, ids array<long>").select(*nowhere, "key", "v", "ids").withColumn("block", F.pmod(F.xxhash64("key"), F.lit(count)).cast("int"))
        left = queries.join(short, "key").mapInArrow(_raw, "key long, v binary, ids array<long>").select(*nowhere, "key", "v", "ids")
        left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        whole = _lists(everyone, left, places, k, dim)
        lists = lists.where(F.size("near") >= min(k + 1, total)).unionByName(whole)
    joined = join_hot(asked, lists.join(counts, "qkey"), "qkey", "n", asked.count())
    near = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = joined.select("query_id", F.posexplode(near).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def _lists(members: DataFrame, seekers: DataFrame, places: list[str], k: int, dim: int) -> DataFrame:
    """(qkey, near): the best k + 1 of what each query meets, best first."""
    columns = [*places, "kind", "key", "v", "ids"]
    met = members.withColumn("kind", F.lit(0)).select(columns).union(seekers.withColumn("kind", F.lit(1)).select(columns))
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(parts, *places).sortWithinPartitions(*places, "kind")
    found = met.mapInArrow(_best(k, dim), "qkey long, key long, ids array<long>, score double")
    found = found.groupBy("qkey", "key").agg(F.first("ids").alias("ids"), F.max("score").alias("score"))
    ranked = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    found = found.select("qkey", F.explode("ids").alias("vec_id"), "score")
    found = found.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1)
    return found.groupBy("qkey").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))


def _raw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes."""
    for part in parts:
        key, v, ids = (part.column(part.schema.get_field_index(c)) for c in ("key", "v", "ids"))
        raw = pa.array([r.tobytes() for r in _matrix(v)] if part.num_rows else [], pa.binary())
        yield pa.RecordBatch.from_arrays([key, raw, ids], names=["key", "v", "ids"])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _buckets(hasher: CrossPolytope, probes: int):
    """One row per vector, table and probe."""

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(0, part.num_rows, 2000):
                own = part.slice(i, 2000)
                key, v, ids, band = (own.column(own.schema.get_field_index(c)) for c in ("key", "v", "ids", "band"))
                x = _matrix(v)
                unit = x / np.abs(x).max(1)[:, None]
                unit /= np.sqrt((unit * unit).sum(1))[:, None]
                raw = pa.array([r.tobytes() for r in x], pa.binary())
                for t in range(len(hasher.signs)):
                    axes = hasher.axes(unit, t, probes)
                    rows = pa.array(np.repeat(np.arange(len(x)), axes.shape[1]))
                    order = np.tile(np.arange(axes.shape[1], dtype=np.int32), len(axes))
                    columns = [pa.array(np.full(axes.size, t, np.int32)), pa.array(axes.ravel().astype(np.int32)), pa.array(order), *(c.take(rows) for c in (band, key, raw, ids))]
                    yield pa.RecordBatch.from_arrays(columns, names=["tab", "bucket", "probe", "band", "key", "v", "ids"])

    return step


def _best(k: int, dim: int):
    """Per task and query, the best members of all blocks it meets there."""

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[int, tuple[float, list[int]]]] = {}
        at, keys, ids, vectors, matrix = None, [], [], [], None

        def out():
            rows = [(q, c, i, s) for q, hits in best.items() for c, (s, i) in hits.items()]
            best.clear()
            for i in range(0, len(rows), 20_000):
                q, c, d, s = zip(*rows[i : i + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.list_(pa.int64())), pa.array(s, pa.float64())], names=["qkey", "key", "ids", "score"])

        def ask(qkeys: list[int], q: np.ndarray) -> None:
            near = q @ matrix.T
            count = min(k + 1, len(keys))
            top = np.argpartition(-near, count - 1, 1)[:, :count]
            for i, qk in enumerate(qkeys):
                exact = (matrix[top[i]] * q[i]).sum(1)
                hits = best.setdefault(qk, {})
                hits.update((keys[j], (float(s), ids[j])) for j, s in zip(top[i].tolist(), exact.tolist()))
                if len(hits) > 4 * (k + 1):
                    best[qk] = dict(sorted(hits.items(), key=lambda h: (-h[1][0], h[1][1][0]))[: k + 1])

        for part in parts:
            *where, kind, key, v, idl = part.columns
            place = np.stack([c.to_numpy() for c in (*where, kind)], 1)
            if not len(place):
                continue
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)]
            for a, b in zip(cuts, cuts[1:]):
                spot, queries = tuple(place[a, :-1].tolist()), place[a, -1] == 1
                if spot != at:
                    at, keys, ids, vectors, matrix = spot, [], [], [], None
                x = np.frombuffer(b"".join(v.slice(a, b - a).to_pylist()), np.float64).reshape(-1, dim)
                names = key.slice(a, b - a).to_pylist()
                if not queries:
                    keys += names
                    ids += idl.slice(a, b - a).to_pylist()
                    vectors.append(x)
                elif keys:
                    if matrix is None:
                        matrix = np.concatenate(vectors)
                    for i in range(0, len(names), 1024):
                        ask(names[i : i + 1024], x[i : i + 1024])
            if len(best) > HELD_QUERIES:
                yield from out()
        for qk, hits in best.items():
            best[qk] = dict(sorted(hits.items(), key=lambda h: (-h[1][0], h[1][1][0]))[: k + 1])
        yield from out()

    return step
