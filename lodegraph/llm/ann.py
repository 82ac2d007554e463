"""Approximate nearest neighbours by largest inner product: adaptive dimension scan.

Vectors lie in the lists of an inverted file. All are rotated by one random orthogonal
matrix and read in blocks of columns. After each block, a candidate's inner product is
estimated from the columns read so far; a candidate goes as soon as a test says that it
is, with high confidence, below what the query already has. The rest are scored in
double precision on the original vectors.

The test's hypothesis is that the whole inner product is the floor F, or more. A vector v
is then F / |q|^2 times q and something orthogonal to q, so of the columns read so far, which hold the
share a of |q|^2, F a is expected; the orthogonal rest adds, over random rotations of D columns,
a standard deviation of |q| sqrt(a (1 - a) / D) sqrt(|v|^2 - (F / |q|)^2). A candidate goes when it
is DEVIATIONS of these short, or when what is left of both vectors couldn't make up for it even if parallel.
What a query already has is a floor: its k-th best inner product in a sample of rows,
raised by what it finds as a list is scanned, some candidates at a time. While most pairs of a
block are still alive they are read as one matrix product, afterwards pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.llm.common import bounded_arrow, let_go, settle

#: Rows, at most about so many, that lists, floors and the number of probes are fitted on.
SAMPLE = 8192
#: Queries of the sample that recall is measured with when the number of probes is chosen.
TRIALS = 256
#: Lists at most, and rows and queries of a list that meet in one task.
MOST_LISTS, BLOCK = 4096, 4096
#: Queries and candidates that are scanned at a time, before floors rise; and pairs that are held as pairs.
QUERIES, CANDIDATES, PAIRS = 512, 1024, 1 << 16
COLUMNS, DEVIATIONS = 16, 3.0


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) with v in the precision it has, single or double: no null, zero, empty or non-finite vectors, no null ids."""
    v, kind = F.col("v"), vectors.schema[vec_col].dataType.simpleString()
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    cast = vectors[vec_col] if kind == "array<float>" else vectors[vec_col].cast("array<double>")
    return vectors.select(vectors[id_col].alias("id"), cast.alias("v")).where(F.col("id").isNotNull() & fine)


def one_for_each(rows: DataFrame) -> DataFrame:
    """Of rows that repeat an id the least one, column by column. Only these are shuffled with all their columns."""
    again = settle(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("again")), "repeated-ids")
    if again.isEmpty():
        return rows
    others = [c for c in rows.columns if c != "id"]
    repeated = rows.join(again, F.col("id") == F.col("again"), "left_semi").groupBy("id").agg(F.min(F.struct(*others)).alias("r"))
    once = rows.join(again, F.col("id") == F.col("again"), "left_anti")
    return settle(once.unionByName(repeated.select("id", *(F.col(f"r.{c}").alias(c) for c in others))), "once")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centres of lists, on unit vectors; deterministic."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), k, replace=False)]
    for _ in range(rounds):
        near = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def probes_for(x: np.ndarray, centres: np.ndarray, k: int, goal: float) -> int:
    """The least number of lists a query must probe to find so large a share of its k nearest in the sample."""
    trial = x[:: max(1, len(x) // TRIALS)]
    of = (x @ centres.T / np.linalg.norm(x, axis=1, keepdims=True)).argmax(axis=1)
    best = np.argsort(-(trial @ x.T), axis=1)[:, : k + 1]
    order = np.argsort(np.argsort(-(trial @ centres.T), axis=1), axis=1)
    need = np.sort(np.take_along_axis(order, of[best], axis=1).ravel())
    return int(need[min(len(need) - 1, int(np.ceil(goal * len(need))))]) + 1


class Index:
    """What every task knows: rotation, list centres, sample for floors, and the number of probes."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, rows: int, k: int, goal: float):
        width = sample.shape[1]
        self.k, self.width = k, width
        self.rotation = np.linalg.qr(np.random.default_rng(11).normal(size=(width, width)))[0]
        lists = int(min(MOST_LISTS, max(1, round(rows**0.5 / 4)), len(sample)))
        self.centres = k_means(sample, lists)
        self.probes = probes_for(sample, self.centres, k, goal)
        self.sample, self.ids = sample, ids

    def lists(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T).argmax(axis=1)

    def floors(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The k-th best inner product in the sample, without the query itself: no more than the true one."""
        out = np.full(len(q), -np.inf)
        for a in range(0, len(q), 256):
            s = q[a : a + 256] @ self.sample.T
            s[ids[a : a + 256, None] == self.ids[None, :]] = -np.inf
            if s.shape[1] >= self.k:
                out[a : a + 256] = -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1]
        return out


def scan(q: np.ndarray, floors: np.ndarray, c: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no test abandons, column block by column block."""
    width = q.shape[1]
    rq, rc = q @ rotation, c @ rotation
    # Norms of what is left of each vector behind every block.
    left_q, left_c = (np.sqrt(np.maximum(0, np.cumsum((x**2)[:, ::-1], axis=1)[:, ::-1])) for x in (rq, rc))
    bounded = np.isfinite(floors)
    least = np.where(bounded, floors - 1e-9 * (1 + np.abs(np.where(bounded, floors, 0))), -1e300)
    along = np.where(bounded, floors, 0) / left_q[:, 0]
    # What of a candidate is orthogonal to the query if its inner product is the floor.
    across = np.sqrt(np.maximum(0, left_c[None, :, 0] ** 2 - along[:, None] ** 2))

    def tested(part, i, j, at: int) -> np.ndarray:
        """Whether the pairs stay; i and j index queries and candidates, as pairs or as rows and columns."""
        if at == width:
            return part >= least[i]
        share = 1 - (left_q[i, at] / left_q[i, 0]) ** 2
        short = DEVIATIONS * left_q[i, 0] * np.sqrt(share * (1 - share) / width) * across[i, j]
        return (part >= least[i] * share - short) & (part + left_q[i, at] * left_c[j, at] >= least[i])

    part, at = np.zeros((len(q), len(c))), 0
    rows, columns = np.arange(len(q))[:, None], np.arange(len(c))[None, :]
    while True:
        to = min(at + COLUMNS, width)
        part += rq[:, at:to] @ rc[:, at:to].T
        at = to
        alive = tested(part, rows, columns, at)
        if at == width or alive.sum() * 8 < alive.size:
            break
    i, j = np.nonzero(alive)
    part = part[i, j]
    while at < width and len(i):
        to = min(at + COLUMNS, width)
        for a in range(0, len(i), PAIRS):
            some = slice(a, a + PAIRS)
            part[some] += np.einsum("ij,ij->i", rq[i[some], at:to], rc[j[some], at:to])
        at = to
        keep = tested(part, i, j, at)
        i, j, part = i[keep], j[keep], part[keep]
    return i, j


def products(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs in double precision, summed from the first column to the last."""
    out = np.zeros(len(i))
    for a in range(0, len(i), PAIRS):
        x, y = q[i[a : a + PAIRS]].T, c[j[a : a + PAIRS]].T
        for d in range(len(x)):
            out[a : a + PAIRS] += x[d] * y[d]
    return out


def best(q: np.ndarray, qi: np.ndarray, floors: np.ndarray, c: np.ndarray, ci: np.ndarray, rotation: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best among the candidates but itself, ties to the smaller id."""
    i, j, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    floors = floors.copy()
    for at in range(0, len(c), CANDIDATES):
        ni, nj = scan(q, floors, c[at : at + CANDIDATES], rotation)
        nj = nj + at
        other = qi[ni] != ci[nj]
        ni, nj = ni[other], nj[other]
        i, j, s = np.concatenate([i, ni]), np.concatenate([j, nj]), np.concatenate([s, products(q, c, ni, nj)])
        order = np.lexsort((ci[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        i, j, s, rank = (x[rank < k] for x in (i, j, s, rank))
        full = rank == k - 1
        floors[i[full]] = np.maximum(floors[i[full]], s[full])
    return i, j, s


def nearest(vectors: DataFrame, is_query: str, k: int = 20, *, id_col: str = "vec_id", vec_col: str = "embedding", goal: float = 0.97) -> DataFrame:
    """(query_id, rank, id_col, score): each query's k nearest found among all rows but itself, nearest first, ties to the smaller id.

    is_query: SQL on id. The index is fitted on about SAMPLE rows, taken by a hash of the
    id; every row is indexed. Lists are probed until a share goal of the sample's true
    neighbours is found in them. A list's rows and the queries that probe it meet in blocks of about
    BLOCK each, so a full list is many tasks. A query whose lists hold fewer than k others is held against
    all rows. Vectors null, empty, zero, or with null or non-finite components take no
    part, nor do null ids; vectors of another length than the most common (of equally
    common ones the shortest) take no part either; of rows that repeat an id the least vector
    counts. Empty tables and tables of one vector give no rows.
    """
    spark = vectors.sparkSession
    bounded_arrow(spark)
    rows = one_for_each(settle(usable(vectors, id_col, vec_col).withColumn("id", F.col("id").cast("bigint")), "ann-rows"))
    sizes = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.expr(is_query)).alias("q")).orderBy(F.desc("n"), "w").limit(1).collect()
    out = f"query_id bigint, rank int, `{id_col}` bigint, score double"
    if not sizes:
        return spark.createDataFrame([], out)
    width, total = sizes[0].w, sizes[0].n
    rows = rows.where(F.size("v") == width)
    share = min(1.0, SAMPLE / total)
    drawn = (F.xxhash64("id").cast("double") + 2.0**63) / 2.0**64
    taken = rows.where(drawn < share).orderBy("id").toArrow()
    if not len(taken):
        taken = rows.orderBy("id").limit(1).toArrow()
    index = Index(matrix(taken.column("v").combine_chunks(), width), taken.column("id").to_numpy(), total, k, goal)
    shared = spark.sparkContext.broadcast(index)
    vector = rows.schema["v"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(shared.value.lists(matrix(b.column(1), width)).astype(np.int32))], ["id", "v", "list"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            ids, q = b.column(0).to_numpy(), matrix(b.column(1), width)
            near = np.argsort(-(q @ ix.centres.T), axis=1, kind="stable")[:, : ix.probes].astype(np.int32)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(ix.floors(ids, q)), pa.array(list(near), pa.list_(pa.int32()))], ["id", "v", "floor", "lists"])

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ix = shared.value
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            qi, ci = left.column("id").to_numpy(), right.column("id").to_numpy()
            q, c = (matrix(t.column("v").combine_chunks(), width) for t in (left, right))
            floors = left.column("floor").to_numpy()
            for a in range(0, len(q), QUERIES):
                here = slice(a, a + QUERIES)
                i, j, s = best(q[here], qi[here], floors[here], c, ci, ix.rotation, ix.k)
                found.append((qi[i + a], ci[j], s))
        return pa.table([pa.array(np.concatenate([f[n] for f in found])) for n in range(3)], ["query_id", "id", "score"])

    def met(queries: DataFrame, candidates: DataFrame) -> DataFrame:
        """What queries find among the candidates of their lists, block by block."""
        parts = queries.groupBy("list").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("chunks"))
        parts = settle(parts.join(candidates.groupBy("list").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("blocks")), "list"), "ann-parts")  # a row a list
        asked = queries.join(F.broadcast(parts), "list").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(2)), F.col("chunks")).cast("int"))
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", "v", "floor", "list", "chunk", "block")
        given = candidates.join(F.broadcast(parts), "list").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
        given = given.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("id", "v", "list", "chunk", "block")
        by = ["list", "block", "chunk"]
        return asked.groupBy(*by).cogroup(given.groupBy(*by)).applyInArrow(search, "query_id bigint, id bigint, score double")

    listed = settle(rows.mapInArrow(assign, f"id bigint, v {vector}, list int"), "ann-lists")
    asked = settle(rows.where(is_query).mapInArrow(probe, f"id bigint, v {vector}, floor double, lists array<int>"), "ann-queries")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = met(asked.withColumn("list", F.explode("lists")).drop("lists"), listed)
    found = settle(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ann-found")
    least = min(k, total - 1)
    if least and found.count() < least * sizes[0].q:
        # Lists that held too few: these queries against all rows, as one list.
        enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("query_id")
        short = settle(asked.join(enough, F.col("id") == F.col("query_id"), "left_anti").select("id", "v", F.lit(float("-inf")).alias("floor"), F.lit(0).alias("list")), "ann-short")
        again = met(short, rows.select("id", "v", F.lit(0).alias("list")))
        again = again.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = found.join(short.select("id").withColumnRenamed("id", "s"), F.col("query_id") == F.col("s"), "left_anti").unionByName(again)
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")


#: Exact search: what the approximate one finds where all its neighbours are found.
SQL = """
WITH fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""
