"""Matrix factorization of interactions, and its diffusion over the graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.signals import _add, _Fitted
from lodegraph.plans.branch import named_nodes
from lodegraph.sources.shared import settle


#: Rows that a generator draws at a time.
DRAWN = 1 << 14


def dot(a: str, b: str):
    return F.coalesce(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def _solve(sums: DataFrame, k: int, reg: float) -> DataFrame:
    """(nid, f) from (nid, g: upper triangle of the Gram matrix, b: sum of vectors)."""
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g = np.zeros((n, k, k))
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            g[:, upper[0], upper[1]] = flat
            g[:, upper[1], upper[0]] = flat
            b = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, k)
            x = np.linalg.solve(g + reg * np.eye(k), b[:, :, None])[:, :, 0]
            yield pa.record_batch([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["nid", "f"])

    return sums.mapInArrow(run, "nid bigint, f array<double>")


class MatrixFactorization(_Fitted):
    """Alternating least squares over observed pairs: f = (A'A + reg I)^-1 A'1, users then items, each iteration.

    The sums are aggregates with partial sums on the map side; no user's or item's pairs
    meet in one task's memory. Nodes without pairs have no factors. Items of graphs from
    text start as the first draws of a seeded generator, in node order behind the users';
    items of table graphs start from a digest of seed and id, which needs no order.
    """

    supports_guidance = True

    def __init__(self, factors=8, iterations=20, regularization=0.05, seed=42, item_type="movie", user_type="user", relation="has_interact"):
        self.factors, self.iterations, self.regularization, self.seed = factors, iterations, regularization, seed
        self.item_type, self.user_type, self.relation = item_type, user_type, relation

    def _key(self):
        return (self.factors, self.iterations, self.regularization, self.seed, self.item_type, self.user_type, self.relation)

    def fit(self, graph):
        self.users, self.items = self.kept(graph, ("factors", self._key()), lambda: self._alternate(graph))

    def _start(self, graph, items: DataFrame) -> DataFrame:
        """(nid, f): the items' first factors, drawn where the items are."""
        k, seed = self.factors, self.seed
        if not graph.from_text:
            # Two uniform numbers from a digest of seed, id and factor make a normal one (Box and Muller).
            def uniform(j: int, part: int) -> Column:
                digest = F.md5(F.concat(F.lit(f"{seed}|{j}|"), F.col("nid").cast("string")))
                return (F.conv(F.substring(digest, part, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))

            drawn = [F.lit(0.1) * F.sqrt(F.lit(-2.0) * F.ln(uniform(j, 1))) * F.cos(F.lit(2 * np.pi) * uniform(j, 17)) for j in range(k)]
            return items.select("nid", F.array(*drawn).alias("f"))
        # Places are dense here: the generator's sequence runs over all users, then all items, and a task takes what is its own.
        low, high = graph.block(self.user_type)
        first, users = graph.block(self.item_type)[0], high - low

        def run(batches):
            rng = np.random.default_rng(seed)
            begin, block = 0, rng.normal(scale=0.1, size=(DRAWN, k))
            for batch in batches:  # ids ascend
                row = users + batch.column(0).to_numpy() - first
                out, done = np.zeros((len(row), k)), 0
                while done < len(row):
                    if row[done] >= begin + DRAWN:
                        begin, block = begin + DRAWN, rng.normal(scale=0.1, size=(DRAWN, k))
                        continue
                    to = int(np.searchsorted(row, begin + DRAWN))
                    out[done:to] = block[row[done:to] - begin]
                    done = to
                yield pa.record_batch([batch.column(0), pa.array(list(out), pa.list_(pa.float64()))], ["nid", "f"])

        return items.sortWithinPartitions("nid").mapInArrow(run, "nid bigint, f array<double>")

    def _alternate(self, graph) -> tuple[DataFrame, DataFrame]:
        k = self.factors
        pairs = settle(graph.edges([self.relation], False, False, self.user_type, self.item_type).distinct(), "factors-pairs")
        items = self._start(graph, pairs.select(F.col("d").alias("nid")).distinct()).join(pairs.select(F.col("d").alias("nid")).distinct(), "nid", "left_semi")
        gram = [(i, j) for i in range(k) for j in range(i, k)]

        def half(near: str, far: str, known: DataFrame) -> DataFrame:
            joined = pairs.join(known.toDF("_k", "f"), F.col(far) == F.col("_k")).select(F.col(near).alias("nid"), *(F.col("f")[i].alias(f"f{i}") for i in range(k)))
            sums = joined.groupBy("nid").agg(*(F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"g{i}_{j}") for i, j in gram), *(F.sum(f"f{i}").alias(f"b{i}") for i in range(k)))
            return _solve(sums.select("nid", F.array(*(f"g{i}_{j}" for i, j in gram)).alias("g"), F.array(*(f"b{i}" for i in range(k))).alias("b")), k, self.regularization)

        users = None
        for _ in range(self.iterations):
            users = half("s", "d", items)
            items = settle(half("d", "s", users), "factors-items")
        return settle(users if users is not None else items.where("false"), "factors-users"), items

    def vectors(self) -> DataFrame:
        return self.users.unionByName(self.items)

    def _pairwise(self, df, a, b, vectors, out):
        df = df.join(vectors.toDF(f"_i{out}", f"_f{out}"), F.col(a) == F.col(f"_i{out}"), "left").join(vectors.toDF(f"_j{out}", f"_g{out}"), F.col(b) == F.col(f"_j{out}"), "left")
        return df.withColumn(out, dot(f"_f{out}", f"_g{out}")).drop(f"_i{out}", f"_j{out}", f"_f{out}", f"_g{out}")

    def edge_weight(self, graph, df, source, target, out):
        users, items = self.users.withColumn("side", F.lit(0)), self.items.withColumn("side", F.lit(1))
        v = users.unionByName(items).toDF("n", "f", "side")
        df = df.join(v.toDF("_i", "_f", "_si"), F.col(source) == F.col("_i"), "left").join(v.toDF("_j", "_g", "_sj"), F.col(target) == F.col("_j"), "left")
        return df.withColumn(out, F.when(F.col("_si") != F.col("_sj"), dot("_f", "_g")).otherwise(0.0)).drop("_i", "_j", "_f", "_g", "_si", "_sj")

    def score(self, ctx, df, out):
        user, item = ctx.of_type(self.user_type), ctx.of_type(self.item_type)
        if item is None:
            item = ctx.node()
        if user is not None:
            return self._pairwise(df, user, item, self.vectors(), out)
        # Without a user in the row: the first of those that the pattern matches; a pattern without users scores nothing.
        matched = ctx.matched(self.user_type)
        if matched is None:
            return df.withColumn(out, F.lit(0.0))
        first = matched.agg(F.min("nid").alias("nid"))  # one row
        anchor = first.join(self.users, "nid").select(F.col("f").alias("_anchor"))
        df = df.join(self.items.toDF(f"_i{out}", f"_f{out}"), F.col(item) == F.col(f"_i{out}"), "left").join(F.broadcast(anchor), how="left")
        return df.withColumn(out, dot("_anchor", f"_f{out}")).drop("_anchor", f"_i{out}", f"_f{out}")


class DiffusedMatrixFactorization(MatrixFactorization):
    """The same factors, spread: any other node has the mean of its neighbouring items', parallel edges weighed.

    With to=, the best match to any seed; else, with a path, the match to its last node;
    else the match of user and item.
    """

    def __init__(self, *args, to=None, **kwargs):
        super().__init__(*args, **kwargs)
        self.to = to

    def fit(self, graph):
        super().fit(graph)
        self.spread = self.kept(graph, ("spread", self._key()), lambda: self._spread(graph))

    def _spread(self, graph) -> DataFrame:
        own = self.users.unionByName(self.items)
        near = graph.adjacency().join(self.items.toDF("_i", "f"), F.col("d") == F.col("_i"))
        k = self.factors
        means = near.groupBy(F.col("s").alias("nid")).agg(*((F.sum(F.col("f")[i] * F.col("n")) / F.sum("n")).alias(f"f{i}") for i in range(k)))
        means = means.select("nid", F.array(*(f"f{i}" for i in range(k))).alias("f")).join(own.select("nid"), "nid", "left_anti")
        own_types = (self.user_type, self.item_type)
        for t in own_types:  # nodes of these types without pairs have no factors at all
            if t in graph.tables:
                means = means.join(graph.nodes(t), "nid", "left_anti")
        return settle(own.unionByName(means), "factors-spread")

    def edge_weight(self, graph, df, source, target, out):
        return self._pairwise(df, source, target, self.spread, out)

    def score(self, ctx, df, out):
        node = ctx.node()
        if self.to is not None:
            seeds = self.spread.join(named_nodes(ctx.graph, self.to), "nid", "left_semi").select(F.col("f").alias("_s"))
            nodes = df.select(F.col(node).alias("nid")).distinct().join(self.spread, "nid")
            best = nodes.crossJoin(seeds).select("nid", dot("f", "_s").alias("x")).groupBy("nid").agg(F.max("x").alias("x"))  # seeds are the caller's
            return _add(df, node, best, out)
        if ctx.path is None:
            return super().score(ctx, df, out)
        df = self._pairwise(df.withColumn("_end", F.element_at(f"{ctx.path}.nodes", -1)), node, "_end", self.spread, out)
        return df.drop("_end")
