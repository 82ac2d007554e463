"""Translational embeddings: TransE and TransD as ranking signals, their training and storage.

Scores are Column expressions over vectors held as DataFrames. Up to most_triples, training
is numpy on the driver. A larger graph is trained in parts: in each epoch all triples are
dealt anew, each part descends from the vectors of its own nodes in a task, and a
node's vector is then the mean of what its parts made of it.
"""

from __future__ import annotations

import json
import time

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.signals import _Fitted
from lodegraph.plans.branch import named_nodes
from lodegraph.sources.graph import TYPE_SHIFT
from lodegraph.sources.shared import settle

FORMAT = 1


def plausible_e(h, r, t):
    return -np.sqrt(((h + r - t) ** 2).sum(-1))


def plausible_d(h, hp, r, rp, t, tp):
    project = lambda e, ep: rp * (e * ep).sum(-1, keepdims=True) + e
    return -np.sqrt(((project(h, hp) + r - project(t, tp)) ** 2).sum(-1))


class Translational(_Fitted):
    """What the models share. Vectors are DataFrames: nodes (nid, <table>...), and relations in a dict.

    With seeds (to=), a node's score is its best plausibility against any of them, over the
    edges considered; else against its path's last node; 0 with neither. relation=None
    considers every known relation both ways; a named one, in one direction.
    """

    supports_guidance = True
    name = ""
    #: (entity tables, relation tables)
    tables: tuple[tuple[str, ...], tuple[str, ...]] = ((), ())

    def __init__(self, factors=64, margin=1.0, seed=42, to=None, relation=None, reverse=False):
        self.factors, self.margin, self.seed = factors, margin, seed
        self.to, self.relation, self.reverse = to, relation, reverse
        self.nodes: DataFrame | None = None
        self.rels: dict[str, dict[str, list[float]]] = {}
        self.meta: dict = {}
        self.missing_nodes: list[str] = []
        self.missing_relations: list[str] = []

    # -- scoring

    def plausibility(self, h, r, t) -> np.ndarray:
        """Arrays in, one score a row out; each argument maps table to rows."""
        raise NotImplementedError

    def seeded(self, to, relation=None, reverse=False):
        """The same vectors aimed at other seeds; shared, not copied."""
        other = type(self)(self.factors, self.margin, self.seed, to, relation, reverse)
        other.nodes, other.rels, other.meta = self.nodes, self.rels, self.meta
        other.missing_nodes, other.missing_relations = self.missing_nodes, self.missing_relations
        return other

    def considered(self) -> list[tuple[str, bool]]:
        known = [r for r in self.rels if r not in self.missing_relations]
        if self.relation is None:
            return [(r, reverse) for r in known for reverse in (False, True)]
        return [(self.relation, self.reverse)] if self.relation in known else []

    def _against(self, df: DataFrame, seed: str, candidate: str, out: str) -> DataFrame:
        """Column out: the best of the edges considered, between two node columns."""
        entity = self.tables[0]
        for side, column in (("s", seed), ("c", candidate)):
            vectors = self.nodes.select(F.col("nid").alias(f"_{side}"), *(F.col(t).alias(f"_{side}_{t}") for t in entity))
            df = df.join(vectors, F.col(column) == F.col(f"_{side}"), "left").drop(f"_{side}")
        arrays = [({t: np.asarray(v, np.float64) for t, v in self.rels[name].items()}, reverse) for name, reverse in self.considered()]
        names = [f"_{side}_{t}" for side in "sc" for t in entity]
        # The function that goes to workers holds arrays and a model without DataFrames.
        column = F.pandas_udf(_bound(type(self)(self.factors, self.margin, self.seed), entity, arrays), "double")(*names)
        return df.withColumn(out, column).drop(*names)

    def score(self, ctx, df, out):
        if not self.considered():
            return df.withColumn(out, F.lit(0.0))
        node = ctx.node()
        if self.to is not None:
            seeds = named_nodes(ctx.graph, self.to).select(F.col("nid").alias("_seed"))
            if not seeds.isEmpty():
                pairs = df.select(F.col(node).alias("_node")).distinct().crossJoin(seeds)  # seeds are the caller's
                found = self._against(pairs, "_seed", "_node", "_x").groupBy("_node").agg(F.max("_x").alias(out))
                return df.join(found, F.col(node) == F.col("_node"), "left").drop("_node")
        if ctx.path is None:
            return df.withColumn(out, F.lit(0.0))
        return self._against(df.withColumn("_end", F.element_at(f"{ctx.path}.nodes", -1)), "_end", node, out).drop("_end")

    def edge_weight(self, graph, df, source, target, out):
        return self._against(df, source, target, out) if self.considered() else df.withColumn(out, F.lit(0.0))

    # -- storage

    def save(self, path: str, graph, **details) -> str:
        """Parquet by name: entities and relations, with their provenance."""
        if self.nodes is None:
            raise ValueError("nothing to save: the model has no vectors yet")
        spark = graph.spark
        keys = None
        for t in graph.types:
            part = graph.attrs(t).select("nid", F.lit(t).alias("type"), F.col("id").cast("string").alias("id"))
            keys = part if keys is None else keys.unionByName(part)
        self.nodes.join(keys, "nid").select("type", "id", *self.tables[0]).write.mode("overwrite").parquet(f"{path}/entities")
        rows = [(name, *([float(x) for x in r[t]] for t in self.tables[1])) for name, r in self.rels.items()]
        spark.createDataFrame(rows, "name string, " + ", ".join(f"{t} array<double>" for t in self.tables[1])).write.mode("overwrite").parquet(f"{path}/relations")
        meta = {"format": FORMAT, "model": self.name, "factors": self.factors, "margin": self.margin, "seed": self.seed, "trained_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **self.meta, **details}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        return path

    @classmethod
    def load(cls, path: str, graph, to=None, relation=None, reverse=False):
        """Vectors found again by name; nodes and relations that the file lacks have zeros and are listed as missing."""
        meta = provenance(graph.spark, path)
        if meta["format"] != FORMAT:
            raise ValueError(f"format {meta['format']}, not {FORMAT}")
        if meta["model"] != cls.name:
            raise ValueError(f"vectors of {meta['model']}, not of {cls.name}")
        model = cls(meta["factors"], meta["margin"], meta["seed"], to, relation, reverse)
        model.meta = meta
        stored = graph.spark.read.parquet(f"{path}/entities")
        zeros = F.array(*(F.lit(0.0) for _ in range(model.factors)))
        parts = None
        for t in graph.types:
            mine = graph.attrs(t).select("nid", F.concat(F.lit(f"{t}."), F.col("id").cast("string")).alias("_key"))
            part = mine.join(stored.select(F.concat("type", F.lit("."), "id").alias("_stored"), *cls.tables[0]), F.col("_key") == F.col("_stored"), "left")
            parts = part if parts is None else parts.unionByName(part)
        model.missing_nodes = sorted(r._key for r in parts.where("_stored is null").select("_key").collect())
        model.nodes = parts.select("nid", *(F.coalesce(c, zeros).alias(c) for c in cls.tables[0]))
        known = {r.name: {t: list(r[t]) for t in cls.tables[1]} for r in graph.spark.read.parquet(f"{path}/relations").collect()}
        model.missing_relations = [r for r in graph.relations if r not in known]
        model.rels = {r: known.get(r, {t: [0.0] * model.factors for t in cls.tables[1]}) for r in graph.relations}
        return model


def _bound(model, entity, arrays):
    """The best score over the edges considered, of rows of vectors; 0 where one has none."""

    def best(*columns: pd.Series) -> pd.Series:
        fine = np.logical_and.reduce([c.notna().to_numpy() for c in columns])
        scores = np.zeros(len(columns[0]))
        if fine.any():
            rows = [np.stack(c[fine].to_list()).astype(np.float64) for c in columns]
            sides = [dict(zip(entity, rows[i * len(entity) : (i + 1) * len(entity)], strict=True)) for i in (0, 1)]
            found = [model.plausibility(*((sides[1], r, sides[0]) if reverse else (sides[0], r, sides[1]))) for r, reverse in arrays]
            scores[fine] = np.max(found, axis=0)
        return pd.Series(scores)

    return best


class TransE(Translational):
    """-|h + r - t|."""

    name, tables = "transe", (("vec",), ("vec",))

    def plausibility(self, h, r, t):
        return plausible_e(h["vec"], r["vec"], t["vec"])

    def gradient(self, h, r, t):
        """Of plausibility with respect to (head, relation, tail) tables."""
        u = h["vec"] + r["vec"] - t["vec"]
        g = -u / np.maximum(np.sqrt((u * u).sum(-1, keepdims=True)), 1e-12)
        return {"vec": g}, {"vec": g}, {"vec": -g}


class TransD(Translational):
    """-|h' + r - t'|, where e' = (e . e_p) r_p + e."""

    name, tables = "transd", (("vec", "proj"), ("vec", "proj"))

    def plausibility(self, h, r, t):
        return plausible_d(h["vec"], h["proj"], r["vec"], r["proj"], t["vec"], t["proj"])

    def gradient(self, h, r, t):
        hd, td = (h["vec"] * h["proj"]).sum(-1, keepdims=True), (t["vec"] * t["proj"]).sum(-1, keepdims=True)
        u = h["vec"] + hd * r["proj"] + r["vec"] - t["vec"] - td * r["proj"]
        g = -u / np.maximum(np.sqrt((u * u).sum(-1, keepdims=True)), 1e-12)
        along = (g * r["proj"]).sum(-1, keepdims=True)
        return {"vec": g + along * h["proj"], "proj": along * h["vec"]}, {"vec": g, "proj": g * (hd - td)}, {"vec": -g - along * t["proj"], "proj": -along * t["vec"]}


def corrupted(rng: np.random.Generator, places: np.ndarray, types: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each node another drawn evenly from its own type."""
    return starts[types] + (rng.random(len(places)) * sizes[types]).astype(np.int64)


def descend(model: Translational, entity: dict, relation: dict, triples: np.ndarray, kinds: np.ndarray, rng: np.random.Generator, epochs: int, batch_size: int, lr: float, report=None) -> float:
    """Adam on the margin ranking loss, in place; the last epoch's mean loss.

    triples: (head, relation, tail) as places in the arrays; kinds: types of the entities, ascending. A
    triple must outscore itself with its head, and with its tail, replaced within the type.
    """
    starts = np.searchsorted(kinds, np.arange(kinds.max(initial=0) + 1), side="left")
    sizes = np.searchsorted(kinds, np.arange(kinds.max(initial=0) + 1), side="right") - starts
    params = [*entity.values(), *relation.values()]
    first, second, step, loss = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, 0.0

    def take(tables: dict, i: np.ndarray) -> dict:
        return {n: v[i] for n, v in tables.items()}

    for epoch in range(epochs):
        order, losses = rng.permutation(len(triples)), []
        for at in range(0, len(triples), batch_size):
            h, r, t = triples[order[at : at + batch_size]].T
            grads = [np.zeros_like(p) for p in params]
            ge, gr = dict(zip(entity, grads, strict=False)), dict(zip(relation, grads[len(entity) :], strict=True))

            def push(weight, hi, ti, r=r, ge=ge, gr=gr):
                for into, index, part in zip((ge, gr, ge), (hi, r, ti), model.gradient(take(entity, hi), take(relation, r), take(entity, ti)), strict=True):
                    for n, g in part.items():
                        np.add.at(into[n], index, weight[:, None] * g)

            true = model.plausibility(take(entity, h), take(relation, r), take(entity, t))
            total = 0.0
            for hi, ti in ((h, corrupted(rng, t, kinds[t], starts, sizes)), (corrupted(rng, h, kinds[h], starts, sizes), t)):
                gap = model.margin - true + model.plausibility(take(entity, hi), take(relation, r), take(entity, ti))
                weight = (gap > 0) / len(h)
                total += np.maximum(gap, 0).mean()
                push(-weight, h, t)
                push(weight, hi, ti)
            losses.append(total)
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        loss = float(np.mean(losses))
        if report:
            report(epoch, loss)
    return loss


def train(model: Translational, graph, epochs=50, batch_size=4096, lr=0.01, seed=42, report=None, most_triples=5_000_000, part_triples=100_000) -> Translational:
    """Fit the model's vectors to the graph's edges; on the driver up to most_triples, else in parts of about part_triples."""
    began, k = time.time(), model.factors
    edges = None
    for number, name in enumerate(graph.relations):
        part = graph.edges([name]).select("s", F.lit(number).alias("r"), "d")
        edges = part if edges is None else edges.unionByName(part)
    count = edges.count() if edges is not None else 0
    if not count:
        raise ValueError("no edges to train on")
    rng = np.random.default_rng(seed)
    relation = {t: rng.normal(scale=np.sqrt(2 / (len(graph.relations) + k)), size=(len(graph.relations), k)) for t in model.tables[1]}
    if count > most_triples:
        loss, nodes = _in_parts(model, graph, edges, relation, epochs, batch_size, lr, seed, report, max(1, -(-count // part_triples)))
    else:
        raw = edges.toPandas().to_numpy(np.int64)
        nids = np.sort(graph.nodes().toPandas().nid.to_numpy(np.int64))
        nodes = len(nids)
        triples = np.stack([np.searchsorted(nids, raw[:, 0]), raw[:, 1], np.searchsorted(nids, raw[:, 2])], axis=1)
        entity = {t: rng.normal(scale=np.sqrt(2 / (nodes + k)), size=(nodes, k)) for t in model.tables[0]}
        loss = descend(model, entity, relation, triples, nids >> TYPE_SHIFT, rng, epochs, batch_size, lr, report)
        columns = {"nid": pa.array(nids), **{t: pa.array(list(v), pa.list_(pa.float64())) for t, v in entity.items()}}
        model.nodes = graph.spark.createDataFrame(pa.table(columns))
    model.rels = {name: {t: v[i].tolist() for t, v in relation.items()} for i, name in enumerate(graph.relations)}
    model.meta = {"epochs": epochs, "lr": lr, "batch_size": batch_size, "sampler": "type", "graph_nodes": nodes, "graph_edges": count, "seconds": round(time.time() - began, 3), "loss": loss}
    return model


def _part_fit(model, relation: dict, seed: int, epoch: int, batch_size: int, lr: float):
    """One epoch over one part: (triples, vectors) to new vectors, and a row for each relation."""
    entity, shared = model.tables[0], {t: v.copy() for t, v in relation.items()}

    def fit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("nid")
        nids = right.nid.to_numpy(np.int64)
        own = {t: np.stack(right[t].to_list()).astype(np.float64) for t in entity}
        rels = {t: v.copy() for t, v in shared.items()}
        triples = np.stack([np.searchsorted(nids, left.s), left.r.to_numpy(np.int64), np.searchsorted(nids, left.d)], axis=1)
        triples = triples[np.lexsort(triples.T)]
        found = descend(model, own, rels, triples, nids >> TYPE_SHIFT, np.random.default_rng([seed, epoch, int(left.part.iloc[0])]), 1, batch_size, lr)
        rows = pd.DataFrame({"nid": nids, "rel": -1, "weight": 1.0, "loss": 0.0, **{t: list(v) for t, v in own.items()}})
        # A relation counts by its triples here; its tables follow each other in the first vector.
        used = np.bincount(triples[:, 1], minlength=len(next(iter(rels.values()))))
        first = {entity[0]: [np.concatenate([v[i] for v in rels.values()]) for i in range(len(used))], **{t: [None] * len(used) for t in entity[1:]}}
        return pd.concat([rows, pd.DataFrame({"nid": -1, "rel": np.arange(len(used)), "weight": used.astype(float), "loss": found, **first})])

    return fit


def _in_parts(model, graph, edges, relation, epochs, batch_size, lr, seed, report, parts: int) -> tuple[float, int]:
    """Epochs over triples dealt to parts; (last loss, nodes). What reaches the driver are relations and losses, a row for each part.

    A replaced end is drawn from the part's own nodes of the type. A part's nodes are at most twice its triples, so a hot
    node is copied to each part but is never a part's bulk.
    """
    entity, k, spark = model.tables[0], model.factors, graph.spark
    bare = type(model)(model.factors, model.margin, model.seed)
    edges = settle(edges, "train-edges")

    def draw(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            made = [[np.random.Generator(np.random.Philox(key=[seed, n * len(entity) + j])).normal(scale=1 / np.sqrt(k), size=k) for n in ids] for j in range(len(entity))]
            yield pa.record_batch([batch.column(0), *(pa.array(m, pa.list_(pa.float64())) for m in made)], ["nid", *entity])

    kinds = ", ".join(f"{t} array<double>" for t in entity)
    vectors = settle(graph.nodes().mapInArrow(draw, f"nid bigint, {kinds}"), "train-vectors")
    nodes, loss = vectors.count(), 0.0
    for epoch in range(epochs):
        dealt = edges.withColumn("part", F.pmod(F.xxhash64("s", "r", "d", F.lit(seed + epoch)), F.lit(parts)).cast("int"))
        touched = dealt.select(F.col("part").alias("of"), F.explode(F.array("s", "d")).alias("nid")).distinct().join(vectors, "nid")

        made = dealt.groupBy("part").cogroup(touched.groupBy("of")).applyInPandas(_part_fit(bare, relation, seed, epoch, batch_size, lr), f"nid bigint, rel int, weight double, loss double, {kinds}")
        made = settle(made, "train-parts")
        rows = made.where("rel >= 0").select("rel", "weight", "loss", entity[0]).toPandas()  # parts times relations
        for i, group in rows[rows.weight > 0].groupby("rel"):
            mean = np.average(np.stack(group[entity[0]].to_list()), axis=0, weights=group.weight)
            for t, v in zip(relation, np.split(mean, len(relation)), strict=True):
                relation[t][i] = v
        loss = float(np.average(rows.loss, weights=np.maximum(rows.weight, 1e-9)))
        means = [F.array(*(F.avg(F.col(t)[i]) for i in range(k))).alias(t) for t in entity]
        new = made.where("rel < 0").groupBy("nid").agg(*means)
        kept = vectors.join(new.select("nid"), "nid", "left_anti").unionByName(new)
        vectors = settle(kept, "train-vectors")
        if report:
            report(epoch, loss)
    model.nodes = vectors
    return loss, nodes


#: Models by the name that stored vectors carry.
MODELS = {model.name: model for model in (TransE, TransD)}


def provenance(spark, path: str) -> dict:
    """What stored vectors say of themselves; needs no graph."""
    return json.loads(spark.read.parquet(f"{path}/meta").first().meta)


def load(path: str, graph, **aim) -> Translational:
    """Stored vectors as a model of the class that they name."""
    name = provenance(graph.spark, path)["model"]
    if name not in MODELS:
        raise ValueError(f"vectors of {name!r}, which is no model here")
    return MODELS[name].load(path, graph, **aim)
