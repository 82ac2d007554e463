"""One conjunctive branch of a query: variables with predicates, edges, anti-edges and paths."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.compare import predicate
from lodegraph.functions.fuzzy import closest
from lodegraph.plans.refs import Edge, Node, Vocabulary


@dataclass
class Var:
    name: str
    type: str | None
    node: Node | None = None
    #: (kind, negated, *what) in the order said
    preds: list[tuple] = field(default_factory=list)


@dataclass
class Step:
    """An edge of the pattern. relations None: any; direction None: either."""

    name: str
    a: str
    b: str
    relations: tuple[str, ...] | None
    direction: bool | None


class Names:
    """Variable names by object, the same in every branch of a query."""

    def __init__(self):
        self.of: dict[int, str] = {}
        self.held: list = []

    def __call__(self, ref, prefix: str) -> str:
        if id(ref) not in self.of:
            self.of[id(ref)] = f"{prefix}{len(self.of)}"
            self.held.append(ref)
        return self.of[id(ref)]


class Branch(Vocabulary):
    def __init__(self, graph, names: Names):
        self.graph, self.names = graph, names
        self.vars: dict[str, Var] = {}
        self.steps: list[Step] = []
        self.anti: list[Step] = []
        self.paths: dict[str, tuple[list[str], list[Step]]] = {}
        self.negative = False

    # -- what conditions say

    def var(self, node: Node) -> Var:
        name = self.names(node, "v")
        if name not in self.vars:
            self.vars[name] = Var(name, node.type, node)
            for attr, value in node.attrs.items():
                self.vars[name].preds.append(("attr", False, attr, "eq", value))
        return self.vars[name]

    def constrain(self, expr, op, value):
        what = ("degree", self.negative, expr.name, expr.reverse) if expr.counted else ("attr", self.negative, expr.name)
        self.var(expr.node).preds.append((*what, op, value))

    def member_of(self, ref, values):
        if isinstance(ref, Node):
            self.var(ref).preds.append(("keys", self.negative, values))
        else:
            self.var(ref.node).preds.append(("attr", self.negative, ref.name, "in", list(values)))

    def best_match(self, ref, needles, k, cutoff, closeness):
        self.var(ref.node).preds.append(("best", self.negative, ref.name, list(needles), k, cutoff, closeness))

    def edge(self, source, relation, target, reverse=False):
        relations = None if relation is None else (relation,) if isinstance(relation, str) else tuple(relation)
        if relations == ():
            relations = None
        step = Step(f"e{len(self.steps) + len(self.anti)}", self.var(source).name, self.var(target).name, relations, True if reverse else (None if relations is None and not self.negative else False))
        (self.anti if self.negative else self.steps).append(step)

    def path(self, path, pattern):
        if self.negative:
            raise ValueError("a path can't be negated; negate the relation it must not walk: ~Has(a, rel, b)")
        nodes, steps, pending = [], [], None
        for item in pattern:
            if isinstance(item, Edge):
                if len(item.relations) > 1:
                    raise ValueError("a step of a path has one relation or any")
                pending = item
                continue
            name = self.var(item).name
            if nodes:
                edge = pending or Edge()
                relations = edge.relations or None
                step = Step(f"e{len(self.steps) + len(self.anti)}", nodes[-1], name, relations, True if edge.reverse else (False if relations else None))
                self.steps.append(step)
                steps.append(step)
            nodes.append(name)
            pending = None
        self.paths[self.names(path, "p")] = (nodes, steps)

    def schema(self):
        return self.graph.schema()

    def negated(self):
        view = copy.copy(self)
        view.negative = not self.negative
        return view

    # -- checks, before any job

    def reject_disconnected(self, projected: set[str]) -> None:
        """Every variable must hang together with a projected one, by edges that must or must not exist."""
        group = {name: name for name in self.vars}

        def root(name: str) -> str:
            while group[name] != name:
                name = group[name]
            return name

        together = [(s.a, s.b) for s in [*self.steps, *self.anti]]
        shown = [n for n in projected if n in self.vars] + [n for p in projected & self.paths.keys() for n in self.paths[p][0]]
        for a, b in [*together, *zip(shown, shown[1:], strict=False)]:
            group[root(a)] = root(b)
        alone = sorted(f"Node({v.type!r})" if v.type else "Node()" for n, v in self.vars.items() if shown and root(n) != root(shown[0]))
        if alone:
            raise ValueError(f"no edge of the pattern leads from what is selected to {', '.join(alone)}: was another object meant, or is an edge missing?")

    # -- candidates

    def possible(self, name: str) -> list[str]:
        """Types that a variable can have, by its own type, its predicates and its edges' relations; known without reading a row."""
        var, graph = self.vars[name], self.graph
        if var.type is not None:
            return [var.type] if var.type in graph.types else []
        types = [t for t in graph.types if not any(p[0] in ("attr", "best") and not p[1] and graph.column(t, p[2]) is None for p in var.preds)]
        for s in self.steps:
            for here, there, turned in ((s.a, s.b, False), (s.b, s.a, True)):
                if here == name and there != name:
                    other = self.vars[there].type
                    back = None if s.direction is None else s.direction == turned
                    types = [t for t in types if t in graph.near([other] if other else graph.types, s.relations, back)]
        return types

    def candidates(self, name: str) -> DataFrame | None:
        """(name): nodes that a variable's predicates admit; None if it has none and edges can tell its type."""
        var, graph = self.vars[name], self.graph
        if not var.preds:
            return None if var.type is None or var.type in graph.types else graph.nodes(var.type).toDF(name)
        frames = []
        for type_ in self.possible(name):
            cond, later, degrees, never = F.lit(True), [], {}, False
            for k, (kind, negative, *what) in enumerate(var.preds):
                if kind == "attr":
                    column = graph.column(type_, what[0])
                    here = predicate(F.col(f"`{column[0]}`"), column[1], what[1], what[2]) if column else None
                elif kind == "degree":
                    relation, reverse, op, value = what
                    degrees[f"_degree{k}"] = graph.degrees(relation, reverse)
                    here = predicate(F.coalesce(f"_degree{k}", F.lit(0)), "bigint", op, value)
                else:
                    later.append((kind, negative, what))
                    continue
                never |= here is None and not negative
                if here is not None:
                    cond = cond & (~here if negative else here)
            if never:
                continue
            df = graph.attrs(type_)
            for column, found in degrees.items():
                df = df.join(found.toDF("nid", column), "nid", "left")
            df = df.where(cond)
            for kind, negative, what in later:
                how = "left_anti" if negative else "left_semi"
                if kind == "best":
                    attr, needles, k, cutoff, measure = what
                    column = graph.column(type_, attr)
                    if column is None or column[1] != "string":
                        if not negative:
                            df = df.where("false")
                        continue
                    found = closest(graph.attrs(type_).select("nid", F.col(f"`{column[0]}`").alias("text")), needles, k, cutoff, measure)
                else:
                    found = named_nodes(graph, what[0])
                df = df.join(found.toDF("_nid"), F.col("nid") == F.col("_nid"), how)
            frames.append(df.select("nid"))
        return (reduce(DataFrame.unionByName, frames) if frames else graph.nodes("")).toDF(name)


def named_nodes(graph, keys) -> DataFrame:
    """(nid) of keys, or of the first node of a query's rows: a query stays a plan and is never collected."""
    from lodegraph.plans.query import Query

    if isinstance(keys, Query):
        return keys.bindings().select(F.col(keys.primary).alias("nid")).distinct()
    if isinstance(keys, DataFrame):
        return keys.select("nid").distinct()
    return graph.spark.createDataFrame([(n,) for n in graph.resolve(keys)], "nid bigint")
