"""Queries: the verbs, and the plan they make. Every verb returns a new query; nothing runs until rows are asked for."""

from __future__ import annotations

import copy
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.operators.search import Default
from lodegraph.plans.branch import Branch, Names
from lodegraph.plans.refs import Condition, Node, Path, Position, Score, Strategy, Term, branches
from lodegraph.sources.graph import PLACE, TYPE_SHIFT, Key, Rel
from lodegraph.sources.shared import settle


class Scope:
    """One level of ranking."""

    def __init__(self, rank=(), limit=None):
        self.rank, self.limit = tuple(rank), limit


def variable(projection):
    if isinstance(projection, Term):
        return projection.node
    if isinstance(projection, Position):
        return projection._of
    return projection if isinstance(projection, (Node, Path)) else None


def shows_node(projection) -> bool:
    return isinstance(projection, Node) or isinstance(projection, Position) and projection._attr is None


class Context:
    """What a strategy may know of the query it scores: the graph, and which column holds what."""

    def __init__(self, query: Query):
        self.graph, self.query = query.graph, query
        self.primary, self.path = query.primary, query.path_column
        self.column = query.names.of

    def of_type(self, type_: str) -> str | None:
        return next((self.column[id(v)] for v in self.query.visible if isinstance(v, Node) and v.type == type_), None)

    def matched(self, type_: str) -> DataFrame | None:
        """(nid) of the nodes of a type that the pattern matches without showing them; None if it has no such variable."""
        held = [n for n in self.query.names.held if isinstance(n, Node) and n.type == type_ and id(n) not in {id(v) for v in self.query.visible}]
        frames = [self.query._search([], only=self.query.names.of[id(n)]).toDF("nid") for n in held]
        return reduce(DataFrame.unionByName, frames) if frames else None

    def node(self) -> str:
        if self.primary is None:
            raise ValueError("this strategy scores nodes: project a Node, or an attribute of one")
        return self.primary

    def order(self) -> list:
        return self.query.row_order()


class Query:
    def __init__(self, graph, projections):
        self.graph, self.projections = graph, tuple(projections)
        for p in self.projections:
            if not isinstance(p, (Term, Node, Path, Position, Score)):
                raise TypeError(f"can't select {p!r}")
        self.visible = list({id(v): v for v in map(variable, self.projections) if v is not None}.values())
        self.names = Names()
        for v in self.visible:
            self.names(v, "v" if isinstance(v, Node) else "p")
        named = {kind: next((self.names.of[id(v)] for v in self.visible if isinstance(v, kind)), None) for kind in (Node, Path)}
        self.primary, self.path_column = named[Node], named[Path]
        self.conditions: tuple[Condition, ...] = ()
        self.engine = Default()
        self.group = None
        self.scopes = (Scope(),)
        self.current = 0
        self._rows = None
        #: column of an untyped node -> the types it can have
        self._types: dict[str, list[str]] = {}

    # -- verbs

    def _with(self, **changes) -> Query:
        new = copy.copy(self)
        new.__dict__.update(changes, _rows=None)
        return new

    def where(self, *conditions) -> Query:
        return self._with(conditions=self.conditions + conditions)

    def _scoped(self, taken: bool, **change) -> Query:
        at = max(0, self.current - 1) if taken else self.current
        scopes = tuple(Scope(change.get("rank", s.rank), change.get("limit", s.limit)) if i == at else s for i, s in enumerate(self.scopes))
        return self._with(scopes=scopes, current=at)

    def rank(self, *strategies) -> Query:
        """Rank the current level; a second rank goes to the level above."""
        from lodegraph.operators.signals import ExprStrategy

        return self._scoped(bool(self.scopes[self.current].rank), rank=tuple(s if isinstance(s, Strategy) else ExprStrategy(s) for s in strategies))

    def top(self, n: int) -> Query:
        """Cut the current level; a second top goes to the level above."""
        return self._scoped(self.scopes[self.current].limit is not None, limit=n)

    def groupby(self, var) -> Query:
        return self._with(group=var, scopes=(*self.scopes, Scope()), current=len(self.scopes))

    def using(self, engine) -> Query:
        return self._with(engine=engine)

    # -- planning

    def soft(self) -> list[Strategy]:
        """Conditions that also weigh: a Like at the top of where()."""
        return [c for c in self.conditions if isinstance(c, Strategy)]

    def _outer(self) -> list[Strategy]:
        rank = list(self.scopes[0].rank)
        return rank + [s for s in self.soft() if not any(s is r for r in rank)]

    def _strategies(self) -> list[Strategy]:
        return list({id(s): s for s in [*(r for sc in self.scopes for r in sc.rank), *self.soft()]}.values())

    def _hidden(self) -> list[str]:
        """Columns of nodes that a signal reads and no projection has."""
        shown = {id(v) for v in self.visible}
        nodes = {id(n): n for s in self._strategies() for n in [getattr(s, "reads", lambda: None)()] if n is not None and id(n) not in shown}
        return [self.names(n, "v") for n in nodes.values()]

    def columns(self) -> list[str]:
        return [self.names.of[id(v)] for v in self.visible]

    def types_of(self, column: str) -> list[str]:
        """Types that a node column can have."""
        type_ = next((v.type for v in self.names.held if self.names.of[id(v)] == column and isinstance(v, Node)), None)
        if type_ is not None:
            return [type_] if type_ in self.graph.types else []
        return self._types.get(column) or list(self.graph.types)

    def row_order(self) -> list:
        """Rows' own order: by ids, column by column."""
        out = []
        for v in self.visible:
            c = self.names.of[id(v)]
            out += [F.col(c)] if isinstance(v, Node) else [F.col(f"{c}.nodes"), F.col(f"{c}.rels")]
        return out

    def bindings(self) -> DataFrame:
        """Distinct bindings of the projected variables, unranked."""
        return self._search([])

    def _search(self, hidden: list[str], only: str | None = None) -> DataFrame:
        outputs = [*self.columns(), *hidden] if only is None else [only]
        guide = next((s for sc in reversed(self.scopes) for s in sc.rank if s.supports_guidance), None) or next((s for s in self.soft() if s.supports_guidance), None)
        whole: list = [[]]
        for c in self.conditions:
            whole = [[*a, *b] for a in whole for b in branches(c)]
        frames = []
        for leaves in whole:
            branch = Branch(self.graph, self.names)
            for v in self.visible:
                if isinstance(v, Node):
                    branch.var(v)
            for condition, negative in leaves:
                condition.compile(branch.negated() if negative else branch)
            for v in self.visible:
                if isinstance(v, Path) and self.names.of[id(v)] not in branch.paths:
                    raise ValueError("a selected path needs a shape in where(): path == [...]")
            branch.reject_disconnected(set(self.columns()))
            if only is not None and only not in branch.vars:
                continue
            for name, var in branch.vars.items():
                if var.type is None:
                    may = set(branch.possible(name)) | set(self._types.get(name, ()))
                    self._types[name] = [t for t in self.graph.types if t in may]
            frames.append(self.engine.search(self.graph, branch, [o for o in outputs if o in branch.vars or o in branch.paths or o in hidden], guide))
        if not frames:
            return self.graph.nodes("").toDF(only)
        return frames[0] if len(frames) == 1 else reduce(DataFrame.unionByName, frames).distinct()

    def _combined(self, df: DataFrame, strategies, out: str, group: str | None) -> DataFrame:
        """Column out: the mean of the signals, each stretched to 0..1 over the rows (of each group); all equal gives 0."""
        if not strategies:
            return df.withColumn(out, F.lit(0.0))
        ctx, raw = Context(self), []
        kept = df.columns
        for i, s in enumerate(strategies):
            df = s.score(ctx, df, f"_raw{i}")
            raw.append(f"_raw{i}")
        hidden = [c for c in kept if c not in self.columns() and c[0] == "v"]
        if hidden:
            by = [c for c in kept if c not in hidden]
            df = df.groupBy(*by).agg(*(F.max(r).alias(r) for r in raw))
            kept = by
        if group is None:
            df = settle(df, "scored")  # read for its ends and for its rows
            ends = df.agg(*(f(r).alias(f"{r}{n}") for r in raw for n, f in (("_lo", F.min), ("_hi", F.max))))
            df = df.crossJoin(F.broadcast(ends))  # one row
        else:
            over = W.partitionBy(group)
            df = df.select("*", *(f(r).over(over).alias(f"{r}{n}") for r in raw for n, f in (("_lo", F.min), ("_hi", F.max))))
        parts = [F.when(F.col(f"{r}_hi") > F.col(f"{r}_lo"), (F.col(r) - F.col(f"{r}_lo")) / (F.col(f"{r}_hi") - F.col(f"{r}_lo"))).otherwise(0.0) for r in raw]
        return df.select(*kept, (reduce(lambda a, b: a + b, parts) / F.lit(float(len(parts)))).alias(out))

    def ranked(self) -> tuple[DataFrame, list]:
        """Bindings with their score, cut, and the order they come in."""
        for s in self._strategies():
            s.fit(self.graph)
        df, order = self._search(self._hidden()), self.row_order()
        if self.group is None:
            outer = self._outer()
            if len(outer) == 1 and hasattr(outer[0], "sorted_by") and not any(isinstance(p, Score) for p in self.projections):
                # Nobody reads the score: rows come by the signal's own order, without a place for each.
                df, first = outer[0].sorted_by(Context(self), df)
                order = first + order
                df = df.withColumn("score", F.lit(0.0))
            else:
                df = self._combined(df, outer, "score", None)
                order = ([F.desc("score")] if outer else []) + order
            if self.scopes[0].limit is not None:
                df = df.orderBy(*order).limit(self.scopes[0].limit)
            return df, order
        group, inner, outer = self.names(self.group, "v"), self.scopes[-1], self.scopes[0]
        df = settle(df, "grouped")  # read for groups' rows, leaders and order alike
        plain = [c for c in self.columns() if c[0] == "v"]
        firsts = df.groupBy(F.col(group).alias("_g")).agg(F.min(F.struct(*plain)).alias("_first"))
        df = self._combined(df, inner.rank, "score", group)
        within = W.partitionBy(group).orderBy(*([F.desc("score")] if inner.rank else []), *order)
        df = df.withColumn("_rn", F.row_number().over(within))
        if inner.limit is not None:
            df = df.where(F.col("_rn") <= inner.limit)
        rank = self._outer()
        tops = df.where("_rn = 1").drop("score", "_rn")
        tops = self._combined(tops, rank, "_outer", None).select(F.col(group).alias("_group"), F.col("_outer"))
        tops = tops.join(firsts, F.col("_group") == F.col("_g")).drop("_g")
        by = ([F.desc("_outer")] if rank else []) + [F.col("_first")]
        if outer.limit is not None:
            tops = tops.orderBy(*by).limit(outer.limit)
        return df.join(tops, F.col(group) == F.col("_group")), [*by, F.col("_rn")]

    # -- results

    def to_df(self, *names: str, ordered: bool = True) -> DataFrame:
        """The projections as columns (c0, c1, ... or as named), attributes joined after ranking and cutting.

        A node is its key as text, a path an array of keys and relations as text. ordered
        keeps the rows' order by a last sort; leave it out where the order isn't read.
        """
        df, order = self.ranked()
        cols = []
        for i, p in enumerate(self.projections):
            df, col = self._value(df, p, i)
            cols.append(col.alias(names[i] if i < len(names) else f"c{i}"))
        if not cols:
            return df
        return (df.orderBy(*order) if ordered else df).select(*cols)

    def _raw(self, df: DataFrame, nid, type_: str | None, name: str, out: str, types: list[str] | None = None) -> tuple[DataFrame, object]:
        """An attribute of a node column, joined from its type's table or from those of types (all) that have it."""
        graph = self.graph
        types = [type_] if type_ is not None else types or graph.types
        found = {t: c for t in types if (c := graph.column(t, name))}
        if not found:
            return df, F.lit(None).cast("string")
        if name == "id" and all(graph.by_key(t) for t in types):
            return df, nid.bitwiseAND(F.lit(PLACE))
        kinds = {k for _, k in found.values()}
        cast = None if len(kinds) == 1 else "string"
        tables = [graph.attrs(t).select(F.col("nid").alias(f"_n{out}"), (F.col(f"`{c}`").cast(cast) if cast else F.col(f"`{c}`")).alias(f"_a{out}")) for t, (c, _) in found.items()]
        return df.join(reduce(DataFrame.unionByName, tables), nid == F.col(f"_n{out}"), "left"), F.col(f"_a{out}")

    def _value(self, df: DataFrame, p, i: int):
        col = F.col(self.names.of[id(variable(p))]) if variable(p) is not None else None
        if isinstance(p, Score):
            return df, F.col("score")
        if isinstance(p, Term) and not p.counted:
            return self._raw(df, col, p.node.type, p.name, str(i), self._types.get(self.names.of[id(p.node)]))
        if isinstance(p, Term):
            degrees = self.graph.degrees(p.name, p.reverse).toDF(f"_n{i}", f"_a{i}")
            return df.join(degrees, col == F.col(f"_n{i}"), "left"), F.coalesce(f"_a{i}", F.lit(0)).cast("bigint")
        if isinstance(p, Node):
            return self._key(df, col, p.type, str(i), self._types.get(self.names.of[id(p)]))
        nodes = F.col(f"{self.names.of[id(variable(p))]}.nodes")
        if isinstance(p, Path):
            return df, self._walk(F.col(self.names.of[id(p)]))
        at = F.get(nodes, F.when(F.lit(p._at) < 0, F.size(nodes) + p._at).otherwise(F.lit(p._at)))
        df = df.withColumn(f"_at{i}", at)
        if p._attr is not None:
            return self._raw(df, F.col(f"_at{i}"), None, p._attr, str(i))
        return self._key(df, F.col(f"_at{i}"), None, str(i))

    def _type_name(self, nid):
        return F.element_at(F.array(*(F.lit(t) for t in self.graph.types)), (F.shiftright(nid, TYPE_SHIFT) + 1).cast("int"))

    def _key(self, df, nid, type_, out, types: list[str] | None = None):
        df, raw = self._raw(df, nid, type_, "id", out, types)
        return df, F.concat(self._type_name(nid), F.lit("."), raw.cast("string"))

    def _walk(self, path):
        """Alternating node ids and relations, as text."""
        nodes, rels = path["nodes"], path["rels"]
        step = F.transform(rels, lambda r, i: F.array(F.concat(F.when(r["reverse"], "~").otherwise(""), r["name"]), F.get(nodes, i + 1).cast("string")))
        return F.concat(F.array(F.get(nodes, F.lit(0)).cast("string")), F.flatten(step))

    def _collect(self) -> list:
        df, order = self.ranked()
        graph, cols, plain = self.graph, [], {}
        for i, p in enumerate(self.projections):
            if isinstance(p, (Node, Path)):
                col = F.col(self.names.of[id(p)])
            elif isinstance(p, Position) and p._attr is None:
                nodes = F.col(f"{self.names.of[id(p._of)]}.nodes")
                col = F.get(nodes, F.when(F.lit(p._at) < 0, F.size(nodes) + p._at).otherwise(F.lit(p._at)))
            else:
                df, col = self._value(df, p, i)
            cols.append(col.alias(f"c{i}"))
        if not cols:
            return [()] * min(1, df.limit(1).count())
        rows = df.orderBy(*order).select(*cols).collect()
        ids = set()
        for i, p in enumerate(self.projections):
            if shows_node(p):
                ids |= {r[i] for r in rows}
            elif isinstance(p, Path):
                ids |= {n for r in rows for n in r[i].nodes}
        for t in {graph.type_of(n) for n in ids if n is not None}:
            mine = [n for n in ids if n is not None and graph.type_of(n) == t]
            if graph.by_key(t):
                plain |= {n: Key(graph, n, t, n & PLACE) for n in mine}
                continue
            asked = graph.spark.createDataFrame([(n,) for n in mine], "asked bigint")  # nodes of rows that are collected here
            found = graph.attrs(t).select("nid", "id").join(F.broadcast(asked), F.col("nid") == F.col("asked"))
            plain |= {r.nid: Key(graph, r.nid, t, r.id) for r in found.collect()}

        def shown(p, v):
            if shows_node(p):
                return plain.get(v)
            if isinstance(p, Path):
                out = [plain[v.nodes[0]]]
                for r, n in zip(v.rels, v.nodes[1:], strict=True):
                    out += [Rel(r.name, r.reverse), plain[n]]
                return tuple(out)
            return v

        out = [tuple(shown(p, v) for p, v in zip(self.projections, r, strict=True)) for r in rows]
        return [r[0] for r in out] if len(self.projections) == 1 else out

    def _all(self) -> list:
        if self._rows is None:
            self._rows = self._collect()
        return self._rows

    def __iter__(self):
        return iter(self._all())

    def __len__(self):
        return len(self._all())

    def __getitem__(self, i):
        return self._all()[i]

    def __repr__(self):
        return repr(self._all())
