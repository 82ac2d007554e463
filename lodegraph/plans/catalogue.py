"""Queries over the star-schema tables as a graph, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph import (
    Alphabetical, Compare, Connectivity, DiffusedMatrixFactorization, Edge, EdgeTable, Graph, Greedy, Has, Like, MatrixFactorization, Node, NodeTable, PageRank, Path, Score, from_files,
)
from lodegraph.sources.shared import settle, shared_folder

QUERIES: dict[str, Callable[[Graph], DataFrame]] = {}
SQL: dict[str, str] = {}


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers, suppliers, parts, orders, brands, items, documents, languages and sources."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")}
    events = t["events"].withColumn("item", F.get_json_object("props", "$.k").cast("bigint"))
    docs = t["documents"].select("doc_id", "lang", "source", "n_chars").join(t["labels"].dropDuplicates(["doc_id"]), "doc_id", "left")
    nodes = [
        NodeTable("region", t["region"], "r_regionkey", ("r_name",), "r_name"), NodeTable("nation", t["nation"], "n_nationkey", ("n_name",), "n_name"),
        NodeTable("customer", t["customer"], "c_custkey", ("c_name", "c_acctbal", "c_mktsegment"), "c_name"), NodeTable("supplier", t["supplier"], "s_suppkey", ("s_name", "s_acctbal"), "s_name"),
        NodeTable("part", t["part"], "p_partkey", ("p_name", "p_brand", "p_type", "p_size", "p_retailprice"), "p_name"), NodeTable("order", t["orders"], "o_orderkey", ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
        NodeTable("brand", t["part"], "p_brand"), NodeTable("item", events.select("item").where("item is not null").distinct(), "item"),
        NodeTable("doc", docs, "doc_id", ("n_chars", "quality", "toxic")), NodeTable("lang", t["documents"], "lang"), NodeTable("source", t["documents"], "source"),
    ]
    edges = [
        EdgeTable("in_region", t["nation"], ("nation", "n_nationkey"), ("region", "n_regionkey")), EdgeTable("in_nation", t["customer"], ("customer", "c_custkey"), ("nation", "c_nationkey")), EdgeTable("in_nation", t["supplier"], ("supplier", "s_suppkey"), ("nation", "s_nationkey")),
        EdgeTable("placed_by", t["orders"], ("order", "o_orderkey"), ("customer", "o_custkey")), EdgeTable("contains", t["lineitem"], ("order", "l_orderkey"), ("part", "l_partkey")), EdgeTable("shipped_by", t["lineitem"], ("order", "l_orderkey"), ("supplier", "l_suppkey")),
        EdgeTable("supplies", t["lineitem"], ("supplier", "l_suppkey"), ("part", "l_partkey")), EdgeTable("has_brand", t["part"], ("part", "p_partkey"), ("brand", "p_brand")), EdgeTable("has_interact", events, ("customer", "user_id"), ("item", "item")),
        EdgeTable("in_lang", t["documents"], ("doc", "doc_id"), ("lang", "lang")), EdgeTable("from_source", t["documents"], ("doc", "doc_id"), ("source", "source")),
    ]
    return Graph.from_tables(nodes, edges, related=True)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(q, *names: str) -> DataFrame:
    return q.to_df(*names, ordered=False)


@query("SELECT o_orderkey AS o, c_custkey AS c FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'")
def rel_eq_chain(g):
    o, c, n = Node("order"), Node("customer"), Node("nation")
    return table(g.select(o.id, c.id).where(o.placed_by == c, c.in_nation == n, n.label == "NATION_3"), "o", "c")


@query("SELECT c_custkey AS c FROM customer WHERE c_acctbal < 100 AND c_mktsegment >= 'F'")
def attr_compare(g):
    c = Node("customer")
    return table(g.select(c.id).where(c.c_acctbal < 100, c.c_mktsegment >= "F"), "c")


@query("SELECT d.doc_id AS d, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM 1")
def attr_ne_nulls(g):
    d = Node("doc")
    return table(g.select(d.id, d.quality).where(d.quality != 1), "d", "quality")


@query("SELECT p_partkey AS p, p_size::BIGINT AS size FROM part WHERE p_size IN (1, 7, 49)")
def attr_isin(g):
    p = Node("part")
    return table(g.select(p.id, p.p_size).where(p.p_size.is_in([1, "7", 49, "x"])), "p", "size").withColumn("size", F.col("size").cast("bigint"))


@query("SELECT p_partkey AS p FROM part WHERE p_retailprice BETWEEN 950 AND 1000")
def attr_between(g):
    p = Node("part")
    return table(g.select(p.id).where(p.p_retailprice.is_between(950, 1000)), "p")


@query("SELECT p_partkey AS p FROM part WHERE contains(lower(p_name), 're')")
def attr_contains(g):
    p = Node("part")
    return table(g.select(p.id).where(p.label.contains("RE")), "p")


@query("SELECT d.doc_id AS d FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT coalesce(l.toxic = 1, false) AND NOT coalesce(d.n_chars BETWEEN 500 AND 3000, false)")
def not_predicate(g):
    d = Node("doc")
    return table(g.select(d.id).where(~(d.toxic == 1), ~d.n_chars.is_between(500, 3000)), "d")


@query("SELECT c_custkey AS c FROM customer WHERE c_custkey IN (3, 5, 77)")
def identity_isin(g):
    c = Node("customer")
    return table(g.select(c.id).where(c.is_in(["customer.3", ("customer", 5), ("customer", 77), "customer.999999999", "nothing.1"])), "c")


@query("SELECT n_nationkey::BIGINT AS n FROM nation WHERE n_name = 'NATION_7'")
def label_filter(g):
    n = Node("nation")
    return table(g.select(n.id).where(n.label == "NATION_7"), "n")


@query("SELECT o_orderkey AS o FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01'")
def kwargs_sugar(g):
    o = Node("order", o_orderstatus="F")
    return table(g.select(o.id).where(o.o_orderdate < "1996-01-01"), "o")


@query("SELECT 'nation.' || n_nationkey AS k FROM nation WHERE contains(lower(n_name), 'a') UNION SELECT 'region.' || r_regionkey FROM region WHERE contains(lower(r_name), 'a') UNION SELECT 'customer.' || c_custkey FROM customer WHERE contains(lower(c_name), 'a') UNION SELECT 'supplier.' || s_suppkey FROM supplier WHERE contains(lower(s_name), 'a') UNION SELECT 'part.' || p_partkey FROM part WHERE contains(lower(p_name), 'a')")
def untyped_label(g):
    x = Node()
    return table(g.select(x).where(x.label.contains("a")), "k")


@query("SELECT DISTINCT p_partkey AS p FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_orderkey = 1 OR l_orderkey = 2")
def inverse_edge(g):
    p, o = Node("part"), Node("order")
    return table(g.select(p.id).where(Has(p, "contains", o, True), o.id.is_in([1, 2])), "p")


_NEAR = "(SELECT 'order.' || o_orderkey AS s, 'customer.' || o_custkey AS d FROM orders UNION ALL SELECT 'customer.' || c_custkey, 'nation.' || c_nationkey FROM customer UNION ALL SELECT 'customer.' || user_id, 'item.' || json_extract_string(props, '$.k') FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL)"


@query(f"SELECT DISTINCT CASE WHEN s = 'customer.7' THEN d ELSE s END AS k FROM {_NEAR} WHERE s = 'customer.7' OR d = 'customer.7'")
def wildcard_edge(g):
    c, x, p = Node("customer"), Node(), Path()
    return table(g.select(x).where(p == [c, Edge(), x], c.id == 7), "k")


@query("SELECT DISTINCT b.c_custkey AS c FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey WHERE a.c_custkey = 7")
def two_hop_bridge(g):
    a, n, b, p = Node("customer"), Node("nation"), Node("customer"), Path()
    return table(g.select(b.id).where(p == [a, Edge(), n, Edge(), b], a.id == 7), "c")


@query("SELECT DISTINCT 'order.' || o_orderkey AS first, 'nation.' || c_nationkey AS last FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def path_first_last(g):
    o, c, n, p = Node("order"), Node("customer"), Node("nation"), Path()
    return table(g.select(p.first, p.last).where(p == [o, Edge("placed_by"), c, Edge("in_nation"), n], o.o_totalprice > 300000), "first", "last").distinct()


@query("SELECT ['x'] AS nothing FROM region WHERE false")
def path_unknown_relation(g):
    o, c, p = Node("order"), Node("customer"), Path()
    return table(g.select(p).where(p == [o, Edge("nothing"), c]), "nothing")


@query("SELECT [(5::BIGINT * 281474976710656 + o_orderkey)::VARCHAR, 'placed_by', (2::BIGINT * 281474976710656 + o_custkey)::VARCHAR] AS walk FROM orders WHERE o_totalprice > 350000")
def path_projection(g):
    o, c, p = Node("order"), Node("customer"), Path()
    return table(g.select(p).where(p == [o, Edge("placed_by"), c], o.o_totalprice > 350000), "walk")


@query("SELECT c_custkey AS c FROM customer WHERE c_acctbal > 9000 OR c_mktsegment = 'BUILDING'")
def or_union(g):
    c = Node("customer")
    return table(g.select(c.id).where((c.c_acctbal > 9000) | (c.c_mktsegment == "BUILDING")), "c")


@query("SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_suppkey = 3 UNION SELECT p_partkey FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def or_two_shapes(g):
    p, s, b, low = Node("part"), Node("supplier"), Node("brand"), Path()
    least = g.attrs("brand").agg(F.min("id")).first()[0]
    return table(g.select(p.id).where(((low == [p, Edge("supplies").inverse, s]) & (s.id == 3)) | (Has(p, "has_brand", b) & (b.id == least))), "p")


@query("SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey)")
def semi_existential(g):
    c, o, p = Node("customer"), Node("order"), Node("part")
    return table(g.select(c.id).where(o.placed_by == c, Has(o, "contains", p)), "c")


@query("SELECT DISTINCT a.s_suppkey AS a, b.c_custkey AS b FROM supplier a JOIN customer b ON a.s_nationkey = b.c_nationkey WHERE a.s_acctbal > 8000 AND b.c_acctbal > 9000")
def diamond_join(g):
    a, b, n = Node("supplier"), Node("customer"), Node("nation")
    return table(g.select(a.id, b.id).where(a.in_nation == n, b.in_nation == n, a.s_acctbal > 8000, b.c_acctbal > 9000), "a", "b")


@query("SELECT c_custkey AS c, n_nationkey::BIGINT AS n FROM customer CROSS JOIN nation WHERE c_nationkey <> n_nationkey")
def anti_join(g):
    c, n = Node("customer"), Node("nation")
    return table(g.select(c.id, n.id).where(~Has(c, "in_nation", n)), "c", "n")


@query("SELECT DISTINCT s_suppkey AS s FROM supplier CROSS JOIN nation WHERE s_nationkey <> n_nationkey")
def anti_join_hidden(g):
    s, n = Node("supplier"), Node("nation")
    return table(g.select(s.id).where(~Has(s, "in_nation", n)), "s")


@query("SELECT p_partkey AS p, b.p_brand AS b FROM part CROSS JOIN (SELECT DISTINCT p_brand FROM part) b WHERE part.p_brand <> b.p_brand")
def anti_multi_rel(g):
    """Parts and brands, for all orders and all parts are too many pairs to be a result."""
    p, b = Node("part"), Node("brand")
    return table(g.select(p.id, b.id).where(~Has(p, ("has_brand", "nothing"), b)), "p", "b")


@query("SELECT n_nationkey::BIGINT AS n, r_regionkey::BIGINT AS r FROM nation CROSS JOIN region")
def cross_product(g):
    n, r = Node("nation"), Node("region")
    return table(g.select(n.id, r.id), "n", "r")


@query("SELECT o_orderkey AS o, count(l_orderkey)::BIGINT AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def degree_projection(g):
    o = Node("order")
    return table(g.select(o.id, o.contains.count()), "o", "lines")


@query("SELECT o_orderkey AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def degree_zero(g):
    o = Node("order")
    return table(g.select(o.id).where(o.contains.count() == 0), "o")


@query("SELECT c_custkey AS c FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) < 8")
def degree_predicate(g):
    c = Node("customer")
    return table(g.select(c.id).where(c.placed_by.inverse.count() < 8), "c")


@query("SELECT p_partkey AS p, count(l_partkey)::BIGINT AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey ORDER BY n DESC, p LIMIT 10")
def degree_rank_top(g):
    p = Node("part")
    return table(g.select(p.id, p.contains.inverse.count()).rank(p.contains.inverse.count()).top(10), "p", "n")


@query("SELECT p_partkey AS p FROM part ORDER BY p_name, p_partkey LIMIT 20")
def rank_alphabetical_top(g):
    p = Node("part")
    return table(g.select(p.id).rank(Alphabetical()).top(20), "p")


@query("SELECT c_custkey AS c, (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS score FROM customer")
def score_minmax(g):
    c = Node("customer")
    return table(g.select(c.id, Score()).rank(c.c_acctbal), "c", "score")


@query("WITH d AS (SELECT c_custkey AS c, c_acctbal AS a, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)::DOUBLE AS n FROM customer) SELECT c, ((a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) + (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ())) / 2 AS score FROM d ORDER BY score DESC, c LIMIT 25")
def two_signal_mean(g):
    c = Node("customer")
    return table(g.select(c.id, Score()).rank(c.c_acctbal, c.placed_by.inverse.count()).top(25), "c", "score")


@query("SELECT n, c FROM (SELECT n_nationkey::BIGINT AS n, c_custkey AS c, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE r <= 3")
def group_topn(g):
    n, c = Node("nation"), Node("customer")
    return table(g.select(n.id, c.id).where(c.in_nation == n).groupby(n).rank(c.c_acctbal).top(3), "n", "c")


@query("WITH k AS (SELECT n_nationkey::BIGINT AS n, c_custkey AS c, c_acctbal AS a, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT n, c FROM k WHERE r <= 2 AND n IN (SELECT n FROM k WHERE r = 1 ORDER BY (SELECT count(*) FROM orders WHERE o_custkey = k.c) DESC, n LIMIT 4)")
def group_outer_topm(g):
    n, c = Node("nation"), Node("customer")
    return table(g.select(n.id, c.id).where(c.in_nation == n).groupby(n).rank(c.c_acctbal).top(2).rank(c.placed_by.inverse.count()).top(4), "n", "c")


def _soft(name: str, mode: str, fade: str) -> None:
    sql = f"WITH k AS (SELECT p_partkey AS p, CASE WHEN p_retailprice <= 950 THEN 1.0 ELSE {fade.replace('R', '((p_retailprice - 950) / 20)')} END AS m FROM part WHERE p_retailprice <= 1010) SELECT p, round(CASE WHEN max(m) OVER () > min(m) OVER () THEN (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) ELSE 0 END, 9) AS score FROM k"

    def run(g):
        p = Node("part")
        return table(g.select(p.id, Score()).where(Like(p.p_retailprice <= 950, mode=mode, t=20)), "p", "score").withColumn("score", F.round("score", 9))

    run.__name__ = name
    query(sql)(run)


_soft("like_gaussian", "gaussian", "exp(-0.5 * R * R)")
_soft("like_linear", "linear", "greatest(0, 1 - R / 3)")
_soft("like_sigmoid", "sigmoid", "1 / (1 + exp(R - 3))")
_soft("like_leaky", "leaky", "greatest(0.05 * greatest(0, 1 - R / 6), exp(-0.5 * R * R))")


@query("WITH k AS (SELECT p_partkey AS p, exp(-0.5 * (abs(p_size - 25) / 2.0) ^ 2) AS m FROM part WHERE p_size BETWEEN 19 AND 31) SELECT p, round((m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()), 9) AS score FROM k")
def like_equality_band(g):
    p = Node("part")
    return table(g.select(p.id, Score()).where(Like(p.p_size == 25, width=2)), "p", "score").withColumn("score", F.round("score", 9))


@query("SELECT p_partkey AS p FROM part WHERE contains(lower(p_name), 'widget') ORDER BY p_partkey LIMIT 3")
def like_contains_topk(g):
    p = Node("part")
    return table(g.select(p.id).where(Like(p.label.is_in(["WIDGET"]), k=3)), "p")


@query()
def like_typo(g):
    n = Node("nation")
    return table(g.select(n.id, Score()).where(Like(n.label.is_in(["natoin_1"]), k=3)), "n", "score")


@query("WITH e AS (SELECT s, d FROM (SELECT DISTINCT 'c' || c_custkey AS s, 'n' || c_nationkey AS d FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)), u AS (SELECT s, d FROM e UNION SELECT d, s FROM e), one AS (SELECT s AS seed, d AS x FROM u WHERE s IN ('r0', 'r1', 'n5')), two AS (SELECT seed, x FROM one UNION SELECT seed, d FROM one JOIN u ON x = s) SELECT n_nationkey::BIGINT AS n, count(DISTINCT seed)::BIGINT AS seeds FROM nation LEFT JOIN two ON x = 'n' || n_nationkey GROUP BY n_nationkey")
def connectivity_2hop(g):
    from lodegraph.plans.query import Context

    n, signal = Node("nation"), Connectivity(to=[("region", 0), ("region", 1), ("nation", 5)])
    q = g.select(n.id)
    df, value = q._value(signal.score(Context(q), q.bindings(), "seeds"), n.id, 0)
    return df.select(value.alias("n"), F.col("seeds").cast("bigint").alias("seeds"))


#: The star graph for SQL: nodes by key, and edges both ways with their multiplicity.
_STAR = """v AS (
  SELECT 'region.' || r_regionkey AS k FROM region UNION ALL SELECT 'nation.' || n_nationkey FROM nation UNION ALL SELECT 'customer.' || c_custkey FROM customer
  UNION ALL SELECT 'supplier.' || s_suppkey FROM supplier UNION ALL SELECT 'part.' || p_partkey FROM part UNION ALL SELECT 'order.' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'brand.' || p_brand FROM part UNION ALL SELECT DISTINCT 'item.' || json_extract_string(props, '$.k') FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
  UNION ALL SELECT 'doc.' || doc_id FROM documents UNION ALL SELECT DISTINCT 'lang.' || lang FROM documents WHERE lang IS NOT NULL UNION ALL SELECT DISTINCT 'source.' || source FROM documents WHERE source IS NOT NULL),
e AS (
  SELECT 'nation.' || n_nationkey AS s, 'region.' || n_regionkey AS d FROM nation UNION ALL SELECT 'customer.' || c_custkey, 'nation.' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier.' || s_suppkey, 'nation.' || s_nationkey FROM supplier UNION ALL SELECT 'order.' || o_orderkey, 'customer.' || o_custkey FROM orders
  UNION ALL SELECT 'order.' || l_orderkey, 'part.' || l_partkey FROM lineitem UNION ALL SELECT 'order.' || l_orderkey, 'supplier.' || l_suppkey FROM lineitem
  UNION ALL SELECT 'supplier.' || l_suppkey, 'part.' || l_partkey FROM lineitem UNION ALL SELECT 'part.' || p_partkey, 'brand.' || p_brand FROM part
  UNION ALL SELECT 'customer.' || user_id, 'item.' || json_extract_string(props, '$.k') FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
  UNION ALL SELECT 'doc.' || doc_id, 'lang.' || lang FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'doc.' || doc_id, 'source.' || source FROM documents WHERE source IS NOT NULL)"""
_WALK = """WITH {graph},
u AS (SELECT s, d FROM e UNION ALL SELECT d, s FROM e), outs AS (SELECT s, count(*)::DOUBLE AS n FROM u GROUP BY s),
w AS MATERIALIZED (SELECT u.s, u.d, count(*) / any_value(n) AS w FROM u JOIN outs ON outs.s = u.s GROUP BY u.s, u.d),
t AS MATERIALIZED (SELECT k, {restart} AS t, outs.s IS NULL AS stuck FROM v LEFT JOIN outs ON outs.s = k),
r0 AS (SELECT k, t AS r FROM t), {steps}"""
_STEPS = ", ".join(
    f"r{i + 1} AS MATERIALIZED (SELECT t.k, (0.15::DOUBLE + 0.85 * coalesce((SELECT sum(r) FROM r{i} JOIN t USING (k) WHERE stuck), 0)) * t.t + 0.85 * coalesce(f.x, 0) AS r"
    f" FROM t LEFT JOIN (SELECT d, sum(r * w) AS x FROM w JOIN r{i} ON s = k GROUP BY d) f ON f.d = t.k)"
    for i in range(5)
)


def _ranked(g, seeds):
    """Ranks of all nodes, by key."""
    from lodegraph.plans.query import Context

    x, signal = Node(), PageRank(to=seeds, iterations=5, tol=0)
    signal.fit(g)
    q = g.select(x)
    df, key = q._key(signal.score(Context(q), q.bindings(), "r"), F.col(q.columns()[0]), None, "key")
    return df.select(key.alias("k"), F.round("r", 12).alias("rank"))


@query(_WALK.format(graph=_STAR, restart="1.0::DOUBLE / (SELECT count(*) FROM v)", steps=_STEPS) + " SELECT k, round(r, 12) AS rank FROM r5")
def pagerank_global(g):
    return _ranked(g, None)


@query(_WALK.format(graph=_STAR, restart="CASE WHEN k IN ('nation.3', 'nation.4') THEN 0.5::DOUBLE ELSE 0.0 END", steps=_STEPS) + " SELECT k, round(r, 12) AS rank FROM r5")
def pagerank_rwr(g):
    return _ranked(g, [("nation", 3), ("nation", 4), ("nation", 999)])


_PAIRS = "SELECT DISTINCT user_id AS u, json_extract_string(props, '$.k')::BIGINT AS i FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL"


def _factors(rounds: int, pairs: str = _PAIRS) -> str:
    """Two factors of the pairs (u, i) by alternating least squares, in closed form: u<rounds>(k, x, y) and i<rounds>."""
    at = "(7::BIGINT * 281474976710656 + k)"
    draw = "0.1 * sqrt(-2 * ln({0})) * cos({1})"

    def uniform(j: int, part: int) -> str:
        return f"((('0x' || substr(md5('42|{j}|' || {at}), {part}, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"

    start = ", ".join(draw.format(uniform(j, 1), f"2 * pi() * {uniform(j, 17)}") + f" AS {c}" for j, c in enumerate("xy"))
    out = [f"p AS MATERIALIZED ({pairs})", f"i0 AS (SELECT k, {start} FROM (SELECT DISTINCT i AS k FROM p))"]
    for n in range(1, rounds + 1):
        for near, far, known, name in (("u", "i", f"i{n - 1}", f"u{n}"), ("i", "u", f"u{n}", f"i{n}")):
            sums = f"(SELECT p.{near} AS k, sum(x * x) + 0.05 AS a, sum(x * y) AS b, sum(y * y) + 0.05 AS c, sum(x) AS p, sum(y) AS q FROM p JOIN {known} f ON f.k = p.{far} GROUP BY p.{near})"
            out.append(f"{name} AS MATERIALIZED (SELECT k, (c * p - b * q) / (a * c - b * b) AS x, (a * q - b * p) / (a * c - b * b) AS y FROM {sums})")
    return ", ".join(out)


@query(
    f"WITH {_factors(3)}, s AS (SELECT p.u AS c, p.i, a.x * b.x + a.y * b.y AS s FROM p JOIN u3 a ON a.k = p.u JOIN i3 b ON b.k = p.i), "
    "z AS (SELECT c, i, CASE WHEN max(s) OVER g > min(s) OVER g THEN (s - min(s) OVER g) / (max(s) OVER g - min(s) OVER g) ELSE 0 END AS score FROM s WINDOW g AS (PARTITION BY c)) "
    "SELECT c, i, round(score, 6) AS score FROM z QUALIFY row_number() OVER (PARTITION BY c ORDER BY score DESC, i) <= 3"
)
def mf_user_topk(g):
    c, i = Node("customer"), Node("item")
    mf = MatrixFactorization(factors=2, iterations=3, item_type="item", user_type="customer")
    return table(g.select(c.id, i.id, Score()).where(Has(c, "has_interact", i)).groupby(c).rank(mf).top(3), "c", "i", "score").withColumn("score", F.round("score", 6))


@query(
    f"WITH {_factors(3)}, seeds AS (SELECT x, y FROM u3 WHERE k = 3 UNION ALL SELECT x, y FROM i3 WHERE k = 5), s AS (SELECT k, max(i3.x * seeds.x + i3.y * seeds.y) AS s FROM i3, seeds GROUP BY k), "
    "z AS (SELECT k AS i, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS score FROM s) SELECT i, round(score, 6) AS score FROM z ORDER BY z.score DESC, i LIMIT 10"
)
def diffused_mf(g):
    i = Node("item")
    mf = DiffusedMatrixFactorization(factors=2, iterations=3, item_type="item", user_type="customer", to=[("customer", 3), ("item", 5)])
    return table(g.select(i.id, Score()).rank(mf).top(10), "i", "score").withColumn("score", F.round("score", 6))


@query(
    f"WITH {_factors(3)}, seen AS (SELECT DISTINCT p.i FROM p JOIN customer ON c_custkey = p.u WHERE c_acctbal > 5000), first AS (SELECT min(p.u) AS u FROM p JOIN customer ON c_custkey = p.u WHERE c_acctbal > 5000), "
    "s AS (SELECT seen.i, f.x * a.x + f.y * a.y AS s FROM seen JOIN i3 f ON f.k = seen.i, first JOIN u3 a ON a.k = first.u) SELECT i, round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 6) AS score FROM s"
)
def mf_matched_user(g):
    c, i = Node("customer"), Node("item")
    mf = MatrixFactorization(factors=2, iterations=3, item_type="item", user_type="customer")
    return table(g.select(i.id, Score()).where(Has(c, "has_interact", i), c.c_acctbal > 5000).rank(mf), "i", "score").withColumn("score", F.round("score", 6))


_SPLIT = (
    f"pairs AS MATERIALIZED (SELECT u, i, count(*) OVER (PARTITION BY u) AS n, row_number() OVER (PARTITION BY u ORDER BY md5('42|' || u || '|' || i), i) AS place FROM ({_PAIRS})), "
    "parted AS MATERIALIZED (SELECT u, i, n > 1 AND place <= round(n * 0.2) AS held FROM pairs)"
)


@query(
    f"WITH {_SPLIT}, {_factors(3, 'SELECT u, i FROM parted WHERE NOT held')}, "
    "near AS (SELECT DISTINCT a.u, c.i FROM p a JOIN p b ON b.i = a.i JOIN p c ON c.u = b.u), "
    "offered AS (SELECT near.u, near.i, a.x * b.x + a.y * b.y AS s FROM near ANTI JOIN p ON p.u = near.u AND p.i = near.i JOIN u3 a ON a.k = near.u JOIN i3 b ON b.k = near.i), "
    "ranked AS (SELECT u, i, row_number() OVER (PARTITION BY u ORDER BY s DESC, i) AS rank FROM offered QUALIFY rank <= 10), "
    "wanted AS (SELECT u, count(*) AS w FROM parted WHERE held GROUP BY u), given AS (SELECT u, count(*) AS g FROM ranked GROUP BY u), "
    "hits AS (SELECT r.u, count(*) AS h, sum(1 / log2(rank + 1)) AS gain FROM ranked r JOIN parted t ON t.u = r.u AND t.i = r.i AND t.held GROUP BY r.u) "
    "SELECT count(*) AS users, round(avg(coalesce(h / g, 0)), 9) AS precision, round(avg(coalesce(h, 0) / w), 9) AS recall, round(avg(CASE WHEN h > 0 THEN 1 ELSE 0 END), 9) AS hit_rate, "
    "round(avg(coalesce(gain, 0) / list_sum(list_transform(generate_series(1, least(w, 10)), lambda j: 1 / log2(j + 1)))), 9) AS ndcg FROM wanted LEFT JOIN given USING (u) LEFT JOIN hits USING (u)"
)
def evaluate_factors(g):
    """Items recommended to every customer from those of customers with an item in common, against the pairs held out."""
    from lodegraph.operators.evaluation import quality, split

    pairs = settle(split(g.memo["files"]["events"].where("item is not null"), "user_id", "item"), "split-pairs")  # read by each edge of the pattern and each iteration
    learnt = EdgeTable("has_interact", pairs.where("not held"), ("customer", "user_id"), ("item", "item"))
    known = g.only(["has_interact"])
    known.parts = {"has_interact": Graph.from_tables([NodeTable(t, g.spark.range(0), "id") for t in g.types], [learnt], related=True).parts["has_interact"]}
    c, seen, mate, i, path = Node("customer"), Node("item"), Node("customer"), Node("item"), Path()
    mf = MatrixFactorization(factors=2, iterations=3, item_type="item", user_type="customer")
    found = known.select(c.id, i.id).where(path == [c, Edge(), seen, Edge(), mate, Edge(), i], ~Has(c, "has_interact", i)).groupby(c).rank(mf).top(10)
    rows, order = found.ranked()
    user, item = (F.col(n).bitwiseAND(F.lit((1 << 48) - 1)) for n in found.columns())
    given = rows.select(user.alias("user_id"), item.alias("item"), F.col("_rn").alias("rank"))
    return quality(given, pairs.where("held"), "user_id", "item").select("users", *(F.round(m, 9).alias(m) for m in ("precision", "recall", "hit_rate", "ndcg")))


@query("SELECT a.vec_id AS v, round(-sqrt(list_sum(list_transform(generate_series(1, 64), lambda i: (s.embedding[i]::DOUBLE + 0.01 - a.embedding[i]::DOUBLE) ^ 2))), 6) AS p FROM embeddings a, embeddings s WHERE s.vec_id = 0")
def transe_plausibility(g):
    from lodegraph import TransE
    from lodegraph.plans.query import Context

    vectors = g.memo["embeddings"]
    entities = Graph.from_tables([NodeTable("entity", vectors, "vec_id")], [EdgeTable("near", vectors.limit(0), ("entity", "vec_id"), ("entity", "vec_id"))])
    model = TransE(factors=64, to=[("entity", 0)], relation="near")
    model.nodes = entities.attrs("entity").select("nid", "id").join(vectors, F.col("id") == F.col("vec_id")).select("nid", F.col("embedding").cast("array<double>").alias("vec"))
    model.rels = {"near": {"vec": [0.01] * 64}}
    e = Node("entity")
    q = entities.select(e.id)
    df = model.score(Context(q), q.bindings(), "p")
    df, value = q._value(df, e.id, 0)
    return df.select(value.alias("v"), F.round("p", 6).alias("p"))


class _ByDegree(PageRank):
    """A guide that weighs a step by how many orders contain its end."""

    def fit(self, graph):
        self.ranks = graph.degrees("contains", True).select("nid", F.col("degree").cast("double"))


@query("WITH d AS (SELECT l_partkey AS p, count(*) AS n FROM lineitem GROUP BY l_partkey), k AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) SELECT o, p FROM (SELECT o, p, row_number() OVER (PARTITION BY o ORDER BY n DESC, p) AS r FROM k JOIN d USING (p)) WHERE r <= 2")
def greedy_beam_degree(g):
    o, p = Node("order"), Node("part")
    return table(g.select(o.id, p.id).where(Has(o, "contains", p)).rank(_ByDegree()).using(Greedy(k=2)), "o", "p")


@query("SELECT DISTINCT user_id AS c, json_extract_string(props, '$.k')::BIGINT AS i FROM events WHERE value BETWEEN 50 AND 100 AND json_extract_string(props, '$.k') IS NOT NULL")
def interactions_rating_filter(g):
    rated = g.only(["has_interact"])
    rated.parts = {"has_interact": g.memo["rated"]}
    c, i = Node("customer"), Node("item")
    return table(rated.select(c.id, i.id).where(c.has_interact == i), "c", "i")


_SHOP = """v AS (
  SELECT 'region.' || r_regionkey AS k FROM region UNION ALL SELECT 'nation.' || n_nationkey FROM nation UNION ALL SELECT 'customer.' || c_custkey FROM customer
  UNION ALL SELECT 'supplier.' || s_suppkey FROM supplier UNION ALL SELECT 'part.' || p_partkey FROM part UNION ALL SELECT 'order.' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'brand.' || p_brand FROM part UNION ALL SELECT DISTINCT 'item.' || json_extract_string(props, '$.k') FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
  UNION ALL SELECT 'doc.' || doc_id FROM documents UNION ALL SELECT DISTINCT 'lang.' || lang FROM documents WHERE lang IS NOT NULL UNION ALL SELECT DISTINCT 'source.' || source FROM documents WHERE source IS NOT NULL),
e AS (SELECT 'order.' || o_orderkey AS s, 'customer.' || o_custkey AS d FROM orders UNION ALL SELECT 'order.' || l_orderkey, 'part.' || l_partkey FROM lineitem),
seeds AS (SELECT 'customer.' || c_custkey AS seed FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'),
bought AS (SELECT DISTINCT l_partkey AS p, 'customer.' || o_custkey AS seed FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE 'customer.' || o_custkey IN (SELECT seed FROM seeds))"""


@query(
    _WALK.format(graph=_SHOP, restart="CASE WHEN k IN (SELECT seed FROM seeds) THEN 1.0::DOUBLE / (SELECT count(*) FROM seeds) ELSE 0.0 END", steps=_STEPS)
    + ", raw AS (SELECT p, any_value(r) AS r, count(*)::DOUBLE AS n FROM bought JOIN r5 ON k = 'part.' || p GROUP BY p), "
    "z AS (SELECT p, ((r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()) + CASE WHEN max(n) OVER () > min(n) OVER () THEN (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) ELSE 0 END) / 2 AS score FROM raw) "
    "SELECT p, p_name AS name, round(score, 9) AS score FROM z JOIN part ON p_partkey = p ORDER BY z.score DESC, p LIMIT 10"
)
def flagship(g):
    """Parts that customers of one nation bought, by restarting walks from those customers and by how many of them reach a part."""
    seed, n = Node("customer"), Node("nation")
    seeds = g.select(seed).where(seed.in_nation == n, n.label == "NATION_3")
    part, order, buyer, path = Node("part"), Node("order"), Node("customer"), Path()
    walk = path == [part, Edge("contains").inverse, order, Edge("placed_by"), buyer]
    shop = g.only(["placed_by", "contains"])
    q = shop.select(part.id, part.label, Score()).where(walk, buyer.is_in(seeds)).rank(PageRank(to=seeds, iterations=5, tol=0), Connectivity(to=seeds)).top(10)
    return q.to_df("p", "name", "score").withColumn("score", F.round("score", 9))


@query("SELECT o_orderkey AS o, n_name AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000")
def path_position_attribute(g):
    o, c, n, p = Node("order"), Node("customer"), Node("nation"), Path()
    return table(g.select(o.id, p.last.n_name).where(p == [o, Edge("placed_by"), c, Edge("in_nation"), n], o.o_totalprice > 300000), "o", "name")


@query("SELECT p_partkey AS p FROM part WHERE contains(lower(p_name), 're') OR contains(lower(p_name), 'bol')")
def attr_contains_any(g):
    p = Node("part")
    return table(g.select(p.id).where(Compare(p.label, "contains_any", ["RE", "bol"])), "p")


@query("SELECT p_partkey AS p FROM part WHERE contains(p_size::VARCHAR, '1') OR contains(p_size::VARCHAR, '7')")
def like_number_set(g):
    p = Node("part")
    return table(g.select(p.id).where(Like(p.p_size.is_in([1, 7]))), "p")


_FADE = "exp(-0.5 * ({0} / 20) ^ 2)"
_SPREAD = "round(CASE WHEN max(m) OVER () > min(m) OVER () THEN (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) ELSE 0 END, 9) AS score"


@query(f"WITH k AS (SELECT p_partkey AS p, CASE WHEN p_retailprice >= 1000 THEN 1.0 ELSE {_FADE.format('(1000 - p_retailprice)')} END AS m FROM part WHERE p_retailprice >= 940) SELECT p, {_SPREAD} FROM k")
def like_at_least(g):
    p = Node("part")
    return table(g.select(p.id, Score()).where(Like(p.p_retailprice >= 1000, t=20)), "p", "score").withColumn("score", F.round("score", 9))


@query(f"WITH k AS (SELECT p_partkey AS p, CASE WHEN p_retailprice <= 950 THEN 1.0 ELSE {_FADE.format('(p_retailprice - 950)')} END AS m FROM part) SELECT p, {_SPREAD} FROM k")
def like_in_rank(g):
    p = Node("part")
    return table(g.select(p.id, Score()).rank(Like(p.p_retailprice <= 950, t=20)), "p", "score").withColumn("score", F.round("score", 9))


@query("SELECT p_partkey AS p, 0.0::DOUBLE AS score FROM part WHERE contains(lower(p_name), 'bolt')")
def like_contains(g):
    p = Node("part")
    return table(g.select(p.id, Score()).where(Like(p.label.contains("BOLT"))), "p", "score")


@query("SELECT c_custkey AS c, 0.0::DOUBLE AS score FROM customer")
def like_of_a_text_column(g):
    c = Node("customer")
    return table(g.select(c.id, Score()).rank(Like(c.c_name <= 5)), "c", "score")


@query("SELECT p_partkey AS p FROM part WHERE p_size = 25")
def like_without_width(g):
    p = Node("part")
    return table(g.select(p.id).where(Like(p.p_size == 25, width=0)), "p")


@query("SELECT 'customer.' || c_custkey AS k FROM customer WHERE c_nationkey = 7 UNION SELECT 'supplier.' || s_suppkey FROM supplier WHERE s_nationkey = 7")
def reversed_wildcard(g):
    n, x, p = Node("nation"), Node(), Path()
    return table(g.select(x).where(p == [n, Edge().inverse, x], n.n_name == "NATION_7"), "k")


@query("SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem")
def several_relations(g):
    o, p = Node("order"), Node("part")
    return table(g.select(o.id, p.id).where(Has(o, ("contains", "nothing"), p)), "o", "p")


@query("SELECT row_number() OVER (ORDER BY n DESC, p) - 1 AS position, p, n FROM (SELECT p_partkey AS p, count(l_partkey)::BIGINT AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey) ORDER BY n DESC, p LIMIT 50")
def ranked_order(g):
    """Rows with their position in the result: order counts."""
    p = Node("part")
    rows = g.select(p.id, p.contains.inverse.count()).rank(p.contains.inverse.count()).top(50).to_df("p", "n")
    return rows.coalesce(1).select(F.monotonically_increasing_id().alias("position"), "p", "n")


@query("SELECT n, c, round(CASE WHEN max(a) OVER g > min(a) OVER g THEN (a - min(a) OVER g) / (max(a) OVER g - min(a) OVER g) ELSE 0 END, 9) AS score FROM (SELECT n_nationkey::BIGINT AS n, c_custkey AS c, c_acctbal AS a FROM customer JOIN nation ON c_nationkey = n_nationkey) WINDOW g AS (PARTITION BY n)")
def group_scores(g):
    n, c = Node("nation"), Node("customer")
    return table(g.select(n.id, c.id, Score()).where(c.in_nation == n).groupby(n).rank(c.c_acctbal), "n", "c", "score").withColumn("score", F.round("score", 9))


@query("SELECT n_nationkey::BIGINT AS n, min(c_custkey) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey ORDER BY n_nationkey LIMIT 6")
def group_first_without_rank(g):
    """Groups that nothing ranks come by their first row, and so do their rows."""
    n, c = Node("nation"), Node("customer")
    return table(g.select(n.id, c.id).where(c.in_nation == n).groupby(n).top(1).top(6), "n", "c")


@query("SELECT c_custkey AS c, n_name AS name, count(e.user_id)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT user_id FROM events WHERE value BETWEEN 50 AND 100 AND json_extract_string(props, '$.k') IS NOT NULL) e ON e.user_id = c_custkey GROUP BY c_custkey, n_name")
def graph_from_files(g):
    """Triples, rated interactions and an attribute table, written as text and read as a graph."""
    folder = f"{shared_folder(g.spark)}/text-{uuid.uuid4().hex}"
    line = lambda *cols: F.concat_ws("\t", *(c.cast("string") for c in cols))
    named = lambda type_, c: F.concat(F.lit(f"{type_}."), F.col(c).cast("string"))
    t = g.memo["files"]
    t["customer"].select(line(named("customer", "c_custkey"), F.lit("in_nation"), named("nation", "c_nationkey"))).write.text(f"{folder}/kg")
    t["events"].where("item is not null").select(line(named("customer", "user_id"), named("item", "item"), F.col("value"))).write.text(f"{folder}/ui")
    header = g.spark.range(1).select(F.lit("id\tn_name").alias("l"), F.lit(-1).alias("o"))
    t["nation"].select(line(F.col("n_nationkey"), F.col("n_name")).alias("l"), F.col("n_nationkey").alias("o")).unionByName(header).coalesce(1).sortWithinPartitions("o").select("l").write.text(f"{folder}/x.nation")  # 25 rows
    read = from_files(g.spark, f"{folder}/kg", f"{folder}/ui", [f"{folder}/x.nation"], sf=(50, 100))
    c, n = Node("customer"), Node("nation")
    return table(read.select(c.id, n.n_name, c.has_interact.count()).where(c.in_nation == n), "c", "name", "n")


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    g.memo["embeddings"] = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("item", F.get_json_object("props", "$.k").cast("bigint"))
    rated = EdgeTable("has_interact", events.where(F.col("value").between(50, 100)), ("customer", "user_id"), ("item", "item"))
    g.memo["rated"] = Graph.from_tables([NodeTable(t, spark.range(0), "id") for t in g.types], [rated], related=True).parts["has_interact"]
    g.memo["files"] = {"events": events, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "nation")}}
    return QUERIES[name](g)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, name=name: run(name, spark, sf_dir)) for name in QUERIES}
