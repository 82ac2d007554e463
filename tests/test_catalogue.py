"""Registered queries over whole tables: no id limits what takes part."""

import duckdb
import pyarrow.parquet as pq
import pytest

from lodegraph.plans import catalogue

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["anti_join", "anti_join_hidden", "anti_multi_rel", "greedy_beam_degree"])
def test_whole_tables_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "nation", "supplier", "part", "orders", "lineitem"):
        con.register(t, pq.read_table(f"{SF}/{t}.parquet"))
    want = sorted(con.execute(catalogue.SQL[name]).fetchall())
    assert sorted(map(tuple, catalogue.run(name, spark, SF).collect())) == want


def test_every_customer_gets_its_top_items(spark):
    con = duckdb.connect()
    con.register("events", pq.read_table(f"{LARGER}/events.parquet"))
    items = dict(con.execute("SELECT user_id, count(DISTINCT json_extract_string(props, '$.k')::BIGINT) FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY user_id").fetchall())
    got = {}
    for r in catalogue.run("mf_user_topk", spark, LARGER).collect():
        got.setdefault(r.c, []).append(r.i)
    assert {c: len(set(i)) for c, i in got.items()} == {c: min(3, n) for c, n in items.items()}
    assert max(got) >= 20


def test_hidden_nodes_in_a_row_go_by_the_rows_they_make(spark, monkeypatch):
    """Many users of few items: joining at the items would pair all users."""
    from lodegraph import Edge, EdgeTable, Graph, Node, NodeTable, Path
    from lodegraph.operators import search

    made = []
    settle = search.settle
    monkeypatch.setattr(search, "settle", lambda df, name: made.append(settle(df, name)) or made[-1])
    pairs = [(u, i) for u in range(60) for i in ((0, 1) if u else (0, 1, 2))]
    users, items = (spark.range(n).withColumnRenamed("id", c) for n, c in ((60, "u"), (3, "i")))
    g = Graph.from_tables([NodeTable("user", users, "u"), NodeTable("item", items, "i")], [EdgeTable("has", spark.createDataFrame(pairs, "u bigint, i bigint"), ("user", "u"), ("item", "i"))])
    c, seen, mate, i, path = Node("user"), Node("item"), Node("user"), Node("item"), Path()
    got = g.select(c.id, i.id).where(path == [c, Edge(), seen, Edge(), mate, Edge(), i]).to_df("c", "i", ordered=False)
    assert sorted(map(tuple, got.collect())) == [(u, i) for u in range(60) for i in range(3)]
    assert [df.count() for df in made] == [9]  # pairs of items, not of users


@pytest.mark.parametrize("name", ["diamond_join", "anti_join", "anti_multi_rel"])
def test_pairs_that_keys_tell_apart_are_not_compared(spark, name):
    plan = catalogue.run(name, spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    pairs = plan.split("Join", 1)[0]  # what is done to pairs once they are made
    assert "Aggregate" not in pairs and "LeftAnti" not in plan


def test_parallel_loops_and_edges_without_keys_stay_distinct(spark):
    from lodegraph import EdgeTable, Graph, Node, NodeTable

    ids = spark.range(3)
    edges = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (0, 1), (2, 1)], "a bigint, b bigint")
    g = Graph.from_tables([NodeTable("x", ids, "id")], [EdgeTable("to", edges, ("x", "a"), ("x", "b"))], related=True)
    x, y, z = Node("x"), Node("x"), Node("x")
    assert [r.x for r in g.select(x.id).where(x.to == x).to_df("x").collect()] == [0]
    assert sorted(map(tuple, g.select(x.id, z.id).where(x.to == y, z.to == y).to_df("x", "z").collect())) == [(0, 0), (0, 2), (2, 0), (2, 2)]
