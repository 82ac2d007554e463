"""Random patterns on a random graph against a matcher that tries every assignment."""

import itertools

import numpy as np
import pytest

from lodegraph import EdgeTable, Graph, Has, Node, NodeTable


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(12)
    edges = {r: [(int(a), int(b)) for a, b in rng.integers(0, 7, (14, 2))] for r in ("r", "q")}
    nodes = spark.createDataFrame([(i, int(rng.integers(0, 4))) for i in range(7)], "id bigint, x int")
    tables = [EdgeTable(r, spark.createDataFrame(e, "a bigint, b bigint"), ("n", "a"), ("n", "b")) for r, e in edges.items()]
    return Graph.from_tables([NodeTable("n", nodes, "id", ("x",))], tables), edges, {r.id: r.x for r in nodes.collect()}


@pytest.mark.parametrize("seed", range(8))
def test_against_all_assignments(world, seed):
    graph, edges, x = world
    rng = np.random.default_rng(seed)
    count = int(rng.integers(2, 5))
    nodes = [Node("n") for _ in range(count)]
    pairs = [(int(rng.integers(0, i)), i) for i in range(1, count)]  # connected
    pairs += [tuple(map(int, rng.integers(0, count, 2))) for _ in range(int(rng.integers(0, 3)))]  # and with cycles
    says = [(a, b, str(rng.choice(["r", "q"])), bool(rng.random() < 0.3)) for a, b in pairs]
    nots = [(0, count - 1, "q")] if rng.random() < 0.5 else []
    least, shown = int(rng.integers(0, 3)), sorted(rng.choice(count, int(rng.integers(1, count + 1)), replace=False).tolist())
    conditions = [Has(nodes[a], r, nodes[b], back) for a, b, r, back in says] + [~Has(nodes[a], r, nodes[b]) for a, b, r in nots] + [nodes[0].x >= least]
    got = {tuple(r) for r in graph.select(*(nodes[i].id for i in shown)).where(*conditions).to_df(ordered=False).collect()}
    want = set()
    for at in itertools.product(range(7), repeat=count):
        if x[at[0]] >= least and all(((at[b], at[a]) if back else (at[a], at[b])) in edges[r] for a, b, r, back in says) and not any((at[a], at[b]) in edges[r] for a, b, r in nots):
            want.add(tuple(at[i] for i in shown))
    assert got == want
