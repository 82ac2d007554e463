"""Held-out pairs and what rankings find of them, against plain Python."""

import math

import pytest

from lodegraph.operators.evaluation import quality, split


def test_split_holds_out_a_share_of_each_user(spark):
    pairs = [(u, i) for u in range(12) for i in range(u)] + [(3, 0)]
    rows = split(spark.createDataFrame(pairs, "u int, i int"), "u", "i").collect()
    assert len(rows) == len(set(pairs))
    for u in range(1, 12):
        assert sum(r.held for r in rows if r.u == u) == (round(u * 0.2) if u > 1 else 0)
    again = split(spark.createDataFrame(pairs[::-1], "u int, i int"), "u", "i").collect()
    assert sorted(rows) == sorted(again)


def test_quality_equals_its_definition(spark):
    ranked = {1: [5, 6, 7], 2: [1], 4: [9, 8]}
    held = {1: {6, 7, 20}, 2: {3}, 3: {1}}
    k, want = 2, {"precision": 0.0, "recall": 0.0, "hit_rate": 0.0, "ndcg": 0.0}
    for user, relevant in held.items():
        top = ranked.get(user, [])[:k]
        hits = relevant & set(top)
        gain = sum(1 / math.log2(at + 2) for at, i in enumerate(top) if i in relevant)
        ideal = sum(1 / math.log2(at + 2) for at in range(min(k, len(relevant))))
        for name, value in (("precision", len(hits) / len(top) if top else 0), ("recall", len(hits) / len(relevant)), ("hit_rate", bool(hits)), ("ndcg", gain / ideal)):
            want[name] += value / len(held)
    given = spark.createDataFrame([(u, i, n + 1) for u, items in ranked.items() for n, i in enumerate(items)], "u int, i int, rank int")
    (row,) = quality(given, spark.createDataFrame([(u, i) for u, items in held.items() for i in items], "u int, i int"), "u", "i", k).collect()
    assert row.users == 3 and {n: row[n] for n in want} == pytest.approx(want)
