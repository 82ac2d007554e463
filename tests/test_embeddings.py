"""Translational models: gradients, plausibility, training, storage by name."""

import numpy as np
import pytest
from harbour import CREWS, FIRMS, PORTS, SAILORS, SHIPS, TRIPLES

import lodegraph
from lodegraph import Edge, Greedy, Has, Node, Path, Score
from lodegraph.operators.translational import TransD, TransE, corrupted, train
from lodegraph.sources.text import from_files

MODELS = [TransE, TransD]


@pytest.fixture(scope="module", params=MODELS)
def fitted(request, graph):
    return train(request.param(factors=6), graph, epochs=8, lr=0.05)


@pytest.mark.parametrize("kind", MODELS)
def test_gradients_are_those_of_finite_differences(kind):
    rng, model = np.random.default_rng(1), kind(factors=4)
    sides = [{t: rng.normal(size=(3, 4)) for t in model.tables[0]} for _ in range(3)]
    for side, grads in zip(sides, model.gradient(*sides), strict=True):
        for t, g in grads.items():
            for i in range(3):
                for j in range(4):
                    old, ends = side[t][i, j], []
                    for step in (1e-6, -1e-6):
                        side[t][i, j] = old + step
                        ends.append(model.plausibility(*sides)[i])
                    side[t][i, j] = old
                    assert g[i, j] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-5)


def test_training_learns_and_records_itself(graph):
    seen = []
    model = train(TransE(factors=8), graph, epochs=30, lr=0.05, report=lambda e, loss: seen.append(loss))
    assert seen[-1] < seen[0] and model.meta["graph_edges"] == len(TRIPLES) + len(CREWS) and model.meta["graph_nodes"] == len(SHIPS) + len(PORTS) + len(FIRMS) + len(SAILORS)
    with pytest.raises(ValueError, match="no edges"):
        train(TransE(factors=2), lodegraph.Graph(graph.spark, graph.types, [], graph.tables, {}))


@pytest.mark.parametrize("kind", MODELS)
def test_training_in_parts_learns_too(graph, kind):
    seen = []
    model = train(kind(factors=6), graph, epochs=8, lr=0.1, report=lambda e, loss: seen.append(loss), most_triples=3, part_triples=8)
    rows = {r.nid: r for r in model.nodes.collect()}
    assert len(rows) == model.meta["graph_nodes"] == graph.nodes().count() and model.meta["graph_edges"] == graph.edges().count()
    assert seen[-1] < seen[0] and set(model.rels) == set(graph.relations)
    assert all(len(r[t]) == 6 for r in rows.values() for t in model.tables[0]) and all(len(v[t]) == 6 for v in model.rels.values() for t in model.tables[1])
    ship = Node("ship")
    assert len(graph.select(ship, Score()).rank(model.seeded({"firm.Adria"}))) == len(SHIPS)


def test_negatives_stay_in_their_type():
    rng, kinds = np.random.default_rng(0), np.array([0, 0, 0, 1, 1])
    for _ in range(20):
        out = corrupted(rng, np.arange(5), kinds, np.array([0, 3]), np.array([3, 2]))
        assert (kinds[out] == kinds).all()


def test_scores_equal_numpy(graph, fitted):
    rows = {r.nid: r for r in fitted.nodes.collect()}
    seed, ship = graph.lookup("firm.Adria"), Node("ship")
    take = lambda n: {t: np.array([rows[n][t]]) for t in fitted.tables[0]}
    rel = {r: {t: np.array(v) for t, v in x.items()} for r, x in fitted.rels.items()}
    want = {n: float(fitted.plausibility(take(n), rel["run_by"], take(seed))[0]) for n in rows if graph.type_of(n) == "ship"}
    ranked = [k.nid for k in graph.select(ship).rank(fitted.seeded({"firm.Adria"}, relation="run_by", reverse=True))]
    assert ranked == sorted(want, key=lambda n: -want[n])
    every = {n: max(float(f[0]) for r in rel.values() for f in (fitted.plausibility(take(seed), r, take(n)), fitted.plausibility(take(n), r, take(seed)))) for n in want}
    got = dict(graph.select(ship, Score()).rank(fitted.seeded({"firm.Adria"})))
    low, high = min(every.values()), max(every.values())
    assert all(s == pytest.approx((every[k.nid] - low) / (high - low)) for k, s in got.items())
    assert {s for _, s in graph.select(ship, Score()).rank(fitted.seeded({"firm.Adria"}, relation="unknown"))} == {0.0}
    assert {s for _, s in graph.select(ship, Score()).rank(fitted.seeded(None))} == {0.0}


def test_paths_and_beams_use_the_model(graph, fitted):
    ship, firm, path, sailor = Node("ship"), Node("firm"), Path(), Node("sailor")
    rows = list(graph.select(ship, path, Score()).where(path == [ship, Edge("run_by"), firm]).rank(fitted))
    assert len(rows) == len(SHIPS) and rows[0][2] == 1.0
    assert len(graph.select(sailor, ship).where(Has(sailor, "has_interact", ship)).rank(fitted).using(Greedy(k=1))) == len(SAILORS)


def test_storage_rebinds_by_name(spark, folder, tmp_path, graph, fitted):
    path = fitted.save(str(tmp_path / "model"), graph, note="x")
    lines = (folder / "h.kg").read_text().strip().split("\n")
    (tmp_path / "r.kg").write_text("\n".join([*reversed(lines), "ship.s9\tnew_rel\tfirm.Adria"]) + "\n")
    (tmp_path / "r.ui").write_text("\n".join(reversed((folder / "h.ui").read_text().strip().split("\n"))) + "\n")
    other = from_files(spark, str(tmp_path / "r.kg"), str(tmp_path / "r.ui"))
    model = type(fitted).load(path, other, to={"firm.Adria"})
    assert model.missing_nodes == ["ship.s9"] and model.missing_relations == ["new_rel"] and model.meta["note"] == "x"
    old, new = {r.nid: r for r in fitted.nodes.collect()}, {r.nid: r for r in model.nodes.collect()}
    for key in ("ship.s1", "firm.Baltia", "sailor.3"):
        assert np.allclose(old[graph.lookup(key)].vec, new[other.lookup(key)].vec)
    assert set(new[other.lookup("ship.s9")].vec) == {0.0}
    named = lodegraph.load(path, other, to={"firm.Adria"})
    assert type(named) is type(fitted) and lodegraph.provenance(spark, path)["note"] == "x" and lodegraph.provenance(spark, path)["graph_edges"] == fitted.meta["graph_edges"]
    wrong = TransD if isinstance(fitted, TransE) else TransE
    with pytest.raises(ValueError, match="vectors of"):
        wrong.load(path, graph)
    with pytest.raises(ValueError, match="nothing to save"):
        TransE().save(str(tmp_path / "none"), graph)
