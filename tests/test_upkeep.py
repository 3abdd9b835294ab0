"""Paths kept up after links, and repulsion by cells, against what is worked out anew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import distance, graph, quadtree, upkeep


def paths_of(df):
    return {(r.j, r.i): (round(r.d, 9), r.hops, r.pred) for r in df.collect()}


def test_paths_after_links_equal_those_made_anew(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 40, 60), rng.integers(0, 40, 60), rng.random(60), strict=True) if a != b]
    links = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 44, 9), rng.integers(0, 44, 9), rng.random(9) / 4, strict=True) if a != b] + [(3, 3, 0.1), rows[0][:2] + (0.001,)]
    spec = "j long, i long, d double"
    edges, more = spark.createDataFrame(rows, spec), spark.createDataFrame(links, spec)
    before = graph.shortest_paths(edges)
    got, touched = upkeep.with_links(before, more)
    want, old = paths_of(graph.shortest_paths(edges.unionByName(more.where("j <> i")))), paths_of(before)
    assert paths_of(got) == want
    changed = sum(old.get(k) != v for k, v in want.items())
    assert changed <= touched < 2 * changed + 1 and touched < len(want)
    same, none = upkeep.with_links(before, more.limit(0))
    assert paths_of(same) == old and none == 0


def test_merging_keeps_the_table_up(spark):
    x = np.random.default_rng(5).normal(size=(45, 2)) * 0.2 + np.repeat(np.arange(5), 9)[:, None] * [3.0, 1.0]
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    first = distance.undirected(distance.knn_graph(p, 2))
    edges, paths, touched = upkeep.connected_paths(p, first)
    got, want = paths_of(paths), paths_of(graph.shortest_paths(edges))
    assert len(got) == 45 * 44 and {k: v[0] for k, v in got.items()} == pytest.approx({k: v[0] for k, v in want.items()})
    assert touched > 0


def exact(y):
    d = y[:, None] - y[None]
    w = 1 / (1 + (d**2).sum(2))
    np.fill_diagonal(w, 0)
    return w.sum(1), (w[:, :, None] ** 2 * d).sum(1)


@pytest.mark.parametrize("kind", ["round", "groups", "copies", "narrow"])
def test_forces_of_cells_are_near_the_exact_ones(spark, kind):
    rng = np.random.default_rng(7)
    y = {
        "round": rng.normal(size=(700, 2)) * 12, "groups": rng.normal(size=(600, 2)) * 0.3 + rng.integers(-3, 4, (600, 2)) * 9, "copies": np.concatenate([np.tile([[1.0, 2.0]], (200, 1)), rng.normal(size=(200, 2)) * 5]),
        "narrow": rng.normal(size=(150, 2)) * 1e-3,
    }[kind]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id long, y array<double>").repartition(3)
    got = quadtree.repulsion(df).orderBy("id").collect()
    z, f = exact(y)
    assert [r.id for r in got] == list(range(len(y)))
    assert np.abs(np.array([r.z for r in got]) / z - 1).max() < 1e-3
    assert np.linalg.norm(np.array([r.f for r in got]) - f, axis=1).max() < 0.01 * np.linalg.norm(f, axis=1).mean() + 1e-9


def test_one_point_and_none(spark):
    spec = "id long, y array<double>"
    one = quadtree.repulsion(spark.createDataFrame([(5, [1.0, 2.0])], spec)).collect()
    assert [(r.id, r.z, list(r.f)) for r in one] == [(5, 0.0, [0.0, 0.0])]
    assert quadtree.repulsion(spark.createDataFrame([], spec)).collect() == []


def test_steps_go_down_the_gradient(spark):
    rng = np.random.default_rng(11)
    y = rng.normal(size=(60, 2)) * 3
    m = np.triu(rng.random((60, 60)) * (rng.random((60, 60)) < 0.2), 1)
    m = (m + m.T) / (m + m.T).sum()
    j, i = np.nonzero(m)
    p = spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(j, i, strict=True)], "j long, i long, p double")
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(y)], "id long, y array<double>")

    def slope(y):
        z, f = exact(y)
        d = y[:, None] - y[None]
        w = 1 / (1 + (d**2).sum(2))
        return 4 * (((m * w)[:, :, None] * d).sum(1) - f / z.sum())

    want = slope(y)
    got = np.array([r.g for r in quadtree.tsne_gradient(df, p).orderBy("id").collect()])
    assert np.linalg.norm(got - want, axis=1).max() < 0.01 * np.linalg.norm(want, axis=1).mean()
    v = -30 * want
    after = y + v
    v = 0.5 * v - 30 * slope(after)
    got = np.array([r.y for r in quadtree.tsne_steps(df, p, 2, 30.0).orderBy("id").collect()])
    assert np.abs(got - (after + v)).max() < 0.01 * np.abs(v).max()
