import numpy as np
import pytest

from nearfield.operators import experiment as X
from nearfield.operators.embed import entropy_weights


@pytest.fixture(scope="module")
def blobs(spark):
    x = np.concatenate([rng.normal(size=(20, 4)) + 12 * k for k, rng in ((k, np.random.default_rng(k)) for k in range(3))])
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")


@pytest.mark.parametrize("most", [6144, 10])
def test_a_grid_is_run_and_scored(blobs, most):
    runs = X.grid(blobs, (5, 9), repetitions=2, iterations=250, most=most)
    held = {(r.method, r.perplexity, r["sample"]): r["count"] for r in runs.groupBy("method", "perplexity", "sample").count().collect()}
    want = {(m, p, s) for m in ("random", "pca") for p in (5.0, 9.0) for s in (1, 2)}
    if most > 60:
        want |= {("coarse_to_fine", 5.0, 1), ("coarse_to_fine", 9.0, 1), ("multi_scale", None, 1)}
    assert held == dict.fromkeys(want, 60)
    curves, areas = X.compare(blobs, runs)
    areas = {r.method: r for r in areas.collect()}
    assert set(areas) == {m if p is None else f"{m}/{p:.0f}" for m, p, _ in want}
    assert areas["random/5"].samples == 2 and all(r.r_auc > 0.3 for r in areas.values())
    rows = curves.where("method = 'pca/9'").collect()
    assert {r.K for r in rows} == set(range(1, 60)) and all(r["mean"] is None or r.least <= r["mean"] <= r.largest for r in rows)


def test_weights_have_the_entropy_that_is_asked_for():
    rng = np.random.default_rng(3)
    h = rng.exponential(size=(50, 30)) * 10.0 ** rng.integers(-6, 6, (50, 1))
    h[::5, 12:] = np.inf  # fewer neighbours
    h[1::5, :3] = 0  # copies
    p = entropy_weights(h, 8)
    assert p.sum(1) == pytest.approx(np.ones(50)) and (p[np.isinf(h)] == 0).all()
    entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
    assert entropy == pytest.approx(np.full(50, np.log(8)), abs=1e-4)
    few = entropy_weights(h[:, :4], 8)  # all that four neighbours can have
    assert few == pytest.approx(np.full(few.shape, 0.25), abs=1e-2)
