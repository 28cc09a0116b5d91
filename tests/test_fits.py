"""Quantiles, k-means, the margin classifier and its calibration against plain versions on the driver."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.sql import functions as F

from prioscope.operators import clustering, kmeans, margin, quantiles as quantile_steps
from prioscope.operators.features import stratified_folds
from prioscope.operators.quantiles import quantiles


def expected(values, share):
    numbers = sorted(v for v in values if v is not None and not math.isnan(v))
    return float(np.percentile(numbers, 100 * share)) if numbers else None


@pytest.mark.parametrize("sketch,most", [(4096, 200_000), (64, 40), (200, 5)])
def test_quantiles_of_several_columns(spark, sketch, most):
    draw = np.random.default_rng(1)
    ties = [float(v) for v in draw.choice([1.0, 2.0, 2.0, 2.0, 7.0], 3000)]
    wide = [float(v) for v in draw.lognormal(0, 5, 3000)]
    holes = [None if i % 3 == 0 else float("nan") if i % 3 == 1 else float(i) for i in range(3000)]
    df = spark.createDataFrame(list(zip(ties, wide, holes, [None] * 3000)), "a double, b double, c double, d double").repartition(4)
    shares = (0.0, 0.2, 0.25, 0.5, 0.75, 0.999, 1.0)
    wanted = {f"{c}{s}": (c, s) for c in "abcd" for s in shares} | {"x": (F.col("a") * 2, 0.5)}
    got = quantiles(df, wanted, sketch, most)
    for name, values in (("a", ties), ("b", wide), ("c", holes), ("d", [])):
        for share in shares:
            assert got[f"{name}{share}"] == (pytest.approx(expected(values, share), rel=1e-13) if values else None)
    assert got["x"] == 2 * expected(ties, 0.5)


def test_quantiles_need_two_scans(spark, monkeypatch):
    """One aggregation for the sketch, one for the counts, and none to look closer."""
    calls = []
    for name in ("_sketched", "_settled", "_narrowed"):
        step = getattr(quantile_steps, name)
        monkeypatch.setattr(quantile_steps, name, lambda *a, name=name, step=step: calls.append(name) or step(*a))
    df = spark.range(100_000).selectExpr("cast(id * 7919 % 100003 as double) AS v")
    got = quantiles(df, {"p25": ("v", 0.25), "p75": ("v", 0.75)})
    values = [i * 7919 % 100003 for i in range(100_000)]
    assert got == {"p25": expected(values, 0.25), "p75": expected(values, 0.75)}
    assert calls == ["_sketched", "_settled"]


def blobs(n, seed=2, dims=3, groups=5):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, dims)) * 4
    return centres[draw.integers(groups, size=n)] + draw.normal(size=(n, dims))


def lloyd(points, centres):
    while True:
        home = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([points[home == j].mean(axis=0) if (home == j).any() else centres[j] for j in range(len(centres))])
        if np.allclose(moved, centres, atol=1e-12):
            return ((points - centres[home]) ** 2).sum()
        centres = moved


def test_restarts_side_by_side_equal_single_ones(spark):
    points = blobs(700)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points.tolist())] + [(-1, None)], "i int, vector array<double>").repartition(3)
    seeds = list(range(42, 47))
    together = kmeans.fit_kmeans(df, "vector", 4, seeds, 300, 0.0)
    for seed, cost in zip(seeds, together.costs):
        alone = kmeans.fit_kmeans(df, "vector", 4, [seed], 300, 0.0)
        assert alone.cost == pytest.approx(cost, rel=1e-6)
    assert together.cost == min(together.costs)
    # A fixed point of plain Lloyd steps.
    assert lloyd(points, together.centres) == pytest.approx(together.cost, rel=1e-9)
    got = {r.i: r.c for r in df.select("i", together.nearest(F.col("vector")).alias("c")).collect()}
    assert got.pop(-1) is None
    assert [got[i] for i in range(700)] == ((points[:, None] - together.centres) ** 2).sum(axis=2).argmin(axis=1).tolist()


def test_clusters_of_few_points(spark):
    df = spark.createDataFrame([([1.0, 2.0],)] * 5 + [([3.0, 4.0],)], "v array<double>")
    found = clustering.fit_clusters(df, "v", seeds=[1, 2])
    assert found.cost == pytest.approx(0.0) and found.centres.shape == (4, 2)
    assert clustering.fit_clusters(df.limit(0), "v").cost == 0.0
    with pytest.raises(Exception):
        clustering.fit_clusters(df.union(spark.createDataFrame([([1.0],)], "v array<double>")), "v")


def test_empty_clusters_move_to_far_points(spark):
    points = np.array([[0.0], [0.1], [0.2], [9.0], [20.0]])
    df = spark.createDataFrame([(p,) for p in points.tolist()], "v array<double>")
    blocks, dims, _ = kmeans._packed(df, "v")
    centres = np.array([[[0.1], [500.0], [600.0]]])
    counts, sums, _ = kmeans._pass(blocks, centres, dims)
    moved = np.where(counts[..., None] > 0, sums / np.maximum(counts, 1)[..., None], centres)
    kmeans._repair(blocks, moved, counts, centres)
    assert sorted(moved[0, 1:, 0].tolist()) == [9.0, 20.0]


def loss_of(w, x, sign, cost):
    gap = np.maximum(1 - sign * (x @ w), 0)
    return 0.5 * w @ w + (cost * gap * gap).sum()


def newton_of(x, sign, cost):
    """Minimiser of the loss by Newton steps with the whole Hessian, halved until they help."""
    w = np.zeros(x.shape[1])
    for _ in range(200):
        active = sign * (x @ w) < 1
        gradient = w - 2 * (x[active] * (cost * sign * (1 - sign * (x @ w)))[active, None]).sum(axis=0)
        if np.linalg.norm(gradient) < 1e-10:
            break
        step = -np.linalg.solve(np.eye(len(w)) + 2 * (x[active] * cost[active, None]).T @ x[active], gradient)
        share = 1.0
        while loss_of(w + share * step, x, sign, cost) > loss_of(w, x, sign, cost) and share > 1e-12:
            share /= 2
        w = w + share * step
    return w


def test_margins_reach_the_minimum(spark):
    draw = np.random.default_rng(5)
    x = np.where(draw.random((300, 12)) < 0.3, draw.normal(size=(300, 12)) * 3, 0.0)
    label = (x[:, 0] - x[:, 1] + draw.normal(size=300) > 0).astype(int)
    weight = np.where(label == 1, 1.7, 0.6)
    vectors = [Vectors.dense(v) if i % 5 == 0 else SparseVector(12, [(j, e) for j, e in enumerate(v) if e]) for i, v in enumerate(x.tolist())]
    rows = [(f"T{i}", int(y), float(w), v) for i, (y, w, v) in enumerate(zip(label, weight, vectors))]
    df = stratified_folds(spark.createDataFrame(rows, ["ticket_id", "label", "weight", "features"]), 3).repartition(4)
    fold = {r.ticket_id: r.fold for r in df.collect()}
    for y in (0, 1):
        sizes = np.bincount([fold[f"T{i}"] for i in range(300) if label[i] == y], minlength=3)
        assert sizes.max() - sizes.min() <= 1
    weights = margin.fit_margins(df, 12, 3, 0.5, precision=1e-6)
    full, sign = np.hstack([x, np.ones((300, 1))]), np.where(label == 1, 1.0, -1.0)
    own = np.array([fold[f"T{i}"] for i in range(300)])
    for f in range(3):
        train = own != f
        exact = newton_of(full[train], sign[train], 0.5 * weight[train])
        best = loss_of(exact, full[train], sign[train], 0.5 * weight[train])
        assert loss_of(weights[f], full[train], sign[train], 0.5 * weight[train]) <= best * (1 + 1e-4)
        assert weights[f] == pytest.approx(exact, abs=1e-3)
    model = margin.MarginModel(weights, (-1.0, -2.0, -0.5), (0.0, 0.1, -0.1))
    got = {r.ticket_id: r for r in df.select("ticket_id", model.margins(F.col("features")).alias("m"),
                                             model.probability(F.col("features")).alias("p")).collect()}
    for i in range(300):
        plain = full[i] @ weights.T
        assert got[f"T{i}"].m == pytest.approx(plain.tolist(), abs=1e-9)
        assert got[f"T{i}"].p == pytest.approx(np.mean(1 / (1 + np.exp(np.array(model.slopes) * plain + np.array(model.offsets)))))


def sigmoid_of(margins, label, weight):
    """Calibration by many plain gradient steps of Newton's method in two variables."""
    n1, n0 = weight[label == 1].sum(), weight[label == 0].sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    at = np.array([0.0, math.log((n0 + 1) / (n1 + 1))])

    def loss(at):
        z = at[0] * margins + at[1]
        return (weight * (target * z + np.logaddexp(0, -z))).sum()

    for _ in range(300):
        p = 1 / (1 + np.exp(at[0] * margins + at[1]))
        both = np.stack([margins, np.ones_like(margins)])
        step = -np.linalg.solve((both * weight * p * (1 - p)) @ both.T + 1e-12 * np.eye(2), both @ (weight * (target - p)))
        share = 1.0
        while loss(at + share * step) > loss(at) and share > 1e-12:
            share /= 2
        at = at + share * step
    return at


def test_calibration(spark):
    draw = np.random.default_rng(8)
    rows = [(f, float(draw.normal() + (1.5 if y else -0.5)), int(y), 2.0 if y else 0.7) for f in range(2) for y in draw.random(200) < 0.3]
    slopes, offsets = margin.fit_sigmoids(spark.createDataFrame(rows, "fold int, margin double, label int, weight double"), 3)
    for f in range(2):
        m, y, w = (np.array([r[i] for r in rows if r[0] == f]) for i in (1, 2, 3))
        assert (slopes[f], offsets[f]) == pytest.approx(tuple(sigmoid_of(m, y, w)), abs=1e-6)
        assert slopes[f] < 0
    assert (slopes[2], offsets[2]) == (0.0, 0.0)
