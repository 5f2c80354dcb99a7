"""Boosted trees: splits against an exhaustive search, early stopping, missing features, and the linear arm on a step."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boundlab.operators import boosting, fitting

INF = float("inf")


def table(n, seed, y, cut=True):
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(0, 1, (n, 3)), 2)
    x[rng.random(n) < 0.1, 2] = np.nan
    v = y(x) + rng.normal(0, 0.15, n)
    kind = rng.integers(0, 6, n) if cut else np.full(n, 9)
    low = np.where(kind == 0, -INF, np.where(kind == 2, v - 0.2, v))
    high = np.where(kind == 1, INF, np.where(kind == 2, v + 0.2, v))
    return pd.DataFrame({"row_id": [f"r{i}" for i in range(n)], "endpoint": "e", "lower": low, "upper": high, "exact_mask": kind > 2, "value_p": np.where(kind > 2, v, np.nan), "x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 2]})


def slopes(low, high, margin, scale):
    """Slope and curvature of the loss of one label, by differences of its logarithm."""

    def loss(m):
        if low == high:
            return ((low - m) / scale) ** 2 / 2
        phi = lambda t: 0.5 * math.erfc(-t / math.sqrt(2))
        a, b = (low - m) / scale, (high - m) / scale if high < INF else INF
        return -math.log(phi(-a) - phi(-b) if a > 0 else (1.0 if b == INF else phi(b)) - phi(a))

    e = 1e-4
    return (loss(margin + e) - loss(margin - e)) / (2 * e), (loss(margin + e) - 2 * loss(margin) + loss(margin - e)) / e**2


def searched(x, g, h, rows, penalty, least):
    """The best gain over every feature, every cut between different values and both ways of missing."""
    best = 0.0
    score = lambda i: g[i].sum() ** 2 / (h[i].sum() + penalty)
    for f in range(x.shape[1]):
        gone = np.isnan(x[rows, f])
        for cut in np.unique(x[rows, f][~gone])[:-1]:
            for way in (True, False):
                goes = np.where(gone, way, x[rows, f] <= cut)
                left, right = rows[goes], rows[~goes]
                if len(left) and len(right) and h[left].sum() >= least and h[right].sum() >= least:
                    best = max(best, score(left) + score(right) - score(rows))
    return best


def test_splits_equal_an_exhaustive_search(spark):
    pdf = table(150, 1, lambda x: 5 + (x[:, 0] > 0.4) + 0.5 * (np.nan_to_num(x[:, 2], nan=1.0) > 0.7) * (x[:, 1] > 0.5))
    o = {"rounds": 2, "depth": 2, "bins": 256, "rate": 0.5, "scale": 0.8, "penalty": 1.0, "least_weight": 2.0, "subsample": 1.0, "columns": 1.0}
    features = ["x1", "x2", "x3"]
    model = boosting.fit_boosted(spark.createDataFrame(pdf), features, **o)
    c = model.cells["e"]
    assert len(c["trees"]) == 2 and c["best"] == 2 and c["error"] is None
    low = np.where(np.isinf(pdf.upper), math.log(1e-6), (9 - pdf.upper) * math.log(10))
    high = np.where(np.isinf(pdf.lower), INF, (9 - pdf.lower) * math.log(10))
    x = pdf[features].to_numpy()
    margin = np.full(len(pdf), c["base"])
    cells = boosting.binned(x, c["edges"], 256)
    assert abs(c["base"] - low[low == high].mean()) < 1e-9
    for tree in c["trees"]:
        g, h = np.array([slopes(a, b, m, 0.8) for a, b, m in zip(low, high, margin, strict=True)]).T
        at = {0: np.arange(len(pdf))}
        splits = 0
        for node in range(len(tree.feature)):
            rows = at[node]
            if tree.feature[node] >= 0:
                b = cells[rows, tree.feature[node]]
                left = np.where(b == 256, tree.missing_left[node], b <= tree.bin[node])
                at[tree.left[node]], at[tree.right[node]] = rows[left], rows[~left]
                gain = sum(g[r].sum() ** 2 / (h[r].sum() + 1) * s for r, s in ((rows[left], 1), (rows[~left], 1), (rows, -1)))
                assert gain == pytest.approx(searched(x, g, h, rows, 1.0, 2.0), rel=1e-3)
                splits += 1
            else:
                assert tree.value[node] == pytest.approx(-0.5 * g[rows].sum() / (h[rows].sum() + 1), rel=1e-3, abs=1e-4)
        assert splits == 3
        margin = margin + tree.values(cells, 256)
    assert np.allclose(model.margins("e", x), margin)
    got = boosting.predicted(spark.createDataFrame(pdf), model).toPandas().set_index("row_id").loc[pdf.row_id]
    assert np.allclose(got.mu, 9 - margin / math.log(10)) and np.allclose(got.sigma, 0.8 / math.log(10))


def test_stops_early_and_calibrates(spark):
    pdf = table(400, 2, lambda x: 5 + (x[:, 0] > 0.5))
    noise = pdf.assign(endpoint="n", lower=np.random.default_rng(1).normal(5, 1, 400))
    noise = noise.assign(upper=noise.lower, exact_mask=True, value_p=noise.lower)
    lone = pdf[:3].assign(endpoint="v")
    rows = spark.createDataFrame(pd.concat([pdf, noise, lone]))
    valid = (F.xxhash64("row_id") % 3 == 0) | (F.col("endpoint") == "v")
    model = boosting.fit_boosted(rows, ["x1", "x2", "x3"], valid=valid, rounds=24, patience=4, depth=2, bins=16, rate=0.3, scale=0.5, columns=1.0)
    e, n = model.cells["e"], model.cells["n"]
    assert "v" not in model.cells  # no rows to train on
    assert n["best"] < 15 and len(n["trees"]) == n["best"] + 4
    for c in (e, n):
        held = [x[1] for x in c["history"]]
        assert held[c["best"]] == min(held) and c["history"][-1][0] < c["history"][0][0]
    assert e["best"] > n["best"]
    boosting.fit_scale(model, rows.where(valid))
    assert 0.1 < e["sigma"] < 0.35 < n["sigma"] < 1.3
    made = boosting.predicted(rows.where(~valid), model)
    assert made.where("endpoint = 'e'").agg(F.avg(F.abs(F.col("mu") - F.col("value_p")))).first()[0] < 0.25


def test_better_than_the_linear_arm_on_a_step(spark):
    pdf = table(900, 3, lambda x: 5 + 2.0 * ((x[:, 0] > 0.3) & (x[:, 0] < 0.7)) - 1.5 * (x[:, 1] > 0.6))
    rows = spark.createDataFrame(pdf.assign(fold=np.arange(900) % 3)).fillna(0.0, ["x3"])
    train, test = rows.where("fold <> 0"), rows.where("fold = 0 and exact_mask")
    model = boosting.fit_boosted(train, ["x1", "x2", "x3"], rounds=30, depth=3, bins=32, rate=0.3, scale=0.5)
    line = fitting.fit_cells(rows, ["x1", "x2", "x3"], [{"endpoint": "e", "fold": 0, "treatment": "aft_conc"}])
    error = lambda df: df.agg(F.avg(F.abs(F.col("mu") - F.col("value_p")))).first()[0]
    boosted, linear = error(boosting.predicted(test, model)), error(fitting.apply_cells(test, ["x1", "x2", "x3"], line))
    assert boosted < 0.3 and boosted < 0.5 * linear


def test_a_round_reads_runs_of_equal_bins_as_one(monkeypatch):
    """Sums of a round by bins against those of every row; trees are asked once a run, whatever the number of its rows."""
    rng, n, o = np.random.default_rng(4), 4000, boosting.DEFAULTS | {"bins": 8, "scale": 0.7, "subsample": 0.6}
    low = rng.normal(5, 9, n)
    pdf = pd.DataFrame({"c": rng.integers(0, 3, n), "h": rng.integers(-(2**62), 2**62, n), "valid": rng.random(n) < 0.2, "low": low, "high": np.where(rng.random(n) < 0.3, INF, np.where(rng.random(n) < 0.3, low + 1, low)), "margin": 0.0, "b0": rng.integers(0, 3, n), "b1": rng.integers(0, 2, n), "b2": rng.integers(0, 2, n)})
    pdf["margin"] = pdf.c + 0.5 * pdf.b0
    pdf = pdf.sort_values(["c", "b0", "b1", "b2"])
    tree = boosting.Tree()
    tree.split(0, 1, 0, True, (-0.25, 0.75))
    asked_rows, plain = [], boosting.Tree.values
    monkeypatch.setattr(boosting.Tree, "values", lambda self, x, missing: (asked_rows.append(len(x)), plain(self, x, missing))[1])
    run, shape, used = boosting._round_sums(3, {0: [tree], 2: []}, [0, 2], 5, o)
    got = pd.concat(run(iter([pdf[:2500], pdf[2500:]])))
    assert sum(asked_rows) <= 13 and used == ["b0", "b2"] and shape.startswith("c int, kind int, b0 int, b2 int")
    pdf = pdf[pdf.c != 1]
    margin = pdf.margin + np.where(pdf.c == 0, np.where(pdf.b1 <= 0, -0.25, 0.75), 0)
    loss, g, h, _, _ = boosting.terms(pdf.low.to_numpy(), pdf.high.to_numpy(), (pdf.low == pdf.high).to_numpy(), margin.to_numpy(), np.full(len(pdf), math.log(0.7)))
    drawn = ~pdf.valid & boosting._drawn(pdf.h.to_numpy(), 5, 0, 0.6)
    each = pdf.assign(g=np.clip(g, -15, 15), h=np.clip(h, 1e-16, 15), loss=loss)
    want = each[drawn].groupby(["c", "b0", "b2"])[["g", "h"]].sum()
    sums = got[got.kind == 0].groupby(["c", "b0", "b2"])[["g", "h"]].sum()
    assert want.index.equals(sums.index) and np.allclose(want, sums)
    for kind, valid in ((1, False), (2, True)):
        want = each[pdf.valid == valid].groupby("c").loss.agg(["sum", "count"])
        assert np.allclose(want, got[got.kind == kind].groupby("c")[["g", "h"]].sum())


def test_nothing_to_fit(spark):
    rows = spark.createDataFrame(table(5, 1, lambda x: x[:, 0])).limit(0)
    model = boosting.fit_boosted(rows, ["x1"], rounds=3)
    assert model.cells == {} and boosting.predicted(rows, model).count() == 0
