"""Effects by assay against a dense fit, shrinkage, unseen assays, and many assays."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boundlab.operators import effects

INF = float("inf")
ERFC = np.vectorize(math.erfc)


def planted(rng, sizes, effect, spread, slopes=(0.8, -0.5)):
    """Rows of assays with given sizes and effects; a fifth each is cut above, below and to an interval."""
    rows = []
    for a, n in enumerate(sizes):
        x = rng.normal(size=(n, len(slopes)))
        y = 6 + x @ np.array(slopes) + effect[a] + rng.normal(size=n) * 0.4 * math.exp(spread[a])
        for (x1, x2), v in zip(x, y, strict=True):
            kind = rng.integers(5)
            low, high = {0: (v - 0.3, INF), 1: (-INF, v + 0.3), 2: (v - 0.2, v + 0.1)}.get(kind, (v, v))
            rows.append(("e", f"a{a}", float(low), float(high), bool(kind > 2), float(x1), float(x2)))
    return pd.DataFrame(rows, columns=["endpoint", "assay_id", "lower", "upper", "exact_mask", "x1", "x2"])


def dense_loss(theta, x, low, high, exact, code, n_assays, tau_b, tau_r, ridge):
    """The penalised objective with every effect in one vector, by the error function."""
    p = x.shape[1]
    w, v, b, r = np.split(theta, [p, 2 * p, 2 * p + n_assays])
    mu, log_s = x @ w + b[code], np.clip(x @ v + r[code], -4, 3)
    s = np.exp(log_s)
    z = np.where(exact, np.where(exact, high, 0) - mu, 0) / s
    upper = lambda t: 0.5 * ERFC(t / math.sqrt(2))
    zl, zu = (low - mu) / s, (high - mu) / s
    q = np.where(np.isinf(high), upper(np.where(np.isinf(zl), 0, zl)), np.where(np.isinf(low), upper(-np.where(np.isinf(zu), 0, zu)), np.where(zl > 0, upper(zl) - upper(zu), upper(-zu) - upper(-zl))))
    nll = np.where(exact, z * z / 2 + log_s + 0.5 * math.log(2 * math.pi), -np.log(np.maximum(np.where(exact, 1, q), 1e-300)))
    return nll.sum() + (b @ b / tau_b**2 + r @ r / tau_r**2) / 2 + ridge / 2 * (w[1:] @ w[1:] + v[1:] @ v[1:])


def dense_fit(theta, f, steps=400):
    """BFGS with slopes by central differences."""
    n, h = len(theta), None
    slope = lambda t: np.array([(f(t + d) - f(t - d)) / 2e-5 for d in np.eye(n) * 1e-5])
    h, g, here = np.eye(n) * 1e-3, slope(theta), f(theta)
    for _ in range(steps):
        way, t = -h @ g, 1.0
        while f(theta + t * way) > here + 1e-4 * t * (g @ way) and t > 1e-8:
            t /= 2
        new = theta + t * way
        g2 = slope(new)
        s, y = new - theta, g2 - g
        if s @ y > 1e-12:
            left = np.eye(n) - np.outer(s, y) / (s @ y)
            h = left @ h @ left.T + np.outer(s, s) / (s @ y)
        theta, g, here = new, g2, f(new)
        if np.abs(g).max() < 1e-3:
            break
    return theta, here


def test_equal_to_a_dense_fit_on_twenty_assays(spark):
    rng = np.random.default_rng(3)
    sizes = [3, 4, 5, 6, 8] * 2 + [12] * 5 + [25] * 5
    pdf = planted(rng, sizes, rng.normal(0, 0.6, 20), rng.normal(0, 0.3, 20))
    made = effects.fit_effects(spark.createDataFrame(pdf), ["x1", "x2"], tau_b=0.7, tau_r=0.4, tolerance=1e-7, steps=30)
    cell = made.cells["e"]
    assert cell["converged"] and cell["error"] is None and cell["n"] == len(pdf)
    code, names = pd.factorize(pdf.assay_id)
    x = np.c_[np.ones(len(pdf)), pdf[["x1", "x2"]]]
    f = lambda t: dense_loss(t, x, pdf.lower.to_numpy(), pdf.upper.to_numpy(), pdf.exact_mask.to_numpy(), code, 20, 0.7, 0.4, 1e-6)
    theta, least = dense_fit(np.r_[6.0, np.zeros(5), np.zeros(40)], f)
    found = made.effects.toPandas().set_index("assay").loc[names]
    mine = np.r_[cell["w"], cell["v"], found.b, found.r]
    assert abs(f(mine) - cell["loss"]) < 1e-6 and abs(cell["loss"] - least) < 2e-3
    assert np.abs(mine - theta).max() < 0.03
    assert (found.n.to_numpy() == np.array(sizes)).all()


def test_rare_assays_are_drawn_more_towards_zero(spark):
    rng = np.random.default_rng(5)
    sizes = [2] * 60 + [80] * 10
    sign = np.where(np.arange(70) % 2 == 0, 1.0, -1.0)
    pdf = planted(rng, sizes, sign, np.zeros(70))
    loose, tight = (effects.fit_effects(spark.createDataFrame(pdf), ["x1", "x2"], tau_b=t, tau_r=0.3, steps=8, tolerance=1e-3).effects.toPandas().set_index("assay") for t in (1.0, 0.2))
    part = lambda e, ids: np.mean([e.b[f"a{i}"] * sign[i] for i in ids])
    for e in (loose, tight):
        assert part(e, range(60)) < part(e, range(60, 70)) <= 1.1
    assert part(tight, range(60)) < 0.6 * part(loose, range(60)) and part(tight, range(60, 70)) > 0.8
    none = effects.fit_effects(spark.createDataFrame(pdf), ["x1", "x2"], tau_b=0.0, tau_r=0.0, steps=3).effects
    assert none.agg(F.max(F.abs("b") + F.abs("r"))).first()[0] == 0.0


def test_unseen_assays_and_assay_features(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(size=120)
    pdf = planted(rng, [15] * 120, 0.9 * z + rng.normal(0, 0.15, 120), np.zeros(120))
    assays = spark.createDataFrame(pd.DataFrame({"assay_id": [f"a{i}" for i in range(120)], "z": z}))
    rows = effects.with_assay_features(spark.createDataFrame(pdf), assays, ["z"])
    seen = F.substring("assay_id", 2, 9).cast("int") < 80
    error = {}
    for name, features in (("plain", ["x1", "x2"]), ("amortised", ["x1", "x2", "z"])):
        made = effects.fit_effects(rows.where(seen), features, tau_b=0.5, tau_r=0.3, steps=8, tolerance=1e-3)
        test = effects.predicted(rows.where(~seen & F.col("exact_mask")), made)
        assert test.where("known").count() == 0
        error[name] = test.agg(F.avg(F.abs(F.col("mu") - F.col("lower")))).first()[0]
        assert effects.predicted(rows.where(seen), made).where("not known").count() == 0
    assert error["amortised"] < 0.55 * error["plain"]


def test_cells_without_rows_to_train_on(spark):
    rows = spark.createDataFrame([("a", "1", 1.0, INF, False, 0.0), ("a", None, -INF, 2.0, False, 1.0), ("b", None, 1.0, 1.0, True, 0.5), ("b", "2", 2.0, 2.0, True, 0.1), ("b", "2", 3.0, 3.0, True, 0.2), (None, "2", 3.0, 3.0, True, 0.2)], "endpoint string, assay_id string, lower double, upper double, exact_mask boolean, x1 double")
    made = effects.fit_effects(rows, ["x1"], constant_scale=True, steps=4)
    assert made.cells["a"]["error"] == "no exact rows to train on" and made.cells["b"]["error"] is None and set(made.cells) == {"a", "b"}
    assert (made.cells["b"]["v"][1:] == 0).all()
    out = {(r["endpoint"], r["assay_id"], r["known"]) for r in effects.predicted(rows, made).collect()}
    assert out == {("b", None, False), ("b", "2", True)}
    empty = effects.fit_effects(rows.limit(0), ["x1"])
    assert empty.cells == {} and empty.effects.count() == 0


@pytest.mark.parametrize("n", [100_000])
def test_many_assays_stay_in_spark(spark, n):
    """Effects of 100,000 assays, from three rows each, never come to the driver."""
    rows = spark.range(3 * n).select(
        F.lit("e").alias("endpoint"), F.concat(F.lit("a"), F.col("id") % n).alias("assay_id"), (F.randn(1)).alias("x1"), F.randn(2).alias("noise"), (F.hash("id") % 2 == 0).alias("cut"),
        F.when(F.pmod(F.hash(F.col("id") % n), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("b"),
    )
    y = F.lit(5.0) + F.col("x1") + F.col("b") + 0.5 * F.col("noise")
    rows = rows.withColumns({"upper": F.when(F.col("cut"), INF).otherwise(y), "lower": F.when(F.col("cut"), y - 0.2).otherwise(y), "exact_mask": ~F.col("cut")})
    made = effects.fit_effects(rows, ["x1"], tau_b=1.0, tau_r=0.2, steps=7, tolerance=1e-3)
    assert made.effects.count() == n and abs(made.cells["e"]["w"][1] - 1) < 0.05
    truth = made.effects.withColumn("t", F.when(F.pmod(F.hash(F.substring("assay", 2, 9).cast("long")), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    assert truth.agg(F.corr("b", "t")).first()[0] > 0.85


def test_lines_of_equal_rows_give_the_fit_of_the_rows(spark, monkeypatch):
    """Equal features within an assay make a line of many rows; features that differ by next to nothing keep rows apart and give the same fit."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        x, kind = float(rng.integers(0, 3)), rng.integers(0, 4)
        y = 5 + x / 2 + (i % 5) / 4 + float(rng.normal(0, 0.4))
        low, high = (y, y) if kind < 2 else (5.5, math.inf) if kind == 2 else (y - 0.2, y + 0.2)
        rows.append(("e", f"a{i % 5}", low, high, bool(kind < 2), x, x + i * 1e-12))
    df = spark.createDataFrame(rows, "endpoint string, assay_id string, lower double, upper double, exact_mask boolean, x double, apart double")
    written, keep = [], effects.kept
    monkeypatch.setattr(effects, "kept", lambda d: written.append(keep(d)) or written[-1])
    one, other = effects.fit_effects(df, ["x"], tau_b=0.5, tau_r=0.3), effects.fit_effects(df, ["apart"], tau_b=0.5, tau_r=0.3)
    assert written[0].count() < 200 < written[1].count() <= 300
    a, b = one.cells["e"], other.cells["e"]
    assert a["n"] == b["n"] == 300 and a["loss"] == pytest.approx(b["loss"], rel=1e-7)
    assert np.r_[a["w"], a["v"]] == pytest.approx(np.r_[b["w"], b["v"]], abs=1e-5)
    assert [r["n"] for r in one.effects.collect()] == [60] * 5
