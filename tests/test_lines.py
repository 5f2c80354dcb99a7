"""Rows that are equal are worked on once: against the same work on single rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boundlab.operators import boosting, censoring, effects, fitting, metrics
from boundlab.plans import grid


def test_scores_of_lines_are_those_of_rows(spark):
    """Rows that occur up to five times, in three folds and with every kind of bound: a cell's scores are those of its rows, and each different row is scored once."""
    rng, rows = np.random.default_rng(3), []
    for i in range(300):
        x, y, kind = float(rng.integers(0, 4)), round(float(rng.normal(6, 1)), 2), i % 5
        low, high = ((y, y), (y, y), (-math.inf, y + 0.5), (y - 0.5, math.inf), (y - 0.2, y + 0.2))[kind]
        rows += [(f"{i}|{j}", "ab"[i % 2], i % 3, low, high, kind < 2, y if kind < 2 else None, x) for j in range(1 + i % 5)]
    data = spark.createDataFrame(rows, "row_id string, endpoint string, fold int, lower double, upper double, exact_mask boolean, value_p double, x double")
    cells = [{"endpoint": e, "fold": f, "treatment": t, "members": 2} for e in "ab" for f in range(3) for t in ("exact_only", "tobit", "aft_conc", "ensemble_satisficing", "no_such")]
    options = {"steps": 15, "local_rows": 0}
    found = {r["cell"]: r for r in grid.run_cells(data, ["x"], cells, **options)[0].collect()}
    fitted = fitting.fit_cells(data, ["x"], cells, **options)
    cut = metrics.fold_thresholds(data, [0, 1, 2])
    plain = metrics.score_row(fitting.apply_cells(data, ["x"], fitted).join(cut, ["endpoint", "fold"]), ["cell", "threshold"], F.col("threshold")).collect()
    assert len(plain) == 24 and len(found) == 30
    for r in plain:
        for name, value in r.asDict().items():
            assert found[r["cell"]][name] == (value if value is None else pytest.approx(value, rel=1e-9, abs=1e-12)), name
    lines = data.groupBy("endpoint", "fold", "lower", "upper", "exact_mask", "value_p", "x").count()
    made = fitting.cell_predictions(lines, ["x"], fitted)
    assert made.count() == 4 * lines.count() < 4 * len(rows)


def test_folds_of_effects_are_laid_out_once(spark):
    """Cells of held-out folds from one layout are those fitted one by one, for assays in many rows of the layout and for rows without an assay."""
    rng, rows = np.random.default_rng(8), []
    for i in range(1500):
        a, x = int(rng.integers(0, 4)) if i % 3 else 0, float(rng.normal())
        y, kind = 5 + 0.5 * x + 0.2 * a + float(rng.normal(0, 0.3)), i % 5
        low, high = ((y, y), (y, y), (-math.inf, y + 0.2), (y - 0.2, math.inf), (y - 0.2, y + 0.2))[kind]
        rows.append(("pq"[i % 2], i % 3 if i % 11 else None, None if i % 13 == 0 else f"a{a}", low, high, kind < 2, y if kind < 2 else None, x))
    data = spark.createDataFrame(rows, "endpoint string, fold int, assay_id string, lower double, upper double, exact_mask boolean, value_p double, x double")
    options = {"tau_b": 0.5, "tau_r": 0.3, "steps": 12, "tolerance": 1e-9}
    made = effects.fit_effects(data, ["x"], held="fold", folds=3, **options)
    assert set(made.cells) == {f"{e}|{f}" for e in "pq" for f in range(3)}
    own = {(r["cell"], r["assay"]): (r["n"], r["b"], r["r"]) for r in made.effects.collect()}
    for f in range(3):
        alone = effects.fit_effects(data.where(f"fold is null or fold <> {f}"), ["x"], **options)
        for e in "pq":
            a, b = made.cells[f"{e}|{f}"], alone.cells[e]
            assert a["n"] == b["n"] and a["loss"] == pytest.approx(b["loss"], rel=1e-9) and np.allclose(np.r_[a["w"], a["v"]], np.r_[b["w"], b["v"]], atol=1e-6)
        for r in alone.effects.collect():
            assert own[f"{r['cell']}|{f}", r["assay"]] == (r["n"], pytest.approx(r["b"], abs=1e-6), pytest.approx(r["r"], abs=1e-6))


def test_looked_up_permutations_are_those_walked(monkeypatch):
    """Sums by tables of rounds, by pieces of a block, against every place moved on its own; rows of 0 cost nothing and change nothing."""
    monkeypatch.setattr(censoring, "CHUNK", 1000)
    rng = np.random.default_rng(2)
    for n, part, right in ((5000, 5000, 700), (4096, 3000, 4096), (70_000, 20_000, 1), (300, 10, 100), (1, 1, 1)):
        place, r = rng.permutation(n)[:part], np.maximum(rng.normal(size=part), 0)
        want = [(r * (censoring.shuffled(place, n, 3, k) < right)).sum() for k in range(6)]
        assert censoring.labelled_sums(place, r, n, right, 3, 6) == pytest.approx(want, rel=1e-12)


def test_folds_of_boosted_trees_are_laid_out_once(spark):
    """Cells of held-out folds from one layout grow the trees of those fitted on their own rows, with far labels, missing features and equal bounds."""
    rng, rows = np.random.default_rng(6), []
    for i in range(900):
        x, z = float(rng.integers(0, 6)), float(rng.integers(0, 4)) if i % 10 else None
        y, kind = 5 + 0.6 * (x > 2) + float(rng.normal(0, 0.3)) + (9.0 if i % 70 == 0 else 0.0), i % 5
        low, high = ((y, y), (y, y), (-math.inf, 5.5), (5.0, math.inf), (y - 0.2, y + 0.2))[kind]
        rows.append((f"r{i}", "pq"[i % 2], int(rng.integers(0, 3)), low, high, kind < 2, y if kind < 2 else None, x, z))
    data = spark.createDataFrame(rows, "row_id string, endpoint string, fold int, lower double, upper double, exact_mask boolean, value_p double, x double, z double")
    valid, options = F.xxhash64("row_id") % 5 == 0, {"rounds": 5, "patience": 3, "depth": 2, "bins": 8, "rate": 0.3, "scale": 0.8, "columns": 1.0}
    made = boosting.fit_boosted(data, ["x", "z"], valid=valid, held="fold", folds=3, **options)
    spread = data.withColumn("f", F.explode(F.array(*map(F.lit, range(3))))).where("f <> fold").withColumn("cell", F.concat_ws("|", "endpoint", "f"))
    want = boosting.fit_boosted(spread, ["x", "z"], cell="cell", valid=valid, **options)
    assert set(made.cells) == set(want.cells) and len(made.cells) == 6
    for k, c in want.cells.items():
        own = made.cells[k]
        assert own["best"] == c["best"] and np.allclose(own["history"], c["history"], rtol=1e-9) and len(own["trees"]) == len(c["trees"])
        for a, b in zip(own["trees"], c["trees"], strict=True):
            assert (a.feature, a.bin, a.missing_left) == (b.feature, b.bin, b.missing_left) and np.allclose(a.value, b.value, rtol=1e-9)
