"""Core operators on small fixtures: hand values, simulations, invariants and round trips."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boundlab.functions import arrays
from boundlab.functions import distributions as D
from boundlab.operators import censoring, conformal, curation, metrics, ranking, splits
from boundlab.sources import features, loaders, sinks
from boundlab.sources.observations import sanitised

INF = math.inf


def values(spark, column, rows, layout):
    return [r[0] for r in spark.createDataFrame(rows, layout).select(column).collect()]


def test_log_cdf_down_the_tail(spark):
    z = [-1e6, -100.0, -40.0, -20.0, -8.0, -7.0, -1.5, 0.0, 0.3, 6.0, 9.0, INF, -INF]
    made = values(spark, D.normal_log_cdf(F.col("z")), [(v,) for v in z], "z double")
    for v, got in zip(z, made, strict=True):
        if abs(v) < 30:
            assert got == pytest.approx(math.log(0.5 * math.erfc(-v / math.sqrt(2))), rel=1e-9, abs=1e-15)
        elif v > -INF and v < 0:  # the first terms of the asymptotic series
            assert got == pytest.approx(-v * v / 2 - math.log(-v) - 0.5 * math.log(2 * math.pi) + math.log1p(-1 / v**2 + 3 / v**4 - 15 / v**6), rel=1e-12)
    assert made[-2:] == [0.0, -INF]
    assert arrays.log_ndtr(np.array(z)) == pytest.approx(made)


def integral(f, a, b, n=20_001):
    x = np.linspace(a, b, n)
    y = f(x)
    return float((y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (x[1] - x[0]) / 3)


@pytest.mark.parametrize("df", [1.0, 2.5, 4.0, 30.0])
def test_student_log_cdf(spark, df):
    pdf = lambda x: np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(x * x / df))
    z = [-6.0, -2.0, -0.5, 0.0, 0.7, 3.0]
    made = values(spark, D.student_log_cdf(F.col("z"), df), [(v,) for v in z], "z double")
    for v, got in zip(z, made, strict=True):
        assert math.exp(got) == pytest.approx(0.5 + math.copysign(integral(pdf, 0, abs(v)), v) if v else 0.5, abs=1e-9)
    # far out the tail is a power law: log F(-z) = log(f(z) z / df) nearly
    far = values(spark, D.student_log_cdf(F.col("z"), df), [(-1e8,)], "z double")[0]
    assert far == pytest.approx(math.log(float(pdf(np.array(1e8))) * 1e8 / df) if df < 5 else arrays.log_stdtr(np.array([-1e8]), df)[0], rel=1e-6)
    assert D.LatentDistribution("student_t", df).ppf(0.9) == pytest.approx(-D.LatentDistribution("student_t", df).ppf(0.1))


def test_interval_log_probability(spark):
    rows = [(0.0, 1.0, 100.0, INF), (0.0, 1.0, -INF, -40.0), (0.0, 1.0, 20.0, 20.5), (0.0, 1.0, -20.5, -20.0), (0.0, 1.0, -0.5, 0.7), (0.0, 2.0, 1.0, 1.0005), (0.0, 0.0, -1.0, 1.0)]
    layout = "mu double, sigma double, lower double, upper double"
    at = [F.col(c) for c in ("mu", "sigma", "lower", "upper")]
    made = values(spark, D.interval_log_probability(*at, F.lit(False)), rows, layout)
    assert -made[0] == pytest.approx(5005.5242, abs=1e-3) and -made[1] == pytest.approx(804.6084, abs=1e-3)
    assert made[2] == pytest.approx(made[3])  # mirrored
    cdf = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    assert math.exp(made[4]) == pytest.approx(cdf(0.7) - cdf(-0.5))
    assert math.exp(made[5]) == pytest.approx(cdf(0.50025) - cdf(0.5), rel=1e-6)  # narrow
    assert made[6] == pytest.approx(0, abs=1e-12)
    q = values(spark, D.interval_probability(*at, F.lit(False)), rows, layout)
    assert q[0] == 0 and all(0 <= x <= 1 for x in q)
    assert values(spark, D.interval_probability(*at, F.lit(True)), rows[:1], layout) == [1.0]
    for dist in (D.LatentDistribution("student_t", 4.0), D.LatentDistribution("student_t", 7.0)):
        made = values(spark, D.interval_log_probability(*at, F.lit(False), dist), [r for r in rows if r[1]], layout)
        assert all(math.isfinite(x) and x <= 0 for x in made)
    with pytest.raises(ValueError):
        D.LatentDistribution("cauchy")


def test_quantiles_of_mixtures(spark):
    one, two = [(1.0, 2.0)], [(0.0, 1.0), (3.0, 0.5)]
    frame = spark.createDataFrame([(1, one), (2, two)], "i int, c array<struct<mu: double, sigma: double>>")
    for q in (0.05, 0.5, 0.95):
        made = dict(frame.select("i", D.predictive_quantile(F.col("c"), q)).collect())
        assert made[1] == pytest.approx(1 + 2 * D.GAUSSIAN.ppf(q))
        assert np.mean([0.5 * math.erfc(-(made[2] - m) / s / math.sqrt(2)) for m, s in two]) == pytest.approx(q, abs=1e-9)


def test_exact_masks(spark):
    rows = [("exact", 5.0, 5.0 + 1e-6, None), ("exact", 5.0, 6.0, None), ("left_censored_p", 4.0, 5.0, None), ("right_censored_p", 5.0, 9.0, None), ("interval", 1.0, 2.0, None), ("exact", 5.0, 6.0, True), ("exact", 5.0, 5.0, False)]
    frame = spark.createDataFrame(rows, "censoring_class string, lower double, upper double, exact_mask boolean")
    made = [tuple(r) for r in sanitised(frame).select("lower", "upper", "exact_mask", "censoring_class").collect()]
    assert made[0][:3] == (5.0 + 1e-6, 5.0 + 1e-6, True) and made[1][2] is False
    assert made[2][:2] == (-INF, 5.0) and made[3][:2] == (5.0, INF) and made[4][3] == "interval_censored_p"
    assert made[5][2] is True and made[6][2] is False  # a given mask wins
    assert sanitised(frame.drop("exact_mask"), strict=True).select("exact_mask").first()[0] is False


@pytest.mark.parametrize("kind", ["normal", "ties", "one"])
def test_ranks_and_quantiles(spark, kind):
    rng = random.Random(5)
    pick = {"normal": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.choice([1, 1, 1, 2, 7])), "one": lambda: 3.0}[kind]
    rows = [(g, pick()) for g in "ab" for _ in range(1 if g == "b" and kind == "one" else 301)] + [("a", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    for g, xs in {g: np.array([v for h, v in rows if h == g and v is not None]) for g in "ab"}.items():
        found = {r["g"]: r for r in ranking.quantiles(frame, ["g"], "v", {"q1": 0.1, "q5": 0.5, "q10": 1.0}).collect()}[g]
        assert [found["q1"], found["q5"], found["q10"]] == pytest.approx(np.quantile(xs, [0.1, 0.5, 1.0]).tolist())
        runs = {r["v"]: (r["first"], r["n"]) for r in ranking.value_runs(frame, ["g"], "v").where(F.col("g") == g).collect()}
        assert runs == {float(v): (int((xs < v).sum()), int((xs == v).sum())) for v in set(xs)}


def test_folds_are_even_and_whole(spark):
    rows = [("e", f"a{i % 23}", f"r{i}") for i in range(400)] + [("f", None, "x")]
    made = splits.grouped_folds(spark.createDataFrame(rows, "endpoint string, assay_id string, row_id string"), F.col("assay_id"), 5).collect()
    assert len(made) == len(rows)
    by = {}
    for r in made:
        by.setdefault((r["endpoint"], r["assay_id"]), set()).add(r["fold"])
    assert all(len(f) == 1 for f in by.values())
    sizes = np.bincount([next(iter(f)) for (e, _), f in by.items() if e == "e"])
    assert sizes.tolist() == [5, 5, 5, 4, 4]


def observations(spark, n=600):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        y = rng.gauss(5, 1)
        kind = "exact" if i % 3 else "right_censored_p" if i % 2 else "left_censored_p"
        low, high = (y, y) if kind == "exact" else (5.0, INF) if kind == "right_censored_p" else (-INF, 5.0)
        rows.append((f"r{i}", "e", f"a{i % 40}", f"d{i % 90}", ["big", "mid", "tiny"][0 if i % 2 else 1 if i % 20 else 2], f"c{i % 150}", kind, low, high, kind == "exact", y if kind == "exact" else None))
    return spark.createDataFrame(rows, "row_id string, endpoint string, assay_id string, document_id string, source_name string, compound_id string, censoring_class string, lower double, upper double, exact_mask boolean, value_p double")


def test_split_kinds_have_no_leaks(spark, tmp_path):
    obs = observations(spark)
    tests = splits.make_splits(obs)
    kinds = {r[0] for r in tests.select("kind").distinct().collect()}
    assert kinds == {"random", "assay", "document", "scaffold", "compound", "source", "threshold"}  # no scaffold column: assay_scaffold is left out, scaffold falls back
    made = splits.assignments(obs, tests).persist()
    faults = splits.validation(obs, made).collect()
    assert faults and all(r["ok"] for r in faults)
    rows = {r["row_id"]: r for r in obs.collect()}
    for kind, key in (("assay", "assay_id"), ("document", "document_id"), ("compound", "compound_id"), ("scaffold", "compound_id"), ("source", "source_name")):
        sides = {}
        for r in made.where(F.col("kind") == kind).collect():
            sides.setdefault((r["fold"], rows[r["row_id"]][key]), set()).add(r["role"])
        assert sides and all(len(s) == 1 for s in sides.values())
    assert {r["fold"] for r in faults if r["kind"] == "source"} == {"big", "mid"}
    assert all(rows[r["row_id"]]["exact_mask"] for r in tests.where("kind = 'threshold'").collect())
    with pytest.raises(ValueError):
        splits.split(obs, "nonsense")
    sinks.write_splits(made, str(tmp_path / "splits"), "measurement")
    assert spark.read.parquet(str(tmp_path / "splits")).count() == made.count()
    broken = made.unionByName(made.where("kind = 'random' and fold = '0'").withColumn("role", F.lit("train")))
    assert [r["ok"] for r in splits.validation(obs, broken).where("kind = 'random' and fold = '0'").collect()] == [False]


def test_source_folds_come_by_size(spark):
    found = splits.source_split(observations(spark)).select("fold", "place").distinct().collect()
    assert {r["fold"]: r["place"] for r in found} == {"big": 0, "mid": 1}


def test_conformal_coverage(spark):
    rng = random.Random(2)
    rows = [(f"r{i}", "e", "s", True, rng.gauss(0, 3), 0.0, 1.0) for i in range(3000)]
    pred = spark.createDataFrame(rows, "row_id string, endpoint string, source_name string, exact_mask boolean, value_p double, mu double, sigma double")
    made = {r["method"]: r for r in conformal.study(pred, ["endpoint"], "source_name", (0,)).collect()}
    assert made["raw"]["coverage"] < 0.5 and 0.87 < made["split"]["coverage"] < 0.93 and made["mondrian"]["coverage"] == made["split"]["coverage"]
    few = conformal.study(pred.limit(30), ["endpoint"], "source_name", (0,)).where("method = 'split'").first()
    assert few is None or few["coverage"] is None or few["n_exact"] < 30


def test_thresholds_fall_back(spark):
    rows = [("a", True, 4.0, True), ("a", True, 6.0, True), ("b", True, 9.0, False), ("c", False, None, True)]
    frame = spark.createDataFrame(rows, "endpoint string, exact_mask boolean, value_p double, train boolean")
    made = {r["endpoint"]: r["threshold"] for r in metrics.decision_thresholds(frame, F.col("train")).collect()}
    assert made == {"a": 5.0, "b": 9.0, "c": 6.0}


def test_mechanism_tests(spark):
    rng = np.random.default_rng(8)
    x, noise = rng.normal(size=(900, 2)), rng.normal(size=900)
    y = 5 + x[:, 0] + noise
    late = [y > 5.8, noise > 0.8]  # censored by the value, and by what the features don't tell
    for hidden, strong in ((late[1], True), (rng.random(900) < 0.2, False)):
        rows = [(f"r{i}", "right_censored_p" if hidden[i] else "exact", float(y[i]) if hidden[i] else float(y[i]), None if hidden[i] else float(y[i]), float(x[i, 0]), float(x[i, 1]), i % 3 > 0) for i in range(900)]
        frame = spark.createDataFrame(rows, "row_id string, censoring_class string, lower double, value_p double, x0 double, x1 double, train boolean")
        found = censoring.informativeness(frame, ["x0", "x1"], F.col("train"), permutations=200).first()
        assert found["informative"] is strong and (found["p"] < 0.05) is strong
    rows = [(f"r{i}", "right_censored_p" if late[0][i] else "exact", float(x[i, 0]), float(x[i, 1]), i % 3 > 0) for i in range(900)]
    frame = spark.createDataFrame(rows, "row_id string, censoring_class string, x0 double, x1 double, train boolean")
    aucs = {r["features"]: r["auc"] for r in censoring.predict_censoring(frame, {"good": ["x0"], "bad": ["x1"], "none": []}, F.col("train")).collect()}
    assert aucs["good"] > 0.7 > 0.6 > aucs["bad"] and aucs["good+bad+none"] > 0.7
    assert censoring.informativeness(frame.withColumns({"value_p": F.lit(1.0), "lower": F.lit(1.0)}).limit(30), ["x0"], F.col("train")).first()["p"] is None


def test_relabelling_is_an_exact_permutation(spark):
    for n in (1, 2, 3, 15, 16, 17, 100, 1025):
        for k in range(4):
            assert sorted(censoring.shuffled(np.arange(n), n, 7, k)) == list(range(n))
    hits = np.array([censoring.shuffled(np.arange(40), 40, 1, k) < 13 for k in range(3000)])
    assert (hits.sum(axis=1) == 13).all()
    assert np.abs(hits.mean(axis=0) - 13 / 40).max() < 0.04  # each row as often
    both = hits.T.astype(float) @ hits / 3000
    assert np.abs(both[~np.eye(40, dtype=bool)] - 13 * 12 / (40 * 39)).max() < 0.04  # and each pair


def test_permutation_test_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, n, late in (("a", 260, 0.4), ("b", 300, 0.0), ("few", 60, 0.0), ("none", 20, 0.0)):
        x = rng.normal(size=n)
        y = 5 + x + rng.normal(0, 0.5, n)
        for i in range(n):
            right = rng.random() < 0.3 if g != "few" else i == 0
            rows.append((f"{g}{i}", g, "right_censored_p" if right else "exact", float(y[i]) + late * right, None if right else float(y[i]), float(x[i]), i % 2 == 0 and g != "none"))
    frame = spark.createDataFrame(rows, "row_id string, endpoint string, censoring_class string, lower double, value_p double, x0 double, train boolean")
    found = {r["endpoint"]: r for r in censoring.informativeness(frame, ["x0"], F.col("train"), permutations=300, by="endpoint", least_train=20).collect()}
    assert set(found) == {"a", "b", "few", "none"} and found["few"]["p"] is None and found["none"]["n_right_test"] is None and found["none"]["n_exact_train"] == 0
    for g in "ab":
        mine = [r for r in rows if r[1] == g]
        w = censoring.ridge(spark.createDataFrame([(r[5], r[4]) for r in mine if r[6] and r[2] == "exact"], "x0 double, y double"), ["x0"], "y")
        test = [(hashlib.md5(r[0].encode()).hexdigest(), r[2] != "exact", max(0.0, (r[3] if r[2] != "exact" else r[4]) - w[0] - w[1] * r[5])) for r in mine if not r[6]]
        test.sort()
        c, v = np.array([t[1] for t in test]), np.array([t[2] for t in test])
        observed = v[c].mean() - v[~c].mean()
        far = 0
        for k in range(300):
            label = censoring.shuffled(np.arange(len(v)), len(v), 0, k) < c.sum()
            far += abs(v[label].mean() - v[~label].mean()) >= abs(observed) - 1e-12
        r = found[g]
        assert (r["n_right_test"], r["n_exact_test"]) == (c.sum(), (~c).sum())
        assert r["difference"] == pytest.approx(observed) and r["p"] == pytest.approx((far + 1) / 301)
    assert found["a"]["informative"] and found["a"]["p"] < found["b"]["p"]


def test_ridge_against_normal_equations(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(3, 1, (50, 2)), rng.normal(2, 1, 50)
    w = censoring.ridge(spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double"), ["a", "b"], "y")
    xc, yc = x - x.mean(0), y - y.mean()
    beta = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
    assert w == pytest.approx([y.mean() - beta @ x.mean(0), *beta])


def test_reading_and_writing(spark, tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text(json.dumps({"data": "d", "folds": 3, "endpoints": ["x"]}))
    assert loaders.read_config(spark, str(tmp_path / "c.json")).folds == 3
    monkeypatch.setenv("BOUNDLAB_DATA", "elsewhere")
    assert loaders.read_config(spark, str(tmp_path / "c.json")).data == "elsewhere"
    (tmp_path / "bad.json").write_text('{"nonsense": 1}')
    with pytest.raises(ValueError):
        loaders.read_config(spark, str(tmp_path / "bad.json"))
    cells = spark.createDataFrame([("e:1", 0, "satisficing", 0.05, 0.5, None), ("e:1", 1, "tobit", 0.0, None, "failed")], "endpoint string, fold int, treatment string, eps double, acc_mae double, error string")
    sinks.write_cells(cells, str(tmp_path / "cells"))
    with open(tmp_path / "cells" / "_endpoint=e_1" / "broken.json", "w") as f:
        f.write("{not json\n")
    kept = sinks.collate(spark, str(tmp_path / "cells"), str(tmp_path / "all.parquet"), "endpoint string, fold int, treatment string, eps double, acc_mae double, error string")
    assert kept.count() == 2
    assert [r["treatment_label"] for r in sinks.read_results(spark, str(tmp_path / "all.parquet")).collect()] == ["satisficing@0.05"]
    for i in range(2):
        (tmp_path / f"t{i}.csv").write_text(f"a,b\n{i},0.5\n")
    assert loaders.result_files(spark, str(tmp_path / "t*.csv"), "a int, b double", strict=True).count() == 2
    sinks.write_report(kept, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_report(kept, str(tmp_path / "report"), limit=1)
    text = sinks.write_criteria(spark, spark.createDataFrame([("b", None, "x"), ("a", True, "y")], "name string, pass boolean, detail string"), str(tmp_path / "out"))
    assert "[PASS] a" in text and "[N/A] b" in text
    made = sinks.write_manifest(spark, str(tmp_path / "cells"), str(tmp_path / "manifest"), "1")
    import hashlib

    assert {r["file"]: r["sha256"] for r in made.collect()}["broken.json"] == hashlib.sha256(b"{not json\n").hexdigest()


def test_features_once_a_key(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "b"), (4, None)], "i int, k string")
    made = {r["i"]: r["x"] for r in features.featured(rows, "k", cache=str(tmp_path), bits=8, longest=2).collect()}
    assert made[1] == made[2] == features.shape_of("ab", 8, 2).tolist() and sum(made[3]) == 1 and made[4] is None
    again = features.featured(rows, "k", cache=str(tmp_path), bits=8, longest=2).collect()
    assert {r["i"]: r["x"] for r in again} == made and len(list(tmp_path.iterdir())) == 1
    assert values(spark, features.finite(F.col("v")), [([1.0, float("nan"), INF, None],)], "v array<double>") == [[1.0, 0.0, 0.0, 0.0]]


def test_comment_rules(spark):
    texts = [None, " ", "Not Active (dose)", "see paper", "non-toxic", "reactive"]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select(curation.comment_action(F.col("t"), "strict"), curation.comment_action(F.col("t"), "broad")).collect()
    assert [tuple(r) for r in made] == [("keep", "keep"), ("keep", "keep"), ("quarantine", "flag"), ("flag", "flag"), ("quarantine", "flag"), ("flag", "flag")]


def test_marks_validate_like_written_assignments(spark):
    """Doubled ids among them: what is counted by row and fold is what the assignments themselves give."""
    rows = [(f"r{i % 190}", "e" if i % 190 % 3 else "f", f"a{i % 190 % 17}", f"c{i % 190 % 29}", f"s{i % 190 % 5}", "lab" if i % 190 % 2 else "shop", i % 190 % 4 > 0, float(i % 190) if i % 190 % 4 > 0 else None) for i in range(200)]
    obs = spark.createDataFrame(rows * 2 + [(f"q{i}", "f", f"a{i % 7}", None, None, "lab", True, float(i)) for i in range(300)], "row_id string, endpoint string, assay_id string, compound_id string, scaffold string, source_name string, exact_mask boolean, value_p double")
    kinds = ("random", "assay", "scaffold", "compound", "source", "threshold")
    marks = splits.marked(obs, kinds)
    tests = splits.make_splits(obs, kinds)
    listed = lambda df: sorted(tuple(r) for r in df.select("kind", "endpoint", "fold", "row_id").collect())
    assert listed(marks.select("endpoint", "row_id", F.inline("tests"))) == listed(tests)
    want, found = splits.validation(obs, splits.assignments(obs, tests)), splits.marks_validation(obs, marks)
    assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    unknown = splits.marks_validation(obs.where("row_id <> 'q1'"), marks).where("endpoint = 'f'")
    assert {r["n_unknown"] for r in unknown.collect()} == {1}


@pytest.mark.parametrize("share, least", [(0.2, 50), (0.0, 0), (1.0, 5), (0.5, 10**6), (0.003, 1)])
def test_calibration_slice_is_the_first_rows_in_hash_order(spark, share, least):
    rows = [(f"r{i}", "e" if i % 3 else "f") for i in range(900)] + [("one", "g")] * 3
    made = splits.calibration_slice(spark.createDataFrame(rows, "row_id string, endpoint string"), share, least)
    found = made.groupBy("endpoint").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("calibration"), F.col("row_id")))).alias("ids")).collect()
    for r in found:
        mine = sorted((hashlib.md5(f"0|{i}".encode()).hexdigest(), i) for i, e in rows if e == r["endpoint"])
        assert r["n"] == len(mine) and r["ids"] == sorted(i for _, i in mine[: max(least, int(share * len(mine)))])


def test_weights_stand_for_equal_rows(spark):
    """Ranks, AUC, quantiles and thresholds from counted values are those of the rows."""
    rng = random.Random(8)
    rows = [("e" if rng.random() < 0.6 else "f", float(rng.randint(0, 9)), rng.random() < 0.4, rng.randint(0, 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "endpoint string, value_p double, y boolean, fold int")
    counted = df.groupBy("endpoint", "value_p", "y").agg(F.count("*").alias("w"))
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    assert same(metrics.auc(df, ["endpoint"], "value_p", "y"), metrics.auc(counted, ["endpoint"], "value_p", "y", "w"))
    assert same(ranking.quantiles(df, ["endpoint"], "value_p", {"q": 0.3}), ranking.quantiles(counted, ["endpoint"], "value_p", {"q": 0.3}, "w"))
    exact = df.withColumn("exact_mask", F.col("y"))
    one = [metrics.decision_thresholds(exact, F.col("fold") != f).select("endpoint", F.lit(f).alias("fold"), "threshold") for f in range(3)]
    assert same(one[0].unionByName(one[1]).unionByName(one[2]), metrics.fold_thresholds(exact, [0, 1, 2]))


def test_equal_rows_are_one_line_of_the_logistic_fit(spark, monkeypatch):
    """Rows of few different features reach the fit as few weighted lines."""
    from pyspark.ml.classification import LogisticRegression

    seen, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df, *a: seen.append(df.count()) or fit(self, df, *a))
    rows = [("exact" if (i * 7) % 10 < 6 + i % 3 else "left_censored_p", float(i % 3), i % 5 > 0) for i in range(600)]
    df = spark.createDataFrame(rows, "censoring_class string, a double, train boolean")
    found = censoring.predict_censoring(df, {"a": ["a"]}, F.col("train")).first()
    assert seen == [6] and found["n_test"] == 120 and found["base_rate"] == pytest.approx(sum(r[0] != "exact" for r in rows) / 600)
