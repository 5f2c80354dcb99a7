"""Aggregates over experiment cells and paired inference between treatments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def treatment_label(treatment: F.Column, eps: F.Column) -> F.Column:
    """Budgeted treatments carry their budget in the name."""
    return F.when(treatment.isin("satisficing", "ensemble_satisficing"), F.format_string("%s@%.2f", treatment, eps)).otherwise(treatment)


def endpoint_means(cells: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    return cells.dropna(subset=by).groupBy(*by).agg(*(F.avg(m).alias(m) for m in metrics), F.count("*").alias("n_cells"))


def two_level(means: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """Mean over endpoints of endpoint means, three decimals: replicates of an endpoint don't count as endpoints."""
    return means.groupBy(*by).agg(*(F.round(F.avg(m), 3).alias(m) for m in metrics), F.count("*").alias("n_endpoints"))


def signed_rank_p(n: int, statistic: float) -> float:
    """Exact two-sided p of Wilcoxon's statistic min(W+, W-), from the count of subset sums."""
    total = n * (n + 1) // 2
    ways = np.zeros(total + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r]
    return float(min(1.0, 2 * ways[: int(np.floor(statistic)) + 1].sum() / 2.0**n))


def _exact_p(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for n, w in batches:
        yield pd.Series([signed_rank_p(int(a), b) if a > 0 else 1.0 for a, b in zip(n, w, strict=True)])


def paired(means: DataFrame, metric: str, baseline: str, by: list[str], least: int = 3) -> DataFrame:
    """Each treatment against the baseline over endpoints: deltas, Wilcoxon's statistic and exact p, q by Benjamini-Hochberg."""
    base = means.where(F.col("treatment") == baseline).select("endpoint", *by, F.col(metric).alias("_b"))
    rows = means.where(F.col("treatment") != baseline).join(base, ["endpoint", *by]).withColumn("d", F.col(metric) - F.col("_b")).where("d is not null")
    keys = [*by, "treatment"]
    over = Window.partitionBy(*keys, (F.col("d") != 0)).orderBy(F.abs("d"))
    ties = Window.partitionBy(*keys, F.abs("d"))
    ranked = rows.withColumn("_r", F.rank().over(over) + (F.count("*").over(ties) - 1) / 2)
    plus, minus = (F.coalesce(F.sum(F.when(c, F.col("_r"))), F.lit(0.0)) for c in (F.col("d") > 0, F.col("d") < 0))
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("d") != 0).alias("n_nonzero"), F.median("d").alias("median_delta"), F.avg("d").alias("mean_delta"), F.least(plus, minus).alias("w")).where(F.col("n") >= least)
    exact = F.pandas_udf(_exact_p, "double")  # one row a treatment
    return bh(out.withColumn("p", exact("n_nonzero", "w")), by)


def bh(rows: DataFrame, by: list[str], p: str = "p", alpha: float = 0.05) -> DataFrame:
    """q: the reversed running minimum of p * n / rank."""
    order = Window.partitionBy(*by).orderBy(p, "treatment") if by else Window.orderBy(p, "treatment")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    rows = rows.withColumn("_k", F.row_number().over(order)).withColumn("_q", F.col(p) * F.count("*").over(whole) / F.col("_k"))
    q = F.least(F.lit(1.0), F.min("_q").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    return rows.withColumn("q", q).withColumn("reject", F.col("q") <= alpha).drop("_k", "_q")


def feasibility(cells: DataFrame, eps: float = 0.05, tolerance: float = 1e-3) -> DataFrame:
    """split_kind (and 'all'): feasible share, mean, median and largest constraint excess over endpoint-split units."""
    excess = F.greatest("g_left", "g_right") - eps
    units = cells.withColumn("excess", excess).groupBy("endpoint", "split_kind").agg(F.avg((F.col("excess") <= tolerance).cast("double")).alias("feasible"), F.avg("excess").alias("excess"))
    summary = units.rollup("split_kind").agg(F.count("*").alias("n_units"), F.avg("feasible").alias("feasible"), F.avg("excess").alias("mean_excess"), F.median("excess").alias("median_excess"), F.max("excess").alias("max_excess"))
    return summary.withColumn("split_kind", F.coalesce("split_kind", F.lit("all")))


def monotone_frontier(means: DataFrame, metric: str, by: list[str], slack: float = 0.03) -> DataFrame:
    """Does the metric keep rising with the budget, give or take the slack? Null where it can't be told."""
    points = means.groupBy(*by, "eps").agg(F.avg(metric).alias("m"))
    points = points.withColumn("_next", F.lead("m").over(Window.partitionBy(*by).orderBy("eps")))
    return points.groupBy(*by).agg(F.count("*").alias("n_budgets"), F.every(F.when(F.col("_next").isNotNull(), F.col("m") <= F.col("_next") + slack)).alias("monotone"))


def pareto(means: DataFrame) -> DataFrame:
    kept = means.where(F.col("treatment").rlike(r"^(exact_only|tobit|satisficing@)"))
    return kept.select("endpoint", "treatment", "mae", "violation_rate")


def moments_intercept(rows: DataFrame, by: list[str], value: str, group: str = "endpoint") -> DataFrame:
    """One-way random-intercept model of `value` by `group`, method of moments on pre-aggregated sums."""
    unit = rows.groupBy(*by, group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    k, n = F.count("*"), F.sum("n")
    within = F.try_divide(F.sum(F.coalesce("v", F.lit(0.0)) * (F.col("n") - 1)), n - k)
    size = F.try_divide(n - F.sum(F.col("n") * F.col("n")) / n, k - 1)
    fixed = unit.groupBy(*by).agg(k.alias("n_groups"), n.alias("n_pairs"), within.alias("within"), size.alias("_size"), (F.var_samp("m")).alias("_between"))
    fixed = fixed.withColumn("between", F.greatest(F.col("_between") - F.try_divide(F.col("within"), F.col("_size")), F.lit(0.0)))
    weighted = unit.join(fixed, by).withColumn("_w", F.try_divide(F.lit(1.0), F.col("between") + F.col("within") / F.col("n")))
    out = weighted.groupBy(*by, "n_groups", "n_pairs", "within", "between").agg(F.try_divide(F.sum(F.col("_w") * F.col("m")), F.sum("_w")).alias("estimate"), F.sqrt(F.try_divide(F.lit(1.0), F.sum("_w"))).alias("standard_error"))
    return out.where((F.col("n_groups") >= 3) & (F.col("n_pairs") >= 6))


def random_intercept(rows: DataFrame, by: list[str], value: str, group: str = "endpoint") -> DataFrame:
    """One-way random-intercept model of `value` by `group`, by restricted maximum likelihood on pre-aggregated sums.

    The likelihood needs count, mean and variance of each group alone; the ratio of
    the variances is found by golden section over its log, a vector of candidates a
    step, in an Arrow UDF that sees one row a group.
    """
    unit = rows.groupBy(*by, group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("ss"))
    one = unit.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(group, "n", "m", "ss"))).alias("u"), F.count("*").alias("n_groups"), F.sum("n").alias("n_pairs"))
    one = one.where((F.col("n_groups") >= 3) & (F.col("n_pairs") >= 6))

    @F.pandas_udf("struct<within: double, between: double, estimate: double, standard_error: double>")
    def fit(n: pd.Series, m: pd.Series, ss: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([reml(*(np.asarray(x, float) for x in g)) for g in zip(n, m, ss, strict=True)], columns=["within", "between", "estimate", "standard_error"])

    part = lambda c: F.transform("u", lambda x: x[c])
    return one.withColumn("f", fit(part("n"), part("m"), part("ss"))).select(*by, "n_groups", "n_pairs", "f.*")


def reml(n: np.ndarray, m: np.ndarray, ss: np.ndarray) -> tuple[float, float, float, float]:
    """within, between, estimate, its standard error: restricted maximum likelihood of a one-way model from group sums."""
    total = n.sum()

    def at(ratio):
        """(criterion to minimise, within, estimate, weight sum) for between = ratio * within."""
        w = n / (1 + n * ratio)
        mu = (w * m).sum() / w.sum()
        q = ss.sum() + (w * (m - mu) ** 2).sum()
        within = max(q / (total - 1), 1e-300)
        return (total - 1) * np.log(within) + np.log(1 + n * ratio).sum() + np.log(w.sum()), within, mu, w.sum()

    grid = np.r_[0.0, np.exp(np.linspace(-18, 14, 129))]
    values = [at(r)[0] for r in grid]
    k = int(np.argmin(values))
    low, high = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
    gold = (5**0.5 - 1) / 2
    for _ in range(100):
        a, b = high - gold * (high - low), low + gold * (high - low)
        low, high = (low, b) if at(a)[0] <= at(b)[0] else (a, high)
    best = min((0.0, (low + high) / 2), key=lambda r: at(r)[0])
    _, within, mu, weight = at(best)
    return within, best * within, mu, float(np.sqrt(within / weight))


def treatment_delta(means: DataFrame, metric: str, a: str, b: str, by: list[str], least: int = 3) -> DataFrame:
    """by, n, median_delta between two treatments over the endpoints that have both, where there are enough."""
    side = lambda t, name: means.where(F.col("treatment") == t).select("endpoint", *by, F.col(metric).alias(name))
    both = side(a, "_a").join(side(b, "_b"), ["endpoint", *by]).withColumn("_d", F.col("_a") - F.col("_b")).where("_d is not null")
    found = both.groupBy(*by).agg(F.count("*").alias("n"), F.median("_d").alias("median_delta"))  # one value an endpoint
    return found.where(F.col("n") >= least)


def hidden_summary(cells: DataFrame) -> DataFrame:
    """mode, treatment: mean, sample deviation and number of the hidden errors."""
    return cells.groupBy("mode", "treatment").agg(F.avg("hidden_mae").alias("mean"), F.stddev("hidden_mae").alias("sd"), F.count("hidden_mae").alias("n"))


def cell_mean(cells: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """The plain mean over cells, not over endpoints: endpoints with more cells weigh more."""
    return cells.groupBy(*by).agg(F.avg(metric).alias(metric), F.count("*").alias("n_cells"))


def budget_sweep(cells: DataFrame, slack: float = 1e-3) -> DataFrame:
    """eps: share of cells whose every constraint value g_* keeps the budget, median and largest excess, mean multipliers and test violation."""
    values = [c for c in cells.columns if c.startswith("g_")]
    excess = F.greatest(*values) - F.col("eps") if len(values) > 1 else F.col(values[0]) - F.col("eps")
    return cells.withColumn("_x", excess).groupBy("eps").agg(
        F.count("*").alias("n"), F.avg((F.coalesce("_x", F.lit(0.0)) <= slack).cast("double")).alias("feasible"), F.median("_x").alias("median_excess"), F.max("_x").alias("max_excess"),
        *(F.avg(c).alias(f"mean_{c}") for c in cells.columns if c.startswith("lam_")), F.avg("violation_rate").alias("violation_rate"),
    )


def criteria(spark, hidden: DataFrame | None = None, coverage: DataFrame | None = None, graph: DataFrame | None = None, level: float = 0.9) -> DataFrame:
    """name, pass, detail of the prespecified criteria whose tables are given.

    hidden (mode, endpoint, treatment, hidden_mae): in natural mode the median over
    endpoints of tobit is below that of exact_only, over endpoints with both, 3 at
    least. coverage (raw_cov, conformal_cov): the mean after calibration is nearer
    the level. graph (treatment, violation): exact_only violates more than the mean
    of the budgeted treatments. A criterion that can't be told has a null pass.
    """
    out = []
    if hidden is not None:
        pair = hidden.where(F.col("mode") == "natural").groupBy("endpoint").pivot("treatment", ["exact_only", "tobit"]).agg(F.avg("hidden_mae")).dropna()
        out.append(pair.agg(F.lit("censor_aware_recovers_hidden_truth").alias("name"), F.when(F.count("*") >= 3, F.median("tobit") < F.median("exact_only")).alias("pass"), F.format_string("tobit %.3f, exact_only %.3f, n %d", F.median("tobit"), F.median("exact_only"), F.count("*")).alias("detail")))
    if coverage is not None:
        raw, made = F.avg("raw_cov"), F.avg("conformal_cov")
        out.append(coverage.agg(F.lit("conformal_restores_coverage").alias("name"), (F.abs(made - level) < F.abs(raw - level)).alias("pass"), F.format_string("raw %.3f, conformal %.3f", raw, made).alias("detail")))
    if graph is not None:
        by = graph.groupBy("treatment").agg(F.avg("violation").alias("v"))
        plain, budgeted = F.max(F.when(F.col("treatment") == "exact_only", F.col("v"))), F.avg(F.when(F.col("treatment").startswith("satisficing"), F.col("v")))
        out.append(by.agg(F.lit("second_backbone_same_direction").alias("name"), (plain > budgeted).alias("pass"), F.format_string("exact_only %.3f, budgeted %.3f", plain, budgeted).alias("detail")))
    if not out:
        return spark.createDataFrame([], "name string, pass boolean, detail string")
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]
