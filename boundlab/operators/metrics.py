"""Scores on the rows where each is defined: exact, censored or resolvable ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boundlab.functions.distributions import INF, Z90, interval_probability, normal_cdf
from boundlab.operators.ranking import average_rank, quantiles, value_runs
from boundlab.operators.splits import fold_table
from boundlab.session import kept, saved, small
from boundlab.sources.observations import direction


def value() -> Column:
    return F.col("value_p")


def mean() -> Column:
    return F.col("mu")


def scale() -> Column:
    return F.greatest(F.col("sigma"), F.lit(1e-6))


def fold_predictions(obs: DataFrame, key: Column, k: int = 5, seed: int = 0) -> DataFrame:
    """obs with fold, mu, sigma: folds of whole groups of `key`; mean and sample deviation of the exact values trained on, by scaffold, else of the endpoint.

    One pass over obs gathers moments by (endpoint, group, scaffold); the rest works
    on these: groups are dealt into folds, moments merged by fold about a centre (so
    that large, narrow values don't cancel), and a fold's training moments are all
    minus its own. A second pass joins the two small tables.
    """
    rows = obs.withColumn("_key", F.coalesce(key, F.lit("None")))
    y = F.when(F.col("exact_mask"), value())
    cells = saved(rows.groupBy("endpoint", "_key", "scaffold").agg(F.count(y).alias("n"), F.avg(y).alias("m"), (F.var_pop(y) * F.count(y)).alias("q")))
    lots = saved(fold_table(cells.select("endpoint", F.col("_key").alias("key")).distinct(), k, seed).select(F.col("endpoint").alias("l_e"), F.col("key").alias("l_k"), "fold"))
    weighted = lambda by, name: cells.groupBy(*(F.col(c).alias(f"{name}_{c}") for c in by)).agg(F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias(name))
    same = lambda by, name: reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"{name}_{c}")), by, F.lit(True))
    near, wide = ["endpoint", "scaffold"], ["endpoint"]
    both = cells.join(weighted(near, "a"), same(near, "a")).join(weighted(wide, "b"), same(wide, "b"))
    both = both.join(lots, (F.col("endpoint") == F.col("l_e")) & (F.col("_key") == F.col("l_k")))
    parts = [F.sum("n").alias("n")]
    for c in "ab":
        far = F.col("m") - F.col(c)
        parts += [F.first(c).alias(c), F.sum(F.col("n") * far).alias(f"s{c}"), F.sum(F.col("q") + F.col("n") * far * far).alias(f"q{c}")]
    folds = both.groupBy(*near, "fold").agg(*parts).na.fill(0, ["sa", "qa", "sb", "qb"])

    def rest(rows_, by, centre):
        """Sums of a fold's training rows about the centre: a group's fold rows, k at most, minus their own."""
        over = Window.partitionBy(*by)
        names = {"n": "n", "s": f"s{centre}", "q": f"q{centre}"}
        return rows_.select(*by, "fold", centre, *((F.sum(c).over(over) - F.col(c)).alias(f"{centre}_{x}") for x, c in names.items()))

    by_endpoint = folds.groupBy("endpoint", "fold").agg(F.sum("n").alias("n"), F.first("b").alias("b"), F.sum("sb").alias("sb"), F.sum("qb").alias("qb"))
    wide_rest = rest(by_endpoint, wide, "b").withColumnsRenamed({"endpoint": "w_e", "fold": "w_f"})
    # every fold of the endpoint can meet every scaffold only where it has rows of it, and these are in `folds`
    model = rest(folds, near, "a").join(wide_rest, (F.col("endpoint") == F.col("w_e")) & (F.col("fold") == F.col("w_f")))
    mu = lambda c: F.when(F.col(f"{c}_n") > 0, F.col(c) + F.col(f"{c}_s") / F.col(f"{c}_n"))
    left = lambda c: F.greatest(F.col(f"{c}_q") - F.col(f"{c}_s") * F.col(f"{c}_s") / F.col(f"{c}_n"), F.lit(0.0))
    sd = lambda c: F.when(F.col(f"{c}_n") > 1, F.sqrt(left(c) / (F.col(f"{c}_n") - 1)))
    model = model.select(F.col("endpoint").alias("m_e"), F.col("scaffold").alias("m_s"), F.col("fold").alias("m_f"), F.coalesce(mu("a"), mu("b")).alias("mu"), F.greatest(F.coalesce(sd("a"), sd("b")), F.lit(1e-6)).alias("sigma"))
    model = saved(model)
    out = rows.join(small(lots), (F.col("endpoint") == F.col("l_e")) & (F.col("_key") == F.col("l_k"))).drop("l_e", "l_k", "_key")
    return out.join(small(model), (F.col("endpoint") == F.col("m_e")) & F.col("scaffold").eqNullSafe(F.col("m_s")) & (F.col("fold") == F.col("m_f"))).drop("m_e", "m_s", "m_f")


def decision_thresholds(rows: DataFrame, train: Column, fallback: float = 6.0) -> DataFrame:
    """endpoint, threshold: the median of exact values trained on, else of all exact values, else `fallback`."""
    # values are counted in the one pass over rows; null stands for those that don't count
    counts = kept(rows.groupBy("endpoint", F.when(F.col("exact_mask"), F.col("value_p")).alias("value_p"), train.alias("train")).agg(F.count("*").alias("_n")))
    by_train = quantiles(counts.where("train"), ["endpoint"], "value_p", {"t": 0.5}, "_n").select(F.col("endpoint").alias("t_e"), "t")
    by_all = quantiles(counts, ["endpoint"], "value_p", {"a": 0.5}, "_n").select(F.col("endpoint").alias("a_e"), "a")
    every = counts.select("endpoint").distinct().join(by_train, F.col("endpoint") == F.col("t_e"), "left").join(by_all, F.col("endpoint") == F.col("a_e"), "left")
    return every.select("endpoint", F.coalesce("t", "a", F.lit(fallback)).alias("threshold"))


def fold_thresholds(rows: DataFrame, folds: list[int], fallback: float = 6.0, weight: str | None = None) -> DataFrame:
    """endpoint, fold, threshold: `decision_thresholds` for each of these folds held out, from one count of the exact values by fold.

    A row counts as many times as its `weight` says.
    """
    counts = kept(rows.where("exact_mask and value_p is not null").groupBy("endpoint", F.col("fold").alias("_f"), "value_p").agg((F.sum(weight) if weight else F.count("*")).alias("_n")))
    listed = F.array(*(F.lit(f) for f in folds)) if folds else F.array().cast("array<int>")
    spread = counts.withColumn("fold", F.explode(F.filter(listed, lambda f: (f != F.col("_f")) & F.col("_f").isNotNull())))
    by_train = quantiles(spread, ["endpoint", "fold"], "value_p", {"t": 0.5}, "_n").select(F.col("endpoint").alias("t_e"), F.col("fold").alias("t_f"), "t")
    by_all = quantiles(counts, ["endpoint"], "value_p", {"a": 0.5}, "_n").select(F.col("endpoint").alias("a_e"), "a")
    every = rows.select("endpoint").distinct().withColumn("fold", F.explode(listed))
    every = every.join(by_train, (F.col("endpoint") == F.col("t_e")) & (F.col("fold") == F.col("t_f")), "left").join(by_all, F.col("endpoint") == F.col("a_e"), "left")
    return every.select("endpoint", "fold", F.coalesce("t", "a", F.lit(fallback)).alias("threshold"))


def _at_least(n: Column, k: int, value: Column) -> Column:
    return F.when(n >= k, value)


def accuracy(mu: str = "mu") -> list[Column]:
    """MAE, RMSE, signed bias and rows, over exact rows with a value."""
    e, n = F.when(F.col("exact_mask"), F.col(mu) - value()), F.count_if(F.col("exact_mask") & value().isNotNull())
    return [_at_least(n, 3, F.avg(F.abs(e))).alias("mae"), _at_least(n, 3, F.sqrt(F.avg(e * e))).alias("rmse"), _at_least(n, 3, F.avg(e)).alias("bias"), n.alias("n_exact")]


def violation(mu: str = "mu") -> list[Column]:
    """Share of censored rows predicted outside their bounds, in all and by open side."""
    out = ((F.col(mu) < F.col("lower")) | (F.col(mu) > F.col("upper"))).cast("double")
    part = lambda c: F.avg(F.when(~F.col("exact_mask") & c, out))
    return [part(F.lit(True)).alias("violation_rate"), part(F.col("upper") == INF).alias("violation_right"), part(F.col("lower") == -INF).alias("violation_left"), F.count_if(~F.col("exact_mask")).alias("n_censored")]


def truth(threshold: Column) -> Column:
    """Is the value above the threshold? Null where the label doesn't tell."""
    exact = F.when(value().isNotNull(), value() > threshold)
    return F.when(F.col("exact_mask"), exact).when((F.col("upper") == INF) & (F.col("lower") >= threshold), True).when((F.col("lower") == -INF) & (F.col("upper") <= threshold), False)


def decision_rows(rows: DataFrame, threshold: Column) -> DataFrame:
    """rows with `p`, the probability above the threshold, and `t`, the truth, null where it can't be told.

    Such rows stay: a filter on t would be pushed below the joins with all of its
    expression written out, and the aggregates skip nulls anyway.
    """
    return rows.withColumns({"t": truth(threshold), "p": normal_cdf((mean() - threshold) / scale())})


def decisions(cut: float = 0.5) -> list[Column]:
    t, yes, n = F.col("t"), F.col("p") >= cut, F.count("t")
    pos, neg = F.count_if(t), F.count_if(~t)
    fs, fl = F.try_divide(F.count_if(t & ~yes), pos), F.try_divide(F.count_if(~t & yes), neg)
    balanced = F.coalesce((2 - fs - fl) / 2, 1 - fs, 1 - fl)
    guarded = {"false_safe": fs, "false_liability": fl, "balanced_accuracy": balanced, "regret": F.avg(F.when(t.isNotNull(), F.abs(F.col("p") - t.cast("double"))))}
    return [n.alias("n_resolvable"), pos.alias("n_positive"), *(_at_least(n, 5, c).alias(k) for k, c in guarded.items())]


def calibration_bins(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """rows of decision_rows -> by, bin, n, confidence, frequency; equal bins, the last closed.

    Rows whose truth can't be told are counted in a bin of their own, which goes
    after the few sums are saved: a filter on it would be pushed below the
    aggregate and the joins, with all of the probability written out.
    """
    bin_ = F.when(F.col("t").isNotNull(), F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))).cast("int")
    return saved(rows.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("confidence"), F.avg(F.col("t").cast("double")).alias("frequency"))).where("bin is not null")


def calibration_error(bins: DataFrame, by: list[str], least: int = 20) -> DataFrame:
    n = F.sum("n")
    return bins.groupBy(*by).agg(n.alias("n"), _at_least(n, least, F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("frequency"))) / n).alias("ece"))


def coverage(low: Column, high: Column, alpha: float = 0.1, least: int = 10) -> list[Column]:
    """Coverage, width and interval score over exact rows."""
    y, n = F.when(F.col("exact_mask"), value()), F.count_if(F.col("exact_mask") & value().isNotNull())
    inside = y.between(low, high).cast("double")
    width = F.when(y.isNotNull(), high - low)
    score = width + 2 / alpha * F.greatest(low - y, F.lit(0.0)) + 2 / alpha * F.greatest(y - high, F.lit(0.0))
    score = F.when(y.isNotNull(), score)
    return [n.alias("n_exact"), *(_at_least(n, least, F.avg(c)).alias(k) for k, c in (("coverage", inside), ("width", width), ("interval_score", score)))]


def gaussian_interval(z: float = Z90) -> tuple[Column, Column]:
    return mean() - z * scale(), mean() + z * scale()


def constraint_diagnostics(tau: float = 0.85) -> list[Column]:
    """Over censored rows: share with enough probability in the bounds, mean shortfall, mean probability."""
    q = F.when(~F.col("exact_mask"), interval_probability(mean(), F.col("sigma"), F.col("lower"), F.col("upper"), F.col("exact_mask")))
    return [F.avg((q >= tau).cast("double")).alias("satisfied"), F.avg(F.when(q.isNotNull(), F.greatest(F.lit(tau) - q, F.lit(0.0)))).alias("shortfall"), F.avg(q).alias("mean_probability")]


def spearman(rows: DataFrame, by: list[str], a: str = "mu", b: str = "value_p") -> DataFrame:
    exact = kept(rows.where(F.col("exact_mask") & F.col(b).isNotNull()).select(*by, a, b))
    ranked = average_rank(average_rank(exact, by, a, "_ra"), by, b, "_rb")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.corr("_ra", "_rb")).alias("spearman"))


def auc(rows: DataFrame, by: list[str], score: str, label: str, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve from rank sums; ties count half. A row counts as many times as its `weight` says."""
    ranked = average_rank(kept(rows.select(*by, score, label, *([weight] if weight else []))), by, score, "_r", weight)
    n = F.col(weight) if weight else F.lit(1).cast("long")
    part = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0).cast("long"))
    pos, neg = part(F.col(label)), part(~F.col(label))
    sums = F.sum(F.when(F.col(label), F.col("_r") * n))
    return ranked.groupBy(*by).agg(pos.alias("n_pos"), neg.alias("n_neg"), F.try_divide(sums - pos * (pos + 1) / 2, pos * neg).alias("auc"))


def tail_mean(rows: DataFrame, by: list[str], column: str, alpha: float) -> DataFrame:
    """CVaR: the 1 - alpha quantile plus the mean excess over it divided by alpha. Works on runs of equal values."""
    runs = saved(value_runs(rows, by, column))
    at = F.lit(1 - alpha) * (F.col("all") - 1)
    pick = lambda r: F.max(F.when((F.col("first") <= r) & (r < F.col("first") + F.col("n")), F.col(column)))
    cut = runs.groupBy(*by, "all").agg(pick(F.floor(at)).alias("_l"), pick(F.ceil(at)).alias("_h"))
    cut = cut.select(*(F.col(c).alias(f"c_{c}") for c in by), (F.col("_l") + (F.col("_h") - F.col("_l")) * (at - F.floor(at))).alias("eta"))
    both = runs.join(cut, reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"c_{c}")), by, F.lit(True)))
    over = F.sum(F.col("n") * F.greatest(F.col(column) - F.col("eta"), F.lit(0.0))) / F.sum("n")
    return both.groupBy(*by, "eta").agg((F.col("eta") + over / alpha).alias("cvar"))


def reduced(rows: DataFrame, constraints: DataFrame, by: list[str], column: str = "d") -> DataFrame:
    """by, constraint, eps, G: each constraint's mean or CVaR of `column` over the rows of its direction.

    `constraints`: constraint, direction, eps, reduction ('mean' or 'cvar'), alpha. A
    constraint without rows has G = 0.
    """
    listed = constraints.collect()  # some constraints of an experiment, not data
    out = None
    for c in listed:
        mine = rows.where(F.col("direction") == c["direction"])
        if c["reduction"] == "cvar":
            g = tail_mean(mine, by, column, c["alpha"]).withColumnRenamed("cvar", "G").drop("eta")
        else:
            g = mine.groupBy(*by).agg(F.avg(column).alias("G"))
        every = rows.select(*by).distinct().join(g, by, "left").select(*by, F.lit(c["constraint"]).alias("constraint"), F.lit(c["eps"]).alias("eps"), F.coalesce("G", F.lit(0.0)).alias("G"))
        out = every if out is None else out.unionByName(every)
    return out


def direction_constraints(rows: DataFrame, eps: float, by: list[str]) -> DataFrame:
    """by, constraint, direction, eps, n: a mean budget for each censoring direction that has rows."""
    found = rows.where("not exact_mask").groupBy(*by, direction().alias("direction")).agg(F.count("*").alias("n"))
    return found.select(*by, F.col("direction").alias("constraint"), "direction", F.lit(eps).alias("eps"), "n")


def score_row(rows: DataFrame, by: list[str], threshold: Column) -> DataFrame:
    """One flat row a cell: acc_, viol_ and dec_ scores, cov90, cov90_width, exceed_ece. `rows`: predictions with mu, sigma; `threshold` may be a column."""
    t = decision_rows(rows, threshold)
    low, high = gaussian_interval()
    renamed = lambda cols, prefix, names: [c.alias(f"{prefix}_{n}") for c, n in zip(cols, names, strict=True)]
    acc = renamed(accuracy(), "acc", ("mae", "rmse", "bias", "n_exact"))
    viol = renamed(violation(), "viol", ("violation_rate", "right_violation_rate", "left_violation_rate", "n_censored"))
    dec = renamed(decisions(), "dec", ("n_resolvable", "n_positive", "false_safe_rate", "false_liability_rate", "balanced_accuracy", "decision_regret"))
    cover = coverage(low, high)
    one = t.groupBy(*by).agg(F.count("*").alias("n_test"), *acc, *viol, *dec, cover[1].alias("cov90"), cover[2].alias("cov90_width"))
    ece = calibration_error(calibration_bins(t, by), by).drop("n").withColumnRenamed("ece", "exceed_ece")
    return one.join(ece, by, "left")


def score_lines(rows: DataFrame, by: list[str], threshold: Column, weight: str, bins: int = 10) -> DataFrame:
    """score_row of rows that count as many times as their `weight` says, all of it from one aggregate by cell and bin of the probability."""
    w, exact, censored = F.col(weight), F.col("exact_mask"), ~F.col("exact_mask")
    low, high = gaussian_interval()
    scored = exact & value().isNotNull()
    e, y, mu = F.when(exact, mean() - value()), F.when(exact, value()), mean()
    out = ((mu < F.col("lower")) | (mu > F.col("upper"))).cast("int")
    sides = {"all": F.lit(True), "right": F.col("upper") == INF, "left": F.col("lower") == -INF}
    t, p = F.col("t"), F.col("p")
    yes, told = p >= 0.5, t.isNotNull()
    parts = {"n_test": w, "n_exact": F.when(scored, w), "mae": w * F.abs(e), "rmse": w * e * e, "bias": w * e, "n_censored": F.when(censored, w)}
    parts |= {f"n_{k}": F.when(censored & c & out.isNotNull(), w) for k, c in sides.items()} | {f"out_{k}": F.when(censored & c, w * out) for k, c in sides.items()}
    parts |= {"n": F.when(told, w), "pos": F.when(t, w), "neg": F.when(~t, w), "fs": F.when(t & ~yes, w), "fl": F.when(~t & yes, w), "regret": w * F.abs(p - t.cast("double")), "sum_p": F.when(told, w * p)}
    parts |= {"inside": w * y.between(low, high).cast("int"), "width": F.when(y.isNotNull(), w * (high - low))}
    bin_ = F.when(told, F.least(F.floor(p * bins), F.lit(bins - 1))).cast("int")
    sums = saved(decision_rows(rows, threshold).groupBy(*by, bin_.alias("bin")).agg(*(F.sum(c).alias(f"_{k}") for k, c in parts.items())))  # bins + 1 rows a cell
    none = {k: F.lit(0).cast("long") for k in ("n_test", "n_exact", "n_censored", "n", "pos", "neg", "fs", "fl")}
    off = F.when(F.col("bin").isNotNull(), F.abs(F.col("_sum_p") - F.coalesce("_pos", F.lit(0))))
    s = sums.groupBy(*by).agg(*(F.coalesce(F.sum(f"_{k}"), none[k]).alias(f"_{k}") if k in none else F.sum(f"_{k}").alias(f"_{k}") for k in parts), F.sum(off).alias("_off"))
    a = lambda k: F.col(f"_{k}")
    over = lambda k, n: F.try_divide(a(k), a(n))
    fs, fl, n = over("fs", "pos"), over("fl", "neg"), a("n")
    made = {"n_test": a("n_test"), **{f"acc_{k}": _at_least(a("n_exact"), 3, c) for k, c in (("mae", over("mae", "n_exact")), ("rmse", F.sqrt(over("rmse", "n_exact"))), ("bias", over("bias", "n_exact")))}, "acc_n_exact": a("n_exact")}
    made |= {"viol_violation_rate": over("out_all", "n_all"), "viol_right_violation_rate": over("out_right", "n_right"), "viol_left_violation_rate": over("out_left", "n_left"), "viol_n_censored": a("n_censored")}
    made |= {"dec_n_resolvable": n, "dec_n_positive": a("pos")}
    guarded = {"false_safe_rate": fs, "false_liability_rate": fl, "balanced_accuracy": F.coalesce((2 - fs - fl) / 2, 1 - fs, 1 - fl), "decision_regret": over("regret", "n")}
    made |= {f"dec_{k}": _at_least(n, 5, c) for k, c in guarded.items()}
    made |= {"cov90": _at_least(a("n_exact"), 10, over("inside", "n_exact")), "cov90_width": _at_least(a("n_exact"), 10, over("width", "n_exact")), "exceed_ece": _at_least(n, 20, over("off", "n"))}
    return s.select(*by, *(c.alias(k) for k, c in made.items()))
