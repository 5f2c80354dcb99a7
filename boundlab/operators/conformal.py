"""Split and group-conditional conformal calibration of Gaussian predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundlab.functions.distributions import Z90
from boundlab.operators.metrics import coverage, mean, scale, value
from boundlab.operators.ranking import at_ranks
from boundlab.operators.splits import calibration_slice
from boundlab.session import kept, saved, small


def quantiles(calibration: DataFrame, by: list[str], alpha: float = 0.1, least: int = 10) -> DataFrame:
    """by, n, q: the score of rank min(k + 1, n), k = ceil((n + 1)(1 - alpha)), of exact calibration rows."""
    scores = calibration.where("exact_mask and value_p is not null").withColumn("_s", F.abs(value() - mean()) / scale())
    rank = lambda n: F.least(F.ceil((n + 1.0) * (1 - alpha)), n - 1)  # noqa: E731  from 0
    return at_ranks(scores, by, "_s", {"q": rank}).where(F.col("all") >= least).select(*by, F.col("all").alias("n"), "q")


def split_conformal(rows: DataFrame, by: list[str], alpha: float = 0.1) -> DataFrame:
    """Coverage on rows with calibration = false, by `by`; groups too small to calibrate use the normal quantile."""
    rows = kept(rows.drop("row_id") if "row_id" in rows.columns else rows)
    q = small(saved(quantiles(rows.where("calibration"), by, alpha).drop("n")))
    both = rows.where("not calibration").join(q, by, "left").withColumn("q", F.coalesce("q", F.lit(Z90)))
    return both.groupBy(*by, "q").agg(*coverage(mean() - F.col("q") * scale(), mean() + F.col("q") * scale(), alpha))


def mondrian_conformal(rows: DataFrame, by: list[str], group: str, alpha: float = 0.1) -> DataFrame:
    """As split_conformal with a quantile for each group, then the one over all groups, then the normal one."""
    rows = kept(rows.drop("row_id") if "row_id" in rows.columns else rows)
    calibration = rows.where("calibration")
    own = small(saved(quantiles(calibration, [*by, group], alpha).select(*by, group, F.col("q").alias("q_own"))))
    wide = small(saved(quantiles(calibration, by, alpha).select(*by, F.col("q").alias("q_all"))))
    both = rows.where("not calibration").join(own, [*by, group], "left").join(wide, by, "left")
    both = both.withColumn("q", F.coalesce("q_own", "q_all", F.lit(Z90)))
    return both.groupBy(*by).agg(*coverage(mean() - F.col("q") * scale(), mean() + F.col("q") * scale(), alpha), F.count_distinct(group).alias("n_groups"))


def study(pred: DataFrame, by: list[str], group: str, seeds: tuple[int, ...], alpha: float = 0.1) -> DataFrame:
    """seed, by, method, coverage, width, interval_score: raw, split and group-conditional intervals on what each seed's calibration slice leaves."""
    out = None
    for seed in seeds:
        rows = kept(calibration_slice(pred, seed=seed).drop("row_id"))
        test = rows.where("not calibration")
        raw = test.groupBy(*by).agg(*coverage(mean() - Z90 * scale(), mean() + Z90 * scale(), alpha))
        for method, made in (("raw", raw), ("split", split_conformal(rows, by, alpha)), ("mondrian", mondrian_conformal(rows, by, group, alpha))):
            made = made.select(F.lit(seed).alias("seed"), *by, F.lit(method).alias("method"), "n_exact", "coverage", "width", "interval_score")
            out = made if out is None else out.unionByName(made)
    return out
