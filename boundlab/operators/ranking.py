"""Ranks and order statistics of large groups, without a window over a whole group.

A group is cut into buckets that follow each other in the wanted order. Counts
by bucket (few rows a group) give each bucket its offset; windows run inside
buckets alone. Hash orders take a prefix of the hash as bucket, value orders the
ranges between approximate quantiles. The sketch decides sizes of buckets only,
so results are exact. Equal values are counted before they are ranked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boundlab.session import kept, small

PARTS = 64


def _keyed(by: list[str], prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}{c}") for c in by]


def _same(by: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return out


def offsets(counts: DataFrame, by: list[str], bucket: str, n: str) -> DataFrame:
    """o_<by>, o_<bucket>, before, all from counts by bucket: a window over some dozens or thousands of small rows a group."""
    order = Window.partitionBy(*by).orderBy(bucket)
    before = F.coalesce(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return counts.select(*_keyed(by, "o_"), F.col(bucket).alias(f"o_{bucket}"), before.alias("before"), F.sum(n).over(Window.partitionBy(*by)).alias("all"))


def hash_ranked(rows: DataFrame, by: list[str], turn: Column, tie: list[str], prefix: int = 2) -> DataFrame:
    """rows with `place` (from 0) in the order of `turn` (a hex hash) and `tie` inside its group, and `all`, the group's rows."""
    turned = rows.withColumn("_turn", turn).withColumn("_lot", F.substring("_turn", 1, prefix))
    marks = offsets(turned.groupBy(*by, "_lot").agg(F.count("*").alias("_n")), by, "_lot", "_n")
    inside = Window.partitionBy(*by, "_lot").orderBy("_turn", *tie)
    ranked = turned.withColumn("_in", F.row_number().over(inside))
    both = ranked.join(marks, _same([*by, "_lot"], "o_"))
    return both.withColumn("place", F.col("before") + F.col("_in") - 1).drop("_turn", "_lot", "_in", "before", "o__lot", *(f"o_{c}" for c in by))


def tile(place: Column, all_: Column, k: int) -> Column:
    """The lot, from 0, of a place when `all_` places are dealt into k lots, the first all_ % k of them one larger."""
    small, more = F.floor(all_ / k), all_ % k
    wide = (small + 1) * more
    return F.when(place < wide, F.floor(place / (small + 1))).otherwise(more + F.floor((place - wide) / F.greatest(small, F.lit(1)))).cast("int")


def value_runs(rows: DataFrame, by: list[str], value: str, parts: int = PARTS, weight: str | None = None) -> DataFrame:
    """by, value, n (rows that hold it), first (rows below it), all (the group's rows); null values take no part.

    A row counts as many times as its `weight` says. Values are counted once and
    written, so what `rows` takes to compute is paid once.
    """
    counts = kept(rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("n")))
    cuts = counts.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(1000))).alias("_cuts"))
    cut = counts.join(cuts.select(*_keyed(by, "c_"), "_cuts"), _same(by, "c_")).drop(*(f"c_{c}" for c in by))
    cut = cut.withColumn("_b", F.size(F.filter("_cuts", lambda x: x < F.col(value)))).drop("_cuts")
    marks = offsets(cut.groupBy(*by, "_b").agg(F.sum("n").alias("_n")), by, "_b", "_n")
    inside = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    both = cut.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(marks, _same([*by, "_b"], "o_"))
    return both.select(*by, value, "n", (F.col("before") + F.col("_in")).alias("first"), "all")


def at_ranks(rows: DataFrame, by: list[str], value: str, wanted: dict[str, Callable[[Column], Column]], weight: str | None = None) -> DataFrame:
    """by, all, and for each name the value of rank wanted[name](all), counted from 0."""
    runs, all_ = value_runs(rows, by, value, weight=weight), F.col("all")
    pick = lambda k: F.max(F.when((F.col("first") <= k(all_)) & (k(all_) < F.col("first") + F.col("n")), F.col(value)))
    return runs.groupBy(*by, "all").agg(*(pick(k).alias(name) for name, k in wanted.items()))


def quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float], weight: str | None = None) -> DataFrame:
    """by, all, and for each name the quantile with linear interpolation between neighbours."""
    at = lambda q: (lambda n: F.lit(q) * (n - 1))
    ends = {}
    for name, q in wanted.items():
        ends[f"_l_{name}"] = lambda n, q=q: F.floor(at(q)(n))
        ends[f"_h_{name}"] = lambda n, q=q: F.ceil(at(q)(n))
    found = at_ranks(rows, by, value, ends, weight)
    part = lambda q: at(q)(F.col("all")) - F.floor(at(q)(F.col("all")))
    return found.select(*by, "all", *((F.col(f"_l_{n}") + (F.col(f"_h_{n}") - F.col(f"_l_{n}")) * part(q)).alias(n) for n, q in wanted.items()))


def average_rank(rows: DataFrame, by: list[str], value: str, name: str, weight: str | None = None) -> DataFrame:
    """Adds ranks from 1; equal values share the mean of theirs. Rows without a value go."""
    runs = value_runs(rows, by, value, weight=weight).select(*_keyed([*by, value], "r_"), (F.col("first") + (F.col("n") + 1) / 2).alias(name))
    return rows.join(small(kept(runs)), _same(by, "r_") & (F.col(value) == F.col(f"r_{value}"))).drop(*(f"r_{c}" for c in (*by, value)))
