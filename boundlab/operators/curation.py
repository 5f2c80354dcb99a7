"""From single measurements to endpoint rows: filters, interval intersection, duplicates, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boundlab.operators.ranking import hash_ranked, quantiles
from boundlab.session import saved, small

INF = float("inf")


def record_filter(rows: DataFrame, low: float = 0.0, high: float = 14.0) -> DataFrame:
    """Positive concentrations with a p value in range and a known class."""
    classes = ["exact", "left_censored_p", "right_censored_p", "interval_censored_p"]
    return rows.where((F.col("conc") > 0) & F.col("p_true").between(low, high) & F.col("censoring_class").isin(classes))


def relation_bounds(p: F.Column, relation: F.Column) -> tuple[F.Column, F.Column]:
    """Relations on the p scale as bounds: > and >= open the top, < and <= the bottom, = is a point."""
    lower = F.when(relation.isin("<", "<="), -INF).otherwise(p)
    upper = F.when(relation.isin(">", ">="), INF).otherwise(p)
    return lower, upper


def aggregated(rows: DataFrame, key: list[str]) -> DataFrame:
    """A row for each key: median of exact values, intersection of bounds, counts, and what becomes of duplicates.

    resolution: 'single', 'high_confidence' (exact range <= 0.5), 'strict' (<= 1),
    'broad' (<= 2), 'discordant' beyond, 'contradiction' if the bounds don't
    meet or the median lies outside them.
    """
    exact = F.when(F.col("exact_mask"), F.col("value_p"))
    low, high = (F.when(~F.col("exact_mask"), F.col(c)) for c in ("lower", "upper"))
    one = rows.groupBy(*key).agg(
        F.count("*").alias("n_measurements"),
        F.count(exact).alias("n_exact"),
        F.median(exact).alias("median_p"),
        (F.max(exact) - F.min(exact)).alias("exact_range"),
        F.max(low).alias("bound_low"),
        F.min(high).alias("bound_high"),
        F.size(F.collect_set("assay_id")).cast("long").alias("n_assays"),  # the set is held for the list below; a second DISTINCT would triple the rows
        F.array_join(F.array_sort(F.collect_set("assay_id")), ";").alias("assay_ids"),
        F.count_distinct("document_id").alias("n_documents"),
        *([F.min("year").alias("min_year"), F.max("year").alias("max_year")] if "year" in rows.columns else []),
    )
    clash = (F.col("bound_low") > F.col("bound_high")) | (F.col("median_p") < F.col("bound_low")) | (F.col("median_p") > F.col("bound_high"))
    how = (
        F.when(F.coalesce(clash, F.lit(False)), "contradiction")
        .when(F.col("n_measurements") == 1, "single")
        .when(F.coalesce("exact_range", F.lit(0.0)) <= 0.5, "high_confidence")
        .when(F.col("exact_range") <= 1.0, "strict")
        .when(F.col("exact_range") <= 2.0, "broad")
        .otherwise("discordant")
    )
    one = one.withColumn("resolution", how)
    one = one.withColumns({"lower": F.coalesce("median_p", "bound_low"), "upper": F.coalesce("median_p", "bound_high")})
    return one.withColumn("row_id", F.sha2(F.concat_ws("|", *key), 256)).drop("bound_low", "bound_high")


def duplicate_summary(groups: DataFrame) -> DataFrame:
    """Per endpoint: groups by number of measurements and by how they agree."""
    n = F.col("n_measurements")
    between = lambda a, b: F.count_if((F.col("exact_range") > a) & (F.col("exact_range") <= b))
    return groups.groupBy("endpoint").agg(
        F.count_if(n == 1).alias("n_single"), F.count_if(n == 2).alias("n_double"), F.count_if(n >= 3).alias("n_more"), F.count_if((n > 1) & (F.coalesce("exact_range", F.lit(0.0)) <= 0.5)).alias("n_consistent"),
        between(0.5, 1.0).alias("n_discordant_1"), between(1.0, 2.0).alias("n_discordant_2"), F.count_if(F.col("exact_range") > 2).alias("n_discordant_more"), F.count_if(F.col("resolution") == "contradiction").alias("n_contradiction"),
    )


def curation_summary(groups: DataFrame) -> DataFrame:
    ok = F.col("resolution") != "contradiction"
    groups = saved(groups.select("endpoint", "resolution", "exact_range", F.col("n_measurements").cast("double").alias("n_measurements")))
    one = groups.groupBy("endpoint").agg(F.sum("n_measurements").cast("long").alias("n_input"), F.count("*").alias("n_groups"), F.count_if(ok).alias("n_final"), F.count_if(~ok).alias("n_quarantined"), F.max("exact_range").alias("max_exact_range"))
    for column, name in (("n_measurements", "median_group"), ("exact_range", "median_exact_range")):
        one = one.join(quantiles(groups, ["endpoint"], column, {name: 0.5}).drop("all"), "endpoint", "left")
    return one


def endpoint_audit(rows: DataFrame, least_rows: int = 100) -> DataFrame:
    """Per endpoint: rows, shares by class, median, what relations, units and flags occur, how many different parts, and the gate."""
    used = ("endpoint", "censoring_class", "source_name", "relation", "unit", "validity", "compound_id", "scaffold", "assay_id", "document_id", "value_p")
    rows, n = saved(rows.select(*(c for c in used if c in rows.columns))), F.count("*")  # read once, then five aggregates and a median
    part = lambda c: 100.0 * F.count_if(F.col("censoring_class") == c) / n
    seen = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";") if c in rows.columns else F.lit("")
    one = rows.groupBy("endpoint").agg(
        n.alias("n"), part("exact").alias("pct_exact"), part("left_censored_p").alias("pct_left"), part("right_censored_p").alias("pct_right"), part("interval_censored_p").alias("pct_interval"),
        seen("source_name").alias("sources"), seen("relation").alias("relations"), seen("unit").alias("units"), seen("validity").alias("flags"), (n >= least_rows).alias("pass_gate"),
    )
    for c in ("compound_id", "scaffold", "assay_id", "document_id"):  # one shuffle by (endpoint, id) each: no set of ids is held together
        one = one.join(rows.groupBy("endpoint", c).count().groupBy("endpoint").agg(F.count(c).alias(f"n_{c.removesuffix('_id')}s")), "endpoint")
    return one.join(quantiles(rows, ["endpoint"], "value_p", {"median_p": 0.5}).drop("all"), "endpoint", "left")


def endpoint_manifest(rows: DataFrame, least_rows: int = 100) -> DataFrame:
    """Per endpoint: rows and classes, censored share, different compounds, scaffolds, assays and documents, years, a hash of the content, and the gate."""
    rows = saved(rows.select("endpoint", "row_id", "censoring_class", "year", "compound_id", "scaffold", "assay_id", "document_id"))
    n, cens = F.count("*"), F.count_if(F.col("censoring_class") != "exact")
    of = lambda c: F.count_if(F.col("censoring_class") == c)
    content = F.conv(F.substring(F.md5(F.concat_ws("|", "row_id", "censoring_class").cast("binary")), 1, 8), 16, 10).cast("long")
    one = rows.groupBy("endpoint").agg(
        n.alias("n_rows"), of("exact").alias("n_exact"), cens.alias("n_censored"), of("left_censored_p").alias("n_left"), of("right_censored_p").alias("n_right"), of("interval_censored_p").alias("n_interval"), (cens / n).alias("censored_share"),
        F.min("year").alias("earliest_year"), F.max("year").alias("latest_year"), (F.count("year") / n).alias("with_year"), F.bit_xor(content).alias("content_hash"), (n >= least_rows).alias("pass_gate"),
    )
    for c in ("compound_id", "scaffold", "assay_id", "document_id"):
        one = one.join(rows.groupBy("endpoint", c).count().groupBy("endpoint").agg(F.count(c).alias(f"n_{c.removesuffix('_id')}s")), "endpoint")
    return one


#: Fixed values of the curation rules.
RELATIONS = ("=", "<", "<=", ">", ">=")
VALIDITY = {"strict": ("Manually validated",), "broad": ("Manually validated", "Outside typical range")}
CONFIDENCE = {"strict": 9, "broad": 7}
CONFLICTS = ("inactive", "not active", "inconclusive", "non-toxic", "toxic", "active")


def records(rows: DataFrame, mode: str, units: list[str], organism: str) -> DataFrame:
    """Records that a strict or a broad reading accepts.

    Known relation and unit, positive value, p from 0 to 14, single protein of
    `organism`, confidence, no validity comment or an allowed one; strict also
    drops potential duplicates. A null in a required field fails.
    """
    ok = F.col("relation").isin(*RELATIONS) & F.col("unit").isin(*units) & (F.col("conc") > 0) & F.col("p_true").between(0, 14)
    ok = ok & (F.col("target_type") == "SINGLE PROTEIN") & (F.col("organism") == organism) & (F.col("confidence") >= CONFIDENCE[mode])
    ok = ok & (F.col("validity").isNull() | F.col("validity").isin(*VALIDITY[mode]))
    if mode == "strict":
        ok = ok & (F.coalesce(F.col("potential_duplicate"), F.lit(0)) == 0)
    return rows.where(ok)


def structures(rows: DataFrame) -> DataFrame:
    """rows with `structure` (the parent's, else the compound's own) and `structure_fault`: missing, mixture, inorganic, too_small, too_large or null."""
    structure = F.coalesce("parent_structure", "child_structure")
    fault = F.when(structure.isNull(), "missing").when(F.contains(structure, F.lit(".")), "mixture").when(~F.coalesce(F.col("organic"), F.lit(False)), "inorganic")
    fault = fault.when(F.col("heavy_atoms") < 5, "too_small").when((F.col("heavy_atoms") > 120) | (F.col("weight") > 1200), "too_large")
    return rows.withColumns({"structure": structure, "structure_fault": fault, "parent_used": F.col("parent_structure").isNotNull()})


def structure_summary(rows: DataFrame) -> DataFrame:
    """One row of totals over the result of `structures`."""
    names = ("missing", "mixture", "inorganic", "too_small", "too_large")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("structure_fault").isNull()).alias("n_valid"), F.count_if("parent_used").alias("n_parent"), F.count_if(~F.col("parent_used") & F.col("structure").isNotNull()).alias("n_child"), F.count_if(F.col("scaffold").isNull()).alias("n_no_scaffold"), *(F.count_if(F.col("structure_fault") == c).alias(f"n_{c}") for c in names))


def comment_action(comment: F.Column, mode: str) -> F.Column:
    """keep, flag or quarantine. Comments never make labels: a conflicting term quarantines a strict row and flags a broad one, any other comment flags."""
    clash = F.lower(comment).rlike(r"\b(" + "|".join(sorted(CONFLICTS, key=len, reverse=True)) + r")\b")
    return F.when(comment.isNull() | (F.trim(comment) == ""), "keep").when(clash, "quarantine" if mode == "strict" else "flag").otherwise("flag")


def group_action(resolution: F.Column, mode: str) -> F.Column:
    """What becomes of a group's duplicates: contradictions and too wide ranges are quarantined, in the broad reading kept with a flag where some rows agree."""
    if mode == "strict":
        return F.when(resolution.isin("contradiction", "broad", "discordant"), "quarantine").otherwise("keep")
    return F.when(resolution == "discordant", "quarantine").when(resolution == "contradiction", F.when(F.col("n_measurements") > 1, "flag").otherwise("quarantine")).otherwise("keep")


def assay_vocabulary(rows: DataFrame, train: F.Column, key: str = "assay_id", least: int = 1) -> DataFrame:
    """key, n, idx: dense ids from 1 over keys of training rows, commonest first, equally common ones by hash; others look up 0."""
    name = F.col(key)
    counts = saved(rows.where(train & name.isNotNull() & ~name.isin("", "nan", "None")).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least))
    ranked = hash_ranked(counts, ["n"], F.md5(name.cast("binary")), [key])
    sizes = counts.groupBy("n").agg(F.count("*").alias("_k"))
    commoner = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each different count
    sizes = sizes.select(F.col("n").alias("_n"), F.coalesce(F.sum("_k").over(commoner), F.lit(0)).alias("_ahead"))
    return ranked.join(F.broadcast(sizes), F.col("n") == F.col("_n")).select(key, "n", (F.col("_ahead") + F.col("place") + 1).cast("int").alias("idx"))


def vocabulary_index(rows: DataFrame, vocabulary: DataFrame, key: str = "assay_id", name: str = "assay_idx") -> DataFrame:
    """rows with the key's number, 0 for keys that weren't trained on."""
    known = vocabulary.select(F.col(key).alias("_vk"), F.col("idx").alias("_vi"))
    return rows.join(small(known), F.col(key) == F.col("_vk"), "left").withColumn(name, F.coalesce("_vi", F.lit(0))).drop("_vk", "_vi")
