"""Interval-labelled observations, and a fixture that derives them from star-schema tables.

Canonical columns: row_id, endpoint, assay_id, document_id, source_name,
scaffold, compound_id, conc, censoring_class, p_true, lower, upper, exact_mask,
value_p. Open bounds are IEEE infinities; a missing value is NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture: prices stand for concentrations, suppliers for assays with limits of their own."""
    return observed(raw_rows(spark, sf_dir))


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fixture's rows are made of, in the tables' own columns: a fraction of their width."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    items = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_tax", F.col("l_extendedprice").cast("double").alias("conc"))
    rows = items.join(read("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    # one table after the other: Spark takes a join's size to be the product of its sides' and would shuffle all items for a join with suppliers' places
    rows = rows.join(read("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(read("nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.join(read("region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.drop("p_partkey", "s_suppkey", "s_nationkey", "n_nationkey", "n_regionkey", "r_regionkey")


def raw_id() -> F.Column:
    return F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def observed(rows: DataFrame) -> DataFrame:
    """raw_rows as observations."""
    high, low = 70000 + 300 * (F.col("l_suppkey") % 100), 2000 + 100 * (F.col("l_suppkey") % 50)
    kind = F.when(F.col("conc") >= high, "left_censored_p").when(F.col("conc") <= low, "right_censored_p").when(F.col("l_tax").cast("double") == 0.08, "interval_censored_p").otherwise("exact")
    p = lambda c: 9 - F.log10(c.cast("double"))
    rows = rows.select(
        raw_id().alias("row_id"),
        F.concat_ws("_", "l_returnflag", "l_linestatus").alias("endpoint"),
        F.col("l_suppkey").cast("string").alias("assay_id"),
        F.col("l_orderkey").cast("string").alias("document_id"),
        F.col("r_name").alias("source_name"),
        F.col("p_brand").alias("scaffold"),
        F.col("l_partkey").cast("string").alias("compound_id"),
        "conc",
        kind.alias("censoring_class"),
        p(F.col("conc")).alias("p_true"),
        p(low).alias("p_low"),
        p(high).alias("p_high"),
    )
    half = F.when(F.col("censoring_class") == "interval_censored_p", 0.1).otherwise(0.0)
    raw = rows.withColumns({
        "lower": F.when(F.col("censoring_class") == "right_censored_p", F.col("p_low")).otherwise(F.col("p_true") - half),
        "upper": F.when(F.col("censoring_class") == "left_censored_p", F.col("p_high")).otherwise(F.col("p_true") + half),
    })
    clean = sanitised(raw.drop("p_low", "p_high"))
    return clean.withColumn("value_p", F.when(F.col("exact_mask"), F.col("p_true")))


def sanitised(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Opens the censored side of each bound and marks exact rows: finite and equal, within a tolerance unless `strict`.

    A column exact_mask that the rows bring wins where it isn't null.
    """
    inf = F.lit(float("inf"))
    name = F.when(F.col("censoring_class") == "interval", "interval_censored_p").otherwise(F.col("censoring_class"))
    lower = F.when(name == "left_censored_p", -inf).otherwise(F.nanvl("lower", F.lit(None).cast("double")))
    upper = F.when(name == "right_censored_p", inf).otherwise(F.nanvl("upper", F.lit(None).cast("double")))
    near = F.col("lower") == F.col("upper") if strict else F.abs(F.col("lower") - F.col("upper")) <= 1e-8 + 1e-5 * F.abs("upper")
    finite = (F.abs("lower") < inf) & (F.abs("upper") < inf)
    rows = rows.withColumns({"censoring_class": name, "lower": lower, "upper": upper})
    given = F.col("exact_mask") if "exact_mask" in rows.columns else F.lit(None).cast("boolean")
    rows = rows.withColumn("exact_mask", F.coalesce(given, (F.col("censoring_class") == "exact") & finite & near, F.lit(False)))
    return rows.withColumn("lower", F.when(F.col("exact_mask"), F.col("upper")).otherwise(F.col("lower")))


def direction() -> F.Column:
    """exact, right, left or interval, in this precedence."""
    inf = F.lit(float("inf"))
    return F.when(F.col("exact_mask"), "exact").when(F.col("upper") == inf, "right").when(F.col("lower") == -inf, "left").otherwise("interval")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture as a raw measurement table: what loaders and curation rules read, with faults that a hash of the row decides."""
    return measured(observations(spark, sf_dir))


def measured(rows: DataFrame) -> DataFrame:
    """Observations as raw measurements."""
    h = F.conv(F.substring(F.md5(F.col("row_id").cast("binary")), 1, 8), 16, 10).cast("long")
    kind, pick = F.col("censoring_class"), lambda n, *cases: _cases(F.col("h") % n, cases)
    rows = rows.withColumn("h", h)
    child = F.concat(F.lit("C"), F.col("compound_id"))
    return rows.select(
        F.col("row_id").alias("activity_id"), F.substring("endpoint", 1, 1).alias("target_key"), F.substring("endpoint", 3, 1).alias("standard_type"), pick(3, "B", "F").alias("assay_type"), (F.col("h") % 10 != 0).alias("core_clean"),
        F.when(F.col("h") % 7 != 0, F.when(F.col("h") % 31 == 0, F.concat(child, F.lit(".Cl"))).otherwise(child)).alias("parent_structure"), F.when(F.col("h") % 77 != 0, child).alias("child_structure"),
        kind.alias("censoring_class"), F.when(kind == "left_censored_p", F.col("upper") - 1).otherwise(F.col("lower")).alias("lower_bound_p"), F.when(kind == "right_censored_p", F.col("lower") + 1).otherwise(F.col("upper")).alias("upper_bound_p"),
        "assay_id", "document_id", "source_name", F.when(F.col("h") % 11 != 0, 1990 + F.col("h") % 30).alias("document_year"), (7 + F.col("h") % 3).alias("confidence_score"),
        F.when(kind == "left_censored_p", pick(2, "<", "<=")).when(kind == "right_censored_p", pick(2, ">", ">=")).when(F.col("h") % 50 == 0, F.lit("~")).otherwise(F.lit("=")).alias("standard_relation"),
        pick(9, "uM", "nM").alias("unit"), pick(8, None, "Manually validated", "Outside typical range", "Potential missing data", None).alias("validity"), pick(12, "Not Active", "see paper", "highly active", None).alias("comment"),
        (F.col("h") % 13 == 0).cast("int").alias("potential_duplicate"), (F.col("h") % 140).alias("heavy_atoms"), (F.col("h") % 1400).cast("double").alias("weight"), (F.col("h") % 97 != 0).alias("organic"),
        F.lit("SINGLE PROTEIN").alias("target_type"), pick(6, "Mus musculus", "Homo sapiens").alias("organism"), F.col("value_p").alias("p_value"), "p_true", "conc", "endpoint", "scaffold", "compound_id",
    )


def _cases(n: F.Column, cases: tuple) -> F.Column:
    """cases[n], the last one from there on."""
    out = F.lit(cases[-1]).cast("string")
    for i in reversed(range(len(cases) - 1)):
        out = F.when(n == i, F.lit(cases[i]).cast("string")).otherwise(out)
    return out


#: The fixture in DuckDB's words, written on its own; each oracle begins with it.
OBS_SQL = """WITH obs AS (
  SELECT *, 9 - log10(conc) AS p_true,
    CASE class_ WHEN 'left_censored_p' THEN '-inf'::DOUBLE WHEN 'right_censored_p' THEN 9 - log10(lo_cut) WHEN 'interval_censored_p' THEN 9 - log10(conc) - 0.1 ELSE 9 - log10(conc) END AS lower,
    CASE class_ WHEN 'right_censored_p' THEN 'inf'::DOUBLE WHEN 'left_censored_p' THEN 9 - log10(hi_cut) WHEN 'interval_censored_p' THEN 9 - log10(conc) + 0.1 ELSE 9 - log10(conc) END AS upper,
    class_ AS censoring_class, class_ = 'exact' AS exact_mask, CASE WHEN class_ = 'exact' THEN 9 - log10(conc) END AS value_p
  FROM (
    SELECT *, CASE WHEN conc >= hi_cut THEN 'left_censored_p' WHEN conc <= lo_cut THEN 'right_censored_p' WHEN tax = 0.08 THEN 'interval_censored_p' ELSE 'exact' END AS class_
    FROM (
      SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id, l_returnflag || '_' || l_linestatus AS endpoint,
        CAST(l_suppkey AS VARCHAR) AS assay_id, CAST(l_orderkey AS VARCHAR) AS document_id, r_name AS source_name, p_brand AS scaffold,
        CAST(l_partkey AS VARCHAR) AS compound_id, CAST(l_extendedprice AS DOUBLE) AS conc, CAST(l_tax AS DOUBLE) AS tax,
        CAST(70000 + 300 * (l_suppkey % 100) AS DOUBLE) AS hi_cut, CAST(2000 + 100 * (l_suppkey % 50) AS DOUBLE) AS lo_cut
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    )
  )
)"""

MEAS_SQL = OBS_SQL + """, hashed AS (SELECT *, ('0x' || substr(md5(row_id), 1, 8))::BIGINT AS h FROM obs),
meas AS (SELECT row_id AS activity_id, substr(endpoint, 1, 1) AS target_key, substr(endpoint, 3, 1) AS standard_type, CASE h % 3 WHEN 0 THEN 'B' ELSE 'F' END AS assay_type, h % 10 <> 0 AS core_clean,
  CASE WHEN h % 7 <> 0 THEN 'C' || compound_id || CASE WHEN h % 31 = 0 THEN '.Cl' ELSE '' END END AS parent_structure, CASE WHEN h % 77 <> 0 THEN 'C' || compound_id END AS child_structure,
  censoring_class, lower, upper, exact_mask, assay_id, document_id, source_name, CASE WHEN h % 11 <> 0 THEN 1990 + h % 30 END AS document_year, 7 + h % 3 AS confidence_score,
  CASE censoring_class WHEN 'left_censored_p' THEN CASE h % 2 WHEN 0 THEN '<' ELSE '<=' END WHEN 'right_censored_p' THEN CASE h % 2 WHEN 0 THEN '>' ELSE '>=' END ELSE CASE WHEN h % 50 = 0 THEN '~' ELSE '=' END END AS standard_relation,
  CASE h % 9 WHEN 0 THEN 'uM' ELSE 'nM' END AS unit, CASE h % 8 WHEN 1 THEN 'Manually validated' WHEN 2 THEN 'Outside typical range' WHEN 3 THEN 'Potential missing data' END AS validity,
  CASE h % 12 WHEN 0 THEN 'Not Active' WHEN 1 THEN 'see paper' WHEN 2 THEN 'highly active' END AS comment, CAST(h % 13 = 0 AS INTEGER) AS potential_duplicate, h % 140 AS heavy_atoms, CAST(h % 1400 AS DOUBLE) AS weight, h % 97 <> 0 AS organic,
  CASE h % 6 WHEN 0 THEN 'Mus musculus' ELSE 'Homo sapiens' END AS organism, value_p AS p_value, p_true, conc, endpoint, scaffold, compound_id, h FROM hashed)"""
