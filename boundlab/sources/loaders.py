"""Readers of endpoint, measurement and property tables, configurations and result files.

Each reader returns the canonical columns of boundlab.sources.observations plus
what the table has of year, confidence, relation and the like. Filters are
column predicates, so Parquet readers skip what doesn't match.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boundlab.sources.observations import sanitised

CLASSES = ("exact", "left_censored_p", "right_censored_p", "interval_censored_p")


@dataclass
class Config:
    """Where tables lie and what an experiment runs; BOUNDLAB_DATA and BOUNDLAB_CACHE override the folders."""

    data: str = "data"
    cache: str = "cache"
    folds: int = 5
    split_seed: int = 0
    seeds: list[int] = field(default_factory=lambda: [0])
    splits: list[str] = field(default_factory=lambda: ["random"])
    budgets: list[float] = field(default_factory=lambda: [0.05])
    endpoints: list[str] = field(default_factory=list)
    tau: float = 0.85

    def __post_init__(self):
        self.data, self.cache = os.environ.get("BOUNDLAB_DATA", self.data), os.environ.get("BOUNDLAB_CACHE", self.cache)


def read_config(spark: SparkSession, path: str) -> Config:
    """A JSON object from any file system that Spark reads; unknown keys are errors."""
    text = spark.read.text(path, wholetext=True).first()  # one small file
    found = json.loads(text[0]) if text else {}
    unknown = set(found) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Config(**found)


def first_of(ids: Column) -> Column:
    """The first of a list of ids that `;` or `,` part, trimmed."""
    return F.trim(F.get(F.split(ids, "[;,]"), F.lit(0)))


def _clean(rows: DataFrame, names: dict[str, Column], optional: dict[str, str]) -> DataFrame:
    have = {k: F.col(c) for k, c in optional.items() if c in rows.columns}
    out = sanitised(rows.select(*(c.alias(k) for k, c in (names | have).items())))
    return out.withColumn("value_p", F.nanvl(F.col("value_p").cast("double"), F.lit(None).cast("double")))


def endpoint_rows(rows: DataFrame, endpoint: str | None = None) -> DataFrame:
    """Rows aggregated by compound: the primary assay and document are the first of their lists. `endpoint` names the table, else its own column does."""
    names = {
        "row_id": F.col("row_id").cast("string"), "endpoint": F.lit(endpoint) if endpoint else F.col("endpoint_id"), "assay_id": first_of(F.col("assay_ids")), "document_id": first_of(F.col("document_ids")),
        "compound_id": F.col("structure"), "censoring_class": F.col("censoring_class"), "lower": F.col("lower_bound_p").cast("double"), "upper": F.col("upper_bound_p").cast("double"), "value_p": F.col("value_p"),
    }
    return _clean(rows, names, {"scaffold": "scaffold", "year": "year", "n_assays": "n_assays", "n_documents": "n_documents"})


def measurement_rows(rows: DataFrame, target: str, kind: str, assay_type: str | None = None, clean: bool = True) -> DataFrame:
    """Single measurements of one target and kind: every predicate must hold. The endpoint is target_kind, or target_kind_type."""
    ok = (F.col("target_key") == target) & (F.col("standard_type") == kind)
    if assay_type is not None:
        ok = ok & (F.col("assay_type") == assay_type)
    if clean and "core_clean" in rows.columns:
        ok = ok & F.col("core_clean").cast("boolean")
    structure = F.col("parent_structure" if "parent_structure" in rows.columns else "structure")
    ok = ok & structure.isNotNull() & F.col("censoring_class").isin(*CLASSES)
    names = {
        "row_id": F.col("activity_id").cast("string"), "endpoint": F.lit("_".join(x for x in (target, kind, assay_type) if x)), "assay_id": F.col("assay_id"), "document_id": F.col("document_id"), "source_name": F.col("source_name"),
        "compound_id": structure, "censoring_class": F.col("censoring_class"), "lower": F.col("lower_bound_p").cast("double"), "upper": F.col("upper_bound_p").cast("double"), "value_p": F.col("p_value"),
    }
    return _clean(rows.where(ok), names, {"year": "document_year", "confidence": "confidence_score", "assay_type": "assay_type", "relation": "standard_relation"})


def property_rows(rows: DataFrame, endpoint: str) -> DataFrame:
    """Single measurements of a property table; rows without a structure go, a description column comes along if there is one."""
    names = {
        "row_id": F.col("activity_id").cast("string"), "endpoint": F.lit(endpoint), "assay_id": F.col("assay_id"), "document_id": F.col("document_id"), "source_name": F.col("source_name"),
        "compound_id": F.col("structure"), "censoring_class": F.col("censoring_class"), "lower": F.col("lower_bound_p").cast("double"), "upper": F.col("upper_bound_p").cast("double"), "value_p": F.col("value_p"),
    }
    return _clean(rows.where(F.col("structure").isNotNull()), names, {"year": "document_year", "confidence": "confidence_score", "assay_type": "assay_type", "relation": "standard_relation", "assay_description": "assay_description"})


def endpoint_table(spark: SparkSession, config: Config, endpoint: str) -> DataFrame:
    return endpoint_rows(spark.read.parquet(f"{config.data}/endpoints/{endpoint}.parquet"), endpoint)


def measurement_table(spark: SparkSession, config: Config, target: str, kind: str, **more) -> DataFrame:
    """From the one table of all measurements. Laid out by (target_key, standard_type) it is read by partition; Spark shares nothing between calls, so persist what several use."""
    return measurement_rows(spark.read.parquet(f"{config.data}/measurements.parquet"), target, kind, **more)


def property_table(spark: SparkSession, config: Config, endpoint: str) -> DataFrame:
    return property_rows(spark.read.parquet(f"{config.data}/properties/{endpoint}.parquet"), endpoint)


def result_files(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of all CSV files that `path` (with wildcards) names, with their header's columns; unless strict, unreadable files and rows are skipped."""
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    reader = reader.option("mode", "FAILFAST") if strict else reader.option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True)
    return reader.csv(path)


def row_label(rows: DataFrame) -> Column:
    """row_id, else activity_id, as text; tables with neither have no identity that holds in a cluster."""
    for c in ("row_id", "activity_id"):
        if c in rows.columns:
            return F.col(c).cast("string")
    raise ValueError("rows have neither row_id nor activity_id")


def close_to(column: Column, value: float) -> Column:
    """Equal within 1e-8 + 1e-5 of the value."""
    return F.abs(column - value) <= 1e-8 + 1e-5 * abs(value)
