"""Features of rows that repeat a key: computed once for each different key, kept by content, joined back."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundlab.session import saved


def finite(values: Column) -> Column:
    """An array whose missing and non-finite values are 0: a constant, so no statistic of test rows leaks in."""
    return F.transform(values, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x.cast("double")))


def shape_of(key: str, bits: int, longest: int) -> np.ndarray:
    """Folded counts of a key's substrings: a stand-in for structure fingerprints, which need a chemistry library."""
    out = np.zeros(bits)
    for n in range(1, longest + 1):
        for i in range(len(key) - n + 1):
            out[int.from_bytes(hashlib.blake2b(key[i : i + n].encode(), digest_size=4).digest(), "little") % bits] += 1
    return out


def featured(rows: DataFrame, key: str, function: Callable[..., np.ndarray] = shape_of, cache: str | None = None, **parameters) -> DataFrame:
    """rows with `x`, an array of doubles that `function(key, **parameters)` gives; null keys have none.

    With `cache`, a shared folder, a table of features grows there under a hash of
    the function's code and the parameters: only keys that it doesn't hold yet are
    computed, and added to it.
    """
    keys = rows.select(F.col(key).alias("_k")).where("_k is not null").distinct()

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"_k": pdf["_k"], "x": [function(k, **parameters).tolist() for k in pdf["_k"]]})

    if cache:
        spark = rows.sparkSession
        path = f"{cache}/features-{_identity(function, parameters)}"
        known = _read(spark, path)
        if known is not None:
            keys = saved(keys.join(known.select(F.col("_k").alias("_h")), F.col("_k") == F.col("_h"), "left_anti"))
        if known is None or keys.limit(1).count():
            keys.mapInPandas(run, "_k string, x array<double>").select("_k", finite(F.col("x")).alias("x")).write.mode("append").parquet(path)
        made = _read(spark, path).dropDuplicates(["_k"])  # two jobs may have added a key at once
    else:
        made = saved(keys.mapInPandas(run, "_k string, x array<double>").select("_k", finite(F.col("x")).alias("x")))
    return rows.join(made, F.col(key) == F.col("_k"), "left").drop("_k")


def _identity(function: Callable, parameters: dict) -> str:
    """A hash over a function's source (or its code where there is none) and its parameters."""
    try:
        body = inspect.getsource(function)
    except (OSError, TypeError):
        code = getattr(function, "__code__", None)
        body = repr((code.co_code, code.co_consts, code.co_names)) if code else repr(function)
    return hashlib.sha256(json.dumps([function.__name__, body, parameters], sort_keys=True, default=repr).encode()).hexdigest()[:16]


def _read(spark, path: str) -> DataFrame | None:
    """The table that lies there, or None."""
    try:
        return spark.read.schema("_k string, x array<double>").parquet(path)
    except AnalysisException:
        return None
