"""The growing store of features: a key is computed once for each function body and parameters."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from boundlab.sources import features


def test_only_new_keys_are_computed(spark, tmp_path):
    def counted(key: str, folder: str, scale: int) -> np.ndarray:
        Path(folder, f"{key}-{scale}-{len(list(Path(folder).iterdir()))}").touch()
        return np.array([len(key) * scale, np.nan])

    folder, cache = tmp_path / "calls", str(tmp_path / "cache")
    folder.mkdir()
    rows = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k string")
    calls = lambda: sorted(p.name.split("-")[0] for p in folder.iterdir())
    made = lambda df, **more: {r["k"]: r["x"] for r in features.featured(df, "k", counted, cache, folder=str(folder), **({"scale": 2} | more)).collect()}
    assert made(rows("a", "bb", "a", None)) == {"a": [2.0, 0.0], "bb": [4.0, 0.0], None: None} and calls() == ["a", "bb"]
    assert made(rows("a", "ccc", "bb")) == {"a": [2.0, 0.0], "bb": [4.0, 0.0], "ccc": [6.0, 0.0]} and calls() == ["a", "bb", "ccc"]
    assert made(rows("bb")) == {"bb": [4.0, 0.0]} and len(calls()) == 3
    assert made(rows("a"), scale=3) == {"a": [3.0, 0.0]} and len(calls()) == 4  # other parameters, another table
    assert made(rows()) == {}
    other = features._identity(lambda key: np.zeros(1), {})
    assert other != features._identity(lambda key: np.ones(1), {}) and other != features._identity(counted, {})
    assert features.featured(rows("a"), "k", counted, folder=str(folder), scale=5).select(F.get("x", F.lit(0))).first()[0] == pytest.approx(5.0)
