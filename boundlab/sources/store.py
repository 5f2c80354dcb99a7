"""Tables that several jobs share: laid out once, read by partition and bucket, rebuilt when their input changes.

A stored table is partitioned by columns that readers filter on and bucketed by a
key that they join on, so that a filter reads its partitions alone and a join
with another table of the same buckets needs no exchange. A fingerprint of the
input files (names, sizes, times of change) is kept beside it; `stored` compares
it and writes the table anew only if it differs.

Every version has a name of its own and `_catalog` says last which one holds, so
a build that is stopped half-way leaves the version before it in use.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Where no number of buckets is given: so many at least, and one for so many bytes of the source, so that a bucket is sorted in memory.
LEAST_BUCKETS, BUCKET_BYTES = 16, 4_000_000


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def buckets_for(spark: SparkSession, path: str) -> int:
    size = _files(spark, path).agg(F.sum("length")).first()[0] or 0
    return max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))


def fingerprint(spark: SparkSession, path: str) -> str:
    """A hash over the names, sizes and times of change of the files under a path; their content isn't read."""
    files = _files(spark, path)
    one = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("double").cast("string")), 256)
    parts = [F.conv(F.substring(one, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    found = files.agg(F.count("*").alias("n"), *(F.bit_xor(p).alias(f"x{k}") for k, p in enumerate(parts)), *(F.sum(p).alias(f"s{k}") for k, p in enumerate(parts))).first()
    return "-".join(str(v or 0) for v in found)


def _entries(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema("name string, version string, print string, at timestamp, buckets int").json(f"{root}/_catalog")
    except AnalysisException:
        return None


def _last(spark: SparkSession, root: str, name: str):
    entries = _entries(spark, root)
    return entries.where(F.col("name") == name).orderBy(F.desc("at"), F.desc("version")).first() if entries is not None else None


def current(spark: SparkSession, root: str, name: str) -> tuple[str, str] | None:
    """Version and fingerprint of the build of a table that holds."""
    last = _last(spark, root, name)
    return (last["version"], last["print"]) if last else None


def stored(
    spark: SparkSession, root: str, name: str, source: str, rows: DataFrame | None = None, partitions: tuple[str, ...] = ("target_key", "standard_type"), key: str = "activity_id",
    buckets: int | None = None, at: Column | None = None, derive: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The table `name` under `root`, made of `rows` (else of the Parquet files at `source`) unless the one that is there has the source's fingerprint.

    `derive` makes the table's columns of rows that have been shuffled, so that narrow
    rows move; `at` is then the key as an expression over these. Without `buckets`
    their number follows from the size of the source.

    Buckets and their order are kept in Spark's catalog of this session, which is
    told of a version that another session has written.
    """
    now, found = fingerprint(spark, source), _last(spark, root, name)
    if found is None or found["print"] != now:
        version = f"{name}_{uuid4().hex}"
        buckets = buckets or buckets_for(spark, source)
        made = rows if rows is not None else spark.read.parquet(source)
        # as many tasks as buckets and no more files than partitions x buckets
        made = made.repartition(buckets, key if at is None else at)
        made = derive(made) if derive else made
        made.write.partitionBy(*partitions).bucketBy(buckets, key).sortBy(key).option("path", f"{root}/{version}").saveAsTable(version)
        spark.createDataFrame([(name, version, now, buckets)], "name string, version string, print string, buckets int").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{root}/_catalog")
        return spark.table(version)
    version = found["version"]
    if not spark.catalog.tableExists(version):
        buckets = found["buckets"] or buckets or LEAST_BUCKETS  # those that it was written with
        shape = spark.read.parquet(f"{root}/{version}")
        columns = ", ".join(f"`{c}` {kind}" for c, kind in shape.dtypes)
        parts = ", ".join(f"`{c}`" for c in partitions)
        spark.sql(f"CREATE TABLE `{version}` ({columns}) USING parquet PARTITIONED BY ({parts}) CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{root}/{version}'")
        spark.catalog.recoverPartitions(version)
    return spark.table(version)
