"""The shared table: pruned partitions, joins without exchange, rebuilt only when its input changes."""

import pytest
from pyspark.sql import functions as F

from boundlab.sources import store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_laid_out_once(spark, tmp_path):
    rows = spark.range(4000).select(F.concat(F.lit("r"), "id").alias("activity_id"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("target_key"), (F.col("id") % 5).cast("string").alias("standard_type"), F.col("id").alias("v"))
    source, root = str(tmp_path / "in"), str(tmp_path / "store")
    rows.write.parquet(source)
    first = store.stored(spark, root, "meas", source, buckets=4)
    version = store.current(spark, root, "meas")
    assert first.count() == 4000 and store.stored(spark, root, "meas", source, buckets=4).count() == 4000
    assert store.current(spark, root, "meas") == version  # nothing was written again
    part = first.where("target_key = 'A' and standard_type = '2'")
    assert "PartitionFilters: [isnotnull(target_key" in plan(part) and part.count() == 400
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        other = store.stored(spark, root, "notes", source, rows.withColumn("note", F.lit(1)), buckets=4)
        joined = first.join(other.select("activity_id", "note"), "activity_id")
        assert "Exchange" not in plan(joined) and joined.count() == 4000
        spark.sql(f"DROP TABLE {version[0]}")  # as in a session that doesn't know the table yet
        again = store.stored(spark, root, "meas", source, buckets=4)
        joined = again.join(other.select("activity_id", "note"), "activity_id")
        assert store.current(spark, root, "meas") == version and "Exchange" not in plan(joined) and joined.count() == 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rows.limit(10).write.mode("append").parquet(source)
    assert store.stored(spark, root, "meas", source, buckets=4).count() == 4010
    assert store.current(spark, root, "meas")[0] != version[0]


def test_a_stopped_build_leaves_the_version_before(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "store")
    make = lambda n: spark.range(n).select(F.col("id").cast("string").alias("activity_id"), F.lit("A").alias("target_key"), F.lit("x").alias("standard_type"))
    make(20).write.parquet(source)
    store.stored(spark, root, "t", source, buckets=2)
    version = store.current(spark, root, "t")
    make(5).write.mode("append").parquet(source)
    broken = make(25).withColumn("bad", F.raise_error(F.lit("stopped")))
    with pytest.raises(Exception, match="stopped"):
        store.stored(spark, root, "t", source, broken, buckets=2)
    assert store.current(spark, root, "t") == version and spark.table(version[0]).count() == 20
    assert store.stored(spark, root, "t", source, buckets=2).count() == 25


def test_narrow_rows_move_and_buckets_follow_the_size(spark, tmp_path, monkeypatch):
    """`derive` makes columns after the shuffle; the table is as if made before, and another session reads the buckets it was written with."""
    rows = spark.range(3000).select((F.col("id") * 7).alias("a"))
    source, root = str(tmp_path / "in"), str(tmp_path / "store")
    rows.repartition(3).write.parquet(source)
    wide = lambda r: r.select(F.concat(F.lit("r"), "a").alias("activity_id"), F.when(F.col("a") % 2 == 0, "A").otherwise("B").alias("target_key"), F.lit("x").alias("standard_type"), F.repeat(F.lit("long"), 50).alias("text"))
    monkeypatch.setattr(store, "BUCKET_BYTES", 400)
    n = store.buckets_for(spark, source)
    assert n > store.LEAST_BUCKETS and store.buckets_for(spark, source) == n
    made = store.stored(spark, root, "t", source, rows, at=F.concat(F.lit("r"), F.col("a")), derive=wide)
    other = store.stored(spark, root, "u", source, wide(rows), buckets=n)
    ordered = lambda df: sorted(df.select(wide(rows).columns).collect())
    assert ordered(made) == ordered(wide(rows)) == ordered(other)
    version = store.current(spark, root, "t")[0]
    files = made.select(F.regexp_extract(F.input_file_name(), r"_(\d{5})\.c000", 1).alias("f"), F.pmod(F.hash("activity_id"), F.lit(n)).alias("b"))
    assert files.where("cast(f as int) <> b").count() == 0  # one bucket a task: rows lie where their key says
    monkeypatch.setattr(store, "BUCKET_BYTES", 10**9)
    spark.sql(f"DROP TABLE {version}")
    again = store.stored(spark, root, "t", source, rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = again.join(other.select("activity_id", F.lit(1).alias("note")), "activity_id")
        assert store.current(spark, root, "t")[0] == version and "Exchange" not in plan(joined) and joined.count() == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_fixtures_small_tables_are_sent_to_the_items(spark):
    """No join of the fixture deals out all items: Spark took suppliers joined with their places to be the product of their sizes."""
    from boundlab.sources.observations import raw_rows

    rows = raw_rows(spark, "/root/testdata/sf0.1")
    assert "Exchange hashpartitioning" not in plan(rows) and rows.columns[-2:] == ["p_brand", "r_name"]
