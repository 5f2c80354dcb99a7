"""Train/test splits that keep groups together, with audits of leakage.

A split is rows with a `fold`: the number (or name) of the fold that tests the
row; every other fold trains on it. `assignments` turns any kind of split into
rows (kind, endpoint, fold, row_id, role). Fold numbers come from md5 of seed
and key: equal for any partitioning and engine.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boundlab.operators.ranking import hash_ranked, offsets, quantiles, tile
from boundlab.session import kept, saved, small


def _turn(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key).cast("binary"))


def fold_table(keys: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """(endpoint, key) of different groups -> endpoint, key, fold: dealt into k equal lots of groups."""
    dealt = hash_ranked(keys, ["endpoint"], _turn(seed, F.col("key")), ["key"])
    return dealt.select("endpoint", "key", tile(F.col("place"), F.col("all"), k).alias("fold"))


def grouped_folds(obs: DataFrame, key: Column, k: int = 5, seed: int = 0) -> DataFrame:
    """obs with `fold`: whole groups of an endpoint dealt into k equal lots of groups. Missing keys are the group 'None'."""
    rows = obs.withColumn("_key", F.coalesce(key, F.lit("None")))
    lots = fold_table(kept(rows.select("endpoint", F.col("_key").alias("key")).distinct()), k, seed)
    lots = lots.select(F.col("endpoint").alias("_e"), F.col("key").alias("_k"), "fold")
    return rows.join(small(saved(lots)), (F.col("endpoint") == F.col("_e")) & (F.col("_key") == F.col("_k"))).drop("_key", "_e", "_k")


def random_folds(obs: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """obs with `fold` from the row's hash: no window over whole endpoints, sizes equal up to chance."""
    return obs.withColumn("fold", F.pmod(F.conv(F.substring(_turn(seed, F.col("row_id")), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))


def structure_key(obs: DataFrame) -> Column:
    """The scaffold where the table has one, else the compound, as rows of single measurements have no scaffold."""
    return F.col("scaffold") if "scaffold" in obs.columns else F.col("compound_id")


def source_split(obs: DataFrame, least_source: int = 50, least_test: int = 30, least_train: int = 100) -> DataFrame:
    """Rows of sources that are large enough, with `fold`: the source, held out as a whole; `place` orders folds by size, from 0."""
    sizes = source_folds(obs, least_source, least_test, least_train)
    larger = F.struct(-F.col("n_test"), F.col("fold"), F.col("source_name"))
    order = sizes.groupBy("endpoint").agg(F.array_sort(F.collect_list(larger)).alias("order"))  # sources of an endpoint
    named = sizes.join(order, "endpoint").select(F.col("endpoint").alias("_e"), F.col("source_name").alias("_s"), "fold", (F.array_position("order", larger) - 1).cast("int").alias("place"))
    return obs.join(small(saved(named)), (F.col("endpoint") == F.col("_e")) & (F.col("source_name") == F.col("_s"))).drop("_e", "_s")


def source_folds(obs: DataFrame, least_source: int = 50, least_test: int = 30, least_train: int = 100) -> DataFrame:
    """One fold a source of at least `least_source` rows: (endpoint, source_name, fold, n_test, n_train); names end after 24 characters."""
    sizes = obs.groupBy("endpoint", "source_name").agg(F.count("*").alias("n_test"))
    totals = sizes.groupBy("endpoint").agg(F.sum("n_test").alias("n"))
    found = sizes.where(F.col("source_name").isNotNull() & (F.col("n_test") >= least_source)).join(totals, "endpoint").withColumn("n_train", F.col("n") - F.col("n_test"))
    return found.where((F.col("n_test") >= least_test) & (F.col("n_train") >= least_train)).select("endpoint", "source_name", F.substring("source_name", 1, 24).alias("fold"), "n_test", "n_train")


def band_edges(obs: DataFrame, bands: int = 3, least_exact: int = 100) -> DataFrame:
    """endpoint, edges: the quantiles 0, 1/bands, ..., 1 of exact values, where there are enough."""
    exact = obs.where("exact_mask and value_p is not null")
    found = quantiles(exact, ["endpoint"], "value_p", {f"e{i}": i / bands for i in range(bands + 1)}).where(F.col("all") >= least_exact)
    return found.select("endpoint", F.array(*(F.col(f"e{i}") for i in range(bands + 1))).alias("edges"))


def _band(bands: int = 3) -> Column:
    return F.size(F.filter(F.slice("edges", 2, bands - 1), lambda x: x <= F.col("value_p")))


def threshold_split(obs: DataFrame, bands: int = 3, least_exact: int = 100, least_test: int = 30, least_train: int = 100) -> DataFrame:
    """Exact rows with `fold`, their band of values, and its `low` and `high`; bands are closed below, the last on both sides. Censored rows are never tested."""
    obs = kept(obs)  # read four times
    edges = band_edges(obs, bands, least_exact).withColumnRenamed("endpoint", "_e")
    exact = obs.where("exact_mask and value_p is not null").join(small(saved(edges)), F.col("endpoint") == F.col("_e")).drop("_e")
    rows = exact.withColumn("fold", _band(bands)).withColumns({"low": F.get("edges", F.col("fold")), "high": F.get("edges", F.col("fold") + 1)})
    totals = obs.groupBy(F.col("endpoint").alias("_e")).agg(F.count("*").alias("_n"))
    sizes = rows.groupBy("endpoint", "fold").agg(F.count("*").alias("_t")).join(totals, F.col("endpoint") == F.col("_e"))
    good = sizes.where((F.col("_t") >= least_test) & (F.col("_n") - F.col("_t") >= least_train)).select("endpoint", "fold")
    return rows.join(small(saved(good)), ["endpoint", "fold"], "left_semi")


def crossed_folds(obs: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """Folds of assay x scaffold pairs; test rows whose assay or scaffold is also trained on get role 'dropped'."""
    pairs = saved(obs.select("endpoint", "assay_id", "scaffold").distinct())  # all else works on these
    folded = saved(grouped_folds(pairs, F.concat_ws("|", "assay_id", "scaffold"), k, seed))
    marks = folded
    for c in ("assay_id", "scaffold"):
        spread = folded.groupBy(F.col("endpoint").alias("_e"), F.col(c).alias("_k")).agg(F.count_distinct("fold").alias(f"n_{c}"))
        marks = marks.join(spread, (F.col("endpoint") == F.col("_e")) & F.col(c).eqNullSafe(F.col("_k"))).drop("_e", "_k")
    marks = small(saved(marks.select(F.col("endpoint").alias("_e"), F.col("assay_id").alias("_a"), F.col("scaffold").alias("_s"), "fold", "n_assay_id", "n_scaffold")))
    rows = obs.join(marks, (F.col("endpoint") == F.col("_e")) & F.col("assay_id").eqNullSafe(F.col("_a")) & F.col("scaffold").eqNullSafe(F.col("_s"))).drop("_e", "_a", "_s")
    return rows.withColumn("role", F.when((F.col("n_assay_id") == 1) & (F.col("n_scaffold") == 1), "test").otherwise("dropped"))


#: Which column keeps together what; the rest have rules of their own.
GROUPED = {"assay": lambda o: F.col("assay_id"), "document": lambda o: F.col("document_id"), "scaffold": structure_key, "compound": lambda o: F.col("compound_id")}
NEEDS = {"assay": "assay_id", "document": "document_id", "compound": "compound_id", "source": "source_name"}
KINDS = ("random", *GROUPED, "source", "threshold", "assay_scaffold")


def split(obs: DataFrame, kind: str, k: int = 5, seed: int = 0) -> DataFrame | None:
    """Test rows of one kind of split, with `fold` as a string; None where the table lacks the columns."""
    if kind not in KINDS:
        raise ValueError(f"unknown split {kind}; known are {', '.join(KINDS)}")
    needs = {"assay_scaffold": {"assay_id", "scaffold"}}.get(kind, {NEEDS[kind]} if kind in NEEDS else set())
    if not needs <= set(obs.columns):
        return None
    if kind == "random":
        found = random_folds(obs, k, seed)
    elif kind in GROUPED:
        found = grouped_folds(obs, GROUPED[kind](obs), k, seed)
    elif kind == "source":
        found = source_split(obs).drop("place")
    elif kind == "threshold":
        found = threshold_split(obs).drop("low", "high", "edges")
    else:
        found = crossed_folds(obs, k, seed).where("role = 'test'").drop("role", "n_assay_id", "n_scaffold")
    return found.withColumn("fold", F.col("fold").cast("string"))


def narrow(obs: DataFrame) -> DataFrame:
    """The columns of obs that splits read, kept; a frame that is kept already stays as it is."""
    if obs.__dict__.get("_is_saved"):
        return obs
    return kept(obs.select(*(c for c in ("endpoint", "row_id", "assay_id", "document_id", "compound_id", "scaffold", "source_name", "exact_mask", "value_p") if c in obs.columns)))


def make_splits(obs: DataFrame, kinds: Iterable[str] = KINDS, k: int = 5, seed: int = 0) -> DataFrame:
    """kind, endpoint, fold, row_id of all test rows of the kinds that the table allows. A fold trains on the endpoint's other rows (see assignments).

    The columns that splits read are kept once and read by each kind.
    """
    obs, out = narrow(obs), None
    for kind in kinds:
        found = split(obs, kind, k, seed)
        if found is not None:
            found = found.select(F.lit(kind).alias("kind"), "endpoint", "fold", "row_id")
            out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("the table has the columns of none of these splits")
    return out


def assignments(obs: DataFrame, tests: DataFrame) -> DataFrame:
    """kind, endpoint, fold, row_id, role: every row of an endpoint for each of its folds, 'test' or 'train'.

    Of assay_scaffold, rows that share only an assay or a scaffold with the test side still train.
    """
    folds = saved(tests.select("kind", "endpoint", "fold").distinct())
    every = obs.select("endpoint", "row_id").join(small(folds), "endpoint")  # endpoints are few and hot
    marks = tests.withColumn("role", F.lit("test"))
    return every.join(marks, ["kind", "endpoint", "fold", "row_id"], "left").withColumn("role", F.coalesce("role", F.lit("train")))


def validation(obs: DataFrame, made: DataFrame) -> DataFrame:
    """Faults of exported assignments by kind, endpoint and fold: rows in both roles, doubled rows, unknown ids, empty sides."""
    known = obs.select("endpoint", "row_id").distinct().withColumn("_known", F.lit(True))
    one = made.groupBy("kind", "endpoint", "fold", "row_id").agg(F.count_distinct("role").alias("roles"), F.count("*").alias("times"), F.max((F.col("role") == "test").cast("int")).alias("tests"), F.max((F.col("role") == "train").cast("int")).alias("trains"))
    seen = one.join(known, ["endpoint", "row_id"], "left")
    faults = seen.groupBy("kind", "endpoint", "fold").agg(
        F.sum("tests").alias("n_test"), F.sum("trains").alias("n_train"), F.count_if(F.col("roles") > 1).alias("n_shared"), F.count_if(F.col("times") > F.col("roles")).alias("n_doubled"), F.count_if(F.col("_known").isNull()).alias("n_unknown")
    )
    return faults.withColumn("ok", (F.col("n_test") > 0) & (F.col("n_train") > 0) & (F.col("n_shared") + F.col("n_doubled") + F.col("n_unknown") == 0))


def marked(obs: DataFrame, kinds: Iterable[str] = KINDS, k: int = 5, seed: int = 0) -> DataFrame:
    """endpoint, row_id, tests: the (kind, fold) pairs that test each row of obs, a row of obs once: `assignments` without its copies.

    Every fold of the endpoint that isn't listed trains on the row. Folds come
    from tables by key that are joined to the rows one after the other, so rows
    aren't shuffled by their ids. Of kinds whose rules read single rows only.
    """
    rows, listed = narrow(obs), []
    obs = rows
    for i, kind in enumerate(kinds):
        if kind not in KINDS or kind == "assay_scaffold":
            raise ValueError(f"no such marks: {kind}")
        if kind in NEEDS and NEEDS[kind] not in obs.columns:
            continue
        if kind == "random":
            rows = random_folds(rows, k, seed)
        elif kind in GROUPED:
            key = F.coalesce(GROUPED[kind](obs), F.lit("None"))
            lots = fold_table(kept(obs.select("endpoint", key.alias("key")).distinct()), k, seed).select(F.col("endpoint").alias("_e"), F.col("key").alias("_k"), "fold")
            rows = rows.join(small(kept(lots)), (F.col("endpoint") == F.col("_e")) & (key == F.col("_k")), "left").drop("_e", "_k")
        elif kind == "source":
            named = source_folds(obs).select(F.col("endpoint").alias("_e"), F.col("source_name").alias("_s"), "fold")
            rows = rows.join(small(saved(named)), (F.col("endpoint") == F.col("_e")) & (F.col("source_name") == F.col("_s")), "left").drop("_e", "_s")
        else:
            bands = threshold_split(obs).groupBy("endpoint").agg(F.first("edges").alias("edges"), F.collect_set("fold").alias("good"))  # bands of an endpoint
            rows = rows.join(small(saved(bands.withColumnRenamed("endpoint", "_e"))), F.col("endpoint") == F.col("_e"), "left")
            band = F.when(F.col("exact_mask") & F.col("value_p").isNotNull(), _band())
            rows = rows.withColumn("fold", F.when(F.array_contains("good", band), band)).drop("_e", "edges", "good")
        rows = rows.withColumn(f"_f{i}", F.col("fold").cast("string")).drop("fold")
        listed.append(F.when(F.col(f"_f{i}").isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(f"_f{i}").alias("fold"))))
    if not listed:
        raise ValueError("the table has the columns of none of these splits")
    return rows.select("endpoint", "row_id", F.array_compact(F.array(*listed)).alias("tests"))


def marks_validation(obs: DataFrame, marks: DataFrame) -> DataFrame:
    """`validation` of the assignments that `marks` (see `marked`) stand for, without writing them out.

    Rows are gathered by id once. A fold trains on every id of its endpoint that it
    doesn't test, so its numbers are the endpoint's less those of its own test rows.
    An id that several rows share gets every role so often.
    """
    ids = obs.select("endpoint", "row_id").distinct().select(F.col("endpoint").alias("k_e"), F.col("row_id").alias("k_r"))
    one = marks.groupBy("endpoint", "row_id").agg(F.count("*").alias("n"), F.flatten(F.collect_list("tests")).alias("tests"))
    one = one.join(ids, (F.col("endpoint") == F.col("k_e")) & (F.col("row_id") == F.col("k_r")), "left").withColumn("_unknown", F.col("k_e").isNull())
    # an id is tested by a fold n times for each of its marks, and else trains it n times
    seen = F.explode(F.concat(F.transform(F.array_distinct("tests"), lambda m: F.struct(m["kind"].alias("kind"), m["fold"].alias("fold"), (F.size(F.filter("tests", lambda x: x == m)) * F.col("n")).alias("times"))), F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("fold"), F.col("n").alias("times")))))
    flat = one.select("endpoint", "n", "_unknown", seen.alias("m")).select("endpoint", "n", "_unknown", "m.kind", "m.fold", "m.times")
    sums = saved(flat.groupBy("endpoint", "kind", "fold").agg(F.count("*").alias("ids"), F.count_if(F.col("times") > 1).alias("doubled"), F.count_if(F.col("n") > 1).alias("plural"), F.count_if("_unknown").alias("unknown")))
    whole = sums.where("kind is null").select(F.col("endpoint").alias("w_e"), F.col("ids").alias("w_ids"), F.col("plural").alias("w_plural"), F.col("unknown").alias("w_unknown"))
    both = sums.where("kind is not null").join(whole, F.col("endpoint") == F.col("w_e"))  # a row a fold
    found = both.select("kind", "endpoint", "fold", F.col("ids").alias("n_test"), (F.col("w_ids") - F.col("ids")).alias("n_train"), F.lit(0).cast("long").alias("n_shared"), (F.col("doubled") + F.col("w_plural") - F.col("plural")).alias("n_doubled"), F.col("w_unknown").alias("n_unknown"))
    return found.withColumn("ok", (F.col("n_test") > 0) & (F.col("n_train") > 0) & (F.col("n_doubled") + F.col("n_unknown") == 0))


def overlap(folded: DataFrame, key: str = "compound_id") -> DataFrame:
    """Per endpoint and fold: the part of test rows whose key is also trained on."""
    folded = saved(folded.select("endpoint", "fold", key))
    spread = folded.groupBy("endpoint", key).agg(F.count_distinct("fold").alias("n_folds")).select(F.col("endpoint").alias("_e"), F.col(key).alias("_k"), "n_folds")
    both = folded.join(spread, (F.col("endpoint") == F.col("_e")) & (F.col(key) == F.col("_k")))
    return both.groupBy("endpoint", "fold").agg(F.count("*").alias("n_test"), F.avg((F.col("n_folds") > 1).cast("double")).alias("overlap"))


def overlap_summary(shares: DataFrame) -> DataFrame:
    return shares.groupBy("endpoint").agg(F.count("*").alias("n_folds"), F.avg("overlap").alias("mean_overlap"), F.min("overlap").alias("min_overlap"), F.max("overlap").alias("max_overlap"))


def calibration_slice(obs: DataFrame, share: float = 0.2, least: int = 50, seed: int = 0) -> DataFrame:
    """obs with `calibration`: the first max(least, share * n) rows of each endpoint in hash order."""
    obs = kept(obs)  # read three times
    turned = obs.withColumn("_lot", F.substring(_turn(seed, F.col("row_id")), 1, 4))
    marks = offsets(turned.groupBy("endpoint", "_lot").agg(F.count("*").alias("_n")), ["endpoint"], "_lot", "_n")
    # whole lots are in or out by their counts; the one lot of an endpoint where the slice ends is ranked alone
    limit = F.greatest(F.lit(least), F.floor(F.lit(share) * F.col("all")))
    after = Window.partitionBy("o_endpoint").orderBy("before")
    ends = saved(marks.withColumn("_limit", limit).withColumn("_next", F.lead("before").over(after)).where((F.col("before") < F.col("_limit")) & (F.coalesce("_next", F.col("all")) >= F.col("_limit")) | F.col("_next").isNull() & (F.col("all") < F.col("_limit")) | (F.col("before") == 0) & (F.col("_limit") <= 0)).select("o_endpoint", F.col("o__lot").alias("_end"), (F.col("_limit") - F.col("before")).alias("_left")))
    both = turned.join(small(ends), F.col("endpoint").eqNullSafe(F.col("o_endpoint")))
    whole = both.where("_lot <> _end").withColumn("calibration", F.col("_lot") < F.col("_end"))
    inside = Window.partitionBy("endpoint").orderBy(_turn(seed, F.col("row_id")), "row_id")
    edge = both.where("_lot = _end").withColumn("calibration", F.row_number().over(inside) <= F.col("_left"))
    return whole.unionByName(edge).drop("_lot", "_end", "_left", "o_endpoint")


def sample_audit(sliced: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """endpoint, n_calibration, n_calibration_exact, n of a calibration slice; with the counts on record also `ok`, whether they agree."""
    names = ["n_calibration", "n_calibration_exact", "n"]
    found = sliced.groupBy("endpoint").agg(F.count_if("calibration").alias(names[0]), F.count_if(F.col("calibration") & F.col("exact_mask")).alias(names[1]), F.count("*").alias(names[2]))
    if recorded is None:
        return found
    was = recorded.select("endpoint", *(F.col(c).alias(f"recorded_{c}") for c in names))
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"recorded_{c}"))
    return found.join(was, "endpoint", "full").withColumn("ok", same)
