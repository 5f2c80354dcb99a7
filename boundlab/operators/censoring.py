"""How labels come to be censored: learn the mechanism, apply it to known values, test it."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundlab.operators.metrics import auc, mean
from boundlab.operators.ranking import hash_ranked, value_runs
from boundlab.session import kept, saved, small


def labels() -> dict[str, F.Column]:
    """is_censored, is_left and is_right of a row."""
    kind = F.col("censoring_class")
    return {"is_censored": kind != "exact", "is_left": kind == "left_censored_p", "is_right": kind == "right_censored_p"}


def mechanism(obs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, n_exact, p_censored, p_left, p_right (the latter two among one-sided rows)."""
    left, right = F.count_if(F.col("censoring_class") == "left_censored_p"), F.count_if(F.col("censoring_class") == "right_censored_p")
    n, exact = F.count("*"), F.count_if("exact_mask")
    return obs.groupBy(*by).agg(n.alias("n"), exact.alias("n_exact"), F.try_divide(left + right, left + right + exact).alias("p_censored"), F.try_divide(left, left + right).alias("p_left"), F.try_divide(right, left + right).alias("p_right"))


def uniform(seed: str, key: str = "row_id") -> F.Column:
    """A number in [0, 1) from md5: the same wherever and in whatever engine it is drawn."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key)).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def thresholds(obs: DataFrame, by: list[str]) -> DataFrame:
    """by, side, place (from 0), cut: the pool of finite limits of each side, numbered in order."""
    cut = F.when(F.col("censoring_class") == "left_censored_p", F.col("upper")).when(F.col("censoring_class") == "right_censored_p", F.col("lower"))
    side = F.when(F.col("censoring_class") == "left_censored_p", "left").otherwise("right")
    pool = obs.where(cut.isNotNull()).select(*by, side.alias("side"), cut.alias("cut")).distinct()
    return value_runs(pool, [*by, "side"], "cut").select(*by, "side", "cut", F.col("first").alias("place"))


def censored_again(obs: DataFrame, strength: float = 0.0, seed: str = "hide") -> DataFrame:
    """Exact rows with hidden_lower, hidden_upper, recensored by the endpoint's own mechanism.

    A row is drawn with p_censored, with `strength` > 0 more often the higher its
    value ranks (chances p * (1 + strength * (2r - 1))), gets a side by p_right and a
    threshold from the pool, and is censored only if its value lies strictly beyond.
    """
    by = ["endpoint"]
    obs = kept(obs)  # read four times
    exact = obs.where("exact_mask and value_p is not null")
    runs = value_runs(exact, by, "value_p").select(F.col("endpoint").alias("_re"), F.col("value_p").alias("_rv"), F.col("first").alias("_first"), F.col("all").alias("_all"))
    model = mechanism(obs, by).select("endpoint", "p_censored", "p_right")
    pool = thresholds(obs, by)
    sizes = pool.groupBy("endpoint").pivot("side", ["left", "right"]).count()
    rows = exact.join(runs, (F.col("endpoint") == F.col("_re")) & (F.col("value_p") == F.col("_rv"))).join(model, by).join(sizes, by, "left")
    rank = F.coalesce(F.try_divide(F.col("_first"), F.col("_all") - 1), F.lit(0.5))
    chance = F.least(F.greatest(F.col("p_censored") * (1 + F.lit(strength) * (rank - 0.5) * 2), F.lit(0.0)), F.lit(1.0))
    side = F.when(F.col("left").isNull(), "right").when(F.col("right").isNull(), "left").when(uniform(f"{seed}-side") < F.col("p_right"), "right").otherwise("left")
    rows = rows.withColumn("_side", F.when(uniform(f"{seed}-draw") < chance, side))
    place = F.floor(uniform(f"{seed}-cut") * F.when(F.col("_side") == "left", F.col("left")).otherwise(F.col("right")))
    rows = rows.withColumn("_place", place)
    pool = pool.select(F.col("endpoint").alias("_e"), F.col("side").alias("_s"), F.col("place").alias("_p"), "cut")
    rows = rows.join(pool, (F.col("endpoint") == F.col("_e")) & (F.col("_side") == F.col("_s")) & (F.col("_place") == F.col("_p")), "left")
    right, left = (F.col("_side") == "right") & (F.col("value_p") > F.col("cut")), (F.col("_side") == "left") & (F.col("value_p") < F.col("cut"))
    inf = F.lit(float("inf"))
    return rows.withColumns({
        "hidden_lower": F.when(right, F.col("cut")).when(left, -inf).otherwise(F.col("value_p")),
        "hidden_upper": F.when(right, inf).when(left, F.col("cut")).otherwise(F.col("value_p")),
        "recensored": F.coalesce(right | left, F.lit(False)),
    }).select(*obs.columns, "hidden_lower", "hidden_upper", "recensored")


def recovery(least: int = 3) -> list[F.Column]:
    """MAE, RMSE and signed bias over re-censored rows."""
    e = F.when(F.col("recensored") & F.col("value_p").isNotNull(), mean() - F.col("value_p"))
    n = F.count(e)
    return [n.alias("n"), *(F.when(n >= least, c).alias(k) for k, c in (("mae", F.avg(F.abs(e))), ("rmse", F.sqrt(F.avg(e * e))), ("bias", F.avg(e))))]


def predict_censoring(rows: DataFrame, groups: dict[str, list[str]], train: F.Column, iterations: int = 300) -> DataFrame:
    """features, auc, base_rate, n_test: how well logistic models over groups of features tell censored test rows.

    Besides each group, their union is tried. The penalty is that of C = 1 on
    summed losses, 1 / n here, on features as they are. The AUC is null where
    either side has a single class.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    spark = rows.sparkSession
    every = list(dict.fromkeys(c for g in groups.values() for c in g))
    data = rows.select(*(F.col(c).cast("double").alias(c) for c in every), labels()["is_censored"].cast("double").alias("label"), train.alias("train"))
    # rows with equal features and label weigh as many as they are
    data = kept(data.groupBy(*data.columns).agg(F.count("*").alias("_n")))
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0).cast("long"))
    n, n_pos, n_test, base = data.agg(some(F.col("train")), some(F.col("train") & (F.col("label") == 1)), some(~F.col("train")), F.try_divide(F.sum(F.col("label") * F.col("_n")), F.sum(F.when(F.col("label").isNotNull(), F.col("_n"))))).first()
    out = []
    for name, columns in (groups | ({"+".join(groups): every} if len(groups) > 1 else {})).items():
        if not columns:
            continue
        found = None
        if 0 < n_pos < n:
            x = VectorAssembler(inputCols=columns, outputCol="x").transform(data)
            model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="_n", regParam=1 / n, standardization=False, maxIter=iterations).fit(x.where("train"))
            test = model.transform(x.where("not train")).select(F.lit(1).alias("grp"), F.round(F.get(vector_to_array("probability"), F.lit(1)), 12).alias("p"), (F.col("label") == 1).alias("y"), "_n")
            row = auc(test, ["grp"], "p", "y", "_n").first()
            found = row["auc"] if row else None
        out.append((name, found, base, n_test))
    return spark.createDataFrame(out, "features string, auc double, base_rate double, n_test long")


def ridges(rows: DataFrame, by: list[str], features: list[str], target: str, alpha: float = 1.0) -> dict[tuple, list[float]]:
    """Intercept and weights of a ridge regression for each group, from one aggregate of central moments; a group's moments are all that comes to the driver."""
    names = [*features, target]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    have = rows.where(F.col(target).isNotNull()).select(*by, *(F.col(c).cast("double").alias(c) for c in names))
    moments = have.groupBy(*by).agg(F.count("*").alias("_n"), *(F.avg(c).alias(f"_m{i}") for i, c in enumerate(names)), *(F.covar_pop(a, b).alias(f"_c{i}") for i, (a, b) in enumerate(pairs)))
    out = {}
    for r in moments.collect():  # a row a group
        c = {p: r[f"_c{i}"] * r["_n"] for i, p in enumerate(pairs)}
        at = lambda a, b: c.get((a, b), c.get((b, a)))  # noqa: B023, E731
        gram = np.array([[at(a, b) for b in features] for a in features]).reshape(len(features), -1) + alpha * np.eye(len(features))
        w = np.linalg.solve(gram, np.array([at(a, target) for a in features])) if features else np.zeros(0)
        out[tuple(r[k] for k in by)] = [float(r[f"_m{len(features)}"] - w @ np.array([r[f"_m{i}"] for i in range(len(features))])), *map(float, w)]
    return out


def ridge(rows: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> list[float]:
    """Intercept and weights of a ridge regression over all rows."""
    return ridges(rows, [], features, target, alpha)[()]


#: Rows of a group that are held for all permutations, and places that are moved at once.
BLOCK, CHUNK = 1 << 18, 1 << 16
ROUNDS, MIX_A, MIX_B = 6, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shuffled(place: np.ndarray, n: int, seed: int, k) -> np.ndarray:
    """Where permutation k of n places puts these: a bijection of 0 to n - 1, so a task needs its own rows alone. For an array k, a row a permutation.

    A Feistel network over the next power of 4, walked along its cycle until it is back below n.
    """
    half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    low = (np.uint64(1) << half) - np.uint64(1)
    which = np.atleast_1d(np.asarray(k, np.uint64))[:, None] * np.uint64(0xD1B54A32D192ED03)

    def once(x, own):
        left, right = x >> half, x & low
        for r in range(ROUNDS):
            h = (right + own + np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0x8CB92BA72F3D8DD7) % 2**64)) * MIX_A
            h = (h ^ (h >> np.uint64(29))) * MIX_B
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & low)
        return left << half | right

    out = once(place.astype(np.uint64)[None, :], which)
    own = np.broadcast_to(which, out.shape)
    while (over := out >= n).any():
        out[over] = once(out[over], own[over])
    return (out if np.ndim(k) else out[0]).astype(np.int64)


def labelled_sums(place: np.ndarray, r: np.ndarray, n: int, n_right: int, seed: int, permutations: int) -> np.ndarray:
    """For each permutation the sum of `r` over the places that `shuffled` puts below n_right.

    Half a place has few values next to the rows of a block, so a round is looked up in a table of its own.
    """
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    out, use = np.zeros(permutations), r != 0
    place, r = place[use].astype(np.int64), r[use]
    if 1 << half > len(place):
        step = max(1, BLOCK // max(len(place), 1))
        for k in range(0, permutations, step):
            some = np.arange(k, min(k + step, permutations))
            out[some] += (shuffled(place, n, seed, some) < n_right) @ r
        return out
    low, values = (1 << half) - 1, np.arange(1 << half, dtype=np.uint64)
    rounds = [np.uint64((seed * 0x9E3779B97F4A7C15 + i * 0x8CB92BA72F3D8DD7) % 2**64) for i in range(ROUNDS)]

    def once(x, tables):
        left, right = x >> half, x & low
        for t in tables:
            left ^= t[right]
            left, right = right, left
        return left << half | right

    for k in range(permutations):
        own, tables = np.uint64(k * 0xD1B54A32D192ED03 % 2**64), []
        for more in rounds:
            h = (values + own + more) * MIX_A
            h = (h ^ (h >> np.uint64(29))) * MIX_B
            tables.append(((h ^ (h >> np.uint64(32))) & np.uint64(low)).astype(np.int64))
        for i in range(0, len(place), CHUNK):
            at, mine = once(place[i : i + CHUNK], tables), r[i : i + CHUNK]
            out[k] += mine[at < n_right].sum()
            over = np.flatnonzero(at >= n)
            at, mine = at[over], mine[over]
            while len(at):
                at = once(at, tables)
                out[k] += mine[at < n_right].sum()
                over = np.flatnonzero(at >= n)
                at, mine = at[over], mine[over]
    return out


def relabelled_sums(rows: DataFrame, by: list[str], permutations: int, seed: int) -> DataFrame:
    """by, k, s: for each permutation the sum of `r` over the n_right rows that it labels.

    `rows`: by, place (0 to n - 1), n, n_right, r. Each task adds its rows up for
    all permutations, some BLOCK of a group at once, and gives one vector a group;
    rows x permutations never exist.
    """
    keys = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in by)

    def run(batches):
        sums, held, size = {}, {}, 0

        def add(key):
            mine = held.pop(key)
            place, r = (np.concatenate([m[i] for m in mine]) for i in (0, 1))
            sums[key] = sums.get(key, 0.0) + labelled_sums(place, r, mine[0][2], mine[0][3], seed, permutations)
            return len(place)

        for pdf in batches:
            for key, part in pdf.groupby(by, dropna=False):
                held.setdefault(key, []).append((part.place.to_numpy(np.int64), part.r.to_numpy(float), int(part.n.iloc[0]), int(part.n_right.iloc[0])))
                size += len(part)
                if sum(len(m[0]) for m in held[key]) >= BLOCK:
                    size -= add(key)
            while size > 8 * BLOCK:
                size -= add(max(held, key=lambda k: sum(len(m[0]) for m in held[k])))
        for key in list(held):
            add(key)
        if sums:
            yield pd.DataFrame([(*key, v.tolist()) for key, v in sums.items()], columns=[*by, "v"])

    parts = rows.mapInPandas(run, f"{keys}, v array<double>")
    return parts.select(*by, F.posexplode("v").alias("k", "s")).groupBy(*by, "k").agg(F.sum("s").alias("s"))


def informativeness(rows: DataFrame, features: list[str], train: F.Column, permutations: int = 2000, seed: int = 0, least_train: int = 50, least_test: int = 15, by: str | None = None) -> DataFrame:
    """Is censoring informative beyond the features? A row for each value of `by` (one row without it).

    A ridge regression on exact training rows gives predictions. Over test rows the
    positive part of value minus prediction (exact rows) is compared with that of
    lower bound minus prediction (right-censored rows, where it is a lower bound).
    The difference of means is held against relabelled rows: each permutation
    labels exactly as many rows as are right-censored. `p` counts the permutations
    whose difference is as far from 0. Groups with too few rows have null results.
    """
    kind = labels()
    data = rows.select(F.col(by).cast("string").alias("g") if by else F.lit("").alias("g"), "row_id", "value_p", "lower", kind["is_right"].alias("c"), kind["is_censored"].alias("any"), F.coalesce(train, F.lit(False)).alias("train"), *(F.col(f).cast("double").alias(f) for f in features))
    data = saved(data.where("g is not null"))
    exact = data.where(F.col("train") & ~F.col("any") & F.col("value_p").isNotNull())
    weights = ridges(exact, ["g"], features, "value_p")
    listed = data.sparkSession.createDataFrame([(k[0], w) for k, w in weights.items()], "w_g string, w array<double>")
    fitted = reduce(lambda a, i: a + F.get("w", F.lit(i + 1)) * F.col(features[i]), range(len(features)), F.get("w", F.lit(0)))
    test = data.where(~F.col("train") & (F.col("c") | (~F.col("any") & F.col("value_p").isNotNull())))
    residual = F.greatest(F.when(F.col("c"), F.col("lower")).otherwise(F.col("value_p")) - fitted, F.lit(0.0))
    test = test.join(small(listed), F.col("g") == F.col("w_g")).select("g", "row_id", "c", residual.alias("r"))
    placed = saved(hash_ranked(test, ["g"], F.md5(F.col("row_id").cast("binary")), ["row_id", "c", "r"]).select("g", "place", "c", "r"))
    counts = placed.groupBy("g").agg(F.count("*").alias("n"), F.count_if("c").alias("n_right"), F.avg(F.when(F.col("c"), F.col("r"))).alias("m_right"), F.avg(F.when(~F.col("c"), F.col("r"))).alias("m_exact"), F.sum("r").alias("total"))
    counts = saved(counts)
    trained = exact.groupBy("g").agg(F.count("*").alias("n_exact_train"))
    enough = counts.join(trained, "g").where((F.col("n_exact_train") >= least_train) & (F.col("n_right") >= least_test) & (F.col("n") - F.col("n_right") >= least_test))
    chosen = saved(enough.select(F.col("g").alias("e_g"), F.col("n").alias("e_n"), "n_right", "total", (F.col("m_right") - F.col("m_exact")).alias("observed")))
    relabelled = relabelled_sums(placed.join(small(chosen), F.col("g") == F.col("e_g")).select("g", "place", F.col("e_n").alias("n"), "n_right", "r"), ["g"], permutations, seed)
    stats = relabelled.join(small(chosen), F.col("g") == F.col("e_g")).withColumn("d", F.col("s") / F.col("n_right") - (F.col("total") - F.col("s")) / (F.col("e_n") - F.col("n_right")))
    p = stats.groupBy("g").agg(F.first("observed").alias("difference"), ((F.count_if(F.abs("d") >= F.abs("observed") - 1e-12) + 1) / (permutations + 1)).alias("p"))
    groups = data.select("g").distinct() if by else data.sparkSession.createDataFrame([("",)], "g string")
    out = groups
    for more, name in ((trained, "t_g"), (counts, "c_g"), (p, "p_g")):
        out = out.join(more.withColumnRenamed("g", name), F.col("g") == F.col(name), "left").drop(name)
    train_n = F.coalesce("n_exact_train", F.lit(0).cast("long"))
    tested = train_n >= least_train
    found = out.select(*([F.col("g").alias(by)] if by else []), train_n.alias("n_exact_train"), F.when(tested, F.coalesce("n_right", F.lit(0).cast("long"))).alias("n_right_test"), F.when(tested, F.coalesce(F.col("n") - F.col("n_right"), F.lit(0).cast("long"))).alias("n_exact_test"), "difference", "p")
    return found.withColumn("informative", (F.col("p") < 0.05) & (F.col("difference") > 0))
