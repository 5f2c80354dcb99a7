"""Interval-aware Gaussian models with random effects by assay: shared weights and one small effect for each assay.

A row's label is N(mu, sigma) cut to its bounds, with

    mu = x w + b,  log sigma = x v + r  (kept in [-4, 3]),

where b and r belong to the row's assay and are drawn towards 0 by a Gaussian
prior: (b / tau_b)^2 / 2 + (r / tau_r)^2 / 2 is added to the summed negative log
likelihood. An assay that isn't known has b = r = 0. Features of assays (see
`with_assay_features`) are shared features like others, so an unseen assay gets
what its features tell, and the effects are what they leave over.

Effects are a DataFrame, (cell, assay, b, r), however many there are. Lines are
dealt out by assay and packed once. A step of Newton's method is one pass over
them, joined with what the step before left of each assay, where alone there is
a shuffle: every assay finds its own step from the shared one, then its own
gradient, curvature and their products with x. The same pass eliminates assays
(the Schur complement of the arrow-shaped curvature), so that the driver solves
for the shared weights of a cell alone. mu and log sigma have
curvatures of their own, both non-negative: exact rows use expected ones,
censored rows the exact one for mu and the squared slope for log sigma. Steps
that don't descend are halved.

A cell is any key, an endpoint or a fold of one; all cells are fitted at once.
A cell without rows, or without exact rows, is a cell with an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boundlab.functions.arrays import log_ndtr
from boundlab.session import dealt, kept, saved, small

LOG_ROOT = 0.5 * math.log(2 * math.pi)
LOW, HIGH = -4.0, 3.0
#: A step is halved so often at most.
HALVINGS = 12
#: Lines of an assay in one row; tasks over which lines without an assay are dealt.
PACK, SALTS = 256, 64


@dataclass
class Fitted:
    """cells: {cell: {w, v, loss, n, steps, converged, error}}; effects: cell, assay, n, b, r for each assay trained on."""

    cells: dict
    effects: DataFrame
    features: list[str] = field(default_factory=list)


def terms(low: np.ndarray, high: np.ndarray, exact: np.ndarray, mu: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """Negative log likelihood of each row, its slopes by mu and log sigma, and their curvatures."""
    free = (raw > LOW) & (raw < HIGH)
    log_s = np.clip(raw, LOW, HIGH)
    s = np.exp(log_s)
    z = np.where(exact, np.where(exact, high, 0) - mu, 0) / s
    loss, g_mu, h_mu, g_l, h_l = z * z / 2 + log_s + LOG_ROOT, -z / s, 1 / s**2, 1 - z * z, np.full(len(mu), 2.0)
    zl, zu = np.where(exact, -np.inf, low - mu) / s, np.where(exact, np.inf, high - mu) / s
    right = ~exact & np.isposinf(high)
    left = ~exact & ~right & np.isneginf(low)
    both = ~(exact | right | left)
    log_q = np.zeros(len(mu))
    with np.errstate(all="ignore"):
        log_q[right], log_q[left] = log_ndtr(-zl[right]), log_ndtr(zu[left])
        a, b = zl[both], zu[both]
        flip = a > 0
        more, less = log_ndtr(np.where(flip, -a, b)), log_ndtr(np.where(flip, -b, a))
        log_q[both] = np.minimum(more + np.log1p(-np.exp(np.minimum(less - more, -1e-12))), 0)
        density = lambda v: np.where(np.isfinite(v), np.exp(np.where(np.isfinite(v), -v * v / 2, 0) - LOG_ROOT - log_q), 0.0)
        fl, fu = density(zl), density(zu)
        vl, vu = np.where(np.isfinite(zl), zl, 0), np.where(np.isfinite(zu), zu, 0)
        slope, twist = (fu - fl) / s, fu * vu - fl * vl
        bend = np.maximum(slope**2 + twist / s**2, 0)  # -log of a probability between bounds is convex in mu
    pick = lambda a, b: np.where(exact, a, b)
    return pick(loss, -log_q), pick(g_mu, slope), pick(h_mu, bend), pick(g_l, twist) * free, pick(h_l, np.maximum(twist**2, 1e-6)) * free


def _line_terms(x, low, high, exact, n, spread, mu, raw):
    """terms() of lines that stand for n rows; exact rows lie about the line's mean. Only censored lines need probabilities."""
    log_s = np.clip(raw, LOW, HIGH)
    inside, over = (raw > LOW) & (raw < HIGH), np.exp(-2 * log_s)
    e = np.where(exact, np.where(exact, high, 0) - mu, 0)
    zz, more = e * e * over, np.where(exact, spread * over, 0)
    out = [n * (zz / 2 + log_s + LOG_ROOT) + more / 2, -n * e * over, n * over, (n * (1 - zz) - more) * inside, 2.0 * n * inside]
    cut = np.flatnonzero(~exact & (n > 0))
    if len(cut):
        for mine, found in zip(out, terms(low[cut], high[cut], np.zeros(len(cut), bool), mu[cut], raw[cut]), strict=True):
            mine[cut] = n[cut] * found
    return out


def _pass(features: list[str], slots: int, held: bool, now: dict, pull: tuple[float, float]):
    """A step's pass over the packed lines, which lie by cell and assay, joined with what the step before left of each assay.

    now: by key of cells, for each slot (the fold held out) None or (state, w, v, dw, dv, t). An assay first goes its own way
    along the shared step, then its lines are added up at that point. Of each assay and slot the pass gives
    (b, r, n, g_b, h_b, g_r, h_r, c_b.., c_r..): the point, rows, slopes, curvatures and products with x; and of each cell, with assay
    null, a task's sums: rows, loss, shared slopes and curvatures, prior, what assays take from the shared ones, and what their own steps gain.
    """
    p = len(features) + 1
    m = 7 + 2 * p

    def run(batches):
        total: dict = {}
        late = None  # the last assay of a batch may go on in the next one

        def closed(key, points, likely):
            """Adds the prior to whole assays of a cell; gives their rows."""
            for k, c in enumerate(now[key]):
                if c is None or c[0] != "open":
                    continue
                mine, at = likely[:, k], total[key, k]
                at[-1 - 2 * (p + p * p) - 1] += (pull[0] * mine[:, 0] ** 2 + pull[1] * mine[:, 1] ** 2).sum() / 2
                for side, weight in enumerate(pull):
                    g, h = mine[:, 3 + 2 * side], mine[:, 4 + 2 * side]
                    g += weight * mine[:, side]
                    h += weight if weight else np.inf  # without a prior there is no effect: an endless curvature
                    along = mine[:, 7 + side * p : 7 + (side + 1) * p]
                    o = 2 + 2 * p + 2 * p * p + 1 + side * (p + p * p)
                    at[o : o + p] += along.T @ (g / h)
                    at[o + p : o + p + p * p] += ((along / h[:, None]).T @ along).ravel()
                    at[-1] += (g * g / h).sum()
            known = [i for i, (_, name) in enumerate(points) if name is not None]
            if not known:
                return None
            flat = likely[known].reshape(len(known), -1)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(known) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
            return pa.RecordBatch.from_arrays([pa.array([key] * len(known)), pa.array([points[i][1] for i in known]), pa.nulls(len(known), pa.int32()), values, pa.nulls(len(known), pa.list_(pa.float64()))], names=["cell", "assay", "f", "s", "t"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, names, packed = batch.column("cell").to_pylist(), batch.column("assay").to_pylist(), batch.column("lines")
            at = list(zip(keys, names, strict=True))
            head = np.array([i for i, k in enumerate(at) if not i or k != at[i - 1]])
            first = np.r_[0, np.cumsum(packed.value_lengths().to_numpy(zero_copy_only=False))]
            flat = packed.flatten()
            field_of = lambda name: flat.field(flat.type.get_field_index(name)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            low, high, n, spread = (field_of(c).astype(float) for c in ("lower", "upper", "n", "spread"))
            exact, fold = field_of("exact_mask").astype(bool), field_of("fold")
            x = np.c_[np.ones(len(n)), *(field_of(c).astype(float) for c in features)]
            before = np.zeros((len(head), slots * m))
            for i, value in enumerate(batch.column("s").take(pa.array(head))):
                if value.is_valid:
                    before[i] = value.values.to_numpy(zero_copy_only=False)
            before = before.reshape(len(head), slots, m)
            base = [keys[i] for i in head]
            cuts = [0, *(i for i in range(1, len(base)) if base[i] != base[i - 1]), len(base)]
            for r0, r1 in zip(cuts, cuts[1:], strict=False):
                key, points = base[r0], [at[i] for i in head[r0:r1]]
                if key not in now:
                    continue
                l0, l1 = first[head[r0]], first[head[r1]] if r1 < len(head) else first[-1]
                mine, starts = slice(l0, l1), first[head[r0:r1]] - l0
                run_of = np.repeat(np.arange(r1 - r0), np.diff(np.r_[starts, l1 - l0]))
                free = np.array([name is not None for _, name in points])
                likely = before[r0:r1].copy()
                for k, c in enumerate(now[key]):
                    if c is None:
                        continue
                    state, w, v, dw, dv, t = c
                    weight = n[mine] * (fold[mine] != k) if held else n[mine]
                    if state != "open":
                        if state == "first":
                            likely[:, k, 2] = np.add.reduceat(weight, starts)
                        continue
                    b, r = likely[:, k, 0], likely[:, k, 1]
                    if t:
                        was = before[r0:r1, k]
                        with np.errstate(all="ignore"):
                            b += np.where(free, -t * (was[:, 3] + was[:, 7 : 7 + p] @ dw) / was[:, 4], 0)
                            r += np.where(free, -t * (was[:, 5] + was[:, 7 + p :] @ dv) / was[:, 6], 0)
                    xs = x[mine]
                    loss, g_mu, h_mu, g_l, h_l = _line_terms(xs, low[mine], high[mine], exact[mine], weight, spread[mine] * (weight > 0), xs @ w + b[run_of], xs @ v + r[run_of])
                    columns = np.vstack([weight, g_mu, h_mu, g_l, h_l, xs.T * h_mu, xs.T * h_l])
                    likely[:, k, 2:] = np.add.reduceat(columns, starts, axis=1).T
                    shared = np.r_[weight.sum(), loss.sum(), xs.T @ g_mu, xs.T @ g_l, ((xs * h_mu[:, None]).T @ xs).ravel(), ((xs * h_l[:, None]).T @ xs).ravel()]
                    have = total.setdefault((key, k), np.zeros(len(shared) + 2 + 2 * (p + p * p)))
                    have[: len(shared)] += shared
                if late is not None:
                    if late[0] == key and late[1] == points[0]:
                        for k, c in enumerate(now[key]):
                            if c is not None and c[0] != "shut":
                                likely[0, k, 2:] += late[2][0, k, 2:]
                    elif (rows := closed(late[0], [late[1]], late[2])) is not None:
                        yield rows
                late = (key, points[-1], likely[-1:].copy())
                if len(points) > 1 and (rows := closed(key, points[:-1], likely[:-1])) is not None:
                    yield rows
        if late is not None and (rows := closed(late[0], [late[1]], late[2])) is not None:
            yield rows
        if total:
            sums = [(key, None, k, None, v.tolist()) for (key, k), v in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*sums, strict=True), (pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], names=["cell", "assay", "f", "s", "t"])

    return run


def _summed(parts: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Arrays of n sums added up by keys, place by place."""
    return parts.groupBy(*keys).agg(F.array(*(F.sum(F.get("v", F.lit(i))) for i in range(n))).alias("v"))


def _moments(rows: DataFrame, slots: int, held: bool) -> dict:
    """Of each cell that has rows to train on: (rows, mean and deviation of exact values); a row an endpoint and fold comes to the driver."""
    y = F.when(F.col("exact_mask"), F.col("lower"))
    found = rows.groupBy("cell", "fold").agg(F.count("*").alias("n"), F.count(y).alias("c"), F.avg(y).alias("m"), F.var_pop(y).alias("q")).collect()
    out: dict = {}
    for key in sorted({r["cell"] for r in found}):
        for k in range(slots):
            mine = [r for r in found if r["cell"] == key and not (held and r["fold"] == k)]
            exact = [r for r in mine if r["c"]]
            count = sum(r["c"] for r in exact)
            mean = sum(r["c"] * r["m"] for r in exact) / count if count else None
            if mine:
                out[key, k] = (sum(r["n"] for r in mine), mean, math.sqrt(sum(r["c"] * (r["q"] + (r["m"] - mean) ** 2) for r in exact) / count) if count else None)
    return out


def fit_effects(rows: DataFrame, features: list[str], cell: str = "endpoint", assay: str = "assay_id", tau_b: float = 1.0, tau_r: float = 1.0, constant_scale: bool = False, ridge: float = 1e-6, steps: int = 40, tolerance: float = 1e-5, held: str | None = None, folds: int = 1) -> Fitted:
    """Fits every cell of `rows` (cell, assay, lower, upper, exact_mask, features).

    With `held`, the column of a row's fold, there is a cell 'cell|f' for each of the `folds` folds, which trains on the
    other rows; lines are laid out once for all of them. `constant_scale` leaves features out of log sigma (its assay
    effects stay). Rows without an assay take part with b = r = 0. `tolerance` bounds what a Newton step could still
    gain, for each row. tau of 0 takes the effects out.
    """
    spark, p, slots = rows.sparkSession, len(features) + 1, folds if held else 1
    m, size = 7 + 2 * p, 2 + 2 * (p + p * p)
    exact = F.coalesce(F.col("exact_mask"), F.lit(False))
    fold = F.coalesce(F.col(held).cast("int"), F.lit(-1)) if held else F.lit(-1)
    single = rows.select(F.col(cell).alias("cell"), F.col(assay).cast("string").alias("assay"), fold.alias("fold"), "lower", "upper", exact.alias("exact_mask"), *(F.col(f).cast("double").alias(f) for f in features)).where("cell is not null")
    first = _moments(single, slots, bool(held))
    # exact rows of an assay with equal features by count, mean and spread, censored ones with equal bounds too by count
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    place = ["cell", "_a"]
    lot = F.when(F.col("assay").isNull(), F.concat(F.lit("-"), F.pmod(F.xxhash64("lower", "upper", *features), F.lit(SALTS)).cast("string"))).otherwise(F.concat(F.lit("+"), "assay"))
    bounds = {"_l": F.when(~F.col("exact_mask"), F.col("lower")), "_u": F.when(~F.col("exact_mask"), F.col("upper"))}
    lines = single.withColumns({"_a": lot, **bounds}).groupBy(*place, "assay", "fold", "exact_mask", *features, "_l", "_u")
    value = F.when(F.col("exact_mask"), F.col("upper"))
    lines = lines.agg(F.count("*").cast("double").alias("n"), F.avg(value).alias("_m"), F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0)).alias("spread"))
    bound = lambda c: F.when(F.col("exact_mask"), F.col("_m")).otherwise(F.col(c)).alias({"_l": "lower", "_u": "upper"}[c])
    lines = kept(lines.select(*place, "assay", "fold", "exact_mask", bound("_l"), bound("_u"), "n", "spread", *features))
    # dealt out by assay, so that a step shuffles what it knows of assays, never lines
    lines = lines.repartition(parts, *place).withColumn("_p", F.floor((F.row_number().over(Window.partitionBy(*place).orderBy("fold")) - 1) / PACK))
    packed = lines.groupBy(*place, "assay", "_p").agg(F.collect_list(F.struct("fold", "exact_mask", "lower", "upper", "n", "spread", *features)).alias("lines"))
    packed = dealt(packed.drop("_p").sortWithinPartitions(*place))
    name = lambda key: f"{key[0]}|{key[1]}" if held else key[0]
    cells: dict = {}
    for key, (n, mean, sd) in first.items():
        w, v = np.zeros(p), np.zeros(p)
        w[0], v[0] = mean or 0.0, math.log(max(sd or 1.0, 1e-2))
        cells[key] = {"w": w, "v": v, "dw": np.zeros(p), "dv": np.zeros(p), "t": 0.0, "loss": None, "gain": None, "n": n, "steps": 0, "converged": False, "halved": 0, "error": None if mean is not None else "no exact rows to train on"}
    open_ = {k for k, c in cells.items() if c["error"] is None}
    pull = tuple(1 / t**2 if t > 0 else 0.0 for t in (tau_b, tau_r))
    state = None
    empty = spark.createDataFrame([], "s_c string, s_a string, s array<double>")

    def step(open_, state):
        """A pass over all lines: what it leaves of each assay, and the sums of each open cell."""
        now: dict = {}
        for key, c in cells.items():
            mode = "open" if key in open_ else "first" if state is None else "shut"
            now.setdefault(key[0], [None] * slots)[key[1]] = (mode, c["w"] + c["t"] * c["dw"], c["v"] + c["t"] * c["dv"], c["dw"], c["dv"], c["t"])
        left = empty if state is None else state.select(F.col("cell").alias("s_c"), F.concat(F.lit("+"), "assay").alias("s_a"), "s")
        same = (F.col("cell") == F.col("s_c")) & (F.col("_a") == F.col("s_a"))
        both = packed.join(left.hint("merge"), same, "left").select("cell", "assay", "lines", "s")
        made = saved(both.mapInArrow(_pass(features, slots, bool(held), now, pull), "cell string, assay string, f int, s array<double>, t array<double>"))
        sums = _summed(made.where("f is not null").select("cell", "f", F.col("t").alias("v")), ["cell", "f"], 2 + 2 * p + 2 * p * p + size)
        return made.where("f is null").select("cell", "assay", "s"), {(r["cell"], r["f"]): np.array(r["v"]) for r in sums.collect()}  # a row a cell

    for _ in range(steps):
        if not open_:
            break
        before, tried = state, set(open_)
        state, found = step(open_, before)
        back = set()
        for k in sorted(tried):
            c, flat = cells[k], found[k]
            off = flat[2 + 2 * p + 2 * p * p :]
            c["steps"] += 1
            at = c["w"] + c["t"] * c["dw"], c["v"] + c["t"] * c["dv"]
            loss = flat[1] + off[0] + ridge / 2 * (at[0][1:] @ at[0][1:] + at[1][1:] @ at[1][1:])
            if c["loss"] is not None and not loss <= c["loss"] - 1e-4 * c["t"] * c["gain"] + 1e-12 * abs(c["loss"]):
                back.add(k)
                c["t"] /= 2
                c["halved"] += 1
                if c["halved"] >= HALVINGS:  # no step is left: the last point stands
                    c["t"] = 0.0
                    c["converged"] = c["gain"] <= 1e-3 * c["n"]
                    open_.discard(k)
                continue
            c.update(w=at[0], v=at[1], loss=float(loss), halved=0)
            steps_, gain = [], float(off[-1])  # what the assays' own steps gain
            for side in (0, 1):
                g, h = flat[2 + side * p : 2 + (side + 1) * p], flat[2 + 2 * p + side * p * p : 2 + 2 * p + (side + 1) * p * p].reshape(p, p)
                o = 1 + side * (p + p * p)
                og, oh = off[o : o + p], off[o + p : o + p + p * p].reshape(p, p)
                hold = np.r_[0.0, np.full(p - 1, ridge)]
                a, rhs = h - oh + np.diag(hold + 1e-9), g + hold * (c["w"], c["v"])[side] - og
                if side and constant_scale:
                    a, rhs = a[:1, :1], rhs[:1]
                d = np.zeros(p)
                d[: len(rhs)] = -np.linalg.solve(a, rhs)
                steps_.append(d)
                gain -= float(d[: len(rhs)] @ rhs)
            c.update(dw=steps_[0], dv=steps_[1], gain=gain, t=1.0)
            if c["gain"] <= tolerance * c["n"]:
                c["converged"], c["t"] = True, 0.0
                open_.discard(k)
        if back:  # cells that didn't descend stay where they were
            old = before.select(F.col("cell").alias("o_c"), F.col("assay").alias("o_a"), F.col("s").alias("o_s"))
            pick = [F.when(F.col("cell").isin(*(c for c, k in back if k == i)), F.slice("o_s", i * m + 1, m)).otherwise(F.slice("s", i * m + 1, m)) if any(k == i for _, k in back) else F.slice("s", i * m + 1, m) for i in range(slots)]
            state = saved(state.join(old, (F.col("cell") == F.col("o_c")) & (F.col("assay") == F.col("o_a"))).select("cell", "assay", F.concat(*pick).alias("s")))
    if state is None:
        state = step(set(), None)[0]
    for c in cells.values():
        for gone in ("dw", "dv", "t", "halved", "gain"):
            c.pop(gone, None)
    numbers = lambda i: [F.get("s", F.lit(i * m + j)).alias(c) for j, c in enumerate(("b", "r", "n"))]
    listed = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), *numbers(i)) for i in range(slots))))
    effects = state.select("cell", "assay", listed.alias("e")).where("e.n > 0")
    key = F.concat_ws("|", "cell", "e.f") if held else F.col("cell")
    effects = saved(effects.select(key.alias("cell"), F.col("assay").cast(dict(rows.select(F.col(assay).alias("assay")).dtypes)["assay"]).alias("assay"), F.col("e.n").cast("long").alias("n"), F.col("e.b").alias("b"), F.col("e.r").alias("r")))
    return Fitted({name(k): c for k, c in cells.items()}, effects, list(features))


def predicted(rows: DataFrame, fitted: Fitted, cell: str = "endpoint", assay: str = "assay_id") -> DataFrame:
    """rows of fitted cells with mu, sigma and `known`: whether the assay has an effect."""
    p = len(fitted.features) + 1
    listed = [(k, *map(float, c["w"]), *map(float, c["v"])) for k, c in fitted.cells.items() if c["error"] is None]
    weights = rows.sparkSession.createDataFrame(listed, "p_c string" + "".join(f", p_{s}{i} double" for s in "wv" for i in range(p)))
    dot = lambda s: sum((F.col(f"p_{s}{i + 1}") * F.col(f).cast("double") for i, f in enumerate(fitted.features)), F.col(f"p_{s}0"))
    mu, raw = dot("w"), dot("v")
    effects = fitted.effects.select(F.col("cell").alias("e_c"), F.col("assay").alias("e_a"), F.col("b").alias("e_b"), F.col("r").alias("e_r"))
    both = rows.join(F.broadcast(weights), F.col(cell) == F.col("p_c"))  # a row a cell
    both = both.join(small(effects), (F.col(cell) == F.col("e_c")) & (F.col(assay) == F.col("e_a")), "left")
    made = both.withColumns({"mu": mu + F.coalesce("e_b", F.lit(0.0)), "sigma": F.exp(F.greatest(F.lit(LOW), F.least(F.lit(HIGH), raw + F.coalesce("e_r", F.lit(0.0))))), "known": F.col("e_b").isNotNull()})
    return made.select(*rows.columns, "mu", "sigma", "known")


def with_assay_features(rows: DataFrame, assays: DataFrame, features: list[str], assay: str = "assay_id") -> DataFrame:
    """rows with the features of their assays (one row an assay); an assay that isn't listed has 0, like missing values."""
    named = assays.select(F.col(assay).alias("f_a"), *features)
    both = rows.join(small(named), F.col(assay) == F.col("f_a"), "left").drop("f_a")
    return both.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
