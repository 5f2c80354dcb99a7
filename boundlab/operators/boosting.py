"""Boosted trees on interval labels: an accelerated-failure-time model by histograms that Spark adds up.

Labels are bounds on ln(concentration); errors are normal with a fixed scale. A
round adds one tree a cell, fitted to the slopes and curvatures of the loss at
the margins so far. Features are cut into bins once, at approximate quantiles of
the training rows, and rows are laid out by cell and bins. A round reads the rows
once: as a tree knows a row by its bins alone, slopes and curvatures are added up
by (cell, bins of the round's features), and what rounds since the last writing
of the margins add is evaluated once for each run of equal bins. A level of a
tree is one aggregate of these sums by (cell, node, feature, bin); what comes to
the driver, bins x features x nodes of each cell, decides the splits. Margins are
written to the checkpoint folder every few rounds. Cells that differ in the fold
held out share one layout of the rows (`held`), by their features' own values.

Missing features go the way that gains more at each split. Rows marked `valid`
take no part in fitting; their loss, gathered along with the next round's sums,
stops a cell that hasn't improved for `patience` rounds, and their exact
labels give a calibrated deviation (`fit_scale`).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from boundlab.functions import distributions as D
from boundlab.operators.effects import HIGH, LOG_ROOT, LOW, terms
from boundlab.session import kept, saved

LOG_TEN = math.log(10)
DEFAULTS = {"rounds": 400, "patience": 40, "rate": 0.05, "depth": 6, "bins": 64, "scale": 1.0, "least_weight": 1.0, "penalty": 1.0, "subsample": 0.8, "columns": 0.8, "seed": 0}
#: Rounds between two writings of the margins.
KEPT_ROUNDS = 8
#: Different values of cells and features that are predicted on their own.
FEW = 100_000
#: Rows of a task that are added up at once where rows are laid out for all folds.
TOGETHER = 200_000
#: Slopes and curvatures of a row are kept within these, so that a far label can't rule a leaf.
MOST_SLOPE, MOST_CURVE, LEAST_CURVE = 15.0, 15.0, 1e-16
ODD = 0x9E3779B97F4A7C15


@dataclass
class Tree:
    """Nodes by number: a split (feature, last bin that goes left, where missing goes, children) or a leaf (feature -1) with its value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, missing_left: bool, values: tuple[float, float]) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.missing_left[node] = feature, bin_, missing_left
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for v in values:
            for name, x in (("feature", -1), ("bin", 0), ("missing_left", False), ("left", 0), ("right", 0), ("value", v)):
                getattr(self, name).append(x)
        return self.left[node], self.right[node]

    def nodes(self, x: np.ndarray, missing: int) -> np.ndarray:
        """The node where each row of binned features ends."""
        feature, cut, left, right, way = (np.array(a) for a in (self.feature, self.bin, self.left, self.right, self.missing_left))
        at = np.zeros(len(x), int)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            b = x[np.arange(len(x)), np.maximum(f, 0)]
            goes_left = np.where(b == missing, way[at], b <= cut[at])
            at = np.where(inner, np.where(goes_left, left[at], right[at]), at)

    def values(self, x: np.ndarray, missing: int) -> np.ndarray:
        return np.array(self.value)[self.nodes(x, missing)]


@dataclass
class Boosted:
    """Per cell: edges of bins, base margin, trees, rounds used, losses of training and validation rows by round, sigma on the p scale, error."""

    features: list[str]
    options: dict
    cells: dict

    def margins(self, cell, values: np.ndarray) -> np.ndarray:
        c, bins = self.cells[cell], self.options["bins"]
        x = binned(values, c["edges"], bins)
        return c["base"] + sum((t.values(x, bins) for t in c["trees"][: c["best"]]), np.zeros(len(x)))


def binned(values: np.ndarray, edges: list[np.ndarray], bins: int) -> np.ndarray:
    """The bin of each feature, the number of edges at or below it; missing and non-finite ones get the number `bins`."""
    out = np.empty(values.shape, np.int32)
    for k, e in enumerate(edges):
        v = values[:, k]
        out[:, k] = np.where(np.isfinite(v), np.searchsorted(e, np.where(np.isfinite(v), v, 0), side="right"), bins)
    return out


def best_split(g: np.ndarray, h: np.ndarray, columns: list[int], penalty: float, least_weight: float):
    """(gain, feature, bin, missing goes left, (left sums), (right sums)) from sums by (feature, bin); the last bin is missing. None if nothing gains.

    Ties go to the smaller feature, then the smaller bin, then missing to the left.
    """
    best = None
    score = lambda a, b: a * a / (b + penalty)
    for f in columns:
        total_g, total_h = g[f].sum(), h[f].sum()
        for way in (True, False):
            left_g, left_h = np.cumsum(g[f][:-1])[:-1] + way * g[f][-1], np.cumsum(h[f][:-1])[:-1] + way * h[f][-1]
            right_g, right_h = total_g - left_g, total_h - left_h
            ok = (left_h >= least_weight) & (right_h >= least_weight)
            gain = np.where(ok, score(left_g, left_h) + score(right_g, right_h) - score(total_g, total_h), -np.inf)
            k = int(gain.argmax()) if len(gain) else -1
            if k >= 0 and gain[k] > 1e-9 and (best is None or gain[k] > best[0] + 1e-12 * abs(best[0])):
                best = (float(gain[k]), f, k, way, (left_g[k], left_h[k]), (right_g[k], right_h[k]))
    return best


def _drawn(h: np.ndarray, round_: int, seed: int, share: float) -> np.ndarray:
    """Which rows a round takes, by a hash of theirs."""
    if share >= 1:
        return np.ones(len(h), bool)
    x = (h.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + round_ + 1) * ODD % 2**64)) * np.uint64(ODD)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) < np.uint64(int(share * 2**64) - 1)


def _slopes(low: np.ndarray, high: np.ndarray, margin: np.ndarray, log_scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature of each row as `terms` has them; exact rows take the parabola alone."""
    log_s = min(max(log_scale, LOW), HIGH)
    s = math.exp(log_s)
    z = (high - margin) / s
    loss, g, h = z * z / 2 + log_s + LOG_ROOT, -z / s, np.full(len(z), 1 / s**2)
    cut = np.flatnonzero(~(low == high))
    if len(cut):
        loss[cut], g[cut], h[cut] = terms(low[cut], high[cut], np.zeros(len(cut), bool), margin[cut], np.full(len(cut), log_scale))[:3]
    return loss, g, h


def _round_sums(p: int, asked: dict, columns: list[int], round_: int, o: dict):
    """A round's sums of a task's rows. asked: by number of cell, the trees that margins don't hold yet.

    Kind 0: slopes and curvatures of the rows drawn, by cell and bins of `columns` (none: not wanted). Kinds 1 and 2: loss
    and number of training and of validation rows. Rows lie by cell and bins, so that trees are evaluated once a run of equal ones.
    """
    names, used = [f"b{i}" for i in range(p)], [f"b{i}" for i in columns]
    log_scale = math.log(o["scale"])

    def run(batches):
        losses = np.zeros((4, max(asked) + 1))
        for pdf in batches:
            pdf = pdf[pdf.c.isin(asked)]
            if not len(pdf):
                continue
            c, x = pdf.c.to_numpy(), pdf[names].to_numpy(np.int32)
            head = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (x[1:] != x[:-1]).any(axis=1)])
            first, margin = c[head], pdf.margin.to_numpy(float)[head].copy()
            for k in np.unique(first):
                mine = np.flatnonzero(first == k)
                for t in asked[k]:
                    margin[mine] += t.values(x[head[mine]], o["bins"])
            loss, g, h = _slopes(pdf.low.to_numpy(float), pdf.high.to_numpy(float), np.repeat(margin, np.diff(np.r_[head, len(c)])), log_scale)
            valid = pdf.valid.to_numpy(bool)
            for i, w in enumerate((loss * ~valid, ~valid, loss * valid, valid)):
                losses[i] += np.bincount(c, w, losses.shape[1])
            if columns:
                use = ~valid & _drawn(pdf.h.to_numpy(np.int64), round_, o["seed"], o["subsample"])
                add = lambda v: np.add.reduceat(np.where(use, v, 0.0), head)  # noqa: B023, E731
                out = pd.DataFrame({"c": first, "kind": 0, **{n: x[head, i] for n, i in zip(used, columns, strict=True)}, "g": add(np.clip(g, -MOST_SLOPE, MOST_SLOPE)), "h": add(np.clip(h, LEAST_CURVE, MOST_CURVE))})
                yield out[out.h > 0]
        seen = np.flatnonzero(losses[1] + losses[3])
        for kind in (1, 2):
            yield pd.DataFrame({"c": seen, "kind": kind, **dict.fromkeys(used, 0), "g": losses[2 * kind - 2, seen], "h": losses[2 * kind - 1, seen]})

    return run, f"c int, kind int, {''.join(n + ' int, ' for n in used)}g double, h double", used


def _kinds(p: int) -> dict:
    """The columns of a block of rows that are laid out for all folds."""
    return {"c": np.int32, "fold": np.int32, "low": float, "high": float, "h": np.int64, "valid": bool, **{f"x{i}": float for i in range(p)}}


def _blocks(p: int):
    """Rows as blocks, a column's values in one binary value: what goes to Python every round is copied, not converted value by value."""
    kinds = _kinds(p)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(k).to_numpy(zero_copy_only=False).astype(t).tobytes()], pa.binary()) for k, t in kinds.items()], names=list(kinds))

    return run, ", ".join(f"{k} binary" for k in kinds)


def _held_sums(p: int, asked: dict, columns: list[int], round_: int, o: dict):
    """The same sums for cells that differ in the fold held out, from rows that are laid out once for all of them.

    asked: by number of an endpoint, for each fold (number of the cell, base margin, edges, trees). Rows lie by endpoint,
    features, fold and bounds. Of exact rows of a run, count, mean and spread about it are all that a parabola needs; a run with a
    slope beyond MOST_SLOPE goes row by row. Censored rows with equal bounds are one line. Only what a margin changes is done for each cell.
    """
    names, used = [f"x{i}" for i in range(p)], [f"b{i}" for i in columns]
    log_s = min(max(math.log(o["scale"]), LOW), HIGH)
    steep, flat = math.exp(-2 * log_s), log_s + LOG_ROOT
    size = 1 + max(cell[0] for cells in asked.values() for cell in cells.values())

    def sums(pdf, losses):
        c, fold, low, high = pdf.c.to_numpy(), pdf.fold.to_numpy(), pdf.low.to_numpy(float), pdf.high.to_numpy(float)
        x = pdf[names].to_numpy(float)
        x = np.where(np.isfinite(x), x, np.inf)  # missing ones are equal
        starts = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (fold[1:] != fold[:-1]) | (x[1:] != x[:-1]).any(axis=1)])
        run_of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(c)]))
        total = lambda v: np.add.reduceat(v.astype(float), starts)
        valid, exact = pdf.valid.to_numpy(bool), low == high
        drawn = ~valid & _drawn(pdf.h.to_numpy(np.int64), round_, o["seed"], o["subsample"]) if columns else np.zeros(len(c), bool)
        mean = total(np.where(exact, low, 0)) / np.maximum(total(exact), 1)
        away = np.where(exact, low - mean[run_of], 0.0)
        sets = [(total(exact & s), total(away * s), total(away * away * s)) for s in (~valid, valid)]
        n_drawn, away_drawn = total(exact & drawn), total(away * drawn)
        least, most = np.minimum.reduceat(away, starts), np.maximum.reduceat(away, starts)
        cut = np.flatnonzero(~exact)
        first = np.flatnonzero(np.r_[True, (run_of[cut[1:]] != run_of[cut[:-1]]) | (low[cut[1:]] != low[cut[:-1]]) | (high[cut[1:]] != high[cut[:-1]])]) if len(cut) else cut
        line = cut[first]
        counts = [np.add.reduceat(s[cut].astype(float), first) if len(cut) else np.zeros(0) for s in (~valid, valid, drawn)]
        head_c, head_fold, head_x = c[starts], fold[starts], x[starts]
        for base in np.unique(head_c):  # endpoints whose cells are all closed have none
            for slot, (number, start, edges, trees) in asked.get(int(base), {}).items():
                runs = np.flatnonzero((head_c == base) & (head_fold != slot))
                if not len(runs):
                    continue
                bins = binned(head_x[runs], edges, o["bins"])
                margin = np.full(len(starts), np.nan)
                margin[runs] = start + sum((t.values(bins, o["bins"]) for t in trees), np.zeros(len(runs)))
                far = margin - mean
                mine = np.flatnonzero(~np.isnan(margin[run_of[line]]))
                at = run_of[line[mine]]
                lost, slope, bend = terms(low[line[mine]], high[line[mine]], np.zeros(len(mine), bool), margin[at], np.full(len(mine), math.log(o["scale"])))[:3] if len(mine) else np.zeros((3, 0))
                for i, (n, one, two) in enumerate(sets):
                    n, one, two, d = n[runs], one[runs], two[runs], far[runs]
                    losses[2 * i, number] += ((two - 2 * d * one + n * d * d) * steep / 2 + n * flat).sum() + lost @ counts[i][mine]
                    losses[2 * i + 1, number] += n.sum() + counts[i][mine].sum()
                if not columns:
                    continue
                g, h = -(away_drawn - n_drawn * far) * steep, n_drawn * min(max(steep, LEAST_CURVE), MOST_CURVE)
                for r in runs[np.maximum(np.abs(most - far), np.abs(least - far))[runs] * steep > MOST_SLOPE]:
                    own = slice(starts[r], starts[r + 1] if r + 1 < len(starts) else len(c))
                    g[r] = np.clip((far[r] - away[own]) * steep, -MOST_SLOPE, MOST_SLOPE)[exact[own] & drawn[own]].sum()
                g += np.bincount(at, np.clip(slope, -MOST_SLOPE, MOST_SLOPE) * counts[2][mine], len(starts))
                h += np.bincount(at, np.clip(bend, LEAST_CURVE, MOST_CURVE) * counts[2][mine], len(starts))
                out = pd.DataFrame({"c": number, "kind": 0, **{n: bins[:, i] for n, i in zip(used, columns, strict=True)}, "g": g[runs], "h": h[runs]})
                yield out[out.h > 0]

    kinds = _kinds(p)

    def run(batches):
        losses, held, rows = np.zeros((4, size)), [], 0
        for pdf in batches:
            for block in pdf[list(kinds)].itertuples(index=False):
                held.append([np.frombuffer(b, t) for b, t in zip(block, kinds.values(), strict=True)])
                rows += len(held[-1][0])
                if rows >= TOGETHER:
                    yield from sums(pd.DataFrame({k: np.concatenate(v) for k, v in zip(kinds, zip(*held, strict=True), strict=True)}), losses)
                    held, rows = [], 0
        if rows:
            yield from sums(pd.DataFrame({k: np.concatenate(v) for k, v in zip(kinds, zip(*held, strict=True), strict=True)}), losses)
        seen = np.flatnonzero(losses[1] + losses[3])
        for kind in (1, 2):
            yield pd.DataFrame({"c": seen, "kind": kind, **dict.fromkeys(used, 0), "g": losses[2 * kind - 2, seen], "h": losses[2 * kind - 1, seen]})

    return run, f"c int, kind int, {''.join(n + ' int, ' for n in used)}g double, h double", used


def _level(p: int, asked: dict, columns: list[int], o: dict):
    """A task's round sums by (cell, node, feature, bin). asked: by number of cell, the tree, its open nodes, and whether losses are wanted; these get feature -1 and bin 0 for training rows, 1 for validation rows."""
    bins = o["bins"]

    def run(batches):
        total: dict = {}
        for pdf in batches:
            for k, rows in pdf.groupby("c"):
                if k not in asked:
                    continue
                tree, open_, losses = asked[k]
                mine = total.setdefault(k, {})
                if losses:
                    told = rows[rows.kind > 0]
                    mine["loss"] = mine.get("loss", 0) + np.array([np.bincount(told.kind - 1, told[v], 2) for v in ("g", "h")])
                rows = rows[rows.kind == 0]
                x = np.zeros((len(rows), p), np.int32)
                for f in columns:
                    x[:, f] = rows[f"b{f}"]
                place = np.full(max(open_) + 1 if open_ else 1, -1)
                place[open_] = np.arange(len(open_))
                node = tree.nodes(x, bins)
                slot = np.where(node < len(place), place[np.minimum(node, len(place) - 1)], -1)
                use, size = slot >= 0, len(open_) * (bins + 1)
                g, h = rows.g.to_numpy(float)[use], rows.h.to_numpy(float)[use]
                for f in columns:
                    key = slot[use] * (bins + 1) + x[use, f]
                    mine[f] = mine.get(f, 0) + np.array([np.bincount(key, g, size), np.bincount(key, h, size)])
        out = []
        for k, mine in total.items():
            open_ = asked[k][1]
            for f, sums in mine.items():
                if isinstance(f, str):
                    out += [(k, -1, -1, i, float(sums[0, i]), float(sums[1, i])) for i in (0, 1)]
                else:
                    at = np.flatnonzero(sums.any(axis=0))
                    out += [(k, int(open_[i // (bins + 1)]), f, int(i % (bins + 1)), float(sums[0, i]), float(sums[1, i])) for i in at]
        if out:
            yield pd.DataFrame(out, columns=["c", "node", "feature", "bin", "g", "h"])

    return run


def fit_boosted(rows: DataFrame, features: list[str], cell: str = "endpoint", key: str = "row_id", valid: Column | None = None, held: str | None = None, folds: int = 1, **options) -> Boosted:
    """Fits every cell of `rows` (cell, key, lower, upper on the p scale, features) at once. `key` decides which rows a round draws.

    With `held`, the column of a row's fold, there is a cell 'cell|f' for each of the `folds` folds, which trains on the
    other rows; rows are laid out once for all of them, and trees are evaluated anew for each run of equal features.
    """
    o = DEFAULTS | options
    p, bins = len(features), o["bins"]
    low, high = D.conc_bounds(F.col("lower"), F.col("upper"))
    use = rows.where(F.col(cell).isNotNull()).select(F.col(cell).alias("cell"), F.xxhash64(key).alias("h"), F.coalesce(valid if valid is not None else F.lit(False), F.lit(False)).alias("valid"), F.log(low).alias("low"), F.when(high == float("inf"), high).otherwise(F.log(high)).alias("high"), *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)), *([F.coalesce(F.col(held).cast("int"), F.lit(-1)).alias("fold")] if held else []))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    cuts = [F.percentile_approx(finite(f"x{i}"), F.array(*(F.lit(k / bins) for k in range(1, bins))), F.lit(10_000)).alias(f"e{i}") for i in range(p)]
    exact = F.when(F.col("low") == F.col("high"), F.col("low"))
    middle = F.when(F.col("high") == float("inf"), F.col("low")).otherwise((F.col("low") + F.col("high")) / 2)
    spread = use
    if held:
        spread = use.withColumn("_f", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(folds - 1)), F.array("fold")))).withColumn("cell", F.concat_ws("|", "cell", "_f"))
    first = spread.where("not valid").groupBy("cell").agg(F.count("*").alias("n"), F.coalesce(F.avg(exact), F.avg(middle)).alias("base"), *cuts).collect()  # a row a cell
    cells = {r["cell"]: {"edges": [np.unique(r[f"e{i}"] or []) for i in range(p)], "base": r["base"], "n": r["n"], "trees": [], "best": 0, "history": [], "sigma": None, "error": None} for r in first}
    edges = {k: c["edges"] for k, c in cells.items()}
    base = {k: c["base"] for k, c in cells.items()}
    number = {k: i for i, k in enumerate(sorted(cells))}
    name = {i: k for k, i in number.items()}

    def cut(batches):
        for pdf in batches:
            codes, names = pd.factorize(pdf.cell)
            values, out = pdf[[f"x{i}" for i in range(p)]].to_numpy(float), pdf[["h", "valid", "low", "high"]]
            c, x, margin = np.full(len(pdf), -1, np.int32), np.zeros((len(pdf), p), np.int32), np.zeros(len(pdf))
            for j, k in enumerate(names):
                if k in edges:
                    at = np.flatnonzero(codes == j)
                    c[at], x[at], margin[at] = number[k], binned(values[at], edges[k], bins), base[k]
            out = out.assign(c=c, margin=margin, **{f"b{i}": x[:, i] for i in range(p)})
            yield out[c >= 0]

    layout = f"c int, h long, valid boolean, low double, high double, margin double, {', '.join(f'b{i} int' for i in range(p))}"
    if not cells:
        return Boosted(list(features), o, cells)
    if held:
        bases = sorted({k.rsplit("|", 1)[0] for k in cells})
        lie = ["c", *(f"x{i}" for i in range(p)), "fold", "low", "high", "h"]
        data = use.withColumn("c", (F.array_position(F.array(*map(F.lit, bases)), F.col("cell")) - 1).cast("int")).where("c >= 0").select(*lie, "valid")
    else:
        lie = ["c", *(f"b{i}" for i in range(p)), "h"]  # h parts runs that are long
        data = use.mapInPandas(cut, layout)
    data = data.repartitionByRange(*lie).sortWithinPartitions(*lie)
    data = kept(data.mapInArrow(*_blocks(p)) if held else data)
    open_cells = set(cells)
    written = dict.fromkeys(cells, 0)  # trees that the margins hold
    for round_ in range(o["rounds"] + 1):
        last = round_ == o["rounds"]  # losses of the last trees alone
        draw = np.random.default_rng([o["seed"], round_])
        chosen = sorted(draw.choice(p, max(1, round(o["columns"] * p)), replace=False).tolist())
        growing = {k: (Tree(), [0]) for k in sorted(open_cells)}
        fresh = {number[k]: cells[k]["trees"][written[k] :] for k in open_cells}
        if held:
            fresh = {}
            for k in open_cells:
                base_of, slot = k.rsplit("|", 1)
                fresh.setdefault(bases.index(base_of), {})[int(slot)] = (number[k], base[k], edges[k], cells[k]["trees"])
        run, shape, used = (_held_sums if held else _round_sums)(p, fresh, [] if last else chosen, round_, o)
        mine = data if held else data.where(F.col("c").isin(*fresh))
        lines = saved(mine.mapInPandas(run, shape).groupBy("c", "kind", *used).agg(F.sum("g").alias("g"), F.sum("h").alias("h")))
        for level in range(1 if last else o["depth"]):
            asked = {number[k]: (tree, nodes, level == 0) for k, (tree, nodes) in growing.items() if k in open_cells and nodes}
            if not asked:
                break
            sums = lines.mapInPandas(_level(p, asked, [] if last else chosen, o), "c int, node int, feature int, bin int, g double, h double")
            found = sums.groupBy("c", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()  # bins x features x nodes a cell
            for i, mine in found.groupby("c"):
                k = name[i]
                c = cells[k]
                if level == 0:
                    losses = mine[mine.feature < 0].set_index("bin")
                    train, kept_out = (float(losses.g[i] / losses.h[i]) if i in losses.index and losses.h[i] else None for i in (0, 1))
                    c["history"].append((train, kept_out))
                    watched = [x[1] for x in c["history"]]
                    if kept_out is None:
                        c["best"] = len(c["trees"])
                    else:
                        c["best"] = int(np.argmin(watched))
                        if len(c["trees"]) - c["best"] >= o["patience"]:
                            open_cells.discard(k)
                            continue
                if last:
                    continue
                tree, nodes = growing[k]
                again = []
                for node, part in mine[mine.feature >= 0].groupby("node"):
                    g, h = np.zeros((p, bins + 1)), np.zeros((p, bins + 1))
                    g[part.feature, part.bin], h[part.feature, part.bin] = part.g, part.h
                    best = best_split(g, h, chosen, o["penalty"], o["least_weight"])
                    if level == 0:
                        tree.value[0] = float(-o["rate"] * g[chosen[0]].sum() / (h[chosen[0]].sum() + o["penalty"]))
                    if best is not None:
                        leaves = tuple(float(-o["rate"] * a / (b + o["penalty"])) for a, b in best[4:])
                        again += tree.split(int(node), best[1], best[2], best[3], leaves)
                growing[k] = (tree, again)
        if last:
            break
        for k in open_cells:
            cells[k]["trees"].append(growing[k][0])
        if not open_cells:
            break
        if (round_ + 1) % KEPT_ROUNDS == 0 and not held:
            fresh = {number[k]: cells[k]["trees"][written[k] :] for k in open_cells}

            def moved(batches, fresh=fresh):
                for pdf in batches:
                    for k, part in pdf.groupby("c", sort=False):  # rows stay in their order
                        x = part[[f"b{i}" for i in range(p)]].to_numpy(np.int32)
                        yield part.assign(margin=part.margin.to_numpy(float) + sum(t.values(x, bins) for t in fresh[k]))

            data = kept(data.where(F.col("c").isin(*fresh)).mapInPandas(moved, layout))
            written.update({k: len(cells[k]["trees"]) for k in open_cells})
    return Boosted(list(features), o, cells)


def predicted(rows: DataFrame, model: Boosted, cell: str = "endpoint") -> DataFrame:
    """rows of fitted cells with mu and sigma on the p scale; sigma is the calibrated one where there is one.

    Where cells and features have few values, these alone are predicted, and rows join them.
    """
    names = [cell, *model.features]
    number = lambda f: F.when(~F.isnan(F.col(f"`{f}`").cast("double")), F.col(f"`{f}`").cast("double"))  # noqa: E731  missing ones are equal
    parts = [F.col(f"`{cell}`"), *map(number, model.features)]
    keys = rows.select(*(c.alias(n) for c, n in zip(parts, names, strict=True))).distinct()
    if keys.limit(FEW + 1).count() <= FEW:
        own = [f"_k{i}" for i in range(len(names))]
        made = _predicted(keys, model, cell).select(*(F.col(f"`{n}`").alias(k) for n, k in zip(names, own, strict=True)), F.col("mu").alias("_mu"), F.col("sigma").alias("_sigma"))
        same = reduce(lambda a, b: a & b, (c.eqNullSafe(F.col(k)) for c, k in zip(parts, own, strict=True)))
        listed = (F.nanvl(F.col(f"`{n}`"), F.lit(None)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in rows.dtypes)  # missing values are null, as they come back from Python
        return rows.join(F.broadcast(made), same).select(*listed, F.col("_mu").alias("mu"), F.col("_sigma").alias("sigma"))
    return _predicted(rows, model, cell)


def _predicted(rows: DataFrame, model: Boosted, cell: str) -> DataFrame:
    layout = StructType([*rows.schema.fields, StructField("mu", DoubleType()), StructField("sigma", DoubleType())])
    plain = model.options["scale"] / LOG_TEN

    def run(batches):
        for pdf in batches:
            codes, names = pd.factorize(pdf[cell])
            values, mu, sigma = pdf[model.features].to_numpy(float), np.zeros(len(pdf)), np.zeros(len(pdf))
            known = np.zeros(len(pdf), bool)
            for j, k in enumerate(names):
                if k in model.cells:
                    at = np.flatnonzero(codes == j)
                    known[at], mu[at], sigma[at] = True, 9 - model.margins(k, values[at]) / LOG_TEN, model.cells[k]["sigma"] or plain
            yield pdf.assign(mu=mu, sigma=sigma)[known]

    return rows.mapInPandas(run, layout)


def fit_scale(model: Boosted, rows: DataFrame, cell: str = "endpoint", least: int = 10) -> Boosted:
    """Sets each cell's sigma to the deviation of its errors on these exact rows (value_p), where there are enough."""
    error = predicted(rows.where(F.col("value_p").isNotNull() & ~F.isnan("value_p")), model, cell).withColumn("e", F.col("mu") - F.col("value_p"))
    for r in error.groupBy(F.col(cell).alias("cell")).agg(F.count("*").alias("n"), F.stddev_pop("e").alias("sd")).collect():  # a row a cell
        if r["n"] >= least:
            model.cells[r["cell"]]["sigma"] = max(float(r["sd"]), 1e-6)
    return model
