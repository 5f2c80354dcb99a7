"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic rows are the positives; texts of all training rows, labelled or
not, are the unlabelled mixture; labels of 0 serve for the class prior alone. A
linear model over hashed words and word beginnings is trained in numpy with the risk
    prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)),
whose second part, if negative, is climbed instead of descended. Several models
are averaged, each fitted on two thirds of the sample, its cut chosen on the rest
by the zero-one form of the same risk. Features are first screened: kept are
those surely commoner in positives than, by the class prior, in negatives; Spark counts a
feature's documents over all training rows. Weights and cuts come from a bounded sample: of the `most_p`
positive and `most_u` unlabelled ids with the smallest hashes the as many rows with the smallest hashes of
id and text. Rows equal in both are one there, so repeated ids can't exceed the bound.
All counts for the prior and all scores cover every row.

Nulls: a null or empty text has no features and gets the bias alone. Null
doc_ids are scored as held out. Rows of `labels` with null fields are skipped;
of several labels of one id the largest counts. With no positive at all every
score is 0. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import saved, table

DIMENSIONS, FOLDS = 1 << 17, 5
FIT = {"most_p": 4000, "most_u": 8000, "epochs": 30, "seeds": (1, 2, 3), "l2": 1e-5, "rate": 0.05, "least_z": 3.0, "lift": 0.1}
#: ASCII letters lower-cased, punctuation and control characters to spaces.
FOLD_CASE = bytes(x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else x + 32 if 65 <= x <= 90 else 32 for x in range(256))


PART_SALT, KNOWN_WORDS = 11, 1 << 17


def _places(word: str) -> tuple[int, ...]:
    return tuple({crc32(w.encode()) % DIMENSIONS for w in (word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) >= n))})


def features(text: bytes | None, known: dict[str, tuple[int, ...]] | None = None) -> np.ndarray:
    """Hashed words of a text and their first 4, 5 and 6 characters, each once; `known` keeps places of words for later texts."""
    known = {} if known is None else known
    found: set[int] = set()
    for w in set((text or b"").translate(FOLD_CASE).decode("utf-8", "replace").split()):
        at = known.get(w)
        if at is None:
            if len(known) >= KNOWN_WORDS:
                known.clear()
            at = known[w] = _places(w)
        found.update(at)
    return np.array(sorted(found), np.int32)


def _featured(batches):
    known: dict = {}
    for b in batches:
        rows = [features(t.as_py(), known) for t in b.column("text")]
        names = [k for k in b.schema.names if k != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(rows, pa.list_(pa.int32()))], [*names, "words"])


def _counter(parts: int):
    """A task's documents by part and feature; the feature -1 counts all."""

    def run(batches):
        known: dict = {}
        found = np.zeros((parts, DIMENSIONS + 1), np.int64)
        for b in batches:
            for part, t in zip(b.column("part").to_pylist(), b.column("text"), strict=True):
                found[part, features(t.as_py(), known)] += 1
                found[part, -1] += 1
        part, place = np.nonzero(found)
        n = found[part, place]
        place = np.where(place == DIMENSIONS, -1, place)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(place, pa.int32()), pa.array(n)], ["part", "place", "n"])

    return run


def document_counts(rows: DataFrame, parts: int) -> np.ndarray:
    """(part, feature) -> documents of `rows` that hold it; the last column counts all."""
    sums = rows.select("part", "text").mapInArrow(_counter(parts), "part int, place int, n long").groupBy("part", "place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((parts, DIMENSIONS + 1))
    counts[sums.column("part").to_numpy(), sums.column("place").to_numpy()] = sums.column("n").to_numpy()
    return counts


def gradient(w: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[float, float, np.ndarray]:
    """The two parts of the risk, prior * R+ and R-(unlabelled) - prior * R-(positive), and the direction of ascent: of their sum, or if the second is negative, of minus the second alone."""

    def scores(rows):
        sizes = np.array([len(r) for r in rows])
        idx = np.concatenate(rows).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(rows)), sizes)
        return np.bincount(owner, w[idx], len(rows)) + w[-1], idx, owner

    (zp, ip, op), (zu, iu, ou) = scores(positive), scores(unlabelled)
    sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
    # logistic losses; -log(1 - s) has the gradient s, -log(s) has s - 1
    first, second = prior * np.mean(np.logaddexp(0, -zp)), np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
    if second >= 0:
        gp, gu = (prior * (sp - 1) - prior * sp) / len(sp), su / len(su)
    else:
        gp, gu = prior * sp / len(sp), -su / len(su)
    g = np.bincount(ip, gp[op], len(w)).astype(float) + np.bincount(iu, gu[ou], len(w))
    g[-1] = gp.sum() + gu.sum()
    return first, second, g


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int, epochs: int, l2: float, rate: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the classifier with the least non-negative risk, by Adam on batches."""
    rng, n = np.random.default_rng(seed), DIMENSIONS + 1
    w, m, v, t = np.zeros(n), np.zeros(n), np.zeros(n), 0
    w[-1] = -1.0
    batches = max(1, min(len(positive), len(unlabelled) // 256 + 1))
    for _ in range(epochs):
        ps, us = (np.array_split(rng.permutation(len(x)), batches) for x in (positive, unlabelled))
        for p, u in zip(ps, us, strict=True):
            if not len(p) or not len(u):
                continue
            _, _, g = gradient(w, [positive[i] for i in p], [unlabelled[i] for i in u], prior)
            g[:-1] += l2 * w[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            np.maximum(w[:-1], 0, out=w[:-1])  # features are evidence for toxicity alone: long clean text can't hide it
    return w[:-1], float(w[-1])


def telling(positive: list[np.ndarray], u: np.ndarray, n_u: float, prior: float, least_z: float, lift: float) -> np.ndarray:
    """Mask of the features that are surely commoner in positives; `u` counts a feature's documents among n_u unlabelled ones.

    The rate in negatives follows from the mixture: (unlabelled - prior * positive) / (1 - prior).
    """
    p = np.zeros(DIMENSIONS)
    for r in positive:  # a row's features are different
        p[r] += 1
    rp, ru = (p + 0.5) / (len(positive) + 1), (u + 0.5) / (n_u + 1)
    rn = np.clip((ru - prior * rp) / (1 - prior), 1e-9, 1)
    z = (rp - ru) / np.sqrt(rp * (1 - rp) / len(positive) + ru * (1 - ru) / n_u)
    return (z > least_z) & (p >= 3) & (rn < lift * rp)


def offset(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """The cut with the least zero-one risk, corrected by the class prior; the middle of the best stretch."""
    cuts = np.unique(np.concatenate([zp, zu]))
    if len(cuts) < 2:
        return 0.0
    cuts = (cuts[1:] + cuts[:-1]) / 2
    hit = 1 - np.searchsorted(np.sort(zp), cuts) / len(zp)
    all_ = 1 - np.searchsorted(np.sort(zu), cuts) / len(zu)
    risk = prior * (1 - hit) + np.maximum(0, all_ - prior * hit)
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    return float(cuts[best[len(best) // 2]])


def ensemble(positive: list[tuple[int, np.ndarray]], unlabelled: list[tuple[int, np.ndarray]], counts: np.ndarray, prior: float, epochs: int, seeds, l2: float, rate: float, least_z: float, lift: float):
    """One model for each seed: screened and fitted on all but one part of the rows, its cut chosen on that part."""
    weights, biases = [], []
    for k, seed in enumerate(seeds):
        fit_p, fit_u = ([r for part, r in x if part != k] or [r for _, r in x] for x in (positive, unlabelled))
        cut_p, cut_u = ([r for part, r in x if part == k] or [r for _, r in x] for x in (positive, unlabelled))
        u = counts.sum(0) - counts[k]
        u = u if u[-1] else counts.sum(0)
        mask = telling(fit_p, u[:-1], u[-1], prior, least_z, lift)
        w, b = fit([r[mask[r]] for r in fit_p], [r[mask[r]] for r in fit_u], prior, seed, epochs, l2, rate)
        w[~mask] = 0
        zp, zu = (np.array([w[r].sum() + b for r in x]) for x in (cut_p, cut_u))
        weights.append(w)
        biases.append(b - offset(zp, zu, prior))
    return np.array(weights, np.float32), np.array(biases)


def scorer(weights: np.ndarray, bias: np.ndarray):
    """Adds `score` to rows with a struct `row` that has a text. weights: (models, dimensions)."""

    def run(batches):
        known: dict = {}
        for b in batches:
            text = b.column("row").field("text").cast(pa.binary()) if b.num_rows else []
            rows = [features(t.as_py(), known) for t in text]
            sizes = np.array([len(r) for r in rows], np.int64)
            idx = np.concatenate(rows) if sizes.sum() else np.zeros(0, np.int32)
            owner = np.repeat(np.arange(len(rows)), sizes)
            z = [np.bincount(owner, weights[k][idx], len(rows)) + bias[k] for k in range(len(bias))]
            score = np.mean([1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in z], axis=0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, "score"])

    return run


def learn(docs: DataFrame, labels: DataFrame, most_p: int, most_u: int, epochs: int, seeds, l2: float, rate: float, least_z: float, lift: float):
    """(weights, biases) or None if no toxic row is known."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("text")).where(~held).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(PART_SALT)), F.lit(len(seeds))).cast("int"))
    ids = rows.select("doc_id").join(known, F.col("doc_id") == F.col("label_id"))
    n, toxic = ids.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()
    if not toxic:
        return None
    order = [F.xxhash64(F.col("doc_id"), F.lit(7)), F.col("doc_id")]
    first = lambda df, most: df.select("doc_id").distinct().orderBy(*order).limit(most).withColumnRenamed("doc_id", "chosen")

    def drawn(frame, most, positive):
        chosen = F.broadcast(first(frame, most))  # `most` ids at most
        return rows.join(chosen, F.col("doc_id") == F.col("chosen"), "left_semi").withColumn("positive", F.lit(positive)).dropDuplicates(["doc_id", "text"])

    found = drawn(ids.where("toxic > 0"), most_p, True).unionByName(drawn(rows, most_u, False)).withColumn("hash", F.xxhash64("text"))
    found = saved(found.select("doc_id", "positive", "part", "hash", "text").mapInArrow(_featured, "doc_id long, positive boolean, part int, hash long, words array<int>"))
    bounded = [found.where(F.col("positive") == kind).orderBy(*order, "hash").limit(most) for kind, most in ((True, most_p), (False, most_u))]
    sample = bounded[0].unionByName(bounded[1]).toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("positive", "ascending"), ("hash", "ascending")])
    words = sample.column("words").combine_chunks()
    flat, ends = words.flatten().to_numpy(), np.cumsum(np.diff(words.offsets.to_numpy()))
    rows_, marks = np.split(flat, ends[:-1]), sample.column("positive").to_numpy()  # views of one array
    own = sample.column("part").to_pylist()
    positive, unlabelled = ([(part, r) for part, r, m in zip(own, rows_, marks, strict=True) if m == kind] for kind in (True, False))
    prior = min(0.95, toxic / n)
    return ensemble(positive, unlabelled, document_counts(rows, len(seeds)), prior, epochs, seeds, l2, rate, least_z, lift)


def scored(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """`row`, a struct of all columns of `docs`, with held_out, score and predicted; a row for each row."""
    model = learn(docs, labels, **(FIT | options))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(held, F.lit(True)).alias("held_out"))
    if model is None:
        found = rows.withColumn("score", F.lit(0.0))
    else:
        found = rows.mapInArrow(scorer(*model), StructType([*rows.schema.fields, StructField("score", DoubleType())]))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, text, score, predicted for each row of `docs`."""
    return scored(docs.select("doc_id", "text"), labels, **options).select("row.doc_id", "held_out", "row.text", "score", "predicted")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")
