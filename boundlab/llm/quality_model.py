"""A quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's words (runs of letters and digits, or of other visible characters) and
their n-grams up to `n` are hashed into DIMENSIONS places. An n-gram of one word
repeated has a place of its own, as repetition tells more than the word. The
value of a place is the root of its share of all n-grams, so a text is a unit
vector whatever its length, and its score the logistic of a sparse dot product.

Training: FTRL-proximal (McMahan et al., 2013), one step a document, with an L1
part that leaves few weights. The labelled rows are dealt to `members` learners,
each trained in a task of its own, and Spark averages their weights (Zinkevich
et al., 2010). The fit sample is bounded: of the training rows with a label, the
`most` (doc_id, text) pairs with the smallest hashes. All rows are scored.

Nulls: a null or empty text has no n-grams and gets the bias alone. Null doc_ids
are scored as held out. Labels with null fields are skipped; of several labels
of one id the largest counts. Rows equal in id and text train once. With no
label every score is 0.5. An empty table gives no rows. Extra columns pass
through. A very long text is read whole; its places are at most DIMENSIONS.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import saved, table

BITS, FOLDS = 18, 5
DIMENSIONS = 1 << BITS
FIT = {"most": 16_000, "members": 4, "epochs": 8, "alpha": 3.0, "beta": 1.0, "l1": 0.3, "l2": 1e-4, "n": 2}
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
#: Hashes of so many words are kept for later texts of a task.
KNOWN_WORDS = 1 << 17
MIX, STEP, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def features(text: bytes | None, n: int, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's n-grams, ascending, and their values; the squares of the values sum to 1."""
    hashes = []
    for w in WORD.findall(text or b""):
        h = known.get(w)
        if h is None:
            if len(known) >= KNOWN_WORDS:
                known.clear()
            h = known[w] = crc32(w)
        hashes.append(h)
    word = np.array(hashes, np.uint64)
    gram, same, found = word * MIX, np.ones(len(word), bool), [word * MIX]
    for size in range(2, n + 1):
        gram = (gram[:-1] ^ (gram[:-1] >> np.uint64(31))) * STEP + word[size - 1 :] * MIX + np.uint64(size)
        same = same[:-1] & (word[size - 1 :] == word[size - 2 : -1])
        found.append(np.where(same, STEP + np.uint64(size), gram))
    mixed = np.concatenate(found)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * END
    place, times = np.unique(mixed >> np.uint64(64 - BITS), return_counts=True)
    return place.astype(np.int32), np.sqrt(times / max(1, times.sum())).astype(np.float32)


class Leader:
    """State of FTRL-proximal by place: z, and the sum of squared gradients; the last place is the bias."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, place=slice(None)) -> np.ndarray:
        """The weights that minimise the regularised sum of the linearised losses so far; 0 where |z| is within l1."""
        z = self.z[place]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[place])) / self.alpha + self.l2))

    def learn(self, place: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(place)
        g = (logistic(w @ value) - label) * value
        more = self.n[place] + g * g
        self.z[place] += g - (np.sqrt(more) - np.sqrt(self.n[place])) / self.alpha * w
        self.n[place] = more


def logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def member(epochs: int, **rates):
    """Trains one learner on its rows (member, hash, label, place, value): its nonzero weights."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["hash", "doc_id"], kind="stable")
        leader, order = Leader(**rates), np.random.default_rng(int(pdf.member.iloc[0]))
        rows = [(np.append(p, DIMENSIONS), np.append(v, np.float32(1)), y) for p, v, y in zip(pdf.place, pdf.value, pdf.label, strict=True)]
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                leader.learn(*rows[i])
        w = leader.weights()
        at = np.flatnonzero(w)
        return pd.DataFrame({"place": at.astype(np.int32), "weight": w[at]})

    return run


def _featured(n: int):
    def run(batches):
        known: dict = {}
        for b in batches:
            rows = [features(t.as_py(), n, known) for t in b.column("text")]
            names = [k for k in b.schema.names if k != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array([p for p, _ in rows], pa.list_(pa.int32())), pa.array([v for _, v in rows], pa.list_(pa.float32()))], [*names, "place", "value"])

    return run


def _held():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0


def learn(docs: DataFrame, labels: DataFrame, most: int, members: int, epochs: int, n: int, **rates) -> np.ndarray | None:
    """DIMENSIONS weights and the bias, or None if no training row has a label."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").alias("label"))
    rows = docs.where(F.col("doc_id").isNotNull()).where(~_held()).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    hashed = rows.select("doc_id", F.xxhash64(F.lit(3), "doc_id", "text").alias("hash")).join(known, F.col("doc_id") == F.col("l_id"))
    chosen = hashed.groupBy("doc_id", "hash").agg((F.max("label") > 0).cast("double").alias("label")).orderBy("hash", "doc_id").limit(most)
    chosen = saved(chosen.withColumn("member", F.pmod(F.xxhash64("hash"), F.lit(members)).cast("int")))
    keys = F.broadcast(chosen.withColumnsRenamed({"doc_id": "c_id", "hash": "c_hash"}))  # `most` short rows at most
    sample = rows.withColumn("hash", F.xxhash64(F.lit(3), "doc_id", "text")).join(keys, (F.col("doc_id") == F.col("c_id")) & (F.col("hash") == F.col("c_hash"))).drop("c_id", "c_hash").dropDuplicates(["doc_id", "hash"])
    made = sample.select("doc_id", "hash", "member", "label", "text").mapInArrow(_featured(n), "doc_id long, hash long, member int, label double, place array<int>, value array<float>")
    learnt = made.groupBy("member").applyInPandas(member(epochs, **rates), "place int, weight double")
    used = chosen.select("member").distinct().count()
    if not used:
        return None
    mean = learnt.groupBy("place").agg((F.sum("weight") / used).alias("weight")).toPandas()  # a row a place at most
    out = np.zeros(DIMENSIONS + 1)
    out[mean.place] = mean.weight
    return out


def scorer(weights: np.ndarray, n: int):
    """Adds `score` to rows with a struct `row` that has a text."""
    light, bias = weights[:-1].astype(np.float32), float(weights[-1])

    def run(batches):
        known: dict = {}
        for b in batches:
            score = np.empty(b.num_rows)
            for i, t in enumerate(b.column("row").field("text").cast(pa.binary()) if b.num_rows else []):
                place, value = features(t.as_py(), n, known)
                score[i] = logistic(float(light[place] @ value) + bias)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, "score"])

    return run


def classified(docs: DataFrame, labels: DataFrame, least: float = 0.3, **options) -> DataFrame:
    """`row`, a struct of all columns of `docs`, with held_out, score and predicted (score >= least); a row for each row."""
    options = FIT | options
    weights = learn(docs, labels, **options)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(_held(), F.lit(True)).alias("held_out"))
    if weights is None:
        found = rows.withColumn("score", F.lit(0.5))
    else:
        found = rows.mapInArrow(scorer(weights, options["n"]), StructType([*rows.schema.fields, StructField("score", DoubleType())]))
    return found.withColumn("predicted", (F.col("score") >= least).cast("int"))


def op11_quality_model(spark, sf_dir: str) -> DataFrame:
    found = classified(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("row.doc_id", "held_out", "score", "predicted")
