"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. If two differ in at most k bits, then one of their
two 32-bit halves differs in at most k // 2. Anchors for a half are the words of
a covering code: the perfect Hamming code of 31 bits, with the 32nd bit free,
which has covering radius 1. Each different fingerprint is replicated, for each
half, to all anchors within 1 + k // 2 of it (17 at most for k = 2 or 3). Two
linked fingerprints then meet at the anchor nearest to one of them, and are
compared there in full.

Work is on different fingerprints, so exact copies cost nothing. A cell holds
the fingerprints of one anchor. Cells above `hot` members (large groups of near
copies) are split again by anchors of the other half, within 1 + k; pairs of
such a cell differ in at most k bits there, so none is lost. Inside a cell the
links are reduced to a spanning forest before they are emitted: at most one row
a member, never all pairs. Components follow by large-star / small-star rounds.

Nulls: a null text has no words and fingerprint zero; fingerprint zero is linked
like any other. Rows with a null doc_id take part, and null is never the
smallest id unless all of the component are null. Repeated rows are each
reported. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import saved, table

SEED, SHINGLE, DISTANCE, HOT = 42, 3, 2, 4096


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Bit j is set if it is set in more than half of the shingles' hashes."""
    words = (text or b"").lower().split()  # bytes: A-Z alone change, and white space is ASCII's
    if not words:
        return 0
    n = min(shingle, len(words))
    count, ones, step = len(words) - n + 1, np.zeros(64, np.int64), 1 << 16
    for i in range(0, count, step):
        part = words[i : i + step + n - 1]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(part[k:] for k in range(n)), strict=False)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > count, bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches):
    for b in batches:
        prints = [fingerprint(t.as_py()) for t in b.column("text")]
        more = [k for k in b.schema.names if k != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in more), pa.array(prints, pa.int64())], [*more, "fp"])


def syndromes(half: np.ndarray) -> np.ndarray:
    """The xor of the numbers 1 to 31 of the bits that are set; bit 31 counts as 0."""
    found = np.zeros(len(half), np.int64)
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)
        found |= (np.bitwise_count(half & np.uint64(mask)) & 1).astype(np.int64) << k
    return found


def flips(radius: int) -> list[np.ndarray]:
    """By syndrome: the changes of at most `radius` bits that lead to an anchor."""
    by = [[] for _ in range(32)]
    for n in range(radius + 1):
        for bits in combinations(range(32), n):
            s = 0
            for i in bits:
                s ^= i + 1 if i < 31 else 0
            by[s].append(sum(1 << i for i in bits))
    return [np.array(x, np.uint64) for x in by]


def anchors(half: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors: each half at every anchor within the radius."""
    which, found = [], []
    by, s = flips(radius), syndromes(half)
    for k in range(32):
        rows = np.flatnonzero(s == k)
        which.append(np.repeat(rows, len(by[k])))
        found.append((half[rows][:, None] ^ by[k][None, :]).ravel())
    return np.concatenate(which), np.concatenate(found)


def replicate(distance: int):
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1 << 15):
                fp = b.column("fp").slice(i, 1 << 15).to_numpy().view(np.uint64)
                for side, half in enumerate((fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32))):
                    rows, found = anchors(half, 1 + distance // 2)
                    cell = (found | np.uint64(side << 32)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp[rows].view(np.int64)), pa.array(np.zeros(len(rows), np.int64))], ["cell", "fp", "sub"])

    return run


def resplit(distance: int):
    """Rows of hot cells, at each anchor of their other half."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1 << 12):
                cell, fp = (b.column(c).slice(i, 1 << 12).to_numpy() for c in ("cell", "fp"))
                bits = fp.view(np.uint64)
                other = np.where(cell >> 32 == 0, bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF))
                rows, found = anchors(other, 1 + distance)
                yield pa.RecordBatch.from_arrays([pa.array(cell[rows]), pa.array(fp[rows]), pa.array(found.view(np.int64) + 1)], ["cell", "fp", "sub"])

    return run


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n members the smallest member that pairs (a, b) connect it to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def pairs_within(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a sorted array of different fingerprints; memory follows the links found."""
    n, a, b = len(fp), [], []
    if n <= HOT:
        step = max(1, (1 << 20) // n)
        for i in range(0, n, step):
            x, y = np.nonzero(np.bitwise_count(fp[i : i + step, None] ^ fp[None, i:]) <= distance)
            keep = y > x
            a.append(x[keep] + i)
            b.append(y[keep] + i)
    else:  # look every change of few bits up
        masks = [sum(1 << i for i in bits) for k in range(1, distance + 1) for bits in combinations(range(64), k)]
        for mask in np.array(masks, np.uint64):
            sought = fp ^ mask
            at = np.minimum(np.searchsorted(fp, sought), n - 1)
            x = np.flatnonzero((fp[at] == sought) & (sought > fp))
            a.append(x)
            b.append(at[x])
            if sum(map(len, a)) > 4 * n:  # keep a spanning forest alone
                root = forest(n, np.concatenate(a), np.concatenate(b))
                rest = np.flatnonzero(root != np.arange(n))
                a, b = [rest], [root[rest]]
    return np.concatenate(a), np.concatenate(b)


def links(distance: int):
    """Sorted rows (cell, sub, fp) -> links (fp, least linked fp of the cell)."""

    def cells(key: np.ndarray, fp: np.ndarray):
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        size = np.diff(np.r_[start, len(key)])
        a, b = [], []
        run = np.repeat(np.arange(len(start)), np.where(size <= 32, size, 0))  # small cells, all at once
        at = np.flatnonzero(np.repeat(size <= 32, size))
        small, members = run, fp[at]
        for shift in range(1, min(32, int(size.max(initial=0)))):
            if shift >= len(members):
                break
            ok = (small[shift:] == small[:-shift]) & (np.bitwise_count(members[shift:] ^ members[:-shift]) <= distance)
            hit = np.flatnonzero(ok)
            a.append(at[hit])
            b.append(at[hit + shift])
        for s, n in zip(start[size > 32], size[size > 32], strict=True):
            order = np.argsort(fp[s : s + n])
            x, y = pairs_within(fp[s : s + n][order], distance)
            a.append(s + order[x])
            b.append(s + order[y])
        if not a:
            return
        root = forest(len(fp), np.concatenate(a), np.concatenate(b))
        rest = np.flatnonzero(root != np.arange(len(fp)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[rest].view(np.int64)), pa.array(fp[root[rest]].view(np.int64))], ["u", "v"])

    def run(batches):
        held_key, held_fp = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        for b in batches:
            key = np.concatenate([held_key, np.stack([b.column("cell").to_numpy(), b.column("sub").to_numpy()], axis=1)])
            fp = np.concatenate([held_fp, b.column("fp").to_numpy().view(np.uint64)])
            if not len(key):
                continue
            last = len(key) - int(np.argmax((key[::-1] != key[-1]).any(axis=1))) if (key[0] != key[-1]).any() else 0
            if last:
                yield from cells(key[:last], fp[:last])
            held_key, held_fp = key[last:], fp[last:]
        if len(held_key):
            yield from cells(held_key, held_fp)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (node, root) for every node that has a link; root is its component's least node."""
    edges = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        joined = large.join(least, F.col("u") == F.col("c"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
        edges = saved(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.count_if(F.lit(True))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, hot: int = HOT, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) and root (a fingerprint that only this component has) for each row of `docs`, with its columns `carry`."""
    if not 0 <= distance <= 3:
        raise ValueError("the anchors are laid out for 0 to 3 differing bits")
    rows = docs.select("doc_id", *carry, F.col("text").cast("binary").alias("text"))
    layout = StructType([*rows.drop("text").schema.fields, StructField("fp", LongType())])
    prints = saved(rows.mapInArrow(_fingerprints, layout))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    layout = "cell long, fp long, sub long"
    rows = nodes.select("fp").mapInArrow(replicate(distance), layout)
    crowded = saved(rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > hot).select(F.col("cell").alias("h")))
    if crowded.limit(1).count():
        calm = rows.join(crowded, F.col("cell") == F.col("h"), "left_anti")
        rows = calm.unionByName(rows.join(crowded, F.col("cell") == F.col("h"), "left_semi").mapInArrow(resplit(distance), layout))
    found = rows.repartition("cell", "sub").sortWithinPartitions("cell", "sub").mapInArrow(links(distance), "u long, v long")
    roots = components(found)
    labels = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("l_fp"), F.coalesce("root", "fp").alias("root"), "least")
    named = labels.groupBy(F.col("root").alias("c")).agg(F.min("least").alias("component_id"))
    labels = labels.join(named, F.col("root") == F.col("c")).select("l_fp", "component_id", "root")
    return prints.join(labels, F.col("fp") == F.col("l_fp")).select("doc_id", *carry, "fp", "component_id", "root")


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
