"""License scans: base phrases, and an exact set-similarity join with notice templates.

Text blocks don't depend on line breaks: for each size class of templates (up to
16, 32, 64, 128 words and so on) they are windows of twice that many words, one
for each half, so a notice lies whole in one of them however it is wrapped. A
template matches a block of its class that holds at least `threshold` of the
template's different words. Words of templates are ordered by how many blocks'
texts hold them, rarest first. With o words needed of a template of n, a
matching block holds one of the n - o + 1 rarest (prefix filter), has o words
(length filter) and still has o template words from the first shared one on
(positional filter). Candidates are joined with the prefixes and verified in
full, so no match is lost.

One pass counts template words, one reads blocks; only candidate blocks leave
it. The templates are a fixed list; their table is broadcast if it is small.

Nulls: a null text is empty. Rows with equal doc_id and text share their labels;
each is reported. A null doc_id is a value. Very long texts and lines are read
whole. Of several templates with one label the best part counts, so ties don't
matter. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table
from .notices import NOTICES

THRESHOLD, LEAST_CLASS, MOST_BROADCAST = 0.8, 16, 100_000
#: Base phrases.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Letters a-z, digits and bytes from 128 on stay; A-Z become a-z; the rest are gaps.
WORDS = bytes(x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else x + 32 if 65 <= x <= 90 else 32 for x in range(256))


def size_class(words: str) -> int:
    """The smallest power of two, LEAST_CLASS at least, that holds the template."""
    c = LEAST_CLASS
    while c < len(words.split()):
        c *= 2
    return c


def counter(vocabulary: frozenset[bytes]):
    def run(batches):
        for b in batches:
            found: Counter = Counter()
            for t in b.column("text"):
                found.update(vocabulary.intersection((t.as_py() or b"").translate(WORDS).split()))
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found]), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    return run


def blocks_of(words: list[bytes], rank: dict[bytes, int], prefixes: dict[int, frozenset[bytes]]) -> list[dict]:
    """The windows that hold a prefix word of their class: class, different words, ranks of template words."""
    places = [i for i, w in enumerate(words) if w in rank]
    out = []
    for size, marks in prefixes.items():
        windows = {k for i in places if words[i] in marks for k in (i // size, i // size - 1) if k >= 0}
        for k in sorted(windows):
            low, high = k * size, (k + 2) * size
            held = {rank[words[places[j]]] for j in range(bisect_left(places, low), bisect_left(places, high))}
            out.append({"class": size, "size": len(set(words[low:high])), "ranks": sorted(held)})
    return out


def reader(rank: dict[bytes, int], prefixes: dict[int, frozenset[bytes]], phrases: list[tuple[list[bytes], str]]):
    """A row a document: its base counts, and its candidate blocks as ranks of template words."""

    def run(batches):
        for b in batches:
            out = []
            for t in b.column("text"):
                words = (t.as_py() or b"").translate(WORDS).split()
                places, labels = [], set()
                joined = b" ".join(words)
                for phrase, label in phrases:
                    if b" ".join(phrase) in joined:
                        at = [i for i, w in enumerate(words) if w == phrase[0] and words[i : i + len(phrase)] == phrase]
                        places += at
                        if at:
                            labels.add(label)
                out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), blocks_of(words, rank, prefixes)))
            block = pa.struct([("class", pa.int64()), ("size", pa.int64()), ("ranks", pa.list_(pa.int32()))])
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(block))
            cols = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copy"), *cols], ["doc_id", "copy", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"])

    return run


def license_scan(docs: DataFrame, templates=NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    text = docs.select("doc_id", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("copy"), F.col("text").cast("binary").alias("text"))
    sets = [(label, size_class(words), set(words.split())) for label, words in templates]
    vocabulary = frozenset(w.encode() for *_, s in sets for w in s)
    counts = text.select("text").mapInArrow(counter(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    seen = {r["word"]: r["n"] for r in counts.collect()}  # the templates' words at most
    order = sorted((w.decode() for w in vocabulary), key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index, marks = [], {}
    for label, size, s in sets:
        ranks = sorted(rank[w] for w in s)
        need = ceil(threshold * len(ranks) - 1e-9)
        index += [(label, size, r, ranks, need) for r in ranks[: len(ranks) - need + 1]]
        marks.setdefault(size, set()).update(order[r].encode() for r in ranks[: len(ranks) - need + 1])
    prefixes = {size: frozenset(m) for size, m in marks.items()}
    phrases = [([w.encode() for w in p.split()], label) for p, label in PHRASES.items()]
    layout = "doc_id long, copy string, n_words long, n_base long, first_word long, last_word long, base_labels string, blocks array<struct<class: long, size: long, ranks: array<int>>>"
    base = saved(text.mapInArrow(reader({w.encode(): i for w, i in rank.items()}, prefixes, phrases), layout))
    blocks = base.select("doc_id", "copy", F.explode("blocks").alias("block")).select("doc_id", "copy", F.col("block.class").alias("class"), F.col("block.size").alias("size"), F.col("block.ranks").alias("ranks"))
    starts = blocks.select("*", F.posexplode("ranks").alias("place", "rank"))
    prefix = spark.createDataFrame(index, "label string, of_class long, prefix int, words array<int>, need int")
    prefix = F.broadcast(prefix) if len(index) <= MOST_BROADCAST else prefix
    near = starts.join(prefix, (F.col("rank") == F.col("prefix")) & (F.col("class") == F.col("of_class"))).where((F.col("size") >= F.col("need")) & (F.size("ranks") - F.col("place") >= F.col("need")))
    shared = F.size(F.array_intersect("ranks", "words"))
    hits = near.where(shared >= F.col("need")).select(F.col("doc_id").alias("h_doc"), F.col("copy").alias("h_copy"), "label", (shared / F.size("words")).alias("part"))
    hits = hits.groupBy("h_doc", "h_copy").agg(F.collect_set("label").alias("found"), F.max("part").alias("part"))
    both = base.drop("blocks").join(hits, F.col("doc_id").eqNullSafe(F.col("h_doc")) & (F.col("copy") == F.col("h_copy")), "left")
    own = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    every = F.array_sort(F.array_union(own, F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("part", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_join(every, ",").alias("labels"), score.alias("score"))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_VALUES = ", ".join(f"({size_class(words)}, '{label}', list_distinct(string_split('{words}', ' ')))" for label, words in NOTICES)
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER} AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, {_WORD})) AS word, generate_subscripts(regexp_extract_all(text, {_WORD}), 1) - 1 AS i FROM d),
n AS (SELECT *, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
base AS (
  SELECT r, i, 'cc-by' AS label FROM n WHERE word = 'cc' AND w2 = 'by'
  UNION ALL SELECT r, i, 'gpl' FROM n WHERE word = 'general' AND w2 = 'public' AND w3 = 'license'
  UNION ALL SELECT r, i, 'reserved' FROM n WHERE word = 'all' AND w2 = 'rights' AND w3 = 'reserved'
),
t(size, label, words) AS (VALUES {_VALUES}),
c AS (SELECT DISTINCT size FROM t),
b AS (SELECT r, size, k, list(DISTINCT word) AS words FROM (SELECT r, size, word, unnest([i // size, i // size - 1]) AS k FROM w, c) WHERE k >= 0 GROUP BY r, size, k),
hit AS (
  SELECT r, label, len(list_intersect(t.words, b.words)) / len(t.words) AS part FROM b JOIN t ON b.size = t.size
  WHERE len(list_intersect(t.words, b.words)) >= ceil({THRESHOLD} * len(t.words) - 1e-9)
),
lab AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM hit) GROUP BY r),
bs AS (SELECT r, count(*) AS n, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY r),
tot AS (SELECT r, count(*) AS n FROM w GROUP BY r),
best AS (SELECT r, max(part) AS part FROM hit GROUP BY r)
SELECT doc_id, coalesce(tot.n, 0) AS n_words, coalesce(bs.n, 0) AS n_base, CAST(bs.first_word AS BIGINT) AS first_word, CAST(bs.last_word AS BIGINT) AS last_word,
  coalesce(bs.labels, '') AS base_labels, coalesce(lab.labels, '') AS labels, CAST(CASE WHEN bs.n > 0 THEN 1.0 ELSE coalesce(best.part, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN tot USING (r) LEFT JOIN bs USING (r) LEFT JOIN lab USING (r) LEFT JOIN best USING (r)
"""
