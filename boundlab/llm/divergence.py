"""Source divergence audit: how far the sources of a language lie apart in their words.

Every (lang, source) group, and each language as a whole, gives each kept term
of the language a smoothed frequency of SCALE parts; f measures how far a
group's p lies from a partner's q, in whole numbers throughout.

The sum of f over all terms for each pair of sources comes from an inverted
index with a corrected baseline. A pair starts at V times the f of two zero
counts. Then postings correct it where counts aren't zero: those of one source
against a partner that lacks the term, counted by equal counts first; then,
where a term has postings of both, what that is off by. Terms that neither
source has cost nothing. Postings of a term lie in blocks of about BLOCK
sources, and pairs are made block against block and summed in the task that
makes them, so no list grows with the number of sources. The report of terms
takes the first ranks by a window, cut down before the shuffle.

Tables that come out hold each pair of a language's sources, as asked; no
other step makes pairs of rows.

Nulls: null texts, languages and sources are empty strings, so rows without a
source form a source of their own. A document is a row: repeated rows count
each, doc_id isn't read. Sources without a kept term still have pairs; with V = 0
all values are 0. A language of one source has no pairs. Very long texts are
read whole; a task holds the words of one at a time. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boundlab.session import small

from .common import saved, table

#: Frequencies are parts of SCALE; a power of ten, by whose digits a division goes.
SCALE_DIGITS = 9
#: ASCII letters lower-cased, the rest of ASCII, which stands between terms, to spaces; other bytes stay.
LETTERS = bytes(x if x >= 128 or 97 <= x <= 122 else x + 32 if 65 <= x <= 90 else 32 for x in range(256))
#: Terms that a task holds before it gives its counts out, and rows of a batch then.
MOST_TERMS, OUT_ROWS = 1 << 18, 1 << 15
LEAST_DOCUMENTS, TERM_RANKS, BLOCK = 3, 200, 256


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kept)), by long division in steps of three digits: exact for fewer than 9 * 10^15 occurrences in a language."""
    below = total + kept
    rest = count + 1
    out = F.lit(0).cast("long")
    for _ in range(SCALE_DIGITS // 3):
        rest = rest * 1000
        out = out * 1000 + _div(rest, below)
        rest = rest % below
    return 1 + out


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def far(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _counted(batches):
    """A task's occurrences and documents by group and term, given out whenever MOST_TERMS are held; the empty term marks that a group occurs."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    seen = 0

    def given():
        for (lang, source), (n, docs) in held.items():
            terms = [b"", *n]
            for i in range(0, len(terms), OUT_ROWS):
                part = terms[i : i + OUT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "docs"])

    for b in batches:
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text"), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen -= len(n)
            words = (text.as_py() or b"").translate(LETTERS).split()
            n.update(words)
            docs.update(set(words))
            seen += len(n)
            if seen > MOST_TERMS:
                yield from given()
                held, seen = {}, 0
    yield from given()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it); every group has a row with the empty term."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), F.col("text").cast("binary").alias("text"))
    each = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Index:
    """Saved tables: `groups` (lang, source, total, kept, zero) and `postings` (lang, source, term, n, p) of kept terms; `zero` is p of the count 0."""

    def __init__(self, docs: DataFrame, least: int = LEAST_DOCUMENTS):
        counts = saved(term_counts(docs))
        terms = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least)
        self.terms = saved(terms.select("lang", "term", "all_n"))
        kept = counts.where("term <> ''").join(self.terms.select(F.col("lang").alias("t_lang"), F.col("term").alias("t_term"), "all_n"), (F.col("lang") == F.col("t_lang")) & (F.col("term") == F.col("t_term"))).drop("t_lang", "t_term", "docs")
        kept = saved(kept)
        sizes = self.terms.groupBy(F.col("lang").alias("v_lang")).agg(F.count("*").alias("kept"), F.sum("all_n").alias("lang_total"))
        totals = kept.groupBy(F.col("lang").alias("n_lang"), F.col("source").alias("n_source")).agg(F.sum("n").alias("total"))
        groups = counts.select("lang", "source").distinct().join(sizes, F.col("lang") == F.col("v_lang"), "left").join(totals, (F.col("lang") == F.col("n_lang")) & (F.col("source") == F.col("n_source")), "left")
        groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("kept", "lang_total", "total")))
        zero = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).otherwise(F.lit(1).cast("long"))
        self.groups = saved(groups.withColumn("zero", zero))
        mine = self.groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "kept", "lang_total", "total", "zero")
        both = kept.join(mine, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source"))).drop("g_lang", "g_source")
        self.postings = saved(both.withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))).select("lang", "source", "term", "n", "p", "zero", share(F.col("all_n"), F.col("lang_total"), F.col("kept")).alias("q")))


def _named(rows: DataFrame, prefix: str, *names: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{prefix}{c}") for c in names))


def pair_values(index: Index, block: int = BLOCK) -> DataFrame:
    """lang, source, item, value: f of the source's p and the item's q, over all kept terms, for each two sources of a language."""
    mine, other = _named(index.groups, "a_", "lang", "source", "zero", "kept"), small(_named(index.groups, "b_", "lang", "source", "zero"))
    different = (F.col("a_lang") == F.col("b_lang")) & (F.col("a_source") != F.col("b_source"))
    empty = far(F.col("a_zero"), F.col("b_zero"))
    base = mine.join(other, different).select(F.col("a_lang").alias("lang"), F.col("a_source").alias("source"), F.col("b_source").alias("item"), (F.col("a_kept") * empty).alias("value"))
    # a source's terms by count, against partners without the term
    levels = saved(index.postings.groupBy("lang", "source", "n", "p", "zero").agg(F.count("*").alias("times")))
    alone = []
    for one, two in (("a_", "b_"), ("b_", "a_")):
        have, lack = _named(levels, one, "lang", "source", "p", "zero", "times"), small(_named(index.groups, two, "lang", "source", "zero"))
        p, q = (F.col(f"{x}{'p' if x == one else 'zero'}") for x in ("a_", "b_"))
        alone.append(have.join(lack, different).select(F.col("a_lang").alias("lang"), F.col("a_source").alias("source"), F.col("b_source").alias("item"), (F.col(f"{one}times") * (far(p, q) - empty)).alias("value")))
    # postings of both
    many = index.groups.groupBy("lang").agg(F.ceil(F.count("*") / block).alias("blocks"))
    blocked = index.postings.join(many.withColumnRenamed("lang", "m_lang"), F.col("lang") == F.col("m_lang")).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
    lists = blocked.groupBy("lang", "term", "block").agg(F.collect_list(F.struct("source", "p", "zero")).alias("list"))
    if index.groups.groupBy("lang").count().where(F.col("count") > block).limit(1).count():
        lists = saved(lists)
        left, right = _named(lists, "a_", "lang", "term", "list"), _named(lists, "b_", "lang", "term", "list")
        met = left.join(right, (F.col("a_lang") == F.col("b_lang")) & (F.col("a_term") == F.col("b_term"))).select("a_lang", "a_list", "b_list")
    else:
        met = lists.select(F.col("lang").alias("a_lang"), F.col("list").alias("a_list"), F.col("list").alias("b_list"))
    pairs = met.select("a_lang", F.explode("a_list").alias("a"), "b_list").select("a_lang", "a", F.explode("b_list").alias("b")).where(F.col("a.source") != F.col("b.source"))
    off = far(F.col("a.p"), F.col("b.p")) - far(F.col("a.p"), F.col("b.zero")) - far(F.col("a.zero"), F.col("b.p")) + far(F.col("a.zero"), F.col("b.zero"))
    joint = pairs.select(F.col("a_lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item"), off.alias("value"))
    parts = base
    for x in (*alone, joint):
        parts = parts.unionByName(x.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(index: Index) -> DataFrame:
    """lang, source, item, value: f of each term that a source uses more than its language does."""
    return index.postings.where("p > q").select("lang", "source", F.col("term").alias("item"), far(F.col("p"), F.col("q")).alias("value"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS, block: int = BLOCK) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: all partners, and the first `ranks` terms, of every source."""
    index = Index(docs, least)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pair_values(index, block), "pair").unionByName(ranked(term_values(index), "term").where(F.col("rank") <= ranks))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(x.n, 0) AS n, k.n AS all_n FROM g JOIN kept k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source) AS below, sum(all_n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source) AS all_below FROM c),
p AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // below AS p, 1 + (CAST(1000000000 AS HUGEINT) * (all_n + 1)) // all_below AS q FROM s),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
listed AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM listed) WHERE part = 'pair' OR rank <= 200
"""
