"""Quality rules with cross-document line frequencies.

Each line is normalised (ASCII lower case, single spaces) and hashed. A line of
a host is boilerplate when at least `min_docs` different documents of that host
hold it and these are either more than `max_share` of the host's documents or
at least `most_docs`, so that a large host doesn't loosen the rule. Boilerplate
lines are removed from the text; a document left with too few words, or too
small a part of its words, is depleted and rejected. A document is a row; rows
equal in doc_id, source and text are one. Copies under other ids count each.

Everything runs as DataFrame expressions. Texts are parsed once: the base counts
and the lines' hashes go to the checkpoint folder, and all else reads those.
Line counts are pre-aggregated before the shuffle, the boilerplate table (at
most lines / min_docs rows) is joined by (host, line, salt) and no group is
gathered in one place.

Nulls: a null text is empty; null hosts form a host of their own; a null doc_id
is a value like any other. Repeated rows are each reported. An empty table gives
no rows. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP_CHARS, ascii_lower, packed, saved, table, words_of

SYMBOLS = "#*$%&|<>"
SALTS = 16
LIMITS = {"min_docs": 10, "max_share": 0.05, "most_docs": 200, "min_words": 5, "min_left": 0.3}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_boiler_words", "base_failed", "kept"]

#: Words in 8-word windows that occur twice or more: window hashes are sorted
#: with their positions, equal neighbours give the repeated positions, and the
#: windows from these cover min(8, distance to the previous one) new words each.
#: transform(array(x), v -> ...)[0] binds x to v, so that it is computed once.
REPEATED = """
transform(array(transform({words}, w -> xxhash64(w))), h ->
 transform(array(if(size(h) < 8, array(), transform(sequence(1, size(h) - 7), i -> xxhash64(slice(h, i, 8))))), g ->
  if(size(array_distinct(g)) = size(g), 0L,
   transform(array(sort_array(transform(g, (x, i) -> struct(x as h, i as i)))), s ->
    transform(array(sort_array(transform(filter(s, (x, k) -> x.h <=> get(s, k - 1).h or x.h <=> get(s, k + 1).h), x -> x.i))), p ->
     aggregate(transform(p, (x, k) -> cast(least(8, x - get(p, k - 1)) as bigint)), 0L, (a, b) -> a + b))[0])[0]))[0])[0]
"""


def removed(text: Column, chars: str) -> Column:
    """Code points left when `chars` are taken out."""
    return F.length(F.translate(text, chars, ""))


def normalised(text: Column) -> Column:
    """ASCII lower case and single spaces; line ends stay. Works on a line or on a whole text."""
    return F.regexp_replace(ascii_lower(text), r"[\x20\x09\x0B-\x0D]+", " ")


def parsed(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id, source, the counts that need one document alone, and `lines`: (hash, words) of each different line."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("k1", "k2", "doc_id", "source", text.alias("text")).withColumn("_words", words_of(F.col("text")))
    found = found.withColumn("_raw", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(GAP_CHARS)) != ""))
    found = found.withColumn("_lines", F.filter(F.transform(F.split(normalised(F.col("text")), "\n"), lambda x: F.btrim(x)), lambda x: x != ""))
    words = lambda x: (F.length(x) - F.length(F.translate(x, " ", "")) + 1).cast("int")
    return found.select(
        "k1",
        "k2",
        "doc_id",
        "source",
        F.size("_words").cast("long").alias("n_words"),
        removed(F.col("text"), GAP_CHARS).cast("long").alias("word_chars"),
        (F.length("text") - removed(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_raw") - F.size(F.array_distinct("_raw"))).cast("long").alias("n_dup_lines"),
        F.expr(REPEATED.format(words="_words")).alias("n_repeat_words"),
        F.transform("_lines", lambda x: F.struct(F.xxhash64(x).alias("line"), words(x).alias("words"))).alias("lines"),
    )


def boilerplate(read: DataFrame, min_docs: int, max_share: float, most_docs: int) -> DataFrame:
    """(source, line) of the lines above the limits."""
    rows = read.select("k1", "k2", "source", F.explode(F.array_distinct("lines.line")).alias("line"))
    counts = rows.groupBy("source", "line").agg(F.count_distinct("k1", "k2").alias("n")).where(F.col("n") >= min_docs)
    hosts = read.groupBy(F.col("source").alias("host")).agg(F.count_distinct("k1", "k2").alias("n_host"))
    near = counts.join(hosts, F.col("source").eqNullSafe(F.col("host")))
    return near.where((F.col("n") > F.lit(max_share) * F.col("n_host")) | (F.col("n") >= most_docs)).select("source", "line")


def verdicts(docs: DataFrame, min_docs: int, max_share: float, most_docs: int, min_words: int, min_left: float) -> DataFrame:
    """k1, k2, doc_id, COUNTS and `bad`, the hashes of the document's boilerplate lines, for each row of `docs` (k1, k2, doc_id, source, text)."""
    read = saved(parsed(docs))
    salted = read.select("k1", "k2", "source", F.explode("lines").alias("l")).select("k1", "k2", "source", "l.line", "l.words", F.pmod("k1", F.lit(SALTS)).alias("salt"))
    lines = boilerplate(read, min_docs, max_share, most_docs).select(F.col("source").alias("b_source"), F.col("line").alias("b_line"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("b_salt"))
    hit = salted.join(lines, [F.col("source").eqNullSafe(F.col("b_source")), F.col("line") == F.col("b_line"), F.col("salt") == F.col("b_salt")])
    # a line's words follow from its hash, so the lines of repeated rows, summed together, are divided by their number
    lost = hit.groupBy(F.col("k1").alias("l1"), F.col("k2").alias("l2")).agg(F.sum("words").alias("lost"), F.collect_set("line").alias("bad"))
    same = read.groupBy(F.col("k1").alias("s1"), F.col("k2").alias("s2")).agg(F.count("*").alias("times")).where("times > 1")
    both = read.drop("lines").join(lost, (F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2")), "left").join(same, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left")
    left = F.col("n_words") - F.col("n_boiler_words")
    depleted = (left < min_words) | (left < F.lit(min_left) * F.col("n_words"))
    return (
        both.withColumn("n_boiler_words", F.coalesce((F.col("lost") / F.coalesce("times", F.lit(1))).cast("long"), F.lit(0).cast("long")))
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
        .select("k1", "k2", "doc_id", *COUNTS, "bad")
    )


def without(text: Column, bad: Column) -> Column:
    """The text without the lines whose hashes are in `bad`."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(bad, F.xxhash64(F.btrim(normalised(x)))))
    return F.when(text.isNotNull() & bad.isNotNull(), F.array_join(kept, "\n")).otherwise(text)


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """`row`, a struct of all columns of `docs`, with COUNTS and `clean_text`, the text without boilerplate lines; a row for each row."""
    rows = packed(docs)
    found = verdicts(rows.select("k1", "k2", "row.doc_id", "row.source", "row.text"), **(LIMITS | limits))
    once = found.drop("doc_id").dropDuplicates(["k1", "k2"]).withColumnsRenamed({"k1": "v1", "k2": "v2"})
    both = rows.join(once, (F.col("k1") == F.col("v1")) & (F.col("k2") == F.col("v2")))
    return both.select("row", *COUNTS, without(F.col("row.text"), F.col("bad")).alias("clean_text"))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = packed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return verdicts(docs.select("k1", "k2", "row.doc_id", "row.source", "row.text"), **LIMITS).select("doc_id", *COUNTS)
