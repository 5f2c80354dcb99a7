"""A corpus, cleaned in five stages: quality, toxicity, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir), reads all that the one before kept and
returns a DataFrame; all but the last return the columns of `documents`, and
extra columns pass through them.

Every row is a document of its own. Decisions go by row: either a row travels
through the operator whole, or it is found again by 128 bits of hash over all
its columns. So rows with a null doc_id are documents of their own, and so are
rows that share a doc_id but differ in any other column; of rows that are equal
in every column it doesn't matter which one stays. A null text is empty: it has
too few words and goes in the first stage. Equal and near-equal texts end as one
row, the one with the smallest doc_id (null last, ties by hash). Very long texts
are read whole. Empty tables give empty results.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundlab.llm import mixing, pieces, quality, simhash, toxicity
from boundlab.llm.common import packed, shared_folder, table

#: SQL can't express the learnt, hashed and encoded stages.
ORACLE_SQL = None
KEYS = ("k1", "k2")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject, and boilerplate lines from the others' texts; n_chars follows."""
    found = quality.quality_rules(docs).where("kept")
    kind = dict(docs.dtypes).get("n_chars", "bigint")
    changed = {"text": F.col("clean_text"), "n_chars": F.when(F.col("row.text").eqNullSafe(F.col("clean_text")), F.col("row.n_chars")).otherwise(F.length("clean_text")).cast(kind)}
    return found.select(*(changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier calls toxic."""
    return toxicity.scored(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select("row.*")


def _matching(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """One of the equal rows of `rows` (see packed) for each key of `chosen`, with the latter's columns."""
    chosen = chosen.withColumnsRenamed({k: f"c_{k}" for k in KEYS})
    both = rows.join(chosen, (F.col("k1") == F.col("c_k1")) & (F.col("k2") == F.col("c_k2")))
    return both.dropDuplicates(list(KEYS))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the smallest doc_id, null last."""
    rows = packed(docs)
    found = simhash.near_duplicates(rows.select(*KEYS, "row.doc_id", "row.text"), carry=KEYS)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEYS)).alias("best"))
    return _matching(rows, best.select("best.k1", "best.k2")).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, once or twice, whole; untaken ones go."""
    rows = packed(docs)
    taken = mixing.mix(rows.select(*KEYS, "row.doc_id", "row.source", "row.text"), carry=KEYS)
    times = taken.groupBy(*KEYS).agg(F.sum(F.coalesce(F.ceil(F.try_divide("taken", "size")), F.lit(0))).cast("int").alias("times")).where("times > 0")
    return _matching(rows, times).select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, tokens, n_tokens and whether decoding gives the text back."""
    model = pieces.read_model()
    encoded = pieces.encode_pieces(docs.select("doc_id", "lang", "source", "text"), model, back=True)  # one worker a task
    whole = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.SPACE), F.lit(" "))
    return encoded.select("doc_id", "lang", "source", "tokens", F.size("tokens").alias("n_tokens"), whole.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
