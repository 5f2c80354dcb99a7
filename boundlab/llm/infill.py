"""Fill-in-middle transformation: texts rearranged so that a model learns to fill gaps.

A text is cut into units (code points). Two cuts, drawn by a hash of the seed
and doc_id, give prefix, middle and suffix; a sentinel stands before each part:
    psm: <P>prefix<S>suffix<M>middle        spm: <S>suffix<P>prefix<M>middle
A share of the texts, empty ones, and those that hold a sentinel already stay
plain. `restored` parses the sentinels and gives the exact text back.

DataFrame functions alone, row by row: no shuffle, any size of table. A unit
array exists for one text at a time, so a very long text needs memory in
proportion to itself; nothing is cut off.

Nulls: a null text is empty (plain, n 0, output empty); a null doc_id is drawn
as the empty string. Repeated rows give equal results, rows that share a
doc_id are cut at the same draws. An empty table gives no rows. Extra columns
pass through; those named like a result are replaced by it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

SENTINELS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
#: Percent of the texts that are rearranged, and of those percent with the suffix first.
RATES = {"rearranged": 90, "suffix_first": 20}


def apart(sentinels: tuple[str, str, str]) -> None:
    """Raises ValueError unless a sentinel can only be read where it was written: different, none inside another, no end of one is the start of one."""
    for i, a in enumerate(sentinels):
        for k, b in enumerate(sentinels):
            if not a or (i != k and a in b) or any(a.endswith(b[:n]) for n in range(1, len(b))):
                raise ValueError(f"sentinels {sentinels} can be misread")


def draws(seed: int, key: Column) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def holds(text: Column, sentinels: tuple[str, str, str]) -> Column:
    found = F.lit(False)
    for s in sentinels:
        found = found | F.contains(text, F.lit(s))
    return found


def transformed(docs: DataFrame, seed: int = 1, sentinels: tuple[str, str, str] = SENTINELS, rearranged: int = RATES["rearranged"], suffix_first: int = RATES["suffix_first"]) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars and output."""
    apart(sentinels)
    p, s, m = (F.lit(x) for x in sentinels)
    h1, h2, h3, h4 = draws(seed, F.col("row.doc_id"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # no name of theirs can clash
    plain = (F.col("text") == "") | holds(F.col("text"), sentinels) | (F.pmod(h3, F.lit(100)) >= rearranged)
    rows = rows.select("row", F.coalesce("row.text", F.lit("")).alias("text"))
    # each step is a projection of its own, so that the unit array is made once
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.pmod(h4, F.lit(100)) < suffix_first, "spm").otherwise("psm"))
    moved = F.col("form") != "plain"
    rows = rows.withColumn("units", F.when(moved, F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))))
    rows = rows.withColumn("n", F.when(moved, F.size("units")).otherwise(F.length("text")).cast("long"))
    one, two = F.pmod(h1, F.col("n") + 1), F.pmod(h2, F.col("n") + 1)
    rows = rows.withColumns({"first": F.when(moved, F.least(one, two).cast("int")), "last": F.when(moved, F.greatest(one, two).cast("int"))})
    piece = lambda start, length: F.array_join(F.slice("units", start, length), "")
    rows = rows.withColumns({"p": piece(F.lit(1), F.col("first")), "m": piece(F.col("first") + 1, F.col("last") - F.col("first")), "s": piece(F.col("last") + 1, F.col("n").cast("int") - F.col("last"))})
    output = F.when(F.col("form") == "psm", F.concat(p, "p", s, "s", m, "m")).when(F.col("form") == "spm", F.concat(s, "s", p, "p", m, "m")).otherwise(F.col("text"))
    made = {"n": F.col("n"), "form": F.col("form"), "prefix_chars": F.col("first").cast("long"), "middle_chars": (F.col("last") - F.col("first")).cast("long"), "output": output}
    return rows.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in made), *(v.alias(k) for k, v in made.items()))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of `transformed` came from."""
    apart(sentinels)
    parts = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (
  SELECT *, CAST(length(text) AS BIGINT) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 AS plain,
    ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 AS suffix_first
  FROM d
),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n),
o AS (
  SELECT *, CASE WHEN plain THEN text
    WHEN suffix_first THEN '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a)
    ELSE '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a) END AS output
  FROM c
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN a END AS prefix_chars, CASE WHEN NOT plain THEN b - a END AS middle_chars,
  sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM o
"""
