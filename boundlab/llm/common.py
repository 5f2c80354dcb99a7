"""What the operators share: word rules, checkpoints and distributed running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boundlab.session import saved, shared_folder, small  # noqa: F401

#: White space between words, as a Java regular expression.
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\u000b\u000c\r"
#: Rows that one task ranks at a time.
PIECE = 1 << 17
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone, so that other engines agree on every character."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def _hashable(name: str, kind: str) -> Column:
    """A column as Spark can hash it: a map by its sorted entries, what holds maps or variants deeper down as JSON."""
    column = F.col(f"`{name}`")
    if kind.startswith("map<") and "map<" not in kind[4:] and "variant" not in kind:
        return F.array_sort(F.map_entries(column))
    if "map<" in kind or "variant" in kind:
        return F.to_json(F.struct(column.alias("v")))
    return column


def row_keys(docs: DataFrame) -> list[Column]:
    """k1, k2: 128 bits that tell rows apart by all their columns, nulls included; equal rows share them."""
    parts = [x for c, kind in docs.dtypes for x in (F.col(f"`{c}`").isNull(), _hashable(c, kind))]
    return [F.xxhash64(F.lit(k), *parts).alias(f"k{k}") for k in (1, 2)]


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """k1, k2, `row` (a struct of all columns, so that no name can clash) and `more`."""
    return docs.select(*row_keys(docs), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *more)


def prefix_length(rows: int, piece: int = PIECE) -> int:
    """How many hexadecimal digits of a hash cut `rows` rows into pieces of about `piece` rows or fewer; two at least."""
    digits = 2
    while rows > piece * 16**digits:
        digits += 1
    return digits


def _same(columns: list[str], mark: str) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"{mark}{c}")) for c in columns]


def _marked(df: DataFrame, columns: list[str], mark: str, *more: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{mark}{c}") for c in columns), *more)


def _cut_repeated(df: DataFrame, groups: list[str], key: str, large: DataFrame, piece: int) -> DataFrame:
    """df with `_part` and `_salt`, which cut the buckets `large` further, in the order of the key.

    Only a repeated key can fill a bucket far beyond the others. Keys with more
    than `piece` rows get parts of their own, the keys between two of them share
    one, and the rows of a repeated key, which may come in any order, are dealt
    out by salt. The salts are written down, so that a lost task can't deal anew.
    """
    at = [*groups, "_bucket"]
    inside = df.join(small(_marked(large, at, "_l_")), _same(at, "_l_"), "left_semi")
    hot = inside.groupBy(*at, F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") > piece)
    hot = saved(hot.groupBy(*at).agg(F.collect_list(F.struct("_key", "_n")).alias("_hot")))  # a bucket's rows / piece keys at most
    both = df.join(small(_marked(hot, at, "_h_", "_hot")), _same(at, "_h_"), "left")
    keys = F.coalesce("_hot", F.array().cast("array<struct<_key:string,_n:bigint>>"))
    own = F.get(F.filter(keys, lambda h: h["_key"] == F.col(key)), F.lit(0))["_n"]
    part = 2 * F.size(F.filter(keys, lambda h: h["_key"] < F.col(key))) + own.isNotNull().cast("int")
    salt = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(own / piece)), F.lit(0))
    return saved(both.select(*df.columns, part.alias("_part"), salt.alias("_salt")))


def running_total(df: DataFrame, groups: list[str], order: list[str], value: str, name: str, digits: int, piece: int = PIECE) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of the group that come before this one.

    A window over a whole group would put a hot group into one task. Here the
    first `digits` digits of the first order column, a hash in hexadecimal (see
    prefix_length), cut each group into pieces: a window over the few sums by
    piece gives each its offset, and a second one works inside pieces. Pieces
    far larger than planned hold a repeated key and are cut further. Rows that
    are equal in the order columns come in any order; all that share a hash
    have to.
    """
    df = df.withColumn("_bucket", F.substring(order[0], 1, digits))
    at = [*groups, "_bucket"]
    sums = saved(df.groupBy(*at).agg(F.sum(value).alias("_sum"), F.count("*").alias("_rows")))
    large = sums.where(F.col("_rows") > 4 * piece)
    if not large.isEmpty():
        df = _cut_repeated(df, groups, order[0], large, piece)
        at += ["_part", "_salt"]
        sums = saved(df.groupBy(*at).agg(F.sum(value).alias("_sum")))
    before = Window.partitionBy(*groups).orderBy(*at[len(groups) :]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = _marked(sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))), at, "_p_", "_offset")
    inside = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_inner", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    both = inner.join(small(offsets), _same(at, "_p_")).withColumn(name, F.col("_inner") + F.col("_offset"))
    return both.drop("_inner", "_offset", *at[len(groups) :], *(f"_p_{c}" for c in at))
