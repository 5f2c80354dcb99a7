"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents may belong to several sources. They are aggregated by membership
pattern; the flow routes each pattern's words to the quotas of its sources. The
first copy of a pattern's words costs nothing, the r-th copy costs r - 1, so
repetition is used only where it must be (convex costs). The flow works on one
node per pattern and source, whose number doesn't grow with the documents.
Within a pattern documents are taken in a seeded order, md5 of seed, doc_id and
text; each source of the pattern takes the next stretch of it, as long as its
route. The document on a limit is taken in part, so the words that a source
takes equal its routes. Source totals, and of documents in several sources the
patterns, come to the driver; beyond `most_patterns` different sets of sources
an error is raised before any is collected.

Running totals are two-level (see common.running_total), so a hot source is
spread over as many pieces as its rows need.

Nulls: a null text has size 0; the null source is a source and comes last; a
null or empty array of sources is the null source alone. A null doc_id is
ordered as an empty string. Repeated rows are each a document; rows equal in
doc_id and text may stand in any order, and many of them are ranked by many
tasks. Very long texts are read whole. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, prefix_length, running_total, saved, table, words_of

WEIGHTS = (5, 2, 1)
SHARE, MOST, SEED, MOST_PATTERNS = 1.5, 2, "mix-1", 100_000


def sizes(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size and order key."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    key = F.md5(F.concat(F.lit(SEED + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))
    return docs.select("doc_id", *carry, "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), key.alias("key"))


def targets(totals: dict, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> dict:
    """Words wanted from each source: by weight, at most `most` times its size, the excess reshared."""
    names = sorted((s for s in totals if s is not None), key=lambda s: s) + [s for s in totals if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    wanted, open_, rest = {}, set(names), share * sum(totals.values())
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / whole > most * totals[s]}
        if not over:
            wanted |= {s: rest * weight[s] / whole for s in open_}
            break
        for s in over:
            wanted[s] = float(most * totals[s])
        rest -= sum(most * totals[s] for s in over)
        open_ -= over
    return wanted


def route(patterns: dict[tuple, int], quotas: dict, most: int = MOST) -> dict[tuple, int]:
    """Min-cost flow: words sent from each pattern to each of its sources, {(pattern, source): words}.

    A path costs what the copy costs that it begins with, so paths are taken
    price by price: each further copy adds the patterns' sizes to what may leave
    them, and a maximum flow by levels is found on top of the last one before
    the next copy opens. Shortest paths never get cheaper again, hence the cost
    is least. Source quotas bind; what can't be routed is left. The same
    patterns give the same routes, whatever their order.
    """
    ordered = sorted(patterns, key=lambda p: [(s is None, s or "") for s in p])
    nodes = {p: i + 1 for i, p in enumerate(ordered)}
    nodes |= {("source", s): len(ordered) + 1 + i for i, s in enumerate(quotas)}
    start, end = 0, len(nodes) + 1
    head, left, out = [], [], [[] for _ in range(end + 1)]

    def arc(a, b, capacity):
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            out[x].append(len(head))
            head.append(y)
            left.append(c)
        return len(head) - 2

    leaving = [(arc(start, nodes[p], 0), patterns[p]) for p in ordered]
    routes = {(p, s): arc(nodes[p], nodes["source", s], most * patterns[p]) for p in ordered for s in p}
    for s, quota in quotas.items():
        arc(nodes["source", s], end, quota)

    def levels():
        level, queue = [-1] * (end + 1), deque([start])
        level[start] = 0
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if left[e] and level[head[e]] < 0:
                    level[head[e]] = level[a] + 1
                    queue.append(head[e])
        return level

    def block(level):
        """Fills every path that climbs one level a step; a node's arcs are tried once."""
        tried, path, at = [0] * (end + 1), [], start
        while True:
            if at == end:
                push = min(left[e] for e in path)
                for e in path:
                    left[e] -= push
                    left[e ^ 1] += push
                full = next(i for i, e in enumerate(path) if not left[e])
                at = head[path[full] ^ 1]
                del path[full:]
            while tried[at] < len(out[at]):
                e = out[at][tried[at]]
                if left[e] and level[head[e]] == level[at] + 1:
                    break
                tried[at] += 1
            else:
                if not path:
                    return
                at = head[path.pop() ^ 1]
                tried[at] += 1
                continue
            path.append(e)
            at = head[e]

    for _ in range(most):
        for e, size in leaving:
            left[e] += size
        while (level := levels())[end] >= 0:
            block(level)
    return {key: left[e ^ 1] for key, e in routes.items()}


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, carry: tuple[str, ...] = (), most_patterns: int = MOST_PATTERNS, piece: int = PIECE) -> DataFrame:
    """A row for each row of `docs`: doc_id, source, size, source_size, target, taken, by_source array<struct<source, taken>>, and the columns `carry`.

    `source` may be a string (one membership each) or an array of strings; then
    source_size and target are sums over the row's sources.
    """
    spark = docs.sparkSession
    many = dict(docs.dtypes)["source"].startswith("array")
    rows = saved(sizes(docs, carry))
    nothing = F.array(F.lit(None).cast("string"))
    pattern = F.when(F.coalesce(F.size("source"), F.lit(0)) > 0, F.array_sort(F.array_distinct("source"))).otherwise(nothing) if many else F.array("source")
    member = rows.withColumn("pattern", pattern)
    sums = saved(member.groupBy("pattern").agg(F.sum("size").alias("n"), F.count("*").alias("docs")))
    if (n := sums.count()) > most_patterns:
        raise ValueError(f"{n} different sets of sources; the flow takes {most_patterns}")
    found = sums.collect()  # most_patterns rows at most
    patterns = {tuple(r["pattern"]): r["n"] for r in found}
    digits = prefix_length(sum(r["docs"] for r in found), piece)
    totals: dict = {}
    for pattern, n in patterns.items():
        for s in pattern:
            totals[s] = totals.get(s, 0) + n
    wanted = targets(totals, weights, share, most)
    sent = route(patterns, {s: round(t) for s, t in wanted.items()}, most)
    quota = []  # each pattern's words are laid out `most` times in a row; its sources take one stretch after another
    for p in patterns:
        ends = [0]
        for s in p:
            ends.append(ends[-1] + sent.get((p, s), 0))
        quota.append((list(p), list(zip(p, ends[:-1], ends[1:], strict=True)), patterns[p], sum(totals[s] for s in p), float(sum(wanted[s] for s in p))))
    layout = "q_pattern array<string>, stretches array<struct<source: string, low: long, high: long>>, pattern_size long, source_size long, target double"
    ranked = running_total(member, ["pattern"], ["key", "doc_id", "size"], "size", "before", digits, piece)
    both = ranked.join(spark.createDataFrame(quota, layout), F.col("pattern") == F.col("q_pattern"))  # arrays that hold a null are equal too

    def share_of(stretch):
        starts = [F.col("before") + F.lit(c) * F.col("pattern_size") for c in range(most)]
        parts = [F.greatest(F.least(at + F.col("size"), stretch["high"]) - F.greatest(at, stretch["low"]), F.lit(0)) for at in starts]
        return F.struct(stretch["source"].alias("source"), sum(parts[1:], parts[0]).cast("long").alias("taken"))

    both = both.withColumn("by_source", F.transform("stretches", share_of))
    taken = F.aggregate("by_source", F.lit(0).cast("long"), lambda a, x: a + x["taken"])
    return both.select("doc_id", *carry, "source", "size", "source_size", "target", taken.alias("taken"), "by_source")


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source", "by_source").withColumn("target", F.round("target", 4))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w
  FROM d GROUP BY source
), ratio AS (
  SELECT *, 2.0 * n / w AS r, 1.5 * sum(n) OVER () AS whole,
    coalesce(sum(2 * n) OVER (ORDER BY 2.0 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_n,
    sum(w) OVER (ORDER BY 2.0 * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM src
), level AS (
  SELECT coalesce(arg_min((whole - full_n) / open_w, r) FILTER (WHERE (whole - full_n) / open_w <= r), max(r)) AS l FROM ratio
), t AS (SELECT source, n, least(2.0 * n, l * w) AS target, CAST(round(least(2.0 * n, l * w)) AS BIGINT) AS quota FROM ratio, level),
ranked AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d
)
SELECT doc_id, size, n AS source_size, round(target, 4) AS target,
  CAST(least(greatest(quota - before, 0), size) + least(greatest(quota - n - before, 0), size) AS BIGINT) AS taken
FROM ranked JOIN t ON ranked.source IS NOT DISTINCT FROM t.source
"""
