"""Balanced label propagation: linked documents move to their neighbours' shards under quotas.

Equal texts are linked. Every document starts in a shard drawn from its hash,
which gives each group a count by shard. A group larger than a shard takes whole
shards, those that hold most of it first, and one more for its remainder. Any
other group's rows propose, round by round, to move to the shard that holds most
of the group. Two shards exchange equal numbers of rows, and what is left moves
where there is room; leavers make room in the same round. Groups that are still
split after the rounds, or don't fit, are laid one after the other into the room
that is left. Where that cuts one, it goes whole into any shard that holds it.
So at most shards - 1 groups that fit a shard stay cut, however many rounds ran.

Rounds work on counts, at most one row for each group and shard. At the end
unlinked documents fill the shards up to exactly even counts (law `rows`: counts
at most one apart).

Nulls: a null text is empty and equal to other empty texts; a null doc_id is
hashed as an empty string. Repeated rows are each a document; rows equal in
doc_id and text may stand in any order, and many of them are ranked by many
tasks. Very long texts are hashed whole. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PIECE, prefix_length, running_total, saved, table

SHARDS, ROUNDS = 40, 6


def sized(docs: DataFrame, shards: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat(F.lit("shard|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(text.cast("binary"))).cast("binary"))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("copies"), key.alias("key"))
    return rows.withColumn("first", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))


def at(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def exchange(asked: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many of the rows that ask to go from one shard to another may: equal numbers both ways, and more where there is room."""
    allowed = {(s, t): min(n, asked.get((t, s), 0)) for (s, t), n in asked.items()}
    free, more = list(free), True
    while more:
        more = False
        for (s, t), n in sorted(asked.items()):
            step = min(n - allowed[s, t], free[t])
            if step > 0:
                allowed[s, t], free[t], free[s], more = allowed[s, t] + step, free[t] - step, free[s] + step, True
    return {k: n for k, n in allowed.items() if n}


def fill(n: int, free: list[int], votes: dict[int, int]) -> list[tuple[int, int, int]]:
    """(shard, from, to) for a group of n rows, in as few shards as the room allows; takes the room."""
    parts, low = [], 0
    while low < n:
        holds = [s for s, f in enumerate(free) if f >= n - low]
        s = min(holds, key=lambda s: (free[s], -votes.get(s, 0), s)) if holds else max(range(len(free)), key=lambda s: (free[s], votes.get(s, 0), -s))
        step = min(n - low, free[s])
        parts.append((s, low, low + step))
        free[s], low = free[s] - step, low + step
    return parts


def propagate(cells: DataFrame, free: list[int], rounds: int, digits: int) -> DataFrame:
    """copies, label, n -> the same after the rounds."""
    spark = cells.sparkSession
    state = saved(cells)
    for k in range(rounds):
        # ties go by hash: by number, all would move to the low shards and none back
        best = state.groupBy("copies").agg(F.max(F.struct("n", F.xxhash64("copies", "label").alias("tie"), "label")).alias("best"), F.count("*").alias("parts"))
        best = best.where("parts > 1").select(F.col("copies").alias("b_copies"), F.col("best.label").alias("target"))
        asked = saved(state.join(best, F.col("copies") == F.col("b_copies")).where("label != target").select("copies", "label", "n", "target"))
        flows = {(r["label"], r["target"]): r["n"] for r in asked.groupBy("label", "target").agg(F.sum("n").alias("n")).collect()}  # shards x shards
        loads = {r["label"]: r["n"] for r in state.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # one row a shard
        allowed = exchange(flows, [f - loads.get(s, 0) for s, f in enumerate(free)])
        if not allowed:
            break
        limits = spark.createDataFrame([(*key, n) for key, n in allowed.items()], "a_label int, a_target int, allowed long")
        turns = asked.withColumn("turn", F.md5(F.concat("copies", F.lit(f"|{k}"))))
        turns = running_total(turns, ["label", "target"], ["turn"], "n", "before", digits)
        moved = turns.join(F.broadcast(limits), (F.col("label") == F.col("a_label")) & (F.col("target") == F.col("a_target"))).where("before < allowed")
        moved = moved.withColumn("step", F.least("n", F.col("allowed") - F.col("before")))
        change = moved.select("copies", F.explode(F.array(F.struct(F.col("label"), (-F.col("step")).alias("n")), F.struct(F.col("target").alias("label"), F.col("step").alias("n")))).alias("x"))
        both = state.unionByName(change.select("copies", F.col("x.label").alias("label"), F.col("x.n").alias("n")))
        state = saved(both.groupBy("copies", "label").agg(F.sum("n").alias("n")).where("n > 0"))
    return state


def settle(state: DataFrame, free: list[int], digits: int) -> tuple[DataFrame, list[tuple[str, int, int, int]]]:
    """(copies, label) of groups that lie in one shard, and (copies, shard, from, to) of the others, fewer than shards."""
    groups = state.groupBy("copies").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max("label").alias("label"))
    whole = running_total(groups.where("parts = 1"), ["label"], ["copies"], "n", "before", digits)
    whole = whole.withColumn("label", F.when(F.col("before") + F.col("n") <= F.get(at(free), F.col("label")), F.col("label"))).drop("before")
    found = saved(whole.unionByName(groups.where("parts > 1").withColumn("label", F.lit(None).cast("int"))).drop("parts"))
    sums = lambda df: {r["label"]: r["n"] for r in df.where("label is not null").groupBy("label").agg(F.sum("n").alias("n")).collect()}
    held = sums(found)
    room = [f - held.get(s, 0) for s, f in enumerate(free)]
    low = [sum(room[:s]) for s in range(len(room))]
    rest = running_total(found.where("label is null").drop("label").withColumn("all", F.lit(0)), ["all"], ["copies"], "n", "before", digits)
    shard = lambda row: F.size(F.filter(at(low), lambda x: x <= row)) - 1
    rest = saved(rest.withColumn("s", shard(F.col("before"))).withColumn("label", F.when(F.col("s") == shard(F.col("before") + F.col("n") - 1), F.col("s"))).select("copies", "n", "label"))
    held = sums(rest)
    room = [f - held.get(s, 0) for s, f in enumerate(room)]
    across = sorted((-r["n"], r["copies"]) for r in rest.where("label is null").collect())  # fewer than shards
    parts = [(copies, *part) for n, copies in across for part in fill(-n, room, {})]
    return found.select("copies", "label").unionByName(rest.select("copies", "label")).where("label is not null"), parts


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, piece: int = PIECE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of `docs`."""
    spark = docs.sparkSession
    rows = saved(sized(docs, shards))
    total = rows.count()
    digits = prefix_length(total, piece)
    want = [total // shards + (s < total % shards) for s in range(shards)]
    linked = rows.groupBy("copies").agg(F.count("*").alias("n")).where("n > 1").select(F.col("copies").alias("l_copies"))
    cells = saved(rows.join(linked, F.col("copies") == F.col("l_copies"), "left_semi").groupBy("copies", "first").agg(F.count("*").alias("n")))
    large = cells.groupBy("copies").agg(F.sum("n").alias("total")).where(F.col("total") > min(want)).select(F.col("copies").alias("g_copies"))  # fewer than shards
    votes: dict[str, dict[int, int]] = {}
    for r in cells.join(F.broadcast(large), F.col("copies") == F.col("g_copies"), "left_semi").collect():
        votes.setdefault(r["copies"], {})[r["first"]] = r["n"]
    free, parts = list(want), []
    for copies, by in sorted(votes.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        parts += [(copies, *part) for part in fill(sum(by.values()), free, by)]
    fitting = cells.join(F.broadcast(large), F.col("copies") == F.col("g_copies"), "left_anti")
    whole, across = settle(propagate(fitting.select("copies", F.col("first").alias("label"), "n"), free, rounds, digits), free, digits)
    parts += across
    labels = cells.join(whole.select(F.col("copies").alias("w_copies"), "label"), F.col("copies") == F.col("w_copies"))
    labels = labels.select(F.col("copies").alias("c_copies"), F.col("first").alias("c_first"), "label")
    rows = rows.withColumn("one", F.lit(1))
    cut = F.broadcast(spark.createDataFrame([(c,) for c in sorted({p[0] for p in parts})], "p_copies string"))
    ranges = F.broadcast(spark.createDataFrame(parts, "r_copies string, label int, low long, high long"))
    in_cut = F.col("copies") == F.col("p_copies")
    split = running_total(rows.join(cut, in_cut, "left_semi"), ["copies"], ["key"], "one", "place", digits, piece)
    split = split.join(ranges, (F.col("copies") == F.col("r_copies")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))).select(*rows.columns, "label")
    placed = rows.join(cut, in_cut, "left_anti").join(labels, (F.col("copies") == F.col("c_copies")) & (F.col("first") == F.col("c_first")), "left").select(*rows.columns, "label").unionByName(split)
    # order inside a shard; linked rows beyond the shard's size go to the pool of unlinked ones
    ranked = saved(running_total(placed, ["label"], ["key", "doc_id", "text_crc32", "size"], "one", "rank", digits, piece))
    sizes = spark.createDataFrame(list(enumerate(want)), "s int, want long")
    kept = ranked.join(F.broadcast(sizes), F.col("label") == F.col("s"), "left").withColumn("stays", F.col("label").isNotNull() & (F.col("rank") < F.col("want")))
    loads = {r["label"]: r["n"] for r in kept.where("stays").groupBy("label").agg(F.count("*").alias("n")).collect()}
    held = [loads.get(s, 0) for s in range(shards)]
    low = [0]  # the pool's ranks from low[s] on go to shard s, after the rows that it holds
    for s in range(shards - 1):
        low.append(low[-1] + want[s] - held[s])
    pool = running_total(kept.where("not stays").drop("rank").withColumn("all", F.lit(0)), ["all"], ["key", "doc_id", "text_crc32", "size"], "one", "rank", digits, piece)
    pool = pool.withColumn("g", F.size(F.filter(at(low), lambda x: x <= F.col("rank"))) - 1)
    pool = pool.withColumn("slot", F.col("rank") - F.get(at(low), F.col("g")) + F.get(at(held), F.col("g")))
    columns = ["doc_id", "size", "text_crc32"]
    there = kept.where("stays").select(*columns, F.col("label").alias("shard"), F.col("rank").cast("long").alias("slot"))
    return there.unionByName(pool.select(*columns, F.col("g").alias("shard"), F.col("slot").cast("long").alias("slot")))


def op8_balanced_shards(spark, sf_dir: str) -> DataFrame:
    made = balanced_shards(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
