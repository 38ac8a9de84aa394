"""Shards of near equal bytes by k-d tree partitioning (operator 10).

A document's size is its UTF-8 bytes plus 16. Equal texts form a group; a group is one unit of the tree and stays in one
shard unless it is heavier than a shard: then its rows are dealt by a hash of doc_id to units of about a quarter of a shard.
A unit has a place in metadata space: language and source (the smallest of its rows) and, if asked for, the log of the
text's bytes ("bytes_at"), each from 0 to 1. Without the bytes, long texts are spread over all shards, which evens out
their weight.

The tree splits a node that is to hold k shards in floor(k / 2) and ceil(k / 2), along the dimension in which its units lie
widest apart, at the weighted quantile that divides its bytes alike; equal values are ordered by the hash of the text. The
quantile is found by histograms of the weights, which are narrowed to the bin that holds the split until the error is below
`slack` of a shard, or the bin has one unit. All nodes of a level share a pass over the units; histograms are summed up and
searched in Spark, and the splits of a level are a table that is joined by node. The driver sees one row for each node, so
as many as there are shards at most.

Heavy units, of over `heavy_share` of a shard (at most shards / heavy_share of them), would upset a quantile when they lie
on it. They are dealt to the sides first, in the order of the node's dimension where both sides can hold what they get, else
by weight; the quantile of the others is then set so that both sides weigh what they should.

Slots: rows of a shard are dealt to bins by a hash of doc_id and text, numbered in each bin and shifted by the bins before,
so no task numbers a whole shard.

Defined cases: a null text has size 16 and groups with the empty text. A null language or source is a value of its own. Rows
with the same doc_id each get a slot; equal rows are interchangeable. With fewer units than shards some shards stay empty.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparloom.llm.common import discard, materialize

OVERHEAD = 16
#: Order within a node: 31 bits of the dimension's value, then 31 bits of the text's hash.
HASH_BITS = 31
TOP = (1 << 31) - 1
BINS = 1 << 20  # of the histograms of a level together
BIN_ROWS = 50_000  # rows that one task numbers
MOST_SHARDS = 1_000_000  # the tables of a level, with a row for each node, are broadcast up to here


def code(column: Column) -> Column:
    """A place from 0 to 1 for a category."""
    return F.when(column.isNull(), 0.0).otherwise((1 + F.pmod(F.xxhash64(column), F.lit(1 << 20))) / float(1 + (1 << 20)))


def small(table: DataFrame, rows: int) -> DataFrame:
    """table, to be broadcast if it has few rows."""
    return F.broadcast(table) if rows <= MOST_SHARDS else table


def number(value: float) -> int:
    """The first part of a sort key, as sort_key() has it."""
    return int(value * float(TOP)) << HASH_BITS


def sort_key(value: Column) -> Column:
    return F.shiftleft((value * float(TOP)).cast("long"), HASH_BITS).bitwiseOR(F.col("tie"))


def packs(weights: list[float], room: float, shards: int) -> bool:
    """Whether first fit, heaviest first, puts the weights into so many shards; what is over a shard takes one of its own."""
    free = [room] * shards
    for w in sorted(weights, reverse=True):
        at = next((i for i, f in enumerate(free) if w <= f or f == room), None)
        if at is None:
            return False
        free[at] -= w
    return True


def sides(heavy: list[dict], dim: str, room: float, left: int, right: int) -> int:
    """Sorts the heavy units of a node by side; returns how many of them go to the left one, which is to hold `left` shards."""
    heavy.sort(key=lambda u: (u[dim], u["tie"], u["group"], u["part"]))
    goal = sum(u["weight"] for u in heavy) * left / (left + right)
    cuts, at = [], 0.0
    for i in range(len(heavy) + 1):
        cuts.append((abs(at - goal), i))
        at += heavy[i]["weight"] if i < len(heavy) else 0
    for _, i in sorted(cuts)[:3]:
        if packs([u["weight"] for u in heavy[:i]], room, left) and packs([u["weight"] for u in heavy[i:]], room, right):
            return i
    free, dealt = [left * room, right * room], ([], [])
    for u in sorted(heavy, key=lambda u: -u["weight"]):
        side = int(free[1] / right > free[0] / left)
        free[side] -= u["weight"]
        dealt[side].append(u)
    heavy[:] = [*dealt[0], *dealt[1]]
    return len(dealt[0])


def quantiles(placed: DataFrame, work: dict[int, dict], dims: list[str], near: float) -> dict[int, int]:
    """For each node of work (dim, want, low, high): the largest key that goes to the left."""
    spark, splits = placed.sparkSession, {}
    while work:
        bins = max(64, min(2048, BINS // len(work)))
        rows = [(n, x["dim"], x["low"], x["high"], float(x["before"]), float(x["want"])) for n, x in work.items()]
        sought = small(spark.createDataFrame(rows, "node int, dim int, low long, high long, before double, want double"), len(rows))
        key = F.element_at(F.array(*[sort_key(F.col(d)) for d in dims]), F.col("dim") + 1)
        part = placed.join(sought, "node").withColumn("key", key).where("key between low and high")
        seen = part.groupBy("node", "before", "want", F.expr(f"(key - low) div ((high - low) div {bins} + 1)").alias("bin")).agg(F.sum("weight").alias("w"), F.min("key").alias("first"), F.max("key").alias("last"))
        up_to = F.sum("w").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
        row = F.struct("bin", "w", "up_to", "first", "last")
        # the bin in which the wanted weight is reached
        hits = seen.withColumn("up_to", up_to).groupBy("node").agg(F.coalesce(F.min(F.when(F.col("up_to") >= F.col("want"), row)), F.max(row)).alias("hit"))
        found = {r["node"]: r["hit"] for r in hits.collect()}
        for n, x in list(work.items()):
            if n not in found:  # no units
                splits[n] = x["low"]
                work.pop(n)
                continue
            hit = found[n]
            before = hit["up_to"] - hit["w"]
            below, above = x["want"] - before, hit["up_to"] - x["want"]
            if hit["first"] == hit["last"] or min(below, above) <= near:
                splits[n] = hit["first"] - 1 if below < above else hit["last"]
                work.pop(n)
            else:
                x["low"], x["high"], x["before"] = hit["first"], hit["last"], before
    return splits


def split_units(units: DataFrame, shards: int, dims: list[str], slack: float = 0.01, heavy_share: float = 0.25) -> DataFrame:
    """(group, part, node) of units (group, part, weight long, tie long, dims double); node is the shard.

    A node is named by its first shard. Each level is written to the shared folder.
    """
    spark = units.sparkSession
    total = units.agg(F.sum("weight")).first()[0] or 0
    room = total / shards
    heavy = [r.asDict() for r in units.where(F.col("weight") > heavy_share * room).collect()]  # at most shards / heavy_share rows
    by_node, done = {0: heavy}, []
    placed, level = units.where(F.col("weight") <= heavy_share * room).withColumn("node", F.lit(0)), {0: shards}
    while any(k > 1 for k in level.values()):
        spans = placed.groupBy("node").agg(F.sum("weight").alias("w"), *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims])
        spans = {r["node"]: r.asDict() for r in spans.collect()}
        work, below, weights = {}, {}, {}
        for n, k in level.items():
            ours = by_node.pop(n, [])
            if k == 1:
                done += [(u["group"], u["part"], n) for u in ours]
                continue
            x = spans.get(n)
            w = (x["w"] if x else 0) + sum(u["weight"] for u in ours)
            low = {d: min([*([x[f"lo_{d}"]] if x else []), *(u[d] for u in ours)], default=0.0) for d in dims}
            high = {d: max([*([x[f"hi_{d}"]] if x else []), *(u[d] for u in ours)], default=0.0) for d in dims}
            at = max(range(len(dims)), key=lambda i: (high[dims[i]] - low[dims[i]], -i))
            i = sides(ours, dims[at], max(w / k, 1.0), k // 2, k - k // 2)
            by_node[n], by_node[n + k // 2] = ours[:i], ours[i:]
            if x:
                want = min(max(w * (k // 2) / k - sum(u["weight"] for u in ours[:i]), 0), x["w"])
                work[n] = {"dim": at, "low": number(low[dims[at]]), "high": number(high[dims[at]]) + (1 << HASH_BITS) - 1, "before": 0, "want": want}
                below[n] = (at, n + k // 2)
        level = {c: m for n, k in level.items() for c, m in ([(n, k // 2), (n + k // 2, k - k // 2)] if k > 1 else [(n, k)])}
        if not work:
            continue
        splits = quantiles(placed, work, dims, slack * room / 10)
        table = small(spark.createDataFrame([(n, below[n][0], s, below[n][1]) for n, s in splits.items()], "node int, dim int, split long, right int"), len(splits))
        key = F.element_at(F.array(*[sort_key(F.col(d)) for d in dims]), F.col("dim") + 1)
        before = placed
        placed = placed.join(table, "node", "left").withColumn("node", F.when(key > F.col("split"), F.col("right")).otherwise(F.col("node"))).drop("dim", "split", "right")
        placed = materialize(placed, "level")
        if before is not units and len(level) > 2:
            discard(before)
    done += [(u["group"], u["part"], n) for n, ours in by_node.items() for u in ours]
    out = placed.select("group", "part", "node")
    return out.union(spark.createDataFrame(done, "group long, part int, node int")) if done else out


def kd_shards(docs: DataFrame, shards: int = 40, whole_share: float = 1.0, heavy_share: float = 0.25, slack: float = 0.01, dims: tuple[str, ...] = ("lang", "source"), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row of docs: doc_id, size long, text_crc32 long, shard int, slot long. Groups of up to `whole_share` of a shard stay whole."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        code(F.col(lang_col)).alias("lang"),
        code(F.col(source_col)).alias("source"),
    )
    rows = materialize(rows, "sizes", wide=True)
    spark = rows.sparkSession
    total = rows.agg(F.sum("size")).first()[0] or 0
    limit, piece = max(1.0, total / shards * whole_share), max(1.0, total / shards * heavy_share)
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.max("size").alias("one"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    groups = materialize(groups, "groups")
    large = materialize(groups.where(F.col("bytes") > limit).select("group", F.ceil(F.col("bytes") / F.lit(piece)).cast("int").alias("parts")), "large")  # fewer than shards / whole_share rows
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("parts")), F.lit(0)).cast("int")
    rows = rows.drop("lang", "source").join(small(large, int(shards / whole_share)), "group", "left").withColumn("part", part).drop("parts")
    spread = rows.join(small(large.select("group"), int(shards / whole_share)), "group").groupBy("group", "part").agg(F.sum("size").alias("weight"))
    units = groups.select("group", F.lit(0).alias("part"), F.col("bytes").alias("weight"), "one", "lang", "source").join(small(large.select("group"), int(shards / whole_share)), "group", "left_anti")
    units = units.union(spread.join(groups, "group").select("group", "part", "weight", "one", "lang", "source"))
    units = units.select("group", "part", "weight", F.least(F.lit(1.0), F.log2("one") / 40.0).alias("bytes_at"), "lang", "source", F.pmod(F.shiftrightunsigned(F.xxhash64("group", F.lit(0)), 64 - HASH_BITS) + F.col("part"), F.lit(TOP + 1)).alias("tie"))
    placed = split_units(materialize(units, "units"), shards, list(dims), slack, heavy_share).withColumnRenamed("node", "shard")
    out = materialize(rows.join(placed, ["group", "part"]).select("doc_id", "size", "text_crc32", "shard", "group"), "dealt")
    sizes = out.groupBy("shard").agg(F.count("*").alias("n")).collect()  # a row for each shard
    bins = small(spark.createDataFrame([(r["shard"], max(-(-r["n"] // BIN_ROWS), -(-2048 // shards))) for r in sizes] or [(0, 1)], "shard int, bins int"), shards)
    out = out.join(bins, "shard").withColumn("bin", F.pmod(F.xxhash64("doc_id", "group"), F.col("bins")).cast("int")).drop("bins")
    counts = out.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    base = counts.select("shard", "bin", (F.sum("n").over(Window.partitionBy("shard").orderBy("bin")) - F.col("n")).alias("base"))
    local = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("doc_id", "group")) - 1
    n_base = sum(max(-(-r["n"] // BIN_ROWS), -(-2048 // shards)) for r in sizes)
    return out.withColumn("at", local).join(small(base, n_base), ["shard", "bin"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("at")).cast("long").alias("slot"))
