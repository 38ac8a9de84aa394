"""Mixing sources to target weights (operator 4).

A document's size is its number of words between ASCII white space. Sizes are summed for each source; the sources share
`total` (the sum of all sizes unless given) by weight, and no target exceeds `most` (3) times its source's size: what is
above is shared again among the others by weight until none is above. A source's rate is its target over its size; each
of its documents is taken floor(rate) times, and once more if a hash of its doc_id and the seed, read as a number from 0 to
1, is below the fraction of the rate. A few large documents can draw a source far from its target, so the draws are made
for `SEEDS` seeds at once, and each source takes the first of those whose words come nearest. Equal inputs give equal
mixes, however rows are dealt to tasks.

Weights: sources in the order of their UTF-8 bytes (which is that of code points), null last, weigh `weights` in turn.

Only sums for each source are shuffled for the plan, and documents meet their source's rate in a join that may be split
by Spark for a hot source. The source table is numbered by ranges and shared out by sums, so it may be of any size.

Defined cases: a null text has size 0. A null source is a source. Sources of size 0 get target 0 and their documents no
copies; other documents of size 0 are copied at their source's rate. Rows with the same doc_id draw alike; a row with a
null doc_id draws by the MD5 of its text. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import WORD_RE, free_name, materialize

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
SEEDS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def numbered(keys: DataFrame, column: str) -> DataFrame:
    """keys with `rank` from 0 in ascending order of column, null last; each task numbers its range."""
    spark = keys.sparkSession
    order = F.col(column).asc_nulls_last()
    dealt = keys.repartitionByRange(order).sortWithinPartitions(order)
    local = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33).cast("int")).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)), "numbered", wide=True)
    counts = sorted((r["_part"], r["count"]) for r in local.groupBy("_part").count().collect())  # a row for each task
    base, before = [], 0
    for part, n in counts:
        base.append((part, before))
        before += n
    bases = spark.createDataFrame(base or [(-1, 0)], "_part int, _base long")
    return local.join(F.broadcast(bases), "_part").withColumn("rank", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def source_rates(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, total: float | None = None) -> DataFrame:
    """From (source, source_size): source, source_size, target double, rate double.

    Each round looks for the share of weight 1 from the sources that are not yet full; it only grows, so a source that is
    full stays full. It ends when no source fills up.
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = materialize(numbered(sizes, "source").withColumn("weight", turn), "sources")
    every = float(ranked.agg(F.sum("source_size")).first()[0] or 0) if total is None else float(total)
    limit = F.col("source_size") * F.lit(most)
    share, full = 0.0, -1
    while every:
        is_full = F.col("weight") * F.lit(share) >= limit
        held, n, free = ranked.agg(F.sum(F.when(is_full, F.col("source_size"))), F.count(F.when(is_full, 1)), F.sum(F.when(~is_full, F.col("weight")))).first()
        if n == full or not free:
            break
        full, share = n, (every - most * float(held or 0)) / free
    target = F.when(F.col("weight") * F.lit(share) >= limit, limit).otherwise(F.col("weight") * F.lit(share)).cast("double")
    rate = F.when(F.col("source_size") == 0, 0.0).when(F.col("weight") * F.lit(share) >= limit, F.lit(most)).otherwise(F.col("weight") * F.lit(share) / F.col("source_size"))
    return ranked.select("source", "source_size", target.alias("target"), rate.cast("double").alias("rate"))


def name_of(ident: Column, text: Column) -> Column:
    """What is hashed for a row: its id, or the MD5 of its text where that is null."""
    return F.coalesce(ident.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")))))


def drawn(name: Column, seed: int, pick: Column) -> Column:
    """A number from 0 to 1 (excluded) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), pick.cast("string"), name)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def picked(narrow: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """rates with `pick`: of the candidate seeds, the first whose words come nearest the source's target.

    narrow: (source, size, name) of all rows; the sums of all candidates are made in one pass, in each task first.
    """
    rows = narrow.where("size > 0").join(rates, narrow.source.eqNullSafe(rates.source)).select(rates.source, "size", "name", (F.col("rate") - F.floor("rate")).alias("part"))
    sums = rows.groupBy("source").agg(*[F.sum(F.when(drawn(F.col("name"), seed, F.lit(k)) < F.col("part"), F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(SEEDS)])
    near = rates.join(sums.withColumnRenamed("source", "_source"), rates.source.eqNullSafe(F.col("_source")), "left")
    miss = lambda k: F.abs(F.floor("rate") * F.col("source_size") + F.coalesce(f"s{k}", F.lit(0)) - F.col("target"))
    best = F.array_min(F.array(*[F.struct(miss(k).alias("miss"), F.lit(k).alias("k")) for k in range(SEEDS)]))["k"]
    return materialize(near.select("source", "source_size", "target", "rate", best.alias("pick")), "picks")


def mixing_plan(docs: DataFrame, seed: int = 42, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, total: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (doc_id if none are named) and size, source_size, target, rate, pick, copies of each row."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), name_of(F.col(id_col), F.col(text_col)).alias("name"))
    narrow = materialize(narrow, "narrow", wide=True)
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = picked(narrow, source_rates(materialize(sizes, "sizes"), weights, most, total), seed)
    rates = rates.select(*[F.col(c).alias(f"_{c}_of") for c in ("source", "source_size", "target", "rate", "pick")])
    source, size, name = (free_name(docs, x) for x in ("_source", "_size", "_name"))
    if keep is None:  # the plan alone needs no second look at the texts
        keep = [id_col]
        rows = narrow.toDF(id_col, source, size, name)
    else:
        rows = docs.select(*keep, F.col(source_col).alias(source), word_count(F.col(text_col)).alias(size), name_of(F.col(id_col), F.col(text_col)).alias(name))
    out = rows.join(rates, F.col(source).cast("string").eqNullSafe(F.col("_source_of")))
    whole = F.floor("_rate_of")
    copies = (whole + (drawn(F.col(name), seed, F.col("_pick_of")) < F.col("_rate_of") - whole).cast("int")).cast("int")
    return out.select(*keep, F.col(size).alias("size"), F.col("_source_size_of").alias("source_size"), F.col("_target_of").alias("target"), F.col("_rate_of").alias("rate"), F.col("_pick_of").alias("pick"), copies.alias("copies"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as its plan takes it, columns as they were."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = {k: names[options.pop(k, d)] for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    plan = mixing_plan(docs.toDF(*names.values()), keep=list(names.values()), **own, **options)
    return plan.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(v).alias(k) for k, v in names.items()])
