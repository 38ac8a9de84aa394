"""Matched training subsets under token budgets, without leaks from evaluation groups."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.functions import turns as X
from sparloom.operators.quality import filtered, matches_eval, matches_target


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def unit_score(text: Column) -> Column:
    """A number from 0 to 1 from the first 64 bits of a SHA-256."""
    return F.conv(F.left(F.sha2(text, 256), F.lit(16)), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def group_key() -> Column:
    """source, repository and original id of a sample; without an id, a hash of what the user first says."""
    meta = lambda k: F.nullif(F.get_json_object("metadata", f"$.{k}"), F.lit(""))
    first = F.try_element_at(F.filter("messages", lambda m: m["role"] == "user"), F.lit(1))["content"]
    said = F.coalesce(first, F.left(X.joined_text(F.col("messages")), F.lit(1000)))
    return F.concat_ws("|", "source_dataset", F.coalesce(meta("repo"), meta("repository"), F.lit("")), F.coalesce(meta("original_id"), meta("task_id"), F.left(F.sha2(said, 256), F.lit(16))))


def order_key(seed: str) -> Column:
    return F.concat_ws("|", digest(F.lit(seed), F.col("group_key"), F.col("id")), "id")


@dataclass
class Selection:
    """Rows taken by a budget: whole stretches of the order, and the keys of single rows.

    stretches: (after, before, largest tokens), bounds exclusive, None: open; a handful, as each takes a pass to find. keys: at
    most FOLD.
    """

    stretches: list[tuple[str | None, str | None, int]] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    tokens: int = 0

    def of(self, rows: DataFrame, key: str = "key", tokens: str = "tokens") -> DataFrame:
        """The rows that are taken."""
        tests = []
        for after, before, most in self.stretches:
            part = F.col(tokens) <= most
            if after is not None:
                part = part & (F.col(key) > after)
            if before is not None:
                part = part & (F.col(key) < before)
            tests.append(part)
        inside = any_of(tests)
        if not self.keys:
            return rows.where(inside)
        single = rows.sparkSession.createDataFrame([(k,) for k in self.keys], "_single string")
        return rows.join(F.broadcast(single), F.col(key) == F.col("_single"), "left").where(inside | F.col("_single").isNotNull()).drop("_single")


def any_of(tests: list[Column]) -> Column:
    """Their disjunction, as a tree without a long branch."""
    if not tests:
        return F.lit(False)
    while len(tests) > 1:
        tests = [tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return tests[0]


FOLD = 50_000  # rows (key, tokens) that the driver walks at once


def select_by_budget(pool: DataFrame, budget: int) -> Selection:
    """Greedy first fit over pool (key string, tokens) in the order of key: a row is taken if it still fits, the first one anyway.

    Rows are taken in stretches: from the place reached, rows that fit the rest are summed until one does not; after it only
    rows that fit the smaller rest count. The row where a stretch ends is found by sums over the leading digits of the key, so
    the driver sees 256 sums a step, and walks rows itself only when few are left. Keys must differ.
    """
    out, after = Selection(), None
    if budget <= 0:
        return out
    first = pool.orderBy("key").limit(1).collect()
    if not first:
        return out
    out.tokens, after = int(first[0]["tokens"]), first[0]["key"]
    out.keys.append(after)
    while out.tokens < budget:
        rest = budget - out.tokens
        left = pool.where((F.col("key") > after) & (F.col("tokens") <= rest))
        prefix, taken, n = "", 0, None
        while True:
            part = left.where(F.startswith(F.col("key"), F.lit(prefix))) if prefix else left
            sums = sorted(part.groupBy(F.substr("key", F.lit(len(prefix) + 1), F.lit(2)).alias("p")).agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect())
            n = sum(r["n"] for r in sums) if n is None else n
            over = next((r for r in sums if (taken := taken + r["t"]) > rest), None)
            if over is None:
                break
            taken -= over["t"]
            prefix += over["p"]
            if over["n"] <= FOLD or not over["p"]:
                break
        if over is None:  # all that is left fits
            out.stretches.append((after, None, rest))
            out.tokens += taken
            break
        if n <= FOLD:  # the rest is small: walk it
            for r in left.orderBy("key").collect():
                if r["tokens"] <= budget - out.tokens:
                    out.keys.append(r["key"])
                    out.tokens += r["tokens"]
            break
        for r in left.where(F.startswith(F.col("key"), F.lit(prefix))).orderBy("key").collect():
            if taken + r["tokens"] > rest:
                out.stretches.append((after, r["key"], rest))
                after, out.tokens = r["key"], out.tokens + taken
                break
            taken += r["tokens"]
    return out


@dataclass
class Subsets:
    specialist: DataFrame
    general: DataFrame
    evaluation: DataFrame
    manifest: dict
    base: DataFrame

    def release(self) -> None:
        """Frees what is kept of the filtered samples, once the sets are written."""
        self.base.unpersist()


def default_prefix(capabilities: list[str], domains: list[str]) -> str:
    if capabilities == ["DEBUGGING"] and not domains:
        return "debugging"
    return "_".join(x.lower().replace("/", "_").replace(" ", "_") for x in [*domains, *capabilities]) or "general_agent"


def build_subsets(samples: DataFrame, capabilities: list[str] = (), domains: list[str] = (), max_train_tokens: int = 2_000_000, target_ratio: float = 0.8, eval_fraction: float = 0.1, eval_most: int = 200, min_quality: float = 0.45, eval_types: list[str] = (), eval_required: list[str] = (), eval_excluded: list[str] = (), seed: str = "sparloom-1", prefix: str | None = None, **limits) -> Subsets:
    """Specialist, matched general and evaluation sets.

    Evaluation: target samples that pass the evaluation filters, in groups whose hash is under eval_fraction, the first eval_most by
    hash (at least one if there is a candidate). Training: what is in no group of an evaluation sample that was kept; the
    specialist takes its share of target samples and the rest of others, the general set as many tokens from all of them.
    """
    if not 0 < target_ratio <= 1:
        raise ValueError("target_ratio must be in (0, 1]")
    if not 0 < eval_fraction < 1:
        raise ValueError("eval_fraction must be in (0, 1)")
    capabilities, domains = list(capabilities), list(domains)
    base = filtered(samples, min_quality, **limits).withColumn("group_key", group_key()).withColumn("is_target", matches_target(capabilities, domains))
    base = base.persist()
    candidates = base.where("is_target").where(matches_eval(list(eval_types), list(eval_required), list(eval_excluded)))
    in_split = unit_score(F.concat(F.lit(f"{seed}|eval|"), F.col("group_key"))) < eval_fraction
    ids = lambda df, s, n: [r["id"] for r in df.orderBy(order_key(s)).limit(n).select("id").collect()]
    chosen = ids(candidates.where(in_split), f"{seed}|eval", max(0, eval_most)) or (ids(candidates, f"{seed}|eval-fallback", 1) if eval_most > 0 else [])
    # at most eval_most ids and groups
    evaluation = candidates.where(F.col("id").isin(chosen))
    train = base.join(F.broadcast(evaluation.select("group_key").distinct()), "group_key", "left_anti")

    def take(df: DataFrame, budget: int, s: str) -> tuple[DataFrame, int]:
        keyed = df.withColumn("_order", order_key(s))
        got = select_by_budget(keyed.select(F.col("_order").alias("key"), "tokens"), budget)
        return got.of(keyed, "_order").drop("_order"), got.tokens

    target_budget = int(max_train_tokens * target_ratio)
    aim, aim_tokens = take(train.where("is_target"), target_budget, f"{seed}|specialist-target")
    anchor, anchor_tokens = take(train.where("not is_target"), max_train_tokens - target_budget, f"{seed}|specialist-anchor")
    general, general_tokens = take(train, aim_tokens + anchor_tokens, f"{seed}|general")
    name = prefix or default_prefix(capabilities, domains)
    rows = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
    specialist, held = aim.unionByName(anchor), rows(evaluation)
    manifest = {
        "output_prefix": name,
        "seed": seed,
        "target_capabilities": capabilities,
        "target_domains": domains,
        "counts": {"specialist_train": rows(specialist)["n"], "general_train": rows(general)["n"], "target_eval": held["n"]},
        "tokens": {"specialist_train": aim_tokens + anchor_tokens, "general_train": general_tokens, "target_eval": held["t"]},
        "selection": {"max_train_tokens": max_train_tokens, "target_ratio": target_ratio, "eval_fraction": eval_fraction, "eval_most": eval_most, "min_quality": min_quality, **limits, "eval_types": list(eval_types), "eval_required": list(eval_required), "eval_excluded": list(eval_excluded), "eval_candidates": candidates.count()},
    }
    return Subsets(specialist, general, evaluation, manifest, base)
