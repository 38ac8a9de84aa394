"""Analytics over labelled samples: label and target reports, inspection, stratified samples, probes, evaluation."""

from __future__ import annotations

import json
import time
from array import array
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparloom.functions import turns as X
from sparloom.operators.labeling import generated
from sparloom.operators.quality import filtered
from sparloom.schema import CANONICAL


def known(column: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))


def label_report(samples: DataFrame) -> DataFrame:
    """(section, k1, k2, n, first_idx): rows, empty, sources, types; labels and their breakdowns by source and type.

    Two passes of grouping sets over rows and over labels. A label that stands twice in a row counts twice; a source without
    labels keeps an entry with k2 null and n 0. Order it by section, n descending and first_idx.
    """
    rows = samples.select("row_idx", known("source_dataset").alias("source"), known("sample_type").alias("kind"), "capabilities", "domains")
    empty = (F.coalesce(F.size("capabilities"), F.lit(0)) == 0) & (F.coalesce(F.size("domains"), F.lit(0)) == 0)
    by_row = rows.select("row_idx", "source", "kind", empty.cast("int").alias("empty"))
    by_row = by_row.groupingSets([[], ["source"], ["kind"]], "source", "kind").agg(F.count("row_idx").alias("n"), F.sum("empty").alias("empty"), F.min("row_idx").alias("first_idx"), F.grouping_id().alias("g"))
    head = F.when(F.col("g") == 3, F.array(F.struct(F.lit("rows").alias("section"), F.lit(None).cast("string").alias("k1"), F.col("n").alias("n")), F.struct(F.lit("empty").alias("section"), F.lit(None).cast("string").alias("k1"), F.coalesce("empty", F.lit(0)).cast("long").alias("n"))))
    part = F.array(F.struct(F.when(F.col("g") == 1, "sources").otherwise("sample_types").alias("section"), F.coalesce("source", "kind").alias("k1"), F.col("n").alias("n")))
    first = by_row.select(F.explode(F.coalesce(head, part)).alias("x"), "first_idx").select("x.section", "x.k1", F.lit(None).cast("string").alias("k2"), "x.n", "first_idx")
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("labels")) for a in ("capabilities", "domains")]))
    each = rows.select("row_idx", "source", "kind", axes.alias("x")).select("row_idx", "source", "kind", "x.axis", F.explode_outer("x.labels").alias("label"))
    sets = each.groupingSets([["axis", "label"], ["axis", "source", "label"], ["axis", "kind", "label"]], "axis", "source", "kind", "label").agg(F.count("label").alias("n"), F.min("row_idx").alias("first_idx"), F.grouping_id().alias("g"))
    by = F.when(F.col("g") == 6, F.col("axis")).when(F.col("g") == 2, F.concat_ws("_", "axis", F.lit("by_source"))).otherwise(F.concat_ws("_", "axis", F.lit("by_sample_type")))
    total = F.col("g") == 6
    second = sets.where(~total | F.col("label").isNotNull()).select(by.alias("section"), F.when(total, F.col("label")).otherwise(F.coalesce("source", "kind")).alias("k1"), F.when(~total, F.col("label")).alias("k2"), "n", "first_idx")
    # a source with labels has no use for its null entry
    keep = F.sum(F.when(F.col("k2").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("section", "k1"))
    second = second.withColumn("filled", keep).where(F.col("k2").isNotNull() | (F.col("filled") == 0) | ~F.col("section").contains("_by_")).drop("filled")
    return first.unionByName(second)


def empty_rate(report: DataFrame) -> DataFrame:
    """One row: the share of rows without a label, from a label report."""
    count = lambda s: F.sum(F.when(F.col("section") == s, F.col("n")))
    return report.where(F.col("section").isin("rows", "empty")).agg(F.round(F.coalesce(count("empty"), F.lit(0)) / F.greatest(F.coalesce(count("rows"), F.lit(0)), F.lit(1)), 4).alias("empty_rate"))


def label_examples(samples: DataFrame, k: int) -> DataFrame:
    """(axis, label, rank, id): the first k samples of each label in reading order."""
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.array_distinct(F.col(a)).alias("labels")) for a in ("capabilities", "domains")]))
    each = samples.select("row_idx", "id", axes.alias("x")).select("row_idx", "id", "x.axis", F.explode("x.labels").alias("label"))
    rank = F.row_number().over(Window.partitionBy("axis", "label").orderBy("row_idx"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("axis", "label", "rank", "id")


def load_targets(path: str | None = None, most: int | None = None) -> list[dict]:
    """Target rows; at most max_distillations, with different ids."""
    text = open(path, encoding="utf-8").read() if path else resources.files("sparloom").joinpath("data/targets.json").read_text("utf-8")
    value = json.loads(text)
    targets, most = value["targets"], most or int(value.get("max_distillations", 20))
    if len(targets) > most:
        raise ValueError(f"{len(targets)} targets; at most {most} are allowed")
    if len({t["id"] for t in targets}) < len(targets):
        raise ValueError("target ids must differ")
    return targets


TARGET = "target string, ord int, target_capabilities array<string>, target_domains array<string>"


def targets_frame(spark: SparkSession, targets: list[dict]) -> DataFrame:
    return spark.createDataFrame([(t["id"], i, t.get("target_capabilities") or [], t.get("target_domains") or []) for i, t in enumerate(targets)], TARGET)


def covered(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """Eligible samples with each target that they match; targets is a small table (its loader bounds it), hence broadcast."""
    all_caps = F.size(F.array_except("target_capabilities", "capabilities")) == 0
    any_domain = (F.size("target_domains") == 0) | F.arrays_overlap("target_domains", "domains")
    return samples.join(F.broadcast(targets), all_caps & any_domain)


def target_report(samples: DataFrame, targets: list[dict], min_quality: float = 0.45, min_target: int = 25, examples: int = 0, **limits) -> DataFrame:
    """(target, n, tokens, status, examples): each target in turn, those without a match as well."""
    table = targets_frame(samples.sparkSession, targets)
    met = covered(filtered(samples, min_quality, **limits).select("row_idx", "id", "tokens", "capabilities", "domains"), table)
    found = met.groupBy("target").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    if examples:  # a window that keeps a few rows of each target in every task, before anything is shuffled
        first = met.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("row_idx", "id"))).where(F.col("rank") <= examples)
        listed = first.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("x")).select("target", F.col("x.id").alias("examples"))
        found = found.join(F.broadcast(listed), "target", "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(n >= min_target, "ready").when(n > 0, "thin").otherwise("empty")
    out = table.join(F.broadcast(found), "target", "left").orderBy("ord")
    return out.select("target", n.alias("n"), F.coalesce("tokens", F.lit(0)).alias("tokens"), status.alias("status"), *(["examples"] if examples else []))


def target_histograms(samples: DataFrame, targets: list[dict], min_quality: float = 0.45, **limits) -> DataFrame:
    """(target, dim, key, n) by source and sample type."""
    rows = covered(filtered(samples, min_quality, **limits).select(known("source_dataset").alias("source"), known("sample_type").alias("kind"), "capabilities", "domains"), targets_frame(samples.sparkSession, targets))
    sets = rows.groupingSets([["target", "source"], ["target", "kind"]], "target", "source", "kind").agg(F.count("*").alias("n"))
    return sets.select("target", F.when(F.col("source").isNotNull(), "source").otherwise("sample_type").alias("dim"), F.coalesce("source", "kind").alias("key"), "n")


def inspect(samples: DataFrame, sample_id: str | None = None, label: str | None = None, axis: str = "domains", empty: bool = False, parse_errors: bool = False, limit: int = 5, max_chars: int = 4000) -> DataFrame:
    """The first matches of all given conditions in reading order, with their task text."""
    if axis not in ("capabilities", "domains"):
        raise ValueError(f"unknown axis: {axis}")
    if not (sample_id or label or empty or parse_errors):
        raise ValueError("inspection needs a condition")
    tests = []
    if sample_id:
        tests.append(F.col("id") == sample_id)
    if label:
        tests.append(F.array_contains(axis, label))
    if empty:
        tests.append((F.coalesce(F.size("capabilities"), F.lit(0)) == 0) & (F.coalesce(F.size("domains"), F.lit(0)) == 0))
    if parse_errors:
        tests.append(F.coalesce(F.array_contains(F.json_object_keys("metadata"), "llm_labeling_error"), F.lit(False)))
    rows = samples
    for t in tests:
        rows = rows.where(t)
    said = [F.get_json_object("metadata", f"$.{k}").alias(k) for k in ("capability_labeling", "domain_labeling", "label_guardrails", "llm_labeling_error", "original_id", "teacher_model")]
    return rows.orderBy("row_idx").limit(max(1, limit)).select("row_idx", "id", "source_dataset", "sample_type", "capabilities", "domains", "success", "quality_score", *said, X.task_text(F.col("messages"), max_chars).alias("text"))


def sample_group(group_by: str) -> Column:
    groups = {"none": F.lit("all"), "source_dataset": known("source_dataset"), "sample_type": known("sample_type"), "source_dataset+sample_type": F.concat_ws("::", known("source_dataset"), known("sample_type"))}
    if group_by not in groups:
        raise ValueError(f"unknown grouping: {group_by}")
    return groups[group_by]


def stratified_sample(samples: DataFrame, group_by: str = "source_dataset", per_group: int = 10, limit: int | None = None, seed: str = "sparloom-1") -> DataFrame:
    """samples with `grp`: of each group the first per_group (0: all) by a hash of seed and id, then the first `limit` of all.

    The order is that of hashes, not of a random generator: the same for every partitioning.
    """
    rows = samples.withColumns({"grp": sample_group(group_by), "draw": F.sha2(F.concat_ws("|", F.lit(seed), "id"), 256)})
    if per_group > 0:
        rank = F.row_number().over(Window.partitionBy("grp").orderBy("draw", "id"))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= per_group).drop("rank")
    if limit is not None:
        rows = rows.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.lit("all"), "id"), 256), "id").limit(limit)
    return rows.drop("draw")


def sample_summary(samples: DataFrame, chosen: DataFrame, group_by: str = "source_dataset") -> DataFrame:
    """(grp, seen, selected)."""
    seen = samples.groupBy(sample_group(group_by).alias("grp")).agg(F.count("*").alias("seen"))
    got = chosen.groupBy("grp").agg(F.count("*").alias("selected"))
    return seen.join(got, "grp", "left").select("grp", "seen", F.coalesce("selected", F.lit(0)).alias("selected"))


# --- probes ---


def load_probes(path: str | None = None) -> list[dict]:
    """Probe texts with the labels that they should get."""
    return json.loads(open(path, encoding="utf-8").read() if path else resources.files("sparloom").joinpath("data/probes.json").read_text("utf-8"))


def probes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Labelled single-turn samples whose metadata holds the expected labels."""
    rows = []
    for i, p in enumerate(load_probes(path)):
        meta = json.dumps({"expected_capabilities": p["capabilities"], "expected_domains": p["domains"]})
        rows.append((i, p["id"], "probes", "reasoning", [("user", "message", p["text"], False, None, None)], [], [], None, 1.0, meta))
    from pyspark.sql.types import LongType, StructField, StructType

    return spark.createDataFrame(rows, StructType([StructField("row_idx", LongType()), *CANONICAL.fields]))


def probe_compare(samples: DataFrame) -> DataFrame:
    """(id, axis, expected, predicted, hit, missing, extra, coverage, exact)."""
    each = []
    for axis in ("capabilities", "domains"):
        want = F.coalesce(F.from_json(F.get_json_object("metadata", f"$.expected_{axis}"), "array<string>"), F.array().cast("array<string>"))
        each.append(F.struct(F.lit(axis).alias("axis"), want.alias("expected"), F.col(axis).alias("predicted")))
    rows = samples.select("id", F.explode(F.array(*each)).alias("x")).select("id", "x.*")
    hit = F.array_sort(F.array_intersect("expected", "predicted"))
    rows = rows.withColumns({"hit": hit, "missing": F.array_sort(F.array_except("expected", "predicted")), "extra": F.array_sort(F.array_except("predicted", "expected"))})
    n = F.size(F.array_distinct("expected"))
    return rows.withColumns({"coverage": F.when(n > 0, F.round(F.size("hit") / n, 4)).otherwise(1.0), "exact": (F.size("missing") == 0) & (F.size("extra") == 0)})


def probe_report(compared: DataFrame) -> DataFrame:
    """One row: rows, strict_matches, strict_rate and the micro-averaged coverage of each axis."""
    rows = compared.groupBy("id").agg(F.min("exact").alias("exact"), *[F.sum(F.when(F.col("axis") == a, F.size(c))).alias(f"{a}_{c}") for a in ("capabilities", "domains") for c in ("hit", "expected")])
    share = lambda a: F.when(F.sum(f"{a}_expected") > 0, F.round(F.sum(f"{a}_hit") / F.sum(f"{a}_expected"), 4)).otherwise(1.0).alias(f"{a}_coverage")
    strict = F.count(F.when(F.col("exact"), 1))
    return rows.agg(F.count("*").alias("rows"), strict.alias("strict_matches"), F.round(strict / F.greatest(F.count("*"), F.lit(1)), 4).alias("strict_rate"), share("capabilities"), share("domains"))


# --- evaluation of generations ---


def score_generations(generations: DataFrame) -> DataFrame:
    """Rows (model_name, messages, generation, ...) with their metrics as columns."""
    rows = generations.withColumn("metrics", X.generation_metrics(F.col("messages"), F.col("generation")))
    return rows.select("*", "metrics.*").drop("metrics")


def generations(prompts: DataFrame, model_name: str, make_generator, concurrency: int = 1) -> DataFrame:
    """(model_name, sample_id, generation, latency_seconds, generated_tokens) of prompts (sample_id, prompt).

    The generator gives a text, or a pair of a text and its number of tokens; without a number there are none. An error of it
    fails the task.
    """

    def make():
        generate = make_generator()

        def timed(prompt: str) -> str:
            began = time.perf_counter()
            got = generate(prompt)
            text, n = got if isinstance(got, tuple) else (got, None)
            return json.dumps([text, time.perf_counter() - began, n])

        return timed

    made = generated(prompts, make, concurrency).select("sample_id", F.from_json("response", "array<variant>").alias("r"))
    part = lambda i, kind: F.variant_get(F.col("r")[i], "$", kind)
    return made.select(F.lit(model_name).alias("model_name"), "sample_id", part(0, "string").alias("generation"), part(1, "double").alias("latency_seconds"), part(2, "bigint").alias("generated_tokens"))


def summarize(scored: DataFrame) -> DataFrame:
    """Per model: count, rates (grounded over rows with an observation), mean latency and tokens."""
    rate = lambda c: F.avg(F.col(c).cast("int"))
    return scored.groupBy("model_name").agg(F.count("*").alias("count"), rate("valid_tool_call").alias("valid_tool_call_rate"), rate("patch_intent").alias("patch_intent_rate"), F.avg(F.when(F.col("observation_overlap").isNotNull(), F.col("observation_grounded").cast("int"))).alias("observation_grounded_rate"), F.avg("latency_seconds").alias("avg_latency_seconds"), F.avg("generated_tokens").alias("avg_generated_tokens"))


def summary_markdown(rows: list[dict]) -> str:
    show = lambda v, places: "n/a" if v is None else f"{v:.{places}f}"
    lines = ["| model | rows | tool calls | patches | grounded | seconds | tokens |", "| --- | ---: | ---: | ---: | ---: | ---: | ---: |"]
    for r in sorted(rows, key=lambda r: r["model_name"]):
        lines.append(f"| {r['model_name']} | {r['count']} | " + " | ".join(show(r[k], 3) for k in ("valid_tool_call_rate", "patch_intent_rate", "observation_grounded_rate", "avg_latency_seconds")) + f" | {show(r['avg_generated_tokens'], 1)} |")
    return "\n".join(lines) + "\n"


#: Ids that a task of loss_mask or padded gathers before it hands them on, beside those of one example or one batch.
HELD = 1 << 18


def id_lists(values, sizes: list[int]) -> pa.Array:
    """Lists of the given sizes, one after the other in values."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.asarray(values, np.int32)))


def loss_mask(samples: DataFrame, make_tokenizer, max_length: int = 8192, add_eos: bool = True) -> DataFrame:
    """(id, input_ids, labels, attention_mask): ids of the transcript, -100 where a segment is not trained on.

    make_tokenizer() gives a callable from text to ids, with eos_id or None as attribute; it is called once in each task. The end
    id is trained on only if the id before it is. Segments after max_length ids are not read. A task holds an Arrow batch of
    text, one example and HELD ids.
    """

    def run(batches):
        tokenizer = make_tokenizer()
        eos = getattr(tokenizer, "eos_id", None)

        def example(segs):
            a, b = array("i"), array("i")
            for s in segs:
                got = array("i", list(tokenizer(s["text"])))
                a += got
                b += got if s["trainable"] else array("i", [X.IGNORED]) * len(got)
                if len(a) >= max_length:
                    return a[:max_length], b[:max_length]
            if add_eos and eos is not None:
                a.append(eos)
                b.append(eos if b and b[-1] != X.IGNORED else X.IGNORED)
            return a[:max_length], b[:max_length]

        for part in batches:
            start, ids, labels, sizes = 0, array("i"), array("i"), []
            for i, segs in enumerate(part.column(1), 1):
                a, b = example(segs.as_py())
                ids += a
                labels += b
                sizes.append(len(a))
                if len(ids) >= HELD or i == part.num_rows:
                    columns = [part.column(0).slice(start, i - start), *(id_lists(x, sizes) for x in (ids, labels, np.ones(len(ids), np.int32)))]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "input_ids", "labels", "attention_mask"])
                    start, ids, labels, sizes = i, array("i"), array("i"), []

    return samples.select("id", X.segments(F.col("messages")).alias("segs")).mapInArrow(run, "id string, input_ids array<int>, labels array<int>, attention_mask array<int>")


def padded(examples: DataFrame, pad_id: int, batch: int) -> DataFrame:
    """Examples in batches of at most `batch` neighbours in the order of id, padded on the right to the longest of their batch.

    Each task fills batches from its own range of ids, so only the last batch of a range may be short. It holds an Arrow batch of
    examples, one padded batch and HELD ids.
    """
    fills = {"input_ids": pad_id, "labels": X.IGNORED, "attention_mask": 0}

    def run(parts):
        from pyspark import TaskContext

        number, waiting, made, held = TaskContext.get().partitionId() << 33, [], [], 0

        def fill():
            """Moves the waiting rows to made, as a batch; its size."""
            nonlocal number
            wide = max(len(x) for _, x, *_ in waiting)
            made.extend((name, number, [np.append(x, np.full(max(0, wide - len(x)), value, np.int32)) for x, value in zip(lists, fills.values(), strict=True)]) for name, *lists in waiting)
            n, number = (wide + 1) * len(waiting), number + 1
            waiting.clear()
            return n

        def out():
            columns = [[x[k] for _, _, x in made] for k in range(len(fills))]
            arrays = [pa.array([name for name, *_ in made], pa.string()), pa.array([n for _, n, _ in made], pa.int64()), *(id_lists(np.concatenate(c), [*map(len, c)]) for c in columns)]
            made.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["id", "batch", *fills])

        for part in parts:
            names = part.column(0).to_pylist()
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in part.columns[1:]]
            for i, name in enumerate(names):
                waiting.append((name, *(values[at[i] : at[i + 1]] for at, values in lists)))
                if len(waiting) >= batch:
                    held += fill()
                    if held >= HELD:
                        yield out()
                        held = 0
            waiting[:] = [(name, *(x.copy() for x in own)) for name, *own in waiting]  # a view would keep the whole Arrow batch
        if waiting:
            fill()
        if made:
            yield out()

    rows = examples.select("id", *fills).repartitionByRange("id").sortWithinPartitions("id")
    return rows.mapInArrow(run, "id string, batch long, input_ids array<int>, labels array<int>, attention_mask array<int>")
