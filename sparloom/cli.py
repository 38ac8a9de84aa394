"""Command line: one sub-command for each pipeline step, over JSON lines."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.functions import turns as X
from sparloom.functions.labels import Guardrails, Taxonomy
from sparloom.operators import labeling, reports, subsets
from sparloom.operators.quality import filtered, scored
from sparloom.session import session
from sparloom.sources.io import limit_rows, load_config, read_jsonl, read_lines, resolve_source, shard_rows, union_sources, write_jsonl, write_report, write_shards
from sparloom.streaming.ingest import conversion_stats, converted, error_examples, failing

SAMPLE = ["id", "source_dataset", "sample_type", "messages", "capabilities", "domains", "success", "quality_score", "metadata"]


def taxonomies(a) -> tuple[Taxonomy, Taxonomy]:
    return Taxonomy.load(a.taxonomy, "capabilities"), Taxonomy.load(a.domain_taxonomy, "domains")


def shown(rows: DataFrame) -> list[dict]:
    """Rows of a small report."""
    return [r.asDict(recursive=True) for r in rows.collect()]


def read_samples(spark: SparkSession, path) -> DataFrame:
    """Samples that are valid; the first that is not fails the job, named by path and line."""
    return read_jsonl(spark, path, validate=True)


def convert(spark: SparkSession, a) -> dict:
    """Parse raw lines and score them; --stream also filters, and --skip-errors leaves bad rows out."""
    source = resolve_source(a.source, path=a.input, parser=a.parser)
    raw = limit_rows(shard_rows(read_lines(spark, a.input), a.num_shards, a.shard_index), a.max_rows)
    rows = converted(raw, source.parser, source.label, a.min_quality if a.stream else 0.0, *taxonomies(a), min_tokens=a.min_tokens, max_tokens=a.max_tokens, require_success=a.require_success)
    if not a.skip_errors:
        rows = failing(rows)
    rows = rows.persist()
    kept = rows.where("written") if a.stream else rows.where("error is null")
    made = {"shards": write_shards(kept.select("row_idx", *SAMPLE), a.output, a.shard_size)} if a.stream else {"rows": write_jsonl(kept.select(*SAMPLE), a.output)}
    return made | {r["metric"]: r["value"] for r in conversion_stats(rows).collect()} | {"error_examples": shown(error_examples(rows))}


def filter_rows(spark: SparkSession, a) -> dict:
    kept = filtered(read_samples(spark, a.input), min_tokens=a.min_tokens, max_tokens=a.max_tokens, max_repetition=a.max_repetition, require_success=a.require_success)
    return {"written": write_jsonl(kept.select(*SAMPLE), a.output)}


def build(spark: SparkSession, a) -> dict:
    caps, doms, prefix = a.capability or [], a.domain or [], None
    if a.target_id:
        target = next((t for t in reports.load_targets(a.targets) if t["id"] == a.target_id), None)
        if target is None:
            raise ValueError(f"unknown target: {a.target_id}")
        caps, doms, prefix = target["target_capabilities"], target["target_domains"], target["id"]
    elif not caps and not doms:
        caps = ["DEBUGGING"]
    got = subsets.build_subsets(union_sources(spark, a.input), caps, doms, a.max_train_tokens, a.target_ratio, a.eval_fraction, a.eval_max_samples, a.min_quality, a.eval_type or [], a.eval_required or [], a.eval_excluded or [], a.seed, prefix, min_tokens=a.min_tokens, max_tokens=a.max_tokens)
    name = got.manifest["output_prefix"]
    sets = {f"{name}.train": got.specialist, f"general_agentic_mix.{name}.train": got.general, f"{name}.eval": got.evaluation}
    paths = {k: f"{a.output}/{k}.jsonl" for k in sets}
    got.manifest |= {"inputs": list(a.input), "paths": paths, "written": {k: write_jsonl(rows.select(*SAMPLE), paths[k]) for k, rows in sets.items()}}
    got.release()
    write_report(got.manifest, f"{a.output}/{name}.manifest.json")
    return got.manifest


def masked_examples(spark: SparkSession, a) -> dict:
    """Loss-masked examples for a trainer; training itself is outside of this library."""
    config = load_config(a.config)

    def make():
        from tokenizers import Tokenizer

        known = Tokenizer.from_file(config["tokenizer"])

        class Ids:
            eos_id = config.get("eos_id")

            def __call__(self, text):
                return known.encode(text, add_special_tokens=False).ids

        return Ids()

    reports.loss_mask(read_jsonl(spark, config["train"]), make, config.get("max_length", 8192)).write.mode("overwrite").parquet(config["output"])
    return {"examples": spark.read.parquet(config["output"]).count()}


def evaluate(spark: SparkSession, a) -> dict:
    """Generate with each model of the config, or take generations from JSON lines, and score them.

    models: {name: {"generator": "module:function"} or {"url": server, "model": name, "max_tokens": n}}; generations: a file of
    (model_name, sample_id, generation, latency_seconds, generated_tokens).
    """
    config = load_config(a.config)
    samples = limit_rows(read_jsonl(spark, config["samples"]), config.get("limit")).select(F.col("id").alias("sample_id"), "messages", X.eval_prompt(F.col("messages"), config.get("prompt_mode", "initial")).alias("prompt"))
    if not samples.limit(1).count():
        raise ValueError(f"{config['samples']} holds no samples")
    if "models" in config:
        made = None
        for name, m in config["models"].items():
            make = labeling.generator_for(named_callable(m["generator"]) if "generator" in m else None, m.get("url"), model=m.get("model", name), max_tokens=m.get("max_tokens", 512))
            part = reports.generations(samples.select("sample_id", "prompt"), name, make, config.get("concurrency", 1))
            made = part if made is None else made.unionByName(part)
        made.write.mode("overwrite").json(f"{config['output']}/generations")
    folder = f"{config['output']}/generations" if "models" in config else config["generations"]
    made = spark.read.schema("model_name string, sample_id string, generation string, latency_seconds double, generated_tokens long").json(folder)
    rows = reports.score_generations(made.join(samples, "sample_id"))
    summary = shown(reports.summarize(rows))
    write_report({r["model_name"]: r for r in summary}, f"{config['output']}/summary.json")
    Path(config["output"], "summary.md").write_text(reports.summary_markdown(summary), encoding="utf-8")
    rows.drop("messages").write.mode("overwrite").json(f"{config['output']}/rows")
    return {r["model_name"]: r for r in summary}


def relabelled(spark: SparkSession, a) -> dict:
    rows = labeling.relabel(read_samples(spark, a.input), *taxonomies(a), a.min_score, a.max_chars).persist()
    write_jsonl(rows.select(*SAMPLE), a.output)
    return {"counts": shown(labeling.label_counts(rows))}


def named_callable(name: str):
    """What module:function names."""
    import importlib

    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def llm_labelled(spark: SparkSession, a) -> dict:
    caps, doms = taxonomies(a)
    schema = labeling.response_schema(caps, doms, a.max_capabilities, a.max_domains) if a.structured_output else None
    own = named_callable(a.generator) if a.generator else None
    make = labeling.generator_for(own, a.base_url, labeling.stub_generator if a.stub else None, model=a.model, max_tokens=a.max_new_tokens, timeout=a.timeout, key=a.api_key, schema=schema, parts=a.content_parts)
    rules = None if a.no_guardrails else Guardrails.load(a.guardrails)
    samples = limit_rows(read_samples(spark, a.input), a.limit)
    rows = labeling.llm_label(samples, make, caps, doms, concurrency=a.concurrency, max_chars=a.max_chars, max_capabilities=a.max_capabilities, max_domains=a.max_domains, rules=rules, model=a.model).persist()
    write_jsonl(rows.select(*SAMPLE), a.output)
    empty = rows.where((F.size("capabilities") == 0) & (F.size("domains") == 0)).count()
    return {"written": rows.count(), "empty": empty, "parse_errors": rows.where("payload.error is not null").count(), "counts": shown(labeling.label_counts(rows))}


def model_labelled(spark: SparkSession, a) -> dict:
    """A scorer is named as module:function, which makes a callable (texts, candidates, hypothesis) -> scores."""
    make = named_callable(a.scorer)
    rows = labeling.model_label(limit_rows(read_samples(spark, a.input), a.limit), make, *taxonomies(a), batch=a.batch, model=a.scorer).persist()
    write_jsonl(rows.select(*SAMPLE), a.output)
    return {"written": rows.count(), "counts": shown(labeling.label_counts(rows))}


def report_labels(spark: SparkSession, a) -> dict:
    samples = read_jsonl(spark, a.input)
    ordered = reports.label_report(samples).orderBy("section", F.col("n").desc(), "first_idx")
    out = {"report": shown(ordered.drop("first_idx")), **shown(reports.empty_rate(ordered))[0]}
    if a.top_examples:
        out["examples"] = shown(reports.label_examples(samples, a.top_examples))
    if a.output:
        write_report(out, a.output)
    return out


def report_targets(spark: SparkSession, a) -> dict:
    out = {"targets": shown(reports.target_report(read_jsonl(spark, a.input), reports.load_targets(a.targets), a.min_quality, a.min_target_samples, a.top_examples, min_tokens=a.min_tokens, max_tokens=a.max_tokens))}
    if a.output:
        write_report(out, a.output)
    return out


def inspect_rows(spark: SparkSession, a) -> dict:
    rows = shown(reports.inspect(read_jsonl(spark, a.input), a.id, a.label, a.axis, a.empty, a.parse_errors, a.limit, a.max_chars))
    return {"count": len(rows), "samples": rows}


def sample_rows(spark: SparkSession, a) -> dict:
    samples = read_jsonl(spark, a.input)
    chosen = reports.stratified_sample(samples, a.group_by, a.max_per_group, a.limit, a.seed).persist()
    write_jsonl(chosen.select(*SAMPLE), a.output)
    return {"groups": shown(reports.sample_summary(samples, chosen, a.group_by))}


def write_probes(spark: SparkSession, a) -> dict:
    write_jsonl(reports.probes(spark, a.probes).select(*SAMPLE), a.output)
    return {"written": spark.read.text(a.output).count()}


def report_probes(spark: SparkSession, a) -> dict:
    compared = reports.probe_compare(read_jsonl(spark, a.input)).persist()
    out = shown(reports.probe_report(compared))[0] | {"probes": shown(compared)}
    if a.output:
        write_report(out, a.output)
    return out


def export_classifier(spark: SparkSession, a) -> dict:
    labeling.classifier_rows(read_samples(spark, a.input), *taxonomies(a), a.min_score, a.max_chars, a.include_unlabeled).write.mode("overwrite").json(a.output)
    return {"written": spark.read.text(a.output).count()}


def export_prompts(spark: SparkSession, a) -> dict:
    caps, doms = taxonomies(a)
    shots = labeling.icl_examples(read_jsonl(spark, a.examples), caps, doms, a.max_examples_per_label, a.max_chars, a.allow_weak_examples) if a.examples else []
    labeling.prompt_rows(read_jsonl(spark, a.input), caps, doms, shots, a.max_chars).write.mode("overwrite").json(a.output)
    return {"written": spark.read.text(a.output).count(), "examples": len(shots)}


def taxonomy_docs(spark, a) -> dict:
    axis = "domains" if "domains" in json.loads(Path(a.taxonomy).read_text("utf-8")) else "capabilities"
    Path(a.output).write_text(Taxonomy.load(a.taxonomy, axis).markdown(), encoding="utf-8")
    return {"output": a.output}


def list_targets(spark, a) -> dict:
    return {"targets": reports.load_targets(a.targets, a.max_targets)}


def rescore(spark: SparkSession, a) -> dict:
    write_jsonl(scored(read_samples(spark, a.input)).select(*SAMPLE), a.output)
    return {"written": spark.read.text(a.output).count()}


LIMITS = [("--min-tokens", {"type": int, "default": 64}), ("--max-tokens", {"type": int, "default": 32768}), ("--require-success", {"action": "store_true"})]
TAXONOMY = [("--taxonomy", {}), ("--domain-taxonomy", {})]
IO = [("input", {}), ("output", {})]
LANDED = [*IO, ("--source", {"default": "trove"}), ("--parser", {}), ("--min-quality", {"type": float, "default": 0.0}), ("--skip-errors", {"action": "store_true"}), ("--max-rows", {"type": int}), ("--num-shards", {"type": int, "default": 1}), ("--shard-index", {"type": int, "default": 0}), ("--shard-size", {"type": int, "default": 50_000}), *LIMITS, *TAXONOMY]
COMMANDS = {
    "convert": (convert, LANDED, {"stream": False}),
    "stream-convert": (convert, LANDED, {"stream": True}),
    "filter": (filter_rows, [*IO, ("--max-repetition", {"type": float, "default": 0.2}), *LIMITS], {}),
    "build-subsets": (build, [("input", {"nargs": "+"}), ("output", {}), ("--target-id", {}), ("--targets", {}), ("--capability", {"action": "append"}), ("--domain", {"action": "append"}), ("--max-train-tokens", {"type": int, "default": 2_000_000}), ("--target-ratio", {"type": float, "default": 0.8}), ("--eval-fraction", {"type": float, "default": 0.1}), ("--eval-max-samples", {"type": int, "default": 200}), ("--min-quality", {"type": float, "default": 0.45}), ("--eval-type", {"action": "append"}), ("--eval-required", {"action": "append"}), ("--eval-excluded", {"action": "append"}), ("--seed", {"default": "sparloom-1"}), *LIMITS], {}),
    "train-sft": (masked_examples, [("config", {})], {}),
    "eval": (evaluate, [("config", {})], {}),
    "relabel-capabilities": (relabelled, [*IO, *TAXONOMY, ("--min-score", {"type": float, "default": 0.65}), ("--max-chars", {"type": int, "default": 24000})], {}),
    "model-label": (model_labelled, [*IO, ("--scorer", {"required": True}), *TAXONOMY, ("--limit", {"type": int}), ("--batch", {"type": int, "default": 16})], {}),
    "llm-label": (llm_labelled, [*IO, *TAXONOMY, ("--base-url", {}), ("--model", {"default": "model"}), ("--api-key", {}), ("--timeout", {"type": float, "default": 120}), ("--max-new-tokens", {"type": int, "default": 384}), ("--max-chars", {"type": int, "default": 12000}), ("--max-capabilities", {"type": int, "default": 4}), ("--max-domains", {"type": int, "default": 2}), ("--concurrency", {"type": int, "default": 1}), ("--guardrails", {}), ("--no-guardrails", {"action": "store_true"}), ("--generator", {}), ("--stub", {"action": "store_true"}), ("--structured-output", {"action": "store_true"}), ("--content-parts", {"action": "store_true"}), ("--limit", {"type": int})], {}),
    "label-report": (report_labels, [("input", {}), ("--output", {}), ("--top-examples", {"type": int, "default": 0})], {}),
    "target-report": (report_targets, [("input", {}), ("--output", {}), ("--targets", {}), ("--min-quality", {"type": float, "default": 0.45}), ("--min-target-samples", {"type": int, "default": 25}), ("--top-examples", {"type": int, "default": 0}), *LIMITS], {}),
    "inspect-sample": (inspect_rows, [("input", {}), ("--id", {}), ("--label", {}), ("--axis", {"default": "domains"}), ("--empty", {"action": "store_true"}), ("--parse-errors", {"action": "store_true"}), ("--limit", {"type": int, "default": 5}), ("--max-chars", {"type": int, "default": 4000})], {}),
    "sample-jsonl": (sample_rows, [*IO, ("--group-by", {"default": "source_dataset"}), ("--max-per-group", {"type": int, "default": 10}), ("--limit", {"type": int}), ("--seed", {"default": "sparloom-1"})], {}),
    "write-labeling-probes": (write_probes, [("output", {}), ("--probes", {})], {}),
    "probe-report": (report_probes, [("input", {}), ("--output", {})], {}),
    "export-classifier-data": (export_classifier, [*IO, *TAXONOMY, ("--min-score", {"type": float, "default": 0.65}), ("--max-chars", {"type": int, "default": 24000}), ("--include-unlabeled", {"action": "store_true"})], {}),
    "export-labeling-prompts": (export_prompts, [*IO, *TAXONOMY, ("--examples", {}), ("--max-examples-per-label", {"type": int, "default": 2}), ("--max-chars", {"type": int, "default": 12000}), ("--allow-weak-examples", {"action": "store_true"})], {}),
    "taxonomy-docs": (taxonomy_docs, [("taxonomy", {}), ("output", {})], {}),
    "list-specialist-targets": (list_targets, [("--targets", {}), ("--max-targets", {"type": int})], {}),
    "score": (rescore, IO, {}),
}
WITHOUT_SPARK = (taxonomy_docs, list_targets)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparloom")
    commands = top.add_subparsers(dest="command", required=True)
    for name, (run, arguments, fixed) in COMMANDS.items():
        sub = commands.add_parser(name, help=(run.__doc__ or "").strip().split("\n")[0])
        for flag, options in arguments:
            sub.add_argument(flag, **options)
        sub.set_defaults(run=run, **fixed)
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = None if a.run in WITHOUT_SPARK else session(spark__ui__enabled="false")
    print(json.dumps(a.run(spark, a), indent=2, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
