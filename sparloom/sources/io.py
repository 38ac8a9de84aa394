"""JSON lines in and out, source registry, shards and limits."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, replace
from itertools import accumulate
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparloom.schema import CANONICAL, sample_errors, to_json_lines, type_errors, with_defaults


@dataclass(frozen=True)
class Source:
    """Where raw rows come from, and how they are parsed. `label` is the source_dataset of its samples."""

    path: str
    parser: str
    label: str
    split: str = "train"
    config: str | None = None


SOURCES: dict[str, Source] = {
    "trove": Source("landing/trove", "agenttrove", "trove"),
    "hermes-a": Source("landing/hermes-a", "hermes", "hermes-a"),
    "hermes-b": Source("landing/hermes-b", "hermes", "hermes-b"),
}
PARSERS = ("agenttrove", "hermes")


def resolve_source(name: str | None = None, *, path: str | None = None, parser: str | None = None, split: str | None = None, config: str | None = None) -> Source:
    """A registered source with overrides, or one of its own from path and parser; the label stays that of the base."""
    if parser and parser not in PARSERS:
        raise ValueError(f"unknown parser: {parser}")
    if name in SOURCES:
        given = {"path": path, "parser": parser, "split": split, "config": config}
        return replace(SOURCES[name], **{k: v for k, v in given.items() if v})
    if not path or not parser:
        raise ValueError(f"unknown source: {name}; give a path and a parser")
    return Source(path, parser, name or path, split or "train", config)


def read_lines(spark: SparkSession, paths: str | list[str], where: bool = False) -> DataFrame:
    """(row_idx, value) of the non-blank lines, files in the order of their paths; with where, also `place` (path:line from 1).

    Numbers grow in reading order without gaps between files of one read; counting is by file and place, in two steps, so no
    task sees more than its part of a file.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.text(paths).select("value", (F.trim("value") != "").cast("int").alias("full"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    part = Window.partitionBy("file", "block").orderBy("at")
    local = lines.withColumns({"line": F.row_number().over(part), "n": F.sum("full").over(part) - 1})
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("lines"), F.sum("full").alias("count"))
    bases = counts.select(  # a row for each file block
        "file",
        "block",
        (F.sum("count").over(Window.orderBy("file", "block")) - F.col("count")).alias("base"),
        (F.sum("lines").over(Window.partitionBy("file").orderBy("block")) - F.col("lines")).alias("above"),
    )
    out = local.join(bases, ["file", "block"]).where("full = 1")
    place = [F.concat_ws(":", F.regexp_replace("file", "^file:/+", "/"), F.col("above") + F.col("line")).alias("place")] if where else []
    return out.select((F.col("base") + F.col("n")).cast("long").alias("row_idx"), "value", *place)


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: StructType = CANONICAL, validate: bool = False) -> DataFrame:
    """Canonical rows with row_idx; a line that is no JSON object fails the job and is named as path:line.

    With validate, so does a line with a field of another type or an invalid sample, with the codes of what is wrong.
    """
    rows = read_lines(spark, paths, True)
    shown = F.concat("place", F.lit(" is no JSON object: "), F.left("value", F.lit(80)))
    flat = StructType([f for f in schema.fields if f.name != "metadata"])
    value = F.when(F.json_object_keys("value").isNull(), F.raise_error(shown).cast("string"))
    if validate:
        wrong = F.concat("place", F.lit(": "), F.array_join("types", ","))
        rows = rows.withColumn("types", type_errors(F.col("value")))
        value = value.when(F.size("types") > 0, F.raise_error(wrong).cast("string"))
    parsed = rows.select("row_idx", "place", value.otherwise(F.col("value")).alias("value"))
    out = parsed.select("row_idx", F.from_json("value", flat).alias("s"), F.coalesce(F.get_json_object("value", "$.metadata"), F.lit("{}")).alias("metadata"), "place").select("row_idx", "s.*", "metadata", "place")
    if validate:
        filled = with_defaults(out).withColumn("errors", sample_errors())
        bad = F.concat("place", F.lit(": "), F.array_join("errors", ","))
        out = filled.withColumn("id", F.when(F.size("errors") > 0, F.raise_error(bad).cast("string")).otherwise(F.col("id"))).drop("errors")
    return out.drop("place")


def union_sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """UNION ALL of files in the order of the arguments: row_idx counts on from one to the next."""
    out, before = None, 0
    for p in paths:
        part = read_jsonl(spark, p).withColumn("row_idx", F.col("row_idx") + before)
        before += part.count()
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths")
    return out


def write_jsonl(samples: DataFrame, path: str) -> int:
    """The rows that were written, counted as they pass."""
    seen = Observation()
    to_json_lines(samples).observe(seen, F.count("*").alias("rows")).write.mode("overwrite").text(path)
    return seen.get["rows"]


def write_shards(samples: DataFrame, path: str, shard_size: int = 50_000) -> int:
    """Folders shard=00000 and on with exactly shard_size rows each, in reading order, the last with the rest; returns their number.

    Rows are numbered by ranges of row_idx, so no task sees more than its range and its shard.
    """
    if shard_size <= 0:
        raise ValueError("shard_size must be positive")
    rows = samples.repartitionByRange("row_idx").sortWithinPartitions("row_idx").withColumn("_at", F.monotonically_increasing_id())
    rows = rows.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)}).persist()
    try:
        counts = sorted((r["_part"], r["count"]) for r in rows.groupBy("_part").count().collect())  # a row for each task
        base = dict(zip([p for p, _ in counts], accumulate((n for _, n in counts), initial=0), strict=False))
        total = sum(n for _, n in counts)
        table = samples.sparkSession.createDataFrame(list(base.items()) or [(-1, 0)], "_part long, _base long")
        number = F.col("_base") + F.col("_at")
        placed = rows.join(F.broadcast(table), "_part").withColumns({"_row": number, "shard": F.lpad(F.floor(number / shard_size).cast("string"), 5, "0")})
        lines = placed.select("shard", "_row", F.struct(*samples.columns).alias("s")).select("shard", "_row", "s.*")
        text = to_json_lines(lines, ["shard", "_row"]).repartition(max(1, -(-total // shard_size)), "shard").sortWithinPartitions("shard", "_row")
        text.select("shard", "value").write.mode("overwrite").partitionBy("shard").text(path)
    finally:
        rows.unpersist()
    return -(-total // shard_size)


def shard_prefix(label: str) -> str:
    return re.sub("[/:]", "_", label)


def shard_rows(rows: DataFrame, shards: int, index: int) -> DataFrame:
    """Every shards-th row from index on; one shard or fewer pass all."""
    if shards <= 1:
        return rows
    if not 0 <= index < shards:
        raise ValueError(f"shard index {index} is not in 0..{shards - 1}")
    return rows.where(F.pmod("row_idx", F.lit(shards)) == index)


def limit_rows(rows: DataFrame, most: int | None) -> DataFrame:
    """The first rows in reading order; None, 0 or less: all."""
    return rows.orderBy("row_idx").limit(most) if most and most > 0 else rows


def load_config(path: str) -> dict:
    value = json.loads(Path(path).read_text("utf-8"))
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no JSON object")
    return expand(value, str(runs_dir()))


def expand(value, runs: str):
    """`{runs_dir}` put in, in all strings."""
    if isinstance(value, dict):
        return {k: expand(v, runs) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, runs) for v in value]
    return value.replace("{runs_dir}", runs) if isinstance(value, str) else value


def runs_dir() -> Path:
    return Path(os.environ.get("SPARLOOM_RUNS", Path.home() / "sparloom-runs"))


def artifact_path(path: str) -> Path:
    return Path(path) if os.path.isabs(path) else runs_dir() / path


def write_report(report: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=2, ensure_ascii=False, sort_keys=True) + "\n", encoding="utf-8")
