"""Canonical samples from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.functions.labels import Taxonomy
from sparloom.operators.labeling import relabel
from sparloom.operators.quality import measured, scored
from sparloom.schema import TURN_DDL
from sparloom.sources.parsers import normalize_role, split_assistant, turn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, content): every second assistant turn opens with a thought, every fourth with a tool call."""
    rows = table(spark, sf_dir, "conversations")
    call = F.concat(F.lit('<tool_call>{"turn":'), F.col("turn"), F.lit("}</tool_call>"), F.col("text"))
    thought = F.concat(F.lit("<think>"), F.left("text", F.lit(60)), F.lit("</think>"), F.substr("text", F.lit(61)))
    text = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 3), call).when((F.col("role") == "assistant") & (F.col("turn") % 2 == 1), thought).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", "role", text.alias("content"))


def canon_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample for each conversation: source and language of its document, success from the document's quality label."""
    parts = F.when(normalize_role(F.col("role")) == "assistant", split_assistant(F.col("content"))).otherwise(F.array(turn(normalize_role(F.col("role")), "message", F.col("content"), False)))
    turns = raw_turns(spark, sf_dir).select("conv_id", "turn", parts.alias("parts"))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "parts"))).alias("t"))
    convs = convs.select("conv_id", F.flatten(F.transform("t", lambda x: x["parts"])).alias("messages"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = convs.join(docs, convs.conv_id == docs.doc_id).join(labels, "doc_id", "left")
    return rows.select(
        F.col("conv_id").alias("row_idx"),
        F.concat(F.lit("conv-"), F.col("conv_id")).alias("id"),
        F.col("source").alias("source_dataset"),
        F.when(F.col("conv_id") % 3 == 0, "coding").when(F.col("conv_id") % 3 == 1, "agent").otherwise("reasoning").alias("sample_type"),
        "messages",
        F.array().cast("array<string>").alias("capabilities"),
        F.array().cast("array<string>").alias("domains"),
        F.when(F.col("quality") == 1, True).when(F.col("quality") == 0, False).alias("success"),
        F.lit(0.0).alias("quality_score"),
        F.to_json(F.struct(F.col("lang").alias("category"), F.concat(F.lit("doc-"), F.col("conv_id")).alias("original_id"))).alias("metadata"),
    )


def canon_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample for each document: its beginning as the user's turn, the whole as the answer; four documents share a group."""
    rows = table(spark, sf_dir, "documents")
    user = turn("user", "message", F.left("text", F.lit(200)), False)
    return rows.select(
        F.col("doc_id").alias("row_idx"),
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"),
        F.col("source").alias("source_dataset"),
        F.lit("reasoning").alias("sample_type"),
        F.array(user, turn("assistant", "final", F.col("text"), True)).cast(f"array<{TURN_DDL}>").alias("messages"),
        F.array().cast("array<string>").alias("capabilities"),
        F.array().cast("array<string>").alias("domains"),
        F.lit(None).cast("boolean").alias("success"),
        F.lit(0.0).alias("quality_score"),
        F.to_json(F.struct(F.col("lang").alias("category"), F.floor(F.col("doc_id") / 4).cast("string").alias("original_id"))).alias("metadata"),
    )


def canon_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample for each user: their events in order as turns, errors as observations."""
    e = table(spark, sf_dir, "events")
    content = F.concat_ws(" ", "event_type", F.format_string("event_%d", "event_id"))
    kind = F.when(F.col("event_type").isin("signup", "view"), turn("user", "message", content, False)).when(F.col("event_type").isin("click", "purchase"), turn("assistant", "final", content, True)).otherwise(turn("tool", "observation", content, False))
    rows = e.select("user_id", "ts", "event_id", kind.alias("m")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "m"))).alias("t"))
    none = F.array().cast("array<string>")
    return rows.select(F.col("user_id").alias("row_idx"), F.concat(F.lit("user-"), F.col("user_id")).alias("id"), F.lit("events").alias("source_dataset"), F.lit("agent").alias("sample_type"), F.transform("t", lambda x: x["m"]).alias("messages"), none.alias("capabilities"), none.alias("domains"), F.lit(None).cast("boolean").alias("success"), F.lit(0.0).alias("quality_score"), F.lit("{}").alias("metadata"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, relabelled by the example taxonomies and scored."""
    rows = relabel(canon_conv(spark, sf_dir), Taxonomy.load(), Taxonomy.load(axis="domains"), min_score=0.5)
    return scored(measured(rows))
