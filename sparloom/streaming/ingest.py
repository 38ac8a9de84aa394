"""Incremental ingestion and labelling of landed files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparloom.functions.labels import Taxonomy
from sparloom.operators.quality import basic_filter, scored
from sparloom.schema import TURN_DDL
from sparloom.sources.parsers import parse

SAMPLE_DDL = f"id string, source_dataset string, sample_type string, messages array<{TURN_DDL}>, capabilities array<string>, domains array<string>, success boolean, quality_score double, metadata string"


def converted(raw: DataFrame, layout: str, source: str, min_quality: float = 0.0, capabilities: Taxonomy | None = None, domains: Taxonomy | None = None, **limits) -> DataFrame:
    """(row_idx, sample columns, tokens, error, written) of raw rows (row_idx, value): parsed and scored, all in one stage.

    written: whether a row passes min_quality and the basic filter; rows with an error have no sample.
    """
    rows = parse(raw, layout, source, capabilities, domains)
    flat = scored(rows.select("row_idx", "error", "sample.*"))
    ok = F.col("error").isNull() & (F.col("quality_score") >= min_quality) & basic_filter(**limits)
    return flat.withColumn("written", F.coalesce(ok, F.lit(False)))


def kept(rows: DataFrame, *names: str) -> DataFrame:
    """The named columns of the rows that are written.

    A generator stands before the filter, as the planner would else put a copy of the whole conversion into it, in which each use
    of a parsed value parses the row again.
    """
    once = rows.select(F.explode(F.array(F.struct(*names, "written"))).alias("row"))
    return once.where("row.written").select(*[F.col("row")[n].alias(n) for n in names])


def conversion_stats(rows: DataFrame) -> DataFrame:
    """(metric, value): seen, parsed, written, skipped, errors, and error:<type> for each type."""
    head = rows.agg(F.count("*").alias("seen"), F.count(F.when(F.col("error").isNull(), 1)).alias("parsed"), F.count(F.when(F.col("written"), 1)).alias("written"), F.count(F.when(~F.col("written"), 1)).alias("skipped"), F.count("error").alias("errors"))
    main = head.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in head.columns])).alias("x")).select("x.*")
    types = rows.where(F.col("error").isNotNull()).groupBy(F.concat(F.lit("error:"), F.col("error.type")).alias("metric")).agg(F.count("*").alias("value"))
    return main.unionByName(types)


def error_examples(rows: DataFrame, k: int = 3) -> DataFrame:
    """The first k rows with an error: row_idx, type, message, keys."""
    return rows.where(F.col("error").isNotNull()).orderBy("row_idx").limit(k).select("row_idx", "error.*")


def failing(rows: DataFrame) -> DataFrame:
    """Rows of which the first error fails the job."""
    shown = F.concat(F.lit("row "), F.col("row_idx"), F.lit(": "), F.col("error.message"))
    return rows.withColumn("written", F.when(F.col("error").isNotNull(), F.raise_error(shown).cast("boolean")).otherwise(F.col("written")))


def stream_convert(spark: SparkSession, landing: str, output: str, checkpoint: str, layout: str, source: str, max_files: int | None = None, shards: int = 1, shard: int = 0, **options) -> StreamingQuery:
    """Converts files that land in a folder, once each, into Parquet; what is there now, then ends.

    The checkpoint remembers the files, so a second start takes only new ones. Rows are dealt to shards by a hash of the
    file and the line, as a stream has no row numbers.
    """
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", max_files or 1_000_000)
    lines = reader.load(landing).where(F.trim("value") != "").select(F.xxhash64(F.col("_metadata.file_path"), "value").alias("row_idx"), "value")
    if shards > 1:
        lines = lines.where(F.pmod("row_idx", F.lit(shards)) == shard)
    rows = converted(lines, layout, source, **options)
    names = [c.split()[0] for c in SAMPLE_DDL.split(", ")]
    return kept(rows, *names).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_label(spark: SparkSession, canonical: str, output: str, checkpoint: str, label: Callable[[DataFrame], DataFrame], interval: str | None = None, done: DataFrame | None = None) -> StreamingQuery:
    """Labels canonical files as they are closed. Without an interval: what is there now, then ends.

    A batch overwrites the folder of its number, so a repeated batch leaves no second copy. done: rows that are labelled
    already; samples with an id of theirs are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch if done is None else batch.join(done.select("id").distinct(), "id", "left_anti")
        label(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    stream = spark.readStream.schema(SAMPLE_DDL).parquet(canonical).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return stream.trigger(processingTime=interval).start() if interval else stream.trigger(availableNow=True).start()
