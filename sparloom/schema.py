"""The canonical sample: one row per conversation, its turns nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The enumerations of the canonical format.
ROLES = ("system", "user", "assistant", "tool")
TURN_TYPES = ("message", "reasoning", "tool_call", "observation", "final")
SAMPLE_TYPES = ("reasoning", "agent", "coding")

TURN = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("trainable", T.BooleanType()),
        T.StructField("name", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)
CANONICAL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source_dataset", T.StringType()),
        T.StructField("sample_type", T.StringType()),
        T.StructField("messages", T.ArrayType(TURN)),
        T.StructField("capabilities", T.ArrayType(T.StringType())),
        T.StructField("domains", T.ArrayType(T.StringType())),
        T.StructField("success", T.BooleanType()),
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("metadata", T.StringType()),
    ]
)
TURN_DDL = "struct<role:string,type:string,content:string,trainable:boolean,name:string,metadata:string>"


def turn_errors(turn: Column) -> Column:
    """Codes of what is wrong with one turn."""
    checks = [
        (~turn["role"].isin(*ROLES) | turn["role"].isNull(), "turn_role"),
        (~turn["type"].isin(*TURN_TYPES) | turn["type"].isNull(), "turn_type"),
        (turn["content"].isNull(), "turn_content"),
        (turn["trainable"] & (turn["role"] != "assistant"), "trainable_role"),
        ((turn["role"] == "tool") & (turn["type"] != "observation"), "tool_type"),
    ]
    return F.filter(F.array(*[F.when(bad, F.lit(code)) for bad, code in checks]), lambda x: x.isNotNull())


def sample_errors() -> Column:
    """Codes of what is wrong with a sample, each once, ordered; an empty array for a valid one."""
    score = F.col("quality_score")
    checks = [
        (F.coalesce(F.col("id"), F.lit("")) == "", "id"),
        (~F.coalesce(F.col("sample_type").isin(*SAMPLE_TYPES), F.lit(False)), "sample_type"),
        (F.coalesce(F.size("messages"), F.lit(0)) < 1, "messages"),
        (~F.coalesce(score.between(0, 1), F.lit(False)), "quality_score"),
    ]
    own = F.filter(F.array(*[F.when(bad, F.lit(code)) for bad, code in checks]), lambda x: x.isNotNull())
    turns = F.flatten(F.transform(F.coalesce(F.col("messages"), F.array().cast(f"array<{TURN_DDL}>")), turn_errors))
    return F.array_sort(F.array_distinct(F.concat(own, turns)))


def validated(samples: DataFrame, strict: bool = False) -> DataFrame:
    """samples with `errors`; in strict mode the first invalid row fails the job."""
    out = samples.withColumn("errors", sample_errors())
    if strict:
        shown = F.concat(F.lit("invalid sample "), F.coalesce("id", F.lit("?")), F.lit(": "), F.array_join("errors", ","))
        out = out.withColumn("errors", F.when(F.size("errors") > 0, F.raise_error(shown).cast("array<string>")).otherwise(F.col("errors")))
    return out


def noted(metadata: Column, **entries: Column) -> Column:
    """A metadata object with entries (structs) put in or replaced; where an entry is null, its key is taken out."""
    kept = F.coalesce(F.from_json(metadata, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    kept = F.map_filter(kept, lambda k, _: ~k.isin(*entries))
    new = [F.struct(F.lit(k).alias("key"), F.parse_json(F.to_json(v, {"ignoreNullFields": "false"})).alias("value")) for k, v in entries.items()]
    given = F.map_from_entries(F.filter(F.array(*new), lambda e: e["value"].isNotNull()))
    return F.to_json(F.map_concat(kept, given))


def type_errors(value: Column) -> Column:
    """Codes of fields of a JSON line that are there but of another type than a sample's."""
    kinds = {"id": ("STRING",), "source_dataset": ("STRING",), "sample_type": ("STRING",), "messages": ("ARRAY",), "capabilities": ("ARRAY",), "domains": ("ARRAY",), "success": ("BOOLEAN",), "quality_score": ("BIGINT", "DOUBLE", "DECIMAL"), "metadata": ("OBJECT",)}
    parsed = F.try_parse_json(value)
    checks = []
    for name, allowed in kinds.items():
        kind = F.schema_of_variant(F.variant_get(parsed, f"$.{name}", "variant"))
        checks.append(F.when(kind.isNotNull() & (kind != "VOID") & ~F.regexp_extract(kind, "^[A-Z]+", 0).isin(*allowed), F.lit(f"type:{name}")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def with_defaults(samples: DataFrame) -> DataFrame:
    """Columns that older rows lack: empty domains and capabilities, no success, score 0, empty metadata."""
    empty = F.array().cast("array<string>")
    given = set(samples.columns)
    fill = {"capabilities": empty, "domains": empty, "success": F.lit(None).cast("boolean"), "quality_score": F.lit(0.0), "metadata": F.lit("{}")}
    return samples.withColumns({c: F.coalesce(F.col(c), v) if c in given and c != "success" else (F.col(c) if c in given else v) for c, v in fill.items()})


def to_json_lines(samples: DataFrame, beside: list[str] = ()) -> DataFrame:
    """One `value` per row (and the columns `beside`): null success is written, null name and metadata of a turn are left out."""
    turns = F.concat(F.lit("["), F.array_join(F.transform("messages", lambda m: F.to_json(m)), ","), F.lit("]"))
    keep = ["id", "source_dataset", "sample_type", "capabilities", "domains", "success", "quality_score"]
    head = F.to_json(F.struct(*keep), {"ignoreNullFields": "false"})
    opened = F.regexp_replace(head, r"\}\z", "")
    return samples.select(*beside, F.concat(opened, F.lit(',"messages":'), turns, F.lit(',"metadata":'), F.coalesce("metadata", F.lit("{}")), F.lit("}")).alias("value"))
