"""Raw conversations to canonical rows.

Raw rows come as one JSON object per line in column `value` (with `row_idx`), so that a missing key and a null one differ.
A parser returns row_idx, `sample` and `error`: struct(type, message, keys), of which one is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.functions.labels import Taxonomy, category_values, label_evidence, labels_of
from sparloom.functions.text import bind, py_json_success, strip
from sparloom.functions.turns import joined_text
from sparloom.schema import TURN_DDL

# Role names, tags of assistant text, what makes a text coding or agent work.
ROLE_NAMES = {"system": "system", "human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "tool": "tool", "observation": "tool"}
TAG_TYPES = {"think": "reasoning", "thinking": "reasoning", "reasoning": "reasoning", "tool_call": "tool_call", "tool_response": "observation"}
CODING_SIGNS = ("repo", "coding", "code", "python", "javascript")
AGENT_SIGNS = ("tool", "terminal", "shell", "browser")
TOOL_MARKER = ("TOOL_USE", ("<tool", "tool "))


def _map(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def normalize_role(raw: Column) -> Column:
    """One of the four roles; null for an unknown name."""
    return _map(ROLE_NAMES, F.lower(strip(raw)))


def turn(role, kind, content: Column, trainable) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(role).alias("role"), lit(kind).alias("type"), content.alias("content"), lit(trainable).alias("trainable"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("metadata"))


def split_assistant(content: Column) -> Column:
    """Turns of tagged assistant text, in order: tagged stretches by their tag, other text as final turns, blanks dropped.

    A tagged stretch is rewritten as SEP tag SUB body SEP and the text is split at SEP; both signs are taken out of the
    text first.
    """
    tags = "|".join(sorted(TAG_TYPES, key=len, reverse=True))
    clean = F.translate(content, "\x01\x02", "")
    marked = F.regexp_replace(clean, rf"(?is)<({tags})>\s*(.*?)\s*</\1>", "\x01$1\x02$2\x01")

    def piece(p: Column) -> Column:
        cut = F.locate("\x02", p)
        body = strip(F.when(cut > 0, F.substr(p, cut + 1)).otherwise(p))
        kind = F.when(cut > 0, _map(TAG_TYPES, F.lower(F.left(p, cut - 1)))).otherwise(F.lit("final"))
        return F.when(body != "", bind(F.struct(kind.alias("k"), body.alias("b")), lambda x: turn(F.when(x["k"] == "observation", "tool").otherwise("assistant"), x["k"], x["b"], x["k"] != "observation")))

    found = F.filter(F.transform(F.split(marked, "\x01", -1), piece), lambda t: t.isNotNull())
    plain = strip(clean)
    whole = F.when(plain != "", F.array(turn("assistant", "final", plain, True))).otherwise(F.array().cast(f"array<{TURN_DDL}>"))
    return bind(found, lambda f: F.when(F.size(f) > 0, f).otherwise(whole))


def sample_type(text: Column, *fields: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields], F.left(text, F.lit(2000))))
    has = lambda signs: F.rlike(hay, F.lit("|".join(signs)))
    return F.when(has(CODING_SIGNS), "coding").when(has(AGENT_SIGNS), "agent").otherwise("reasoning")


def truthy(value: Column, *keys: str) -> Column:
    """The first of the keys with a value that is not empty, zero, false or null, as a string."""
    at = [F.get_json_object(value, f"$.{k}") for k in keys]
    return F.coalesce(*[F.when(~a.isin("", "0", "0.0", "false", "[]", "{}"), a) for a in at])


def success(value: Column) -> Column:
    """reward if the key is there, else the value of the first of success, result and task_binary that is there."""
    keys = F.json_object_keys(value)

    def typed(key: str) -> Column:
        raw = F.get_json_object(value, f"$.{key}")
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(value), f"$.{key}", "variant"))
        number = F.when(raw.try_cast("double") == 1, True).when(raw.try_cast("double") == 0, False)
        return F.when(F.lower(kind) == "string", py_json_success(raw)).when(F.lower(kind) == "boolean", raw == "true").otherwise(number)

    return F.when(F.array_contains(keys, "reward"), typed("reward")).when(F.array_contains(keys, "success"), typed("success")).when(F.array_contains(keys, "result"), typed("result")).otherwise(typed("task_binary"))


def _turns(raw: Column, role_keys: tuple[str, str], text_keys: tuple[str, str]) -> Column:
    def of(m: Column) -> Column:
        role = normalize_role(F.coalesce(*[F.nullif(m[k], F.lit("")) for k in role_keys]))
        content = strip(F.coalesce(*[F.nullif(m[k], F.lit("")) for k in text_keys], F.lit("")))
        none = F.array().cast(f"array<{TURN_DDL}>")
        return bind(F.struct(role.alias("r"), content.alias("c")), lambda x: F.when(x["c"] == "", none).when(x["r"] == "assistant", split_assistant(x["c"])).when(x["r"] == "tool", F.array(turn("tool", "observation", x["c"], False))).otherwise(F.array(turn(x["r"], "message", x["c"], False))))

    return F.flatten(F.transform(raw, of))


MESSAGE = "array<struct<role:string,from:string,content:string,value:string>>"
#: Metadata fields by name: keys of the raw row, of which the first that is not empty counts.
LAYOUTS = {
    "agenttrove": {
        "lists": ("messages", "conversations"),
        "role": ("role", "from"),
        "text": ("content", "value"),
        "id": ("trajectory_id", "task_id", "id", "path", "trial_name", "episode"),
        "metadata": {"original_id": ("task_id", "id", "path"), "original_source": ("original_source",), "teacher_model": ("original_teacher", "model"), "reward": ("reward",), "result": ("result",), "task": ("task",), "episode": ("episode",), "run_id": ("run_id",), "trial_name": ("trial_name",)},
    },
    "hermes": {
        "lists": ("conversations", "messages"),
        "role": ("from", "role"),
        "text": ("value", "content"),
        "id": ("id",),
        "metadata": {"original_id": ("id",), "category": ("category",), "subcategory": ("subcategory",), "task": ("task",)},
    },
}


def parse(raw: DataFrame, layout: str, source: str, capabilities: Taxonomy | None = None, domains: Taxonomy | None = None) -> DataFrame:
    """(row_idx, sample, error) for raw rows (row_idx, value) of a layout."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown parser: {layout}")
    spec, value = LAYOUTS[layout], F.col("value")
    capabilities, domains = capabilities or Taxonomy.load(), domains or Taxonomy.load(axis="domains")
    lists = [F.from_json(F.get_json_object(value, f"$.{k}"), MESSAGE) for k in spec["lists"]]
    raw_turns = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
    one = lambda keys: truthy(value, *keys) if len(keys) > 1 else F.get_json_object(value, f"$.{keys[0]}")
    fields = [one(k).alias(n) for n, k in spec["metadata"].items()]
    if layout == "hermes":
        fields.append(truthy(value, "tools").isNotNull().alias("tools_present"))
    rows = raw.select("row_idx", "value", raw_turns.alias("raw"), F.to_json(F.struct(*fields)).alias("metadata"))
    bad_role = F.filter(F.col("raw"), lambda m: normalize_role(F.coalesce(*[F.nullif(m[k], F.lit("")) for k in spec["role"]])).isNull())
    message = (
        F.when(F.json_object_keys(value).isNull(), F.lit("the row is no JSON object"))
        .when(F.col("raw").isNull(), F.lit(f"the row has no list of {' or '.join(spec['lists'])}"))
        .when(F.size(bad_role) > 0, F.concat(F.lit("unknown role: "), F.coalesce(*[bad_role[0][k] for k in spec["role"]], F.lit("none"))))
    )
    rows = rows.select("*", message.alias("message"), F.when(message.isNull(), _turns(F.col("raw"), spec["role"], spec["text"])).alias("messages"))
    rows = rows.select("*", F.when(F.col("message").isNotNull(), F.col("message")).when(F.size("messages") < 1, F.lit("no turn has text")).alias("problem"), joined_text(F.col("messages")).alias("text"))
    named = F.coalesce(truthy(value, *spec["id"]), F.left(F.sha2(F.concat_ws("|", F.lit(source), F.get_json_object(value, "$.original_source"), F.to_json("raw")), 256), F.lit(24)))
    kind = F.lit("agent") if layout == "hermes" else sample_type(F.col("text"), *[truthy(value, k) for k in ("category", "subcategory", "original_source")])
    said = category_values(F.get_json_object(value, "$.metadata"), value)
    sample = F.struct(
        named.alias("id"),
        F.lit(source).alias("source_dataset"),
        kind.alias("sample_type"),
        F.col("messages"),
        labels_of(label_evidence(F.col("text"), said, capabilities, TOOL_MARKER)).alias("capabilities"),
        labels_of(label_evidence(F.col("text"), said, domains)).alias("domains"),
        (F.lit(None).cast("boolean") if layout == "hermes" else success(value)).alias("success"),
        F.lit(0.0).alias("quality_score"),
        F.col("metadata"),
    )
    error = F.struct(F.lit("ValueError").alias("type"), F.col("problem").alias("message"), F.array_sort(F.json_object_keys(value)).alias("keys"))
    return rows.select("row_idx", F.when(F.col("problem").isNull(), sample).alias("sample"), F.when(F.col("problem").isNotNull(), error).alias("error"))
