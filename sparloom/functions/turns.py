"""Functions over the turns of a sample: filters, scores, renderings, evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparloom.functions.text import bind, contains_any, earliest_match, first_match, strip

# Where a task begins and where rollout text begins, names of turns, signs of an edit, contest cues.
START_MARKERS = ("Task Description:", "## Problem Description", "Problem Description", "Task:")
STOP_MARKERS = ("Current terminal state:", "Current Terminal Screen:", "New Terminal Output:", "\nassistant:")
TURN_LABELS = {
    "system message": "system",
    "user message": "user",
    "tool observation": "tool_observation",
    "assistant reasoning": "assistant_reasoning",
    "assistant tool_call": "assistant_tool_call",
    "assistant final": "assistant_final",
    "assistant message": "assistant",
}
PATCH_SIGNS = ("diff --git", "@@", "patch", "fix", "edit")
CUT = "\n\n[...truncated...]\n\n"
IGNORED = -100


def joined_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["content"]), "\n")


def trainable_turns(messages: Column) -> Column:
    return F.size(F.filter(messages, lambda m: m["trainable"]))


def malformed(messages: Column) -> Column:
    """A blank turn, no user turn or no trainable turn."""
    blank = F.exists(messages, lambda m: strip(m["content"]) == "")
    return blank | ~F.exists(messages, lambda m: m["role"] == "user") | ~F.exists(messages, lambda m: m["trainable"])


def quality_score(messages: Column, success: Column, capabilities: Column, tokens: Column, repetition: Column) -> Column:
    """Sum of fixed parts, less the repetition (0.25 at most), from 0 to 1, to 4 places."""
    has = lambda kind: F.exists(messages, lambda m: m["type"] == kind)
    parts = [
        F.lit(0.35),
        F.when(success, 0.25).when(~success, -0.25).otherwise(0.0),
        F.when(trainable_turns(messages) >= 2, 0.10).otherwise(0.0),
        F.when(has("tool_call"), 0.10).otherwise(0.0),
        F.when(has("observation"), 0.10).otherwise(0.0),
        F.when(F.coalesce(F.size(capabilities), F.lit(0)) > 0, 0.05).otherwise(0.0),
        F.when(tokens.between(256, 12000), 0.10).when(tokens > 24000, -0.10).otherwise(0.0),
        -F.least(F.lit(0.25), repetition),
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 4)


def classifier_text(messages: Column, max_chars: int = 24000) -> Column:
    """role:type and content of each turn; a longer text keeps its two ends around a mark."""
    whole = F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["type"], F.lit("\n"), strip(m["content"]))), "\n\n")
    head = max_chars // 2
    return bind(whole, lambda t: F.when(F.length(t) <= max_chars, t).otherwise(F.concat(F.left(t, F.lit(head)), F.lit(CUT), F.right(t, F.lit(max_chars - head)))))


def task_text(messages: Column, max_chars: int = 12000) -> Column:
    """What the user asks, from the first listed start marker that occurs to the earliest stop marker."""
    asked = F.filter(messages, lambda m: m["role"] == "user")
    whole = F.when(F.size(asked) > 0, F.array_join(F.transform(asked, lambda m: m["content"]), "\n\n")).otherwise(joined_text(messages))
    begun = bind(whole, lambda t: F.substr(t, F.coalesce(first_match(t, START_MARKERS), F.lit(0)) + 1))
    return bind(begun, lambda t: F.left(t, F.least(F.lit(max_chars), F.coalesce(earliest_match(t, STOP_MARKERS), F.length(t)))))


def turn_label(turn: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TURN_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.concat_ws(" ", turn["role"], turn["type"])), F.concat_ws("_", turn["role"], turn["type"]))


def header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn_label(turn), F.lit("|>\n"))


def segments(messages: Column) -> Column:
    """(text, trainable) of the transcript: a masked header and the content of each turn."""
    pair = lambda m: F.array(F.struct(header(m).alias("text"), F.lit(False).alias("trainable")), F.struct(F.concat(strip(m["content"]), F.lit("\n")).alias("text"), m["trainable"].alias("trainable")))
    return F.flatten(F.transform(messages, pair))


def transcript(messages: Column, include_trainable: bool = True) -> Column:
    parts = segments(messages)
    return F.array_join(F.transform(parts if include_trainable else F.filter(parts, lambda s: ~s["trainable"]), lambda s: s["text"]), "")


def eval_prompt(messages: Column, mode: str = "initial") -> Column:
    """The turns before the first assistant turn, or before the first one after an observation, and an open final header."""
    if mode not in ("initial", "after_first_observation"):
        raise ValueError(f"unknown prompt mode: {mode}")
    size = F.size(messages)
    assistants = F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i)), lambda i: i.isNotNull())
    if mode == "initial":
        end = F.coalesce(F.try_element_at(assistants, F.lit(1)), size)
    else:
        seen = F.coalesce(F.try_element_at(F.filter(F.transform(messages, lambda m, i: F.when(m["type"] == "observation", i)), lambda i: i.isNotNull()), F.lit(1)), size)
        end = F.coalesce(F.try_element_at(F.filter(assistants, lambda i: i > seen), F.lit(1)), size)
    shown = F.transform(F.slice(messages, 1, end), lambda m: F.concat(header(m), strip(m["content"]), F.lit("\n")))
    return F.concat(F.array_join(shown, ""), F.lit("<|assistant_final|>\n"))


def observation_text(messages: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["type"] == "observation"), F.lit(1))["content"], F.lit(""))


def identifiers(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]{3,}"), F.lit(0)), F.lower))


def word_overlap(reference: Column, candidate: Column) -> Column:
    """Share of the reference's identifiers that the candidate has; null without any."""
    return bind(identifiers(reference), lambda r: F.when(F.size(r) > 0, F.size(F.array_intersect(r, identifiers(candidate))) / F.size(r)))


def valid_tool_call(text: Column) -> Column:
    """Whether the first tool_call body is JSON, or at least stands in braces."""
    body = strip(F.regexp_extract(text, r"(?s)<tool_call>\s*(.*?)\s*</tool_call>", 1))
    parsed = F.try_parse_json(body).isNotNull()
    return bind(body, lambda b: (b != "") & (parsed | (F.startswith(b, F.lit("{")) & F.endswith(b, F.lit("}")))))


def patch_intent(text: Column) -> Column:
    return contains_any(F.lower(text), PATCH_SIGNS)


def generation_metrics(messages: Column, text: Column) -> Column:
    seen = observation_text(messages)
    overlap = F.when(seen != "", word_overlap(seen, text))
    return F.struct(valid_tool_call(text).alias("valid_tool_call"), overlap.alias("observation_overlap"), F.coalesce(overlap >= 0.1, F.lit(False)).alias("observation_grounded"), patch_intent(text).alias("patch_intent"))
