"""String and turn functions against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparloom.functions import text as T
from sparloom.functions import turns as X
from sparloom.sources.parsers import split_assistant

CHARS = ["a", "b", "The", " ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "é", "Ü", "ß", "\U0001f600", "-", "_", "x1", "$1", "\\"]


def texts(seed, n=150, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(CHARS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").repartition(3)


def run(spark, values, column):
    return [r[1] for r in sorted(frame(spark, values).select("i", column.alias("v")).collect())]


def slow_repetition(text, n=5):
    words = text.lower().split()
    if len(words) < 2 * n:
        return (0, 0)
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n)]
    return (len(grams), len(grams) - len(set(grams)))


def test_strip_words_and_tokens(spark):
    values = texts(1)
    assert run(spark, values, T.strip(F.col("t"))) == [v.strip() for v in values]
    assert run(spark, values, T.words(F.col("t"))) == [v.split() for v in values]
    assert run(spark, values, T.token_estimate(F.col("t"))) == [max(1, len(v) // 4) for v in values]


def test_repetition_drops_the_last_ngram(spark):
    rng = random.Random(2)
    values = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(150)] + ["", "a b c d e a b c d e"]
    got = run(spark, values, T.repetition_counts(F.col("t")))
    assert [tuple(g) for g in got] == [slow_repetition(v) for v in values]


def test_normalized_label(spark):
    values = ["", " A--b ", "__x__", "Ünder score", "a1/B2", "***"]
    want = [re.sub("_+", "_", re.sub("[^a-zA-Z0-9]+", "_", v.strip().lower())).strip("_") for v in values]
    assert run(spark, values, T.normalized_label(F.col("t"))) == want


TAG = re.compile(r"<(?P<tag>think|thinking|reasoning|tool_call|tool_response)>\s*(?P<body>.*?)\s*</(?P=tag)>", re.I | re.S)
KIND = {"think": "reasoning", "thinking": "reasoning", "reasoning": "reasoning", "tool_call": "tool_call", "tool_response": "observation"}


def slow_split(content):
    out, at = [], 0
    for m in TAG.finditer(content):
        if before := content[at : m.start()].strip():
            out.append(("assistant", "final", before, True))
        kind, body = KIND[m["tag"].lower()], m["body"].strip()
        if body:
            out.append(("tool", kind, body, False) if kind == "observation" else ("assistant", kind, body, True))
        at = m.end()
    if rest := content[at:].strip():
        out.append(("assistant", "final", rest, True))
    return out or ([("assistant", "final", content.strip(), True)] if content.strip() else [])


def test_split_assistant(spark):
    rng = random.Random(3)
    parts = ["<think>", "</think>", "<THINK>", "</THINK>", "<tool_call>", "</tool_call>", "<tool_response>", "</tool_response>", "<reasoning>", "</reasoning>", "<thinking>", "</thinking>", " ", "\n", "x", "$1", "{\"a\":1}", "\\"]
    values = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(800)] + ["<think></think>", "<think> </think>"]
    got = run(spark, values, split_assistant(F.col("t")))
    for v, turns in zip(values, got, strict=True):
        assert [(t["role"], t["type"], t["content"], t["trainable"]) for t in turns] == slow_split(v), v


def messages(spark, turns):
    full = [(i, [(r, k, c, t, None, None) for r, k, c, t in m]) for i, m in enumerate(turns)]
    return spark.createDataFrame(full, "i int, messages array<struct<role:string,type:string,content:string,trainable:boolean,name:string,metadata:string>>")


U = ("user", "message", "Hi\nTask: do it. Current terminal state: no", False)
A = ("assistant", "final", " done ", True)
R = ("assistant", "reasoning", "think", True)
O = ("tool", "observation", "File_name here", False)  # noqa: E741


def one(spark, turns, column):
    return messages(spark, [turns]).select(column).first()[0]


def test_task_text_markers(spark):
    m = F.col("messages")
    say = lambda t: [("user", "message", t, False), A]
    assert one(spark, [U, A], X.task_text(m)) == "Task: do it. "
    assert one(spark, say("Task: a. Problem Description b"), X.task_text(m)) == "Problem Description b"
    assert one(spark, say("current TERMINAL state: x"), X.task_text(m)) == ""
    assert one(spark, [A, O], X.task_text(m)) == " done \nFile_name here"
    assert one(spark, say("abcdef"), X.task_text(m, 4)) == "abcd"


def test_classifier_text_keeps_both_ends(spark):
    m = F.col("messages")
    whole = "user:message\n" + U[2] + "\n\nassistant:final\ndone"
    assert one(spark, [U, A], X.classifier_text(m)) == whole
    assert one(spark, [U, A], X.classifier_text(m, 11)) == whole[:5] + X.CUT + whole[-6:]


def test_transcript_and_prompts(spark):
    m = F.col("messages")
    assert one(spark, [U, R, A], X.transcript(m)) == f"<|user|>\n{U[2]}\n<|assistant_reasoning|>\nthink\n<|assistant_final|>\ndone\n"
    assert one(spark, [U, A], X.transcript(m, False)) == f"<|user|>\n{U[2]}\n<|assistant_final|>\n"
    assert one(spark, [U, R, A], X.eval_prompt(m)) == f"<|user|>\n{U[2]}\n<|assistant_final|>\n"
    after = f"<|user|>\n{U[2]}\n<|assistant_reasoning|>\nthink\n<|tool_observation|>\nFile_name here\n<|assistant_final|>\n"
    assert one(spark, [U, R, O, A, U], X.eval_prompt(m, "after_first_observation")) == after
    assert one(spark, [("system", "odd", "s", False)], X.transcript(m)) == "<|system_odd|>\ns\n"
    with pytest.raises(ValueError):
        X.eval_prompt(m, "other")


def test_generation_metrics(spark):
    cases = {
        '<tool_call>{"a": 1}</tool_call>': True, "<tool_call>{bad}</tool_call>": True, "<tool_call>bad</tool_call>": False, "<tool_call> </tool_call>": False,
        "none": False, "<TOOL_CALL>{}</TOOL_CALL>": False, "<tool_call>[1]</tool_call>": True,
    }
    assert run(spark, list(cases), X.valid_tool_call(F.col("t"))) == list(cases.values())
    got = messages(spark, [[O], [A]]).select("i", X.generation_metrics(F.col("messages"), F.lit("FILE_NAME is here: fix")).alias("m")).orderBy("i").collect()
    assert (got[0].m.observation_overlap, got[0].m.observation_grounded, got[0].m.patch_intent) == (1.0, True, True)
    assert (got[1].m.observation_overlap, got[1].m.observation_grounded) == (None, False)


@pytest.mark.parametrize(("turns", "bad"), [([U, A], False), ([U], True), ([A], True), ([U, ("assistant", "final", " \x1c", True)], True)])
def test_malformed(spark, turns, bad):
    assert one(spark, turns, X.malformed(F.col("messages"))) == bad
