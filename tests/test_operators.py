"""Operators over small canonical samples."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparloom.functions.labels import Guardrails, Taxonomy, apply_guardrails, category_values, label_evidence, normalize_labels, select_labels
from sparloom.operators import labeling as L
from sparloom.operators import reports as R
from sparloom.operators import subsets as S
from sparloom.operators.quality import filtered, matches_target, measured, scored
from sparloom.plans import catalogue
from sparloom.schema import TURN_DDL, sample_errors, to_json_lines, validated
from sparloom.sources import io as IO
from sparloom.sources.parsers import parse
from sparloom.streaming.ingest import conversion_stats, converted, error_examples, stream_convert, stream_label

DDL = f"row_idx long, id string, source_dataset string, sample_type string, messages array<{TURN_DDL}>, capabilities array<string>, domains array<string>, success boolean, quality_score double, metadata string"


def sample(i, user="please do this", answer="done as asked", caps=(), doms=(), source="s", kind="reasoning", success=None, quality=0.9, meta="{}", ident=None):
    turns = [("user", "message", user, False, None, None), ("assistant", "final", answer, True, None, None)]
    return (i, ident or f"id{i}", source, kind, turns, list(caps), list(doms), success, quality, meta)


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL)


TAX = Taxonomy.of({"version": "t", "capabilities": {"FIX": {"positive_cues": ["fix it", "bug", "crash"], "source_aliases": ["repair"]}, "PLAN": {"positive_cues": ["plan"]}, "TOOL_USE": {}}}, "capabilities")
DOM = Taxonomy.of({"version": "d", "domains": {"CODE": {"positive_cues": ["bug"], "classifier_label": "software"}, "ART": {"positive_cues": ["paint"]}}}, "domains")


def evidence(spark, text, cats=(), marker=None, tax=TAX):
    df = spark.createDataFrame([(text, list(cats))], "t string, c array<string>")
    return {e["label"]: e["score"] for e in df.select(label_evidence(F.col("t"), F.col("c"), tax, marker)).first()[0]}


def test_weak_evidence(spark):
    assert evidence(spark, "A BUG made it crash; fix  it") == {"FIX": 0.65}
    assert evidence(spark, "debugging crashes; prefix it") == {}
    assert evidence(spark, "plan", ["Repair"]) == {"FIX": 0.75, "PLAN": 0.45}
    assert evidence(spark, "see <tool x", marker=("TOOL_USE", ("<tool", "tool "))) == {"TOOL_USE": 0.55}
    assert TAX.normalize("fix") == "FIX" and TAX.normalize("nothing") is None and TAX.validate(["PLAN", "no", "FIX"]) == ["FIX", "PLAN"]
    with pytest.raises(ValueError):
        Taxonomy.of({"domains": ["a"]}, "domains")


def test_categories_of_rows_and_metadata(spark):
    row = json.dumps({"category": ["a", "b"], "task": "t", "subcategory": 3, "task_type": " ", "source_category": ["x", 1]})
    df = spark.createDataFrame([(row, '{"category": "m", "task": ["no"]}'), ("[]", None)], "r string, m string")
    got = [r[0] for r in df.select(category_values(F.col("m"), F.col("r"))).collect()]
    assert got == [["a", "b", "t", "m"], []] and df.select(category_values(F.col("m"))).first()[0] == ["m"]


def test_plain_lists_take_known_cues(tmp_path):
    (tmp_path / "t.json").write_text('{"capabilities": ["RECALL", "OTHER"]}')
    labels = Taxonomy.load(str(tmp_path / "t.json")).labels
    assert "tint" in labels[0].cues and labels[1].cues == ()


def test_label_lists(spark):
    df = spark.createDataFrame([(["software", "x", "CODE", "art"], {"a": 0.7, "b": 0.9, "c": 0.7, "d": 0.1})], "l array<string>, m map<string,double>")
    assert df.select(normalize_labels(F.col("l"), DOM)).first()[0] == ["CODE", "ART"]
    assert df.select(normalize_labels(F.col("l"), DOM, 1)).first()[0] == ["CODE"]
    assert df.select(select_labels(F.col("m"), 0.65, 2)).first()[0] == ["b", "a"]
    assert df.select(select_labels(F.col("m"), 0.65)).first()[0] == ["b", "a", "c"]


def test_guardrails(spark):
    rules = Guardrails({"CODE": ("bug",), "ART": ("paint",)}, {"FIX": ("bug",)}, {"PLAN": ("plan",), "FIX": ("crash",)}, ("sample output",), "CODE")

    def run(text, caps, doms, kind="reasoning", most=4, most_d=1):
        df = spark.createDataFrame([(text, list(caps), list(doms), kind)], "t string, c array<string>, d array<string>, k string")
        return df.select(apply_guardrails(rules, F.col("k"), F.col("t"), F.col("c"), F.col("d"), most, most_d)).first()[0]

    g = run("Paint a PLAN", ["FIX", "OTHER"], ["CODE"])
    assert (g.capabilities, g.domains, g.dropped_capabilities, g.added_capabilities, g.applied) == (["OTHER", "PLAN"], ["ART"], ["FIX"], ["PLAN"], True)
    g = run("a bug, paint", [], [], kind="coding", most_d=0)
    assert g.domains == ["CODE"] and g.coding_frame
    g = run("a bug with a plan and a crash", ["A", "B", "C"], ["CODE"], most=4)
    assert (g.capabilities, g.dropped_capabilities) == (["A", "B", "C", "PLAN"], ["FIX"])
    g = run("nothing", ["A"], ["ART"])
    assert (g.capabilities, g.domains, g.applied) == (["A"], ["ART"], False)
    assert run("bug paint", [], ["X"], most_d=0).domains == []


def test_payloads():
    assert L.first_object('say {"a": "}{", "b": {"c": 1}} end') == {"a": "}{", "b": {"c": 1}}
    cut = L.payload_row('{"capabilities": ["FIX", 3], "domains": [], "confidence": "0.4", "rationale": "never clo')
    assert (cut["capabilities"], cut["confidence"], cut["error"]) == (["FIX"], 0.4, None) and cut["recovery"]
    assert L.payload_row("no json")["error"] and L.payload_row(None)["error"]
    assert L.payload_row('{"capabilities": [], "domains": [], "confidence": 7}')["confidence"] == 1.0
    assert L.payload_row('{"capabilities": [], "domains": [], "confidence": NaN}')["confidence"] == 1.0


def test_llm_label_keeps_bad_answers_apart(spark):
    rows = [sample(i, user=f"bug number {i}") for i in range(4)]
    answers = ['{"capabilities": ["fix"], "domains": ["software"], "confidence": 1}', "hm", 'ok {"capabilities": ["plan"], "domains": []} fine', '{"capabilities": ["fix"], "domains": ["art"], "rationale": "cut']
    asked = []

    def make():
        def generate(prompt):
            asked.append(prompt)
            return next(a for i, a in enumerate(answers) if f"number {i}" in prompt)

        return generate

    got = {r.id: r for r in L.llm_label(frame(spark, rows), make, TAX, DOM, concurrency=3).collect()}
    assert [got[f"id{i}"].capabilities for i in range(4)] == [["FIX"], [], ["PLAN"], ["FIX"]]
    assert [got[f"id{i}"].domains for i in range(4)] == [["CODE"], [], [], ["ART"]]
    assert got["id1"].payload.error and got["id3"].payload.recovery


def test_a_failing_generator_fails_the_job(spark):
    def make():
        def generate(prompt):
            raise RuntimeError("no server")

        return generate

    with pytest.raises(Exception, match="no server"):
        L.llm_label(frame(spark, [sample(1)]), make, TAX, DOM).collect()


def test_whole_members_of_a_cut_object():
    text = '{"capabilities": ["FIX", {"a": "]}"}], "domains": [], "n": 12, "s": "a\\"b", "o": {"x": [1]}, "bad": tru, "confidence": 0.8'
    assert L.members("Well: " + text) == {"capabilities": ["FIX", {"a": "]}"}], "domains": [], "n": 12, "s": 'a"b', "o": {"x": [1]}}
    assert L.members(text + ", ")["confidence"] == 0.8 and L.members("none") == {} and L.members("{") == {} and L.members('{"a": [1, 2') == {}
    assert L.payload_row('{"capabilities": ["FIX"], "domains": [')["error"]


def test_provenance_is_kept(spark, tmp_path):
    rows = frame(spark, [sample(0, "bug 0", caps=["OLD"], meta='{"x": {"y": 1.5}, "llm_labeling_error": {"method": "before"}}'), sample(1, "bug 1"), sample(2, "bug 2")])
    answers = ['{"capabilities": ["fix"], "domains": ["software"], "confidence": 0.5, "rationale": "so"}', "hm " * 300, '{"capabilities": ["fix"], "domains": ["art"], "rationale": "cut']

    def make():
        return lambda prompt: next(a for i, a in enumerate(answers) if f"bug {i}" in prompt)

    out = L.llm_label(rows, make, TAX, DOM, rules=Guardrails({}, {}, {}, ("never",), "CODE"), model="m1")
    IO.write_jsonl(out.select(*DDL_NAMES), str(tmp_path / "out"))
    back = IO.read_jsonl(spark, str(tmp_path / "out"), validate=True)
    meta = {r.id: json.loads(r.metadata) for r in back.collect()}
    first = meta["id0"]["capability_labeling"]
    assert first == {"taxonomy_version": "t", "method": "llm_json_v2", "model": "m1", "confidence": 0.5, "rationale": "so", "previous_capabilities": ["OLD"]}
    assert meta["id0"]["x"] == {"y": 1.5} and "llm_labeling_error" not in meta["id0"] and meta["id0"]["label_guardrails"]["method"] == "post_llm_guardrails_v1"
    assert len(meta["id1"]["llm_labeling_error"]["raw_response_preview"]) == 500 and meta["id2"]["llm_labeling_recovery"]["recovery"]
    assert [r.id for r in R.inspect(back, parse_errors=True).collect()] == ["id1"]
    weak = json.loads(L.relabel(rows, TAX, DOM, 0.3).orderBy("row_idx").first().metadata)["capability_labeling"]
    assert weak["method"] == "weak_heuristic_v1" and weak["evidence"] == [{"label": "FIX", "score": 0.45, "sources": ["heuristic_keyword"], "cues": ["bug"]}]
    scored_ = L.model_label(rows, lambda: lambda texts, candidates, hypothesis: [[0.9 if "task" in hypothesis else 0.0] * len(candidates) for _ in texts], TAX, DOM, model="nli").first()
    assert json.loads(scored_.metadata)["domain_labeling"]["scores"] == {"CODE": 0.9, "ART": 0.9}


DDL_NAMES = [c.split()[0] for c in DDL.replace(TURN_DDL, "x").split(", ")][1:]


def test_bad_rows_are_named(spark, tmp_path):
    good = {"id": "a", "source_dataset": "s", "sample_type": "agent", "messages": [{"role": "user", "type": "message", "content": "q", "trainable": False}], "quality_score": 0.5}
    for name, change, said in (("type", {"quality_score": "high"}, "type:quality_score"), ("role", {"messages": [{**good["messages"][0], "role": "king"}]}, "turn_role"), ("score", {"quality_score": 2}, "quality_score"), ("meta", {"metadata": []}, "type:metadata")):
        (tmp_path / name).write_text(json.dumps(good) + "\n\n" + json.dumps(good | change) + "\n")
        with pytest.raises(Exception, match=f"{name}:3: {said}"):
            IO.read_jsonl(spark, str(tmp_path / name), validate=True).collect()
    (tmp_path / "fine").write_text(json.dumps(good) + "\n" + json.dumps(good | {"success": None, "metadata": {"k": 1}}))
    got = IO.read_jsonl(spark, str(tmp_path / "fine"), validate=True).orderBy("row_idx").collect()
    assert [(r.row_idx, r.capabilities, r.metadata) for r in got] == [(0, [], "{}"), (1, [], '{"k":1}')]


def test_servers_and_backends():
    schema = L.response_schema(TAX, DOM, 3, 1)
    assert schema["properties"]["capabilities"]["items"]["enum"] == ["FIX", "PLAN", "TOOL_USE"] and schema["properties"]["domains"]["maxItems"] == 1
    assert {L.chat_url(x) for x in ("http://h", "http://h/v1/", "http://h/v1/chat/completions")} == {"http://h/v1/chat/completions"}
    assert L.chat_text({"choices": [{"message": {"content": [{"text": "a"}, {"image": 1}, {"text": "b "}]}}]}) == "a\nb"
    with pytest.raises(RuntimeError):
        L.http_generator("http://127.0.0.1:9", "m", timeout=1, schema=schema)()("x")
    own = lambda: str.upper
    assert L.generator_for(own, "http://h", model="m") is own and L.generator_for(local=own) is own
    with pytest.raises(ValueError):
        L.generator_for()


def test_generation_loop(spark):
    prompts = spark.createDataFrame([("a", "one"), ("b", "two")], "sample_id string, prompt string")
    got = {r.sample_id: r for r in R.generations(prompts, "m", lambda: lambda p: (p.upper(), len(p)), 2).collect()}
    assert got["a"].generation == "ONE" and got["a"].generated_tokens == 3 and got["b"].latency_seconds >= 0
    assert R.generations(prompts, "m", lambda: str.upper).first().generated_tokens is None


def test_relabel_export_and_examples(spark):
    rows = frame(spark, [sample(0, "a bug, a crash; fix it", caps=["OLD"]), sample(1, "paint", doms=["ART"]), sample(2, "zzz"), sample(3, "x", caps=["PLAN"], meta='{"capability_labeling": {"method": "manual_review_v1"}}')])
    got = {r.id: r for r in L.relabel(rows, TAX, DOM).collect()}
    assert got["id0"].capabilities == ["FIX"] and got["id0"].previous_capabilities == ["OLD"] and got["id2"].capabilities == []
    out = {r.id: r for r in L.classifier_rows(rows, TAX, DOM, min_score=0.45).collect()}
    assert set(out) == {"id0", "id1", "id3"} and out["id0"].label_vector == [1, 0, 0] and out["id1"].domain_vector == [0, 1] and out["id3"].label_vector == [0, 1, 0]
    assert L.classifier_rows(rows, TAX, DOM, include_unlabeled=True).count() == 4
    assert [e["capabilities"] for e in L.icl_examples(rows, TAX, DOM)] == [["PLAN"]]
    assert len(L.icl_examples(rows, TAX, DOM, allow_weak=True)) == 2
    asked = L.prompt_rows(rows, TAX, DOM).orderBy("id").first()
    assert "PLAN" in asked.prompt and json.loads(asked.metadata) == {"quality_score": 0.9, "success": None, "existing_capabilities": ["OLD"], "existing_domains": []}
    assert json.loads(out["id0"].metadata)["capabilities"] == ["OLD"]


def test_examples_equal_the_fold(spark):
    """Against the fold row by row; the list holds what the fold takes and the driver is sent no other row."""
    rng = random.Random(7)

    def fold(rows, names, per_label):
        left, out = dict.fromkeys(names, per_label), []
        for r in sorted(rows):
            caps, doms = sorted(set(r[5]) & set(names)), sorted(set(r[6]) & {"CODE", "ART"})
            if max(left.values()) <= 0:
                break
            if (caps or doms) and (not caps or any(left[c] > 0 for c in caps)):
                left = {n: left[n] - (n in caps) for n in left}
                out.append((r[1], caps, doms))
        return out

    pairs = [("FIX", "PLAN"), ("FIX",), (), ("PLAN",), ("FIX", "TOOL_USE"), ("NONE", "PLAN")]
    for caps, per_label in ((pairs, 2), (pairs, 5), (pairs[:4], 2), (pairs, 0), ([()], 2)):
        rows = [sample(i, caps=rng.choice(caps), doms=rng.choice([(), ("ART",), ("CODE", "ART")])) for i in range(60)]
        rng.shuffle(rows)
        got = L.icl_examples(frame(spark, rows), TAX, DOM, per_label, allow_weak=True)
        assert [(e["id"], e["capabilities"], e["domains"]) for e in got] == fold(rows, list(TAX.names), per_label)
    # FIX goes below zero before the others are full: the end must be found all the same
    rows = [sample(0, caps=("FIX", "PLAN")), sample(1, caps=("FIX", "TOOL_USE")), *(sample(i, doms=("ART",)) for i in range(2, 9))]
    assert len(L.icl_examples(frame(spark, rows), TAX, DOM, 1, allow_weak=True)) == 2


def test_examples_query_sends_no_rows_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(type(frame(spark, [sample(0)])), "toLocalIterator", lambda *_: pytest.fail("rows go to the driver"))
    rows = frame(spark, [sample(i, caps=("FIX",) if i % 2 else (), doms=("ART",)) for i in range(50)])
    monkeypatch.setattr(catalogue, "labelled", lambda *_: rows)
    monkeypatch.setattr(catalogue, "both", lambda: (TAX, DOM))
    assert catalogue.icl_examples(spark, "").count() == 27


def test_model_label(spark):
    def make():
        return lambda texts, candidates, hypothesis: [[0.9 if c in t else 0.1 for c in candidates] for t in texts]

    got = L.model_label(frame(spark, [sample(0, "software and fix")]), make, TAX, DOM).first()
    assert (got.capabilities, got.domains) == (["FIX"], ["CODE"])


def test_filters_and_scores(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [sample(0, long), sample(1, "short"), sample(2, "a b c d e " * 100), sample(3, long, success=True), sample(4, long, success=False), sample(5, long, quality=0.1)]
    df = frame(spark, rows)
    assert sorted(r.id for r in filtered(df).collect()) == ["id0", "id3", "id4", "id5"]
    assert [r.id for r in filtered(df, require_success=True).collect()] == ["id3"]
    assert "id5" not in [r.id for r in filtered(df, 0.45).collect()]
    score = {r.id: r.quality_score for r in scored(df).collect()}
    assert score["id0"] == 0.45 and score["id3"] == 0.7 and score["id4"] == 0.2 and score["id1"] == 0.35
    hit = lambda caps, doms: df.withColumns({"capabilities": F.array(F.lit("A"), F.lit("B")), "domains": F.array(F.lit("X"))}).where(matches_target(caps, doms)).count()
    assert [hit([], []), hit(["A", "B"], ["Y", "X"]), hit(["A", "C"], []), hit([], ["Y"])] == [6, 6, 0, 0]


def test_validation(spark):
    good = sample(0)
    bad = list(sample(1))
    bad[1], bad[3], bad[8] = "", "odd", 2.0
    bad[4] = [("tool", "final", "x", True, None, None), ("king", "message", "x", False, None, None)]
    df = frame(spark, [good, tuple(bad)])
    got = [r[0] for r in df.orderBy("row_idx").select(sample_errors()).collect()]
    assert got == [[], ["id", "quality_score", "sample_type", "tool_type", "trainable_role", "turn_role"]]
    with pytest.raises(Exception, match="invalid sample"):
        validated(df, strict=True).collect()


def test_json_round_trip(spark, tmp_path):
    df = frame(spark, [sample(0, "ü \"q\"\n"), sample(1, success=True, meta='{"a": {"b": 1}}')])
    line = json.loads(to_json_lines(df).orderBy("value").first().value)
    assert line["success"] is None and "name" not in line["messages"][0]
    IO.write_jsonl(df.coalesce(1), str(tmp_path / "a"))
    back = IO.read_jsonl(spark, str(tmp_path / "a"))
    assert sorted(map(tuple, back.collect()))[1][1:4] == ("id1", "s", "reasoning") and back.orderBy("id").first().messages[0].content == "ü \"q\"\n"
    both = IO.union_sources(spark, [str(tmp_path / "a"), str(tmp_path / "a")])
    assert sorted(r.row_idx for r in both.collect()) == [0, 1, 2, 3]
    (tmp_path / "bad").write_text('{"id": "x"}\n\n  \nnot json\n')
    with pytest.raises(Exception, match="bad:4 is no JSON object"):
        IO.read_jsonl(spark, str(tmp_path / "bad")).collect()


def test_shards_and_limits(spark, tmp_path):
    (tmp_path / "in").write_text("\n".join(json.dumps({"id": str(i)}) for i in range(6)))
    rows = IO.read_lines(spark, str(tmp_path / "in"))
    ids = lambda df: sorted(json.loads(r.value)["id"] for r in df.collect())
    assert ids(IO.shard_rows(rows, 3, 1)) == ["1", "4"] and ids(IO.shard_rows(rows, 1, 5)) == list("012345")
    assert ids(IO.limit_rows(rows, 2)) == ["0", "1"] and len(ids(IO.limit_rows(rows, 0))) == 6
    with pytest.raises(ValueError):
        IO.shard_rows(rows, 3, 3)
    many = frame(spark, [sample(i) for i in range(25)]).repartition(5)
    assert IO.write_shards(many, str(tmp_path / "out"), 4) == 7
    shards = {p.name: [json.loads(x)["id"] for f in p.glob("part-*") for x in f.read_text().splitlines()] for p in (tmp_path / "out").glob("shard=*")}
    assert shards == {f"shard={k:05d}": [f"id{i}" for i in range(4 * k, min(25, 4 * k + 4))] for k in range(7)}
    assert IO.write_shards(many.limit(0), str(tmp_path / "none"), 4) == 0 and IO.write_jsonl(many, str(tmp_path / "all")) == 25
    with pytest.raises(ValueError):
        IO.resolve_source("nowhere")
    assert IO.resolve_source("trove", path="/x").label == "trove" and IO.shard_prefix("a/b:c") == "a_b_c"


RAW = [
    {"task_id": "t1", "original_teacher": "m", "reward": 1.0, "messages": [{"role": "user", "content": "fix the code"}, {"role": "assistant", "content": "<think>hm</think>ok"}]},
    {"path": "p2", "result": " Failed ", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "out"}]},
    {"id": "t3", "reward": None, "success": True, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": " "}]},
    {"id": "t4", "messages": [{"role": "king", "content": "q"}]},
    {"id": "t5"},
    {"reward": "1.0", "messages": [{"role": "user", "content": "only this"}]},
]


def raw(spark, rows):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "row_idx long, value string")


def test_parse_trove(spark):
    got = {r.row_idx: r for r in parse(raw(spark, RAW), "agenttrove", "src", TAX, DOM).collect()}
    s = got[0].sample
    assert (s.id, s.success, s.sample_type) == ("t1", True, "coding") and [(m.type, m.trainable) for m in s.messages] == [("message", False), ("reasoning", True), ("final", True)]
    assert json.loads(s.metadata)["teacher_model"] == "m"
    assert got[1].sample.id == "p2" and got[1].sample.success is False and [m.role for m in got[1].sample.messages] == ["user", "assistant", "tool"]
    assert got[2].sample.success is None and len(got[2].sample.messages) == 1
    assert "unknown role" in got[3].error.message and got[4].sample is None and got[4].error.keys == ["id"]
    assert got[5].sample.success is None and len(got[5].sample.id) == 24


def test_parse_hermes(spark):
    rows = [{"id": "h", "category": "repair", "tools": "[x]", "conversations": [{"from": "human", "value": "a bug"}, {"from": "gpt", "value": "<tool_call>{}</tool_call>"}]}]
    s = parse(raw(spark, rows), "hermes", "src", TAX, DOM).first().sample
    assert (s.sample_type, s.success, s.capabilities, s.domains) == ("agent", None, ["FIX"], ["CODE"]) and json.loads(s.metadata)["tools_present"] is True
    with pytest.raises(ValueError):
        parse(raw(spark, rows), "other", "src")


def test_conversion(spark, tmp_path):
    rows = converted(raw(spark, RAW), "agenttrove", "src", 0.0, TAX, DOM, min_tokens=1)
    stats = {r.metric: r.value for r in conversion_stats(rows).collect()}
    assert stats == {"seen": 6, "parsed": 4, "written": 2, "skipped": 4, "errors": 2, "error:ValueError": 2}
    assert [r.row_idx for r in error_examples(rows, 1).collect()] == [3]
    (tmp_path / "in").mkdir()
    go = lambda: stream_convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), "agenttrove", "src", capabilities=TAX, domains=DOM, min_tokens=1).awaitTermination()
    (tmp_path / "in" / "a").write_text("\n".join(map(json.dumps, RAW)))
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (tmp_path / "in" / "b").write_text(json.dumps(RAW[0]))
    go()
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    stream_label(spark, str(tmp_path / "out"), str(tmp_path / "labelled"), str(tmp_path / "c2"), lambda df: L.relabel(df, TAX, DOM, 0.45)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "labelled")).count() == 3
    known = spark.createDataFrame([("t1",)], "id string")
    stream_label(spark, str(tmp_path / "out"), str(tmp_path / "rest"), str(tmp_path / "c3"), lambda df: L.relabel(df, TAX, DOM, 0.45), done=known).awaitTermination()
    assert "t1" not in {r.id for r in spark.read.parquet(str(tmp_path / "rest")).collect()}


def test_stream_filter_has_no_copy_of_the_conversion(spark, tmp_path):
    rows = converted(raw(spark, RAW), "agenttrove", "src", 0.0, TAX, DOM, min_tokens=1)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("\n".join(map(json.dumps, RAW)))
    query = stream_convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), "agenttrove", "src", capabilities=TAX, domains=DOM, min_tokens=1)
    query.awaitTermination()
    filters = [x for x in query._jsq.explainInternal(False).split("\n") if "Filter" in x]
    assert filters and not any("from_json" in x or "get_json_object" in x for x in filters)
    names = ["id", "sample_type", "messages", "capabilities", "domains", "success", "quality_score", "metadata"]
    want = sorted(map(str, rows.where("written").select(*names).collect()))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(*names).collect())) == want and len(want) == 2


def slow_fold(rows, budget):
    taken, total = [], 0
    for key, tokens in sorted(rows):
        if total + tokens > budget and taken:
            continue
        if total >= budget:
            break
        taken.append(key)
        total += tokens
    return taken, total


@pytest.mark.parametrize("fold", [0, 3, 50_000])
def test_budget_matches_the_fold(spark, monkeypatch, fold):
    monkeypatch.setattr(S, "FOLD", fold)
    rng = random.Random(fold)
    for budget in (0, 1, 30, 100, 400, 10_000):
        rows = [(f"{rng.getrandbits(64):016x}|{i}", rng.choice([1, 5, 20, 60, 300])) for i in range(80)]
        df = spark.createDataFrame(rows, "key string, tokens int").repartition(3)
        got = S.select_by_budget(df, budget)
        taken = sorted(r.key for r in got.of(df).collect())
        assert (taken, got.tokens) == slow_fold(rows, budget) if budget else (taken, got.tokens) == ([], 0)


def test_budget_of_the_default_size(spark):
    rng = random.Random(2)
    rows = [(f"{rng.getrandbits(64):016x}|{i}", rng.randint(64, 2000)) for i in range(12_000)]
    df = spark.createDataFrame(rows, "key string, tokens int")
    got = S.select_by_budget(df, 2_000_000)
    taken, total = slow_fold(rows, 2_000_000)
    assert len(taken) > 1500 and sorted(r.key for r in got.of(df).collect()) == taken and got.tokens == total


def test_subsets_do_not_leak(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        words = " ".join(rng.choice("abcdefghijklmnop") * rng.randint(2, 6) for _ in range(120))
        rows.append(sample(i, f"q{i // 3} {words}", caps=["FIX"] if i % 2 else ["PLAN"], meta=json.dumps({"original_id": str(i // 3)})))
    df = frame(spark, rows)
    got = S.build_subsets(df, ["FIX"], max_train_tokens=4000, eval_fraction=0.2, eval_most=6)
    ev, tr = got.evaluation.collect(), got.specialist.collect()
    assert 0 < len(ev) <= 6 and not {r.group_key for r in ev} & {r.group_key for r in tr}
    assert got.manifest["tokens"]["specialist_train"] == sum(r.tokens for r in tr) <= 4000
    assert sum(r.tokens for r in got.general.collect()) == got.manifest["tokens"]["general_train"]
    assert got.manifest["counts"] == {"specialist_train": len(tr), "general_train": got.general.count(), "target_eval": len(ev)}
    assert got.manifest["tokens"]["target_eval"] == sum(r.tokens for r in ev)
    again = S.build_subsets(df.repartition(7), ["FIX"], max_train_tokens=4000, eval_fraction=0.2, eval_most=6)
    assert sorted(r.id for r in again.specialist.collect()) == sorted(r.id for r in tr)
    lone = S.build_subsets(df, ["FIX"], max_train_tokens=400, eval_fraction=1e-9)
    assert lone.evaluation.count() == 1
    with pytest.raises(ValueError):
        S.build_subsets(df, target_ratio=0)


def test_reports(spark):
    rows = [sample(0, caps=["A", "A"], doms=["X"]), sample(1, caps=["B"], source="t"), sample(2, source=None, kind=None), sample(3, source="empty")]
    got = {(r.section, r.k1, r.k2): r.n for r in R.label_report(frame(spark, rows)).collect()}
    assert got["rows", None, None] == 4 and got["empty", None, None] == 2 and got["capabilities", "A", None] == 2
    assert got["sources", "unknown", None] == 1 and got["capabilities_by_source", "s", "A"] == 2
    assert got["capabilities_by_source", "empty", None] == 0 and ("capabilities_by_source", "s", None) not in got
    assert [(r.label, r.id) for r in R.label_examples(frame(spark, rows), 1).orderBy("label").collect()] == [("A", "id0"), ("B", "id1"), ("X", "id0")]
    long = " ".join(f"w{i}" for i in range(200))
    many = frame(spark, [sample(i, long, caps=["A"], doms=["X"]) for i in range(26)])
    targets = [{"id": "a", "target_capabilities": ["A"], "target_domains": ["X"]}, {"id": "none", "target_capabilities": ["Q"]}, {"id": "all"}]
    out = [(r.target, r.n, r.status, r.examples) for r in R.target_report(many, targets, examples=2).collect()]
    assert out == [("a", 26, "ready", ["id0", "id1"]), ("none", 0, "empty", None), ("all", 26, "ready", ["id0", "id1"])]


def test_inspect_and_sample(spark):
    rows = frame(spark, [sample(0, doms=["X"]), sample(1), sample(2, meta='{"llm_labeling_error": {}}'), sample(3, doms=["X"], source="t")])
    assert [r.id for r in R.inspect(rows, label="X").collect()] == ["id0", "id3"]
    assert [r.id for r in R.inspect(rows, empty=True, parse_errors=True).collect()] == ["id2"]
    assert [r.id for r in R.inspect(rows, label="X", limit=0).collect()] == ["id0"]
    for bad in ({}, {"label": "X", "axis": "other"}):
        with pytest.raises(ValueError):
            R.inspect(rows, **bad)
    many = frame(spark, [sample(i, source="a" if i % 2 else "b") for i in range(10)])
    got = R.stratified_sample(many, per_group=2)
    assert {r.grp: r.selected for r in R.sample_summary(many, got).collect()} == {"a": 2, "b": 2}
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in R.stratified_sample(many.repartition(5), per_group=2).collect())
    assert R.stratified_sample(many, per_group=0).count() == 10 and R.stratified_sample(many, limit=3).count() == 3
    with pytest.raises(ValueError):
        R.stratified_sample(many, "x")


def test_loss_mask_and_padding(spark):
    class Points:
        eos_id = 0

        def __call__(self, text):
            return [ord(c) for c in text]

    rows = frame(spark, [sample(0, "q", "a"), sample(1, "qq", "aaa")])
    got = {r.id: r for r in R.loss_mask(rows, Points, 1000).collect()}
    text = "<|user|>\nq\n<|assistant_final|>\na\n"
    assert got["id0"].input_ids == [*map(ord, text), 0] and got["id0"].labels == [-100] * (len(text) - 2) + [97, 10, 0]
    assert R.loss_mask(rows, Points, 5).first().input_ids == [ord(c) for c in text[:5]]
    many = R.loss_mask(frame(spark, [sample(i, "q", "a" * (1 + i % 5)) for i in range(23)]), Points, 1000)
    wide = R.padded(many, 7, 4).collect()
    size, by = {r.id: len(r.input_ids) for r in many.collect()}, {}
    for r in wide:
        by.setdefault(r.batch, []).append(r)
    assert len(wide) == 23 and max(map(len, by.values())) <= 4
    for rows in by.values():
        most = max(size[r.id] for r in rows)
        for r in rows:
            n = most - size[r.id]
            assert len(r.input_ids) == len(r.labels) == len(r.attention_mask) == most
            assert r.input_ids[size[r.id] :] == [7] * n and r.labels[size[r.id] :] == [-100] * n and sum(r.attention_mask) == size[r.id]


def test_loss_mask_holds_few_ids(spark):
    class Grown:
        """20,000 ids a text; the first is by how many MB the process has grown."""

        eos_id = None

        def __init__(self):
            self.before = self.now()

        def now(self):
            with open("/proc/self/statm") as f:
                return int(f.read().split()[1]) * 4096 >> 20

        def __call__(self, text):
            return [max(0, self.now() - self.before), *range(1000, 20999)]

    rows = frame(spark, [sample(i) for i in range(100)]).coalesce(1)
    got = R.loss_mask(rows, Grown, 1 << 30).select(F.size("input_ids").alias("n"), F.element_at("input_ids", 60001).alias("mb"), F.size(F.filter("labels", lambda x: x != -100)).alias("kept"))
    assert got.agg(F.count("*"), F.min("n"), F.max("n"), F.min("kept"), F.max("kept")).first() == (100, 80000, 80000, 20000, 20000)
    assert got.agg(F.max("mb")).first()[0] < 100


def test_padding_over_many_arrow_batches(spark):
    """Batches filled across Arrow batches of seven rows and sent on in several parts; labels longer than the ids stay."""
    n = 3000
    rows = spark.range(n).select(F.format_string("%05d", "id").alias("id"), F.sequence(F.lit(1), (F.col("id") % 997 + 1).cast("int")).alias("input_ids"))
    rows = rows.select("id", "input_ids", F.when(F.col("id") == "00000", F.array(F.lit(5), F.lit(6))).otherwise(F.transform("input_ids", lambda x: -x)).alias("labels"), F.transform("input_ids", lambda x: F.lit(1)).alias("attention_mask"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = R.padded(rows, 7, 4).orderBy("id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for r in got:
        by.setdefault(r.batch, []).append(r)
    assert [r.id for r in got] == [f"{i:05d}" for i in range(n)] and sum(len(x) < 4 for x in by.values()) <= 4
    for i, r in enumerate(got):
        size, wide = i % 997 + 1, max(int(x.id) % 997 + 1 for x in by[r.batch])
        pad = wide - size
        assert r.input_ids == [*range(1, size + 1), *[7] * pad] and r.attention_mask == [1] * size + [0] * pad
        assert r.labels == ([-x for x in range(1, size + 1)] + [-100] * pad if i else [5, 6] + [-100] * (wide - 2))


def test_measures_are_kept(spark):
    assert {"joined_text", "tokens", "repetition"} <= set(measured(frame(spark, [sample(0)])).columns)
