"""The catalogue's queries against their SQL on the smallest tables, the command line, and the library without corpus operators."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from sparloom import cli
from sparloom.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
REPO = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sql, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
    found = sql.execute(catalogue.SQL[name])
    columns = [c[0] for c in found.description]
    want = sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in found.fetchall()), key=str)
    assert sorted(columns) == sorted(df.columns) and got == want


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, str(DATA)).count() > 0


def test_commands(spark, tmp_path, capsys):
    raw = [{"id": f"r{i}", "reward": i % 2, "messages": [{"role": "user", "content": f"the rest of it from the east {i}"}, {"role": "assistant", "content": "it was this " * 40}]} for i in range(6)]
    (tmp_path / "raw").write_text("\n".join(map(json.dumps, [*raw, {"id": "bad"}])))
    at = lambda n: str(tmp_path / n)

    def run(*argv):
        cli.main(list(argv))
        return json.loads(capsys.readouterr().out)

    assert run("convert", at("raw"), at("canon"), "--skip-errors", "--min-tokens", "1")["parsed"] == 6
    assert run("stream-convert", at("raw"), at("streamed"), "--skip-errors", "--min-tokens", "1", "--min-quality", "0.5")["seen"] == 7
    assert run("filter", at("canon"), at("kept"), "--min-tokens", "1", "--max-repetition", "1")["written"] == 6
    assert run("relabel-capabilities", at("canon"), at("labelled"), "--min-score", "0.5")["counts"]
    made = run("llm-label", at("canon"), at("llm"), "--stub")
    assert made["written"] == 6
    assert run("inspect-sample", at("llm"), "--parse-errors")["count"] == min(5, made["parse_errors"])
    assert run("label-report", at("labelled"), "--top-examples", "1")["examples"]
    assert len(run("target-report", at("labelled"), "--min-tokens", "1", "--min-quality", "0")["targets"]) == 5
    assert run("inspect-sample", at("labelled"), "--label", "RECALL", "--axis", "capabilities")["count"] == 5
    assert run("sample-jsonl", at("labelled"), at("some"), "--max-per-group", "2")["groups"][0]["selected"] == 2
    assert run("write-labeling-probes", at("probes"))["written"] == 13
    assert run("probe-report", at("probes"))["rows"] == 13
    assert run("export-classifier-data", at("labelled"), at("export"))["written"] == 6
    assert run("export-labeling-prompts", at("labelled"), at("prompts"), "--examples", at("labelled"), "--allow-weak-examples")["examples"] > 0
    assert run("build-subsets", at("labelled"), at("sets"), "--capability", "RECALL", "--min-tokens", "1", "--min-quality", "0", "--eval-fraction", "0.3")["counts"]
    assert run("list-specialist-targets")["targets"]
    (tmp_path / "tax.json").write_text('{"domains": {"X": {"description": "d"}}}')
    run("taxonomy-docs", at("tax.json"), at("tax.md"))
    assert "## X" in (tmp_path / "tax.md").read_text()
    (tmp_path / "gen").write_text("\n".join(json.dumps({"model_name": "m", "sample_id": f"r{i}", "generation": "patch", "latency_seconds": 1, "generated_tokens": 2}) for i in range(6)))
    (tmp_path / "eval.json").write_text(json.dumps({"samples": at("canon"), "generations": at("gen"), "output": at("scores")}))
    assert run("eval", at("eval.json"))["m"]["patch_intent_rate"] == 1.0
    (tmp_path / "loop.json").write_text(json.dumps({"samples": at("canon"), "models": {"stub": {"generator": "sparloom.operators.labeling:stub_generator"}}, "output": at("loop")}))
    assert run("eval", at("loop.json"))["stub"]["count"] == 6
    from public_tokenizers import path

    (tmp_path / "sft.json").write_text(json.dumps({"train": at("canon"), "tokenizer": str(path("byte_bpe_50k.json")), "eos_id": 50256, "output": at("sft")}))
    assert run("train-sft", at("sft.json"))["examples"] == 6


def test_library_stands_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})


def test_errors_inside_the_corpus_operators_are_raised(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    (copy / "sparloom" / "llm" / "common.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode and "no_such_module" in done.stderr


def test_padded_batches_moves_sizes_not_ids(spark):
    plan = catalogue.QUERIES["padded_batches"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    below = plan.children().head().children().head().output().toString()  # what the window gets
    assert "wide#" in below and "input_ids#" not in below and "attention_mask#" not in below
