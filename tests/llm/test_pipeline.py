"""The pipeline against its stages in plain Python, on small tables."""

import random
import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as C
from sparloom.llm.queries import tokenizer_path
from test_decontaminate import slow as slow_hits
from test_mixing import slow_copies, slow_pick, slow_targets
from test_simhash import slow_components, slow_fingerprint
from test_toxicity import BAD, VOCAB


def made(seed):
    rng = random.Random(seed)
    bench = [(i, " ".join(rng.choice(VOCAB) + rng.choice("abc") for _ in range(15))) for i in range(5)]
    docs = []
    for i in range(260):
        words = [rng.choice(VOCAB) + rng.choice(["", "s", "ing", "er"]) for _ in range(rng.randint(20, 60))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        if i % 10 == 3:
            words[3:3] = bench[i % 5][1].split()
        docs.append([i, " ".join(words), "en", f"s{i % 4}", 0])
    docs += [[300 + i, docs[4 * i + 1][1], "en", "s1", 0] for i in range(10)] + [[400, None, None, None, None], [401, "", "en", "s2", 0]]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(260)]
    return docs, labels, bench


def test_pipeline_matches_brute_force(spark, tmp_path):
    docs, labels, bench = made(6)
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([tuple(d) for d in docs], ddl).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    # stage by stage, each written and read again
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for i, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{i}"))
        now = spark.read.parquet(str(tmp_path / f"stage{i}"))
        kept[name] = now.collect()
        if name != "token_files":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    by = {d[0]: d for d in docs}
    left = [r.doc_id for r in kept["toxicity"]]
    toxic = {i for i, t in ((d[0], d[1]) for d in docs) if t and any(b in t for b in BAD)}
    assert len(set(left) & toxic) <= 0.05 * len(toxic) and len(set(by) - set(left) - toxic) <= 0.02 * len(by)
    fps = [slow_fingerprint(by[i][1]) for i in left]
    roots = slow_components(fps)
    groups = {}
    for i, r in zip(left, roots):
        groups.setdefault(r, []).append(i)
    want = sorted(min(g) for g in groups.values())
    assert sorted(r.doc_id for r in kept["near_duplicates"]) == want
    want = [i for i in want if not slow_hits(by[i][1], [(str(a), b) for a, b in bench], 10)[1]]
    assert sorted(r.doc_id for r in kept["decontamination"]) == want
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", by[i][1] or "")) for i in want}
    source = {}
    for i in want:
        source[by[i][3]] = source.get(by[i][3], 0) + sizes[i]
    goal = slow_targets(source)
    rate = {s: goal[s] / n if n else 0 for s, n in source.items()}
    pick = {s: slow_pick([(i, by[i][1], sizes[i]) for i in want if by[i][3] == s], rate[s], goal[s]) for s in source}
    mixed = sorted(i for i in want for _ in range(slow_copies(i, by[i][1], rate[by[i][3]], pick[by[i][3]])))
    assert sorted(r.doc_id for r in kept["mixing"]) == mixed
    tk, start, rows = Tokenizer.from_file(tokenizer_path()), 0, []
    for i in mixed:
        ids = [*tk.encode(by[i][1] or "", add_special_tokens=False).ids, 2]
        rows.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in kept["token_files"]) == rows
    assert sorted(tuple(r) for r in C.run(spark, str(tmp_path)).collect()) == rows
