import random
import re

import numpy as np
import pytest

from sparloom.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def slow(text, items, window):
    w = words(text)
    hit, found, longest = set(), set(), 0
    for name, t in items:
        v = words(t)
        grams = [tuple(v[i : i + window]) for i in range(max(1, len(v) - window + 1))] if v else []
        for g in grams:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    found.add(name)
        for i in range(len(w)):
            for j in range(len(v)):
                k = 0
                while i + k < len(w) and j + k < len(v) and w[i + k] == v[j + k]:
                    k += 1
                if k >= min(window, len(v)) and k:
                    longest = max(longest, k)
    return len(w), len(hit), sorted(found), longest


def made(seed, n=40):
    rng = random.Random(seed)
    vocab = ["a", "B", "c", "été", "d1", "e"]
    items = [(str(i), " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 5, 6, 9, 14])))) for i in range(12)]
    docs = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(items)[1] if rng.random() < 0.4 else " ".join(rng.choice([*vocab, "zz", "q-q"]) for _ in range(rng.randint(0, 15))))
        docs.append(", ".join(parts).upper() if rng.random() < 0.3 else "\n".join(parts))
    return items, docs


@pytest.mark.parametrize("window", [3, 5, 10])
def test_shard_matches_brute_force(window):
    for seed in range(6):
        items, docs = made(seed)
        if window == 10:
            items = [x for x in items if len(words(x[1])) > 4]
        block = D.Block([(a, b.encode()) for a, b in items], window)
        for text, (n, runs, names, longest) in zip(docs, D.match_shard([d.encode() for d in docs], block), strict=True):
            want = slow(text, items, window)
            assert (n, sum(b - a for a, b in runs), names, longest) == want


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(1)
    text = rng.integers(-1, 3, 400).astype(np.int32)
    order = D.suffix_array(text, 400)
    cut = [tuple(text[i : i + np.flatnonzero(np.append(text[i:], -1) == -1)[0] + 1].tolist()) for i in order]
    assert cut == sorted(cut)


@pytest.mark.parametrize("block_bytes", [1, 60, 1 << 20])
def test_operator_over_blocks(spark, block_bytes):
    items, docs = made(3)
    rows = [(i, t, "x", 1) for i, t in enumerate(docs)] + [(None, docs[0], "x", 1), (3, docs[3], "x", 1), (7, None, None, None), (8, "", "", 0), (9, "a " * 60_000, "", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, runs string, _doc int")
    bench = spark.createDataFrame([(int(a), b) for a, b in items] + [(99, None)], "item_id long, text string")
    got = D.benchmark_matches(table, bench, window=5, block_bytes=block_bytes).collect()
    want = [(i, *slow(t, items, 5)) for i, t, *_ in rows[:-1]] + [(9, *next((n, sum(b - a for a, b in r), x, m) for n, r, x, m in D.match_shard([rows[-1][1].encode()], D.Block([(a, b.encode()) for a, b in items], 5))))]
    assert sorted(((g.doc_id, g.n_words, g.n_hit, g["items"], g.longest) for g in got), key=str) == sorted(want, key=str)
    kept = D.drop_contaminated(table, bench, window=5, block_bytes=block_bytes)
    assert kept.columns == table.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((w[0] for w in want if not w[2]), key=str)


def test_empty_tables(spark):
    items, docs = made(1)
    table = spark.createDataFrame([(1, docs[0])], "doc_id long, text string")
    bench = spark.createDataFrame([(1, docs[0])], "item_id long, text string")
    assert D.benchmark_matches(table.limit(0), bench).count() == 0
    assert [r.n_hit for r in D.benchmark_matches(table, bench.limit(0)).collect()] == [0]
    assert D.drop_contaminated(table, bench.limit(0)).count() == 1
