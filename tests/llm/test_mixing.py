import hashlib
import random
import re
from collections import Counter, defaultdict

from sparloom.llm import mixing as M


def slow_targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        share = left / sum(w[s] for s in free) if free and total else 0.0
        new = {s for s in free if w[s] * share >= most * sizes[s]} if total else set()
        if not new:
            return {s: most * sizes[s] if s in full else w[s] * share for s in names}
        full |= new


def slow_copies(doc_id, text, rate, pick, seed=42):
    name = str(doc_id) if doc_id is not None else "text " + hashlib.md5((text or "").encode()).hexdigest()
    draw = int(hashlib.md5(f"{seed}:{pick}:{name}".encode()).hexdigest()[:13], 16) / 2**52
    return int(rate) + (draw < rate - int(rate))


def slow_pick(rows, rate, target):
    """rows: (doc_id, text, size) of a source."""
    return min(range(M.SEEDS), key=lambda k: (abs(sum(slow_copies(d, t, rate, k) * n for d, t, n in rows) - target), k))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, _source string")


def test_plan_matches_brute_force(spark):
    rng = random.Random(2)
    for case in range(4):
        sources = [None, "a", "B", "é", "\U0001f600", "￿", ""][: rng.randint(1, 7)]
        rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "a b", "x " * rng.randint(1, 400), "l\x0bm\x1cn o"]), rng.choice(sources) if case else sources[min(i, len(sources) - 1)], 5, "z") for i in range(60)]
        rows += rows[:2]
        n = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
        sizes = Counter()
        for (_, _, s, *_), k in zip(rows, n):
            sizes[s] += k
        goal = slow_targets(sizes)
        got = M.mixing_plan(table(spark, rows), keep=["doc_id", "text", "source"]).collect()
        assert len(got) == len(rows)
        by = {(r.doc_id, r.text, r.source): r for r in got}
        for (d, t, s, *_), k in zip(rows, n):
            r = by[d, t, s]
            assert (r.size, r.source_size) == (k, sizes[s])
            assert abs(r.target - goal[s]) <= 1e-9 * max(1, goal[s])
            same = [(a, b, k) for (a, b, c, *_), k in zip(rows, n) if c == s]
            assert r.pick == slow_pick(same, r.rate, r.target) and r.copies == (slow_copies(d, t, r.rate, r.pick) if sizes[s] else 0) and r.copies <= 3


def test_mix_emits_copies_and_keeps_columns(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5}", i, "q") for i in range(300)]
    docs = table(spark, rows)
    plan = {r.doc_id: r.copies for r in M.mixing_plan(docs).collect()}
    mixed = M.mix_sources(docs)
    assert mixed.columns == docs.columns
    got = Counter(r.doc_id for r in mixed.collect())
    assert got == Counter({k: v for k, v in plan.items() if v})
    again = Counter(r.doc_id for r in M.mix_sources(docs.repartition(7)).collect())
    assert got == again
    taken = defaultdict(int)
    for r in M.mixing_plan(docs, keep=["source"]).collect():
        taken[r.source, r.target] += r.copies * r.size
    assert all(abs(v - t) < 0.02 * t for (_, t), v in taken.items())


def test_many_sources_and_empty(spark):
    rows = [(i, "w " * (1 + i % 11), f"s{i * 7919 % 1000:04d}", i, "q") for i in range(1000)]
    goal = slow_targets({s: len(t.split()) for _, t, s, *_ in rows})
    for r in M.mixing_plan(table(spark, rows), keep=["source"]).collect():
        assert abs(r.target - goal[r.source]) < 1e-9 * max(1, goal[r.source])
    assert M.mixing_plan(table(spark, rows).limit(0)).count() == 0
    assert M.mixing_plan(table(spark, [(1, None, "a", 1, ""), (2, "", None, 1, "")])).select("copies").distinct().collect()[0][0] == 0
