import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparloom.llm import simhash as S


def slow_fingerprint(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in low).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    """Smallest index reachable, over links at 2 or fewer bits."""
    a = np.array(fps, np.uint64)
    label = np.arange(len(a))
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 2
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label.tolist()
        label = new


TEXTS = [None, "", " \t", "One", "one", "a b", "É une chose", "the same text here " * 9, "The SAME text here " * 9, "x" * 100_000, "word " * 70_000, "a\x1cb c d e", "1 2 3 4 5 6"]


def test_fingerprint_matches_brute_force():
    rng = random.Random(5)
    texts = [t for t in TEXTS if len(t or "") < 1000] + [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for t in texts:
        assert S.fingerprint((t or "").encode()) == slow_fingerprint(t)


@pytest.mark.parametrize("crowd", [2, 16, 1000])
def test_links_lose_nothing(spark, crowd):
    rng = random.Random(crowd)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for base in list(fps)[:30]:
        for _ in range(rng.randint(1, 6)):
            x = base
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    hub = rng.getrandbits(64)
    fps |= {hub ^ (1 << i) ^ (1 << rng.randrange(64)) for i in range(60)}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "doc_id long, fp long")
    edges = S.links(docs.select("fp"), crowd)
    rows = {r.node: r.root for r in S.components(edges).collect()}
    want = slow_components(fps)
    got = {}
    for i, x in enumerate(signed):
        got.setdefault(rows.get(x, x), []).append(i)
    named = {i: min(g) for g in got.values() for i in g}
    assert [named[i] for i in range(len(fps))] == want


def test_rows_nulls_ties_and_clashing_names(spark):
    rows = [(i, t, "a", "b") for i, t in enumerate(TEXTS)] + [(None, "One", "a", "b"), (4, "one", "a", "b"), (4, "one", "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, _key string")
    got = S.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = [slow_fingerprint(t) if len(t or "") < 1000 else S.fingerprint(t.encode()) for _, t, *_ in rows]
    roots = slow_components(fps)
    want = sorted(((r[0], np.uint64(f).view(np.int64).item(), min(x[0] for x, q in zip(rows, roots) if q == root and x[0] is not None)) for r, f, root in zip(rows, fps, roots)), key=str)
    assert sorted(((g.doc_id, g.fp, g.component_id) for g in got), key=str) == want
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted({w[2] for w in want})


def test_null_ids_only_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "other words in here")], "doc_id long, text string")
    assert {r.component_id for r in S.near_duplicates(docs).collect()} == {None}
    assert S.drop_near_duplicates(docs).count() == 2
    assert S.near_duplicates(docs.limit(0)).count() == 0
    assert S.drop_near_duplicates(docs.limit(0)).count() == 0


def test_chain_is_the_pigeonring_condition(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.randint(0, 4)):
            b ^= 1 << rng.randrange(64)
        pairs.append((a, b))
    signed = [tuple(np.array(p, np.uint64).view(np.int64).tolist()) for p in pairs]
    df = spark.createDataFrame(signed, "a long, b long")
    got = df.select(*[S.chain_holds(S.turned(F.col("a"), F.lit(i)), S.turned(F.col("b"), F.lit(i))).alias(f"c{i}") for i in range(16)]).collect()
    for (a, b), row in zip(pairs, got):
        d = [((a ^ b) >> (60 - 4 * s) & 15).bit_count() for s in range(16)]
        want = [all(sum(d[(i + j) % 16] for j in range(k)) <= k * 2 // 16 for k in range(1, 17)) for i in range(16)]
        assert list(row) == want
        assert any(want) == (bin(a ^ b).count("1") <= 2)


def test_rows_that_differ_in_where_a_null_stands_are_two(spark):
    from sparloom.llm.common import row_key

    text = "alpha beta gamma delta"
    rows = [(1, text, None), (1, None, text), (2, "something else that is no copy", None), (2, "something else that is no copy", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string")
    assert docs.select(row_key(docs).alias("k")).distinct().count() == 3
    assert sorted(map(tuple, S.drop_near_duplicates(docs).collect()), key=str) == sorted(rows[:3], key=str)
