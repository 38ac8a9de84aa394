import itertools
import math
import random
import zlib

import numpy as np
import pytest

from sparloom.llm import queries as Q
from sparloom.llm import toxicity as T


def slow_kernel(a, b):
    """Shared subsequences of three symbols within SPAN, over the norms of stretches of these lengths without repeats."""
    some = lambda s: [(c, T.DECAY ** (c[2] - c[0] + 1)) for c in itertools.combinations(range(len(s)), 3) if c[2] - c[0] < T.SPAN]
    norm = lambda s: math.sqrt(sum(w * w for _, w in some(s)))
    total = sum(v * w for x, v in some(a) for y, w in some(b) if all(a[i] == b[j] for i, j in zip(x, y)))
    return total / (norm(a) * norm(b))


def coded(words):
    rows = np.zeros((len(words), T.LONGEST), np.uint8)
    for i, w in enumerate(words):
        rows[i, : len(w)] = [T.BLANK if c == "_" else T.SIGN if c == "-" else T.CODES[ord(c)] for c in w]
    return rows, np.array([len(w) for w in words])


def spelled(rows, size):
    name = {int(T.CODES[i]): chr(i) for i in range(255, 0, -1) if T.CODES[i]} | {T.BLANK: "_", T.SIGN: "-"}
    return ["".join(name[int(c)] for c in r[:n]) for r, n in zip(rows, size)]


def test_kernel_matches_brute_force():
    words = ["_abc_", "_abcab_", "_aqbc_", "_idiot_", "_id-iot_", "_éab_", "_drop_dead_", "_drop_deadly_"]
    got = T.kernel_matrix(*coded(words), *coded(words), group=3)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(got[i, j] - slow_kernel(a, b)) < 1e-4


def test_collapsed_weights_equal_the_sum_over_landmarks():
    rng = random.Random(1)
    words = ["_" + "".join(rng.choice("abcdeé_") for _ in range(rng.randint(2, 24))) + "_" for _ in range(40)]
    marks, beta = words[:12], np.random.default_rng(0).normal(size=12)
    m = T.Machine(*coded(marks), beta, 0.3)
    assert np.allclose(m.values(*coded(words)), T.kernel_matrix(*coded(words), *coded(marks)) @ beta + 0.3, atol=2e-3)


def all_stretches(text):
    rows, size, of = T.stretches([text])
    assert not of.any() and len(rows) == len(size)
    return sorted(spelled(rows, size))


def test_stretches():
    assert all_stretches("Drop dead! You...") == ["_dead_", "_drop_", "_drop_dead_", "_you_"]
    assert all_stretches("piece of\ngarbage") == ["_garbage_", "_of_", "_of_garbage_", "_piece_", "_piece_of_"]
    assert "_idiot_" in all_stretches("i . d . i . o . t") and "_idiot_" in all_stretches("an i.d-iot!") and "_stupid_" in all_stretches("st up id")
    assert "_stu_pid_" in all_stretches("stu pid") and "_idiot_" in all_stretches("1d10t") and "_1d10t_" in all_stretches("1d10t")
    assert all_stretches("** ?!") == [] and all_stretches("") == [] and all_stretches("no") == ["_no_"]
    assert all_stretches("One end. Two") == ["_end_", "_one_", "_one_end_", "_two_"]
    long = all_stretches("a" * 60 + "bcdef")
    assert all(len(x) == T.LONGEST for x in long) and any(x.endswith("bcdef_") for x in long)
    rows, size, of = T.stretches(["a b", "", "c"])
    assert sorted(zip(of.tolist(), spelled(rows, size))) == [(0, "_a_"), (0, "_a_b_"), (0, "_ab_"), (0, "_b_"), (2, "_c_")]


def test_long_texts_are_read_in_parts(monkeypatch):
    m = T.Machine(*coded(["_grobnak_"]), np.ones(1), 0.0)
    text = ("river wall " * 30 + "grobnak " + "house " * 50).encode()
    whole = m.margins([text, b"x"])
    monkeypatch.setattr(T, "PART", 300)
    assert np.allclose(m.margins([text, b"x"]), whole) and whole[0, 0] > 0.9 and whole[0, 1] > 0
    assert m.margins([b"\xff\xfe gro\xffbnak"])[0, 0] > T.LOWEST


VOCAB = ["".join(x) for x in itertools.product(["ri", "sto", "gree", "wal", "hou", "ne", "lit"], ["ver", "ne", "king", "se", "tle", "per", "den"])]
BAD = ["grobnak", "zufflep", "wimblort"]


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(VOCAB) + rng.choice(["", "s", "ing", "er"]) for _ in range(rng.randint(5, 40))]
        bad = rng.random() < 0.25
        if bad:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words) + ".", int(bad)))
    return rows


def test_held_out_accuracy_and_disguises(spark, tmp_path):
    rows = made(600, 3)
    docs = [(i, t, "x") for i, t, _ in rows] + [(9000, "you g r o b n a k there", "x"), (9001, "what a zuf-flep", "x"), (9002, "a wimbxlort", "x"), (9006, "g . r . o . b . n . a . k", "x"), (9007, "so gr ob na k it", "x"), (9003, None, "x"), (9004, "", "x"), (9005, "the river " * 50_000, "x"), (3, rows[3][1], "x")]
    spark.createDataFrame(docs, "doc_id long, text string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = Q.op1_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    truth = {i: y for i, _, y in rows}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [i for i in truth if by[i].held_out]
    assert sum(by[i].predicted == truth[i] for i in held) >= 0.95 * len(held)
    assert all(by[i].predicted for i in (9000, 9001, 9002))
    assert by[9006].predicted == 1 and by[9007].predicted == 1
    assert not any(by[i].predicted for i in (9003, 9004, 9005))
    assert by[9003].score == by[9004].score


def test_insults_of_two_ordinary_words():
    rng = random.Random(9)
    rows = []
    for i in range(800):
        words = [rng.choice([*VOCAB, "drop", "dead"]) for _ in range(rng.randint(8, 30))]
        while any(a == "drop" and b == "dead" for a, b in itertools.pairwise(words)):
            rng.shuffle(words)
        toxic = i % 4 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = ["drop", "dead"]
        rows.append((" ".join(words).encode(), int(toxic)))
    m = T.train([t for t, _ in rows[:600]], [y for _, y in rows[:600]])
    got = m.scores(m.margins([t for t, _ in rows[600:]])) >= 0.5
    assert (got == np.array([y for _, y in rows[600:]])).mean() >= 0.95


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = made(300, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, _, y in rows]
    a = T.train_on(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = T.train_on(docs.repartition(5), spark.createDataFrame(flip, "doc_id long, toxic int"))
    assert (a.weights == b.weights).all() and (a.slope == b.slope).all() and a.shift == b.shift


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1), (2, 1)]])
def test_without_both_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a word"), (2, None)], "doc_id long, text string")
    machine = T.train_on(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert machine is None
    assert [r.score for r in T.toxicity_scores(docs, machine).collect()] == [0.0, 0.0]
    assert T.drop_toxic(docs, machine).count() == 2
    assert T.toxicity_scores(docs.limit(0), machine).count() == 0
