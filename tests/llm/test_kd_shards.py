import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from sparloom.llm import kd_shards as K


def check(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(0 <= s < shards for s in by)
    for got in by.values():
        assert sorted(r.slot for r in got) == list(range(len(got)))
    return [sum(r.size for r in by[s]) for s in range(shards)]


def made(n, seed=1):
    rng = random.Random(seed)
    docs = [(i, "x" * int(rng.lognormvariate(6, 1)) + str(i % 500), rng.choice(["en", "de", None]), f"s{rng.randint(0, 5)}", "z") for i in range(n)]
    return docs + [(n + i, "hot text " * 20, "en", "s0", "z") for i in range(n // 2)]


def test_bytes_are_near_equal_and_groups_whole(spark):
    docs = made(1500)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, shard string").withColumns({c: F.lit(c) for c in ("slot", "size", "group", "part", "bin", "node")})
    rows = K.kd_shards(frame, 7).collect()
    assert len(rows) == len(docs)
    by = {d[0]: d for d in docs}
    assert all((r.size, r.text_crc32) == (len(by[r.doc_id][1].encode()) + 16, zlib.crc32(by[r.doc_id][1].encode())) for r in rows)
    sizes = check(rows, 7)
    mean = sum(sizes) / 7
    assert all(abs(s - mean) < 0.1 * mean for s in sizes)
    where = defaultdict(set)
    for r in rows:
        where[by[r.doc_id][1]].add(r.shard)
    assert sum(len(w) > 1 for w in where.values()) <= 1  # the hot group
    again = {(r.doc_id, r.shard, r.slot) for r in K.kd_shards(frame.repartition(9), 7).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_odd_tables(spark):
    ddl = "doc_id long, text string, lang string, source string"
    rows = [(1, None, None, None), (2, "", "en", None), (None, "é", None, "s"), (3, "a" * 50_000, "en", "s"), (3, "a", "en", "s"), (3, "a", "en", "s")]
    frame = spark.createDataFrame(rows, ddl)
    got = K.kd_shards(frame, 40).collect()
    assert len(got) == 6 and sum(check(got, 40)) == sum(len((t or "").encode()) + 16 for _, t, *_ in rows)
    assert K.kd_shards(frame, 1).select("shard").distinct().collect()[0][0] == 0
    assert K.kd_shards(frame.limit(0), 40).count() == 0


def slow_tree(units, dims, node, k, out):
    """Units (id, weight, tie, dims) of a node that holds k shards: the widest dimension, sorted, cut where the weight is nearest."""
    if k == 1 or not units:
        out.update((u["group"], node) for u in units)
        return
    width = [max(u[d] for u in units) - min(u[d] for u in units) for d in dims]
    d = dims[width.index(max(width))]
    key = lambda u: (int(u[d] * float(K.TOP)), u["tie"])
    units = sorted(units, key=key)
    want, at = sum(u["weight"] for u in units) * (k // 2) / k, 0
    for i, u in enumerate(units):
        if at + u["weight"] >= want:
            cut = i if want - at < at + u["weight"] - want else i + 1
            break
        at += u["weight"]
    slow_tree(units[:cut], dims, node, k // 2, out)
    slow_tree(units[cut:], dims, node + k // 2, k - k // 2, out)


def test_tree_matches_brute_force(spark):
    rng = random.Random(5)
    places = [i / 7 for i in range(8)]
    units = [{"group": i, "part": 0, "weight": rng.randint(16, 4000), "tie": rng.getrandbits(31), "lang": rng.choice(places[:3]), "source": rng.choice(places)} for i in range(700)]
    frame = spark.createDataFrame([tuple(u.values()) for u in units], "group long, part int, weight long, tie long, lang double, source double")
    for shards in (2, 7, 40):
        want: dict = {}
        slow_tree(units, ["lang", "source"], 0, shards, want)
        assert {r.group: r.node for r in K.split_units(frame, shards, ["lang", "source"], slack=0, heavy_share=1e9).collect()} == want


def test_heavy_groups_stay_whole_and_shards_even(spark):
    rng = random.Random(8)
    docs = [(i, "".join(rng.choice("abcdef ") for _ in range(rng.randint(50, 400))), "en", f"s{rng.randint(0, 3)}") for i in range(3000)]
    for g in range(6):  # groups of 0.3 to 0.9 of a shard
        docs += [(10_000 * (g + 1) + i, f"group {g} " * 20, "en", "s1") for i in range(45 + 25 * g)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    rows = K.kd_shards(frame, 20).collect()
    sizes = check(rows, 20)
    where = defaultdict(set)
    for r in rows:
        where[r.text_crc32].add(r.shard)
    assert all(len(w) == 1 for w in where.values())
    assert max(sizes) < 1.03 * sum(sizes) / 20 and min(sizes) > 0.97 * sum(sizes) / 20


def test_many_shards(spark):
    frame = spark.range(12_000).selectExpr("id as doc_id", "concat('text ', id) as text", "cast(id % 5 as string) as lang", "cast(id % 17 as string) as source")
    rows = K.kd_shards(frame, 1500).collect()
    sizes = check(rows, 1500)
    assert len(rows) == 12_000 and all(0.7 < s * 1500 / sum(sizes) < 1.4 for s in sizes)
