"""SimHash near-duplicates found by pigeonring filtering (operator 3).

Fingerprint: lower-case A-Z, words between ASCII white space, `shingle_words`-word shingles with repeats (fewer words:
the whole sequence), XXH64 with seed 42 of each; a bit is 1 if it is set in over half of the hashes. A text without
words has fingerprint zero and links like any other. Fingerprints link at `distance` (2) or fewer differing bits.

Search: the 64 bits form a ring of 16 segments of 4 bits. If two fingerprints differ in at most 2 bits, the pigeonring
principle gives a start from which every chain of k consecutive segments differs in at most floor(2k / 16) bits: none in
the first 7 segments, one in the first 15, two in all. So a fingerprint is filed under its first 7 segments from each of
the 16 starts; two in one bucket are compared along the chain, the chain stops at the first exceeded budget, and only
what is left gets the full Hamming check.

Crowded buckets (over `crowd` distinct fingerprints) are not paired: each of their fingerprints is filed under itself and
its 64 one-bit neighbours. Two fingerprints share such a key exactly if they differ in at most 2 bits, so a star of links
under each key gives the same components with a number of rows in proportion to the fingerprints.

All work after the fingerprints is on distinct fingerprints: copies of a text never meet as pairs.

Defined cases: a null text counts as empty. Rows with the same doc_id, and equal rows, each get a row. A null doc_id links
like any other; component_id is the smallest doc_id that is not null (null if there is none). An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import components, free_name, materialize, per_text, row_key

SEGMENTS, SEGMENT_BITS, DISTANCE = 16, 4, 2
#: Consecutive segments that must agree: the longest chain with a budget below one bit.
AGREE = next(k for k in range(1, SEGMENTS + 1) if (k + 1) * DISTANCE // SEGMENTS >= 1)
#: Hashes that are counted at once; longer texts are counted in parts.
PART = 1 << 16


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text."""
    import xxhash

    words = text.lower().split()  # for bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    n = len(words) - shingle_words + 1
    first, last = (ends - sizes)[:n].tolist(), (ends[shingle_words - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, n, PART):
        hashes = np.array([hashed(joined[a:b], 42) for a, b in zip(first[i : i + PART], last[i : i + PART], strict=True)], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", name: str = "fp", shingle_words: int = 3) -> DataFrame:
    """`keep` columns and the fingerprint as a signed long."""

    def make():
        return lambda texts: {name: np.array([fingerprint(t, shingle_words) for t in texts], np.uint64).view(np.int64)}

    return per_text(docs, text_col, keep, f"{name} long", make)


def turned(fp: Column, start: Column) -> Column:
    """The ring read from a segment: that segment becomes the highest bits."""
    by = start * SEGMENT_BITS
    return F.when(by == 0, fp).otherwise(F.call_function("shiftleft", fp, by).bitwiseOR(F.call_function("shiftrightunsigned", fp, F.lit(64) - by)))


def chain_holds(a: Column, b: Column) -> Column:
    """Whether the chains from the first segment of two turned rings keep their budgets.

    Sums along a chain only grow, so each budget needs a look only at the longest chain that it covers.
    """
    differ = a.bitwiseXOR(b)
    tests = []
    for budget in range(DISTANCE + 1):
        longest = max(k for k in range(1, SEGMENTS + 1) if k * DISTANCE // SEGMENTS == budget)
        beyond = 64 - longest * SEGMENT_BITS
        tests.append(F.bit_count(F.shiftrightunsigned(differ, beyond) if beyond else differ) <= budget)
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def links(distinct: DataFrame, crowd: int = 16) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` that keep the components of "at most 2 differing bits"."""
    filed = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("start")).withColumn("ring", turned(F.col("fp"), F.col("start")))
    filed = filed.withColumn("key", F.shiftrightunsigned("ring", 64 - AGREE * SEGMENT_BITS))
    buckets = materialize(filed.groupBy("start", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
    two = buckets.where("n = 2").select("start", "a", "b")
    more = filed.join(buckets.where("n > 2").select("start", "key", "n"), ["start", "key"])
    few = more.where(F.col("n") <= crowd).groupBy("start", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    several = few.select("start", F.explode(F.flatten(F.transform("fps", lambda x, i: F.transform(F.slice(few.fps, i + 2, F.size(few.fps)), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("start", "p.a", "p.b")
    near = two.union(several).where(chain_holds(turned(F.col("a"), F.col("start")), turned(F.col("b"), F.col("start"))))
    near = near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")
    crowded = more.where(F.col("n") > crowd).select("fp").distinct()
    balls = crowded.select("fp", F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int")))))).alias("point"))
    centres = balls.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = balls.join(centres.select("point", "a"), "point").where("fp != a").select("a", F.col("fp").alias("b"))
    return near.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = 16) -> DataFrame:
    """Per row of docs: doc_id long, row_key (of all columns), fp long, component_id long, representative boolean.

    One row of each component is its representative, the smallest (doc_id, row_key), null doc_id last; rows that are
    equal in every column share the flag.
    """
    ident, key = free_name(docs, "_doc"), free_name(docs, "_key")
    rows = docs.withColumn(key, row_key(docs)).withColumn(ident, F.col(id_col).cast("long"))
    printed = materialize(fingerprints(rows, [ident, key], text_col).toDF("doc_id", "row_key", "fp"), "fingerprints", wide=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    distinct = materialize(printed.groupBy("fp").agg(first), "distinct")
    linked = components(links(distinct, crowd))
    rooted = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    named = rooted.select("fp", "root").join(heads, "root").select("fp", "head")
    out = printed.join(named, "fp")
    best = F.col("head")
    return out.select("doc_id", "row_key", "fp", best["doc_id"].alias("component_id"), (F.col("doc_id").eqNullSafe(best["doc_id"]) & (F.col("row_key") == best["row_key"])).alias("representative"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, all columns as they were; of equal rows one stays."""
    key = free_name(docs, "_key")
    kept = near_duplicates(docs, id_col, text_col).where("representative").groupBy(F.col("row_key").alias(key)).agg(F.count("*").alias(free_name(docs, "_n")))
    n = kept.columns[1]
    kept = materialize(kept, "kept")
    # the kept keys grow with the documents: a merge join at every size, one shuffle of the documents
    rows = docs.withColumn(key, row_key(docs)).join(kept.hint("merge"), key)
    out = rows.where(F.col(n) == 1)
    if kept.where(F.col(n) > 1).limit(1).count():
        out = out.union(rows.where(F.col(n) > 1).dropDuplicates([key]))
    return out.select(*docs.columns)
