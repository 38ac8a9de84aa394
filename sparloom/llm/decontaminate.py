"""Benchmark decontamination with suffix arrays over the training text (operator 6).

Words are runs of letters a-z (A-Z lowered), digits and characters from U+0080 on. A window is `window` consecutive words
of a benchmark item; an item with fewer words, but not none, is one window. A document word inside any occurrence of a
window is hit.

The training text is cut into shards of some megabytes. A shard's suffix array stands over the stretches of words that
the benchmark knows (no other stretch can hold a window), as word numbers, sorted by prefix doubling as deep as the longest
item. Every benchmark suffix is searched in it by bisection: the range of suffixes that start with its window gives
all locations, and the words that go on agreeing there give the longest verbatim match.

The benchmark comes to the workers in blocks of at most `block_bytes` of text each (a longer item stands alone), so no
broadcast grows with it. A block is arrays of word numbers and a dictionary of its distinct words, at most some 30 bytes
for a byte of its text. Blocks are built, broadcast and released one after the other; with several blocks a document's
results are united.

Defined cases: a null text has no words. Rows with the same doc_id, and equal rows, each get a row. Benchmark rows with the
same item_id are one item with the windows of all; a null item_id is named by an empty string. An empty benchmark hits
nothing; an empty documents table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import free_name, materialize, per_text, row_key

#: Bytes that are part of words stay, A-Z go to a-z, others to blanks.
TO_WORDS = bytes(x + 32 if 0x41 <= x <= 0x5A else x if 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or x >= 0x80 else 0x20 for x in range(256))
WINDOW = 10


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


class Block:
    """A part of the benchmark as one array of word numbers, -2 around the items, and the distinct windows by size.

    by_size has for each size n: the start of one occurrence of each distinct window, all occurrences ordered by window, and
    where each window's occurrences begin.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.numbers: dict[bytes, int] = {}
        parts, starts, sizes, self.names = [np.array([-2], np.int32)], [], [], []
        at = 1
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.fromiter((self.numbers.setdefault(w, len(self.numbers)) for w in words), np.int32, len(words))
            parts += [ids, np.array([-2], np.int32)]
            starts.append(at)
            sizes.append(len(ids))
            self.names.append(name)
            at += len(ids) + 1
        self.tokens, self.starts = np.concatenate(parts), np.array(starts, np.int64)
        every: dict[int, list[np.ndarray]] = {}
        for start, n in zip(starts, sizes, strict=True):
            every.setdefault(min(n, window), []).append(np.arange(start, start + max(1, n - window + 1)))
        self.by_size = {}
        for n, found in sorted(every.items()):
            places = np.concatenate(found)
            _, first, which = np.unique(self.tokens[places[:, None] + np.arange(n)], axis=0, return_index=True, return_inverse=True)
            order = np.argsort(which.ravel(), kind="stable")
            self.by_size[n] = (places[first], places[order], np.searchsorted(which.ravel()[order], np.arange(len(first) + 1)))
        self.shortest = min(self.by_size, default=0)
        self.deepest = max(sizes, default=0)

    def items_at(self, places: np.ndarray) -> list[str]:
        return [self.names[i] for i in np.unique(np.searchsorted(self.starts, places, "right") - 1)]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of text (numbers from -1 on, -1 ends a stretch) in the order of their first `depth` numbers."""
    rank, k = text.astype(np.int64) + 1, 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-k] = rank[k:]
        after[rank == 0] = 0
        both = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(both, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(both[order]) != 0)])
        grown = np.empty_like(rank)
        grown[order] = new
        if new[-1] == len(text) - 1:
            break
        rank, k = grown + 1, 2 * k
        rank[text == -1] = 0
    return order


def search(text: np.ndarray, order: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of sought: the range of the suffix array whose suffixes start with it."""
    wide = sought.shape[1]
    padded = np.concatenate([text, np.full(wide, -1, text.dtype)])
    span = np.arange(wide)

    def bound(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(sought), np.int64), np.full(len(sought), len(order), np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            there = padded[order[np.minimum(middle, len(order) - 1)][:, None] + span]
            differ = there != sought
            first = differ.argmax(axis=1)
            at = np.arange(len(sought))
            less = np.where(differ.any(axis=1), there[at, first] < sought[at, first], upper)
            low = np.where(open_ & less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        return low

    return bound(False), bound(True)


def longest_from(text: np.ndarray, at: np.ndarray, tokens: np.ndarray, start: int) -> np.ndarray:
    """Words that agree with the item's words from `start` on, from each of the places `at`."""
    size = np.zeros(len(at), np.int64)
    alive = np.arange(len(at))
    for word in tokens[start:]:
        here = at[alive] + size[alive]
        alive = alive[(here < len(text)) & (text[np.minimum(here, len(text) - 1)] == word)]
        if not len(alive):
            break
        size[alive] += 1
    return size


def possible(block: Block, text: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the windows all of whose pairs of neighbouring words (one word: the word) stand in the text; others can't be found."""
    if n == 1:
        return np.flatnonzero(np.isin(block.tokens[first], text))
    wide = len(block.numbers) + 1
    pairs = np.unique(text[:-1].astype(np.int64)[(text[:-1] >= 0) & (text[1:] >= 0)] * wide + text[1:][(text[:-1] >= 0) & (text[1:] >= 0)])
    left = np.arange(len(first))
    for i in range(n - 1):
        code = block.tokens[first[left] + i].astype(np.int64) * wide + block.tokens[first[left] + i + 1]
        at = np.searchsorted(pairs, code)
        left = left[(at < len(pairs)) & (pairs[np.minimum(at, len(pairs) - 1)] == code)] if len(pairs) else left[:0]
    return left


def match_shard(texts: list[bytes], block: Block) -> list[tuple[int, list[tuple[int, int]], list[str], int]]:
    """For each text: words, hit runs of words (start, end exclusive), names of the items found, longest match in words."""
    counts, stretches, owner, origin = [], [], [], []
    for d, t in enumerate(texts):
        words = words_of(t)
        counts.append(len(words))
        if not block.shortest or len(words) < block.shortest:
            continue
        get = block.numbers.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        known = np.concatenate([[0], (ids >= 0).view(np.int8), [0]])
        edge = np.diff(known)
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if b - a >= block.shortest:
                stretches += [ids[a:b], np.array([-1], np.int32)]
                owner += [d]
                origin += [a]
    runs: list[list[tuple[int, int]]] = [[] for _ in texts]
    names: list[set[str]] = [set() for _ in texts]
    longest = [0] * len(texts)
    if stretches:
        text = np.concatenate(stretches)
        sizes = np.array([len(x) + 1 for x in stretches[::2]])
        starts = np.cumsum(sizes) - sizes
        order = suffix_array(text, block.deepest)
        cover = np.zeros(len(text) + 1, np.int32)
        of = np.array(owner)
        for n, (first, occurrences, bounds) in block.by_size.items():
            which = possible(block, text, first, n)
            low, high = search(text, order, block.tokens[first[which][:, None] + np.arange(n)])
            for k, a, b in zip(which[high > low], low[high > low], high[high > low], strict=True):
                places = order[a:b]
                np.add.at(cover, places, 1)
                np.add.at(cover, places + n, -1)
                docs = of[np.searchsorted(starts, places, "right") - 1]
                there = occurrences[bounds[k] : bounds[k + 1]]
                items = block.items_at(there)
                for d in np.unique(docs).tolist():
                    names[d].update(items)
                for i in there.tolist():
                    if (block.tokens[i - 1] == text[places - 1]).all() and (places > 0).all():
                        continue  # each place is inside a longer match, which the suffix before measures
                    length = longest_from(text, places, block.tokens, i)
                    best = np.zeros(len(texts), np.int64)
                    np.maximum.at(best, docs, length)
                    for d in np.flatnonzero(best).tolist():
                        longest[d] = max(longest[d], int(best[d]))
        edge = np.diff(np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).view(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            s = int(np.searchsorted(starts, a, "right")) - 1
            shift = int(origin[s] - starts[s])
            runs[owner[s]].append((a + shift, b + shift))
    return [(counts[d], runs[d], sorted(names[d]), longest[d]) for d in range(len(texts))]


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Block]:
    """The benchmark, partition by partition, in blocks."""
    items: list[tuple[str, bytes]] = []
    size = 0
    for r in benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).toLocalIterator():
        text = r[1].encode()
        if items and size + len(text) > block_bytes:
            yield Block(items, window)
            items, size = [], 0
        items.append((r[0], text))
        size += len(text)
    yield Block(items, window)


SCHEMA = "n_words long, runs array<struct<start:long,end:long>>, items array<string>, longest long"


def _maker(shared) -> Callable:
    def make():
        block = shared.value

        def work(texts):
            found = match_shard(texts, block)
            pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return {"n_words": [x[0] for x in found], "runs": pa.array([[{"start": a, "end": b} for a, b in x[1]] for x in found], pairs), "items": pa.array([x[2] for x in found], pa.list_(pa.string())), "longest": [x[3] for x in found]}

        return work

    return make


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = 4 << 20) -> DataFrame:
    """Per row of docs: doc_id, n_words long, n_hit long, runs array of (start, end) in words, items array<string>, longest long."""
    sc = docs.sparkSession.sparkContext
    ident, key = free_name(docs, "_doc"), free_name(docs, "_key")
    rows = docs.withColumn(key, row_key(docs)).withColumn(ident, F.col(id_col))
    blocks = blocks_of(benchmark, item_col, item_text_col, window, block_bytes)
    block, after, parts = next(blocks), next(blocks, None), []
    if after is None:
        out = per_text(rows, text_col, [ident, key], SCHEMA, _maker(sc.broadcast(block)))
    else:
        while block is not None:
            shared = sc.broadcast(block)
            found = materialize(per_text(rows, text_col, [ident, key], SCHEMA, _maker(shared)), "matches", wide=True)
            shared.destroy()
            parts.append(found.groupBy(key).agg(F.first(ident).alias(ident), F.count("*").alias("_copies"), *[F.first(c).alias(c) for c in ("n_words", "runs", "items", "longest")]))
            block, after = after, next(blocks, None)
        every = parts[0]
        for p in parts[1:]:
            every = every.union(p)
        every = every.groupBy(key).agg(F.first(ident).alias(ident), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"), F.first("_copies").alias("_copies"))
        out = every.withColumn("runs", F.expr(UNITE)).withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return out.select(F.col(ident).alias("doc_id"), "n_words", hit.alias("n_hit"), "runs", "items", "longest")


#: Sorted runs, with those that touch or overlap made one.
UNITE = """aggregate(runs, cast(array() as array<struct<start:bigint,end:bigint>>), (s, r) ->
  case when size(s) > 0 and element_at(s, -1).end >= r.start
       then concat(slice(s, 1, size(s) - 1), array(named_struct('start', element_at(s, -1).start, 'end', greatest(element_at(s, -1).end, r.end))))
       else concat(s, array(r)) end)"""


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = 4 << 20) -> DataFrame:
    """docs without the rows in which a benchmark window occurs; columns and other rows as they were.

    With one block nothing is shuffled. With several, the keys of the hit rows are written block by block and taken out by a
    merge join.
    """
    sc, text = docs.sparkSession.sparkContext, F.col(text_col).cast("string")
    blocks = blocks_of(benchmark, item_col, item_text_col, window, block_bytes)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return docs.where(~_touched(sc.broadcast(block), text))
    key, hit = free_name(docs, "_key"), None
    rows = docs.withColumn(key, row_key(docs))
    while block is not None:
        shared = sc.broadcast(block)
        found = materialize(rows.where(_touched(shared, text)).select(key).distinct(), "hit")
        shared.destroy()
        hit = found if hit is None else hit.union(found)
        block, after = after, next(blocks, None)
    return rows.join(hit.hint("merge"), key, "left_anti").select(*docs.columns)


def _touched(shared, text: Column) -> Column:
    @F.arrow_udf("boolean")
    def touched(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from sparloom.llm.common import slices, text_bytes

        for column in columns:
            parts = slices(pa.RecordBatch.from_arrays([column], names=["t"]), 0)
            flags = [bool(x[1]) for p in parts for x in match_shard(text_bytes(p.column(0)), shared.value)]
            yield pa.array(flags, pa.bool_())

    return touched(text)
