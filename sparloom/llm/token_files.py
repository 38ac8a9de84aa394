"""Token ids in patched frame-of-reference files (operator 8).

A document is encoded, the end id is appended, and the ids of a run of documents go to one shard file. In a file, ids
stand in blocks of 128. A block stores its minimum, the differences packed at the width that holds `percentile` of
them, and the higher bits of the rest as an exception list of positions and values. An index of block starts allows a
read of any block or document.

A file is the value of a binary column: Spark writes the shard table with its commit protocol, so a lost or repeated
task leaves no half file and any store that Spark reaches will do. `export_files` copies them out as single files.

Defined cases: a null or empty text has only the end id. Rows with the same doc_id stand in the order of a hash of
their text; equal rows are interchangeable. A null doc_id comes first. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import itertools
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import free_name, materialize, slices, text_bytes

BLOCK = 128
MAGIC = b"PFR1"
HEAD = struct.Struct("<4sIQQ")  # magic, documents, ids, blocks
AT_ONCE = 1024  # blocks that are packed together, to bound what the bits take
FIXED = 6  # of a block: minimum (4), width (1), exceptions (1)


def pack_bits(values: np.ndarray, w: int) -> bytes:
    """Rows of BLOCK values at w bits each, in little-endian 64-bit words: one step for each place of 64 values."""
    v = np.ascontiguousarray(values.T).astype(np.uint64) & np.uint64((1 << w) - 1)
    words = np.zeros((BLOCK // 64 * w, len(values)), np.uint64)
    for j in range(BLOCK):
        at, shift = divmod(j * w, 64)
        words[at] |= v[j] << np.uint64(shift)
        if shift + w > 64:
            words[at + 1] |= v[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").tobytes()


def unpack_bits(data: bytes, w: int) -> np.ndarray:
    words = np.ascontiguousarray(np.frombuffer(data, "<u8").reshape(-1, BLOCK // 64 * w).T)
    out = np.empty((BLOCK, words.shape[1]), np.uint64)
    for j in range(BLOCK):
        at, shift = divmod(j * w, 64)
        out[j] = words[at] >> np.uint64(shift)
        if shift + w > 64:
            out[j] |= words[at + 1] << np.uint64(64 - shift)
    return (out & np.uint64((1 << w) - 1)).astype(np.uint32).T


def encode_ids(ids: np.ndarray, percentile: float = 90.0) -> tuple[np.ndarray, np.ndarray]:
    """(block starts, payload bytes) of unsigned 32-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    grid = np.full(blocks * BLOCK, ids[-1], np.uint32)
    grid[:n] = ids
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    delta = grid - low[:, None]
    rank = max(0, int(np.ceil(BLOCK * percentile / 100)) - 1)
    width = np.full(blocks, int(delta.max()).bit_length(), np.int64)
    narrow = np.arange(blocks)
    while len(narrow) and width[narrow[0]]:  # one bit less for the blocks in which enough ids still fit
        narrow = narrow[(delta[narrow] >> np.uint32(width[narrow[0]] - 1) == 0).sum(axis=1) > rank]
        width[narrow] -= 1
    high = delta >> width[:, None].astype(np.uint32) if width.max() < 32 else (delta.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    odd = high != 0
    extra = odd.sum(axis=1)
    starts = np.concatenate([[0], np.cumsum(FIXED + BLOCK // 8 * width + 5 * extra)]).astype(np.int64)
    head = np.empty((blocks, FIXED), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4], head[:, 5] = width, extra
    packed = [b""] * blocks
    for w in np.unique(width):
        every = np.flatnonzero(width == w) if w else ()
        for i in range(0, len(every), AT_ONCE):
            rows = every[i : i + AT_ONCE]
            flat, n = pack_bits(delta[rows], int(w)), BLOCK // 8 * int(w)
            for j, r in enumerate(rows.tolist()):
                packed[r] = flat[j * n : (j + 1) * n]
    row, pos = np.nonzero(odd)
    places, values = pos.astype(np.uint8).tobytes(), high[row, pos].astype("<u4").tobytes()
    heads, parts, e = head.tobytes(), [], 0
    for r, n in enumerate(extra.tolist()):
        parts += (heads[FIXED * r : FIXED * (r + 1)], packed[r])
        if n:
            parts += (places[e : e + n], values[4 * e : 4 * (e + n)])
            e += n
    return starts[:-1].astype(np.uint64), np.frombuffer(b"".join(parts), np.uint8)


def decode_ids(starts: np.ndarray, payload: np.ndarray, n: int) -> np.ndarray:
    """The n ids of consecutive blocks."""
    at = starts.astype(np.int64)
    if not len(at):
        return np.zeros(0, np.uint32)
    low = payload[at[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    width, extra = payload[at + 4].astype(np.int64), payload[at + 5].astype(np.int64)
    out = np.zeros((len(at), BLOCK), np.uint32)
    data, first = payload.data, (at + FIXED).tolist()
    for w in np.unique(width):
        every = np.flatnonzero(width == w) if w else ()
        wide = BLOCK // 8 * int(w)
        for i in range(0, len(every), AT_ONCE):
            rows = every[i : i + AT_ONCE]
            out[rows] = unpack_bits(b"".join([data[first[r] : first[r] + wide] for r in rows.tolist()]), int(w))
    row = np.repeat(np.arange(len(at)), extra)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(extra) - extra, extra)
        lists = at[row] + FIXED + BLOCK // 8 * width[row]
        high = payload[(lists + extra[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        out[row, payload[lists + nth]] |= (high.astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
    return (out + low[:, None]).reshape(-1)[:n]


def build_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, percentile: float = 90.0) -> bytes:
    """Head, document table (null flags, doc ids, lengths), block starts, payload."""
    starts, payload = encode_ids(ids, percentile)
    null = np.array([x is None for x in doc_ids], np.uint8)
    known = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join([HEAD.pack(MAGIC, len(doc_ids), len(ids), len(starts)), null.tobytes(), known.tobytes(), np.array(lengths, "<u8").tobytes(), starts.astype("<u8").tobytes(), payload.tobytes()])


class TokenFile:
    """Reads one file: `documents()` walks it, `ids(a, b)` decodes only the blocks that hold ids a to b."""

    def __init__(self, data: bytes) -> None:
        magic, self.n_docs, self.n_ids, self.n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        null = np.frombuffer(data, np.uint8, self.n_docs, at)
        known = np.frombuffer(data, "<i8", self.n_docs, at := at + self.n_docs)
        self.lengths = np.frombuffer(data, "<u8", self.n_docs, at := at + 8 * self.n_docs).astype(np.int64)
        self.starts = np.frombuffer(data, "<u8", self.n_blocks, at := at + 8 * self.n_docs)
        self.payload = np.frombuffer(data, np.uint8, offset=at + 8 * self.n_blocks)
        self.doc_ids = [None if x else int(y) for x, y in zip(null, known, strict=True)]

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        b = self.n_ids if b is None else min(b, self.n_ids)
        first, last = a // BLOCK, -(-b // BLOCK)
        return decode_ids(self.starts[first:last], self.payload, min(last * BLOCK, self.n_ids) - first * BLOCK)[a - first * BLOCK : b - first * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        every, at = self.ids(), 0
        for doc, n in zip(self.doc_ids, self.lengths, strict=True):
            yield doc, at, every[at : at + n]
            at += int(n)


#: The settings of a tokenizer file under which ChunkEncoder's steps give the library's ids.
CHUNKED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
    "post_processor": None,
}
CHUNKED_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
LONG = 64  # bytes from which a chunk is not kept
#: Fixed value: the pattern that splits text before the merges of rank files.
RANK_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def is_chunked(settings: dict) -> bool:
    model = settings.get("model", {})
    marks = [t["content"] for t in settings.get("added_tokens") or []]
    plain = all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in settings.get("added_tokens") or [])
    return all(settings.get(k) == v for k, v in CHUNKED.items()) and all(model.get(k) == v for k, v in CHUNKED_MODEL.items()) and plain and all(m.startswith("<|") and not any(c.isspace() for c in m) for m in marks)


class WholeEncoder:
    """Ids of whole texts from any file of the three libraries: .json (tokenizers), .tiktoken (ranks), .model (sentencepiece)."""

    def __init__(self, path: str) -> None:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            made = tiktoken.Encoding("ranks", pat_str=RANK_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.ids = lambda texts: [made.encode_ordinary(t) for t in texts]
        elif path.endswith(".model"):
            import sentencepiece

            read = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ids = lambda texts: read.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            made_ = Tokenizer.from_file(path)
            self.ids = lambda texts: [e.ids for e in made_.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; bytes that are not UTF-8 are read as U+FFFD."""
        return [np.array(ids, "<u4").tobytes() for ids in self.ids([t.decode("utf-8", "replace") for t in texts])]


class ChunkEncoder(dict):
    """Ids of whole texts as little-endian bytes, for a tokenizer file whose settings are CHUNKED: its pre-tokens never cross
    ASCII white space.

    Maps a chunk between white space to its ids; a chunk is encoded when it is first seen. Chunks of over LONG bytes are
    not kept, and `memo` bounds the number of the others: when it is reached, those not met since the last time are dropped.
    The tokenizer composes, lower-cases and splits letters from stops, so a chunk of Latin-1 letters with at most one final
    stop or comma is looked up as its lower-case letters and that sign; letters alone are one pre-token, whose bytes the BPE
    model takes as printable characters.
    """

    def __init__(self, path: str, memo: int = 1_200_000) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.memo, self.older = Tokenizer.from_file(path), memo, {}
        self.model = self.tokenizer.model
        self.packers = [struct.Struct(f"<{n}I").pack for n in range(32)]
        # byte-level BPE: printable Latin-1 stands for itself, the other bytes are dealt out in order from U+0100 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [x for x in range(256) if x not in plain]
        self.printable = {x: 256 + i for i, x in enumerate(rest)}

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            if chunk.isalpha() and chunk.islower():  # for bytes: ASCII letters only
                ids = self._pack([t.id for t in self.model.tokenize(chunk.decode())])
            else:
                ids = self._encode_other(chunk)
        if len(chunk) > LONG:
            return ids
        if 2 * len(self) >= self.memo:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def _pack(self, ids: list[int]) -> bytes:
        return self.packers[len(ids)](*ids) if len(ids) < len(self.packers) else struct.pack(f"<{len(ids)}I", *ids)

    def _encode_other(self, chunk: bytes) -> bytes:
        word = chunk.decode("utf-8", "replace")
        core = word[:-1] if word[-1:] in (".", ",") else word
        if not core.isalpha() or ord(max(core)) > 255:
            return self._pack(self.tokenizer.encode(word, add_special_tokens=False).ids)
        low = core.lower()
        if low != word:
            return self[low.encode()] + (self[chunk[-1:]] if len(core) < len(word) else b"")
        return self._pack([t.id for t in self.model.tokenize(chunk.decode("latin-1").translate(self.printable))])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. A-Z are lowered first, as the tokenizer does, unless that could spell a special token."""
        get = self.__getitem__
        return [b"".join(map(get, (t if b"<|" in t else t.lower()).split())) for t in texts]


_encoders: dict[tuple[str, int], ChunkEncoder | WholeEncoder] = {}


def encoder(path: str, memo: int) -> ChunkEncoder | WholeEncoder:
    """One for each path in a Python worker, which Spark uses again for later tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are dealt out by Spark
    if (path, memo) not in _encoders:
        chunked = False
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                chunked = is_chunked(json.load(f))
        _encoders[path, memo] = ChunkEncoder(path, memo) if chunked else WholeEncoder(path)
    return _encoders[path, memo]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, ids_per_file: int = 1 << 20, percentile: float = 90.0, id_col: str = "doc_id", text_col: str = "text", memo: int = 1_200_000) -> DataFrame:
    """Write the files of all documents in ascending order of id_col; returns the shard table.

    Columns: part int, seq int (files are in the order of these two), n_docs long, n_ids long, before long (ids of the part in earlier files), data binary.
    Documents are dealt by ranges of id_col, so that each task holds one run of them; a file closes after the document
    that fills `ids_per_file`. tokenizer: a .json, .tiktoken or .model file. memo: chunks of at most LONG bytes whose ids a worker
    keeps (about 200 bytes each).
    """
    tie = free_name(docs, "_tie")
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn(tie, F.xxhash64("text"))
    dealt = dealt.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie).select("doc_id", "text")
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer, memo).encode
        docs_, parts, size, before = [], [], 0, 0

        def closed() -> pa.RecordBatch:
            data = build_file(docs_, [len(x) // 4 for x in parts], np.frombuffer(b"".join(parts), "<u4"), percentile)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(docs_)], pa.int64()), pa.array([size], pa.int64()), pa.array([before], pa.int64()), pa.array([data], pa.binary())], names=["part", "seq", "n_docs", "n_ids", "before", "data"])

        for whole in batches:
            for batch in slices(whole, 1):
                for doc, ids in zip(batch.column(0).to_pylist(), encode(text_bytes(batch.column(1))), strict=True):
                    docs_.append(doc)
                    parts.append(ids + end)
                    size += len(parts[-1]) // 4
                    if size >= ids_per_file:
                        yield closed()
                        docs_, parts, size, seq, before = [], [], 0, seq + 1, before + size
        if docs_:
            yield closed()

    return materialize(dealt.mapInArrow(write, "part int, seq int, n_docs long, n_ids long, before long, data binary"), "tokens", wide=True)


def read_token_files(shards: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start long, n_tokens long, ids_crc32 long."""
    spark = shards.sparkSession
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # as many rows as the write had tasks
    bases = list(itertools.accumulate((r["n"] for r in sorted(totals)), initial=0))
    base = spark.createDataFrame([(r["part"], b) for r, b in zip(sorted(totals), bases, strict=False)] or [(-1, 0)], "part int, base long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, before, file = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), TokenFile(batch.column(2)[i].as_py())
                rows = [(doc, part, before + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, at, ids in file.documents()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    out = shards.select("part", "before", "data").mapInArrow(read, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return out.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def export_files(shards: DataFrame, folder: str) -> None:
    """Copy the shard table's files to single files in a folder that all executors mount."""

    def copy(rows) -> None:
        for r in rows:
            with open(f"{folder}/ids-{r.part:06d}-{r.seq:04d}.pfr", "wb") as f:
                f.write(r.data)

    shards.foreachPartition(copy)
