import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparloom.llm import queries as Q
from sparloom.llm import token_files as T

ODD = ["Don't STOP, <|endoftext|>x <|startoftext|> ΑΣ. ÀB. é a b c İI's", "", "  ", "x\x1cy\x85z 'S't ...,. 12.5, a.b. l'été, it's.", "ªº µ ß ÿ Ÿ", "ﬁ ½ été. Å,", "\U0001f600. 中文, ‍"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 500), st.just(7)), max_size=700), st.sampled_from([1.0, 50.0, 90.0, 100.0]))
def test_blocks_round_trip(ids, percentile):
    a = np.array(ids, np.uint32)
    starts, payload = T.encode_ids(a, percentile)
    assert (T.decode_ids(starts, payload, len(a)) == a).all() and len(starts) == -(-len(a) // T.BLOCK)


def test_file_random_access():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 49408, 5000, dtype=np.uint32)
    f = T.TokenFile(T.build_file([5, None, -1], [1000, 0, 4000], ids))
    for a, b in ((0, 1), (127, 129), (128, 256), (4990, 5000), (300, 300)):
        assert (f.ids(a, b) == ids[a:b]).all()
    assert [(d, at, len(x)) for d, at, x in f.documents()] == [(5, 0, 1000), (None, 1000, 0), (-1, 1000, 4000)]
    with pytest.raises(ValueError):
        T.TokenFile(b"x" * 100)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("abAB ., '\n|-12éÉßñ́<>")), st.characters(blacklist_categories=["Cs"])), max_size=60))
def test_chunks_equal_whole_texts(text):
    tk, enc = reader()
    assert enc.encode([text.encode()])[0] == np.array(tk.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def reader(_made=[]):
    if not _made:
        _made.append((Tokenizer.from_file(Q.tokenizer_path()), T.ChunkEncoder(Q.tokenizer_path(), memo=50)))
    return _made[0]


def test_odd_texts():
    tk, enc = reader()
    assert enc.encode([t.encode() for t in ODD]) == [np.array(tk.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in ODD]


@pytest.mark.parametrize("ids_per_file", [10, 1 << 20])
def test_files_in_order(spark, ids_per_file):
    rng = random.Random(1)
    rows = [(i, rng.choice([*ODD, None, "word " * rng.randint(1, 50)]), "p") for i in rng.sample(range(1000), 80)] + [(None, "n", "p"), (5000, "long words here. " * 20_000, "p")]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(5)
    shards = T.write_token_files(docs, Q.tokenizer_path(), ids_per_file=ids_per_file)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in T.read_token_files(shards).collect())
    tk, at = reader()[0], 0
    want = []
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((at, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert T.read_token_files(T.write_token_files(docs.limit(0), Q.tokenizer_path())).count() == 0


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"])
def test_ids_are_the_librarys_for_every_tokenizer(file):
    import base64

    import public_tokenizers as P
    import sentencepiece
    import tiktoken

    path = str(P.path(file))
    texts = [t for t in ODD if "<|" not in t] + ["Hello the World and more", "  two  blanks\n", "x" * 300]
    if file.endswith(".json"):
        want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    elif file.endswith(".model"):
        want = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    else:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        one = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        want = [one.encode_ordinary(t) for t in texts]
    made = T.encoder(path, 100)
    assert isinstance(made, T.ChunkEncoder) == (file == "word_bpe_49k.json")
    assert made.encode([t.encode() for t in texts]) == [np.array(ids, "<u4").tobytes() for ids in want]


def test_long_chunks_and_bad_bytes():
    tk, enc = reader()
    texts = ["".join(chr(0x4E00 + (i * 7 + j) % 5000) for j in range(1000)) for i in range(60)] + ["qx" * 40_000]
    enc.clear(), enc.older.clear()
    got = enc.encode([t.encode() for t in texts])
    assert got[3] == np.array(tk.encode(texts[3], add_special_tokens=False).ids, "<u4").tobytes() and not enc and not enc.older
    assert enc.encode([b"ab\xff cd"])[0] == np.array(tk.encode("ab\ufffd cd", add_special_tokens=False).ids, "<u4").tobytes()
    changed = {"normalizer": None, "model": {}, "added_tokens": []}
    assert not T.is_chunked(changed)


def test_exported_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words {i} " * 5) for i in range(30)], "doc_id long, text string")
    shards = T.write_token_files(docs, Q.tokenizer_path(), ids_per_file=50)
    T.export_files(shards, str(tmp_path))
    files = [T.TokenFile(p.read_bytes()) for p in sorted(tmp_path.glob("*.pfr"))]
    assert [d for f in files for d in f.doc_ids] == list(range(30)) and len(files) == shards.count() > 3
