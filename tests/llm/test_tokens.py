"""Token ids: byte-level BPE against the tiktoken library, files against the tokenizers library."""

import hashlib
import json
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coopspark.llm import bpe, queries, tokenbin

WORDS = P.path("word_bpe_49k.json")
ODD = [
    (3, "It's  the  'end',\n\nisn't it?\x85\xa0 \x1c x"), (1, None), (2, ""), (2, ""), (None, "null id"), (5, "a" * 30_000), (4, "word " * 20_000), (9, " \t\n"), (8, "Straße ñandú 日本語 😀 é ́x İ ΑΣ"), (7, "<|endoftext|> and <|startoftext|>"), (3, "It's  the  'end',\n\nisn't it?\x85\xa0 \x1c x"),
]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(None, P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected10(library, rows):
    out = []
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_bpe_odd_rows(spark, ranks, library):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in ODD], "doc_id bigint, text string, block string, pos int")
    for block in (5, 40_000, bpe.BLOCK_CHARS):
        encoded = bpe.encode(docs, ranks, P.PATTERN, block_chars=block)
        again = bpe.decode(encoded.withColumnRenamed("decoded", "at_once"), ranks)
        assert again.where("decoded <> at_once").count() == 0
        assert sorted(map(tuple, bpe.digests(encoded).collect()), key=str) == expected10(library, ODD)


def test_bpe_empty_and_join_decode(spark, ranks):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.encode(empty, ranks, P.PATTERN).count() == 0
    docs = spark.createDataFrame([(1, "Grüße, world"), (2, None), (3, "x  y")], "doc_id bigint, text string")
    joined = bpe.decode_by_join(bpe.encode(docs, ranks, P.PATTERN).select("doc_id", "ids"), bpe.token_table(spark, ranks))
    assert {r.doc_id: bytes(r.decoded).decode() for r in joined.collect()} == {1: "Grüße, world", 2: "", 3: "x  y"}


def test_two_vocabularies_of_one_size(spark):
    """Python workers are reused: a second vocabulary of the same size and the same first tokens must not get the first one's ids."""
    single = {bytes([b]): b for b in range(256)}
    docs = spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string").coalesce(1)
    for pair, want in ((b"ab", [256, 99, 100]), (b"cd", [97, 98, 256])):
        row = bpe.encode(docs, single | {pair: 256}, P.PATTERN).first()
        assert row.ids == want and bytes(row.decoded) == b"abcd"


def test_op10_query(spark, sf_dir, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op10_byte_bpe(spark, sf_dir).collect()), key=str) == expected10(library, rows)


def expected5(rows, path=WORDS):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    made = [(d, np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")) for d, x in rows]
    made.sort(key=lambda r: (r[0] is None, r[0] or 0))
    start, out = 0, []
    for doc, ids in made:
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def test_op5_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op5_token_ids(spark, sf_dir).collect()), key=str) == expected5(rows)


@pytest.mark.parametrize("kind", [1, 8])
def test_files_odd_rows(spark, tmp_path, kind):
    docs = spark.createDataFrame([(d, t, 0) for d, t in ODD], "doc_id bigint, text string, part int")
    files = tokenbin.write_ids(docs, WORDS, str(tmp_path / "ids"), kind=kind)
    assert sorted(map(tuple, tokenbin.ids_crc32(files).collect()), key=str) == expected5(ODD)
    assert sum(len(r.ids) for r in tokenbin.read_ids(tokenbin.open_ids(spark, str(tmp_path / "ids"))).collect()) == sum(r[2] for r in expected5(ODD))


def test_files_empty(spark):
    assert tokenbin.ids_crc32(tokenbin.write_ids(spark.createDataFrame([], "doc_id bigint, text string"), WORDS)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.integers(1, 70), st.sampled_from([1, 8]), st.integers(0, 320), st.integers(0, 320))
def test_codec_round_trip(ids, block, kind, a, b):
    data = np.array(ids, "<u4")
    frame = tokenbin.pack(data, block, kind)
    assert tokenbin.unpack(frame).tolist() == ids
    lo, hi = min(a, b, len(ids)), max(a, b)
    assert tokenbin.unpack(frame, lo, hi).tolist() == ids[lo:hi]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n'sdltré\x1c\x85")), max_size=60))
def test_words_equal_whole_texts(text):
    words = tokenbin._loaded_words(WORDS, "test", tokenbin.separable(WORDS))
    assert words.split is not None
    ids, counts = words.texts(pa.array([text, None, text + " ab", ""]))
    want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "", text + " ab", "")]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_not_separable_is_encoded_whole(spark, tmp_path):
    """A tokenizer whose pieces may hold a space (by its declaration) takes the path of whole texts."""
    with open(WORDS, encoding="utf-8") as f:
        said = json.load(f)
    said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"of the|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    path = str(tmp_path / "own.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(said, f)
    assert tokenbin.separable(path) == (None, False)
    docs = spark.createDataFrame(ODD + [(77, "one of the words of  the")], "doc_id bigint, text string")
    got = tokenbin.ids_crc32(tokenbin.write_ids(docs, path))
    assert sorted(map(tuple, got.collect()), key=str) == expected5(ODD + [(77, "one of the words of  the")], path)


def test_parts_split_null_ids(spark):
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(800)] + [(7, f"again {i}") for i in range(800)], "doc_id bigint, text string")
    files = tokenbin.write_ids(docs, WORDS)
    assert files.select("part").distinct().count() >= 7
    rows = tokenbin.ids_crc32(files).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [7] * 800 + [None] * 800
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n'sdltré\x1c\x85")), max_size=60))
def test_pieces_equal_whole_texts(library, text):
    import regex

    assert [i for w in regex.findall(P.PATTERN, text) for i in library._encode_single_piece(w)] == library.encode_ordinary(text)


def test_slices_by_bytes():
    import pyarrow as pa

    from coopspark.llm.common import slices_of_texts

    texts = ["aaaa", None, "bb", "c" * 50, "", "dd", "é"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "t"])
    got = [b.column(1).to_pylist() for b in slices_of_texts(iter([batch, batch.slice(0, 0)]), 1, 5, 6)]
    assert got == [["aaaa", None, "bb"], ["c" * 50], [""], ["dd", "é"]]
