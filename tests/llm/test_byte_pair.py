"""Chunked byte-pair encoding against the tokenizer library on whole texts."""

import base64
import hashlib
import random
from array import array

import public_tokenizers
import pytest
import tiktoken

from rankspark.llm import byte_pair, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def whole():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(whole, rows):
    out = []
    for doc, text in rows:
        ids = whole.encode_ordinary(text or "")
        out.append((doc, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def digested(spark, rows, chunk, overlap):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = byte_pair.digest(byte_pair.encode(frame, PATH, PATTERN, chunk, overlap), PATH, PATTERN)
    return sorted(map(tuple, found.collect()), key=str)


def random_text(seed, size):
    draw = random.Random(seed)
    some = ["word", " word", "  ", "\n", "\n\n", "\t ", "'s", "'re", "'", "1234567", " 9", "!?", "é", "ß́", "漢字", "🙂", "\x1c", " ", "֋", "\U0001e900", "᷹", "a" * 40, " " * 30, "'ll"]
    return "".join(draw.choices(some, k=size))[:size]


def test_random_texts_in_small_chunks(spark, whole):
    rows = [(k, random_text(k, 30 + 37 * k)) for k in range(40)]
    assert digested(spark, rows, 32, 8) == expected(whole, rows)
    assert digested(spark, rows, 64, 64) == expected(whole, rows)


def test_runs_longer_than_overlap_are_joined(spark, whole):
    rows = [(1, "x" * 500), (2, "a b " * 30 + " " * 300 + "c" * 200 + " d" * 90), (3, "." * 129 + "'s" * 70 + "\n" * 77), (4, "7" * 63 + "'" + "re" + "q" * 62), (5, "ab" * 33)]
    assert digested(spark, rows, 32, 8) == expected(whole, rows)


def test_null_empty_repeated_rows_and_ids(spark, whole):
    long = "one two  three\n" * 30
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, long), (4, long), (4, "b" + long), (None, long), (None, None)]
    assert digested(spark, rows, 64, 16) == expected(whole, rows)


def test_very_long_text(spark, whole):
    rows = [(1, random_text(5, 1_000_000)), (2, "z" * 100_000)]
    assert digested(spark, rows, byte_pair.CHUNK, byte_pair.OVERLAP) == expected(whole, rows)


def test_empty_table_and_clashing_columns(spark, whole):
    assert digested(spark, [], 32, 8) == []
    frame = spark.createDataFrame([(7, "some  text here " * 9, 1, "x", [3], "y", 0)], "doc_id long, text string, row int, chunk string, ids array<int>, body string, first int")
    found = byte_pair.digest(byte_pair.encode(frame, PATH, PATTERN, 32, 8), PATH, PATTERN)
    assert list(map(tuple, found.collect())) == expected(whole, [(7, "some  text here " * 9)])


def test_decoded_bytes_give_the_texts_back(spark):
    rows = [(1, random_text(1, 700)), (2, "é🙂" * 50), (3, "")]
    encoded = byte_pair.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH, PATTERN, 32, 8)
    texts = {}
    for part in encoded:
        for r in byte_pair.decode(part, PATH, PATTERN).orderBy("row", "chunk").collect():
            texts[r["doc_id"]] = texts.get(r["doc_id"], b"") + bytes(r["raw"])
    assert {k: v.decode() for k, v in texts.items()} == dict(rows)


def test_every_character_is_classed_as_the_library_does(whole):
    own = byte_pair.coder(PATH, PATTERN)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{c}1{c} " for c in every)
    assert own.encode(own.pieces(text)) == array("I", whole.encode_ordinary(text)).tobytes()


def test_an_overlap_has_bounds(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        byte_pair.encode(frame, PATH, PATTERN, 32, 64)
    with pytest.raises(ValueError):
        byte_pair.encode(frame, PATH, PATTERN, 32, 2)


def test_query(spark, whole):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op11_byte_bpe"](spark, folder).collect()), key=str) == expected(whole, rows)
