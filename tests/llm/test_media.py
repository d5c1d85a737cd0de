import hashlib
import random
import zlib

import numpy as np
import pytest

from rankspark.llm import media as M

#: Fixed values of the JPEG standard: the zigzag order.
ZIGZAG_HEAD = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25]


def test_zigzag():
    assert M.ZIGZAG[:12].tolist() == ZIGZAG_HEAD and M.ZIGZAG[-1] == 63


@pytest.mark.parametrize("size", [1, 2, 8, 9, 32, 33, 100])
def test_bytes_come_back(size):
    raw = random.Random(size).randbytes(size * 192)
    film = M.parse_avi(M.encode_avi(raw))
    heads, blocks, held = M.decode_frames(film)
    assert held[: film.payload_bytes].tobytes() == raw
    # the general Huffman decoder agrees with the flat one
    head = heads[0]
    general = M._huffman(head, film.pictures[0][head.data : -2])
    assert (general[1] == blocks[0]).all()


def test_index_order_rules_and_missing_index():
    data = M.encode_avi(random.Random(1).randbytes(192 * 20))
    film = M.parse_avi(data)
    assert len(film.pictures) == 3
    assert M.parse_avi(data[: data.index(b"idx1")]).pictures == film.pictures
    with pytest.raises(ValueError):
        M.parse_avi(b"nothing")


def test_shots_at_a_jump():
    shares = np.zeros((30, 16))
    shares[:12, 3] = 1
    shares[12:, 9] = 1
    assert M.shots(shares) == [(0, 12), (12, 30)]
    assert M.shots(np.zeros((0, 16))) == []


def test_query_columns(spark):
    texts = [None, "", "a", "é" * 96, "x" * 192, "long " * 9000, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'q' as media", "1 as feature")
    got = {r.doc_id: r for r in M.store_and_read(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert r.media_sha256 == hashlib.sha256(M.encode_avi(full)).hexdigest()
    assert got[2][1:] == got[6][1:]
    clips = M.clip_rows(M.films(docs)).collect()
    assert {c.doc_id for c in clips} == set(range(7))
    assert sum(c.n_frames for c in clips if c.doc_id == 5) == -(-45000 // 1536)
    assert M.store_and_read(docs.limit(0)).collect() == []
