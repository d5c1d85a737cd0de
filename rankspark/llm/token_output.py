"""Token-id output in a bit-plane format: fixed-size blocks of ids are transposed into byte or bit planes, each plane is
compressed with zstandard, and a chunk index says where each lies.

A segment (one record of the written table, one self-contained binary image) holds whole documents:

    "RKPL" | version u8 | planes u8 | bits per plane u8 | 0 u8 | block u32 | documents u32 | ids u64 | index length u32
    index: zstandard of the documents' ids (i64), a null flag (u8) and token counts (u64)
    chunk index: for each block, for each plane: offset u64 from the end of this index, length u32
    the compressed planes

Documents are range-partitioned and sorted by id, encoded whole, and written by Spark's committed Parquet writer into the
shared folder, so a lost executor's segments are written anew. Segments are numbered by (part, segment), and each carries the
number of ids before it in its part, so starts need only per-part totals (one row a part reaches the driver and goes out again):
images are read where they lie and not shuffled.

Encoding caches the ids of pieces: a text may be cut before each single space that a non-space follows, as no token spans such
a place in byte-level pre-tokenisation, and marks after a word, a line feed and the next line's word are encoded apart from it. Texts that contain an added token
are encoded in one go. The cache holds two generations of bounded size and only saves work.

Defined results: null and empty texts give the end id alone; null ids come first; repeated ids are ordered by text; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import gc
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small_batches, staged

#: Pieces kept, and the characters of the longest that is.
CACHE, MOST_PIECE = 500_000, 64
BLOCK, SEGMENT_IDS = 1 << 15, 1 << 18
MAGIC = b"RKPL"
_HEAD = struct.Struct("<4sBBBxIIQI")
#: A word and the marks after it (no apostrophe, which may begin a token with letters), and perhaps a line feed and a word of the
#: next line, with or without marks: pre-tokenisation parts words, runs of marks and a line feed that a word follows.
_MARKED = re.compile(r"([^\W\d_]+)([.,;:!?*#&$%()\-\"]*)(?:\n([^\W\d_]+)([.,;:!?*#&$%()\-\"]*))?")
_ENCODERS: dict[str, PieceEncoder] = {}


def planes_of(ids: np.ndarray, bits: bool) -> list[np.ndarray]:
    """The byte planes (or, for each byte, its eight bit planes) of little-endian 32-bit ids."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(octets[:, k]) for k in range(4)]
    each = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(each[:, k], bitorder="little") for k in range(32)]


def ids_of(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    octets = np.empty((n, 4), np.uint8)
    if bits:
        each = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        octets[:] = np.packbits(each, axis=1, bitorder="little")
    else:
        for k, p in enumerate(planes):
            octets[:, k] = np.frombuffer(p, np.uint8)
    return octets.view("<u4").reshape(-1)


def pack(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, bits: bool = False, block: int = BLOCK, level: int = 3) -> bytes:
    """A segment of documents whose ids lie in a row."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    flags = np.array([x is None for x in doc_ids], np.uint8)
    index = squeeze(np.array([x or 0 for x in doc_ids], "<i8").tobytes() + flags.tobytes() + np.array(counts, "<u8").tobytes())
    chunks, body, at = [], [], 0
    for k in range(0, len(ids), block):
        for plane in planes_of(ids[k : k + block], bits):
            packed = squeeze(plane.tobytes())
            chunks.append(struct.pack("<QI", at, len(packed)))
            body.append(packed)
            at += len(packed)
    return b"".join([_HEAD.pack(MAGIC, 1, 32 if bits else 4, 1 if bits else 8, block, len(doc_ids), len(ids), len(index)), index, *chunks, *body])


def unpack(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """A segment's document ids, token counts and ids."""
    magic, version, planes, width, block, n_docs, n_ids, size = _HEAD.unpack_from(image)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token segment")
    expand = zstandard.ZstdDecompressor().decompress
    index = expand(image[_HEAD.size : _HEAD.size + size])
    numbers = np.frombuffer(index, "<i8", n_docs)
    flags = np.frombuffer(index, np.uint8, n_docs, 8 * n_docs)
    counts = np.frombuffer(index, "<u8", n_docs, 9 * n_docs).astype(np.int64)
    at = _HEAD.size + size
    blocks = -(-n_ids // block)
    data = at + 12 * blocks * planes
    out = []
    for b in range(blocks):
        n = min(block, n_ids - b * block)
        own = []
        for p in range(planes):
            offset, length = struct.unpack_from("<QI", image, at + 12 * (b * planes + p))
            own.append(expand(image[data + offset : data + offset + length]))
        out.append(ids_of(own, n, width == 1))
    return [None if f else x for x, f in zip(numbers.tolist(), flags.tolist(), strict=True)], counts, np.concatenate(out) if out else np.zeros(0, "<u4")


class PieceEncoder:
    """Encodes whole texts with the tokenizers library, by way of a bounded cache of pieces."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes | None] = {}  # of a piece with a space before it; None if a text must not be cut there
        self.old: dict[str, bytes | None] = {}
        self.heads: dict[str, bytes] = {"": b""}  # of what comes before a text's first space, or begins a line
        self.marks: dict[str, bytes] = {"": b"", "\n": self.ids("\n")}

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def mark(self, marks: str) -> bytes:
        if (ids := self.marks.get(marks)) is None:
            ids = self.ids(marks)
            if len(marks) <= 3:  # some 3000 at most
                self.marks[marks] = ids
        return ids

    def batch(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers. The garbage collector rests meanwhile: no cycles are made, and
        it would walk the lists of pieces again and again."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.old, self.known = self.known, {}
        if len(self.heads) > CACHE:
            self.heads = {"": b""}
        known, old, heads = self.known, self.old, self.heads
        cut, missing, begun = [], {}, {}
        for text in texts:
            if not text or any(a in text for a in self.added):
                cut.append(None)
                continue
            first, *rest = text.split(" ")
            missing.update(dict.fromkeys(filterfalse(known.__contains__, rest)))
            if first not in heads:
                begun[first] = None
            cut.append((first, rest))
        fresh, marked = {}, []
        for x in missing:
            if not x or x[0].isspace():
                known[x] = None
            elif (ids := old.get(x)) is not None:
                known[x] = ids
            elif (m := _MARKED.fullmatch(x)) and m[1] != x:
                marked.append((x, *m.groups()))
                if m[3] is not None and m[3] not in heads:
                    begun[m[3]] = None
                if m[1] not in known:
                    if (ids := old.get(m[1])) is not None:
                        known[m[1]] = ids
                    else:
                        fresh[m[1]] = None
            else:
                fresh[x] = None
        known.update(zip(fresh, self.batch([" " + x for x in fresh]), strict=True))
        heads.update(zip(begun, self.batch(list(begun)), strict=True))
        for x, word, mark, line, end in marked:
            ids = known[word] + self.mark(mark)
            known[x] = ids if line is None else ids + self.marks["\n"] + heads[line] + self.mark(end)
        find, out = known.__getitem__, []
        # long pieces are not kept, so the cache is bounded in bytes, not only in entries
        passing = [x for x in (*fresh, *(m[0] for m in marked)) if len(x) > MOST_PIECE]
        for text, pieces in zip(texts, cut, strict=True):
            if pieces is None:
                out.append(self.ids(text) if text else b"")
                continue
            try:
                out.append(heads[pieces[0]] + b"".join(map(find, pieces[1])))
            except TypeError:  # two spaces, or a space before other white space
                out.append(self.ids(text))
        for x in passing:
            del known[x]
        for x in begun:
            if len(x) > MOST_PIECE:
                del heads[x]
        return out


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


_SEGMENT = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("segment", T.LongType()), T.StructField("n_before", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("image", T.BinaryType())])


def write_tokens(documents: DataFrame, tokenizer: str, end_id: int = 0, bits: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes all documents in ascending id order and writes their segments to the shared folder; returns the written table."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        names, counts, held, size = [], [], [], 0

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            image = pack(names, counts, ids, bits)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([before], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([image], pa.binary())], schema=arrow)

        arrow = pa.schema([("part", pa.int32()), ("segment", pa.int64()), ("n_before", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])
        for batch in batches:
            for piece in slices(batch, "text"):
                for name, ids in zip(piece.column("doc_id").to_pylist(), coder.encode(piece.column("text").to_pylist()), strict=True):
                    names.append(name)
                    counts.append(len(ids) // 4 + 1)
                    held += (ids, end)
                    size += counts[-1]
                    if size >= SEGMENT_IDS:
                        yield segment()
                        number, before = number + 1, before + size
                        names, counts, held, size = [], [], [], 0
        if names:
            yield segment()

    ordered = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return staged(ordered.mapInArrow(run, _SEGMENT), "tokens")


_READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())])


def read_tokens(segments: DataFrame, with_ids: bool = True) -> DataFrame:
    """Per document, read from the segments: doc_id, start, n_tokens, ids_crc32 and (on wish) ids as little-endian u32 bytes."""
    spark = segments.sparkSession
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    bases, at = [], 0
    for r in totals:
        bases.append((r["part"], at))
        at += r["n"]
    offsets = spark.createDataFrame(bases, "part int, base long")
    placed = segments.join(F.broadcast(offsets), "part").select((F.col("base") + F.col("n_before")).alias("first"), "image")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                names, counts, ids = unpack(batch.column("image")[k].as_py())
                ends = np.cumsum(counts)
                raw = ids.tobytes()
                each = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(ends - counts + batch.column("first")[k].as_py()), pa.array(counts), pa.array([zlib.crc32(x) for x in each], pa.int64()), pa.array(each if with_ids else [None] * len(each), pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return placed.mapInArrow(run, _READ)
