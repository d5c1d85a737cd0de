"""Byte-level BPE encoding of texts in overlapping chunks, and decoding by raw bytes.

A text is cut into chunks of CHUNK characters, each read on for OVERLAP more. Chunks are pre-tokenised apart from each other, in
parallel: from a chunk's start the pattern may first cut wrongly, but matching goes on from a boundary without memory, so
from the first boundary on which a chunk and the one before it agree, both cut as the whole text would be. The stitch of two
neighbours is that boundary: the smallest place in both the tail of the one (boundaries in its overlap that cannot change with
what follows) and the head of the other. Each chunk then encodes the pieces between its own stitch and the next one's.

Chunks that agree nowhere in the overlap (a run of letters or spaces longer than it) are joined to the chunk before them and
pre-tokenised again, round by round, until every neighbour agrees; a round joins whole runs, so a single endless piece takes two rounds. A
piece is the unit of byte-pair merging and is held whole by one task; nothing else is.

Plan: texts of one chunk have nothing to stitch and are encoded where they are read. Chunks of longer texts are dealt by
(row, chunk), so that one long text is the work of many tasks, and written with the lengths of their pieces; stitches come from a
window over the boundaries alone, without texts. digest() deals ids by row and reads them in the order of chunks, one at a time.

Characters newer than the tokenizer library's Unicode tables belong to other classes in the regex library: they are
replaced, for finding boundaries only, by stand-ins of the class that the tokenizer library gives them.

Defined results: null and empty texts have no ids; repeated rows and ids are encoded each on its own; a null doc_id stays
null; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import slices, small_batches, staged

CHUNK, OVERLAP = 1 << 15, 1 << 9
#: A boundary this near the end of what was read may move with the text behind it: contractions look three characters ahead.
LOOK_AHEAD = 4
#: Pieces kept in each of two generations, and the characters of the longest that is.
CACHE, MOST_PIECE = 400_000, 64
_CODERS: dict[tuple[str, str], Coder] = {}


class _Pieces(dict):
    """The ids (bytes) of pieces; what is missing is encoded."""

    def __init__(self, encode, old: dict[str, bytes]):
        super().__init__()
        self.encode, self.old = encode, old

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("I", self.encode(piece)).tobytes()
        if len(piece) <= MOST_PIECE:
            self[piece] = ids
        return ids


class Coder:
    """Ranks from a .tiktoken file and the pattern that parts texts into pieces."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # the whole of what it is given is one piece
        self.one = tiktoken.Encoding("pieces", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.bytes[rank] = word
        self.split = regex.compile(pattern).findall
        self.known = _Pieces(self.one, {})
        self._odd: dict[int, str] | None = None

    def odd(self) -> dict[int, str]:
        """Of each character that the two libraries class apart, a stand-in of the tokenizer library's class."""
        if self._odd is None:
            import regex
            import tiktoken

            every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
            octets = {bytes([k]): k for k in range(256)}
            self._odd, classed = {}, {}
            for pattern, stand_in in ((r"\p{L}", "б"), (r"\p{N}", "²"), (r"\s", " ")):
                found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=octets, special_tokens={}).encode_ordinary(every)
                classed[stand_in] = (set(bytes(found).decode()), set(regex.findall(pattern, every)))
            for theirs, ours in classed.values():
                self._odd.update(dict.fromkeys(map(ord, ours - theirs), "☃"))
            for stand_in, (theirs, ours) in classed.items():
                self._odd.update(dict.fromkeys(map(ord, theirs - ours), stand_in))
        return self._odd

    def pieces(self, text: str) -> list[str]:
        # all characters before U+0530 have their classes for good
        if not text.isascii() and max(text) >= "԰" and not self.odd().keys().isdisjoint(map(ord, set(text))):
            out, at = [], 0
            for piece in self.split(text.translate(self.odd())):
                out.append(text[at : at + len(piece)])
                at += len(piece)
            return out
        return self.split(text)

    def encode(self, pieces: list[str]) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if len(self.known) > CACHE:
            self.known = _Pieces(self.one, dict(self.known))
        return b"".join(map(self.known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


#: Of a chunk: the characters before it, its own, those read ahead, and whether these end the text.
_CHUNKS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("first", pa.int64()), ("body", pa.string()), ("ahead", pa.string()), ("closed", pa.bool_())])
_CUT = pa.schema([*_CHUNKS, ("lengths", pa.list_(pa.int32())), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])
_IDS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("ids", pa.binary())])
_RAW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("raw", pa.binary())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(pa.int32()): "array<int>", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def chunked(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """texts (row, doc_id, text) in overlapping chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for row, doc, text in zip(*(part.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                    held = []
                    for at in range(0, len(text), chunk):
                        end = at + chunk + overlap
                        held.append((row, doc, at // chunk, at, text[at : at + chunk], text[at + chunk : end], end >= len(text)))
                        if len(held) * chunk >= 1 << 20:
                            yield _table(_CHUNKS, held)
                            held = []
                    yield _table(_CHUNKS, held)

    return texts.mapInArrow(run, _ddl(_CHUNKS))


def pretokenised(chunks: DataFrame, path: str, pattern: str, overlap: int) -> DataFrame:
    """chunks with the lengths of their pieces, and the places of boundaries in head (the start and its first `overlap` characters)
    and tail (what it read ahead), as far as these cannot change with the text behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            for part in slices(batch, "body"):
                rows = []
                for r in part.to_pylist():
                    text, first = r["body"] + r["ahead"], r["first"]
                    lengths = np.array([len(p) for p in own.pieces(text)], np.int32)
                    ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
                    sure = ends if r["closed"] else ends[ends <= len(text) - LOOK_AHEAD]
                    rows.append((*(r[c] for c in _CHUNKS.names), lengths, first + sure[sure <= overlap], first + sure[sure >= len(r["body"])]))
                yield _table(_CUT, rows)

    return chunks.mapInArrow(run, _ddl(_CUT))


def _in_text() -> WindowSpec:
    return Window.partitionBy("row").orderBy("chunk")


def stitches(cut: DataFrame) -> DataFrame:
    """Of each chunk: row, chunk and stitch, the first boundary that it shares with the chunk before; 0 for a text's first chunk,
    null where none is shared."""
    before = cut.select("row", "chunk", "head", F.lag("tail").over(_in_text()).alias("before"))
    shared = F.array_min(F.array_intersect("before", "head"))
    return before.select("row", "chunk", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(shared).cast("long").alias("stitch"))


def _joined(cut: DataFrame, groups: DataFrame) -> DataFrame:
    """One chunk of each group (row, chunk, to: the chunk it goes to)."""
    member = F.struct("chunk", "first", "body", "ahead", "closed").alias("m")
    whole = cut.join(groups.hint("shuffle_hash"), ["row", "chunk"]).groupBy("row", "doc_id", "to").agg(F.sort_array(F.collect_list(member)).alias("m"))
    last = F.element_at("m", -1)
    bodies = F.array_join(F.transform("m", lambda x: x["body"]), "").alias("body")
    return whole.select("row", "doc_id", F.col("to").alias("chunk"), F.col("m")[0]["first"].alias("first"), bodies, last["ahead"].alias("ahead"), last["closed"].alias("closed"))


def stitched(chunks: DataFrame, path: str, pattern: str, overlap: int) -> DataFrame:
    """Chunks whose neighbours all agree, written, with their stitch and the next one's (null for the last)."""
    cut = staged(pretokenised(chunks.repartition("row", "chunk"), path, pattern, overlap), "chunks")
    while True:
        found = staged(stitches(cut), "stitches")
        if found.where("stitch is null").isEmpty():
            break
        # a chunk without a stitch goes to the last one before it that has one
        to = F.max(F.when(F.col("stitch").isNotNull(), F.col("chunk"))).over(_in_text())
        members = found.select("row", "chunk", to.alias("to"))
        members = members.withColumn("n", F.count("*").over(Window.partitionBy("row", "to")))
        left = cut.join(members.where("n = 1").select("row", "chunk").hint("shuffle_hash"), ["row", "chunk"])
        again = pretokenised(_joined(cut, members.where("n > 1").drop("n")), path, pattern, overlap)
        cut = staged(left.unionByName(again), "chunks")
    following = found.select("row", "chunk", "stitch", F.lead("stitch").over(_in_text()).alias("until"))
    return cut.drop("head", "tail").join(following.hint("shuffle_hash"), ["row", "chunk"])


def encode_chunks(chunks: DataFrame, path: str, pattern: str) -> DataFrame:
    """row, doc_id, chunk and the ids of each chunk's pieces from its stitch to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            for part in slices(batch, "body"):
                rows = []
                for r in part.to_pylist():
                    text, ends = r["body"] + r["ahead"], np.cumsum([0, *r["lengths"]], dtype=np.int64) + r["first"]
                    until = r["first"] + len(text) if r["until"] is None else r["until"]
                    places = ends[(ends >= r["stitch"]) & (ends <= until)] - r["first"]
                    pieces = [text[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
                    rows.append((r["row"], r["doc_id"], r["chunk"], own.encode(pieces)))
                yield _table(_IDS, rows)

    return chunks.mapInArrow(run, _ddl(_IDS))


def _short(texts: DataFrame, path: str, pattern: str) -> DataFrame:
    """row, doc_id, chunk 0 and ids of texts that are one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [own.encode(own.pieces(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(np.zeros(len(ids), np.int64)), pa.array(ids, pa.binary())], schema=_IDS)

    return texts.mapInArrow(run, _ddl(_IDS))


def encode(documents: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts of one chunk, longer texts), both with row, doc_id, chunk and ids (little-endian 32-bit integers); a longer text's ids are
    those of its chunks in ascending order."""
    if not LOOK_AHEAD < overlap <= chunk:
        raise ValueError("an overlap is longer than the look-ahead and no longer than a chunk")
    small_batches(documents.sparkSession)
    texts = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = F.char_length("text") > chunk
    return _short(texts.where(~long), path, pattern), encode_chunks(stitched(chunked(texts.where(long), chunk, overlap), path, pattern, overlap), path, pattern)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """row, doc_id, chunk and the raw bytes of encoded ids; a text is the bytes of its chunks in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            held, size = [], 0
            for k, ids in enumerate(batch.column("ids")):
                raw = own.decode(ids.as_py())
                held.append((*(batch.column(c)[k].as_py() for c in ("row", "doc_id", "chunk")), raw))
                size += len(raw)
                if size >= 1 << 21:
                    yield _table(_RAW, held)
                    held, size = [], 0
            yield _table(_RAW, held)

    return encoded.select("row", "doc_id", "chunk", "ids").mapInArrow(run, _ddl(_RAW))


def digest(encoded: tuple[DataFrame, DataFrame], path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens and the hashes of its ids and of the bytes decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        row, doc, n, ids, raw = None, None, 0, None, None
        for batch in batches:
            done = []
            for r, d, part in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if r != row:
                    if row is not None:
                        done.append((doc, n, ids.hexdigest(), raw.hexdigest()))
                    row, doc, n, ids, raw = r, d, 0, hashlib.sha256(), hashlib.sha256()
                part = part.as_py()
                n += len(part) // 4
                ids.update(part)
                raw.update(own.decode(part))
            yield _table(_DIGEST, done)
        if row is not None:
            yield _table(_DIGEST, [(doc, n, ids.hexdigest(), raw.hexdigest())])

    short, long = encoded
    ordered = long.repartition("row").sortWithinPartitions("row", "chunk")
    return short.mapInArrow(run, _ddl(_DIGEST)).unionByName(ordered.mapInArrow(run, _ddl(_DIGEST)))
