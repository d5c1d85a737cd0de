"""Media columns: AVI motion-JPEG. Parses RIFF indexes, decodes intra frames, and detects shots by adaptive histogram
differences, which gives timed clip rows.

encode_avi() stores bytes losslessly in baseline JPEG's own unit, the quantised DCT coefficient: a byte b is the coefficient of
size category 8 whose eight appended bits are b (-255..-128 for 0..127, 128..255 for 128..255). Each MCU holds three 8x8
blocks, so 192 bytes, all tables are flat (quantiser 1, one Huffman code of one bit a table), and a restart marker after every
MCU resets the DC prediction. Any baseline decoder reads the frames; decode_frames() reads other baseline tables too.

A film has frames of 32x16 pixels (1536 bytes each), or one narrower frame if it is shorter; the last frame is filled up with zeros, and the
stream's `strd` chunk holds the payload's length. One RIFF holds at most 4 GB.

Defined results: null and empty texts give one MCU of spaces; equal texts give equal films and features; other columns are not
read; an empty table gives an empty table; a film that cannot be parsed raises ValueError.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small_batches, staged

UNIT, COLUMNS, LINES, FRAME_MS = 192, 4, 2, 40
#: JPEG's zigzag order: the place (row * 8 + column) of each coefficient.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, (p // 8 if (p // 8 + p % 8) % 2 else p % 8))))
_BASIS = np.array([[(0.5**0.5 if u == 0 else 1.0) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: Coefficients in zigzag order to pixels, in units of 2^-12: whole numbers, so sums are exact in any order.
_INVERSE = np.round(np.einsum("ux,vy->uvxy", _BASIS, _BASIS).reshape(64, 64)[ZIGZAG] * 4096)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with spaces up to a positive multiple of 192, and their number without those."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % UNIT or (UNIT if not raw else 0)), len(raw)


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def _frame_head(width: int, height: int) -> bytes:
    return b"".join([
        b"\xff\xd8",
        _marker(0xDB, b"\x00" + b"\x01" * 64),
        _marker(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _marker(0xC4, b"\x00" + bytes([1] + [0] * 15) + b"\x08"),
        _marker(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x08"),
        _marker(0xDD, b"\x00\x01"),
        _marker(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])),
    ])


def _scans(payload: np.ndarray, units: int) -> list[bytes]:
    """The entropy-coded data of each frame of `units` MCUs; the payload fills the frames."""
    b = payload.reshape(-1, 8).astype(np.uint16)
    out = np.zeros((len(b), 9), np.uint8)
    for j in range(9):  # codes of nine bits: a zero, then the byte
        if j < 8:
            out[:, j] |= (b[:, j] >> (j + 1)).astype(np.uint8)
        if j:
            out[:, j] |= (b[:, j - 1] << (8 - j)).astype(np.uint8)
    wide = np.empty((len(payload) // UNIT, 218), np.uint8)
    wide[:, :216] = out.reshape(-1, 216)
    wide[:, 216] = 0xFF
    wide[:, 217] = 0xD0 + np.arange(len(wide)) % units % 8
    if not (out == 0xFF).any():
        rows = wide.reshape(-1, units * 218)[:, :-2]
        return [r.tobytes() for r in rows]
    each = [w[:216].tobytes().replace(b"\xff", b"\xff\x00") + w[216:].tobytes() for w in wide]
    return [b"".join(each[k : k + units])[:-2] for k in range(0, len(each), units)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(name: bytes, *parts: bytes) -> bytes:
    return _chunk(b"LIST", name + b"".join(parts))


def encode_avi(payload: bytes) -> bytes:
    """A film that holds the payload, whose length is a positive multiple of 192."""
    units = len(payload) // UNIT
    if not units or len(payload) % UNIT:
        raise ValueError("the payload's length must be a positive multiple of 192")
    columns, lines = (units, 1) if units <= COLUMNS else (COLUMNS, min(LINES, -(-units // COLUMNS)))
    per = columns * lines
    frames = -(-units // per)
    full = np.zeros(frames * per * UNIT, np.uint8)
    full[: len(payload)] = np.frombuffer(payload, np.uint8)
    head = _frame_head(8 * columns, 8 * lines)
    pictures = [head + scan + b"\xff\xd9" for scan in _scans(full, per)]
    most = max(map(len, pictures))
    avih = struct.pack("<14I", FRAME_MS * 1000, most * 1000 // FRAME_MS, 0, 0x10, frames, 0, 1, most, 8 * columns, 8 * lines, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, FRAME_MS, 1000, 0, frames, most, 0xFFFFFFFF, 0, 0, 0, 8 * columns, 8 * lines)
    strf = struct.pack("<IiiHH4sIiiII", 40, 8 * columns, 8 * lines, 1, 24, b"MJPG", 3 * 64 * per, 0, 0, 0, 0)
    header = _list(b"hdrl", _chunk(b"avih", avih), _list(b"strl", _chunk(b"strh", strh), _chunk(b"strf", strf), _chunk(b"strd", struct.pack("<Q", len(payload)))))
    index, at = [], 4
    for picture in pictures:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(picture)))
        at += 8 + len(picture) + len(picture) % 2
    movie = _list(b"movi", *[_chunk(b"00dc", p) for p in pictures])
    return _chunk(b"RIFF", b"AVI " + header + movie + _chunk(b"idx1", b"".join(index)))


@dataclass
class Film:
    frame_ms: float
    pictures: list[bytes]
    payload_bytes: int | None


def parse_avi(data: bytes) -> Film:
    """Frame time and coded frames in the order of the RIFF index; without an index, in the order of the movie list."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    film = Film(float(FRAME_MS), [], None)
    movie, index, plain = 0, b"", []

    def walk(at: int, end: int) -> None:
        nonlocal movie, index
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", data, at)
            body = at + 8
            if name == b"LIST":
                if data[body : body + 4] == b"movi":
                    movie = body
                walk(body + 4, min(body + size, end))
            elif name == b"avih":
                film.frame_ms = struct.unpack_from("<I", data, body)[0] / 1000
            elif name == b"strd" and size == 8:
                film.payload_bytes = struct.unpack_from("<Q", data, body)[0]
            elif name == b"idx1":
                index = data[body : body + size]
            elif name[2:] in (b"dc", b"db"):
                plain.append((body, size))
            at = body + size + size % 2

    walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
    if index and movie:
        for name, _, offset, size in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]):
            if name[2:] in (b"dc", b"db"):
                start = movie + offset + 8 if data[movie + offset : movie + offset + 4] == name else offset + 8
                film.pictures.append(data[start : start + size])
    else:
        film.pictures = [data[at : at + size] for at, size in plain]
    return film


@dataclass
class Header:
    width: int = 0
    height: int = 0
    restart: int = 0
    components: list | None = None
    quantisers: dict | None = None
    tables: dict | None = None
    data: int = 0


def parse_jpeg(picture: bytes) -> Header:
    if picture[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    head, at = Header(components=[], quantisers={}, tables={}), 2
    while at + 4 <= len(picture):
        code, size = picture[at + 1], struct.unpack_from(">H", picture, at + 2)[0]
        body = picture[at + 4 : at + 2 + size]
        if code == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                head.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif code == 0xC0:
            _, head.height, head.width, n = struct.unpack_from(">BHHB", body)
            head.components = [[body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k], 0, 0] for k in range(n)]
        elif 0xC1 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are decoded")
        elif code == 0xC4:
            while body:
                counts = body[1:17]
                n = sum(counts)
                symbols, table, word, k = body[17 : 17 + n], {}, 0, 0
                for length in range(1, 17):
                    for _ in range(counts[length - 1]):
                        table[length, word] = symbols[k]
                        word, k = word + 1, k + 1
                    word <<= 1
                head.tables[body[0]] = table
                body = body[17 + n :]
        elif code == 0xDD:
            head.restart = struct.unpack(">H", body)[0]
        elif code == 0xDA:
            for k in range(body[0]):
                for c in head.components:
                    if c[0] == body[1 + 2 * k]:
                        c[4], c[5] = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
            head.data = at + 2 + size
            return head
        at += 2 + size
    raise ValueError("a JPEG frame without a scan")


def _flat(head: Header) -> bool:
    return head.restart == 1 and [c[1:] for c in head.components] == [[1, 1, 0, 0, 0]] * 3 and head.tables == {0: {(1, 0): 8}, 16: {(1, 0): 8}}


def _huffman(head: Header, scan: bytes) -> dict[int, np.ndarray]:
    """Quantised coefficients (blocks, 64) of each component of any baseline scan, in MCU order."""
    across, down = max(c[1] for c in head.components), max(c[2] for c in head.components)
    units = -(-head.width // (8 * across)) * -(-head.height // (8 * down))
    out: dict[int, list] = {c[0]: [] for c in head.components}
    done = 0
    for piece in _RESTART.split(scan):
        bits = np.unpackbits(np.frombuffer(piece.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
        at, last = 0, dict.fromkeys(out, 0)

        def symbol(table: dict) -> int:
            nonlocal at
            word = 0
            for length in range(1, 17):
                word, at = word << 1 | bits[at], at + 1
                if (length, word) in table:
                    return table[length, word]
            raise ValueError("a broken scan")

        def extended(size: int) -> int:
            nonlocal at
            value = 0
            for _ in range(size):
                value, at = value << 1 | bits[at], at + 1
            return value if not size or value >> (size - 1) else value - (1 << size) + 1

        for _ in range(min(head.restart or units, units - done)):
            done += 1
            for name, h, v, _, dc, ac in head.components:
                for _ in range(h * v):
                    block = [0] * 64
                    last[name] += extended(symbol(head.tables[dc]))
                    block[0], k = last[name], 1
                    while k < 64:
                        s = symbol(head.tables[16 + ac])
                        if not s & 15:
                            if s != 0xF0:
                                break
                            k += 16
                            continue
                        k += s >> 4
                        block[k] = extended(s & 15)
                        k += 1
                    out[name].append(block)
    return {name: np.array(blocks, np.int64).reshape(-1, 64) for name, blocks in out.items()}


def decode_frames(film: Film) -> tuple[list[Header], list[np.ndarray], np.ndarray | None]:
    """Of each frame its header and first component's quantised blocks (n, 64); and all bytes held, if the film is one of ours."""
    heads: list[Header] = []
    for k, picture in enumerate(film.pictures):
        same = k and picture[: heads[0].data] == film.pictures[0][: heads[0].data]
        heads.append(heads[0] if same else parse_jpeg(picture))
    if heads and all(map(_flat, {id(h): h for h in heads}.values())):
        held, blocks = [], []
        for head, picture in zip(heads, film.pictures, strict=True):
            units = (head.width // 8) * (head.height // 8)
            scan = picture[head.data : -2]
            if len(scan) == units * 218 - 2:
                held.append(np.frombuffer(scan + b"\0\0", np.uint8).reshape(units, 218)[:, :216])
            else:
                held.append(np.frombuffer(b"".join(p.replace(b"\xff\x00", b"\xff") for p in _RESTART.split(scan)), np.uint8).reshape(units, 216))
        packed = np.concatenate(held).reshape(-1, 9).astype(np.uint16)
        out = np.empty((len(packed), 8), np.uint8)
        for j in range(8):
            out[:, j] = (packed[:, j] << (j + 1)) | (packed[:, j + 1] >> (7 - j))
        payload = out.reshape(-1, 3, 64)
        luma = payload[:, 0, :].astype(np.int16)
        luma -= np.where(luma < 128, np.int16(255), np.int16(0))
        at = 0
        for head in heads:
            n = (head.width // 8) * (head.height // 8)
            blocks.append(luma[at : at + n])
            at += n
        return heads, blocks, payload.reshape(-1)
    found = []
    for head, picture in zip(heads, film.pictures, strict=True):
        found.append(next(iter(_huffman(head, picture[head.data :].rpartition(b"\xff\xd9")[0]).values())))
    return heads, found, None


def histograms(heads: list[Header], blocks: list[np.ndarray], bins: int = 16) -> np.ndarray:
    """Luma histograms (frames, bins) of the decoded pixels, as shares."""
    out = np.zeros((len(blocks), bins))
    for k, (head, own) in enumerate(zip(heads, blocks, strict=True)):
        scale = head.quantisers[head.components[0][3]]
        pixels = np.clip(np.floor((own * scale).astype(np.float64) @ _INVERSE / 4096 + 128.5), 0, 255).astype(np.uint8)
        out[k] = np.bincount(pixels.reshape(-1) >> (8 - bins.bit_length() + 1), minlength=bins) / max(1, pixels.size)
    return out


def shots(shares: np.ndarray, window: int = 8, times: float = 3.0, least: float = 0.1) -> list[tuple[int, int]]:
    """Frame ranges [first, past]: a cut is where the histogram difference passes the mean of the `window` before it by
    `times` their deviation, and `least` at any rate."""
    if not len(shares):
        return []
    gaps = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    cuts, begin = [0], 0
    for t, gap in enumerate(gaps.tolist()):
        past = gaps[max(begin, t - window) : t]
        if gap > max(least, (past.mean() + times * past.std()) if len(past) else least):
            cuts.append(t + 1)
            begin = t + 1
    return list(zip(cuts, cuts[1:] + [len(shares)], strict=True))


_FILM = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())])


def _digest(media: bytes) -> tuple:
    film = parse_avi(media)
    heads, blocks, held = decode_frames(film)
    back = held[: film.payload_bytes].tobytes()
    shares = histograms(heads, blocks)
    clips = ",".join(f"{a * film.frame_ms:.0f}-{b * film.frame_ms:.0f}" for a, b in shots(shares))
    mean = "/".join(f"{round(1000 * x)}" for x in shares.mean(axis=0))
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"frames={len(blocks)};clips={clips};luma={mean}"


def store_and_read(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its text's film is written to the shared folder, read from there, parsed and decoded; digests of what was
    read back and its features."""
    stored = staged(films(documents, id_col, text_col), "films", "zstd")
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digest(x.as_py()) for x in batch.column("media")]
            columns = list(zip(*found, strict=True)) if found else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, pa.string() if k in (1, 4, 5) else pa.int64()) for k, c in enumerate(columns))], names=_FILM.names)

    return stored.mapInArrow(run, _FILM)


def films(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes (of the text) and media, its film."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                held = [payload_of(x.as_py()) for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([n for _, n in held], pa.int64()), pa.array([encode_avi(x) for x, _ in held], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def clip_rows(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row a shot of each film: doc_id, clip, start_ms, end_ms and n_frames. Null films have none."""
    small_batches(media.sparkSession, 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
                if (raw := data.as_py()) is None:
                    continue
                film = parse_avi(raw)
                heads, blocks, _ = decode_frames(film)
                rows += [(name, k, a * film.frame_ms, b * film.frame_ms, b - a) for k, (a, b) in enumerate(shots(histograms(heads, blocks)))]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "clip", "start_ms", "end_ms", "n_frames"])

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, "doc_id long, clip long, start_ms double, end_ms double, n_frames long")
