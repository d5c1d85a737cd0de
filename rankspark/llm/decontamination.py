"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over the documents' token windows.

Words are runs of 0-9, a-z (after lower-casing A-Z) and characters above ASCII. A window is `length` consecutive words of a
benchmark item; an item with fewer words is one window. Every document window whose hash is in the set is verified on its
words before it counts.

The set is broadcast in blocks of at most `BLOCK_BYTES` of benchmark text, which arrays hold in at most some 80 MB: while the
benchmark fits one block (its size is counted), in the scan itself; beyond it the documents get a row number, each block is
broadcast, scanned and destroyed in a pass of its own, and the passes' hits are merged per row. The driver reads the items one
by one and holds no more than two blocks.

Defined results: a null or empty text has no words, hits or items; a null item text or item without words has no window;
equal items all count; items without an id count for hits and cuts, together as one item that items_sha256 leaves out; an
empty benchmark leaves every document clean; repeated document rows are scanned each on its own. Other columns of the
documents are not touched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, slices, small_batches, staged, text_buffer, windows, word_hashes, word_spans

LENGTH = 10
BLOCK_BYTES = 8 << 20
_SPACE = bytes(c if ALNUM[c] else 32 for c in range(256))


class WindowSet:
    """The normalised windows of a block of items, looked up by hash and verified by their words. Items are numbers into
    `ids`. All is held in arrays: a word of the block takes some 24 bytes beside its text."""

    def __init__(self, items: list[tuple[int | None, str]], length: int = LENGTH):
        self.ids = [i for i, _ in items]
        values, offsets = text_buffer(pa.array([t for _, t in items], pa.string()))
        self.raw = LOWER[values]
        starts, ends, firsts = word_spans(self.raw, offsets, ALNUM)
        hashes = word_hashes(self.raw, starts, ends)
        self.starts, self.ends = starts.astype(np.int32), ends.astype(np.int32)
        owner = np.repeat(np.arange(len(items), dtype=np.int32), np.diff(firsts))
        words = np.diff(firsts)
        self.by_length = {}
        for n in np.unique(np.minimum(words[words > 0], length)).tolist():
            each = windows(hashes, n)
            mine = words[owner[: len(each)]] == n if n < length else words[owner[: len(each)]] >= n
            place = np.flatnonzero(mine & (owner[: len(each)] == owner[n - 1 :]))
            # an item's equal windows count once
            order = np.lexsort((owner[place], each[place]))
            place = place[order]
            once = np.concatenate(([True], (each[place][1:] != each[place][:-1]) | (owner[place][1:] != owner[place][:-1])))
            place = place[once].astype(np.int32)
            keys = each[place]
            bits = min(24, max(10, (16 * len(keys)).bit_length()))
            slots = np.zeros(1 << bits, bool)
            slots[keys >> np.uint64(64 - bits)] = True
            self.by_length[n] = (np.uint64(64 - bits), slots, keys, place, owner[place])

    @property
    def nbytes(self) -> int:
        return self.raw.nbytes + self.starts.nbytes + self.ends.nbytes + sum(x.nbytes for rows in self.by_length.values() for x in rows)

    def scan(self, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[set], np.ndarray, np.ndarray]:
        """Of each text: its first word's number and hit words; the ids of items found; all words' starts and ends."""
        raw = LOWER[values]
        starts, ends, firsts = word_spans(raw, offsets, ALNUM)
        items: list[set] = [set() for _ in range(len(offsets) - 1)]
        step = np.zeros(len(starts) + 1, np.int32)
        if self.by_length:
            hashes = word_hashes(raw, starts, ends)
            for n, (shift, slots, keys, place, owner) in self.by_length.items():
                each = windows(hashes, n)
                near = np.flatnonzero(slots[each >> shift])
                if not len(near):
                    continue
                lo, hi = np.searchsorted(keys, each[near]), np.searchsorted(keys, each[near], side="right")
                texts = np.searchsorted(firsts, near, side="right") - 1
                whole = np.flatnonzero((hi > lo) & (near + n <= firsts[texts + 1]))
                for k in whole.tolist():
                    i, t = near[k], texts[k]
                    words, hit = _joined(raw[starts[i] : ends[i + n - 1]]), False
                    for e in range(lo[k], hi[k]):
                        at = place[e]
                        if _joined(self.raw[self.starts[at] : self.ends[at + n - 1]]) == words:
                            hit = True
                            items[t].add(self.ids[owner[e]])
                    step[i] += hit
                    step[i + n] -= hit
        return firsts, np.cumsum(step[:-1]) > 0, items, starts, ends


def _joined(raw: np.ndarray) -> bytes:
    return b" ".join(raw.tobytes().translate(_SPACE).split())


def window_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", length: int = LENGTH, most: int = BLOCK_BYTES) -> Iterator[WindowSet]:
    """The benchmark as window sets of at most `most` text bytes each (one longer item is a set of its own), one at a time."""
    block: list = []
    held = 0
    for item, text in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        size = len(text.encode("utf-8", "surrogatepass"))
        if block and held + size > most:
            yield WindowSet(block, length)
            block, held = [], 0
        block.append((item, text))
        held += size
    if block:
        yield WindowSet(block, length)


_FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.LongType()))])
_HITS = T.StructType([T.StructField("row", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.LongType()))])


def _ids(found: set) -> list:
    return sorted(found - {None}) + [None] * (None in found)


def _runs(hit: np.ndarray, firsts: np.ndarray) -> list[np.ndarray]:
    """Of each text the runs of hit words, as start, end, start, end.. counted from its first word."""
    out = []
    for lo, hi in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        out.append(np.flatnonzero(np.diff(np.concatenate(([0], hit[lo:hi].view(np.int8), [0])))))
    return out


def _passes(rows: DataFrame, blocks: Iterator[WindowSet]) -> DataFrame:
    """rows (row, text, and others) to (row, spans, items) of all blocks, for the rows that have a hit. One broadcast at a time."""
    spark = rows.sparkSession
    found = None
    for block in blocks:
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    firsts, hit, items, _, _ = held.value.scan(*text_buffer(part.column("text")))
                    some = [t for t, x in enumerate(items) if x]
                    spans = _runs(hit, firsts) if some else []
                    yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(some, pa.int64())), pa.array([spans[t] for t in some], pa.list_(pa.int64())), pa.array([_ids(items[t]) for t in some], pa.list_(pa.int64()))], names=_HITS.names)

        hits = staged(rows.select("row", "text").mapInArrow(run, _HITS), "hits")
        held.destroy()
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _united(spans: np.ndarray, words: int) -> np.ndarray:
    """Whether each of a text's words is in one of the spans."""
    step = np.zeros(words + 1, np.int64)
    np.add.at(step, spans[0::2], 1)
    np.add.at(step, spans[1::2], -1)
    return np.cumsum(step[:-1]) > 0


def _started(blocks: Iterator[WindowSet]) -> tuple[WindowSet, Iterator[WindowSet] | None]:
    """The only block (empty without items), or the first one and all blocks."""
    first = next(blocks, None) or WindowSet([])
    second = next(blocks, None)
    return first, None if second is None else chain((first, second), blocks)


def scan_documents(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any window) and items (ids, ascending, null last)."""
    spark = documents.sparkSession
    small_batches(spark)
    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first, blocks = _started(window_blocks(benchmark, length=length, most=most))
    if blocks is not None:
        rows = staged(source.withColumn("row", F.monotonically_increasing_id()), "rows")
        return _merged(rows, _passes(rows, blocks))
    held = spark.sparkContext.broadcast(first)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                firsts, hit, items, _, _ = held.value.scan(*text_buffer(part.column("text")))
                total = np.concatenate(([0], np.cumsum(hit)))[firsts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(firsts).astype(np.int64)), pa.array(np.diff(total).astype(np.int64)), pa.array([_ids(x) for x in items], pa.list_(pa.int64()))],
                    names=_FOUND.names,
                )

    return source.mapInArrow(scan, _FOUND)


def _merged(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """scan_documents()' columns from the rows and the hits of all passes; only words' numbers are shuffled, not texts."""
    counted = T.StructType([T.StructField("row", T.LongType()), _FOUND["doc_id"], _FOUND["n_words"]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, offsets = text_buffer(part.column("text"))
                firsts = word_spans(LOWER[values], offsets, ALNUM)[2]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(np.diff(firsts).astype(np.int64))], names=counted.names)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, spans = batch.column("n_words").to_pylist(), batch.column("spans").to_pylist()
            hit = [int(_united(np.array(s, np.int64), n).sum()) if s else 0 for s, n in zip(spans, words, strict=True)]
            items = [_ids(set(x or ())) for x in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.int64()))], names=_FOUND.names)

    return rows.select("row", "doc_id", "text").mapInArrow(count, counted).join(hits, "row", "left").mapInArrow(unite, _FOUND)


def decontaminate(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", length: int = LENGTH, drop_share: float = 0.5, most: int = BLOCK_BYTES) -> DataFrame:
    """The documents without benchmark passages, in their own columns: hit spans are cut out of the text; a document with at
    least `drop_share` of its words hit goes. Texts without a hit, null and empty ones stay as they are; n_chars, where there
    is one, follows the new text."""
    spark = documents.sparkSession
    small_batches(spark)
    schema = documents.schema
    first, blocks = _started(window_blocks(benchmark, length=length, most=most))

    def cleaned(part: pa.RecordBatch, values: np.ndarray, offsets: np.ndarray, hit: np.ndarray, firsts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        if not hit.any():
            return part
        total = np.diff(np.concatenate(([0], np.cumsum(hit)))[firsts])
        words = np.diff(firsts)
        texts: list = part.column(text_col).to_pylist()
        for t in np.flatnonzero(total).tolist():
            lo, hi = firsts[t], firsts[t + 1]
            own = np.flatnonzero(hit[lo:hi]) + lo
            runs = np.split(own, np.flatnonzero(np.diff(own) > 1) + 1)
            kept, at = [], offsets[t]
            for run in runs:
                kept.append(values[at : starts[run[0]]].tobytes())
                at = ends[run[-1]]
            kept.append(values[at : offsets[t + 1]].tobytes())
            texts[t] = b"".join(kept).decode("utf-8", "replace")
        keep = total < np.maximum(words, 1) * drop_share
        columns = list(part.columns)
        names = part.schema.names
        columns[names.index(text_col)] = pa.array(texts, part.schema.field(text_col).type)
        if "n_chars" in names:
            sizes = part.column("n_chars").to_pylist()
            for t in np.flatnonzero(total).tolist():
                sizes[t] = len(texts[t])
            columns[names.index("n_chars")] = pa.array(sizes, part.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(keep))

    if blocks is not None:
        whole = F.struct(*[documents[c] for c in documents.columns]).alias("whole")
        rows = staged(documents.select(F.monotonically_increasing_id().alias("row"), whole), "rows")
        hits = staged(_passes(rows.select("row", F.col("whole").getField(text_col).alias("text")), blocks), "merged")

        def cut_merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = batch.column("spans")
                part = pa.RecordBatch.from_struct_array(batch.column("whole"))
                values, offsets = text_buffer(part.column(text_col))
                starts, ends, firsts = word_spans(LOWER[values], offsets, ALNUM)
                words = np.diff(firsts).tolist()
                hit = np.concatenate([_united(np.array(s, np.int64), n) if s else np.zeros(n, bool) for s, n in zip(spans.to_pylist(), words, strict=True)] or [np.zeros(0, bool)])
                yield cleaned(part, values, offsets, hit, firsts, starts, ends)

        return rows.join(hits, "row", "left").select("whole", "spans").mapInArrow(cut_merged, schema)
    held = spark.sparkContext.broadcast(first)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                values, offsets = text_buffer(part.column(text_col))
                firsts, hit, _, starts, ends = held.value.scan(values, offsets)
                yield cleaned(part, values, offsets, hit, firsts, starts, ends)

    return documents.mapInArrow(cut, schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from scan_documents()."""
    joined: Column = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
