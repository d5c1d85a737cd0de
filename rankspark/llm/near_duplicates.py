"""MinHash near-duplicates with sequential Bayesian verification.

Words are runs of anything but space and 0x09-0x0D, A-Z lower-cased; a document's set holds its distinct shingles of `shingle`
words. Documents with equal sets form a class, found by a 128-bit digest of the sorted set, and one representative (the
smallest id) goes on. Signatures of `HASHES` minima are banded; what shares a band is a candidate pair. A candidate's
signatures are compared in batches of `BATCH`, and it is dropped as soon as the posterior probability (uniform prior) that its
similarity reaches the threshold is under `MISS`. Survivors are confirmed on full shingle sets.

A bucket of m documents doesn't give all pairs. First each member is paired with the bucket's leader, another one in each
band. Links found so give groups. Buckets that still hold several groups are dealt into parts of about `BLOCK` documents and
`BLOCK_SHINGLES` shingles, and parts meet two by two: their signatures are compared batch by batch, and only documents with a
candidate in another group go on. Of these the hashed sets meet in the same blocks, which give one link for each two groups
that have one; links are confirmed on the full texts' sets. The members of one group of each bucket (the one with the smallest
label, as a rule the largest) needn't meet each other, so a bucket of one huge group and a few others stays linear. Every pair
that shares a band is thus compared or already connected: one path at every size, without a cap.

Hot band keys, leaders and sets are spread over salted parts of their rows (see common.lookup), so no task gets a bucket
whole; a task holds two parts, that is about 2 * BLOCK signatures, or 16 MB of sets and 16 MB of a product's chunk.

At a similarity of 0.8 a pair shares none of the 32 bands of 5 rows with probability 3e-6.

Defined results: null, empty and blank texts have an empty set, link with nothing and stay; ids must identify texts, rows that
repeat an id share its fate; a null id counts as larger than all, and of the rows with null ids link_documents() keeps those
whose class has no other id, keep_one() one text of each such class; other columns are not read by link_documents() and pass
through keep_one().
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SOLID, lookup, mix, salt, slices, small_batches, staged, text_buffer, windows, word_hashes, word_spans
from .components import connected_components

BANDS, ROWS, BATCH = 32, 5, 32
HASHES = BANDS * ROWS
#: Documents and shingles in a part of a bucket, on average.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
MISS = 1e-6
_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_WORDS = bytes(32 if not SOLID[c] else int(LOWER[c]) for c in range(256))


def posterior_bounds(threshold: float, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> list[int]:
    """After each batch, the fewest matches at which the posterior P(similarity >= threshold | matches) is at least `miss`."""
    bounds = []
    for n in range(batch, hashes + 1, batch):
        # with a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum
        for m in range(n + 1):
            tail = sum(math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))
            if tail >= miss:
                bounds.append(m)
                break
    return bounds


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of a set, folded to 32 bits."""
    least = None
    for at in range(0, len(shingles), 2048):
        part = (shingles[at : at + 2048, None] * _FACTORS[None, :]).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return (mix(least) >> np.uint64(32)).astype(np.uint32)


_SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("packed", T.BinaryType())])


def sketches(documents: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, the set's digest, its signature and its band keys; the last three null for empty sets."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                values, offsets = text_buffer(part.column("text"))
                raw = LOWER[values]
                starts, ends, firsts = word_spans(raw, offsets, SOLID)
                words = word_hashes(raw, starts, ends)
                each = windows(words, shingle)
                sizes, digests, sigs, keys, packed = [], [], [], [], []
                for lo, hi in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
                    if hi == lo:
                        sizes.append(0), digests.append(None), sigs.append(None), keys.append(None), packed.append(None)
                        continue
                    own = each[lo : hi - shingle + 1] if hi - lo >= shingle else mix(windows(words[lo:hi], hi - lo) + np.uint64(hi - lo))
                    own = np.unique(own)
                    sig = signature(own)
                    sizes.append(len(own))
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    sigs.append(sig.astype(np.uint8).tobytes())  # a chance match of 1 in 256 only prunes less
                    keys.append(_band_keys(sig))
                    packed.append(keys[-1].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "sig", "keys", "packed"],
                )

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SKETCH)


def _band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for k in range(ROWS):
        key = mix(key ^ rows[:, k]) + np.uint64(k)
    return key.astype(np.int64)


def likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose signatures are not pruned."""
    bounds = posterior_bounds(threshold)
    small_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            alive = np.arange(batch.num_rows)
            matches = np.zeros(batch.num_rows, np.int64)
            for k, least in enumerate(bounds):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(alive)), batch.column("b").take(pa.array(alive))], names=["a", "b"])

    a = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"))
    b = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))
    return lookup(lookup(pairs, "a", a, "b"), "b", b, "a").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def shingle_set(text: str | None, shingle: int) -> frozenset | set:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split(b" ")
    words = [w for w in words if w]
    if len(words) < shingle:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(shingle)), strict=False))


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets have 100 * intersection >= percent * union. texts: (id, text), one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                a = batch.column("a")[i].as_py()
                if last[0] != a:
                    last = a, shingle_set(batch.column("text_a")[i].as_py(), shingle)
                other = shingle_set(batch.column("text_b")[i].as_py(), shingle)
                both = len(last[1] & other)
                if 100 * both >= percent * (len(last[1]) + len(other) - both) and both:
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(good, pa.int64())), batch.column("b").take(pa.array(good, pa.int64()))], names=["a", "b"])

    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return lookup(lookup(pairs, "a", a, "b"), "b", b, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _links(pairs: DataFrame, reps: DataFrame, documents: DataFrame, shingle: int, percent: int) -> DataFrame:
    close = staged(likely(pairs, reps, percent / 100), "likely")
    return staged(confirmed(close, _texts_of(close.select(F.explode(F.array("a", "b")).alias("id")), documents), shingle, percent), "confirmed")


def _texts_of(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, text) of the ids, one row each."""
    wanted = ids.distinct()
    return staged(documents.join(wanted.hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "texts")


_HELD = T.StructType([T.StructField("rep", T.LongType()), T.StructField("set", T.BinaryType())])


def _hashed_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """Of each text (id, text): rep and set, its sorted shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                values, offsets = text_buffer(part.column("text"))
                raw = LOWER[values]
                starts, ends, firsts = word_spans(raw, offsets, SOLID)
                words = word_hashes(raw, starts, ends)
                each = windows(words, shingle)
                sets = [np.unique(each[lo : hi - shingle + 1]) if hi - lo >= shingle else np.zeros(0, np.uint64) for lo, hi in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([x.tobytes() for x in sets], pa.binary())], names=_HELD.names)

    return texts.mapInArrow(run, _HELD)


_MET = T.StructType([T.StructField("key", T.LongType()), T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("rep", T.LongType()), T.StructField("group", T.LongType())])


def _candidates(rows: pa.Table, bounds: list[int]) -> pa.Table:
    """The rows of two parts (key, i, j, rep, group, side, minor, band, sig, keys) to those documents of either side that have
    a candidate of another group on the other, by batches of signatures. A pair that shares an earlier band is left to that."""
    reps, groups, side, minor = (rows.column(c).to_numpy() for c in ("rep", "group", "side", "minor"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
    keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.int64).reshape(-1, BANDS)
    x, y = sigs[left], sigs[right]
    # two members of the smaller groups meet twice, once on either side; either order will do
    open_ = (groups[left][:, None] != groups[right][None, :]) & (~minor[right][None, :] | (reps[left][:, None] < reps[right][None, :]))
    grid = np.zeros(open_.shape, np.int16)
    for h in range(BATCH):
        grid += x[:, h, None] == y[None, :, h]
    i, j = np.nonzero(open_ & (grid >= bounds[0]))
    matches = grid[i, j].astype(np.int64)
    for k, least in enumerate(bounds[1:], 1):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches += (x[i, part] == y[j, part]).sum(axis=1)
        alive = matches >= least
        i, j, matches = i[alive], j[alive], matches[alive]
    band = rows.column("band")[0].as_py()
    fresh = ~(keys[left[i], :band] == keys[right[j], :band]).any(axis=1)
    found = np.union1d(left[i[fresh]], right[j[fresh]])
    _, once = np.unique(reps[found], return_index=True)
    return rows.take(pa.array(found[once])).select(_MET.names)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a list of sets, by products over chunks of the shared elements."""
    out = np.zeros((len(sets), len(sets)), np.int64)
    if not sets:
        return out
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.concatenate(([True], every[1:] != every[:-1]))
    place = np.cumsum(first) - 1
    shared = np.bincount(place)[place] > 1
    place, owner = np.unique(place[shared], return_inverse=True)[1], owner[shared]
    for lo in range(0, int(place.max(initial=-1)) + 1, 4096):
        a, b = np.searchsorted(place, (lo, lo + 4096))
        grid = np.zeros((len(sets), 4096), np.float32)
        grid[owner[a:b], place[a:b] - lo] = 1
        out += (grid @ grid.T).astype(np.int64)
    return out


def _block_links(rows: pa.Table, percent: int) -> pa.Table:
    """The candidates (rep, group, set) of two parts to links between different groups, one for each two groups."""
    groups, reps = rows.column("group").to_numpy(), rows.column("rep").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()]
    both = _overlaps(sets)
    sizes = np.array([len(x) for x in sets])
    near = (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) & (both > 0) & (groups[:, None] < groups[None, :])
    x, y = np.nonzero(near)
    _, first = np.unique(np.stack([groups[x], groups[y]], 1), axis=0, return_index=True) if len(x) else (None, np.zeros(0, int))
    x, y = x[first], y[first]
    return pa.table({"a": np.minimum(reps[x], reps[y]), "b": np.maximum(reps[x], reps[y])})


def _banded(reps: DataFrame, *more: str) -> DataFrame:
    """A row for each band of each representative, with the salt of its part of a hot key."""
    return reps.select("rep", *more, F.posexplode("keys").alias("band", "key")).withColumn("_salt", salt("rep"))


def _buckets(banded: DataFrame, **sums: Column) -> DataFrame:
    """Of each (key, _salt) the sums over the key's rows. Salted counts first, then a window over a key's few salts."""
    parts = banded.groupBy("key", "_salt").agg(*[c.alias(n) for n, c in sums.items()])
    whole = Window.partitionBy("key")
    over = {n: (F.min if n in ("least", "lo") else F.max if n == "hi" else F.sum)(n).over(whole) for n in sums}
    return parts.select("key", "_salt", *[c.alias(n) for n, c in over.items()])


def _leader_pairs(reps: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket with its leader, the least id after an exclusive or with a hash of the key."""
    mask = F.xxhash64("key")
    banded = _banded(reps)
    leaders = staged(_buckets(banded, size=F.count("*"), least=F.min(F.col("rep").bitwiseXOR(mask))).where("size > 1").select("key", "_salt", F.col("least").bitwiseXOR(mask).alias("leader")), "leaders")
    return banded.join(leaders.hint("merge"), ["key", "_salt"]).where("rep <> leader").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()


def _meetings(reps: DataFrame, groups: DataFrame) -> DataFrame | None:
    """The rows of all meetings of two parts of a bucket that holds several groups and three members or more (a bucket of two
    has been compared), or None. Members of the smaller groups are on side 0 against all on side 1."""
    known = reps.join(groups.hint("merge"), F.col("rep") == F.col("node"), "left").select("rep", "n_shingles", "keys", F.coalesce("label", "rep").alias("group"))
    banded = _banded(staged(known, "grouped"), "group", "n_shingles")
    split = _buckets(banded, size=F.count("*"), total=F.sum("n_shingles"), lo=F.min("group"), hi=F.max("group")).where("lo <> hi and size > 2")
    split = staged(split, "split")
    if not split.limit(1).count():
        return None
    members = staged(banded.join(split.hint("merge"), ["key", "_salt"]).select("key", "_salt", "rep", "group", "band", "n_shingles", (F.col("group") != F.col("lo")).alias("minor")), "members")
    small = members.where("minor").groupBy("key").agg(F.count("*").alias("few"), F.sum("n_shingles").alias("part"))

    def parts(size: str, total: str) -> Column:
        return F.ceil(F.greatest(F.col(size) / BLOCK, F.col(total) / BLOCK_SHINGLES))

    dealt = split.join(small.hint("merge"), "key").select("key", "_salt", parts("few", "part").alias("rows"), parts("size", "total").alias("columns"))
    placed = members.join(dealt.hint("merge"), ["key", "_salt"]).join(reps.select("rep", "sig", F.col("packed").alias("keys")).hint("merge"), "rep")
    place = F.xxhash64("rep", "key")
    own = ["key", "rep", "group", "band", "minor", "sig", "keys"]
    ahead = placed.where("minor").select(*own, F.lit(0).alias("side"), F.pmod(place, F.col("rows")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)).alias("j"))
    facing = placed.select(*own, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("i"), F.pmod(place, F.col("columns")).alias("j"))
    return ahead.unionByName(facing)


def link_documents(documents: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest id reachable) and kept."""
    return _linked(documents, shingle, percent, id_col, text_col).drop("digest")


def _linked(documents: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """link_documents() with the digest of each document's set."""
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    drawn = staged(sketches(source, shingle, "id"), "sketches")
    full = drawn.where("digest is not null")
    classes = staged(full.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    owners = classes.where("rep is not null").withColumnRenamed("digest", "own")
    reps = full.join(owners.hint("merge"), (full["doc_id"] == owners["rep"]) & (full["digest"] == owners["own"])).dropDuplicates(["rep"])
    reps = staged(reps.select("rep", "n_shingles", "sig", "keys", "packed"), "reps")
    groups = connected_components(_links(_leader_pairs(reps), reps, source, shingle, percent))

    meetings = _meetings(reps, groups)
    if meetings is not None:
        bounds = posterior_bounds(percent / 100)

        def meet(rows: pa.Table) -> pa.Table:
            return _candidates(rows, bounds)

        def link(rows: pa.Table) -> pa.Table:
            return _block_links(rows, percent)

        met = staged(meetings.groupBy("key", "i", "j").applyInArrow(meet, _MET), "met")
        texts = _texts_of(met.select(F.col("rep").alias("id")), source)
        sets = staged(_hashed_sets(texts, shingle), "sets")
        found = met.join(sets.hint("merge"), "rep").select("key", "i", "j", "rep", "group", "set").groupBy("key", "i", "j").applyInArrow(link, "a long, b long")
        more = staged(confirmed(staged(found.distinct(), "found"), texts, shingle, percent), "confirmed")
        groups = connected_components(_stars(groups).union(more))

    named = classes.join(groups.hint("merge"), F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("label", "rep").alias("component"))
    slim = drawn.select("doc_id", "n_shingles", "digest")
    joined = lookup(slim, "digest", named, "doc_id", "left").select("doc_id", "n_shingles", "digest", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull()))


def _stars(groups: DataFrame) -> DataFrame:
    return groups.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))


def keep_one(documents: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates of one of smaller id, in their own columns."""
    linked = staged(_linked(documents, shingle, percent, id_col, text_col), "linked")
    gone = linked.where("not kept and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    named = documents.where(F.col(id_col).isNotNull()).join(gone.hint("merge"), id_col, "left_anti").select(*documents.columns)
    nameless = documents.where(F.col(id_col).isNull())
    if not nameless.limit(1).count():
        return named
    # rows without an id are told by a hash of their texts
    tagged = nameless.withColumn("_tag", F.xxhash64(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    drawn = staged(sketches(tagged, shingle, "_tag", text_col).select(F.col("doc_id").alias("_tag"), "digest"), "nameless")
    alone = linked.where("component_id is null and digest is not null").select("digest").distinct()
    one = drawn.join(alone.hint("merge"), "digest", "left_semi").groupBy("digest").agg(F.min("_tag").alias("_tag")).select("_tag")
    single = tagged.join(one.hint("merge"), "_tag", "left_semi").dropDuplicates(["_tag"])
    blank = tagged.join(drawn.where("digest is null").select("_tag").distinct().hint("merge"), "_tag", "left_semi")
    return named.unionByName(single.drop("_tag")).unionByName(blank.drop("_tag"))
