"""At-least-once results to one row a key: keyed state lets a row through that is newer than what its key has, and a sink whose batches
replace themselves keeps what was let through.

Keys are dealt into groups by a hash, and the state of a group is a table of its keys: the newest version of each and the time until which
it is held. A task meets a group's rows with its table at once, so no key costs a call. A source may give a row any number of times, in
any order, over restarts: what is not newer goes no further. A batch that ran twice writes its folder anew. A key whose newest time is
`ttl` behind the watermark loses its state, which bounds the store; a row that comes again later is let through again, and current() still
gives the newest version once. Expiry goes by the rows' own times, so a run over given files gives the same rows whenever it runs, and ends.

Defined results: rows without a version or time, or with a null in a key, are left out; of rows of equal version the first wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, StructField, StructType

#: Groups that keys are dealt into; part of what a checkpoint holds.
GROUPS = 1024


def _newest(frame: pd.DataFrame, keys: list[str], version: str) -> pd.DataFrame:
    """The first row of the largest version of each key, with the key's largest _until, and _at, that row's place."""
    frame = frame.reset_index(drop=True)
    own = frame.groupby(keys, sort=False, dropna=False)
    at = own[version].idxmax().to_numpy()
    return frame.loc[at].assign(_until=own["_until"].max().to_numpy(), _at=at)


def _packed(table: pd.DataFrame) -> bytes:
    found, sink = pa.Table.from_pandas(table, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema) as out:
        out.write_table(found)
    return sink.getvalue().to_pybytes()


def newer(rows: DataFrame, keys: list[str], version: str, time: str, ttl: str = "7 days", late: str = "1 hour") -> DataFrame:
    """The rows of a stream that are newer than all before with their key; at most one a key and batch."""
    kinds = rows.schema
    quiet = int(pd.Timedelta(ttl).total_seconds() * 1000)
    columns = [*keys, version, "_until"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else None
        found, best = None, None
        for frame in frames if not state.hasTimedOut else ():
            if len(frame):
                found = _newest(frame if found is None else pd.concat([found, frame]), keys, version)
        if found is not None:
            found["_until"] = found["_until"].clip(lower=now) + quiet
            fresh = found[columns].assign(_came=True)
            both = fresh if held is None else pd.concat([held.assign(_came=False), fresh])
            n, whole = len(both) - len(fresh), _newest(both, keys, version)
            best = found.iloc[whole["_at"].to_numpy()[whole["_at"].to_numpy() >= n] - n]
            came = both.reset_index(drop=True).groupby(keys, sort=False, dropna=False)["_came"].max().to_numpy()
            held = whole.loc[came | (whole["_until"] >= now).to_numpy(), columns]
        else:
            held = held[held["_until"] >= now]
        if len(held):
            state.update((_packed(held),))
            state.setTimeoutTimestamp(int(held["_until"].min()))
        else:
            state.remove()
        if best is not None and len(best):
            yield best[kinds.names]

    present = F.col(version).isNotNull() & F.col(time).isNotNull()
    for k in keys:
        present &= F.col(k).isNotNull()
    store = StructType([StructField("held", BinaryType())])
    dealt = rows.where(present).withWatermark(time, late).withColumns({"_until": F.unix_millis(time), "_group": F.pmod(F.xxhash64(*keys), F.lit(GROUPS))})
    return dealt.groupBy("_group").applyInPandasWithState(step, kinds, store, "update", GroupStateTimeout.EventTimeTimeout)


def upsert(rows: DataFrame, keys: list[str], version: str, time: str, sink: str, checkpoint: str, ttl: str = "7 days", late: str = "1 hour") -> StreamingQuery:
    """Writes newer() rows of a stream to sink, a folder a batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return newer(rows, keys, version, time, ttl, late).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, sink: str, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key in a sink."""
    found = spark.read.parquet(sink).drop("batch")
    rest = [c for c in found.columns if c not in keys]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, "_r.*")
