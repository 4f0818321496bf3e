"""The activity log as a stream: each query gives what its batch twin gives on the same rows, as far as watermarks let it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, ListState, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from ..operators.activity import accepted


def read_events(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def debounced(inputs: DataFrame, millis: int = 150, late: str = "10 minutes") -> DataFrame:
    """The last input of each session of a user's inputs less than `millis` apart, with its columns, once the watermark has passed. In append
    mode a session comes out once, so the last ones wait for later events; `closing` gives a stream such."""
    w = F.session_window("ts", f"{millis} milliseconds")
    others = [c for c in inputs.columns if c not in ("user_id", "ts", "event_id")]
    last = inputs.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.max(F.struct("ts", "event_id", *others)).alias("last"))
    return last.select("user_id", "last.*")


def closing(events: DataFrame, after: str) -> DataFrame:
    """One event of no user, `after` the last of a finished log: a stream that reads it passes the watermark over all the others."""
    last = events.agg((F.max("ts") + F.expr(f"INTERVAL {after}")).alias("ts")).filter("ts IS NOT NULL")
    return last.select(*[(F.col("ts") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])


_POSITION = ["no_user", "user_id", "article_id", "us", "no_event", "event_id", "percent"]
_CHUNK = 65_536  # rows of one value in the state store


def _chunks(rows: pd.DataFrame) -> list[tuple[bytes]]:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    out = []
    for at in range(0, len(rows), _CHUNK):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table.slice(at, _CHUNK))
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _rows(state: ListState) -> pd.DataFrame:
    """What `_chunks` has put into a state."""
    found = [pa.ipc.open_stream(bytes(x[0])).read_pandas() for x in state.get()] if state.exists() else []
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({c: [] for c in _POSITION}).astype({"no_user": bool, "us": "int64", "no_event": bool, "event_id": "int64"}).assign(owed=True)


class _Throttle(StatefulProcessor):
    """Reading positions of one bucket of users and articles. Positions wait until the watermark has passed them, so that they are taken in the
    order of time, whatever order they came in; an accepted one waits for its delayed write.

    States are chunks of rows, so the calls to the state store grow with buckets and micro-batches, not with users and articles. The last
    accepted position is forgotten once the watermark is `millis` past it, as any later one is accepted then without it.
    """

    def __init__(self, step: float, millis: int, settle: int):
        self.step, self.millis, self.settle = step, millis, settle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.last = handle.getListState("last", "rows binary")  # the last accepted position of each user and article; `owed` if its write is due
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            if len(batch):
                self.waiting.appendList(_chunks(batch[_POSITION]))
                first = min(int(batch["us"].min()), first) if first is not None else int(batch["us"].min())
        if first is not None and (not self.due.exists() or first // 1000 + 1 < self.due.get()[0]):
            self._wake(first // 1000 + 1)
        return iter(())

    def _wake(self, ms: int) -> None:
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if not self.due.exists() or self.due.get()[0] > now:  # another timer of this bucket has done the work
            return
        rows, last = _rows(self.waiting), _rows(self.last)
        ready = rows["us"] < now * 1000
        rest = rows[~ready]
        out, last = self._walk(last, rows[ready], now)
        wake = [] if last.empty else [int(last["us"].max()) // 1000 + self.millis, *(last.loc[last["owed"], "us"] // 1000 + self.settle + 1)]
        wake += [] if rest.empty else [int(rest["us"].min()) // 1000 + 1]
        for state, kept in ((self.waiting, rest), (self.last, last)):
            state.clear()
            if len(kept):
                state.put(_chunks(kept))
        self.due.clear()
        if wake:
            self._wake(int(min(wake)))
        if len(out):
            yield out

    def _walk(self, last: pd.DataFrame, ready: pd.DataFrame, now: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """What comes out, and the last accepted positions that are still needed."""
        both = pd.concat([x for x in (last, ready.assign(owed=True)) if len(x)] or [ready.assign(owed=True)], ignore_index=True)
        keys, new = both.groupby(["no_user", "user_id", "article_id"], dropna=False, sort=False).ngroup().to_numpy(), np.arange(len(both)) >= len(last)
        order = np.lexsort((both["event_id"], ~both["no_event"], both["us"], new, keys))
        both, keys, new = both.iloc[order], keys[order], new[order]
        us, percent, take = both["us"].to_numpy(), both["percent"].to_numpy(), ~new
        ends = np.flatnonzero(np.diff(keys, append=-1)) + 1
        for a, z in zip([0, *ends], ends, strict=False):
            b = a + int(not new[a])
            take[b:z], _ = accepted(us[b:z] // 1000, percent[b:z], (int(us[a]) // 1000, float(percent[a])) if b > a else None, self.step, self.millis)
        both, keys, us = both[take], keys[take], us[take]
        end = np.diff(keys, append=-1) != 0
        written = np.where(end, us + self.settle * 1000 < now * 1000, np.diff(us, append=0) > self.settle * 1000)
        told = both["owed"].to_numpy(bool) & (~end | written)
        out = both[told].drop(columns="owed").assign(written=written[told])
        both = both.assign(owed=both["owed"].to_numpy(bool) & ~told)
        return out, both[end & (both["owed"].to_numpy() | (now - us // 1000 < self.millis))]

    def close(self) -> None:
        pass


#: What `throttled` needs of a session: a state store that keeps several states for a key.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


BUCKETS = 256  # groups of users and articles that share a state of `throttled`


def throttled(positions: DataFrame, step: float = 0.05, millis: int = 1500, settle: int = 250, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(user_id, article_id, ts, event_id, percent, written) as by `operators.activity.throttle`: accepted positions, once it is known whether
    each is written `settle` milliseconds later or another was accepted before. Needs STATE_STORE. Users and articles are dealt over `buckets`; the state
    of a bucket holds what the watermark has not passed, the last accepted positions of the last `millis`, and the writes that are due, which a timer
    lets out. A task holds one bucket at a time; a stream keeps its number of buckets."""
    rows = positions.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    known = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)  # noqa: E731  pandas has no null in a column of whole numbers
    bucket = F.pmod(F.xxhash64("user_id", "article_id"), F.lit(buckets)).alias("bucket")
    rows = rows.select(bucket, "ts", F.unix_micros("ts").alias("us"), F.col("user_id").isNull().alias("no_user"), known("user_id"), "article_id", F.col("event_id").isNull().alias("no_event"), known("event_id"), F.col("percent").cast("double").alias("percent"))
    schema = "no_user boolean, user_id long, article_id string, us long, no_event boolean, event_id long, percent double, written boolean"
    out = rows.filter("us IS NOT NULL").groupBy("bucket").transformWithStateInPandas(_Throttle(step, millis, settle), schema, "append", "eventTime")
    some = lambda c, no: F.when(~F.col(no), F.col(c)).alias(c)
    return out.select(some("user_id", "no_user"), "article_id", F.timestamp_micros("us").alias("ts"), some("event_id", "no_event"), "percent", "written")


COMPACT = 8  # micro-batches after which what they wrote is put together


def _folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the complete folders path/name=N."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    found = [x.getPath() for x in system.listStatus(root) if x.getPath().getName().startswith(f"{name}=")]
    return sorted(int(x.getName().split("=")[1]) for x in found if system.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


def _remove(spark: SparkSession, path: str) -> None:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def _stored(spark: SparkSession, path: str, up_to: int | None = None) -> DataFrame | None:
    """The latest base and the batches after it, as far as `up_to`."""
    bases = [n for n in _folders(spark, path, "base") if up_to is None or n <= up_to]
    base = bases[-1] if bases else -1
    parts = [f"{path}/base={base}"] if bases else []
    parts += [f"{path}/batch={n}" for n in _folders(spark, path, "batch") if n > base and (up_to is None or n <= up_to)]
    if not parts:
        return None
    rows = spark.read.schema("user_id long, article_id string, percent double, percent_at struct<ts:timestamp_ntz,event_id:bigint>, updated_at timestamp_ntz").parquet(*parts)
    return rows.groupBy("user_id", "article_id").agg(F.max_by("percent", "percent_at").alias("percent"), F.max("percent_at").alias("percent_at"), F.max("updated_at").alias("updated_at"))


def upsert_progress(updates: DataFrame, path: str, checkpoint: str, compact: int = COMPACT) -> StreamingQuery:
    """Keep per user and article the last update: each micro-batch writes its own last percents, and when they were told, to path/batch=N; every
    `compact` batches they are put together with what was there in path/base=N, and older folders go. So the folders are
    bounded however long the stream runs.

    A batch that is run again after a failure overwrites its own folder, or, if a base holds it, does nothing; a base
    that was not finished is written anew. Nothing counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bases = _folders(spark, path, "base")
        if not bases or bases[-1] < number:
            at = F.struct(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").cast("long").alias("event_id"))
            told = F.when(F.col("percent").isNotNull(), at)
            last = batch.groupBy("user_id", "article_id").agg(F.max_by("percent", told).alias("percent"), F.max(told).alias("percent_at"), F.max("ts").cast("timestamp_ntz").alias("updated_at"))
            last.write.mode("overwrite").parquet(f"{path}/batch={number}")
            if (number + 1) % compact == 0:
                _stored(spark, path, number).write.mode("overwrite").parquet(f"{path}/base={number}")
                bases = _folders(spark, path, "base")
        for name in ("base", "batch"):  # what the latest base holds; a batch that reads at this moment may have to read again
            for n in _folders(spark, path, name):
                if bases and (n < bases[-1] or name == "batch" and n <= bases[-1]):
                    _remove(spark, f"{path}/{name}={n}")

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_progress(spark: SparkSession, path: str) -> DataFrame:
    """The table that upsert_progress keeps, as of now."""
    found = _stored(spark, path)
    if found is None:
        return spark.createDataFrame([], "user_id long, article_id string, percent double, updated_at timestamp_ntz")
    return found.drop("percent_at")
