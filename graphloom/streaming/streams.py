"""Structured Streaming: windows, sessions, gap state, idempotent upserts, incremental jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..shared import Scratch


def read(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over a Parquet folder or file with the schema it has now."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return r.parquet(path)
    folder, _, name = path.rpartition("/")  # streams read folders: the file's own, narrowed to it
    return r.option("pathGlobFilter", name).parquet(folder)


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks take TIMESTAMP only; the session's zone is UTC, so the cast keeps the reading."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def drain(stream: DataFrame, mode: str, scratch: Scratch) -> DataFrame:
    """Runs a query over what is there and returns its result as a table."""
    spark = stream.sparkSession
    scratch.n += 1
    out = f"{scratch.root}/{scratch.n}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def keep(batch: DataFrame, n: int) -> None:  # complete mode: each batch is the whole result
        batch.write.mode("overwrite").parquet(f"{out}/{n}")
        scratch.last = f"{out}/{n}"

    scratch.last = None
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}-state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(scratch.last) if scratch.last else spark.createDataFrame([], stream.schema)


def tumbling(stream: DataFrame, ts: str, keys: list[str], width: str, late: str = "1 hour") -> DataFrame:
    return event_time(stream, ts).withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), *keys, "n")


def sessions(df: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    """Batch or stream: sessions of a key, closed by a pause of ``gap``."""
    return event_time(df, ts).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def gap_state(stream: DataFrame, key: str, ts: str, hours: float) -> DataFrame:
    """(key, from_ts, to_ts, gap_hours) of events more than ``hours`` after the one before of their key; keeps one time a key."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0]) if state.exists else None
        times = pd.concat([b[ts] for b in batches]).sort_values()
        rows = []
        for t in times:
            if last is not None and (t - last).total_seconds() / 3600 > hours:
                rows.append((k[0], last, t, (t - last).total_seconds() / 3600))
            last = t if last is None or t > last else last
        state.update((last.to_pydatetime(),))
        yield pd.DataFrame(rows, columns=[key, "from_ts", "to_ts", "gap_hours"])

    kind = stream.schema[key].dataType.simpleString()
    return event_time(stream, ts).select(key, ts).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, from_ts timestamp, to_ts timestamp, gap_hours double", "last timestamp", "append", "NoTimeout")


#: Parts the table of an upserting stream is kept in; a micro-batch rewrites those its keys fall into.
PARTS = 64


def upsert_stream(stream: DataFrame, keys: list[str], order: str, scratch: Scratch, parts: int = PARTS) -> DataFrame:
    """The last row of each key after all micro-batches: each batch is merged into the parts of the table its keys fall into."""
    spark = stream.sparkSession
    state: dict[int, str] = {}
    bucket = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")

    def merge(batch: DataFrame, n: int) -> None:
        new, new_path = scratch.write(batch.withColumn("part__", bucket))
        touched = sorted(r[0] for r in new.select("part__").distinct().collect())  # parts at most
        if not touched:
            return
        old = [state[p] for p in touched if p in state]
        both = new.drop("part__") if not old else new.drop("part__").unionByName(spark.read.schema(stream.schema).parquet(*old))
        rest = [c for c in both.columns if c not in keys]
        last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r")).select(*keys, *[F.col("r").getField(c).alias(c) for c in rest])
        scratch.n += 1
        out = f"{scratch.root}/{scratch.n}"
        last.withColumn("part__", bucket).repartition("part__").write.partitionBy("part__").parquet(out)
        state.update({p: f"{out}/part__={p}" for p in touched})
        for path in [*old, new_path]:
            scratch.drop(path)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{scratch.root}/state-{scratch.n}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(*state.values()).select(*stream.columns) if state else spark.createDataFrame([], stream.schema)


def incremental(stream: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs the caller's batch job on each micro-batch of what is there; no ingestion job comes with the package."""
    stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Progress(StreamingQueryListener):
    """Collects (batch, rows) of each micro-batch: the status feed."""

    def __init__(self) -> None:
        self.seen: list[tuple[int, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.seen.append((event.progress.batchId, event.progress.numInputRows))

    def onQueryTerminated(self, event) -> None:
        pass
