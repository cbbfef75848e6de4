"""Activity as a stream: observations (path, hash, ts) of changing files.

Late rows are dropped behind a watermark; state is kept for each path and ends
when a path hasn't been observed for a given time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SEEN = "path string, first_us long, last_us long, observed long"
STATE = "first long, last long, at long, hash string, n long"


def slices(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(path, start, n) for each tumbling slice."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "path").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("path", F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(path, start, end, n): observations of a path less than ``gap`` apart make one session."""
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "path").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("path", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_last_seen(events: DataFrame, late: str = "1 hour", forget_ms: int | None = None) -> DataFrame:
    """Updates (path, first_us, last_us, observed): last moves only when the hash does.

    Rows of a batch are taken in time order; one that is older than what its
    path has shown already counts as observed and may move first back only.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, last, at, held, n = state.get if state.exists else (None, None, None, None, 0)
        batch = pd.concat(list(frames))
        batch["us"] = batch["ts"].astype("datetime64[us]").astype("int64")
        for us, h in batch.sort_values(["us", "event_id"])[["us", "hash"]].itertuples(index=False):
            n += 1
            if first is None or us < first:
                first = us
            if at is None or us >= at:
                if n == 1 or h != held:
                    last, held = us, h
                at = us
        state.update((int(first), int(last), int(at), held, int(n)))
        if forget_ms is not None:
            state.setTimeoutTimestamp(max(at // 1000, state.getCurrentWatermarkMs()) + forget_ms)
        yield pd.DataFrame({"path": [key[0]], "first_us": [first], "last_us": [last], "observed": [n]})

    timeout = GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.EventTimeTimeout
    return events.withWatermark("ts", late).groupBy("path").applyInPandasWithState(step, SEEN, STATE, "update", timeout)


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs ``stream`` over what is there, into Parquet below ``folder`` with its batch number, and reads it back.

    A batch that is run again after a failure replaces its own folder.
    """
    spark = stream.sparkSession
    base = f"{folder}/stream-{uuid.uuid4().hex}"

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/rows/batch={batch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/rows")


def latest(updates: DataFrame, key: str) -> DataFrame:
    """The last update of each key by batch number."""
    rest = [c for c in updates.columns if c not in (key, "batch")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def events_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of observations."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf + "/")
    return e.select(F.col("user_id").cast("string").alias("path"), F.col("value").cast("string").alias("hash"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
