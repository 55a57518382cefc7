"""Structured Streaming jobs over the event log: counts, first deliveries, active time.

Watermarks close windows and duplicates are forgotten after the watermark, so those keep
bounded state.  Active time is a running total: it keeps four numbers for every key it has
seen, for as long as the stream lives, and takes events that come late as they come.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docweave.session import _ensure_checkpoint_dir


def source(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file stream with the event time as a timestamp ``at``; ``path`` may be a file or a directory."""
    glob = f"{path[:-1]}[{path[-1]}]"  # a pattern, since the source takes no single file
    return spark.readStream.schema(schema).parquet(glob).withColumn("at", F.col("ts").cast("timestamp"))


def first_deliveries(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Events without repeated deliveries that arrive within ``late``."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, by: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window; a window is emitted once, when the watermark passes it."""
    made = events.withWatermark("at", late).groupBy(F.window("at", length).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("w.start").alias("start"), by, "n", "total")


def active_time(events: DataFrame, key: str, changes: dict[str, int]) -> DataFrame:
    """Running active and paused microseconds of each key, updated with every micro-batch.

    Events of a micro-batch are taken in order of time; earlier ones than the last seen
    count from there.
    """

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, depth, active, paused = state.get if state.exists else (-1, 0, 0, 0)
        rows = pd.concat(batches).sort_values(["us", "event_id"])
        for us, kind in zip(rows["us"], rows["event_type"], strict=True):
            if last >= 0:
                span = max(0, int(us) - last)
                active, paused = (active, paused + span) if depth > 0 else (active + span, paused)
            last, depth = max(last, int(us)), max(0, depth + changes.get(kind, 0))
        state.update((last, depth, active, paused))
        yield pd.DataFrame({key: [keys[0]], "active": [active], "paused": [paused]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} long, active long, paused long", "last long, depth long, active long, paused long", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that is available now, written to the shared folder and read back."""
    spark = stream.sparkSession
    _ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    else:

        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")

        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema if mode == "append" else f"{stream.schema.toDDL()}, batch long").parquet(f"{base}/out")
