"""Live event logs with Structured Streaming: tail, dedup, per-run state machines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from planlens.operators.events import INTERNAL_TYPES
from planlens.workspace import Scratch

#: The state that an event leads a run to, by state and type; a run that ended stays as it is.
STEPS = {
    ("NEW", "RUN_STARTED"): "RUNNING", ("RUNNING", "RUN_PAUSED"): "PAUSED", ("PAUSED", "RUN_RESUMED"): "RUNNING", ("RUNNING", "RUN_CANCELLED"): "CANCELLED", ("PAUSED", "RUN_CANCELLED"): "CANCELLED",
    ("RUNNING", "RUN_COMPLETED"): "SUCCEEDED", ("RUNNING", "RUN_FAILED"): "FAILED",
}


def tail(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """New rows of the Parquet table ``name`` in a folder, a file or a folder of part files, as they arrive."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{folder}/{name}")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def catch_up(stream: DataFrame, scratch: Scratch, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, exactly once, and return what it wrote."""
    schema = stream.schema
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", scratch.path(f"{name}-progress"))
    if mode == "append":
        writer = writer.format("parquet").option("path", scratch.path(name))
    else:  # a batch replaces what an earlier one wrote for it, so retries don't repeat rows
        writer = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(scratch.path(f"{name}/batch={n}")))
    writer.start().awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(scratch.path(name)).select(*schema.names)


def visible_after(events: DataFrame, cursor: int) -> DataFrame:
    """The tail that a user sees from an exclusive cursor on."""
    return events.filter((F.col("event_id") > cursor) & ~F.col("event_type").isin(*INTERNAL_TYPES))


def once(commands: DataFrame, keys: list[str], within: str | None = None, time: str = "created_at") -> DataFrame:
    """The first of each key; ``within`` bounds the state by a watermark, else it grows with the keys."""
    return commands.withWatermark(time, within).dropDuplicatesWithinWatermark(keys) if within else commands.dropDuplicates(keys)


def run_states(events: DataFrame) -> DataFrame:
    """run_id, state, steps, refused after each batch: legal steps move a run, others are counted. Events of tasks aren't a run's steps."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, steps, refused = state.get if state.exists else ("NEW", 0, 0)
        for kind in pd.concat(list(frames)).sort_values("event_id")["event_type"]:
            following = STEPS.get((now, kind))
            now, steps, refused = (following, steps + 1, refused) if following else (now, steps, refused + 1)
        state.update((now, steps, refused))
        yield pd.DataFrame({"run_id": [key[0]], "state": [now], "steps": [steps], "refused": [refused]})

    return events.filter(F.col("event_type").isin(*{kind for _, kind in STEPS})).select("run_id", "event_id", "event_type").groupBy("run_id").applyInPandasWithState(advance, "run_id long, state string, steps long, refused long", "state string, steps long, refused long", "update", GroupStateTimeout.NoTimeout)
