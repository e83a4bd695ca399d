"""Tasks that become ready as what they depend on completes, as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ready_tasks(completions: DataFrame, edges: DataFrame, expires_after_ms: int | None = None) -> DataFrame:
    """plan_id, i, once for each task whose dependencies all completed.

    ``completions`` is a stream (plan_id, i; 0 is the plan's input), ``edges`` (plan_id, i, dep) a table. A
    completion is sent to the tasks that wait for it, and each task keeps what it has seen: as many ids as it has
    dependencies, and after that only that it was ready, so completions may come twice and in any order
    and batches. State is dealt by task: a large run is no hot key. With ``expires_after_ms`` a task
    forgets what it knew that long after its last completion, by event time; ``completions`` then have created_at and a watermark.
    Without it a task of one dependency needs no Python: it is ready at the first completion, and Spark drops later ones.
    """
    timed = expires_after_ms is not None
    kept = ["plan_id", "dep", *(["created_at"] if timed else [])]
    needs = edges.groupBy("plan_id", "i").agg(F.collect_set("dep").alias("deps")).select("plan_id", "i", F.size("deps").alias("needed"), F.explode("deps").alias("dep"))
    told = completions.withColumnRenamed("i", "dep").select(*kept).join(needs, ["plan_id", "dep"])

    def wait(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, done = (set(state.get[0]), state.get[1]) if state.exists else (set(), False)
        for frame in frames:
            if not done:
                seen |= set(frame["dep"].tolist())
                done = len(seen) == int(frame["needed"].iloc[0])
                if done:
                    seen = set()
                    yield pd.DataFrame({"plan_id": [key[0]], "i": [key[1]]})
        state.update((sorted(seen), done))
        if timed:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + expires_after_ms)

    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    stateful = lambda rows: rows.groupBy("plan_id", "i").applyInPandasWithState(wait, "plan_id long, i long", "seen array<long>, done boolean", "append", timeout)
    if timed:
        return stateful(told)
    single = told.filter("needed = 1").select("plan_id", F.col("i").cast("long").alias("i")).dropDuplicates(["plan_id", "i"])
    return stateful(told.filter("needed > 1")).unionByName(single)
