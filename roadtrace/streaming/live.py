"""Live operators keyed by drive, on Structured Streaming.

State is per drive and small: times and counters. Rows that are not newer than the last processed one are dropped
(FLT03), so a late or repeated row can't alter a result; within a micro-batch a drive's rows are put in order first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def throttled(stream: DataFrame, key: str, time: str, tie: str, step: int) -> DataFrame:
    """STR09, WIN15: at most one row per ``step``, counted from the last kept, with the number suppressed since."""
    fields = [stream.schema[c] for c in (key, time, tie)]
    out = T.StructType([*fields, T.StructField("suppressed", T.LongType())])
    state = T.StructType([T.StructField("kept", T.LongType()), T.StructField("seen", T.LongType()), T.StructField("dropped", T.LongType())])

    def step_key(keys: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values([time, tie], kind="stable")
        kept, seen, dropped = held.get if held.exists else (None, None, 0)
        found = []
        for t, i in zip(rows[time].tolist(), rows[tie].tolist(), strict=True):
            if seen is not None and t < seen:
                continue  # late
            seen = t
            if kept is None or t - kept >= step:
                found.append((keys[0], t, i, dropped))
                kept, dropped = t, 0
            else:
                dropped += 1
        if seen is not None:
            held.update((kept, seen, dropped))
        yield pd.DataFrame(found, columns=[f.name for f in out])

    return stream.select(key, time, tie).groupBy(key).applyInPandasWithState(step_key, out, state, "append", GroupStateTimeout.NoTimeout)


def silent(stream: DataFrame, key: str, time: str, limit_ms: int) -> DataFrame:
    """STR18: (key, last) of drives without data for ``limit_ms`` of processing time."""
    out = T.StructType([stream.schema[key], T.StructField("last", T.LongType())])

    def watch(keys: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            (last,) = held.get
            held.remove()
            yield pd.DataFrame({key: [keys[0]], "last": [last]})
            return
        last = max([int(b[time].max()) for b in batches if len(b)], default=0)
        held.update((max(last, held.get[0]) if held.exists else last,))
        held.setTimeoutDuration(limit_ms)

    return stream.select(key, time).groupBy(key).applyInPandasWithState(watch, out, T.StructType([T.StructField("last", T.LongType())]), "append", GroupStateTimeout.ProcessingTimeTimeout)


def current_session(stream: DataFrame, sessions: DataFrame, session: str = "session_id") -> DataFrame:
    """STR19: rows of the sessions that are current; late rows of older ones fall away."""
    return stream.join(sessions.select(session), session, "left_semi")


def blocks(stream: DataFrame, ts: str, value: str, size: str, late: str) -> DataFrame:
    """WIN07 live: tumbling blocks behind a watermark (an extension: the batch form has no lateness)."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size)).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def run_to_end(stream: DataFrame, folder: str, *, mode: str = "append") -> DataFrame:
    """Runs ``stream`` over what its source holds now; the result is read back from ``folder``, which all nodes share."""
    spark = stream.sparkSession
    if mode == "append":
        started = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).outputMode("append").start()
    else:
        started = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).outputMode(mode).start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
