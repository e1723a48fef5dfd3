"""Structured Streaming forms of the stateful operators; each has a batch twin in plans."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("click", "view", "purchase")


def replay(spark: SparkSession, folder: str, schema, per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number of files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def tumbling(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts per window and key; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def quiet_sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions that end after a quiet gap (debounce)."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def hit_counts(events: DataFrame, key: str) -> DataFrame:
    """Running counts for update mode."""
    return events.groupBy(key).agg(F.count("*").alias("hits"), F.max("ts").alias("last"))


def controller_states(steps: DataFrame) -> DataFrame:
    """The controller's state per session after each micro-batch, from (session_id, seq, pi, fresh)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    from verdigris.operators import folds
    from verdigris.session import ship

    ship(steps.sparkSession)

    def run(key, parts: Iterator, state: GroupState):
        import pandas as pd

        phi, n = state.get if state.exists else (folds.START, 0)
        rows = pd.concat(list(parts)).sort_values("seq")
        for pi, fresh in zip(rows["pi"], rows["fresh"], strict=True):
            n += 1
            phi = max(0.0, min(1.0, phi + folds.GAIN * min(1.0, pi / folds.SCALE) + folds.FRESH * max(0.0, min(1.0, fresh)) - folds.DAMP * min(1.0, n / 10.0)))
        state.update((phi, n))
        yield pd.DataFrame({"session_id": [key[0]], "phi": [phi], "n": [n]})

    return steps.groupBy("session_id").applyInPandasWithState(run, "session_id long, phi double, n long", "phi double, n long", "update", GroupStateTimeout.NoTimeout)


def quarantine(events: DataFrame, ttl_seconds: int, most: int) -> DataFrame:
    """A ring of the latest entries per user with a time to live, from (user_id, event_id, ts, judgment)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    from verdigris.session import ship

    ship(events.sparkSession)

    def run(key, parts: Iterator, state: GroupState):
        import pandas as pd

        rows = pd.concat(list(parts))
        ring = list(zip(*state.get, strict=True)) if state.exists else []
        ring += [(int(pd.Timestamp(t).timestamp() * 1000), int(i), j if j in KINDS else "rejected") for t, i, j in zip(rows["ts"], rows["event_id"], rows["judgment"], strict=True)]
        now = max(t for t, _, _ in ring)
        ring = sorted(x for x in ring if now - x[0] <= 1000 * ttl_seconds)[-most:]
        state.update(tuple(list(c) for c in zip(*ring, strict=True)))
        yield pd.DataFrame({"user_id": [key[0]], "kept": [len(ring)], "has_rejected": [any(j == "rejected" for _, _, j in ring)]})

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, kept long, has_rejected boolean", "ts array<bigint>, ids array<bigint>, judgments array<string>", "update", GroupStateTimeout.NoTimeout)


def to_files(df: DataFrame, path: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there into files, one folder for each batch, and read them.

    A batch that runs again overwrites its own folder. Mode complete gives the last batch, the
    others all that was emitted.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = df.sparkSession.read.schema(df.schema.add("batch", "long")).parquet(path)
    if mode == "complete":
        rows = rows.filter(F.col("batch") == (rows.agg(F.max("batch")).first()[0] or 0))
    return rows.drop("batch")


def append_log(df: DataFrame, path: str, checkpoint: str) -> None:
    """An append-only file sink."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged_counts(df: DataFrame, path: str, checkpoint: str, key: str) -> None:
    """Fold each micro-batch's counts into a table that is rewritten under a new version."""
    from verdigris.operators.stores import flushed

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        delta = batch.groupBy(key).agg(F.count("*").alias("hits"), F.max("ts").alias("last"))
        old = spark.read.parquet(f"{path}/v{number - 1}") if number else delta.limit(0)
        flushed(old, delta, key).write.mode("overwrite").parquet(f"{path}/v{number}")

    df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
