"""Stateful streams with timers: quarantine ring, deferred queue and debounced rebuilds.

State is a list of entries; a timer at the time an entry or a quiet period ends makes a user's
row change without a further event of that user, once the watermark is past it. Rows of a user
come in any order within the watermark's delay. Rings and bursts keep the users of a shard (by
hash) in one state with one timer, the earliest, since a call and its timers cost the same for
one user as for hundreds; what a shard holds is computed in whole columns. The session needs the
RocksDB state store, which ``with_timers`` sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from verdigris.session import ship

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Judgments that a quarantine entry may bear; others count as rejected.
KINDS = ("click", "view", "purchase")
#: Shards of the users. Those without an id have one of their own, NOBODY, so that ids stay whole numbers.
SHARDS, NOBODY = 1024, -1
#: Entries of a packed piece of state.
PIECE = 1 << 15


def with_timers(spark: SparkSession) -> SparkSession:
    """The session, set to keep streams' state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def sharded(events: DataFrame, late: str, shards: int) -> DataFrame:
    """The events with a watermark, their time in milliseconds (at) and the user's shard."""
    shard = F.when(F.col("user_id").isNull(), NOBODY).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(shards)).cast("int"))
    return events.withWatermark("ts", late).withColumns({"at": F.unix_millis("ts"), "shard": shard, "user_id": F.coalesce("user_id", F.lit(0)).cast("long")})


def _rows(state, columns: tuple[str, ...]):
    """The entries of a list state as a frame of whole numbers."""
    import pandas as pd

    pieces = [np.frombuffer(bytes(e[0]), "<i8").reshape(len(columns), -1) for e in state.get()]
    return pd.DataFrame(dict(zip(columns, np.concatenate([np.zeros((len(columns), 0), "<i8"), *pieces], axis=1), strict=True)))


def _put(state, frame, columns: tuple[str, ...]) -> None:
    """Hold a frame as packed columns of at most PIECE entries, since each row of a state costs a conversion."""
    if len(frame):
        whole = frame[list(columns)].to_numpy("<i8").T
        state.put([(np.ascontiguousarray(whole[:, k : k + PIECE]).tobytes(),) for k in range(0, len(frame), PIECE)])
    else:
        state.clear()


def _told(key, frame):
    """What is given out: the users of the shard without ids have none."""
    import pandas as pd

    return frame if key[0] != NOBODY else frame.assign(user_id=pd.array([None] * len(frame), "Int64"))


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    n = len(columns[0])
    return np.flatnonzero(np.r_[n > 0, np.any([c[1:] != c[:-1] for c in columns], axis=0)]) if n else np.zeros(0, "i8")


class Ring(StatefulProcessor):
    """The latest entries of a user with a time to live: (user_id, at, kept, has_rejected) at each change.

    An entry has expired when it is older than the time to live, strictly; then a timer prunes it.
    """

    COLUMNS = ("user_id", "at", "id", "rejected")

    def __init__(self, ttl_seconds: int, most: int):
        self.ttl, self.most = 1000 * ttl_seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "packed binary")

    def handleInputRows(self, key, rows: Iterator, timerValues: TimerValues) -> Iterator:  # noqa: N802
        import pandas as pd

        new = pd.concat([part[["user_id", "at", "event_id", "judgment"]] for part in rows]).rename(columns={"event_id": "id"})
        new["rejected"] = ~new["judgment"].isin(KINDS)
        held = _rows(self.entries, self.COLUMNS)
        touched = held["user_id"].isin(new["user_id"])
        ring = pd.concat([held[touched], new[list(self.COLUMNS)].astype("int64")]).sort_values(list(self.COLUMNS), ignore_index=True)
        now = ring.groupby("user_id")["at"].transform("max")
        ring = ring[now - ring["at"] <= self.ttl].groupby("user_id").tail(self.most)
        self._wait(pd.concat([held[~touched], ring]))
        told = ring.groupby("user_id", as_index=False).agg(at=("at", "max"), kept=("at", "size"), has_rejected=("rejected", "any"))
        yield _told(key, told)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator:  # noqa: N802
        import pandas as pd

        ring = _rows(self.entries, self.COLUMNS).sort_values(["user_id", "at", "id"], ignore_index=True)
        over = (ring["at"] + self.ttl + 1 <= timerValues.getCurrentWatermarkInMs()).to_numpy()
        users, at, rejected = ring["user_id"].to_numpy(), ring["at"].to_numpy(), ring["rejected"].to_numpy()
        # After the last entry of a user and time has gone, the user's later ones are left.
        ends, total = np.r_[_edges(users, at)[1:], len(at)] - 1, np.cumsum(rejected)
        ends = ends[over[ends]] if len(at) else ends[:0]
        last = np.searchsorted(users, users[ends], "right") - 1
        told = pd.DataFrame({"user_id": users[ends], "at": at[ends] + self.ttl + 1, "kept": last - ends, "has_rejected": total[last] > total[ends]})
        self._wait(ring[~over])
        yield _told(key, told)

    def _wait(self, ring) -> None:
        _put(self.entries, ring, self.COLUMNS)
        if len(ring):
            # One millisecond beyond its time to live.
            self.handle.registerTimer(int(ring["at"].min()) + self.ttl + 1)

    def close(self) -> None:
        pass


class Queue(StatefulProcessor):
    """A bounded queue for each key: of what is too large to be done at once, the latest stay, the oldest are dropped."""

    def __init__(self, defer_above: int, most: int):
        self.above, self.most = defer_above, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "id long")
        self.gone = handle.getValueState("dropped", "n long")

    def handleInputRows(self, key, rows: Iterator, timerValues: TimerValues) -> Iterator:  # noqa: N802
        import pandas as pd

        queue = [e[0] for e in self.entries.get()]
        gone = self.gone.get()[0] if self.gone.exists() else 0
        for part in rows:
            queue += [int(i) for i, size in zip(part["id"], part["size"], strict=True) if size > self.above]
        queue.sort()
        gone += max(0, len(queue) - self.most)
        queue = queue[-self.most :]
        if queue:
            self.entries.put([(i,) for i in queue])
        self.gone.update((gone,))
        yield pd.DataFrame({"key": [key[0]], "waiting": [len(queue)], "first": [queue[0] if queue else -1], "dropped": [gone]})

    def close(self) -> None:
        pass


class Quiet(StatefulProcessor):
    """One row for each burst of a user's events, when nothing has come for the quiet period.

    Open bursts are held as their ends and their number of events; an event within the quiet
    period of a burst joins it, and may join two to one.
    """

    COLUMNS = ("user_id", "first", "last", "n")

    def __init__(self, quiet_seconds: int):
        self.quiet = 1000 * quiet_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "packed binary")

    def handleInputRows(self, key, rows: Iterator, timerValues: TimerValues) -> Iterator:  # noqa: N802
        import pandas as pd

        new = [pd.DataFrame({"user_id": part["user_id"], "first": part["at"], "last": part["at"], "n": 1}) for part in rows]
        held = pd.concat([_rows(self.open, self.COLUMNS), *new]).sort_values(["user_id", "first"], ignore_index=True)
        user, first = held["user_id"].to_numpy(), held["first"].to_numpy()
        upto = held.groupby("user_id")["last"].cummax().to_numpy()
        starts = np.flatnonzero(np.r_[True, (user[1:] != user[:-1]) | (first[1:] - upto[:-1] >= self.quiet)])
        self._wait(pd.DataFrame({"user_id": user[starts], "first": first[starts], "last": np.maximum.reduceat(upto, starts), "n": np.add.reduceat(held["n"].to_numpy(), starts)}))
        return iter([_told(key, held[:0])])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator:  # noqa: N802
        held = _rows(self.open, self.COLUMNS)
        over = held["last"] + self.quiet <= timerValues.getCurrentWatermarkInMs()
        self._wait(held[~over])
        yield _told(key, held[over])

    def _wait(self, held) -> None:
        _put(self.open, held, self.COLUMNS)
        if len(held):
            self.handle.registerTimer(int(held["last"].min()) + self.quiet)

    def close(self) -> None:
        pass


def ring(events: DataFrame, late: str, ttl_seconds: int = 900, most: int = 128, shards: int = SHARDS) -> DataFrame:
    """Quarantine rings of (user_id, event_id, ts, judgment)."""
    ship(events.sparkSession)
    keyed = sharded(events, late, shards).groupBy("shard")
    return keyed.transformWithStateInPandas(Ring(ttl_seconds, most), "user_id long, at long, kept long, has_rejected boolean", "Update", "EventTime")


def queue(items: DataFrame, defer_above: int = 512, most: int = 256) -> DataFrame:
    """Deferred queues of (key, id, size)."""
    ship(items.sparkSession)
    return items.groupBy("key").transformWithStateInPandas(Queue(defer_above, most), "key string, waiting long, first long, dropped long", "Update", "None")


def bursts(events: DataFrame, late: str, quiet_seconds: int = 3, shards: int = SHARDS) -> DataFrame:
    """(user_id, first, last, n) of each burst of (user_id, ts), in milliseconds, once it is over."""
    ship(events.sparkSession)
    keyed = sharded(events, late, shards).groupBy("shard")
    return keyed.transformWithStateInPandas(Quiet(quiet_seconds), "user_id long, first long, last long, n long", "Append", "EventTime")
