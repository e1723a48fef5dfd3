"""Streams with timers: what expires or falls quiet without a further event of its key."""

import datetime as dt

import pytest

from verdigris.streaming import streams, timers


@pytest.fixture
def session(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield timers.with_timers(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def millis(seconds):
    return int(at(seconds).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def batches(spark, tmp_path, parts, schema):
    """A stream with one file a trigger, in order."""
    import time

    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in the order of their times
        del k
    return streams.replay(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)


def ran(df, tmp_path, mode):
    return streams.to_files(df, str(tmp_path / "out"), mode, str(tmp_path / "cp")).collect()


def test_ring_expires_without_an_event_of_its_key(session, tmp_path):
    schema = "user_id long, event_id long, ts timestamp, judgment string"
    parts = [
        [(1, 1, at(0), "error"), (1, 2, at(100), "click")],
        [(2, 3, at(950), "view")],  # only another key: the watermark passes 900
        [(2, 4, at(2000), "view"), (2, 5, at(2001), "view"), (2, 6, at(2002), "view")],
        [(2, 7, at(2003), "view")],
    ]
    got = sorted((r.user_id, r.at, r.kept, r.has_rejected) for r in ran(timers.ring(batches(session, tmp_path, parts, schema), "0 seconds", 900, 2), tmp_path, "update"))
    one = [g for g in got if g[0] == 1]
    assert one == [(1, millis(100), 2, True), (1, millis(900) + 1, 1, False), (1, millis(1000) + 1, 0, False)]
    assert (2, millis(2002), 2, False) in got  # no more than two stay


def test_bursts_end_when_it_is_quiet(session, tmp_path):
    schema = "user_id long, ts timestamp"
    parts = [[(1, at(0)), (1, at(2)), (1, at(10)), (2, at(1))], [(1, at(11)), (2, at(40))], [(3, at(100))], [(3, at(200))]]
    got = sorted((r.user_id, r.first, r.last, r.n) for r in ran(timers.bursts(batches(session, tmp_path, parts, schema), "0 seconds", 3), tmp_path, "append"))
    m = millis
    assert got == [(1, m(0), m(2), 2), (1, m(10), m(11), 2), (2, m(1), m(1), 1), (2, m(40), m(40), 1), (3, m(100), m(100), 1)]


def test_queue_drops_the_oldest(session, tmp_path):
    parts = [[("a", k, 600 if k % 2 else 512) for k in range(10)], [("a", 20, 9999), ("b", 1, 10)]]
    got = sorted((r.key, r.waiting, r.first, r.dropped) for r in ran(timers.queue(batches(session, tmp_path, parts, "key string, id long, size long"), 512, 4), tmp_path, "update"))
    assert got == [("a", 4, 3, 1), ("a", 4, 5, 2), ("b", 0, -1, 0)]


class Handle:
    """A state in memory that counts timers."""

    def __init__(self):
        self.rows, self.timers = [], []

    def getListState(self, name, schema):  # noqa: N802
        return self

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows

    def clear(self):
        self.rows = []


class Now:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815


@pytest.mark.parametrize("kind", [lambda: timers.Quiet(3), lambda: timers.Ring(3, 8)], ids=["t2_bursts", "t1_ring"])
def test_a_shard_has_one_timer_for_all_its_users(kind):
    import pandas as pd

    rows = pd.DataFrame([(u, 1_000_000 + 10_000 * k, k, "view", at(1000 + 10 * k)) for u in range(50) for k in range(20)], columns=["user_id", "at", "event_id", "judgment", "ts"])
    handle, processor = Handle(), kind()
    processor.init(handle)
    list(processor.handleInputRows((7,), iter([rows[:600], rows[600:]]), Now(0)))
    assert len(handle.timers) == 1
    told = pd.concat(processor.handleExpiredTimer((7,), Now(1_500_000), Now(handle.timers[0])))
    assert len(told) == (1000 if isinstance(processor, timers.Quiet) else 50) and not handle.rows and len(handle.timers) == 1


def test_late_events_join_bursts_and_nobody_is_a_user(session, tmp_path):
    """An event between two open bursts makes them one; events without a user are those of one user."""
    schema = "user_id long, ts timestamp"
    big = 2**60 + 1
    parts = [[(1, at(10)), (big, at(20))], [(1, at(14)), (big, at(30)), (None, at(30))], [(1, at(34)), (None, at(31)), (None, at(33)), (1, at(12))], [(9, at(99))], [(9, at(200))]]
    got = sorted((r.user_id or 0, r.first, r.last, r.n) for r in ran(timers.bursts(batches(session, tmp_path, parts, schema), "60 seconds", 3), tmp_path, "append"))
    m = millis
    assert got == [(0, m(30), m(33), 3), (1, m(10), m(14), 3), (1, m(34), m(34), 1), (9, m(99), m(99), 1), (big, m(20), m(20), 1), (big, m(30), m(30), 1)]
