"""Decision tables, parsers and statistics on hand-computed rows."""

import math

import pytest
from pyspark.sql import functions as F

from verdigris.functions import scoring as S
from verdigris.functions import text as T
from verdigris.operators import evidence as E
from verdigris.operators import folds
from verdigris.operators import statistics as St


def values(spark, schema, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_chunker_keeps_the_overlap(spark):
    (chunks,) = values(spark, "t string", [("x" * 1500,)], T.fixed_chunks(F.col("t")))[0]
    assert [(c.start, len(c.chunk)) for c in chunks] == [(0, 800), (700, 800), (1400, 100)]
    with pytest.raises(ValueError):
        T.fixed_chunks(F.col("t"), 10, 10)


def test_entities_are_decoded_in_order(spark):
    assert values(spark, "t string", [("a&amp;lt;b <i>c</i>",)], T.unescaped(F.col("t"))) == [("a<b c",)]


def test_source_name_strips_a_run(spark):
    got = values(spark, "u string", [("https://www.wired.com/x",), ("http://Example.org",)], T.source_name(F.col("u")))
    assert got == [("ired.com",), ("example.org",)]


def test_scripts(spark):
    rows = [("こんにちは",), ("中文",), ("한국어",), ("привет",), ("the cat of the house",), ("ok",)]
    assert [r[0] for r in values(spark, "t string", rows, T.script_language(F.col("t")))] == ["ja", "zh", "ko", "ru", "en", "en"]


def test_letters(spark):
    rows = [("B.",), ("it is **C**",), ("The answer is (d)",), ("well (E).",), (r"\boxed{F}",), ("maybe G then",), ("not A",), ("",)]
    letter, layer = T.parsed_letter(F.col("t"))
    assert values(spark, "t string", rows, letter, layer) == [("B", "exact"), ("C", "bold"), ("D", "tagged"), ("E", "terminal"), ("F", "boxed"), ("G", "last"), (None, "none"), (None, "none")]


def test_volatility_table(spark):
    rows = [(True, False), (True, True), (False, True), (False, False)]
    assert [r[0] for r in values(spark, "h boolean, l boolean", rows, S.volatility(F.col("h"), F.col("l")))] == [0.85, 0.25, 0.10, 0.45]


def test_controller_by_hand(spark):
    steps = spark.createDataFrame([(1, k, 0.37, 0.1) for k in range(40)] + [(2, 0, 0.0, 0.0)], "session_id long, seq long, pi double, fresh double")
    got = {(r.session_id, r.seq): r.phi for r in folds.controller(steps).collect()}
    phi = 0.2
    for n in range(1, 41):
        phi = max(0, min(1, phi + 0.3 + 0.02 - 0.1 * min(1, n / 10)))
        assert math.isclose(got[1, n - 1], phi, abs_tol=1e-12)
    assert all(0 <= p <= 1 for p in got.values())
    assert {(r.session_id, r.seq): round(r.phi, 9) for r in folds.controller_long(steps, 3).collect()} == {k: round(p, 9) for k, p in got.items()}


def test_wilson_vectors(spark):
    low, high = St.wilson(F.col("k"), F.col("n"))
    got = values(spark, "k long, n long", [(8, 30), (0, 20)], F.round(low * 100, 2), F.round(high * 100, 2))
    assert got == [(14.18, 44.45), (0.0, 16.11)]


def test_mcnemar_exact(spark):
    chi, p = St.mcnemar(F.col("b"), F.col("c"))
    got = values(spark, "b long, c long", [(10, 2), (0, 0), (5, 5)], chi, F.round(p, 6))
    assert got[0] == (49 / 12, round(2 * sum(math.comb(12, k) for k in range(3)) / 2**12, 6))
    assert got[1] == (0.0, 1.0) and got[2][1] == 1.0


def test_bootstrap_holds_the_mean(spark):
    diff = spark.createDataFrame([(k, (k % 3) - 1) for k in range(300)], "id long, diff int")
    low, high = St.bootstrap(diff, 200).first()
    assert -0.2 < low < 0 < high < 0.2


def test_current_words_go_first(spark):
    got = values(spark, "t string", [("the latest archived",), ("archived",), ("plain",)], E.freshness(F.col("t")))
    assert [r[0] for r in got] == ["current", "stale", "acceptable"]


def test_rates_without_denominator(spark):
    assert values(spark, "a long, b long", [(1, 0), (1, 4)], St.rate(F.col("a"), F.col("b"))) == [(None,), (0.25,)]


def test_streams_agree_with_the_batch_fold(spark, sf_dir, tmp_path):
    from verdigris.plans.states import steps
    from verdigris.session import table
    from verdigris.streaming import streams

    table(spark, sf_dir, "events").repartitionByRange(3, "event_id").sortWithinPartitions("event_id").write.parquet(str(tmp_path / "e"))
    batch = steps(spark, sf_dir)
    live = streams.replay(spark, str(tmp_path / "e"), table(spark, sf_dir, "events").schema, 10)
    live = live.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), (0.37 * F.least(F.lit(1.0), F.col("value") / 150)).alias("pi"), F.when(F.col("event_type") == "error", 0.1).otherwise(0.0).alias("fresh"))
    out = streams.to_files(streams.controller_states(live), str(tmp_path / "controller"), "update", str(tmp_path / "cp"))
    want = {r.session_id: round(r.phi, 9) for r in folds.controller(batch).groupBy("session_id").agg(F.max_by("phi", "seq").alias("phi")).collect()}
    assert {r.session_id: round(r.phi, 9) for r in out.collect()} == want


def test_streamed_quarantine_keeps_a_ring(spark, sf_dir, tmp_path):
    from verdigris.session import table
    from verdigris.streaming import streams

    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("judgment"))
    e.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "e"))
    live = streams.replay(spark, str(tmp_path / "e"), e.schema, 1)
    out = streams.to_files(streams.quarantine(live, 86_400 * 3, 4), str(tmp_path / "ring"), "update", str(tmp_path / "cp")).collect()
    rows: dict = {}
    for r in e.collect():
        rows.setdefault(r.user_id, []).append(r)
    last = {}
    for r in out:
        last[r.user_id] = r
    assert last.keys() == rows.keys() and all(1 <= r.kept <= 4 for r in last.values())
    assert sum(r.has_rejected for r in last.values()) > 0


def test_merged_counts_and_sessions(spark, sf_dir, tmp_path):
    from verdigris.operators import folds
    from verdigris.session import table
    from verdigris.streaming import streams

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartitionByRange(2, "event_id").write.parquet(str(tmp_path / "e"))
    live = streams.replay(spark, str(tmp_path / "e"), e.schema, 1)
    streams.merged_counts(live, str(tmp_path / "counts"), str(tmp_path / "cp1"), "user_id")
    newest = max((tmp_path / "counts").iterdir(), key=lambda p: int(p.name[1:]))
    got = {r.user_id: r.hits for r in spark.read.parquet(str(newest)).collect()}
    assert got == {r.user_id: r["count"] for r in e.groupBy("user_id").count().collect()}
    quiet = streams.to_files(streams.quiet_sessions(streams.replay(spark, str(tmp_path / "e"), e.schema, 10), "ts", "user_id", "1 hour", "60 days"), str(tmp_path / "quiet"), "complete", str(tmp_path / "cp2"))
    assert quiet.agg(F.sum("n")).first()[0] == e.count()
    assert quiet.count() == folds.sessions_by_gap(e, "user_id", "ts", "1 hour", "event_id").count()
