"""Late rows, state, joins of streams; as-of and interval joins with hot keys and any length; sketches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quernstone.operators import sketches as K
from quernstone.operators import temporal as T
from quernstone.operators.ranking import range_number, ranged
from quernstone.streaming import windows as S

DAY = datetime(2024, 1, 1)
EVENTS = "user string, ts timestamp, n int, value double"


def fed(spark, tmp_path, *files):
    """A stream of the files, one in each micro-batch; rows (user, minute, n, value)."""
    import os

    for k, rows in enumerate(files):
        df = spark.createDataFrame([(u, DAY + timedelta(minutes=m), n, v) for u, m, n, v in rows], EVENTS)
        df.coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        part = next(x for x in os.listdir(tmp_path / f"in{k}") if x.startswith("part"))
        os.makedirs(tmp_path / "events.parquet", exist_ok=True)
        os.rename(tmp_path / f"in{k}" / part, tmp_path / "events.parquet" / f"{k}.parquet")
        os.utime(tmp_path / "events.parquet" / f"{k}.parquet", (1_700_000_000 + 60 * k,) * 2)
    return S.file_stream(spark, str(tmp_path), "events", spark.createDataFrame([], EVENTS).schema, files=1)


def minute(r):
    return round((r - DAY).total_seconds() / 60)


def test_late_rows_are_left_out_and_state_falls(spark, tmp_path):
    """Windows of an hour, a delay of 30 minutes. The fourth file has a row for hour 0, which has gone by then, and one that is late but in time.

    What is too late goes by the watermark that the micro-batch before began with.
    """
    stream = fed(spark, tmp_path, [("a", 10, 1, 1.0), ("a", 50, 2, 1.0)], [("a", 70, 3, 1.0), ("a", 200, 4, 1.0)], [("a", 201, 9, 1.0)], [("a", 20, 5, 1.0), ("a", 175, 6, 1.0), ("a", 205, 7, 1.0)], [("a", 500, 8, 1.0)])
    got = S.run(S.windowed(stream, "ts", S.tumbling("ts", "1 hour"), ["user"], "30 minutes", F.collect_list("n").alias("n")), "append")
    rows = sorted((minute(r.start), sorted(r.n)) for r in got.table.collect())
    assert rows == [(0, [1, 2]), (60, [3]), (120, [6]), (180, [4, 7, 9])]  # 5 was too late; 8's hour is still open
    assert got.late == 1 and max(got.state) > got.state[-1] == 1
    everything = S.run(S.windowed(stream, "ts", S.tumbling("ts", "1 hour"), ["user"], "30 minutes", F.collect_list("n").alias("n")))
    assert sorted(n for r in everything.table.collect() for n in r.n) == list(range(1, 10)) and everything.late == 0


def test_keys_are_forgotten(spark, tmp_path):
    stream = fed(spark, tmp_path, [("a", 0, 1, 1.0), ("a", 1, 2, 1.0), ("b", 2, 3, 1.0)], [("a", 20, 4, 1.0), ("c", 300, 5, 1.0)], [("d", 303, 8, 1.0)], [("b", 301, 6, 1.0), ("c", 302, 7, 1.0)])
    got = S.run(S.first_of_each(stream, "ts", ["user"], "30 minutes"), "append")
    assert sorted((r.user, r.n) for r in got.table.collect()) in ([("a", n), ("b", 3), ("b", 6), ("c", 5), ("d", 8)] for n in (1, 2)) and got.state[-1] <= 3


def test_streams_joined_by_interval(spark, tmp_path):
    left = fed(spark, tmp_path / "x", [("a", 60, 1, 1.0), ("b", 60, 2, 1.0)], [("a", 400, 3, 1.0)], [("a", 1000, 4, 1.0)])
    right = fed(spark, tmp_path / "y", [("a", 30, 10, 1.0), ("a", 61, 11, 1.0), ("b", 59, 12, 1.0)], [("a", 345, 13, 1.0), ("a", 320, 14, 1.0)], [("c", 1000, 15, 1.0)])
    got = S.run(S.within(left, right, "user", "ts", "1 hour", "0 minutes", "10 minutes"), "append")
    assert sorted((r.n, r.right_n) for r in got.table.collect()) == [(1, 10), (2, 12), (3, 13)] and got.state[-1] < max(got.state)
    outer = S.run(S.within(left.where("user = 'a'"), right.where("user = 'b'"), "user", "ts", "1 hour", "0 minutes", "10 minutes", "leftOuter"), "append")
    assert {(r.n, r.right_n) for r in outer.table.collect()} <= {(1, None), (3, None), (4, None)}


def test_own_state_over_batches(spark, tmp_path):
    stream = fed(spark, tmp_path, [("a", 1, 2, 3.0), ("a", 0, 1, 5.0), ("b", 0, 1, 1.0)], [("a", 2, 3, 4.0), ("a", 3, 4, None), ("a", 4, 5, 3.0)], [("a", 5, 6, 2.0), ("b", 60 * 24 * 40, 2, 9.0)], [("c", 60 * 24 * 200, 1, 1.0)], [("c", 60 * 24 * 201, 2, 2.0)])
    got = S.run(S.best_so_far(stream, "user", "ts", "value", "n", 2, "1 day"), "append")
    rows = sorted((r.user, r.epoch, r.n, r.best, r.waited, r.stopped) for r in got.table.collect())
    assert [r for r in rows if r[0] == "a"] == [("a", 1, 1, 5.0, 0, False), ("a", 2, 2, 3.0, 0, False), ("a", 3, 3, 3.0, 1, False), ("a", 4, 5, 3.0, 2, True), ("a", 5, 6, 2.0, 0, False)]
    assert [r[1:] for r in rows if r[0] == "c"] == [(1, 1, 1.0, 0, False), (2, 2, 1.0, 1, False)] and max(got.state) == 2 > got.state[-1]  # a and b have been forgotten


def test_as_of_with_one_key(spark):
    """One key that holds all rows is cut into many ranges; keys alternate with it; ties and nulls."""
    rng = random.Random(1)
    left = [(k, t, i) for i, (k, t) in enumerate((rng.choice(["hot"] * 8 + ["x", "y", None]), rng.choice([None, *range(400)])) for _ in range(300))]
    right = [(k, t, 1000 + i, rng.choice([None, i])) for i, (k, t) in enumerate((rng.choice(["hot"] * 8 + ["x", None]), rng.choice([None, *range(400)])) for _ in range(120))]
    a, b = spark.createDataFrame(left, "k string, t int, i long"), spark.createDataFrame(right, "k string, t int, j long, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        got = {r.i: (r.j, r.v) for r in T.as_of_join(a, b, "k", "t", ["j", "v"], "j").collect()}
        assert ranged(a.where("k = 'hot'"), F.col("k"), F.col("t")).select(range_number()).distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 300
    for k, t, i in left:
        best = max(((u, j, v) for q, u, j, v in right if k is not None and t is not None and q == k and u is not None and u <= t), default=(None, None, None), key=lambda x: x[:2])
        assert got[i] == best[1:]


def test_intervals_of_any_length(spark):
    rng = random.Random(2)
    spans = [(rng.choice("ab"), a, a + rng.choice([0, -5, 1, 2, 7, 1000, 10**8, 10**11]), i) for i, a in enumerate(rng.randrange(-(10**6), 10**6) for _ in range(60))]
    points = [(rng.choice("abc"), rng.choice([None, rng.randrange(-(10**6), 10**6), rng.choice(spans)[1]]), i) for i in range(200)]
    p, s = spark.createDataFrame(points, "k string, at long, p long"), spark.createDataFrame(spans, "k string, start long, end long, s long")
    got = sorted((r.p, r.s) for r in T.interval_join(p, s, "k", "at", "start", "end").collect())
    assert got == sorted((i, j) for k, t, i in points for q, a, b, j in spans if t is not None and k == q and a <= t < b)
    most = s.where("end > start").select(F.size(T.pieces(F.col("start"), F.col("end"))).alias("n"), F.log2(F.col("end") - F.col("start") + 1).alias("bits"))
    assert most.where("n > 2 * bits + 2").count() == 0
    assert T.interval_join(p, s.limit(0), "k", "at", "start", "end").count() == 0


def test_merged_sketches(spark):
    df = spark.range(40_000).select((F.col("id") % 7).alias("part"), (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 9000).alias("d"), F.col("id").cast("double").alias("v"), F.when(F.col("id") % 2 == 0, "even").otherwise((F.col("id") % 5).cast("string")).alias("i"))
    stored = K.sketched(df, ["part", "g"], F.col("d"), F.col("v"), F.col("i"))
    assert stored.count() == 21
    for r in K.answers(K.merged(stored, ["g"]), ["g"], [0.0, 0.25, 0.5, 1.0], 2).collect():
        own = [x for x in range(40_000) if x % 3 == r.g]
        different = len({x * 7 % 9000 for x in own})
        assert r.n == len(own) and r.distinct_low <= different <= r.distinct_high and abs(r.distinct - different) < 0.05 * different
        assert r.quantiles[0] == own[0] and r.quantiles[3] == own[-1]
        for q, p in zip(r.quantiles[1:3], (0.25, 0.5), strict=True):
            assert abs(sum(x <= q for x in own) / len(own) - p) < K.RANK_ERROR
        assert r.top[0]["item"] == "even" and r.top[0]["count"] == sum(x % 2 == 0 for x in own)
    whole = K.answers(K.merged(stored, []), [], [0.5], 1).first()
    assert whole.n == 40_000 and abs(whole.quantiles[0] - 20_000) < K.RANK_ERROR * 40_000
    assert K.merged(stored.limit(0), ["g"]).count() == 0


@pytest.mark.parametrize("size", [1, 5])
def test_spans_have_no_width_to_choose(spark, size):
    s = spark.createDataFrame([("k", 0, size)], "k string, start long, end long")
    p = spark.createDataFrame([("k", i) for i in range(-1, 7)], "k string, at long")
    assert sorted(r.at for r in T.interval_join(p, s, "k", "at", "start", "end").collect()) == list(range(size))


@pytest.mark.parametrize("few", [0, 3, 64])
def test_intervals_are_never_broadcast(spark, few):
    """Spans by key and by piece give the same pairs, and neither side is sent to the driver, however small its estimate is."""
    p = spark.createDataFrame([(k, t) for k in range(6) for t in range(0, 40, 3)] + [(1, None), (None, 5)], "k int, at long")
    s = spark.createDataFrame([(k, i, i + 1 + i % 7) for k in range(6) for i in range(3 * k)] + [(2, 9, 9), (2, 9, 4), (None, 0, 99), (3, None, 5)], "k int, start long, end long")
    got = T.interval_join(p, s, "k", "at", "start", "end", few)
    want = sorted((r.k, r.at, x.start, x.end) for r in p.collect() for x in s.collect() if None not in (r.k, r.at, x.start) and r.k == x.k and x.start <= r.at < x.end)
    assert sorted(tuple(r) for r in got.select("k", "at", "start", "end").collect()) == want
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
