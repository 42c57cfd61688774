import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.streaming import stateful

SCHEMA = "k string, id long, ts timestamp, x double, y double, slope string"


def _log(spark, rows):
    """k, id, minute, y; x is the minute. A column slope is there to clash."""
    made = spark.createDataFrame([(k, i, float(m), y) for k, i, m, y in rows], "k string, id long, m double, y double")
    return made.select("k", "id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("m") * 60).alias("ts"), F.col("m").alias("x"), "y", F.lit("z").alias("slope"))


def _slopes(parts, folder, rows=3):
    out = stateful.in_parts(parts, str(folder), lambda log: stateful.ordered_slopes(log, "k", "id", "ts", "x", "y", rows, "10 minutes"))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len({(k, i) for k, i, _ in got})
    return {(k, i): s for k, i, s in got}


def test_slopes_follow_event_time_over_restarts(spark, tmp_path):
    first = [("a", 3, 2, 9.0), ("a", 1, 0, 1.0), ("a", 2, 1, 4.0), ("a", 2, 1, 4.0), ("b", 4, 1, 5.0), ("b", None, 1, 5.0), (None, 5, 1, 5.0), ("b", 6, 2, None), ("a", 7, 15, 0.0)]
    # until minute 5 all is told; what comes for minute 4 then is late, for 14 it is not
    second = [("a", 8, 4, 100.0), ("a", 9, 14, 2.0), ("b", 10, 14, 8.0), ("b", 11, 14, 9.0), ("c", 12, 40, 1.0), ("c", 13, 30, 7.0)]
    got = _slopes([_log(spark, first), _log(spark, second)], tmp_path)
    points = {"a": [(1, 0, 1), (2, 1, 4), (3, 2, 9), (9, 14, 2), (7, 15, 0)], "b": [(4, 1, 5), (10, 14, 8), (11, 14, 9)]}
    want = {(k, p[0]): stateful.slope([(float(x), float(y)) for _, x, y in ps[max(0, n - 2) : n + 1]]) for k, ps in points.items() for n, p in enumerate(ps)}
    assert got == {k: None if v is None else pytest.approx(v) for k, v in want.items()}  # at the watermark, minute 30, and after it rows still wait


def _at(spark, rows):
    """k, id and milliseconds."""
    made = spark.createDataFrame(rows, "k string, id long, m long")
    return made.select("k", "id", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("m")).alias("ts"), F.col("m").cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit("z").alias("slope"))


@pytest.mark.parametrize(("last", "told"), [(600_000, 0), (600_001, 1), (600_002, 2)])
def test_rows_are_told_as_soon_as_the_watermark_has_passed(spark, tmp_path, last, told):
    rows = [("a", 1, 0), ("b", 2, 1), ("c", 3, 2), ("c", 4, last)]
    assert set(_slopes([_at(spark, rows)], tmp_path / "one")) == {("a", 1), ("b", 2)} & {(k, i) for k, i, _ in rows[:told]}
    later = [*rows[:3], ("c", 4, 600_000)], [("c", 5, last)]
    assert set(_slopes([_at(spark, p) for p in later], tmp_path / "two")) == {(k, i) for k, i, _ in rows[:told]}


def test_many_slopes_at_once_are_the_same():
    r = np.random.default_rng(1)
    place = np.concatenate([np.arange(n) for n in (1, 2, 3, 9, 10, 11, 40)])
    x, y = r.integers(0, 3, len(place)) * 1e6 + r.integers(0, 2, len(place)), r.random(len(place))
    for rows in (1, 2, 3, 10):
        got = stateful.trailing_slopes(place, x, y, rows)
        for k, p in enumerate(place):
            want = stateful.slope(list(zip(x[: k + 1], y[: k + 1], strict=True))[k - min(p, rows - 1) :])
            assert np.isnan(got[k]) if want is None else got[k] == pytest.approx(want, rel=1e-9, abs=1e-12)


class Handle:
    """State in lists that counts what is asked of it."""

    def __init__(self):
        self.calls, self.held = 0, []

    def getListState(self, *_):
        return self

    getValueState = getListState

    def get(self):
        self.calls += 1
        held = list(self.held)
        return held if self.calls == 3 else None

    def call(self, *values):
        self.calls += 1
        self.held += values

    appendValue = put = update = registerTimer = clear = call


class Times:
    def getCurrentWatermarkInMs(self):
        return 10_000


def test_state_is_asked_for_many_rows_at_once():
    slopes, handle = stateful.TrailingSlope(10), Handle()
    slopes.init(handle)
    frame = pd.DataFrame({"key": [str(k % 50) for k in range(5000)], "at": range(5000), "id": range(5000), "x": np.arange(5000.0), "y": np.arange(5000.0)})
    assert list(slopes.handleInputRows((0,), iter([frame]), Times())) == []
    handle.held = [v for v in handle.held if isinstance(v, tuple)]
    (told,) = slopes.handleExpiredTimer((0,), Times(), None)
    assert len(told) == 5000 and told["slope"].isna().sum() == 50 and told["slope"].dropna().round(9).eq(1).all()
    assert handle.calls < 10


def test_same_data_again_adds_nothing(spark, tmp_path):
    log = _log(spark, [("a", 1, 0, 1.0), ("a", 2, 60, 2.0)])
    assert _slopes([log], tmp_path) == {("a", 1): None}
    again = stateful.ordered_slopes(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log/part=*"), "k", "id", "ts", "x", "y", 3, "10 minutes")
    stateful.run_into(again, str(tmp_path))
    assert stateful.results(spark, str(tmp_path), again.schema).count() == 1


def test_empty_parts(spark, tmp_path):
    assert _slopes([_log(spark, []), _log(spark, [("a", 1, 0, 1.0)]), _log(spark, [])], tmp_path) == {}


def test_contents_are_scored_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def score(text):
        with open(calls, "a") as f:
            f.write(f"{text}\n")
        return float(len(text))

    parts = [spark.createDataFrame(rows, "doc long, t string, score string") for rows in ([(1, "a", "x"), (2, "bb", "x"), (3, "a", "x")], [(4, "a", None), (5, None, None), (6, "", None), (None, "ccc", None)], [(7, "bb", None)])]
    out = stateful.in_parts(parts, str(tmp_path), lambda log: stateful.scored_once(log, "doc", "t", score))
    got = sorted((-1 if r.id is None else r.id, r.score) for r in out.collect())
    assert got == [(-1, 3.0), (1, 1.0), (2, 2.0), (3, 1.0), (4, 1.0), (5, 0.0), (6, 0.0), (7, 2.0)]
    assert sorted(open(calls).read().split("\n")[:-1]) == ["", "a", "bb", "ccc"]
    assert out.where("fresh").count() == 4
