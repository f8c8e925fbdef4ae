"""Trade selection held against a plain walk over the bars; status rules of the stable selection."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from tideline.operators import returns as rt
from tideline.plans.evaluation import downgraded


def _walk(bars, horizon, cost):
    out, i, n = [], 0, len(bars)
    while i < n - horizon - 1:
        (_, t, _, _, _, side), entry, leave = bars[i], bars[i + 1], bars[i + horizon]
        if side == 0 or entry[2] != leave[2]:
            i += 1
            continue
        gross = side * (leave[4] / entry[3] - 1)
        out.append((bars[i][0], t, leave[1], side, round(gross, 10), round(gross - cost, 10)))
        i += horizon + 1
    return out


@pytest.mark.parametrize("horizon", [1, 2, 4, 7])
def test_intraday_trades_match_a_walk_with_one_key_of_most_bars(spark, horizon):
    rng = random.Random(horizon)
    rows = []
    for symbol, days in (("hot", 160), ("a", 9), ("b", 6), ("one", 1), ("flat", 3)):
        for day in range(days):
            start = dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
            for k in range(rng.choice([1, 2, 3, 5, 8, 13])):
                side = 0 if symbol == "flat" else rng.choice([-1, 0, 0, 1, 1])
                rows.append((symbol, start + dt.timedelta(minutes=k), start.date(), 100 + rng.random(), 100 + rng.random(), side))
    bars = spark.createDataFrame(rows, "symbol string, bar timestamp_ntz, session_ny date, open double, close double, signal int").repartition(5)
    got = [(r.symbol, r.signal_time, r.exit_time, r.side, round(r.gross, 10), round(r.net, 10)) for r in rt.greedy_intraday_trades(bars, horizon).collect()]
    want = [t for s in ("hot", "a", "b", "one", "flat") for t in _walk([r for r in rows if r[0] == s], horizon, 0.0015)]
    assert sum(r[0] == "hot" for r in rows) > 0.85 * len(rows) and want
    assert sorted(got) == sorted(want)


def test_intraday_trades_of_no_bars(spark):
    none = spark.createDataFrame([], "symbol string, bar timestamp_ntz, session_ny date, open double, close double, signal int")
    assert rt.greedy_intraday_trades(none).count() == 0


def test_status_falls_by_the_first_reason_that_holds(spark):
    rows = [("promote_candidate", True, 1, 1, 3, "current_baseline"), ("reject_weak_metrics", False, 1, 1, 3, "reject_weak_metrics"),
            ("promote_candidate", False, None, None, 0, "oos_insufficient_sample"), ("promote_candidate", False, 1, 1, 1, "oos_insufficient_sample"),
            ("promote_candidate", False, 0, 1, 1, "reject_oos_degradation"), ("watchlist_strong_recent_mid", False, 0, 0, 2, "watchlist_regime_weakness"),
            ("promote_candidate", False, 0, 0, 0, "promote_candidate"), ("watchlist_strong_recent_mid", False, 0, 0, 0, "watchlist_strong_recent_mid")]
    d = spark.createDataFrame(rows, "status string, base boolean, few int, bad int, weak int, want string")
    got = d.select(downgraded(F.col("status"), F.col("base"), F.col("few"), F.col("bad"), F.col("weak")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
