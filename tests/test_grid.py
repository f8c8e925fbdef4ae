"""Candidate product: order and size against nested enumeration, bitmap results against a plain walk over the rows."""

import datetime as dt
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tideline.operators import grid


def test_pieces_cover_the_product_once_and_keep_its_order():
    found = grid.pieces()
    assert [p.start for p in found] == list(np.cumsum([0] + [p.size for p in found[:-1]]))
    assert sum(p.size for p in found) == 4 * 3 * 8 * 5 * 4 * 27 * 4 * 4 * 3 * 8 * 2
    assert max(p.size for p in found) <= grid.CHUNK
    few = grid.pieces(5001)
    assert sum(p.size for p in few) == 5001 and all(a == b for a, b in zip(few[:2], found))


def test_labels_follow_the_priorities(spark):
    """Ranks spread over the whole product, their values read back and put in order by the plain keys."""
    total = sum(p.size for p in grid.pieces())
    ranks = sorted(random.Random(3).sample(range(total), 300)) + [total - 1]
    got = grid.labelled(spark.createDataFrame([(r,) for r in ranks], "rank bigint")).orderBy("rank").collect()
    assert [r["rank"] for r in got] == sorted(ranks) and len({r.label for r in got}) > 200
    pos = {name: {v: i for i, v in enumerate(values)} for name, values in
           (("tw", grid.TRAIN_WINDOWS), ("sw", grid.TEST_WINDOWS), ("m", grid.MOMENTUM), ("mq", grid.MOMENTUM_QUANTILES), ("vq", grid.VOLUME_QUANTILES),
            ("rsi", grid.RSI_CAPS), ("pf", grid.PRICE_FLOORS), ("vx", grid.VIX_QUANTILES), ("stop", grid.STOPS), ("take", grid.TAKES), ("ex", grid.EXPOSURES),
            ("set", ["+".join(s) for s in grid.SETS]))}
    momentum = {"ret10": 0.0, "ret20": 0.0, "ret5": 0.5, "ret60": 0.5}

    def key(r):
        values = dict(tw=r.train_window, sw=r.test_window, m=r.momentum, mq=r.momentum_q, vq=r.volume_q, rsi=r.max_rsi, pf=r.price_floor, vx=r.vix_q,
                      stop=r.stop, take=r["take"], ex=r.exposure, set=r.flags)
        assert r["take"] > r.stop
        return (abs(r.train_window - 189) / 252, abs(r.test_window - 42) / 63, abs(r.momentum_q - 0.65), abs(r.volume_q - 0.55), momentum.get(r.momentum, 0.8),
                0.0 if "sector_up" in r.flags else 0.2, abs(r.stop - 0.04), abs(r["take"] - 0.05), *[pos[n][v] for n, v in values.items()])

    keys = [key(r) for r in got]
    assert keys == sorted(keys)


def _frame(rows, seed):
    rng = random.Random(seed)
    out, close = [], 100.0
    for i in range(rows):
        nxt = close * (1 + rng.gauss(0.0005, 0.02))
        low, high = min(close, nxt) * (1 - rng.random() * 0.02), max(close, nxt) * (1 + rng.random() * 0.02)
        r = nxt / close - 1
        out.append(dict(symbol=f"s{seed}", session=dt.date(2020, 11, 2) + dt.timedelta(days=i), target_return=r if i < rows - 1 else None,
                        target_direction=int(r > 0) if i < rows - 1 else None, next_low=low / close - 1, next_high=high / close - 1,
                        **{m: rng.gauss(0, 1) if rng.random() > 0.03 else None for m in grid.MOMENTUM}, vol_ratio=rng.random(), vix_chg5=rng.gauss(0, 1),
                        stress=float(rng.randrange(3)), rsi_14=rng.uniform(40, 90), p60=rng.uniform(0.9, 1.1), sector_ret1=rng.gauss(0.4, 1), idx_ret1=rng.gauss(0.4, 1),
                        idx_ret5=rng.gauss(0, 1), macd_hist=rng.gauss(0, 1), obv_signal=rng.gauss(0.5, 1), vol20=rng.random(), vol60=rng.random(), breadth5=rng.random(),
                        mean5=rng.gauss(0, 1), net3=rng.gauss(0, 1), pre_holiday=int(rng.random() < 0.1), pre_holiday_momentum=rng.gauss(0, 1)))
        close = nxt
    return out


_FLAG = {"sector_up": lambda r, c: r["sector_ret1"] > 0, "index_up": lambda r, c: r["idx_ret1"] > 0, "market_up": lambda r, c: r["idx_ret5"] > 0,
         "macd_up": lambda r, c: r["macd_hist"] > 0, "obv_up": lambda r, c: r["obv_signal"] > 0, "vol_calm": lambda r, c: r["vol20"] < r["vol60"] * 1.10,
         "breadth": lambda r, c: r["breadth5"] >= 0.55, "peer_mean": lambda r, c: r["mean5"] > 0, "peer_net": lambda r, c: r["net3"] >= 0,
         "no_stress": lambda r, c: r["stress"] <= c, "no_bad_holiday": lambda r, c: not (r["pre_holiday"] == 1 and r["pre_holiday_momentum"] < 0)}


def _walk(rows, cand):
    """The candidate's test windows, session by session."""
    rows = [r for r in rows if r["target_return"] is not None]
    days = n = up = trades = lost = windows = gain = loss = 0
    miss, years = 0.0, {}
    start = cand.train_window
    while start < len(rows):
        train, test = rows[start - cand.train_window:start], rows[start:start + cand.test_window]
        q = lambda c, p: np.quantile([r[c] for r in train if r[c] is not None], p)
        cut, vol, stress = q(cand.momentum, cand.momentum_q), q("vol_ratio", cand.volume_q), q("stress", 0.75)
        vix = None if cand.vix_q is None else q("vix_chg5", cand.vix_q)

        def on(r):
            return (r[cand.momentum] is not None and r[cand.momentum] > cut and r["vol_ratio"] > vol and (cand.max_rsi is None or r["rsi_14"] < cand.max_rsi)
                    and (cand.price_floor is None or r["p60"] > cand.price_floor) and (vix is None or r["vix_chg5"] < vix)
                    and all(_FLAG[f](r, stress) for f in cand.flags.split("+") if f))

        fit = [r["target_direction"] for r in train if on(r)]
        p = min(max((sum(fit) + 6) / (len(fit) + 12), 0.51), 0.85)
        hits = [r for r in test if on(r)]
        days += len(test)
        trades += sum(on(r) and (k == 0 or not on(test[k - 1])) for k, r in enumerate(test))
        if hits:
            windows += 1
            lost += 2 * sum(r["target_direction"] for r in hits) < len(hits)
        for r in hits:
            n, up = n + 1, up + r["target_direction"]
            miss += (p - r["target_direction"]) ** 2
            y = years.setdefault(r["session"].year, [])
            y.append(r["target_direction"])
            x = -cand.stop if r["next_low"] <= -cand.stop else cand["take"] if r["next_high"] >= cand["take"] else r["target_return"]
            units = int(abs(x) * 1_000_000 + 0.5)
            gain, loss = gain + units * (x > 0), loss + units * (x < 0)
        start += cand.test_window
    rates = [np.mean(v) for v in years.values()]
    return dict(active_days=n, trades=trades, coverage=n / days, precision=up / n if n else 0.0, gain=gain, loss=loss, worst_year=min(rates, default=0.0),
                year_std=float(np.std(rates)) if n else 1.0, losing_windows=lost if windows else 99, brier=miss / n if n else None)


@pytest.fixture(scope="module")
def layouts_found():
    """A piece of each window layout, from all over the product."""
    rng, seen = random.Random(11), {}
    for p in rng.sample(grid.pieces(), 4000):
        seen.setdefault((p.train, p.test), p)
    return [grid.Piece(**{**vars(p), "size": min(p.size, 60)}) for p in list(seen.values())[:5]]


def test_screen_equals_a_walk_over_the_sessions(spark, monkeypatch, layouts_found):
    rows = {f"s{k}": _frame(size, k) for k, size in ((1, 520), (2, 400), (3, 90))}
    frame = spark.createDataFrame([r for v in rows.values() for r in v], ", ".join(
        f"{c} {'string' if c == 'symbol' else 'date' if c == 'session' else 'int' if c in ('target_direction', 'pre_holiday') else 'double'}" for c in rows["s1"][0]))
    monkeypatch.setattr(grid, "pieces", lambda cap=None, chunk=grid.CHUNK: layouts_found)
    got = grid.screen(frame.withColumn("extra", F.lit(1)))
    got = {(r.symbol, r["rank"]): r for r in got.collect()}
    plain = {r["rank"]: r for r in grid.labelled(spark.createDataFrame([(p.start + k,) for p in layouts_found for k in range(p.size)], "rank bigint")).collect()}
    assert {s for s, _ in got} == {"s1", "s2"}  # the shortest series has no test window
    active = 0
    for (symbol, rank), r in got.items():
        want = _walk(rows[symbol], plain[rank])
        active += want["active_days"]
        for name, value in want.items():
            assert r[name] == value or r[name] == pytest.approx(value, abs=1e-9), (symbol, plain[rank].label, name)
    assert active > 200 and {k for _, k in got} == set(plain)


def test_screen_of_no_rows(spark):
    frame = spark.createDataFrame([_frame(2, 1)[0]], ", ".join(
        f"{c} {'string' if c == 'symbol' else 'date' if c == 'session' else 'int' if c in ('target_direction', 'pre_holiday') else 'double'}" for c in _frame(1, 1)[0]))
    assert grid.screen(frame.limit(0), 50).count() == 0
    assert grid.screen(frame, 50).count() == 0
