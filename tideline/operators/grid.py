"""Screen of the whole candidate product over packed bitmaps.

A walk-forward window becomes a few 63-bit words per predicate: one word of test sessions and up to five of training
sessions. A candidate is the AND of six words (momentum, volume, flag set, RSI cap, price floor, volatility cap), its
active days a ``bit_count``, and a sum of returns is a weighted ``bit_count`` over the binary digits of the returns.
Candidates are never stored: a rank is decoded in mixed radix, in order of priority, where it is evaluated.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideline.functions.numeric import clip
from tideline.operators.folds import number_rows, with_folds
from tideline.operators.rules import PREDICATES, STRESS_Q

# The searched values, each list in its published order.
TRAIN_WINDOWS = (126, 189, 252, 315)
TEST_WINDOWS = (21, 42, 63)
MOMENTUM = ("ret5", "ret10", "ret20", "ret60", "ema_10_20_spread", "ema_20_50_spread", "percent_b", "z20")
MOMENTUM_QUANTILES = (0.55, 0.60, 0.65, 0.70, 0.75)
VOLUME_QUANTILES = (0.50, 0.55, 0.60, 0.65)
RSI_CAPS = (None, 65.0, 72.0, 78.0)
PRICE_FLOORS = (None, 0.98, 1.00, 1.02)
VIX_QUANTILES = (None, 0.70, 0.80)
STOPS = (0.025, 0.035, 0.045)
TAKES = (0.04, 0.05, 0.06)
EXPOSURES = (0.75, 1.0)
SETS = (
    (), ("sector_up",), ("index_up",), ("sector_up", "index_up"), ("sector_up", "market_up"), ("sector_up", "macd_up"),
    ("sector_up", "obv_up"), ("sector_up", "vol_calm"), ("sector_up", "index_up", "macd_up"), ("sector_up", "index_up", "obv_up"),
    ("sector_up", "index_up", "vol_calm"), ("sector_up", "index_up", "no_bad_holiday"), ("sector_up", "breadth"),
    ("sector_up", "peer_mean"), ("sector_up", "peer_net"), ("sector_up", "no_stress"), ("sector_up", "breadth", "no_stress"),
    ("sector_up", "peer_mean", "peer_net"), ("sector_up", "index_up", "breadth"), ("sector_up", "index_up", "no_stress"),
    ("sector_up", "obv_up", "breadth"), ("sector_up", "obv_up", "peer_mean"), ("sector_up", "obv_up", "peer_net"),
    ("sector_up", "obv_up", "no_stress"), ("sector_up", "obv_up", "breadth", "no_stress"),
    ("sector_up", "obv_up", "index_up", "breadth"), ("sector_up", "obv_up", "macd_up", "breadth"))
BASE_TRAIN, BASE_TEST, BASE_STOP, BASE_TAKE = 189, 42, 0.04, 0.05
MIN_DAYS, MIN_TRADES = 25, 18

BRACKETS = tuple((s, t) for s in STOPS for t in TAKES if t > s)
FLAG_NAMES = tuple(dict.fromkeys(itertools.chain(*SETS)))
BITS = 63  # a word keeps its sign bit free; all training windows are whole words, a test window is at most one
UNIT = 1_000_000  # returns count in millionths; brackets bound them by the widest take
BILLION = 1_000_000_000
DIGITS = int(max(TAKES + STOPS) * UNIT).bit_length()
CHUNK = 2048  # candidates that one row of bitmaps is asked for at a time
VOL_AT = len(MOMENTUM) * len(MOMENTUM_QUANTILES)
SET_AT = VOL_AT + len(VOLUME_QUANTILES)
RSI_AT = SET_AT + len(SETS)
FLOOR_AT = RSI_AT + len(RSI_CAPS)
VIX_AT = FLOOR_AT + len(PRICE_FLOORS)
UP_AT = VIX_AT + len(VIX_QUANTILES)


@dataclass(frozen=True)
class Piece:
    """A run of consecutive ranks of one window layout; the lists hold positions in the fixed values."""

    start: int
    first: int
    size: int
    train: int
    test: int
    momentum: list[int]
    momentum_q: list[int]
    volume_q: list[int]
    bracket: list[int]
    flags: list[int]


def _near_first(values: tuple, distance) -> list[list[int]]:
    """Positions of the values, those of equal distance together, the nearest first."""
    ranked = sorted(range(len(values)), key=lambda i: distance(values[i]))
    return [list(same) for _, same in itertools.groupby(ranked, key=lambda i: distance(values[i]))]


def pieces(cap: int | None = None, chunk: int = CHUNK) -> list[Piece]:
    """The candidate product in order of priority, cut into runs of at most ``chunk`` ranks; the first ``cap`` ranks if given.

    Their number depends on the fixed values only (about 20,000 for the whole product of 39.8 million)."""
    momentum_class = {"ret10": 0.0, "ret20": 0.0, "ret5": 0.5, "ret60": 0.5}
    groups = (_near_first(TRAIN_WINDOWS, lambda v: abs(v - BASE_TRAIN) / 252), _near_first(TEST_WINDOWS, lambda v: abs(v - BASE_TEST) / 63),
              _near_first(MOMENTUM_QUANTILES, lambda v: abs(v - 0.65)), _near_first(VOLUME_QUANTILES, lambda v: abs(v - 0.55)),
              _near_first(MOMENTUM, lambda v: momentum_class.get(v, 0.8)), _near_first(SETS, lambda v: 0.0 if "sector_up" in v else 0.2),
              _near_first(STOPS, lambda v: abs(v - BASE_STOP)), _near_first(TAKES, lambda v: abs(v - BASE_TAKE)))
    out, start = [], 0
    for trains, tests, mqs, vqs, moms, sets, stops, takes in itertools.product(*groups):
        brackets = [BRACKETS.index((STOPS[s], TAKES[t])) for s in stops for t in takes if TAKES[t] > STOPS[s]]
        size = len(moms) * len(mqs) * len(vqs) * len(RSI_CAPS) * len(PRICE_FLOORS) * len(VIX_QUANTILES) * len(brackets) * len(EXPOSURES) * len(sets)
        for tr, te in itertools.product(trains, tests) if size else ():
            step = max(chunk // (len(EXPOSURES) * len(sets)), 1) * len(EXPOSURES) * len(sets)  # the exposures of a rule stay in one run
            for first in range(0, size, step):
                n = min(step, size - first)
                if cap is not None:
                    n = min(n, cap - start - first)
                if n > 0:
                    out.append(Piece(start + first, first, n, TRAIN_WINDOWS[tr], TEST_WINDOWS[te], moms, mqs, vqs, brackets, sets))
            start += size
            if cap is not None and start >= cap:
                return out
    return out


def _digits(df: DataFrame, at: str) -> DataFrame:
    """Mixed-radix digits of the offset ``at`` of a piece, the last digit the fastest, as positions in the fixed values."""
    lists = [("set_i", "flags", None), ("exposure_i", None, len(EXPOSURES)), ("bracket_i", "bracket", None), ("vix_i", None, len(VIX_QUANTILES)),
             ("floor_i", None, len(PRICE_FLOORS)), ("rsi_i", None, len(RSI_CAPS)), ("vq_i", "volume_q", None), ("mq_i", "momentum_q", None),
             ("momentum_i", "momentum", None)]
    cols, rest = [], F.col(at)
    for name, values, n in lists:
        radix = F.size(values) if values else F.lit(n)
        digit = (rest % radix).cast("int")
        cols.append((F.get(F.col(values), digit) if values else digit).alias(name))
        rest = F.floor(rest / radix).cast("bigint")
    return df.select("*", *cols)


def _pieces_frame(spark: SparkSession, found: list[Piece]) -> DataFrame:
    return spark.createDataFrame([tuple(vars(p).values()) for p in found], "start bigint, first bigint, size int, train int, test int, momentum array<int>,"
                                 " momentum_q array<int>, volume_q array<int>, bracket array<int>, flags array<int>")


def window_rows(frame: DataFrame, layouts: list[tuple[int, int]]) -> DataFrame:
    """Rows of every fold of every layout with the word and the bit of the row's place in its window."""
    rows = number_rows(frame.filter("target_return IS NOT NULL"))
    out = None
    for train, test in layouts:
        f = with_folds(rows, train, test)
        place = F.col("i") - F.col("fold") * test
        at = F.when(F.col("role") == "test", place - train).otherwise(place)
        word = F.when(F.col("role") == "test", 0).otherwise(F.floor(at / BITS) + 1)
        f = f.select("*", F.lit(train).alias("train"), F.lit(test).alias("test"), word.cast("int").alias("word"),
                     F.expr("shiftleft(1L, CAST(%s AS INT))" % f"pmod(i - fold * {test} - IF(role = 'test', {train}, 0), {BITS})").alias("bit"))
        out = f if out is None else out.unionByName(f)
    return out


def _cut_offs(rows: DataFrame) -> DataFrame:
    """Training quantiles of every window, one aggregation."""
    cuts = [F.percentile(m, F.array(*map(F.lit, MOMENTUM_QUANTILES))).alias(f"cut_{m}") for m in MOMENTUM]
    return rows.filter("role = 'train'").groupBy("symbol", "train", "test", "fold").agg(
        *cuts, F.percentile("vol_ratio", F.array(*map(F.lit, VOLUME_QUANTILES))).alias("cut_vol"), F.percentile("stress", STRESS_Q).alias("stress_cut"),
        F.percentile("vix_chg5", F.array(*map(F.lit, VIX_QUANTILES[1:]))).alias("cut_vix"))


def _bracket_units(bracket: int) -> Column:
    """Next session's return in millionths when a stop and a take stand from close to close: a touched stop counts first."""
    stop, take = BRACKETS[bracket]
    r = F.when(F.col("next_low") <= -stop, -stop).when(F.col("next_high") >= take, take).otherwise(F.col("target_return"))
    return F.signum(r).cast("bigint") * F.floor(F.abs(r) * UNIT + 0.5)


def bitmaps(frame: DataFrame, layouts: list[tuple[int, int]], brackets: list[int]) -> DataFrame:
    """One row per (symbol, layout, fold): all words of all predicates side by side, years as bit masks, digits of returns.

    ``words`` holds an array of ``UP_AT + 1`` masks for each word, the test word first; ``gains`` and ``losses`` hold an array of
    ``DIGITS`` masks, the highest digit first, for each of ``brackets``."""
    keys = ["symbol", "train", "test", "fold"]
    rows = window_rows(frame, layouts)
    j = rows.join(_cut_offs(rows), keys)

    def bits(condition: Column) -> Column:
        return F.sum(F.when(F.coalesce(condition, F.lit(False)), F.col("bit")).otherwise(F.lit(0)))

    tests = [F.col(m) > F.get(f"cut_{m}", F.lit(k)) for m in MOMENTUM for k in range(len(MOMENTUM_QUANTILES))]
    tests += [F.col("vol_ratio") > F.get("cut_vol", F.lit(k)) for k in range(len(VOLUME_QUANTILES))]
    flags = [F.expr(PREDICATES[n]) for n in FLAG_NAMES]
    late = [F.lit(True) if c is None else F.col("rsi_14") < c for c in RSI_CAPS] + [F.lit(True) if c is None else F.col("p60") > c for c in PRICE_FLOORS]
    late += [F.lit(True)] + [F.col("vix_chg5") < F.get("cut_vix", F.lit(k)) for k in range(len(VIX_QUANTILES) - 1)]
    words = j.groupBy(*keys, "word").agg(F.array(*map(bits, tests)).alias("front"), F.array(*map(bits, flags)).alias("flag"),
                                         F.array(*map(bits, [*late, F.col("target_direction") == 1])).alias("back"))
    every = F.get("back", F.lit(0))
    sets = []
    for names in SETS:
        mask = every
        for n in names:
            mask = mask.bitwiseAND(F.get("flag", F.lit(FLAG_NAMES.index(n))))
        sets.append(mask)
    words = words.select(*keys, "word", F.concat("front", F.array(*sets), "back").alias("masks"))
    words = words.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("word", "masks"))).alias("w"))  # one word of test rows, at most five of training rows
    words = words.select(*keys, F.transform("w", lambda x: x["masks"]).alias("words"))

    test = rows.filter("role = 'test'").select(*keys, "bit", F.year("session").alias("year"), *[_bracket_units(b).alias(f"u{b}") for b in brackets])
    masks = {}
    for name, sign in (("gains", 1), ("losses", -1)):
        size = {b: F.greatest(F.col(f"u{b}") * sign, F.lit(0)) for b in brackets}
        digits = [F.array(*[F.sum(F.shiftright(size[b], k).bitwiseAND(F.lit(1)) * F.col("bit")) for k in reversed(range(DIGITS))]) for b in brackets]
        masks[name] = F.array(*digits).alias(name)
    worth = test.groupBy(*keys).agg(*masks.values())
    years = test.groupBy(*keys, "year").agg(F.sum("bit").alias("part")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("year", "part"))).alias("years"))
    return words.join(worth, keys).join(years, keys)


def screen(frame: DataFrame, cap: int | None = None) -> DataFrame:
    """One row per (symbol, candidate rank): what the candidate's test windows would have given.

    ``frame`` holds the rule columns, ``next_low`` and ``next_high`` (next session's extremes against this close). Days whose
    next session is unknown are left out. A trade is a run of active days inside one test window: at the next window the
    rule is fitted anew. Every candidate is evaluated; ``cap`` keeps the first ranks of the order of priority."""
    found = pieces(cap)
    spark = frame.sparkSession
    brackets = sorted({b for p in found for b in p.bracket})
    maps = bitmaps(frame, sorted({(p.train, p.test) for p in found}), brackets)
    slots = F.array(*[F.lit(brackets.index(b) if b in brackets else 0) for b in range(len(BRACKETS))])
    # The pieces are bounded by the fixed values. A row of bitmaps meets a run of ranks at a time; all rows of a symbol and
    # run meet in one partition, so neither aggregation below moves data again.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    j = maps.join(F.broadcast(_pieces_frame(spark, found)), ["train", "test"]).repartition(n, "symbol", "start")
    j = j.select("*", F.posexplode("years").alias("year_no", "y")).withColumn("sets", F.size("flags"))
    # Exposures scale a result only: one of them is evaluated, all are returned.
    groups = F.ceil(F.col("size") / (F.col("sets") * len(EXPOSURES))).cast("int")
    j = j.select("*", F.explode(F.sequence(F.lit(0), groups * F.col("sets") - 1)).alias("_m"))
    j = j.withColumn("k", F.floor(F.col("_m") / F.col("sets")).cast("int") * F.col("sets") * len(EXPOSURES) + F.col("_m") % F.col("sets"))
    j = _digits(j.withColumn("at", F.col("first") + F.col("k")), "at")
    picks = [F.col("momentum_i") * len(MOMENTUM_QUANTILES) + F.col("mq_i"), F.lit(VOL_AT) + F.col("vq_i"), F.lit(SET_AT) + F.col("set_i"),
             F.lit(RSI_AT) + F.col("rsi_i"), F.lit(FLOOR_AT) + F.col("floor_i"), F.lit(VIX_AT) + F.col("vix_i")]
    j = j.select("symbol", "start", (F.col("start") + F.col("k")).alias("rank"), F.col("y.year").alias("year"), F.col("y.part").alias("part"), "year_no",
                 "sets", (F.col("start") + F.col("size")).alias("end"), "bracket_i", "words", "gains", "losses", *[p.cast("int").alias(f"p{i}") for i, p in enumerate(picks)])

    # Lambdas keep the generated code of the stage small enough to be compiled to machine code.
    def active(word: Column) -> Column:
        out = F.get(word, F.col("p0"))
        for i in range(1, len(picks)):
            out = out.bitwiseAND(F.get(word, F.col(f"p{i}")))
        return out

    j = j.withColumn("m0", active(F.get("words", F.lit(0))))
    # A window without an active day needs neither its training words nor its returns.
    j = j.withColumn("masks", F.when(F.col("m0") != 0, F.transform("words", active)))
    here = F.col("m0").bitwiseAND(F.col("part"))
    up = F.get(F.get("words", F.lit(0)), F.lit(UP_AT))

    def bits_of(masks: Column) -> Column:
        return F.aggregate(masks, F.lit(0), lambda total, x: total + F.bit_count(x))

    risen = F.zip_with("masks", "words", lambda m, w: m.bitwiseAND(F.get(w, F.lit(UP_AT))))

    def worth(name: str) -> Column:
        digits = F.get(name, F.get(slots, F.col("bracket_i")))
        return F.when(F.col("here") == 0, F.lit(0)).otherwise(F.aggregate(digits, F.lit(0).cast("bigint"), lambda total, x: total * 2 + F.bit_count(F.col("here").bitwiseAND(x))))

    j = j.select("*", here.alias("here"), (bits_of(F.col("masks")) - F.bit_count("m0")).alias("tn"),
                 (bits_of(risen) - F.bit_count(F.col("m0").bitwiseAND(up))).alias("tu"))
    rose = F.bit_count(F.col("here").bitwiseAND(up))
    window_n, window_up = F.bit_count("m0"), F.bit_count(F.col("m0").bitwiseAND(up))
    j = j.select("symbol", "start", "rank", "year", F.bit_count("part").alias("days"), F.bit_count("here").alias("n"), rose.alias("up"),
                 worth("gains").alias("gain"), worth("losses").alias("loss"), F.coalesce(clip((F.col("tu") + 6) / (F.col("tn") + 12), 0.51, 0.85), F.lit(0.51)).alias("p"),
                 F.bit_count(F.col("here").bitwiseAND(F.bitwise_not(F.shiftleft("m0", 1)))).alias("entries"), "sets", "end",
                 F.when((F.col("year_no") == 0) & (window_n > 0), (window_up * 2 < window_n).cast("int")).alias("lost"))
    miss = F.col("up") * (1 - F.col("p")) * (1 - F.col("p")) + (F.col("n") - F.col("up")) * F.col("p") * F.col("p")
    miss = F.floor(miss * BILLION + 0.5)  # whole billionths: sums do not depend on their order
    by_year = j.groupBy("symbol", "start", "end", "sets", "rank", "year").agg(
        *[F.sum(c).alias(c) for c in ("days", "n", "up", "gain", "loss", "entries")], F.sum(miss).alias("miss"), F.sum("lost").alias("lost"), F.count("lost").alias("windows"))
    rate = F.when(F.col("n") > 0, F.col("up") / F.col("n"))
    total = by_year.groupBy("symbol", "start", "end", "sets", "rank").agg(
        *[F.sum(c).alias(c) for c in ("days", "n", "up", "gain", "loss", "entries", "miss", "lost", "windows")],
        F.stddev_pop(rate).alias("year_std"), F.min(rate).alias("worst_year"))
    total = total.select("*", F.posexplode(F.array(*map(F.lit, EXPOSURES))).alias("exposure_i", "exposure"))
    total = total.withColumn("rank", F.col("rank") + F.col("exposure_i") * F.col("sets")).filter(F.col("rank") < F.col("end"))
    has = F.col("n") > 0
    out = total.select(
        "symbol", "rank", "gain", "loss", "miss", F.col("n").alias("active_days"), F.col("entries").alias("trades"), (F.col("n") / F.col("days")).alias("coverage"),
        F.when(has, F.col("up") / F.col("n")).otherwise(0.0).alias("precision"),
        F.when(has, F.col("exposure") * (F.col("gain") - F.col("loss")) / UNIT / F.col("n")).otherwise(0.0).alias("avg_return"),
        F.when(F.col("loss") > 0, F.col("gain") / F.col("loss")).alias("profit_factor"), F.coalesce("worst_year", F.lit(0.0)).alias("worst_year"),
        F.when(has, F.col("year_std")).otherwise(1.0).alias("year_std"), F.when(F.col("windows") > 0, F.col("lost")).otherwise(99).alias("losing_windows"),
        F.when(has, F.col("miss") / BILLION / F.col("n")).alias("brier"), (F.col("gain") > 0).alias("_won"))
    factor = F.least(F.coalesce("profit_factor", F.when(F.col("_won"), 5.0).otherwise(0.0)), F.lit(5.0))
    enough = (F.col("active_days") >= MIN_DAYS) & (F.col("trades") >= MIN_TRADES)
    short = F.greatest(MIN_DAYS - F.col("active_days"), F.lit(0)) + 2 * F.greatest(MIN_TRADES - F.col("trades"), F.lit(0))
    # The terms of the selection score that need no equity path; path terms are for the candidates that are carried on.
    score = (F.col("precision") * 5 + factor * 0.45 + F.col("avg_return") * 50 - F.greatest(F.col("coverage") - 0.25, F.lit(0.0)) * 3
             - F.col("year_std") * 1.5 - F.col("losing_windows") * 0.15)
    return out.withColumn("screen_score", F.when(enough, score).otherwise(-100.0 - short)).drop("_won")


def labelled(df: DataFrame, cap: int | None = None) -> DataFrame:
    """``df`` with the values and the label of its column ``rank``: pieces are met by range of ranks, in equal runs."""
    found = _pieces_frame(df.sparkSession, pieces(cap))
    runs = found.select("*", F.explode(F.sequence(F.floor(F.col("start") / CHUNK), F.floor((F.col("start") + F.col("size") - 1) / CHUNK))).alias("_run"))
    j = df.withColumn("_run", F.floor(F.col("rank") / CHUNK)).join(F.broadcast(runs), "_run")
    j = _digits(j.filter("rank >= start AND rank < start + size").withColumn("_at", F.col("first") + F.col("rank") - F.col("start")), "_at")

    def value(values, i: str) -> Column:
        return F.get(F.array(*[F.lit(v).cast("double") if v is None else F.lit(v) for v in values]), F.col(i))

    j = j.select(*df.columns, F.col("train").alias("train_window"), F.col("test").alias("test_window"), value(MOMENTUM, "momentum_i").alias("momentum"),
                 value(MOMENTUM_QUANTILES, "mq_i").alias("momentum_q"), value(VOLUME_QUANTILES, "vq_i").alias("volume_q"), value(RSI_CAPS, "rsi_i").alias("max_rsi"),
                 value(PRICE_FLOORS, "floor_i").alias("price_floor"), value(VIX_QUANTILES, "vix_i").alias("vix_q"),
                 value([s for s, _ in BRACKETS], "bracket_i").alias("stop"), value([t for _, t in BRACKETS], "bracket_i").alias("take"),
                 value(EXPOSURES, "exposure_i").alias("exposure"), value(["+".join(s) for s in SETS], "set_i").alias("flags"))
    extra = F.concat_ws("+", F.nullif("flags", F.lit("")), *[F.when(F.col(c).isNotNull(), F.concat(F.lit(t), F.format_string("%.2f", c)))
                                                             for c, t in (("max_rsi", "rsi<"), ("price_floor", "p60>"), ("vix_q", "vix<"))])
    return j.withColumn("label", F.concat(F.format_string("tw%d_sw%d_%s_mq%.2f_vq%.2f_", "train_window", "test_window", "momentum", "momentum_q", "volume_q"),
                                          F.when(extra == "", "base").otherwise(extra)))
