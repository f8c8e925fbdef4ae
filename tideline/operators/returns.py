"""Returns, trades, barriers and ledgers of target-position series, without a fill simulator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tideline.functions.numeric import sdiv


def net_of_costs(df: DataFrame, keys: list[str], position: str = "position", ret: str = "ret1",
                 cost: float = 0.0015, order: str = "session") -> DataFrame:
    """Lagged target times return, less cost on the change of the held position."""
    w = Window.partitionBy(*keys).orderBy(order)
    h = df.withColumn("held", F.coalesce(F.lag(position).over(w), F.lit(0.0)))
    h = h.withColumn("turn", F.abs(F.col("held") - F.coalesce(F.lag("held").over(w), F.lit(0.0))))
    return h.withColumn("net", F.col("held") * F.col(ret) - F.col("turn") * F.lit(cost))


def trades(df: DataFrame, keys: list[str], order: str = "session") -> DataFrame:
    """Runs of a held position as trades (gaps and islands), compounding the net return of the run.
    The cost of leaving falls on the first flat row and is charged to the run before it."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.coalesce(F.lag("held").over(w), F.lit(0.0))
    start = ((F.col("held") > 0) & (before <= 0)).cast("int")
    closing = (F.col("held") <= 0) & (before > 0)
    r = df.select("*", start.alias("_start"), closing.alias("_closing"))
    r = r.withColumn("trade", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    live = r.filter("(held > 0 OR _closing) AND trade > 0")
    return live.groupBy(*keys, "trade").agg(
        F.min(F.when(F.col("held") > 0, F.col(order))).alias("entry"), F.max(F.when(F.col("held") > 0, F.col(order))).alias("exit"),
        F.sum((F.col("held") > 0).cast("int")).alias("bars"), (F.exp(F.sum(F.log1p("net"))) - 1).alias("pnl"))


def performance(df: DataFrame, keys: list[str], order: str = "session") -> DataFrame:
    """Return, risk and drawdown metrics of a net-return series per key."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    e = df.withColumn("_log", F.sum(F.log1p("net")).over(w))
    e = e.withColumn("_dd", F.exp(F.col("_log") - F.greatest(F.max("_log").over(w), F.lit(0.0))) - 1)
    m = e.groupBy(*keys).agg(
        F.count("net").alias("days"), F.sum(F.log1p("net")).alias("_l"), F.avg("net").alias("_m"), F.stddev_pop("net").alias("_s"),
        F.stddev_pop(F.when(F.col("net") < 0, F.col("net"))).alias("_d"), F.min("_dd").alias("max_drawdown"),
        F.sqrt(F.avg(F.pow(F.col("_dd") * 100, 2))).alias("ulcer_index"))
    year = F.lit(252.0)
    m = m.select(*keys, "days", (F.exp("_l") - 1).alias("total_return"), (F.exp(F.col("_l") * year / F.col("days")) - 1).alias("annualized_return"),
                 F.coalesce(F.sqrt(year) * F.col("_m") / F.when(F.col("_s") > 1e-12, F.col("_s")), F.lit(0.0)).alias("sharpe_ratio"),
                 F.coalesce(F.sqrt(year) * F.col("_m") / F.when(F.col("_d") > 1e-12, F.col("_d")), F.lit(0.0)).alias("sortino_ratio"),
                 "max_drawdown", "ulcer_index")
    return m.withColumn("calmar_ratio", sdiv("annualized_return", F.abs("max_drawdown")))


def trade_stats(t: DataFrame, keys: list[str]) -> DataFrame:
    win, loss = F.col("pnl") > 0, F.col("pnl") < 0
    g = t.groupBy(*keys).agg(
        F.count("*").alias("num_trades"), F.sum(win.cast("int")).alias("_w"), F.sum(F.when(win, F.col("pnl"))).alias("_gp"),
        F.sum(F.when(loss, F.col("pnl"))).alias("_gl"), F.avg(F.when(win, F.col("pnl"))).alias("avg_win"), F.avg(F.when(loss, F.col("pnl"))).alias("avg_loss"))
    return g.select(*keys, "num_trades", (F.col("_w") / F.col("num_trades")).alias("win_rate"),
                    (F.coalesce("_gp", F.lit(0.0)) / F.abs("_gl")).alias("profit_factor"),
                    F.coalesce("avg_win", F.lit(0.0)).alias("avg_win"), F.coalesce("avg_loss", F.lit(0.0)).alias("avg_loss"))


def full_performance(df: DataFrame, keys: list[str], order: str = "session") -> DataFrame:
    p = performance(df, keys, order)
    s = trade_stats(trades(df, keys, order), keys)
    j = p.join(s, keys, "left")
    return j.withColumn("num_trades", F.coalesce("num_trades", F.lit(0))).withColumn("win_rate", F.coalesce("win_rate", F.lit(0.0)))


def barrier_touch(entries: DataFrame, keys: list[str], horizon: int = 10, stop: float = 0.03, take: float = 0.05,
                  stop_first: bool = True, order: str = "session") -> DataFrame:
    """First stop or take touched in the bars after a flagged entry, gaps at the open first.

    Each row carries the next ``horizon`` bars as a fixed-size array, so the path test is one pass.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, horizon)
    path = F.collect_list(F.struct(F.col(order).alias("day"), "open", "high", "low", "close")).over(w)
    p = entries.withColumn("_path", path).filter("entry_flag")
    lo, hi = F.col("close") * (1 - stop), F.col("close") * (1 + take)

    def mark(b):
        stop_hit, take_hit = b["low"] <= lo, b["high"] >= hi
        first, second = (("stop", stop_hit, lo), ("take", take_hit, hi)) if stop_first else (("take", take_hit, hi), ("stop", stop_hit, lo))
        reason = (F.when(b["open"] <= lo, "gap_stop").when(b["open"] >= hi, "gap_take").when(first[1], first[0]).when(second[1], second[0]))
        price = F.when((b["open"] <= lo) | (b["open"] >= hi), b["open"]).when(first[1], first[2]).when(second[1], second[2])
        return F.struct(b["day"].alias("day"), reason.alias("reason"), price.alias("price"))

    hit = F.get(F.filter(F.transform("_path", mark), lambda x: x["reason"].isNotNull()), 0)
    p = p.withColumn("_hit", hit).withColumn("_last", F.element_at("_path", -1))
    p = p.filter(F.size("_path") > 0)
    return p.select(*keys, order, F.coalesce(F.col("_hit.day"), F.col("_last.day")).alias("exit_day"),
                    F.coalesce(F.col("_hit.reason"), F.lit("timeout")).alias("reason"),
                    (F.coalesce(F.col("_hit.price"), F.col("_last.close")) / F.col("close") - 1).alias("trade_return"))


def drawdown_cutoff(df: DataFrame, keys: list[str], limit: float = 0.15, order: str = "session") -> DataFrame:
    """Flat from the row after the first breach of the drawdown limit (measured on the uncut curve)."""
    w = Window.partitionBy(*keys).orderBy(order)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    e = df.withColumn("_log", F.sum(F.log1p("net")).over(up))
    e = e.withColumn("drawdown", F.exp(F.col("_log") - F.greatest(F.max("_log").over(up), F.lit(0.0))) - 1)
    seen = F.max((F.col("drawdown") <= -limit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("halted", F.coalesce(seen, F.lit(0)))
    return e.withColumn("cut_net", F.when(F.col("halted") == 1, 0.0).otherwise(F.col("net"))).drop("_log")


def ledger(df: DataFrame, keys: list[str], shares_per_unit: float = 100.0, initial: float = 1e6, cost: float = 0.0015,
           order: str = "session") -> DataFrame:
    """Replay fills at the close and check: initial + realised + unrealised - fees = cash + shares x mark."""
    w = Window.partitionBy(*keys).orderBy(order)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    s = df.withColumn("shares", F.col("target") * shares_per_unit)
    s = s.withColumn("qty", F.col("shares") - F.coalesce(F.lag("shares").over(w), F.lit(0.0)))
    s = s.withColumn("fee", F.abs("qty") * F.col("close") * cost)
    s = s.withColumn("basis", F.last(F.when(F.col("qty") > 0, F.col("close")), ignorenulls=True).over(up))
    gain = F.when(F.col("qty") < 0, -F.col("qty") * (F.col("close") - F.col("basis"))).otherwise(0.0)
    s = s.withColumn("_gain", gain)
    s = s.select("*", (F.lit(initial) - F.sum(F.col("qty") * F.col("close") + F.col("fee")).over(up)).alias("cash"),
                 F.sum("_gain").over(up).alias("realised"), F.sum("fee").over(up).alias("fees"),
                 F.coalesce(F.col("shares") * (F.col("close") - F.col("basis")), F.lit(0.0)).alias("unrealised"))
    return s.withColumn("residual", F.lit(initial) + F.col("realised") + F.col("unrealised") - F.col("fees")
                        - F.col("cash") - F.col("shares") * F.col("close"))


def greedy_intraday_trades(scored: DataFrame, horizon: int = 4, cost: float = 0.0015) -> DataFrame:
    """Non-overlapping trades: enter the bar after a signal, leave ``horizon`` bars after the signal in the same session,
    look again after the exit. The last bar of a symbol takes no exit.

    A trade never leaves its session, so all that one session hands to the next is whether its first bar is still barred.
    Each session (a bounded group) is walked for both cases; which case holds is a scan of that bit over a symbol's
    sessions. A symbol with most of the bars is dealt out by its sessions like any other."""
    bars = scored.select("symbol", "session_ny", F.struct("bar", "open", "close", F.col("signal").cast("int").alias("signal")).alias("b"))
    s = bars.groupBy("symbol", "session_ny").agg(F.array_sort(F.collect_list("b")).alias("bars"))
    w = Window.partitionBy("symbol").orderBy("session_ny")
    before = F.lag(F.element_at("bars", -1)).over(w)
    final = F.lead("session_ny").over(w).isNull().cast("int")
    s = s.select("symbol", "session_ny", "bars", before.alias("before"), final.alias("final"))
    # With the last bar of the session before in front, bar k of ``line`` is the signal bar of an entry at bars[k].
    s = s.withColumn("line", F.concat(F.array("before"), F.slice("bars", 1, F.size("bars") - 1)))
    places = F.size("bars") - horizon - F.col("final")

    def walk(barred: int):
        def step(acc, k):
            # Array places count from 0 in sequence(0, n - 1); no bar before the first one means no signal.
            go = (k >= acc["free"]) & (F.coalesce(F.get("line", k)["signal"], F.lit(0)) != 0)
            return F.when(go, F.struct((k + horizon + 1).alias("free"), F.concat(acc["at"], F.array(k)).alias("at"))).otherwise(acc)

        none = F.struct(F.lit(barred).alias("free"), F.array().cast("array<int>").alias("at"))
        return F.when(places < 0, none).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(places, F.lit(0))), none, step))

    s = s.withColumn("open_walk", walk(0)).withColumn("barred_walk", walk(1))
    out = [(F.col(f"{c}.free") > F.size("bars")).cast("int") for c in ("open_walk", "barred_walk")]
    s = s.withColumn("_out0", out[0]).withColumn("_out1", out[1]).withColumn("_flip", (F.col("_out0") > F.col("_out1")).cast("int"))
    # A session with one result for both cases sets the bit; the others keep or flip it.
    flips = F.sum("_flip").over(w.rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("_flips", flips)
    fixed = F.when(F.col("_out0") == F.col("_out1"), F.col("_out0") + F.col("_flips"))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_bit", (F.coalesce(F.last(fixed, ignorenulls=True).over(past), F.lit(0)) + F.coalesce(F.lag("_flips").over(w), F.lit(0))) % 2)
    taken = s.select("symbol", "bars", "line", F.explode(F.when(F.col("_bit") == 1, F.col("barred_walk.at")).otherwise(F.col("open_walk.at"))).alias("k"))
    signal, entry, leave = F.get("line", F.col("k")), F.get("bars", F.col("k")), F.get("bars", F.col("k") + horizon - 1)
    t = taken.select("symbol", signal["bar"].alias("signal_time"), leave["bar"].alias("exit_time"), signal["signal"].alias("side"),
                     (signal["signal"] * (leave["close"] / entry["open"] - 1)).alias("gross"))
    return t.withColumn("net", F.col("gross") - F.lit(cost))
