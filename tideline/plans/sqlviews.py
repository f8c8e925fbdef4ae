"""DuckDB texts of the shared research tables, used only by the SQL twins of the catalog."""

from __future__ import annotations

import re

V: dict[str, str] = {}

V["lines"] = """
SELECT n_name AS symbol, r_name AS sector, CAST(l_shipdate AS DATE) AS session,
       5000.0::DOUBLE + sqrt(l_extendedprice) AS price, l_quantity AS qty, l_extendedprice AS ext,
       l_discount AS disc, l_tax AS tax, l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey"""

V["bars"] = """
SELECT symbol, sector, session,
       arg_min(price, row(l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS open,
       max(price) AS high, min(price) AS low,
       arg_max(price, row(l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS close,
       sum(qty) AS volume, count(*) AS n_lines
FROM lines GROUP BY 1, 2, 3"""

V["market"] = """
SELECT *, row_number() OVER (ORDER BY session) AS pos FROM (
  SELECT CAST(l_shipdate AS DATE) AS session,
         5000.0::DOUBLE + sum(l_extendedprice) / sum(l_quantity) / 10 AS idx,
         avg(l_discount) * 400 AS vix, avg(l_tax) * 1000 AS tnx
  FROM lineitem GROUP BY 1)"""

V["sessions"] = """
SELECT session, row_number() OVER (ORDER BY session) AS pos,
       CAST(session AS TIMESTAMP) + INTERVAL 14 HOUR + INTERVAL 30 MINUTE AS market_open,
       CAST(session AS TIMESTAMP) + INTERVAL 21 HOUR AS market_close
FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem)"""

V["panel"] = "SELECT b.*, m.idx, m.vix, m.tnx, m.pos FROM bars b JOIN market m USING (session)"


def pct(x: str, n: int, w: str = "w") -> str:
    return f"{x} / nullif(lag({x}, {n}) OVER {w}, 0) - 1"


def full(fn: str, x: str, n: int, key: str = "symbol", order: str = "session") -> str:
    fr = f"(PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {fr} >= {n} THEN {fn}({x}) OVER {fr} END"


def gated(fn: str, x: str, lo: int, hi: int, k: int, key: str = "symbol", order: str = "session") -> str:
    a = f"{-lo} PRECEDING" if lo < 0 else (f"{lo} FOLLOWING" if lo > 0 else "CURRENT ROW")
    b = f"{-hi} PRECEDING" if hi < 0 else (f"{hi} FOLLOWING" if hi > 0 else "CURRENT ROW")
    fr = f"(PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {a} AND {b})"
    call = fn.format(x=x) if "{" in fn else f"{fn}({x})"
    return f"CASE WHEN count({x}) OVER {fr} >= {k} THEN {call} OVER {fr} END"


def prior_q(x: str, q: float, n: int = 126, k: int = 40, key: str = "symbol") -> str:
    return gated("quantile_cont({x}, " + str(q) + ")", x, -n, -1, k, key)


V["features"] = f"""
SELECT *, close / nullif(sma20, 0) AS p20, close / nullif(sma60, 0) AS p60,
       (close - sma20) / nullif(std20, 0) AS z20,
       CASE WHEN target_return IS NOT NULL THEN CASE WHEN target_return > 0 THEN 1 ELSE 0 END END AS target_direction
FROM (
 SELECT *, {full('avg', 'close', 20)} AS sma20, {full('avg', 'close', 60)} AS sma60,
        {full('stddev_samp', 'close', 20)} AS std20, {full('stddev_samp', 'ret1', 20)} AS vol20,
        {full('stddev_samp', 'ret1', 60)} AS vol60,
        volume / nullif({full('avg', 'volume', 20)}, 0) AS vol_ratio
 FROM (
  SELECT *, row_number() OVER w AS rn, {pct('close', 1)} AS ret1, {pct('close', 5)} AS ret5,
         {pct('close', 10)} AS ret10, {pct('close', 20)} AS ret20, {pct('close', 60)} AS ret60,
         {pct('idx', 1)} AS idx_ret1, {pct('idx', 5)} AS idx_ret5, {pct('vix', 5)} AS vix_chg5,
         tnx - lag(tnx, 5) OVER w AS tnx_chg5,
         lead(close, 1) OVER w / nullif(close, 0) - 1 AS target_return
  FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY session)))"""

V["signals"] = """
SELECT symbol, sector, session, rn, close, ret1, ret5, ret20, vol20, vol60, p20, p60, vix, vix_chg5, idx_ret5, z20,
       target_return, target_direction,
       1.0::DOUBLE / (1.0::DOUBLE + exp(0.4::DOUBLE * least(greatest(z20, -3.0), 3.0))) AS prob_up,
       CASE WHEN ret20 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS position,
       least(greatest(ret20 / 20, -0.05), 0.05) AS expected
FROM features WHERE ret20 IS NOT NULL AND z20 IS NOT NULL"""

V["strategies"] = """
SELECT symbol, session, ret1, target_return, target_direction, prob_up, vix, vol20, strategy,
       CASE strategy WHEN 'buy_hold' THEN 1.0::DOUBLE
                     WHEN 'momentum' THEN CASE WHEN ret20 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
                     WHEN 'reversal' THEN CASE WHEN z20 < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
                     ELSE CASE WHEN p60 > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS target
FROM signals, (VALUES ('buy_hold'), ('momentum'), ('reversal'), ('trend')) AS names(strategy)"""

V["net_returns"] = """
SELECT *, held * ret1 - turn * 0.0015::DOUBLE AS net FROM (
 SELECT *, abs(held - coalesce(lag(held) OVER w, 0.0)) AS turn FROM (
  SELECT *, coalesce(lag(target) OVER w, 0.0) AS held FROM strategies
  WINDOW w AS (PARTITION BY strategy, symbol ORDER BY session))
 WINDOW w AS (PARTITION BY strategy, symbol ORDER BY session))"""

V["samples"] = """
SELECT o_orderkey AS sample_id, CAST(o_orderdate AS DATE) AS event_date, o_orderstatus AS category,
       o_orderpriority AS theme, CAST(substr(o_orderpriority, 1, 1) AS INT) AS importance,
       o_totalprice AS size, o_custkey AS cust FROM orders"""

V["articles"] = r"""
SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS body, source, lang,
       TIMESTAMP '1996-01-01 00:00:00' + to_minutes(doc_id * 7919 % 2000000) AS published_at,
       TIMESTAMP '1996-01-01 00:00:00' + to_minutes(doc_id * 7919 % 2000000 + doc_id % 180) AS available_at
FROM documents"""

V["ticks"] = """
SELECT event_id, event_type AS symbol, ts, user_id, 100.0::DOUBLE + sqrt(value) AS price,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size FROM events"""

V["intraday"] = """
SELECT symbol, date_trunc('hour', ts) AS bar, arg_min(price, row(ts, event_id)) AS open, max(price) AS high,
       min(price) AS low, arg_max(price, row(ts, event_id)) AS close, sum(size) AS volume, count(*) AS n_ticks
FROM ticks GROUP BY 1, 2"""

V["holdings"] = """
SELECT l_partkey AS cusip, l_suppkey AS manager, CASE WHEN l_linestatus = 'O' THEN 'SH' ELSE 'PRN' END AS amount_type,
       CASE WHEN l_returnflag = 'R' THEN 'Put' END AS put_call, l_extendedprice AS value_usd, l_quantity AS amount
FROM lineitem"""

V["option_bars"] = """
SELECT *, greatest(CASE WHEN cp = 'C' THEN spot - strike ELSE strike - spot END, 0.0) + 0.4::DOUBLE * width AS mid,
       CASE WHEN cp = 'C' THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-1.6::DOUBLE * (spot - strike) / width))
            ELSE 1.0::DOUBLE / (1.0::DOUBLE + exp(-1.6::DOUBLE * (spot - strike) / width)) - 1 END AS delta,
       regexp_replace(symbol, '[^A-Z0-9]', '', 'g') || strftime(expiry, '%y%m%d') || cp
         || lpad(CAST(CAST(strike * 1000 AS BIGINT) AS VARCHAR), 8, '0') AS occ
FROM (
 SELECT q.*, b.close AS spot, date_diff('day', q.session, q.expiry) AS dte,
        b.close * q.iv * sqrt(date_diff('day', q.session, q.expiry) / 365.0::DOUBLE) AS width
 FROM (
  SELECT symbol, session, expiry, strike, cp, sum(qty) AS volume, 0.15::DOUBLE + avg(disc) AS iv
  FROM (
   SELECT symbol, session, qty, disc, CASE WHEN l_linenumber % 2 = 1 THEN 'C' ELSE 'P' END AS cp,
          5000.0::DOUBLE + 50.0::DOUBLE * (CAST(qty AS INT) % 9) AS strike,
          CAST(date_trunc('month', session) + to_months(CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 2 END) AS DATE) + 14
            AS expiry
   FROM lines) GROUP BY 1, 2, 3, 4, 5) q
 JOIN bars b ON b.symbol = q.symbol AND b.session = q.session)"""


def add_view(name: str, sql: str) -> None:
    V[name] = sql


def with_views(sql: str) -> str:
    """Prefix the views a statement uses, in dependency order."""
    names = list(V)
    need: set[str] = set()

    def visit(text: str) -> None:
        words = set(re.findall(r"[a-z_0-9]+", text))
        for n in names:
            if n in words and n not in need:
                need.add(n)
                visit(V[n])

    visit(sql)
    if not need:
        return sql
    ordered: list[str] = []

    def place(n: str) -> None:
        if n in ordered:
            return
        words = set(re.findall(r"[a-z_0-9]+", V[n]))
        for m in names:
            if m in words and m != n and m in need:
                place(m)
        ordered.append(n)

    for n in names:
        if n in need:
            place(n)
    ctes = ",\n".join(f"{n} AS ({V[n].strip()})" for n in ordered)
    return f"WITH {ctes}\n{sql}"


def ewm(src: str, specs: dict[str, tuple[str, float, int]], key: str = "symbol", order: str = "session") -> str:
    """Closed form of the recursive exponentially weighted mean, appended to ``src``."""
    w = f"(PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    xs = sorted({x for x, _, _ in specs.values()})
    counts = ", ".join(f"count({x}) OVER {w} - 1 AS i_{x}" for x in xs)
    outs = []
    for out, (x, a, k) in specs.items():
        r = f"(-ln(1.0::DOUBLE - {a!r}::DOUBLE))"
        outs.append(
            f"CASE WHEN i_{x} >= {k - 1} THEN exp(-{r} * i_{x}) * sum(CASE WHEN i_{x} = 0 THEN 1.0::DOUBLE "
            f"ELSE {a!r}::DOUBLE END * {x} * exp({r} * i_{x})) OVER {w} END AS {out}")
    return f"SELECT * EXCLUDE ({', '.join('i_' + x for x in xs)}), {', '.join(outs)} FROM (SELECT *, {counts} FROM {src})"
