"""SQL of the registered queries, for DuckDB over the same tables.

Common tables are written once, with the ones that they read; a query names what it needs.
"""

from __future__ import annotations

from panelforge.functions.distributions import ERF, ERFC, TAIL
from panelforge.operators.analysis import random_grid

TABLES: dict[str, tuple[tuple[str, ...], str]] = {}
ORACLE: dict[str, str] = {}
T = "PARTITION BY ticker ORDER BY date"
STUDY = ("ict_displacement_bullish", "ict_displacement_bearish", "ict_volume_imbalance_bullish", "ict_volume_imbalance_bearish", "ict_fvg_bullish_formed", "ict_fvg_bearish_formed")


def table(name: str, needs: str, sql: str) -> None:
    TABLES[name] = (tuple(needs.split()), sql)


def sql(needs: str, select: str) -> str:
    """The query with its common tables, each after those that it needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in TABLES[name][0]:
                visit(n)
            order.append(name)

    for n in needs.split():
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n][1]})" for n in order) + "\n" + select


def query(name: str, needs: str, select: str) -> None:
    ORACLE[name] = sql(needs, select)


def r(expr: str, name: str = "") -> str:
    """Rounded, without a negative zero."""
    return f"round({expr} + 1e-9, 6) + 0.0 AS {name or expr}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


D = "CAST(date AS VARCHAR) AS date"

table("bars0", "", """
  SELECT l_returnflag || l_linestatus AS ticker, CAST(l_shipdate AS DATE) AS date,
         arg_min(100 + l_extendedprice / 1000, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS open,
         max(100 + l_extendedprice / 1000) AS high, min(100 + l_extendedprice / 1000) AS low,
         arg_max(100 + l_extendedprice / 1000, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS close,
         sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2""")
table("bars", "bars0", f"SELECT *, row_number() OVER ({T}) AS pos, count(*) OVER (PARTITION BY ticker) AS n_bars, lag(close) OVER ({T}) AS pc FROM bars0")
table("dirty", "bars", """
  SELECT ticker, date, CASE WHEN pos % 40 <> 0 THEN open END AS open, CASE WHEN pos % 7 = 0 THEN (open + close) / 2 ELSE high END AS high,
         CASE WHEN pos % 11 = 0 THEN greatest(open, close) ELSE low END AS low, CASE WHEN pos % 97 = 0 THEN -close ELSE close END AS close, volume FROM bars
  UNION ALL SELECT ticker, date, open, high, low, close, volume + 1 FROM bars WHERE pos % 50 = 0""")

# Hygiene
query("ohlc_repair", "dirty", f"""
SELECT ticker, CAST(count(*) FILTER (WHERE (abs(hi - high) + abs(lo - low)) / abs(close) > 1e-6) AS BIGINT) AS material, {r('sum(hi)', 'sum_high')}, {r('sum(lo)', 'sum_low')}
FROM (SELECT *, greatest(high, open, close) AS hi, least(low, open, close) AS lo FROM dirty) GROUP BY ticker""")
query("quality_report", "dirty", f"""
, x AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date, open NULLS FIRST, high, low, close) - 1 AS ret,
               row_number() OVER (PARTITION BY ticker, date ORDER BY open NULLS FIRST, high, low, close) AS nth, 1e-6 * greatest(abs(close), 1e-9) AS tol FROM dirty),
g AS (SELECT ticker, count(*) AS n_rows, min(date) AS a, max(date) AS b,
        CAST(sum((open IS NULL)::INT + (high IS NULL)::INT + (low IS NULL)::INT + (close IS NULL)::INT + (volume IS NULL)::INT) AS BIGINT) AS missing_values,
        count(*) FILTER (WHERE nth > 1) AS duplicate_dates,
        count(*) FILTER (WHERE high < greatest(open, close) - tol OR low > least(open, close) + tol OR high < low - tol) AS invalid_ohlc,
        count(*) FILTER (WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS nonpositive_rows, count(*) FILTER (WHERE abs(ret) > 0.5) AS extreme_moves
      FROM x GROUP BY ticker)
SELECT ticker, n_rows, CAST(a AS VARCHAR) AS start_date, CAST(b AS VARCHAR) AS end_date, missing_values, duplicate_dates, invalid_ohlc, nonpositive_rows, extreme_moves,
       round(1e-9 + n_rows / (SELECT count(*) FROM generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY) s(d) WHERE isodow(d) < 6), 3) + 0.0 AS coverage,
       CASE WHEN missing_values > 0 OR duplicate_dates > 0 OR invalid_ohlc > 0 OR nonpositive_rows > 0 THEN 'ISSUES_FOUND' ELSE 'OK' END AS status FROM g""".lstrip())
ORACLE["quality_report"] = ORACLE["quality_report"].replace(")\n, x AS", "),\nx AS")
query("dedup_first", "dirty", f"SELECT ticker, count(*) AS n_rows, {r('sum(volume)', 'volume')} FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY volume) AS k FROM dirty) WHERE k = 1 GROUP BY ticker")
query("min_bars_gate", "bars", "SELECT ticker, count(*) AS n_bars FROM bars WHERE n_bars >= 2440 GROUP BY ticker")
query("stale_audit", "bars", "SELECT ticker, CAST(min(date) AS VARCHAR) AS first_date FROM bars GROUP BY ticker HAVING date_diff('day', DATE '1991-01-01', min(date)) > 400")
query("missing_anti", "bars", "SELECT ticker FROM (SELECT DISTINCT l_returnflag || s AS ticker FROM lineitem, (VALUES ('F'), ('O'), ('X')) v(s)) WHERE ticker NOT IN (SELECT ticker FROM bars)")
ORACLE["normalize_symbol"] = """
SELECT symbol, count(*) AS n FROM (
  SELECT CASE s WHEN 'BUILDING.1' THEN 'BLD' WHEN 'MACHINERY.2' THEN 'MCH-B' ELSE replace(s, '.', '-') END AS symbol
  FROM (SELECT trim(' ' || c_mktsegment || '.' || c_nationkey || ' ') AS s FROM customer)) GROUP BY symbol"""
table("added", "", "SELECT ticker, CAST(d AS DATE) AS added FROM (VALUES ('AF', '1990-01-02'), ('AO', '1994-06-01'), ('NF', '1996-01-01'), ('NO', NULL), ('RF', '1997-03-03')) v(ticker, d)")
table("sectors", "", "SELECT * FROM (VALUES ('AF', 'A'), ('AO', 'A'), ('NF', 'N'), ('NO', 'N'), ('RF', 'R')) v(ticker, sector)")
query("membership_mask", "bars added", "SELECT ticker, count(*) FILTER (WHERE coalesce(date >= added, true)) AS kept, count(*) FILTER (WHERE coalesce(date >= added, false)) AS kept_known FROM bars LEFT JOIN added USING (ticker) GROUP BY ticker")

# Indicators
table("tr", "bars", "SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM bars")


def wilder(name: str, source: str, value: str, length: int) -> None:
    """Closed form of the recurrence, seeded with the mean of the first values."""
    q = f"(1.0 - 1.0 / {length})"
    table(name, source, f"""
  SELECT *, CASE WHEN pos >= {length} THEN pow({q}, pos - {length}) * (avg({value}) FILTER (WHERE pos <= {length}) OVER (PARTITION BY ticker)
    + coalesce(sum(CASE WHEN pos > {length} THEN {value} / {length} * pow({q}, {length} - pos) END) OVER ({T} ROWS UNBOUNDED PRECEDING), 0)) END AS {name} FROM {source}""")


wilder("atr10", "tr", "tr", 10)
wilder("atr14", "tr", "tr", 14)
wilder("atr200", "atr14", "tr", 200)
query("true_range", "tr", f"SELECT ticker, {D}, {r('tr')} FROM tr")
query("wilder_atr", "atr200", f"SELECT ticker, {D}, {rs('atr14', 'atr200')} FROM atr200")


def pivot_table(name: str, left: int, right: int) -> None:
    table(name, "bars", f"""
  SELECT *, coalesce(lag(ph, {right}) OVER ({T}), false) AS phc, coalesce(lag(pl, {right}) OVER ({T}), false) AS plc FROM (
    SELECT *, coalesce(pos > {left} AND pos <= n_bars - {right} AND high > max(high) OVER ({T} ROWS BETWEEN {left} PRECEDING AND 1 PRECEDING) AND high >= max(high) OVER ({T} ROWS BETWEEN 1 FOLLOWING AND {right} FOLLOWING), false) AS ph,
           coalesce(pos > {left} AND pos <= n_bars - {right} AND low < min(low) OVER ({T} ROWS BETWEEN {left} PRECEDING AND 1 PRECEDING) AND low <= min(low) OVER ({T} ROWS BETWEEN 1 FOLLOWING AND {right} FOLLOWING), false) AS pl FROM bars)""")


pivot_table("piv", 5, 1)
query("pivots", "piv", f"SELECT ticker, {D}, ph AS pivot_high, pl AS pivot_low, phc AS pivot_high_confirmed, plc AS pivot_low_confirmed FROM piv")


def leg_table(name: str, source: str, size: int) -> None:
    """leg, and sh/sl: the price of a swing on the bar that confirms it."""
    table(name, source, f"""
  SELECT *, CASE WHEN leg = 0 AND was = 1 THEN back_high END AS sh, CASE WHEN leg = 1 AND was = 0 THEN back_low END AS sl FROM (
    SELECT *, lag(leg) OVER ({T}) AS was FROM (
      SELECT *, coalesce(last_value(turn IGNORE NULLS) OVER ({T} ROWS UNBOUNDED PRECEDING), 0) AS leg FROM (
        SELECT *, CASE WHEN pos > {size} AND back_high > top THEN 0 WHEN pos > {size} AND back_low < bottom THEN 1 END AS turn FROM (
          SELECT *, lag(high, {size}) OVER ({T}) AS back_high, lag(low, {size}) OVER ({T}) AS back_low,
                 max(high) OVER ({T} ROWS {size - 1} PRECEDING) AS top, min(low) OVER ({T} ROWS {size - 1} PRECEDING) AS bottom FROM {source}))))""")


leg_table("legs5", "bars", 5)
leg_table("legs10", "bars", 10)
leg_table("legs10a", "atr14", 10)
leg_table("legs3", "atr200", 3)
query("leg_state", "legs5", f"SELECT ticker, {D}, CAST(leg AS BIGINT) AS x_leg FROM legs5")
query("swing_points", "legs10", f"SELECT ticker, {D}, {r('sh', 'x_high')}, {r('sl', 'x_low')} FROM legs10 WHERE sh IS NOT NULL OR sl IS NOT NULL")
query("sma", "bars", f"""SELECT ticker, {D}, {r(f'CASE WHEN pos >= 20 THEN avg(close) OVER ({T} ROWS 19 PRECEDING) END', 'sma20')},
  {r(f'CASE WHEN pos >= 100 THEN avg(close) OVER ({T} ROWS 199 PRECEDING) END', 'sma200_half')}, {r(f'close - lag(close, 20) OVER ({T})', 'diff20')} FROM bars""")
table("ret", "bars", "SELECT *, close / pc - 1 AS ret FROM bars")
table("vol", "ret", f"SELECT *, CASE WHEN pos >= 64 THEN stddev_samp(ret) OVER ({T} ROWS 62 PRECEDING) END AS vol FROM ret")
query("rolling_std", "vol", f"SELECT ticker, {D}, {r('vol', 'std63')} FROM vol")
query("expanding_median", "bars", f"SELECT ticker, {D}, {r(f'CASE WHEN pos >= 63 THEN median(close) OVER ({T} ROWS UNBOUNDED PRECEDING) END', 'median_so_far')} FROM bars")
query("expanding_extremes", "bars", f"""SELECT ticker, {D}, {r(f'max(high) OVER ({T})', 'top')}, {r(f'min(low) OVER ({T})', 'bottom')}, {r(f'sum(volume) OVER ({T})', 'total')},
  {r(f'avg(close) OVER ({T})', 'mean')}, {r(f'max(high) OVER ({T} ROWS 19 PRECEDING)', 'top20')} FROM bars""")


def ema(alpha: str, value: str, seed: int) -> str:
    q = f"(1.0 - {alpha})"
    return f"""CASE WHEN pos >= {seed} THEN pow({q}, pos - {seed}) * sum(CASE WHEN pos = {seed} THEN {value} WHEN pos > {seed} THEN {alpha} * {value} * pow({q}, {seed} - pos) END) OVER ({T} ROWS UNBOUNDED PRECEDING) END"""


table("emas", "bars", f"SELECT *, {ema('(2.0 / 21)', 'close', 1)} AS ema20, {ema('(2.0 / 51)', 'close', 1)} AS ema50 FROM bars")
query("ema", "emas", f"SELECT ticker, {D}, {rs('ema20', 'ema50')} FROM emas")
table("rsis", "bars", f"""SELECT *, 100 - 100 / (1 + g / nullif(l, 0)) AS rsi FROM (SELECT *, {ema('(1.0 / 14)', 'greatest(close - pc, 0)', 2)} AS g, {ema('(1.0 / 14)', 'greatest(pc - close, 0)', 2)} AS l FROM bars)""")
query("rsi", "rsis", f"SELECT ticker, {D}, {r('rsi')} FROM rsis")
query("ffill", "bars", f"SELECT ticker, {D}, {r(f'last_value(CASE WHEN close > open THEN close END IGNORE NULLS) OVER ({T} ROWS UNBOUNDED PRECEDING)', 'last_up_close')} FROM bars")
table("paths", "ret", f"SELECT *, sum(ln(1 + ret)) OVER ({T} ROWS UNBOUNDED PRECEDING) AS path FROM ret")
table("falls", "paths", f"SELECT *, exp(path - max(path) OVER ({T} ROWS UNBOUNDED PRECEDING)) - 1 AS fall FROM paths")
query("drawdown", "falls", f"SELECT ticker, {D}, {r('fall')} FROM falls")
table("weeks", "bars", f"SELECT *, coalesce(isodow(date) - lag(isodow(date)) OVER ({T}), -1) <= 0 AS week_open FROM bars")
query("week_open", "weeks", f"SELECT ticker, {D}, week_open FROM weeks")
query("forward_breach", "bars", f"SELECT ticker, {D}, coalesce(min(low) OVER ({T} ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) < low, false) AS breached FROM bars")
query("forward_excursion", "bars", f"SELECT ticker, {D}, {r(f'max(high) OVER ({T} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)', 'top10')}, {r(f'min(low) OVER ({T} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)', 'bottom10')} FROM bars")
query("forward_return", "bars", f"SELECT ticker, {D}, " + ", ".join(r(f"lead(close, {h}) OVER ({T}) / close - 1", f"fwd{h}") for h in (1, 10, 60)) + " FROM bars")


# Detectors
def displacement(length: int = 5, part: float = 0.36, source: str = "bars", up: str = "disp_up", down: str = "disp_dn") -> str:
    big = f"(abs(close - open) > CASE WHEN pos >= {length} THEN avg(abs(close - open)) OVER ({T} ROWS {length - 1} PRECEDING) END AND high - greatest(open, close) < abs(close - open) * {part} AND least(open, close) - low < abs(close - open) * {part})"
    return f"SELECT *, coalesce({big} AND close > open, false) AS {up}, coalesce({big} AND close < open, false) AS {down} FROM {source}"


def fired(name: str, needs: str, source: str, *columns: tuple[str, str]) -> None:
    query(name, needs, f"SELECT ticker, {D}, " + ", ".join(f"{e} AS {n}" for e, n in columns) + f" FROM {source} WHERE " + " OR ".join(e for e, _ in columns))


table("disp", "bars", displacement())
fired("displacement", "disp", "disp", ("disp_up", "ict_displacement_bullish"), ("disp_dn", "ict_displacement_bearish"))
table("vi", "disp", f"""
  SELECT *, coalesce(open > pc AND h1 > low AND close > pc AND open > o1 AND h1 < least(open, close), false) AS vi_up, coalesce(open < pc AND l1 < high AND close < pc AND open < o1 AND l1 > greatest(open, close), false) AS vi_dn
  FROM (SELECT *, lag(open) OVER ({T}) AS o1, lag(high) OVER ({T}) AS h1, lag(low) OVER ({T}) AS l1, lag(high, 2) OVER ({T}) AS h2, lag(low, 2) OVER ({T}) AS l2,
               coalesce(lag(disp_up) OVER ({T}), false) AS du, coalesce(lag(disp_dn) OVER ({T}), false) AS dd FROM disp)""")
fired("volume_imbalance", "vi", "vi", ("vi_up", "ict_volume_imbalance_bullish"), ("vi_dn", "ict_volume_imbalance_bearish"))
table("fvg", "vi", f"""
  SELECT *, CASE WHEN f_up THEN h2 END AS ul, CASE WHEN f_up THEN low END AS uh, CASE WHEN f_dn THEN high END AS dl, CASE WHEN f_dn THEN l2 END AS dh,
         min(low) OVER ({T} ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS next_low, max(high) OVER ({T} ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS next_high
  FROM (SELECT *, coalesce(du AND low > h2, false) AS f_up, coalesce(dd AND high < l2, false) AS f_dn FROM vi)""")
query("fvg", "fvg", f"SELECT ticker, {D}, f_up AS ict_fvg_bullish_formed, {r('ul', 'ict_fvg_bullish_lower')}, {r('uh', 'ict_fvg_bullish_upper')}, f_dn AS ict_fvg_bearish_formed, {r('dl', 'ict_fvg_bearish_lower')}, {r('dh', 'ict_fvg_bearish_upper')} FROM fvg WHERE f_up OR f_dn")
query("fvg_fill_label", "fvg", f"SELECT ticker, {D}, coalesce(next_low < ul, false) AS ict_fvg_bullish_filled_label, coalesce(next_high > dh, false) AS ict_fvg_bearish_filled_label FROM fvg WHERE f_up OR f_dn")
fired("fvg_ifvg", "vi", "(SELECT *, coalesce(du AND low < h2, false) AS a, coalesce(dd AND high > l2, false) AS b FROM vi)", ("a", "ict_fvg_bullish_formed"), ("b", "ict_fvg_bearish_formed"))
held = lambda c: f"last_value({c} IGNORE NULLS) OVER ({T} ROWS UNBOUNDED PRECEDING)"
held_before = lambda c: f"last_value({c} IGNORE NULLS) OVER ({T} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
fired("bpr", "fvg", f"(SELECT *, coalesce(a IS NOT NULL AND c IS NOT NULL AND greatest(a, c) < least(b, d), false) AND f_up AS x, coalesce(a IS NOT NULL AND c IS NOT NULL AND greatest(a, c) < least(b, d), false) AND f_dn AS y FROM (SELECT *, {held('ul')} AS a, {held('uh')} AS b, {held('dl')} AS c, {held('dh')} AS d FROM fvg))", ("x", "ict_bpr_bullish"), ("y", "ict_bpr_bearish"))

# Pivots of a zigzag as a sequence, highs of a bar before its lows; a run of one side is a vertex
table("pivot_seq", "piv", f"""
  SELECT ticker, pos, k, side, price, sum(fresh) OVER (PARTITION BY ticker ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN side = lag(side) OVER (PARTITION BY ticker ORDER BY k) THEN 0 ELSE 1 END AS fresh FROM (
      SELECT ticker, pos, 2 * pos AS k, 1 AS side, h AS price FROM (SELECT *, lag(high) OVER ({T}) AS h FROM piv) WHERE phc
      UNION ALL SELECT ticker, pos, 2 * pos + 1, -1, l FROM (SELECT *, lag(low) OVER ({T}) AS l FROM piv) WHERE plc))""")
table("vertices", "pivot_seq", """
  SELECT ticker, pos, side, CASE WHEN side = 1 THEN max(price) OVER (PARTITION BY ticker, run ORDER BY k ROWS UNBOUNDED PRECEDING) ELSE min(price) OVER (PARTITION BY ticker, run ORDER BY k ROWS UNBOUNDED PRECEDING) END AS v FROM pivot_seq""")
table("zz", "bars vertices", f"""
  SELECT *, {held('vh')} AS top, {held('vl')} AS bottom FROM (
    SELECT b.*, h.v AS vh, l.v AS vl FROM bars b LEFT JOIN vertices h ON h.ticker = b.ticker AND h.pos = b.pos AND h.side = 1 LEFT JOIN vertices l ON l.ticker = b.ticker AND l.pos = b.pos AND l.side = -1)""")
fired("mss", "zz", f"""(SELECT *, coalesce(s = 1 AND d < 1, false) AS x, coalesce(s = -1 AND d > -1, false) AS y FROM (SELECT *, coalesce({held_before('s')}, 0) AS d FROM (
  SELECT *, CASE WHEN top IS NULL OR bottom IS NULL THEN NULL WHEN close > top THEN 1 WHEN close < bottom THEN -1 END AS s FROM zz)))""", ("x", "ict_mss_bullish"), ("y", "ict_mss_bearish"))


def segment_table(name: str, source: str) -> None:
    table(name, source, f"SELECT *, count(sh) OVER ({T} ROWS UNBOUNDED PRECEDING) AS hseg, {held('sh')} AS hlev, count(sl) OVER ({T} ROWS UNBOUNDED PRECEDING) AS lseg, {held('sl')} AS llev FROM {source}")


def first_table(name: str, source: str, up: str, down: str) -> None:
    """up/dn: the first row of each segment where the condition holds."""
    table(name, source, f"""
  SELECT * EXCLUDE (cu, cd), cu AND hseg > 0 AND sum(cu::INT) OVER (PARTITION BY ticker, hseg ORDER BY date ROWS UNBOUNDED PRECEDING) = 1 AS up, cd AND lseg > 0 AND sum(cd::INT) OVER (PARTITION BY ticker, lseg ORDER BY date ROWS UNBOUNDED PRECEDING) = 1 AS dn
  FROM (SELECT *, coalesce({up}, false) AS cu, coalesce({down}, false) AS cd FROM {source})""")


def block_tables(name: str, source: str, size: int, after: int, low: str, high: str, probe_low: str, probe_high: str, cap: int | None) -> None:
    """{name}m: bars of mitigation of either side, by joins over positions."""
    for side, cond, seg, agg, src, probe, op in (("u", "up", "hseg", "min", low, probe_low, "<"), ("d", "dn", "lseg", "max", high, probe_high, ">")):
        swing = "sh" if side == "u" else "sl"
        table(f"{name}b{side}", source, f"""
  SELECT f.ticker, f.pos AS p, {agg}({src}) AS edge FROM {source} f JOIN {source} c ON c.ticker = f.ticker AND c.{seg} = f.{seg} AND c.{swing} IS NOT NULL
  JOIN {source} w ON w.ticker = f.ticker AND w.pos >= c.pos - {size} + {after} AND w.pos < f.pos WHERE f.{cond} GROUP BY 1, 2""")
        limit = f"lead(p, {cap}) OVER (PARTITION BY ticker ORDER BY p)" if cap else "NULL"
        table(f"{name}m{side}", f"{name}b{side} {source}", f"""
  SELECT DISTINCT ticker, hit AS pos FROM (SELECT b.ticker, b.p, any_value(b.until) AS until, min(x.pos) AS hit FROM (SELECT *, {limit} AS until FROM {name}b{side}) b JOIN {source} x ON x.ticker = b.ticker AND x.pos >= b.p AND {probe} {op} b.edge GROUP BY 1, 2) WHERE until IS NULL OR hit < until""")


segment_table("ob0", "legs10")
first_table("ob1", "ob0", "close > hlev", "close < llev")
block_tables("ob", "ob1", 10, 1, "least(w.open, w.close)", "greatest(w.open, w.close)", "least(x.open, x.close)", "greatest(x.open, x.close)", 200)
fired("order_blocks_ict", "obmu obmd ob1", "(SELECT o.*, u.pos IS NOT NULL AS mu, d.pos IS NOT NULL AS md FROM ob1 o LEFT JOIN obmu u USING (ticker, pos) LEFT JOIN obmd d USING (ticker, pos))",
      ("up", "ict_ob_bullish_formed"), ("mu", "ict_ob_bullish_mitigated"), ("dn", "ict_ob_bearish_formed"), ("md", "ict_ob_bearish_mitigated"))

for side, swing, pen, back in (("u", "sh", "high > lev + 0.25 * atr14", "close < pwas"), ("d", "sl", "low < lev - 0.25 * atr14", "close > pwas")):
    table(f"sweep{side}", "legs10a", f"""
  SELECT *, hit AND seg > 0 AND sum(hit::INT) OVER (PARTITION BY ticker, seg ORDER BY date ROWS UNBOUNDED PRECEDING) = 1 AS fire FROM (
    SELECT *, coalesce(pos - pat <= 3 AND {back} + 0 * atr14, false) AS hit FROM (
      SELECT *, coalesce(sum(pen::INT) OVER ({T} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg, {held_before('CASE WHEN pen THEN pos END')} AS pat, {held_before('CASE WHEN pen THEN lev END')} AS pwas FROM (
        SELECT *, coalesce({pen}, false) AS pen FROM (SELECT *, {held_before(swing)} AS lev FROM legs10a))))""")
fired("liquidity_sweep", "sweepu sweepd", "(SELECT u.ticker, u.date, u.fire AS fu, d.fire AS fd FROM sweepu u JOIN sweepd d USING (ticker, date))", ("fu", "ict_sweep_buyside_bearish"), ("fd", "ict_sweep_sellside_bullish"))
table("gaps", "atr14", f"""
  SELECT *, coalesce(abs(gap) >= 0.1 * a1, false) AS material FROM (SELECT *, open - pc AS gap, lag(atr14) OVER ({T}) AS a1, coalesce(isodow(date) - lag(isodow(date)) OVER ({T}), -1) <= 0 AS wk FROM atr14)""")
query("opening_gaps", "gaps", f"SELECT ticker, {D}, material AND wk AND gap > 0 AS ict_nwog_gap_up, material AND wk AND gap < 0 AS ict_nwog_gap_down, material AND gap > 0 AS ict_ndog_gap_up, material AND gap < 0 AS ict_ndog_gap_down, {r('abs(gap)', 'ict_ndog_gap_size')} FROM gaps WHERE material AND gap <> 0")

table("parsed", "atr200", "SELECT *, CASE WHEN high - low >= 2 * atr200 THEN low ELSE high END AS ph, CASE WHEN high - low >= 2 * atr200 THEN high ELSE low END AS pl FROM atr200")
query("parsed_high_low", "parsed", f"SELECT ticker, {D}, {r('ph', '_phigh')}, {r('pl', '_plow')} FROM parsed")
leg_table("s50a", "parsed", 50)
segment_table("s50b", "s50a")
first_table("s50", "s50b", "close > hlev AND pc <= hlev", "close < llev AND pc >= llev")
table("swing_levels", "s50", "SELECT ticker AS tk, pos AS ps, hlev AS oh, llev AS ol FROM s50")
leg_table("s5a", "parsed", 5)
segment_table("s5b", "s5a")
table("s5c", "s5b swing_levels", "SELECT * EXCLUDE (tk, ps) FROM s5b JOIN swing_levels ON tk = ticker AND ps = pos")
first_table("s5", "s5c", "close > hlev AND pc <= hlev AND hlev IS DISTINCT FROM oh", "close < llev AND pc >= llev AND llev IS DISTINCT FROM ol")
for scale, src in (("swing", "s50"), ("internal", "s5")):
    fired(f"structure_{scale}", src, f"""(SELECT *, up AND bias <> -1 AS bu, up AND bias = -1 AS cu, dn AND below <> 1 AS bd, dn AND below = 1 AS cd FROM (SELECT *, CASE WHEN up THEN 1 ELSE bias END AS below FROM (
  SELECT *, coalesce({held_before('CASE WHEN dn THEN -1 WHEN up THEN 1 END')}, 0) AS bias FROM {src})))""",
          *[(e, f"smc_{scale}_{n}") for e, n in (("bu", "bos_bullish"), ("bd", "bos_bearish"), ("cu", "choch_bullish"), ("cd", "choch_bearish"))])
    block_tables(src, src, 50 if scale == "swing" else 5, 0, "w.pl", "w.ph", "x.low", "x.high", None)
table("smc_blocks", "s50 s5 s50mu s50md s5mu s5md", """
  SELECT a.ticker, a.date, a.up AS a1, u1.pos IS NOT NULL AS a2, a.dn AS a3, d1.pos IS NOT NULL AS a4, b.up AS b1, u2.pos IS NOT NULL AS b2, b.dn AS b3, d2.pos IS NOT NULL AS b4
  FROM s50 a JOIN s5 b USING (ticker, pos) LEFT JOIN s50mu u1 USING (ticker, pos) LEFT JOIN s50md d1 USING (ticker, pos) LEFT JOIN s5mu u2 USING (ticker, pos) LEFT JOIN s5md d2 USING (ticker, pos)""")
for name in ("order_blocks_smc", "order_blocks_live_cap"):  # the cap of live blocks does not bind on this panel
    fired(name, "smc_blocks", "smc_blocks", *[(f"{k}{i}", f"smc_{s}_ob_{e}") for k, s in (("a", "swing"), ("b", "internal")) for i, e in enumerate(("bullish_formed", "bullish_mitigated", "bearish_formed", "bearish_mitigated"), 1)])
fired("equal_highs_lows", "legs3", f"(SELECT *, coalesce(abs(sh - {held_before('sh')}) < 0.1 * atr200, false) AS x, coalesce(abs(sl - {held_before('sl')}) < 0.1 * atr200, false) AS y FROM legs3)", ("x", "smc_equal_highs"), ("y", "smc_equal_lows"))
fired("smc_fvg", "vi", f"""(SELECT *, coalesce(low > h2 AND pc > h2 AND mv > lim, false) AS x, coalesce(high < l2 AND pc < l2 AND -mv > lim, false) AS y FROM (
  SELECT *, 2 * sum(abs(mv)) OVER ({T} ROWS UNBOUNDED PRECEDING) / pos AS lim FROM (SELECT *, (pc - o1) / (o1 * 100) AS mv FROM vi)))""", ("x", "smc_fvg_bullish_formed"), ("y", "smc_fvg_bearish_formed"))
for name, frame in (("zones", "ROWS UNBOUNDED PRECEDING"), ("zones_rolling", "ROWS 49 PRECEDING")):
    query(name, "bars", f"""SELECT ticker, {D}, CASE WHEN close <= 0.95 * b + 0.05 * t THEN 'discount' WHEN close >= 0.95 * t + 0.05 * b THEN 'premium' ELSE 'equilibrium' END AS smc_zone,
  {r('t', 'smc_trailing_top')}, {r('b', 'smc_trailing_bottom')} FROM (SELECT *, max(high) OVER ({T} {frame}) AS t, min(low) OVER ({T} {frame}) AS b FROM bars)""")
for unit in ("week", "month"):
    table(f"{unit}ly", "bars", f"SELECT ticker, date_trunc('{unit}', date) AS p, max(high) AS h, min(low) AS l FROM bars GROUP BY 1, 2")
query("mtf_levels", "bars weekly monthly", f"""SELECT b.ticker, CAST(b.date AS VARCHAR) AS date, {r('lag(b.high) OVER (PARTITION BY b.ticker ORDER BY b.date)', 'smc_prior_day_high')}, {r('lag(b.low) OVER (PARTITION BY b.ticker ORDER BY b.date)', 'smc_prior_day_low')},
  {r('w.h', 'smc_prior_week_high')}, {r('w.l', 'smc_prior_week_low')}, {r('m.h', 'smc_prior_month_high')}, {r('m.l', 'smc_prior_month_low')}
FROM bars b LEFT JOIN weekly w ON w.ticker = b.ticker AND w.p + INTERVAL 7 DAY = date_trunc('week', b.date) LEFT JOIN monthly m ON m.ticker = b.ticker AND m.p + INTERVAL 1 MONTH = date_trunc('month', b.date)""")
query("mtf_levels_compat", "bars weekly monthly", f"""SELECT b.ticker, CAST(b.date AS VARCHAR) AS date, {r('w.h', 'smc_prior_week_high')}, {r('w.l', 'smc_prior_week_low')}, {r('m.h', 'smc_prior_month_high')}, {r('m.l', 'smc_prior_month_low')}
FROM bars b LEFT JOIN weekly w ON w.ticker = b.ticker AND w.p + INTERVAL 14 DAY = date_trunc('week', b.date + INTERVAL 1 DAY) LEFT JOIN monthly m ON m.ticker = b.ticker AND m.p + INTERVAL 2 MONTH = date_trunc('month', b.date + INTERVAL 1 DAY)""")
cross = lambda x, lo, hi: (f"coalesce({x} {lo[0]} {lo[1]} AND lag({x}) OVER ({T}) {hi[0]} {hi[1]}, false)")
fired("ema_cross", "emas", f"(SELECT *, {cross('g', ('>', 0), ('<=', 0))} AS x, {cross('g', ('<', 0), ('>=', 0))} AS y FROM (SELECT *, ema20 - ema50 AS g FROM emas))", ("x", "baseline_ema_cross_bullish"), ("y", "baseline_ema_cross_bearish"))
fired("rsi_reversion", "rsis", f"(SELECT *, {cross('rsi', ('<', 30), ('>=', 30))} AS x, {cross('rsi', ('>', 70), ('<=', 70))} AS y FROM rsis)", ("x", "baseline_rsi_reversion_bullish"), ("y", "baseline_rsi_reversion_bearish"))
fired("breakout_52w", "bars", f"(SELECT *, hi AND NOT coalesce(lag(hi) OVER ({T}), false) AS x, lo AND NOT coalesce(lag(lo) OVER ({T}), false) AS y FROM (SELECT *, pos >= 252 AND close >= max(high) OVER ({T} ROWS 251 PRECEDING) AS hi, pos >= 252 AND close <= min(low) OVER ({T} ROWS 251 PRECEDING) AS lo FROM bars))", ("x", "baseline_52w_breakout_bullish"), ("y", "baseline_52w_breakout_bearish"))
fired("momentum_turn", "bars", f"(SELECT *, {cross('m', ('>', 0), ('<=', 0))} AS x, {cross('m', ('<', 0), ('>=', 0))} AS y FROM (SELECT *, close / lag(close, 126) OVER ({T}) - 1 AS m FROM bars))", ("x", "baseline_momentum_bullish"), ("y", "baseline_momentum_bearish"))
table("random", "bars", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY md5('42|' || ticker || '|' || CAST(date AS VARCHAR))) AS k FROM bars) WHERE k <= 500")
query("random_entry", "random", f"SELECT ticker, {D}, true AS baseline_random_bullish FROM random")
query("buy_and_hold", "falls", f"""SELECT ticker, {r('c1 / c0 - 1', 'total_return')}, {r('pow(c1 / c0, 365.25 / days) - 1', 'cagr')}, {r('m / s * sqrt(252)', 'sharpe')}, {r('mx', 'max_drawdown')}
FROM (SELECT ticker, arg_min(close, date) AS c0, arg_max(close, date) AS c1, date_diff('day', min(date), max(date)) AS days, avg(ret) AS m, stddev_samp(ret) AS s, min(fall) AS mx FROM falls GROUP BY ticker)""")
flags = ("disp_up", "disp_dn", "vi_up", "vi_dn", "f_up", "f_dn")
table("events_", "fvg", " UNION ALL ".join(f"SELECT ticker, date, pos, '{s}' AS signal, {1 if i % 2 == 0 else -1} AS direction, {i} AS ordinal, close FROM fvg WHERE {c}" for i, (s, c) in enumerate(zip(STUDY, flags, strict=True))))
query("events_long", "events_", f"SELECT ticker, {D}, signal, CAST(direction AS BIGINT) AS direction, {r('close')} FROM events_")
query("value_counts", "events_", "SELECT signal, count(*) AS n FROM events_ GROUP BY signal")
ORACLE["hourly_displacement"] = f"""
WITH b0 AS (SELECT event_type AS ticker, date_trunc('hour', ts) AS date, arg_min(100 + value, row(ts, event_id)) AS open, max(100 + value) AS high, min(100 + value) AS low, arg_max(100 + value, row(ts, event_id)) AS close FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
bars AS (SELECT *, row_number() OVER ({T}) AS pos FROM b0), d AS ({displacement()})
SELECT ticker, count(*) AS n_bars, count(*) FILTER (WHERE disp_up) AS n_up, count(*) FILTER (WHERE disp_dn) AS n_down FROM d GROUP BY ticker"""

# Trades
HORIZONS = (1, 2, 3, 5, 10, 20, 40, 60)


def trade_table(name: str, events: str, horizons: tuple[int, ...], bars: str = "bars") -> None:
    legs = " UNION ALL ".join(f"SELECT ticker, date, {h} AS holding_period, close AS entry_price, lead(close, {h}) OVER ({T}) AS exit_price, max(high) OVER ({T} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS top, min(low) OVER ({T} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS bottom FROM {bars}" for h in horizons)
    table(name, f"{bars} {events}", f"""
  SELECT e.ticker, e.date, signal, direction, ordinal, holding_period, entry_price, exit_price, direction * (exit_price / entry_price - 1) AS fwd_return,
         CASE WHEN direction = 1 THEN top / entry_price - 1 ELSE 1 - bottom / entry_price END AS mfe, CASE WHEN direction = 1 THEN bottom / entry_price - 1 ELSE 1 - top / entry_price END AS mae
  FROM {events} e JOIN ({legs}) f ON f.ticker = e.ticker AND f.date = e.date WHERE isfinite(exit_price) AND isfinite(entry_price) AND entry_price > 0""")


trade_table("trades", "events_", HORIZONS)
trade_table("trades10", "events_", (10,))
trade_table("trades1_10", "events_", (1, 10))
trade_table("trades_s", "events_", (1, 5, 10))
trade_table("trades4", "events_", (1, 5, 10, 20))
table("random_events", "random", "SELECT ticker, date, pos, 'baseline_random_bullish' AS signal, 1 AS direction, 0 AS ordinal, close FROM random")
trade_table("base", "random_events", HORIZONS)
trade_table("base10", "random_events", (10,))
H = "CAST(holding_period AS BIGINT) AS holding_period"
query("trades_all_horizons", "trades", f"SELECT ticker, {D}, signal, CAST(direction AS BIGINT) AS direction, {H}, {rs('entry_price', 'exit_price', 'fwd_return', 'mfe', 'mae')} FROM trades")
query("first_slice", "trades10", f"SELECT CAST(direction AS BIGINT) AS direction, count(*) AS n_trades, {r('avg(fwd_return)', 'mean_return')}, {r('avg((fwd_return > 0)::DOUBLE)', 'win_rate')} FROM trades10 WHERE signal LIKE 'ict_displacement%' GROUP BY direction")


def costed(source: str) -> str:
    """A row's identity is unique here, so its occurrence is 0."""
    u = f"('0x' || substr(md5('42|' || ticker || '|' || CAST(date AS VARCHAR) || '|' || signal || '|' || holding_period || '|0'), 1, 13))::BIGINT / pow(2, 52)"
    return f"SELECT *, fwd_return - cost_bps / 10000 AS net_return FROM (SELECT *, 11 + 15 * ({u}) AS cost_bps FROM {source})"


table("costed1_10", "trades1_10", costed("trades1_10"))
table("costed10", "trades10", costed("trades10"))
query("trade_costs", "costed1_10", f"SELECT ticker, {D}, signal, {H}, {rs('cost_bps', 'net_return')} FROM costed1_10")
query("position_audit", "bars", "SELECT ticker, pos, CASE WHEN pos + 10 <= n_bars THEN 10 ELSE 0 END::BIGINT AS n_read FROM bars WHERE pos > n_bars - 20")
query("cost_grid", "trades10", f"SELECT signal, CAST(c AS DOUBLE) AS cost_bps, count(*) AS n_trades, {r('avg(fwd_return - c / 10000.0)', 'mean_net_return')}, {r('avg((fwd_return - c / 10000.0 > 0)::DOUBLE)', 'win_rate')} FROM trades10, (VALUES (0), (5), (10), (20), (40), (60)) v(c) GROUP BY signal, c")
fwds = lambda hs: " UNION ALL ".join(f"SELECT ticker, date, {h} AS holding_period, lead(close, {h}) OVER ({T}) / close - 1 AS fwd FROM bars" for h in hs)
for name, hs in (("pools", HORIZONS), ("pools10", (10,)), ("pools_s", (1, 5, 10)), ("pools4", (1, 5, 10, 20))):
    table(name, "bars", f"SELECT ticker, holding_period, count(fwd) AS n_pool, avg(fwd) AS mu, var_samp(fwd) AS var FROM ({fwds(hs)}) WHERE fwd IS NOT NULL GROUP BY 1, 2 HAVING count(fwd) >= 2")
query("pools", "pools", f"SELECT ticker, {H}, n_pool, {rs('mu', 'var')} FROM pools")
table("excess10", "trades10 pools10", "SELECT t.*, fwd_return - direction * mu AS excess FROM trades10 t JOIN pools10 USING (ticker, holding_period)")
table("excess_s", "trades_s pools_s", "SELECT t.*, fwd_return - direction * mu AS excess FROM trades_s t JOIN pools_s USING (ticker, holding_period)")
query("breakeven", "trades10 excess10", f"SELECT signal, n_trades, {rs('breakeven_bps', 'breakeven_excess_bps')} FROM (SELECT signal, count(*) AS n_trades, avg(fwd_return) * 10000 AS breakeven_bps FROM trades10 GROUP BY signal) LEFT JOIN (SELECT signal, avg(excess) * 10000 AS breakeven_excess_bps FROM excess10 GROUP BY signal) USING (signal)")
query("net_of_cost", "costed10", f"SELECT signal, count(*) AS n_trades, {r('avg(fwd_return)', 'gross_mean')}, {r('avg(net_return)', 'net_mean')}, {r('avg((net_return > 0)::DOUBLE)', 'net_win_rate')}, {r('avg(cost_bps)', 'mean_cost_bps')} FROM costed10 GROUP BY signal")

# Aggregates and tests
table("summed", "trades", """
  SELECT *, exp(path - max(path) OVER (PARTITION BY signal, holding_period ORDER BY ticker, ordinal, date ROWS UNBOUNDED PRECEDING)) - 1 AS fall FROM (
    SELECT *, sum(ln(1 + greatest(fwd_return, -0.999999))) OVER (PARTITION BY signal, holding_period ORDER BY ticker, ordinal, date ROWS UNBOUNDED PRECEDING) AS path FROM trades)""")
query("return_summary", "summed", f"""
, g AS (SELECT signal, holding_period, count(*) AS n_trades, count(*) FILTER (WHERE x > 0) AS w, count(*) FILTER (WHERE x < 0) AS l, avg(x) AS m, median(x) AS md, stddev_samp(x) AS s, skewness(x) AS sk, kurtosis(x) AS ku,
  coalesce(sum(x) FILTER (WHERE x > 0), 0) AS gain, coalesce(-sum(x) FILTER (WHERE x < 0), 0) AS loss, stddev_samp(x) FILTER (WHERE x < 0) AS dn, avg(x) FILTER (WHERE x > 0) AS mw, avg(x) FILTER (WHERE x < 0) AS ml,
  min(fall) AS mdd, coalesce(avg(fall) FILTER (WHERE fall < 0), 0) AS add_, arg_max(path, row(ticker, ordinal, date)) AS fin, 252.0 / holding_period AS yr FROM (SELECT *, fwd_return AS x FROM summed) GROUP BY signal, holding_period)
SELECT signal, {H}, n_trades, {r('w / n_trades', 'win_rate')}, {r('m', 'avg_return')}, {r('md', 'median_return')}, {r('s', 'std_return')}, {r('sk', 'skewness')}, {r('ku', 'kurtosis')},
  {r("CASE WHEN loss > 0 THEN gain / loss WHEN gain > 0 THEN 'infinity'::DOUBLE END", 'profit_factor')}, {r('m / s * sqrt(yr)', 'sharpe')}, {r('m / dn * sqrt(yr)', 'sortino')},
  {r('coalesce(w / n_trades * mw, 0) + coalesce(l / n_trades * ml, 0)', 'expectancy')}, {r('mdd', 'max_drawdown')}, {r('add_', 'avg_drawdown')}, {r('CASE WHEN mdd < 0 THEN (exp(fin * yr / n_trades) - 1) / abs(mdd) END', 'calmar')},
  {r('exp(fin * yr / n_trades) - 1', 'cagr_annualized')}, {r('mw / abs(ml)', 'reward_risk_ratio')} FROM g""".lstrip())
ORACLE["return_summary"] = ORACLE["return_summary"].replace(")\n, g AS", "),\ng AS")
query("mfe_mae", "trades", f"SELECT signal, {H}, {r('avg(mfe)', 'avg_mfe')}, {r('avg(mae)', 'avg_mae')}, {r('median(mfe)', 'median_mfe')}, {r('median(mae)', 'median_mae')}, {r('quantile_cont(mfe, 0.9)', 'p90_mfe')}, {r('quantile_cont(mae, 0.1)', 'p10_mae')}, {r('avg(mfe) / avg(abs(mae))', 'mfe_mae_ratio')} FROM trades GROUP BY signal, holding_period")
query("calendar_collapse", "trades10", f"SELECT signal, {D}, {r('sum(fwd_return)', 'sum_return')}, count(*) AS n FROM trades10 GROUP BY signal, date")
query("newey_west", "trades_s", f"""SELECT signal, {H}, n, {r('mean')}, {r('se', 'nw_se')}, {r('mean / se', 't_stat')} FROM (SELECT signal, holding_period, count(*) AS n, avg(fwd_return) AS mean, sqrt(sum(e * e {' '.join(f'+ CASE WHEN bw >= {k} THEN 2 * (1 - {k} / (bw + 1.0)) * coalesce(e * e{k}, 0) ELSE 0 END' for k in range(1, 11))})) / count(*) AS se
FROM (SELECT *, {', '.join(f'lag(e, {k}) OVER o AS e{k}' for k in range(1, 11))} FROM (SELECT *, fwd_return - avg(fwd_return) OVER (PARTITION BY signal, holding_period) AS e, least(holding_period, count(*) OVER (PARTITION BY signal, holding_period) - 1) AS bw FROM trades_s) WINDOW o AS (PARTITION BY signal, holding_period ORDER BY ticker, ordinal, date)) GROUP BY signal, holding_period)""")
query("lag_autocov", "trades10", "SELECT signal, " + ", ".join(r(f"sum(x * x{k})", f"autocov{k}") for k in (1, 2, 3)) + " FROM (SELECT *, " + ", ".join(f"lag(x, {k}) OVER (PARTITION BY signal ORDER BY date) AS x{k}" for k in (1, 2, 3)) + " FROM (SELECT signal, date, sum(fwd_return) AS x FROM trades10 GROUP BY 1, 2)) GROUP BY signal")


def calendar(source: str, value: str, keys: str, names: tuple[str, str, str], h: str = "holding_period") -> str:
    """Calendar-time test by dense days and ten lags."""
    on = " AND ".join(f"d.{k} = s.{k}" for k in keys.split(", "))
    key = ", ".join(f"s.{k}" for k in keys.split(", "))
    lags = " ".join(f"+ CASE WHEN bw >= {k} THEN 2 * (1 - {k} / (bw + 1.0)) * coalesce(x * x{k}, 0) ELSE 0 END" for k in range(1, 11))
    return f"""(
  SELECT {keys}, any_value(mu) AS {names[0]}, sqrt(sum(x * x {lags})) AS {names[1]}, any_value(mu) / sqrt(sum(x * x {lags})) AS {names[2]}, any_value(total) AS n, count(*) FILTER (WHERE c > 0) AS n_dates FROM (
    SELECT *, {', '.join(f'lag(x, {k}) OVER (PARTITION BY {keys} ORDER BY day) AS x{k}' for k in range(1, 11))}, least(greatest(1, {h}), t - 1) AS bw FROM (
      SELECT *, (sm - c * mu) / total AS x FROM (
        SELECT *, sum(c) OVER (PARTITION BY {keys})::BIGINT AS total, sum(sm) OVER (PARTITION BY {keys}) / sum(c) OVER (PARTITION BY {keys}) AS mu, count(*) OVER (PARTITION BY {keys}) AS t FROM (
          SELECT {key}, s.day, coalesce(d.sm, 0) AS sm, coalesce(d.c, 0) AS c FROM (
            SELECT {keys}, day::DATE AS day FROM (SELECT {keys}, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM {source} GROUP BY {keys}) WHERE isodow(day) < 6
            UNION SELECT {keys}, date FROM {source}) s
          LEFT JOIN (SELECT {keys}, date, sum({value}) AS sm, count(*) AS c FROM {source} GROUP BY {keys}, date) d ON {on} AND d.date = s.day)))) GROUP BY {keys} HAVING any_value(total) >= 5)"""


query("calendar_hac", "trades_s", f"SELECT signal, {H}, {rs('mean', 'hac_se', 't_stat')}, n, n_dates FROM " + calendar("trades_s", "fwd_return", "signal, holding_period", ("mean", "hac_se", "t_stat")))
query("matched_excess", "excess_s", f"SELECT signal, {H}, {rs('mean', 'hac_se', 't_stat')}, n, n_dates FROM " + calendar("excess_s", "excess", "signal, holding_period", ("mean", "hac_se", "t_stat")))
table("ones", "trades", "SELECT signal, holding_period, count(*) AS n, avg(fwd_return) AS mean, avg(fwd_return) * sqrt(count(*)) / stddev_samp(fwd_return) AS t_iid, avg(fwd_return) / stddev_samp(fwd_return) AS cohens_d FROM trades GROUP BY 1, 2")
query("one_sample", "ones", f"SELECT signal, {H}, n, {rs('mean', 't_iid', 'cohens_d')} FROM ones")


def welch(a: str, b: str, keys: str, on: str) -> str:
    part = lambda t, k, s: f"(SELECT {k}, count(*)::DOUBLE AS n{s}, avg(fwd_return) AS m{s}, var_samp(fwd_return) AS v{s} FROM {t} GROUP BY {k} HAVING count(*) >= 5)"
    return f"(SELECT {keys}, ma - mb AS mean_diff, (ma - mb) / sqrt(va / na + vb / nb) AS t_stat, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS dof, (ma - mb) / sqrt((va + vb) / 2) AS cohens_d FROM {part(a, keys, 'a')} JOIN {part(b, on, 'b')} USING ({on}))"


query("welch", "trades base", f"SELECT signal, {H}, {rs('mean_diff', 't_stat', 'dof', 'cohens_d')} FROM " + welch("trades", "base", "signal, holding_period", "holding_period"))


def matched(trades: str, pools: str, keys: str) -> str:
    g = f"(SELECT {keys}, ticker{'' if 'direction' in keys else ', direction'}, count(*) AS c, sum(fwd_return) AS s FROM {trades} GROUP BY ALL)"
    return f"""(
  SELECT {keys}, observed_mean, nm AS null_mean, CASE WHEN v > 0 THEN sqrt(v) / n_matched END AS null_se, observed_mean - nm AS excess_return, (observed_mean - nm) / (CASE WHEN v > 0 THEN sqrt(v) / n_matched END) AS z_stat, n_matched, n_tickers FROM (
    SELECT {keys}, sum(s) / sum(c) AS observed_mean FROM {g} GROUP BY {keys}) JOIN (
    SELECT {keys}, sum(k * direction * mu) / sum(k) AS nm, sum(k * var * (n_pool - k) / (n_pool - 1)) AS v, sum(k)::BIGINT AS n_matched, count(DISTINCT ticker) AS n_tickers
    FROM (SELECT *, least(c, n_pool) AS k FROM {g} JOIN {pools} USING (ticker, holding_period)) GROUP BY {keys}) USING ({keys}))"""


query("matched_null", "trades pools", f"SELECT signal, {H}, CAST(direction AS BIGINT) AS direction, {rs('observed_mean', 'null_mean', 'null_se', 'excess_return', 'z_stat')}, n_matched, n_tickers FROM " + matched("trades", "pools", "signal, holding_period, direction"))
table("ps", "ones", "SELECT *, CASE WHEN holding_period <> 3 THEN round(exp(-abs(t_iid)), 2) END AS p FROM ones")


def bh(source: str, p: str, name: str) -> str:
    """Adjusted values by the smallest later p * m / rank, nulls apart."""
    return f"""(SELECT *, coalesce({name}_adjusted <= 0.05, false) AS {name}_reject FROM (SELECT * EXCLUDE (raw), CASE WHEN {p} IS NOT NULL THEN least(1.0, min(raw) OVER (PARTITION BY {p} IS NULL ORDER BY {p} DESC RANGE UNBOUNDED PRECEDING)) END AS {name}_adjusted FROM (
  SELECT *, {p} * count({p}) OVER (PARTITION BY {p} IS NULL) / row_number() OVER (PARTITION BY {p} IS NULL ORDER BY {p}) AS raw FROM {source})))"""


query("bh_fdr", "ps", f"SELECT signal, {H}, {rs('p', 'p_adjusted')}, p_reject FROM " + bh("ps", "p", "p"))
query("two_sided_family", "ps", f"SELECT signal, {H}, {rs('p', 'p2', 'two_adjusted')}, two_reject FROM " + bh("(SELECT *, least(1.0, 2 * least(p, 1 - p)) AS p2 FROM (SELECT * FROM ps) q)", "p2", "two"))
ORACLE["two_sided_family"] = ORACLE["two_sided_family"].replace("least(1.0, 2 * least(p, 1 - p))", "CASE WHEN p IS NOT NULL THEN least(1.0, 2 * least(p, 1 - p)) END")
query("significance_label", "ps", "SELECT label, count(*) AS n FROM (SELECT CASE WHEN p_adjusted IS NULL THEN 'insufficient_data' WHEN p_adjusted >= 0.05 THEN 'not_significant' WHEN cohens_d IS NULL THEN 'significant_unknown_effect' WHEN abs(cohens_d) < 0.1 THEN 'significant_but_negligible_effect' WHEN abs(cohens_d) < 0.3 THEN 'significant_small_effect' ELSE 'significant_meaningful_effect' END AS label FROM " + bh("ps", "p", "p") + ") GROUP BY label")

# Regimes, sectors, stocks
table("regimes", "vol", f"""
  SELECT *, CASE WHEN close > sma AND slope > 0 THEN 'bull' WHEN close < sma AND slope < 0 THEN 'bear' ELSE 'sideways' END AS trend_regime, CASE WHEN vol < 0.67 * mid THEN 'low_vol' WHEN vol > 1.5 * mid THEN 'high_vol' ELSE 'normal_vol' END AS vol_regime FROM (
    SELECT *, sma - lag(sma, 20) OVER ({T}) AS slope, CASE WHEN count(vol) OVER ({T} ROWS UNBOUNDED PRECEDING) >= 63 THEN median(vol) OVER ({T} ROWS UNBOUNDED PRECEDING) END AS mid FROM (
      SELECT *, CASE WHEN pos >= 100 THEN avg(close) OVER ({T} ROWS 199 PRECEDING) END AS sma FROM vol))""")
query("regime_labels", "regimes", f"SELECT ticker, {D}, trend_regime, vol_regime FROM regimes")
table("rnull", "regimes", f"SELECT trend_regime, vol_regime, avg(fwd) AS regime_null_long, count(*) AS n_bars FROM (SELECT *, lead(close, 10) OVER ({T}) / close - 1 AS fwd FROM regimes) WHERE fwd IS NOT NULL GROUP BY 1, 2")
query("regime_null", "rnull", f"SELECT trend_regime, vol_regime, {r('regime_null_long')}, n_bars FROM rnull")
table("tagged", "trades10 regimes rnull", "SELECT t.*, trend_regime, vol_regime, regime_null_long FROM trades10 t LEFT JOIN (SELECT ticker, date, trend_regime, vol_regime FROM regimes) r USING (ticker, date) LEFT JOIN rnull USING (trend_regime, vol_regime)")
query("regime_analysis", "tagged", f"""SELECT trend_regime, vol_regime, count(*) AS n_trades, count(DISTINCT ticker) AS n_tickers, count(*) FILTER (WHERE direction = 1) AS n_long_trades, count(*) FILTER (WHERE direction = -1) AS n_short_trades, {r('avg(fwd_return)', 'avg_return')},
  {r('avg(fwd_return) FILTER (WHERE direction = 1)', 'avg_return_long')}, {r('avg(fwd_return) FILTER (WHERE direction = -1)', 'avg_return_short')}, {r('any_value(regime_null_long)', 'regime_null_long')}, {r('avg(direction * regime_null_long)', 'matched_null_mean')}, {r('avg(fwd_return - direction * regime_null_long)', 'excess_return')} FROM tagged GROUP BY 1, 2""")
query("regime_by_signal", "tagged", f"""SELECT signal, trend_regime, CAST(d AS BIGINT) AS direction, n_trades, {r('m', 'avg_return')}, {r('d * plain', 'matched_null_mean')}, {r('m - d * plain', 'excess_return')}, {r('m - d * weighted', 'excess_return_weighted')} FROM (
  SELECT signal, trend_regime, any_value(d) AS d, sum(c)::BIGINT AS n_trades, sum(s) / sum(c) AS m, avg(z) AS plain, sum(c * z) / sum(c) AS weighted FROM (SELECT signal, trend_regime, vol_regime, any_value(direction) AS d, count(*) AS c, sum(fwd_return) AS s, any_value(regime_null_long) AS z FROM tagged GROUP BY 1, 2, 3) GROUP BY 1, 2)""")
table("sectored", "trades10 sectors", "SELECT t.*, coalesce(sector, 'Unknown') AS sector FROM trades10 t LEFT JOIN sectors USING (ticker)")
table("sectored_x", "sectored pools10", "SELECT t.*, fwd_return - direction * mu AS excess FROM sectored t JOIN pools10 USING (ticker, holding_period)")
table("sector_table", "sectored sectored_x pools10", f"""
  SELECT * FROM (SELECT sector, count(*) AS n_trades, count(DISTINCT ticker) AS n_tickers, count(*) FILTER (WHERE direction = 1) AS n_long_trades, count(*) FILTER (WHERE direction = -1) AS n_short_trades, avg(fwd_return) AS avg_return,
    avg(fwd_return) FILTER (WHERE direction = 1) AS avg_return_long, avg(fwd_return) FILTER (WHERE direction = -1) AS avg_return_short FROM sectored GROUP BY 1)
  JOIN (SELECT sector, sum(null_mean * c) / sum(c) AS matched_null_mean, sum(excess_return * c) / sum(c) AS excess_return FROM {matched('sectored', 'pools10', 'sector, holding_period, direction')} JOIN (SELECT sector, direction, count(*) AS c FROM sectored GROUP BY 1, 2) USING (sector, direction) GROUP BY 1) USING (sector)
  JOIN (SELECT sector, se AS matched_null_se, z AS matched_z FROM {calendar('sectored_x', 'excess', 'sector, holding_period', ('m', 'se', 'z'))}) USING (sector)""")
query("sector_analysis", "sector_table", f"SELECT sector, n_trades, n_tickers, n_long_trades, n_short_trades, {rs('avg_return', 'avg_return_long', 'avg_return_short', 'matched_null_mean', 'excess_return', 'matched_null_se', 'matched_z')} FROM sector_table")
query("sector_power", "sector_table", f"SELECT sector, n_tickers, n_trades, {r('excess_return * 10000', 'observed_excess_bps')}, {r('m', 'mde_bps')}, m < 10 AS adequately_powered, CASE WHEN m < 10 THEN 'null result is informative' ELSE 'underpowered' END AS power_note FROM (SELECT *, (1.959963984540054 + 0.8416212335729143) * matched_null_se * 10000 AS m FROM sector_table)")
query("sector_coverage", "bars sectors", f"SELECT sector, count(*) AS n_tickers, {r('count(*) / sum(count(*)) OVER ()', 'share')} FROM (SELECT DISTINCT b.ticker, coalesce(sector, 'Unknown') AS sector FROM bars b LEFT JOIN sectors USING (ticker)) GROUP BY sector")
query("rank_stocks", "trades10 base10", f"""SELECT ticker, n_trades, {r('m', 'avg_return')}, {r('bm', 'baseline_avg_return')}, {r('m - bm', 'excess_return_vs_baseline')}, {r('t_stat', 't_vs_baseline')}, {r('cohens_d', 'effect_size_vs_baseline')}, n_trades >= 20 AS eligible
FROM (SELECT ticker, count(*) AS n_trades, avg(fwd_return) AS m FROM trades10 GROUP BY 1) LEFT JOIN (SELECT ticker, avg(fwd_return) AS bm FROM base10 GROUP BY 1 HAVING count(*) >= 15) USING (ticker) LEFT JOIN {welch('trades10', 'base10', 'ticker', 'ticker')} USING (ticker)""")
query("stability", "trades", f"SELECT ticker, {r('m', 'avg_win_rate')}, {r('s', 'win_rate_std_across_horizons')}, {r('m - s', 'stability_score')} FROM (SELECT ticker, avg(w) AS m, stddev_samp(w) AS s FROM (SELECT ticker, holding_period, avg((fwd_return > 0)::DOUBLE) AS w FROM trades GROUP BY 1, 2) GROUP BY 1)")
table("pairs", "events_", "SELECT a.ticker, a.date, a.pos, a.signal || '+' || b.signal AS signal, a.direction, 0 AS ordinal, a.close FROM events_ a JOIN events_ b ON a.ticker = b.ticker AND a.date = b.date AND a.direction = b.direction AND a.signal < b.signal")
table("combo_events", "pairs", "SELECT * FROM pairs WHERE signal IN (SELECT signal FROM pairs GROUP BY signal HAVING count(*) >= 2 ORDER BY count(*) DESC, signal LIMIT 10)")
trade_table("combo_trades", "combo_events", (10,))
query("combos", "combo_trades", f"SELECT signal, CAST(direction AS BIGINT) AS direction, count(*) AS n_trades, {r('avg(fwd_return)', 'avg_return')} FROM combo_trades GROUP BY 1, 2")
table("x4", "trades4 pools4", "SELECT * FROM " + matched("trades4", "pools4", "signal, holding_period"))
query("concept_ranking", "x4", f"SELECT signal, {H}, {rs('observed_mean', 'excess_return')}, row_number() OVER (PARTITION BY holding_period ORDER BY excess_return DESC NULLS LAST, signal) AS rank FROM x4")
query("topk_bottomk", "x4", f"SELECT signal, {H}, {r('excess_return')}, b <= 2 AS best FROM (SELECT *, row_number() OVER (PARTITION BY holding_period ORDER BY excess_return DESC, signal) AS b, row_number() OVER (PARTITION BY holding_period ORDER BY excess_return, signal) AS w FROM x4) WHERE b <= 2 OR w <= 1")
query("sign_consistency", "x4", "SELECT signal, count(*) AS n_horizons, sum(sign(excess_return))::DOUBLE AS sign_sum, abs(sum(sign(excess_return))) = sum(abs(sign(excess_return))) AS consistent FROM x4 GROUP BY signal")
query("pivot_excess", "x4", "SELECT signal, " + ", ".join(r(f"any_value(excess_return) FILTER (WHERE holding_period = {h})", f"h{h}") for h in (1, 5, 10, 20)) + " FROM x4 GROUP BY signal")
query("argmax_rows", "x4", f"SELECT {H}, arg_max(signal, row(excess_return, signal)) AS best_signal, arg_min(signal, row(excess_return, signal)) AS worst_signal FROM x4 GROUP BY holding_period")
query("missing_members", "added", "SELECT *, greatest(20 - in_index_at_sample_start - entry_date_unknown, 0) AS estimated_removed_names_missing FROM (SELECT count(*) AS current_constituents, count(added) AS with_known_entry_date, count(*) FILTER (WHERE added <= DATE '1995-01-01') AS in_index_at_sample_start, count(*) FILTER (WHERE added > DATE '1995-01-01') AS joined_during_sample, count(*) - count(added) AS entry_date_unknown FROM added)")
query("membership_coverage", "bars added", "SELECT CASE WHEN a.ticker IS NULL THEN 'absent' WHEN added IS NULL THEN 'entry_date_unknown' ELSE 'known' END AS membership, count(*) AS n_tickers, CAST(min(added) AS VARCHAR) AS first_added, CAST(max(added) AS VARCHAR) AS last_added FROM (SELECT DISTINCT ticker FROM bars) b LEFT JOIN added a ON a.ticker = b.ticker GROUP BY 1")
table("member_bars", "bars added", "SELECT b.* FROM bars b JOIN added USING (ticker) WHERE date >= added")
table("member_trades", "trades10 added", "SELECT t.* FROM trades10 t JOIN added USING (ticker) WHERE date >= added")
table("member_pools", "member_bars", f"SELECT ticker, holding_period, count(fwd) AS n_pool, avg(fwd) AS mu, var_samp(fwd) AS var FROM ({fwds((10,)).replace('FROM bars', 'FROM member_bars')}) WHERE fwd IS NOT NULL GROUP BY 1, 2 HAVING count(fwd) >= 2")
query("membership_compare", "trades10 pools10 member_trades member_pools", f"""SELECT signal, a.n_matched AS n_full, {r('a.excess_return', 'excess_full')}, b.n_matched AS n_aware, {r('b.excess_return', 'excess_aware')}, {r('(b.excess_return - a.excess_return) * 10000', 'excess_delta_bps')}, sign(a.excess_return) = sign(b.excess_return) AS sign_preserved
FROM {matched('trades10', 'pools10', 'signal, holding_period')} a FULL JOIN {matched('member_trades', 'member_pools', 'signal, holding_period')} b USING (signal)""")
sweeps = [(n, f) for n in (3, 5, 10) for f in (0.25, 0.36, 0.5)]
for i, (n, f) in enumerate(sweeps):
    table(f"sd{i}", "bars", displacement(n, f))
    table(f"se{i}", f"sd{i}", f"SELECT ticker, date, pos, '{STUDY[0]}' AS signal, 1 AS direction, 0 AS ordinal, close FROM sd{i} WHERE disp_up UNION ALL SELECT ticker, date, pos, '{STUDY[1]}', -1, 1, close FROM sd{i} WHERE disp_dn")
    trade_table(f"st{i}", f"se{i}", (10,))
table("swept", " ".join(f"st{i}" for i in range(len(sweeps))) + " pools10", " UNION ALL ".join(f"SELECT signal, n_matched AS n_trades, excess_return AS excess, {n} AS pivot_len, {f}::DOUBLE AS body_fraction FROM {matched(f'st{i}', 'pools10', 'signal, holding_period')}" for i, (n, f) in enumerate(sweeps)))
query("grid_sweep", "swept", f"SELECT signal, n_trades, {r('excess')}, CAST(pivot_len AS BIGINT) AS pivot_len, body_fraction FROM swept")
query("sweep_stability", "swept", f"""SELECT signal, n_configs, {rs('mean_excess', 'median_excess', 'std_excess', 'min_excess', 'max_excess')}, {r('greatest(p, 1 - p)', 'sign_consistency')}, {r('std_excess / nullif(abs(mean_excess), 0)', 'coefficient_of_variation')}, std_excess > 0 AS responds_to_sweep, {r('(max_excess - min_excess) * 10000', 'swept_range_bps')}
FROM (SELECT signal, count(excess) AS n_configs, avg(excess) AS mean_excess, median(excess) AS median_excess, coalesce(stddev_samp(excess), 0) AS std_excess, min(excess) AS min_excess, max(excess) AS max_excess, avg((excess > 0)::DOUBLE) AS p FROM swept GROUP BY signal)""")

# Folds
table("folds", "trades10", "SELECT * FROM (SELECT k + 1 AS fold, a + to_years(k::INT) AS train_start, a + to_years((k + 3)::INT) AS train_end, a + to_years((k + 4)::INT) AS test_end, b FROM (SELECT min(date) AS a, max(date) AS b FROM trades10), generate_series(0, 12) g(k)) WHERE test_end <= b")
table("purged", "folds", "SELECT f.*, (SELECT min(d) FROM (SELECT d FROM generate_series(train_end - INTERVAL 40 DAY, train_end - INTERVAL 1 DAY, INTERVAL 1 DAY) s(d) WHERE isodow(d) < 6 ORDER BY d DESC LIMIT 10)) AS purge FROM folds f")
for part, when, bar_when in (("train", "date >= train_start AND date < purge", "date >= train_start AND date < train_end"), ("test", "date >= train_end AND date < test_end", "date >= train_end AND date < test_end")):
    table(f"wf_t_{part}", "trades10 purged", f"SELECT fold, fold || '|' || ticker AS ticker, date, signal, direction, holding_period, fwd_return FROM trades10 JOIN purged ON {when}")
    table(f"wf_p_{part}", "bars purged", f"SELECT ticker, 10 AS holding_period, count(fwd) AS n_pool, avg(fwd) AS mu, var_samp(fwd) AS var FROM (SELECT ticker, lead(close, 10) OVER ({T}) / close - 1 AS fwd FROM (SELECT fold || '|' || ticker AS ticker, date, close FROM bars JOIN purged ON {bar_when})) WHERE fwd IS NOT NULL GROUP BY ticker HAVING count(fwd) >= 2")
    table(f"wf_{part}", f"wf_t_{part} wf_p_{part}", f"SELECT fold, signal, n_{part}, observed_mean AS mean_{part}, excess_return AS excess_{part} FROM {matched(f'wf_t_{part}', f'wf_p_{part}', 'fold, signal, holding_period')} JOIN (SELECT fold, signal, count(*) AS n_{part} FROM wf_t_{part} GROUP BY 1, 2) USING (fold, signal)")
table("wf", "wf_train wf_test", "SELECT * FROM (SELECT *, n_train >= 10 AND row_number() OVER (PARTITION BY fold, n_train >= 10 ORDER BY excess_train DESC, signal) <= 2 AS selected FROM wf_train) JOIN wf_test USING (fold, signal)")
query("walkforward_detail", "wf", f"SELECT fold::BIGINT AS fold, signal, n_train, {rs('mean_train', 'excess_train')}, selected, n_test, {rs('mean_test', 'excess_test')} FROM wf")
ranks = lambda part: ", ".join(f"rank() OVER ({part} ORDER BY {c}) + (count(*) OVER ({part + ', ' if part else 'PARTITION BY '}{c}) - 1) / 2.0 AS r{n}" for n, c in (("x", "excess_train"), ("y", "excess_test")))
query("walkforward", "wf", f"""SELECT fold::BIGINT AS fold, count(*) AS n_signals, count(*) FILTER (WHERE selected) AS n_selected, {r('avg(excess_train) FILTER (WHERE selected)', 'train_excess_selected')}, {r('avg(excess_test) FILTER (WHERE selected)', 'test_excess_selected')}, {r('avg(excess_test)', 'test_excess_all')},
  {r('avg((excess_test > 0)::DOUBLE) FILTER (WHERE selected)', 'hit_rate_selected')}, {r('CASE WHEN count(*) > 2 THEN corr(rx, ry) END', 'rank_correlation')} FROM (SELECT *, {ranks('PARTITION BY fold')} FROM wf) GROUP BY fold""")
query("spearman", "wf", f"SELECT {r('corr(rx, ry)', 'rank_correlation')}, count(*) AS n FROM (SELECT *, {ranks('')} FROM wf)")

# Sets and reports
query("return_histogram", "trades10", "SELECT CASE WHEN fwd_return < -0.9 THEN 0 WHEN fwd_return >= 0.9 THEN 61 ELSE floor((fwd_return + 0.9) / 1.8 * 60) + 1 END::BIGINT AS bin, count(*) AS n FROM trades10 GROUP BY 1")
query("union_calendar", "bars", "SELECT count(DISTINCT date) AS n_dates, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date FROM bars")
query("intersect_calendar", "bars", f"SELECT {D} FROM ((SELECT date FROM bars WHERE ticker = 'AF' INTERSECT SELECT date FROM bars WHERE ticker = 'NO') EXCEPT SELECT date FROM bars WHERE ticker = 'RO')")
query("anti_never_fire", "events_", "SELECT signal FROM (VALUES " + ", ".join(f"('{s}')" for s in (*STUDY, "ict_ndog_gap_up", "ict_ndog_gap_down")) + ") v(signal) WHERE signal NOT IN (SELECT signal FROM events_)")
query("semi_universe", "bars sectors", "SELECT ticker, count(*) AS n_bars FROM bars WHERE ticker IN (SELECT ticker FROM sectors WHERE sector <> 'R') GROUP BY ticker")
query("sample_export", "trades10", f"SELECT ticker, {D}, signal, {r('fwd_return')} FROM (SELECT *, md5(ticker || '|' || CAST(date AS VARCHAR) || '|' || signal) AS k FROM trades10 ORDER BY k LIMIT 500)")
query("headline_facts", "trades", f"SELECT count(DISTINCT signal) AS n_signals, count(DISTINCT ticker) AS n_tickers, count(*) AS n_trades, {r(chr(39).join(('date_diff(', 'day', ', min(date), max(date)) / 365.25')), 'years')}, count(*) FILTER (WHERE fwd_return > 0) AS n_wins FROM trades")
query("stock_view", "trades", f"SELECT signal, {H}, count(*) AS n, {r('avg(fwd_return)', 'avg_return')}, {r('avg(mfe)', 'avg_mfe')} FROM trades WHERE ticker = 'AF' GROUP BY 1, holding_period")
query("concept_view", "trades10", f"SELECT year(date)::BIGINT AS year, count(*) AS n, {r('avg(fwd_return)', 'avg_return')}, {r('quantile_cont(fwd_return, 0.9)', 'p90')} FROM trades10 WHERE signal = '{STUDY[0]}' GROUP BY 1")

# Rotation of the entry calendar, offset by offset
table("cal", "bars", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM bars)")
table("rot", "bars cal trades10", f"""
  SELECT signal, o, sum(direction * fwd) AS s, count(fwd) AS n FROM (SELECT t.signal, t.ticker, t.direction, c.idx FROM trades10 t JOIN cal c USING (date) WHERE signal LIKE 'ict_fvg%') h CROSS JOIN (SELECT count(*) AS T FROM cal) x CROSS JOIN (SELECT idx AS o FROM cal) g
  JOIN (SELECT ticker, idx, fwd FROM (SELECT ticker, date, lead(close, 10) OVER ({T}) / close - 1 AS fwd FROM bars) JOIN cal USING (date) WHERE fwd IS NOT NULL) f ON f.ticker = h.ticker AND f.idx = (h.idx + g.o) % x.T GROUP BY 1, 2""")
query("rotation_exact", "rot cal", f"""
, m AS (SELECT *, s / n AS m FROM rot WHERE n > 0), ob AS (SELECT signal, m AS observed_mean FROM m WHERE o = 0)
SELECT signal, 10::BIGINT AS holding_period, {r('any_value(observed_mean)', 'observed_mean')}, {r('avg(m)', 'null_mean')}, {r('stddev_samp(m)', 'null_se')}, {r('any_value(observed_mean) - avg(m)', 'excess_vs_rotation')},
  {r('(count(*) FILTER (WHERE m >= observed_mean - 1e-12) + 1) / (count(*) + 1)', 'p_value')}, {r('(count(*) FILTER (WHERE m <= observed_mean + 1e-12) + 1) / (count(*) + 1)', 'p_value_less')}, count(*) AS n_offsets
FROM m JOIN ob USING (signal), (SELECT count(*) AS T FROM cal) WHERE o > 10 AND o < T - 11 GROUP BY signal""".lstrip())
ORACLE["rotation_exact"] = ORACLE["rotation_exact"].replace(")\n, m AS", "),\nm AS")

# Normal tails, and what rests on them


def horner(tables: tuple[tuple[float, ...], tuple[float, ...]], x: str) -> str:
    over, under = tables
    num, den = f"({over[-1]!r} * {x})", x
    for a, b in zip(over[: len(under) - 1], under[:-1], strict=True):
        num, den = f"(({num} + {a!r}) * {x})", f"(({den} + {b!r}) * {x})"
    return f"(({num} + {over[len(under) - 1]!r}) / ({den} + {under[-1]!r}))"


def upper_tail(z: str) -> str:
    """P(Z > z), x and its square being columns of their own."""
    positive = f"CASE WHEN abs(x) <= 4 THEN exp(-x * x) * {horner(ERFC, 'abs(x)')} ELSE exp(-x * x) / abs(x) * (0.5641895835477563 - {horner(TAIL, '(1.0 / (x * x))')} / (x * x)) END"
    return f"(SELECT CASE WHEN abs(x) <= 0.46875 THEN 1 - x * {horner(ERF, '(x * x)')} WHEN x < 0 THEN 2 - ({positive}) ELSE {positive} END / 2 FROM (SELECT {z} / sqrt(2) AS x))"


table("tails", "excess_s", f"SELECT *, {upper_tail('z')} AS p FROM {calendar('excess_s', 'excess', 'signal, holding_period', ('m', 'se', 'z'))}")
query("p_values", "tails", f"SELECT signal, {H}, {r('p', 'p_greater')}, {r('least(1.0, 2 * least(p, 1 - p))', 'p_both')}, {r('p_adjusted', 'greater_adjusted')}, p_reject AS greater_reject FROM " + bh("tails", "p", "p"))
query("forest_table", "excess_s", f"SELECT signal, {H}, {r('m * 10000', 'excess_bps')}, {r('(m - 1.959963984540054 * se) * 10000', 'lower_bps')}, {r('(m + 1.959963984540054 * se) * 10000', 'upper_bps')}, m - 1.959963984540054 * se > 0 OR m + 1.959963984540054 * se < 0 AS clear FROM {calendar('excess_s', 'excess', 'signal, holding_period', ('m', 'se', 'z'))}")

table("combo_x", "combo_trades pools10", "SELECT t.*, fwd_return - direction * mu AS excess FROM combo_trades t JOIN pools10 USING (ticker, holding_period)")
table("combo_ranks", "combo_trades combo_x pools10 base10", f"""
  SELECT *, p_adjusted < 2 AND p_reject AND excess > 0 AND n_trades >= 2 AS beats FROM {bh(f"""(SELECT signal, n_trades, m AS avg_return, d, sharpe, null_mean, excess, {upper_tail('zs')} AS p_srs, {upper_tail('zc')} AS p, cohens_d AS d_base FROM
    (SELECT signal, holding_period, count(*) AS n_trades, avg(fwd_return) AS m, avg(fwd_return) / stddev_samp(fwd_return) AS d, avg(fwd_return) / stddev_samp(fwd_return) * sqrt(252.0 / holding_period) AS sharpe FROM combo_trades GROUP BY 1, 2)
    LEFT JOIN (SELECT signal, null_mean, excess_return AS excess, z_stat AS zs FROM {matched('combo_trades', 'pools10', 'signal, holding_period')}) USING (signal)
    LEFT JOIN (SELECT signal, z AS zc FROM {calendar('combo_x', 'excess', 'signal, holding_period', ('m', 'se', 'z'))}) USING (signal)
    LEFT JOIN (SELECT signal, cohens_d FROM {welch('combo_trades', 'base10', 'signal, holding_period', 'holding_period')}) USING (signal))""", 'p', 'p')}""")
query("combination_ranking", "combo_ranks", f"SELECT signal AS combination, n_trades, {r('avg_return')}, {r('null_mean', 'matched_null_mean')}, {r('excess', 'excess_return_vs_matched_random')}, {r('p_srs', 'p_value_vs_matched_random_srs')}, {r('p', 'p_value_vs_matched_random')}, {r('p_adjusted', 'vs_matched_random_adjusted')}, p_reject AS vs_matched_random_reject, coalesce(beats, false) AS beats_matched_random, {r('d', 'effect_size_cohens_d')}, {r('d_base', 'effect_size_vs_baseline')} FROM combo_ranks")
query("combinations_view", "combo_ranks", f"SELECT row_number() OVER (ORDER BY sharpe DESC NULLS LAST, signal) AS place, signal AS combination, n_trades, {r('sharpe')}, coalesce(beats, false) AS beats_matched_random FROM combo_ranks")

# Views and reports
query("rankings_view", "x4", f"SELECT signal, {H}, {r('excess_return')}, row_number() OVER (ORDER BY excess_return DESC NULLS LAST, signal) AS rank FROM x4 WHERE holding_period = 10")
query("sector_bars", "sector_table", f"SELECT sector, {r('excess_return')}, excess_return > 0 AS positive, row_number() OVER (ORDER BY excess_return DESC NULLS LAST, sector) AS place FROM sector_table")
query("regime_heatmap", "tagged", "SELECT trend_regime, " + ", ".join(r(f"any_value(x) FILTER (WHERE vol_regime = '{v}')", v) for v in ("low_vol", "normal_vol", "high_vol")) + " FROM (SELECT trend_regime, vol_regime, avg(fwd_return - direction * regime_null_long) AS x FROM tagged GROUP BY 1, 2) GROUP BY 1")
ORACLE["validation_counts"] = "SELECT status, count(*) AS n_tickers FROM (SELECT ticker, status FROM (" + ORACLE["quality_report"] + ") UNION ALL SELECT 'ZZ', 'NO_DATA') GROUP BY status"
query("timeline", "events_", "SELECT signal, year(date)::BIGINT AS year, count(*) AS n_events FROM events_ GROUP BY 1, 2")
query("version_compare", "x4", f"SELECT signal, {r('a', 'now')}, {r('b', 'before')}, {r('a - b', 'change')}, sign(a) = sign(b) AS sign_preserved, CASE WHEN b IS NULL THEN 'added' WHEN a IS NULL THEN 'removed' ELSE 'in_both' END AS state FROM (SELECT signal, excess_return AS a FROM x4 WHERE holding_period = 5 AND signal <> 'ict_displacement_bullish') FULL JOIN (SELECT signal, excess_return AS b FROM x4 WHERE holding_period = 10 AND signal <> 'ict_fvg_bullish_formed') USING (signal)")
ORACLE["section_facts"] = " UNION ALL ".join(
    f"SELECT '{section}' AS section, '{fact}' AS fact, {r(f'({expr})::DOUBLE', 'value')} FROM ({ORACLE[source]})"
    for section, source, facts in (
        ("costs", "breakeven", (("n_signals", "count(*)"), ("n_positive_gross", "count(*) FILTER (WHERE breakeven_bps > 0)"), ("n_positive_excess", "count(*) FILTER (WHERE breakeven_excess_bps > 0)"), ("median_breakeven_bps", "median(breakeven_bps)"))),
        ("sectors", "sector_power", (("n_sectors", "count(*)"), ("n_powered", "count(*) FILTER (WHERE adequately_powered)"), ("largest_excess_bps", "max(abs(observed_excess_bps))"), ("smallest_mde_bps", "min(mde_bps)"))),
        ("sweeps", "sweep_stability", (("n_signals", "count(*)"), ("n_responding", "count(*) FILTER (WHERE responds_to_sweep)"), ("n_one_sign", "count(*) FILTER (WHERE sign_consistency = 1)"), ("widest_range_bps", "max(swept_range_bps)"))),
    )
    for fact, expr in facts
)
ORACLE["sector_disagreements"] = "SELECT o.ticker, coalesce(c.sector, '(absent -> Unknown)') AS curated, o.sector AS official, CASE WHEN c.sector IS NULL THEN 'missing' ELSE 'mismatch' END AS kind FROM (VALUES ('AF', 'A'), ('AO', 'B'), ('NF', 'N'), ('NO', 'N'), ('RF', 'R'), ('RO', 'R')) o(ticker, sector) LEFT JOIN (VALUES ('AF', 'A'), ('AO', 'A'), ('NF', 'N'), ('NO', 'N'), ('RF', 'R')) c(ticker, sector) USING (ticker) WHERE c.sector IS NULL OR c.sector <> o.sector"
ORACLE["repeated_assignments"] = "SELECT CAST(c_nationkey AS VARCHAR) AS ticker, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS sectors FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1"

# Baselines, random settings, faulty closes
ORACLE["baseline_event_counts"] = "SELECT signal, direction, count(*) AS n_events FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS signal, CAST({1 if c.endswith('bullish') else -1} AS BIGINT) AS direction FROM ({ORACLE[q]}) WHERE {c}" for q, names in (("ema_cross", ("baseline_ema_cross_bullish", "baseline_ema_cross_bearish")), ("rsi_reversion", ("baseline_rsi_reversion_bullish", "baseline_rsi_reversion_bearish")), ("breakout_52w", ("baseline_52w_breakout_bullish", "baseline_52w_breakout_bearish")), ("momentum_turn", ("baseline_momentum_bullish", "baseline_momentum_bearish")), ("random_entry", ("baseline_random_bullish",))) for c in names) + ") GROUP BY signal, direction"
drawn = random_grid({"pivot_len": (3, 15), "body_fraction": (0.2, 0.6)}, 6, "sweep")
for i, d in enumerate(drawn):
    table(f"rd{i}", "bars", displacement(d["pivot_len"], d["body_fraction"]))
    table(f"re{i}", f"rd{i}", f"SELECT ticker, date, pos, '{STUDY[0]}' AS signal, 1 AS direction, 0 AS ordinal, close FROM rd{i} WHERE disp_up UNION ALL SELECT ticker, date, pos, '{STUDY[1]}', -1, 1, close FROM rd{i} WHERE disp_dn")
    trade_table(f"rt{i}", f"re{i}", (10,))
query("random_sweep", " ".join(f"rt{i}" for i in range(len(drawn))) + " pools10", " UNION ALL ".join(f"SELECT signal, n_matched AS n_trades, {r('observed_mean', 'mean_return')}, {r('excess_return', 'excess')}, {d['pivot_len']}::BIGINT AS pivot_len, {r(repr(d['body_fraction']), 'body_fraction')}, {i + 1}::BIGINT AS draw FROM {matched(f'rt{i}', 'pools10', 'signal, holding_period')}" for i, d in enumerate(drawn)))
table("bad_bars", "bars", "SELECT * REPLACE (CASE WHEN pos % 31 = 0 THEN 'nan'::DOUBLE WHEN pos % 37 = 0 THEN 'infinity'::DOUBLE WHEN pos % 41 = 0 THEN -close WHEN pos % 43 = 0 THEN 0.0 ELSE close END AS close) FROM bars")
trade_table("bad_trades", "events_", (1, 5, 10), "bad_bars")
query("trades_dirty", "bad_trades", f"SELECT ticker, {D}, signal, CAST(direction AS BIGINT) AS direction, {H}, {rs('entry_price', 'exit_price', 'fwd_return', 'mfe', 'mae')} FROM bad_trades")
for unit, plural in (("week", "weekly"), ("month", "monthly")):
    query(f"{plural}_bars", "bars", f"SELECT ticker, CAST(CAST(date_trunc('{unit}', date) AS DATE) AS VARCHAR) AS {unit}, {r('arg_min(open, date)', 'open')}, {r('max(high)', 'high')}, {r('min(low)', 'low')}, {r('arg_max(close, date)', 'close')}, {r('sum(volume)', 'volume')}, count(*) AS n_bars FROM bars GROUP BY ticker, date_trunc('{unit}', date)")
