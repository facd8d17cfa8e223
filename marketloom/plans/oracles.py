"""The market queries as SQL for DuckDB, written apart from the DataFrame code."""

from __future__ import annotations

from ..functions.symbols import FOREX, QUOTES, TIMEFRAMES
from ..functions.text import NEGATIVE, POSITIVE
from ..operators.thesis import DISCLAIMER
from ..sources.schemas import ASSETS
from .queries import AS_OF, HEADLINES, LABELS, SPLIT, SYMBOLS


def _q(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def _candles(name: str, unit: str, tf: str, table: str, symbol: str, ts: str, price: str, tie: str) -> str:
    return f"""{name} AS (SELECT {symbol} AS symbol, '{tf}' AS timeframe, date_trunc('{unit}', {ts})::TIMESTAMP AS open_time, first({price} ORDER BY {ts}, {tie}) AS open,
  max({price}) AS high, min({price}) AS low, last({price} ORDER BY {ts}, {tie}) AS close, count(*)::DOUBLE AS volume FROM {table} GROUP BY 1, 2, 3)"""


def _pick(values, n: str) -> str:
    return f"[{', '.join(_q(v) for v in values)}][({n})::BIGINT % {len(values)} + 1]"


def _normal() -> str:
    fx = ", ".join(map(_q, FOREX))
    ends = lambda out: " ".join(f"WHEN suffix(c, '{q}') AND len(c) > {len(q)} THEN {out(q)}" for q in QUOTES)
    made = f"{_pick(FOREX, 'c_custkey')} || {_pick(('/', '-', '_', ''), 'c_custkey // 8')} || {_pick(QUOTES, 'c_custkey // 32')}"
    return f"""s(raw, class) AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN {made} ELSE lower({made}) END, {_pick((None, 'crypto', 'forex'), 'c_custkey')} FROM customer UNION SELECT {_pick([x[0] for x in SYMBOLS], 'c_custkey')}, {_pick([x[1] for x in SYMBOLS], 'c_custkey')} FROM customer),
na AS (SELECT *, upper(regexp_replace(raw, '[^A-Za-z0-9]', '', 'g')) AS c, regexp_split_to_array(upper(raw), '[/_-]') AS p FROM s),
nb AS (SELECT *, len(p) = 2 AND p[1] <> '' AND p[-1] <> '' AS sp, len(p) > 1 AS del, coalesce(class = 'forex', FALSE) AS fxc, len(c) = 6 AND ((substr(c, 1, 3) IN ({fx}) AND substr(c, 4, 3) IN ({fx})) OR coalesce(class = 'forex', FALSE)) AS fxp FROM na),
nc AS (SELECT *, CASE WHEN sp THEN p[1] WHEN del THEN NULL WHEN fxp THEN substr(c, 1, 3) WHEN fxc THEN NULL {ends(lambda q: f'substr(c, 1, len(c) - {len(q)})')} END AS base, CASE WHEN sp THEN p[-1] WHEN del THEN NULL WHEN fxp THEN substr(c, 4, 3) WHEN fxc THEN NULL {ends(_q)} END AS quote FROM nb),
nd AS (SELECT *, len(c) >= 6 AND quote IS NOT NULL AS ok FROM nc), normal AS (SELECT *, CASE WHEN ok THEN coalesce(class, CASE WHEN quote IN ({fx}) THEN 'forex' ELSE 'crypto' END) END AS kind FROM nd)"""


_NORMAL = _normal()
EV = _candles("ev", "hour", "1h", "events", "event_type", "ts", "value", "event_id")
EV_DAY = _candles("evd", "day", "1d", "events", "event_type", "ts", "value", "event_id")
ORD = _candles("ord", "day", "1d", "orders", "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")
WALK = (
    EV
    + """, w0 AS (SELECT *, avg(close) OVER (PARTITION BY symbol) AS mean FROM ev),
w1 AS (SELECT *, round(1000 + sum(close - mean) OVER (PARTITION BY symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING) / 37, 4) AS walk FROM w0),
w2 AS (SELECT *, coalesce(lag(walk) OVER (PARTITION BY symbol ORDER BY open_time), 1000.0) AS prior FROM w1),
walk AS (SELECT symbol, timeframe, open_time, prior AS open, round(greatest(prior, walk) + (high - low) / 400, 6) AS high, round(least(prior, walk) - (high - low) / 400, 6) AS low, walk AS close, volume FROM w2)"""
)


def _frame(source: str, limit: int | None = None) -> str:
    return f"""cut AS (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY open_time DESC) AS rk FROM {source}),
f AS (SELECT * EXCLUDE rk, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY open_time) AS t FROM cut {f"WHERE rk <= {limit}" if limit else ""})"""


_W = "(PARTITION BY symbol, timeframe ORDER BY t ROWS UNBOUNDED PRECEDING)"
_B = "(PARTITION BY symbol, timeframe ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_L20 = "(PARTITION BY symbol, timeframe ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_LAG = "OVER (PARTITION BY symbol, timeframe ORDER BY t)"


def _ew(source: str, out: str, means: dict[str, tuple[str, str, int]]) -> str:
    """CTEs for exponentially weighted means: name -> (column, a, least observations)."""
    inputs = sorted({x for x, _, _ in means.values()})
    a = ", ".join(f"count({x}) OVER {_W} AS n_{x}, max(CASE WHEN {x} IS NOT NULL THEN t END) OVER {_B} AS p_{x}" for x in inputs)
    b = ", ".join(f"CASE WHEN {x} IS NOT NULL AND p_{x} IS NOT NULL THEN pow(1 - {al}, t - p_{x}) / (pow(1 - {al}, t - p_{x}) + {al}) END AS r_{n}" for n, (x, al, _) in means.items())
    c = ", ".join(f"sum(CASE WHEN r_{n} IS NULL THEN 0 ELSE ln(r_{n}) END) OVER {_W} AS l_{n}, CASE WHEN r_{n} IS NULL THEN {x} ELSE (1 - r_{n}) * {x} END AS c_{n}" for n, (x, _, _) in means.items())
    d = ", ".join(f"CASE WHEN n_{x} >= {least} THEN exp(l_{n}) * sum(c_{n} * exp(-l_{n})) OVER {_W} END AS {n}" for n, (x, _, least) in means.items())
    drop = ", ".join([*(f"n_{x}, p_{x}" for x in inputs), *(f"r_{n}, l_{n}, c_{n}" for n in means)])
    return f"{out}1 AS (SELECT *, {a} FROM {source}), {out}2 AS (SELECT *, {b} FROM {out}1), {out}3 AS (SELECT *, {c} FROM {out}2), {out}4 AS (SELECT *, {d} FROM {out}3), {out} AS (SELECT * EXCLUDE ({drop}) FROM {out}4)"


def _moves(source: str) -> str:
    return f"""mv0 AS (SELECT *, high - lag(high) {_LAG} AS up, lag(low) {_LAG} - low AS dn, close - lag(close) {_LAG} AS st, lag(close) {_LAG} AS pc FROM {source}),
mv AS (SELECT * EXCLUDE (up, dn, st, pc), greatest(high - low, abs(high - pc), abs(low - pc)) AS true_range, CASE WHEN st IS NOT NULL THEN greatest(st, 0) END AS gain, CASE WHEN st IS NOT NULL THEN greatest(-st, 0) END AS loss,
  CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS plus_dm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS minus_dm FROM mv0)"""


_A14 = "(1/14.0::DOUBLE)"


def _strength(source: str) -> str:
    return (
        _ew(source, "sa", {"g14": ("gain", _A14, 14), "l14": ("loss", _A14, 14), "atr_14": ("true_range", _A14, 14), "p14": ("plus_dm", _A14, 14), "m14": ("minus_dm", _A14, 14)})
        + """, sb AS (SELECT *, 100 - 100 / (1 + g14 / nullif(l14, 0)) AS rsi_14, atr_14 / nullif(close, 0) AS atr_pct, 100 * p14 / nullif(atr_14, 0) AS plus_di, 100 * m14 / nullif(atr_14, 0) AS minus_di FROM sa),
sc AS (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM sb), """
        + _ew("sc", "str", {"adx_14": ("dx", _A14, 14)})
    )


def _a(n: int) -> str:
    return f"(2/{n + 1}.0::DOUBLE)"


def _macd(source: str) -> str:
    return _ew(source, "ma", {"e12": ("close", _a(12), 1), "e26": ("close", _a(26), 1)}) + ", mb AS (SELECT *, e12 - e26 AS macd_line FROM ma), " + _ew("mb", "mc", {"macd_signal": ("macd_line", _a(9), 1)}) + ", mac AS (SELECT *, macd_line - macd_signal AS macd_hist FROM mc)"


_EMAS = {f"ema_{n}": ("close", _a(n), 1) for n in (20, 50, 200)}
_AVG = f"av AS (SELECT *, CASE WHEN t >= 20 THEN avg(close) OVER {_L20} END AS sma_20, CASE WHEN t >= 20 THEN avg(volume) OVER {_L20} END AS volume_sma_20, CASE WHEN t >= 20 THEN stddev_pop(close) OVER {_L20} END AS dev FROM %s), bo AS (SELECT *, sma_20 AS bb_middle, sma_20 + 2 * dev AS bb_upper, sma_20 - 2 * dev AS bb_lower, 4 * dev / nullif(close, 0) AS bb_width FROM av)"
#: Every row with indicators, the values before it, and the regime.
_SLOPE = "(CASE WHEN n > 5 THEN coalesce((ema_50 - ema_50_before) / nullif(ema_50_before, 0) * 100, 0) ELSE 0 END)"


def _full(source: str, limit: int | None, keep_all: bool) -> str:
    n = "t" if keep_all else "count(*) OVER (PARTITION BY symbol, timeframe)"
    return f"""WITH {WALK}, {_frame(source, limit)}, {_AVG % "f"}, {_moves("bo")}, {_ew("mv", "em", _EMAS)}, {_macd("em")}, {_strength("mac")},
al0 AS (SELECT *, lag(close) {_LAG} AS prev_close, lag(low) {_LAG} AS prev_low, lag(high) {_LAG} AS prev_high, lag(ema_20) {_LAG} AS prev_ema_20, lag(ema_50, 5) {_LAG} AS ema_50_before, {n} AS n FROM str),
al1 AS (SELECT *, coalesce((ema_50 - ema_200) / nullif(ema_200, 0) * 100, 0) AS gap, {_SLOPE} AS slope FROM al0),
al2 AS (SELECT *, CASE WHEN n < 30 OR ema_50 IS NULL OR ema_200 IS NULL THEN 'insufficient_data' WHEN adx_14 >= 25 AND gap > 0 AND slope > 0 THEN 'bull_trend' WHEN adx_14 >= 25 AND gap < 0 AND slope < 0 THEN 'bear_trend'
  WHEN adx_14 < 18 AND bb_width < 0.05 THEN 'range_compression' WHEN adx_14 < 25 THEN 'range' ELSE 'transition' END AS label FROM al1),
al AS (SELECT *, CASE label WHEN 'insufficient_data' THEN 0 WHEN 'range_compression' THEN 0.65 WHEN 'range' THEN 0.58 WHEN 'transition' THEN 0.5 ELSE least(1, 0.55::DOUBLE + least(adx_14 / 100, 0.3) + least(abs(gap) / 10, 0.15)) END::DOUBLE AS confidence FROM al2)"""


ROWS = _full("walk", None, True)
SNAP = _full("walk", 300, False) + ", snap AS (SELECT * FROM al WHERE t = n AND n >= 60)"
_SETUP_OUT = "SELECT symbol, open_time, direction, round(score, 6) AS score, round(close, 6) AS trigger_price, round(stop, 6) AS stop_hint, round(target, 6) AS target_hint, reasons FROM s WHERE direction IS NOT NULL"
_MR = """CASE WHEN (label IN ('range', 'range_compression', 'transition') OR coalesce(adx_14, 0) < 25) AND close < coalesce(bb_lower, 0) AND coalesce(rsi_14, 0) <= 35 THEN 'bullish'
  WHEN (label IN ('range', 'range_compression', 'transition') OR coalesce(adx_14, 0) < 25) AND close > coalesce(bb_upper, 0) AND coalesce(rsi_14, 0) >= 65 THEN 'bearish' END"""
_MR_SCORE = "CASE direction WHEN 'bullish' THEN least(55 + (35 - coalesce(rsi_14, 0)) * 0.7, 92) WHEN 'bearish' THEN least(55 + (coalesce(rsi_14, 0) - 65) * 0.7, 92) END"
_SCORES = """50.0::DOUBLE + CASE WHEN ema_50 > ema_200 THEN 10 WHEN ema_50 < ema_200 THEN -10 ELSE 0 END + least(coalesce(adx_14, 0), 40) * 0.5 + CASE WHEN label IN ('bull_trend', 'bear_trend') THEN 10 WHEN label IN ('range', 'range_compression') THEN -5 ELSE 0 END AS trend,
  50.0::DOUBLE + CASE WHEN coalesce(rsi_14, 0) BETWEEN 45 AND 60 THEN 12 WHEN coalesce(rsi_14, 0) < 30 OR rsi_14 > 70 THEN -8 ELSE 0 END + CASE WHEN macd_hist > 0 THEN 1 ELSE -1 END * least(abs(coalesce(macd_hist, 0)) * 300, 15) AS momentum,
  50.0::DOUBLE + CASE WHEN coalesce(atr_pct, 0) BETWEEN 0.003 AND 0.03 THEN 15 WHEN atr_pct > 0.05 THEN -15 ELSE -5 END + CASE WHEN coalesce(bb_width, 0) BETWEEN 0.02 AND 0.12 THEN 10 WHEN bb_width > 0.2 THEN -10 ELSE 0 END AS volatility"""


def _clamped(x: str) -> str:
    return f"round(greatest(0, least(100, {x})), 2)"


_SCORE_OUT = f"{_clamped('trend')} AS trend_score, {_clamped('momentum')} AS momentum_score, {_clamped('volatility')} AS volatility_score"


def _levels(limit: int) -> str:
    """Supports and resistances by a recursion over sorted swing points."""
    return f"""sw AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS cnt, max(high) OVER a AS mx, min(low) OVER a AS mn FROM f WINDOW a AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
cand AS (SELECT symbol, 'resistances' AS side, high AS x FROM sw WHERE t > 3 AND t <= cnt - 3 AND high = mx UNION ALL SELECT symbol, 'supports', low FROM sw WHERE t > 3 AND t <= cnt - 3 AND low = mn),
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY x) AS k FROM cand),
grow AS (SELECT symbol, side, k, x AS total, 1 AS touches, 1 AS cluster FROM ranked WHERE k = 1 UNION ALL
  SELECT r.symbol, r.side, r.k, CASE WHEN abs(r.x - g.total / g.touches) / (g.total / g.touches) <= 0.003 THEN g.total + r.x ELSE r.x END, CASE WHEN abs(r.x - g.total / g.touches) / (g.total / g.touches) <= 0.003 THEN g.touches + 1 ELSE 1 END,
    CASE WHEN abs(r.x - g.total / g.touches) / (g.total / g.touches) <= 0.003 THEN g.cluster ELSE g.cluster + 1 END FROM grow g JOIN ranked r ON r.symbol = g.symbol AND r.side = g.side AND r.k = g.k + 1),
clu AS (SELECT symbol, side, cluster, last(total ORDER BY k) / last(touches ORDER BY k) AS price, last(touches ORDER BY k) AS touches FROM grow GROUP BY ALL),
fin AS (SELECT symbol, last(close ORDER BY t) AS last_close FROM f GROUP BY symbol),
near AS (SELECT clu.*, last_close, row_number() OVER (PARTITION BY symbol, side ORDER BY abs(price - last_close)) - 1 AS pos FROM clu JOIN fin USING (symbol) WHERE CASE side WHEN 'supports' THEN price < last_close ELSE price > last_close END),
lev AS (SELECT symbol, side, pos, round(price, 8) AS level, touches, round((price - last_close) / last_close * 100, 4) AS distance_pct FROM near WHERE pos < 5)"""


_WITH_LEVELS = SNAP.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _levels(300) + ", lv AS (SELECT symbol, max(CASE WHEN side = 'supports' AND pos = 0 THEN level END) AS support, max(CASE WHEN side = 'resistances' AND pos = 0 THEN level END) AS resistance, count(*) FILTER (side = 'supports') AS n_supports, count(*) FILTER (side = 'resistances') AS n_resistances FROM lev GROUP BY symbol)"
_PB = """CASE WHEN label = 'bull_trend' AND prev_low <= prev_ema_20 + 0.2 * atr AND abs(close - ema_20) <= 0.5 * atr AND close > prev_close THEN 'bullish'
  WHEN label = 'bear_trend' AND prev_high >= prev_ema_20 - 0.2 * atr AND abs(close - ema_20) <= 0.5 * atr AND close < prev_close THEN 'bearish' END"""
#: The latest row with its one possible setup: the levels lie beyond the close, so nothing breaks out of them, and a trend excludes a reversion.
_ANALYSIS = (
    _WITH_LEVELS
    + f""", an0 AS (SELECT snap.*, support, resistance, coalesce(n_supports, 0) AS n_supports, coalesce(n_resistances, 0) AS n_resistances, greatest(coalesce(atr_14, 0), 1e-9) AS atr FROM snap LEFT JOIN lv USING (symbol)),
an1 AS (SELECT *, {_PB} AS pb, {_MR} AS mr FROM an0),
an2 AS (SELECT *, coalesce(pb, mr) AS direction, CASE WHEN pb IS NOT NULL THEN 'pullback_continuation' WHEN mr IS NOT NULL THEN 'mean_reversion' END AS setup_type,
  CASE WHEN pb = 'bullish' THEN prev_low - 0.5 * atr WHEN pb = 'bearish' THEN prev_high + 0.5 * atr WHEN mr = 'bullish' THEN close * 0.99 WHEN mr = 'bearish' THEN close * 1.01 END AS stop FROM an1),
an3 AS (SELECT *, CASE WHEN pb IS NOT NULL THEN least(58 + confidence * 25, 96) WHEN mr IS NOT NULL THEN {_MR_SCORE} END AS setup_score, {_SCORES} FROM an2),
an AS (SELECT *, {_SCORE_OUT}, {_clamped("0.35 * trend + 0.25 * momentum + 0.15 * volatility + 0.25 * coalesce(setup_score, 35.0)")} AS total_score FROM an3)"""
)
_CANDS = f"""cand0 AS (SELECT event_id AS seq, event_type AS source_name, [{", ".join(_q(h[0]) for h in HEADLINES)}][event_id % {len(HEADLINES)} + 1] AS title, [{", ".join(_q(h[1]) for h in HEADLINES)}][event_id % {len(HEADLINES)} + 1] AS summary,
  'https://news.example/' || (event_id % 50)::VARCHAR AS url, ts AS published_at, [{", ".join(map(_q, LABELS))}][event_id % {len(LABELS)} + 1] AS provider_label, CASE WHEN event_id % 10 = 1 THEN 0.4::DOUBLE END AS provider_score,
  CASE WHEN event_id % 4 = 0 THEN value / 500 END AS provider_importance, CASE event_id % 3 WHEN 0 THEN ['BTC'] WHEN 1 THEN ['ETHUSDT', 'EUR'] ELSE [] END AS tickers FROM events)"""


def _plain(x: str) -> str:
    return rf"regexp_replace(regexp_replace(trim(lower({x}), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')"


def _key(source: str, title: str, ts: str) -> str:
    return f"substr(sha256({_plain(source)} || '|' || {_plain(title)} || '|' || strftime({ts}, '%Y%m%d%H')), 1, 32)"


_KEYED = _CANDS + f", keyed AS (SELECT *, {_key('source_name', 'title', 'published_at')} AS dedup_key FROM cand0), firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY seq) = 1)"


def _sent(source: str, out: str, text: str, positive=POSITIVE, negative=NEGATIVE, label: str = "provider_label", score: str = "provider_score") -> str:
    hits = lambda ts: " + ".join(f"contains(txt, {_q(t)})::INT" for t in ts)
    return f"""{out}0 AS (SELECT *, {_plain(text)} AS txt FROM {source}), {out}1 AS (SELECT *, {hits(positive)} AS up, {hits(negative)} AS dn FROM {out}0), {out}2 AS (SELECT *, (up - dn)::DOUBLE / greatest(up + dn, 1) AS own, lower({label}) AS lab FROM {out}1),
{out} AS (SELECT * EXCLUDE (txt, up, dn, own, lab), CASE WHEN lab <> '' THEN CASE WHEN contains(lab, 'bull') OR contains(lab, 'positive') THEN 'positive' WHEN contains(lab, 'bear') OR contains(lab, 'negative') THEN 'negative' ELSE 'neutral' END
  WHEN own >= 0.2 THEN 'positive' WHEN own <= -0.2 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
  CASE WHEN lab <> '' THEN coalesce(nullif({score}, 0), CASE WHEN contains(lab, 'bull') OR contains(lab, 'positive') THEN 0.25 WHEN contains(lab, 'bear') OR contains(lab, 'negative') THEN -0.25 ELSE 0 END) ELSE own END::DOUBLE AS sentiment_score FROM {out}2)"""


_ASSETS = "assets(symbol, display, base) AS (VALUES " + ", ".join(f"({_q(a[0])}, {_q(a[1])}, {_q(a[2])})" for a in ASSETS) + ")"


def _tags(source: str) -> str:
    return rf"""{_ASSETS}, tx AS (SELECT seq, tickers, regexp_replace(regexp_replace(trim(upper(title || ' ' || summary)), '\s+', ' ', 'g'), '[^A-Z0-9/]', ' ', 'g') AS txt FROM {source}),
tg AS (SELECT seq, symbol, greatest(CASE WHEN list_contains(tickers, symbol) THEN 0.95 ELSE 0 END, CASE WHEN contains(txt, symbol) OR contains(txt, replace(display, '/', '')) THEN 0.9 ELSE 0 END, CASE WHEN list_contains(tickers, base) THEN 0.82 ELSE 0 END,
  CASE WHEN regexp_matches(txt, '\b' || display || '\b') THEN 0.8 ELSE 0 END, CASE WHEN regexp_matches(txt, '\b' || base || '\b') THEN 0.6 ELSE 0 END)::DOUBLE AS relevance FROM tx CROSS JOIN assets), tagged AS (SELECT * FROM tg WHERE relevance >= 0.35)"""


_ITEMS = f"""{_KEYED}, {_sent("firsts", "sen", "title || ' ' || summary")}, {_tags("firsts")}, most AS (SELECT seq, max(relevance) AS rel FROM tagged GROUP BY seq),
items AS (SELECT sen.*, round(greatest(0, least(100, 20 + greatest(0, 25 - 1.1::DOUBLE * greatest(0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(published_at)) / 3.6e9::DOUBLE)) + least(abs(sentiment_score) * 30, 25) + least(coalesce(rel, 0) * 25, 25)
  + CASE WHEN provider_importance IS NULL THEN 8 ELSE greatest(0, least(1, provider_importance)) * 20 END)), 2) AS importance_score FROM sen LEFT JOIN most USING (seq))"""
#: All later news with some urls of their own, the items that all earlier ones have left, and what each later one meets.
_BATCH = (
    _CANDS.replace("FROM events", f"FROM events WHERE ts >= TIMESTAMP '{SPLIT}'").replace("event_id % 50", "event_id % 80")
    + _ITEMS[len(_CANDS) :]
    + f""", e0 AS (SELECT event_id AS seq, event_type AS source_name, [{", ".join(_q(h[0]) for h in HEADLINES)}][event_id % {len(HEADLINES)} + 1] AS title, ts AS published_at, 'https://news.example/' || (event_id % 50)::VARCHAR AS url, 'item ' || (event_id % 50)::VARCHAR AS id FROM events WHERE ts < TIMESTAMP '{SPLIT}'),
st AS (SELECT *, {_key("source_name", "title", "published_at")} AS dedup_key FROM e0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1),
su AS (SELECT url, min(id) AS m FROM st GROUP BY 1), sk AS (SELECT dedup_key, source_name, min(id) AS m FROM st GROUP BY 1, 2),
met AS (SELECT f.*, least(su.m, sk.m) AS hit, coalesce(least(su.m, sk.m), sha256(f.url)) AS id FROM firsts f LEFT JOIN su USING (url) LEFT JOIN sk ON sk.dedup_key = f.dedup_key AND sk.source_name = f.source_name)"""
)
_NAMED = """na AS (SELECT *, CASE symbol WHEN 'click' THEN 'BTC/USDT' WHEN 'view' THEN 'ETH/USDT' WHEN 'error' THEN 'SOL/USDC' ELSE upper(substr(symbol, 1, 3)) || '/USDT' END AS display FROM ev),
nb AS (SELECT *, replace(display, '/', '') AS normalized_symbol, split_part(display, '/', 1) AS base, split_part(display, '/', 2) AS quote FROM na), named AS (SELECT *, CASE WHEN normalized_symbol IN ('BTCUSDT', 'ETHUSDT') THEN 'a-' || normalized_symbol ELSE sha256(normalized_symbol) END AS asset_id FROM nb)"""
_NAMES = "CASE symbol WHEN 'click' THEN 'BTCUSDT' WHEN 'view' THEN 'ETHUSDT' WHEN 'error' THEN 'EURUSD' ELSE symbol END"


def _change(source: str, where: str = "TRUE", name: str = "symbol") -> str:
    return f"""rec AS (SELECT {name} AS symbol, open_time, close FROM {source} WHERE {where} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) <= 30),
chg AS (SELECT symbol, (last(close ORDER BY open_time) - first(close ORDER BY open_time)) / first(close ORDER BY open_time) * 100 AS change_pct FROM rec GROUP BY symbol HAVING count(*) >= 2 AND first(close ORDER BY open_time) <> 0)"""


_SIG = f"""{_ITEMS}, {EV}, {_change("ev", "TRUE", _NAMES)},
sig AS (SELECT i.seq AS id, t.symbol, round(change_pct, 4) AS price_change_pct_24h, (sentiment_label = 'positive' AND change_pct <= -1) OR (sentiment_label = 'negative' AND change_pct >= 1) AS is_contradiction FROM items i JOIN tagged t USING (seq) JOIN chg USING (symbol))"""


def _feed(limit: int | None, where: str = "TRUE") -> str:
    return f"""{_SIG}, page AS (SELECT * FROM items WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR AND {where} ORDER BY published_at DESC, seq {f"LIMIT {limit}" if limit else ""}),
feed AS (SELECT seq AS id, published_at, sentiment_label, importance_score, coalesce((SELECT string_agg(symbol, ',' ORDER BY symbol) FROM tagged t WHERE t.seq = page.seq), '') AS asset_symbols,
  coalesce((SELECT string_agg(symbol || ':' || is_contradiction::VARCHAR, ',' ORDER BY symbol) FROM sig WHERE sig.id = page.seq), '') AS signals FROM page)"""


_NEWS = _feed(None) + """, nc0 AS (SELECT t.symbol, page.seq, sentiment_label FROM page JOIN tagged t USING (seq) QUALIFY row_number() OVER (PARTITION BY t.symbol ORDER BY published_at DESC, page.seq) <= 20),
nc AS (SELECT symbol, count(*) FILTER (sentiment_label = 'positive') AS pos, count(*) FILTER (sentiment_label = 'negative') AS neg, count(*) AS lab,
  sum((SELECT count(*) FROM sig WHERE sig.id = nc0.seq AND is_contradiction)) AS con FROM nc0 GROUP BY symbol)"""
_THESIS = (
    _ANALYSIS
    + ", "
    + _NEWS.replace(EV + ", ", "").replace("cand0", "ncand0").replace("FROM rec", "FROM nrec").replace("rec AS", "nrec AS")
    + f""", th0 AS (SELECT an.* REPLACE ({_NAMES} AS symbol), {_NAMES} AS nm FROM an),
th1 AS (SELECT th0.* REPLACE (coalesce(th0.direction, CASE label WHEN 'bull_trend' THEN 'bullish' WHEN 'bear_trend' THEN 'bearish' ELSE 'neutral' END) AS direction), pos, neg, lab, con FROM th0 LEFT JOIN nc ON nc.symbol = nm),
th2 AS (SELECT *, list_filter(CASE WHEN pb = 'bullish' THEN ['Bull trend regime confirmed.', 'Price pulled back toward EMA20 and bounced.'] WHEN pb = 'bearish' THEN ['Bear trend regime confirmed.', 'Price pulled back toward EMA20 and rejected.']
    WHEN mr = 'bullish' THEN ['Price stretched below lower Bollinger Band.', 'RSI indicates oversold conditions.'] WHEN mr = 'bearish' THEN ['Price stretched above upper Bollinger Band.', 'RSI indicates overbought conditions.'] ELSE [] END || [
    CASE WHEN direction = 'bullish' AND label = 'bull_trend' THEN printf('Trend regime is bullish with confidence %.2f.', confidence) WHEN direction = 'bearish' AND label = 'bear_trend' THEN printf('Trend regime is bearish with confidence %.2f.', confidence) WHEN label IN ('range', 'range_compression') THEN 'Range regime supports selective mean-reversion setups.' END,
    CASE WHEN direction = 'bullish' AND ema_20 > ema_50 AND ema_50 > ema_200 THEN 'EMA alignment (20 > 50 > 200) supports upside structure.' WHEN direction = 'bearish' AND ema_20 < ema_50 AND ema_50 < ema_200 THEN 'EMA alignment (20 < 50 < 200) supports downside structure.' END,
    CASE WHEN rsi_14 IS NOT NULL THEN printf('RSI(14) at %.2f is incorporated into momentum context.', round(rsi_14, 8)) END, CASE WHEN macd_hist IS NOT NULL THEN printf('MACD histogram currently %.4f.', round(macd_hist, 8)) END,
    CASE WHEN lab IS NULL THEN NULL WHEN direction = 'bullish' AND pos > neg THEN printf('Recent news sentiment leans positive (%d positive vs %d negative items).', pos, neg) WHEN direction = 'bearish' AND neg > pos THEN printf('Recent news sentiment leans negative (%d negative vs %d positive items).', neg, pos)
      ELSE printf('Recent news sentiment is mixed (%d positive, %d negative).', pos, neg) END], lambda x: x IS NOT NULL)[1:6] AS fors,
  list_filter([CASE WHEN label IN ('range', 'range_compression', 'transition') THEN printf('Regime is %s, which can weaken directional follow-through.', label) END,
    CASE WHEN direction = 'bullish' AND rsi_14 >= 70 THEN 'RSI is in overbought territory, raising pullback risk.' WHEN direction = 'bearish' AND rsi_14 <= 30 THEN 'RSI is in oversold territory, raising squeeze risk.' END,
    CASE WHEN con > 0 THEN printf('%d recent news items show sentiment/price contradiction signals.', con::BIGINT) END,
    CASE WHEN direction = 'bullish' AND neg > 0 THEN printf('%d negative news item(s) oppose the bullish thesis.', neg) WHEN direction = 'bearish' AND pos > 0 THEN printf('%d positive news item(s) oppose the bearish thesis.', pos) END], lambda x: x IS NOT NULL)[1:6] AS against FROM th1),
th3 AS (SELECT *, len(against) AS na, greatest(10, least(84, coalesce(0.7 * total_score + 0.3 * setup_score, total_score) - 6 * len(against) - CASE WHEN label IN ('range', 'range_compression', 'transition') THEN 6 ELSE 0 END)) AS cs FROM th2),
th AS (SELECT *, CASE WHEN cs < 45 THEN 'low' WHEN cs < 70 THEN 'medium' ELSE 'high' END AS cl FROM th3)"""
)


def _runs(when: str, which: str) -> str:
    """A row per request: of the good ones those ``when``, of the odd ones ``which``."""
    return f"""WITH {EV}, r AS (SELECT *, CASE symbol WHEN 'click' THEN 'btc/usdt' WHEN 'view' THEN 'ETHUSDT' WHEN 'error' THEN 'SOL-USDC' ELSE upper(substr(symbol, 1, 3)) || '/USDT' END AS raw, row_number() OVER (PARTITION BY symbol, date_trunc('day', open_time) ORDER BY open_time) AS k FROM ev), g AS (SELECT raw || ' ' || strftime(open_time, '%Y-%m-%d') AS request_id, 'success' AS status, upper(regexp_replace(raw, '[/-]', '')) AS symbol, count(*) AS fetched, count(*) FILTER (hour(open_time) >= 12) AS inserted, count(*) FILTER (hour(open_time) = 3) AS updated, NULL::VARCHAR AS error FROM r WHERE k <= 20 AND {when} GROUP BY ALL) FROM g UNION ALL SELECT * FROM (VALUES ('fine', 'success', 'EURUSD', 1, 1, 0, NULL), ('failed 1', 'failed', 'BTCUSDT', NULL, NULL, NULL, 'not a provider: nobody'), ('failed 2', 'failed', 'BTCUSDT', NULL, NULL, NULL, 'not a timeframe: 2h'), ('failed 3', 'failed', 'EURUSD', NULL, NULL, NULL, 'Note: null'), ('failed 4', 'failed', 'EURUSD', NULL, NULL, NULL, 'no time series in the payload'), ('failed 5', 'failed', 'BTCUSDT', NULL, NULL, NULL, 'no route for crypto 1h'), ('failed 6', 'failed', 'BTCUSDT', NULL, NULL, NULL, 'not an array of rows'), ('bad 1', 'rejected', NULL, NULL, NULL, NULL, 'not a symbol: x'), ('bad 2', 'rejected', NULL, NULL, NULL, NULL, 'not a symbol: BTC/USD/T'), ('bad 3', 'rejected', NULL, NULL, NULL, NULL, 'not an asset class: stock'), ('bad 4', 'rejected', NULL, NULL, NULL, NULL, 'limit must be 1..1000')) v(request_id, status, symbol, fetched, inserted, updated, error) WHERE {which}"""


def oracle_sql() -> dict[str, str]:
    r = lambda *c: ", ".join(f"round({x}, 6) AS {x}" for x in c)
    ev_f = f"WITH {EV}, {_frame('ev')}"
    walk_f = f"WITH {WALK}, {_frame('walk')}"
    stored = f"st AS (SELECT symbol AS asset_id, open_time, open::DECIMAL(20,8) AS open, high::DECIMAL(20,8) AS high, low::DECIMAL(20,8) AS low, close::DECIMAL(20,8) AS close, volume FROM ev)"
    ups = f"WITH {EV}, {stored}, up AS (SELECT asset_id, open_time, CASE WHEN hour(open_time) = 9 THEN close + 1 ELSE close END::DOUBLE AS close, CASE WHEN hour(open_time) >= 18 THEN 'insert' WHEN hour(open_time) < 6 THEN 'kept' WHEN hour(open_time) = 9 THEN 'update' ELSE 'same' END AS action FROM st)"
    return {
        "candle_resample": f"WITH {EV} SELECT symbol, timeframe, open_time, {r('open', 'high', 'low', 'close')}, volume FROM ev",
        "candles_latest_n": f"WITH {ORD} SELECT symbol, open_time, round(close, 6) AS close FROM ord QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) <= 200",
        "candles_joined_dims": f"WITH {EV} SELECT symbol, CASE symbol WHEN 'click' THEN 'BTC/USDT' WHEN 'view' THEN 'ETH/USDT' ELSE 'EUR/USD' END AS display_symbol, CASE WHEN symbol IN ('click', 'view') THEN 'crypto' ELSE 'forex' END AS asset_class, CASE WHEN symbol IN ('click', 'view') THEN 60 ELSE 5 END::INT AS rate_limit_per_minute, open_time, round(close, 6) AS close FROM ev",
        "sma_volume_sma": f"{ev_f}, {_AVG % 'f'} SELECT symbol, open_time, {r('sma_20', 'volume_sma_20')} FROM bo",
        "bollinger": f"{ev_f}, {_AVG % 'f'} SELECT symbol, open_time, {r('bb_middle', 'bb_upper', 'bb_lower', 'bb_width')} FROM bo",
        "true_range": f"{ev_f}, {_moves('f')} SELECT symbol, open_time, {r('true_range', 'gain', 'loss')} FROM mv",
        "directional_movement": f"{ev_f}, {_moves('f')} SELECT symbol, open_time, {r('plus_dm', 'minus_dm')} FROM mv",
        "ema_20_50_200": f"WITH {ORD}, {_frame('ord')}, {_ew('f', 'em', _EMAS)} SELECT symbol, open_time, round(ema_20, 4) AS ema_20, round(ema_50, 4) AS ema_50, round(ema_200, 4) AS ema_200 FROM em",
        "macd": f"{ev_f}, {_macd('f')} SELECT symbol, open_time, {r('macd_line', 'macd_signal', 'macd_hist')} FROM mac",
        "atr_rsi": f"{ev_f}, {_moves('f')}, {_strength('mv')} SELECT symbol, open_time, {r('atr_14', 'atr_pct', 'rsi_14')} FROM str",
        "adx": f"{walk_f}, {_moves('f')}, {_strength('mv')} SELECT symbol, open_time, {r('plus_di', 'minus_di', 'adx_14')} FROM str",
        "swing_points": f"{walk_f}, sw AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS cnt, max(high) OVER a AS mx, min(low) OVER a AS mn FROM f WINDOW a AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), p AS (SELECT symbol, open_time, CASE WHEN t > 3 AND t <= cnt - 3 AND high = mx THEN high END AS swing_high, CASE WHEN t > 3 AND t <= cnt - 3 AND low = mn THEN low END AS swing_low FROM sw) SELECT * FROM p WHERE swing_high IS NOT NULL OR swing_low IS NOT NULL",
        "support_resistance": f"WITH RECURSIVE {WALK}, {_frame('walk', 300)}, {_levels(300)} SELECT symbol, side, pos, level, touches::BIGINT AS touches, distance_pct FROM lev",
        "trend_regime": f"{SNAP} SELECT symbol, label, round(confidence, 6) AS confidence, round(adx_14, 6) AS adx, round(gap, 6) AS ema_gap_pct, round(slope, 6) AS ema_slope_pct, round(bb_width, 6) AS bb_width FROM snap",
        "setups_mean_reversion": f"{ROWS}, d AS (SELECT *, {_MR} AS direction FROM al WHERE t >= 25), s AS (SELECT *, {_MR_SCORE} AS score, CASE direction WHEN 'bullish' THEN close * 0.99 ELSE close * 1.01 END AS stop, bb_middle AS target, CASE direction WHEN 'bullish' THEN 'Price stretched below lower Bollinger Band. RSI indicates oversold conditions. ' ELSE 'Price stretched above upper Bollinger Band. RSI indicates overbought conditions. ' END || 'Regime is non-trending or transitional.' AS reasons FROM d) {_SETUP_OUT}",
        "setups_pullback": f"{ROWS}, a AS (SELECT *, greatest(coalesce(atr_14, 0), 1e-9) AS atr FROM al WHERE t >= 25), d AS (SELECT *, {_PB} AS direction FROM a), s AS (SELECT *, least(58 + confidence * 25, 96) AS score, CASE direction WHEN 'bullish' THEN prev_low - 0.5 * atr ELSE prev_high + 0.5 * atr END AS stop, CASE direction WHEN 'bullish' THEN close + (close - prev_low) * 1.8 ELSE close - (prev_high - close) * 1.8 END AS target, CASE direction WHEN 'bullish' THEN 'Bull trend regime confirmed. Price pulled back toward EMA20 and bounced.' ELSE 'Bear trend regime confirmed. Price pulled back toward EMA20 and rejected.' END || ' Pullback stayed within ATR-guided bounds.' AS reasons FROM d) {_SETUP_OUT}",
        "setups_breakout_given_levels": f"{ROWS}, a AS (SELECT *, min(close) OVER b AS support, max(close) OVER b AS resistance FROM al WINDOW b AS (PARTITION BY symbol, timeframe ORDER BY t ROWS BETWEEN 21 PRECEDING AND 2 PRECEDING)), d AS (SELECT *, CASE WHEN close > resistance * 1.0025 AND prev_close <= resistance THEN 'bullish' WHEN close < support * 0.9975 AND prev_close >= support THEN 'bearish' END AS direction, coalesce(volume_sma_20, 0) > 0 AND volume > coalesce(volume_sma_20, 0) * 1.2 AS loud FROM a WHERE t >= 25), s AS (SELECT *, least(62 + greatest(0, least(20, coalesce(adx_14, 0) - 20)) + CASE WHEN loud THEN 8 ELSE 0 END, 99)::DOUBLE AS score, CASE direction WHEN 'bullish' THEN resistance ELSE support END AS stop, CASE direction WHEN 'bullish' THEN close + (close - resistance) * 1.5 ELSE close - (support - close) * 1.5 END AS target, CASE direction WHEN 'bullish' THEN 'Price closed above nearest resistance with threshold buffer. Breakout confirmation based on previous close below/at resistance. ' ELSE 'Price closed below nearest support with threshold buffer. Breakdown confirmation based on previous close above/at support. ' END || CASE WHEN loud THEN 'Volume expansion detected.' ELSE 'No strong volume expansion signal.' END AS reasons FROM d) {_SETUP_OUT}",
        "score_breakdown": f"{ROWS}, d AS (SELECT *, {_MR} AS direction FROM al WHERE t >= 60), s AS (SELECT *, coalesce({_MR_SCORE}, 35.0) AS setup, {_SCORES} FROM d) SELECT symbol, open_time, {_SCORE_OUT}, {_clamped('setup')} AS setup_score, {_clamped('0.35 * trend + 0.25 * momentum + 0.15 * volatility + 0.25 * setup')} AS total_score FROM s",
        "analyze_all": f"{_ANALYSIS} SELECT symbol, n, close, label AS regime, CASE WHEN setup_type IS NULL THEN 0 ELSE 1 END::BIGINT AS n_setups, n_supports, n_resistances, support, resistance, trend_score, momentum_score, volatility_score, total_score, {r('rsi_14', 'macd_hist', 'adx_14')} FROM an",
        "rejected_series": f"WITH {EV}, {EV_DAY}, x AS (FROM ev UNION ALL FROM evd) SELECT symbol, timeframe, least(count(*), 300) AS n FROM x GROUP BY 1, 2 HAVING count(*) < 60",
        "symbol_normalize": f"WITH {_NORMAL} SELECT raw, class, CASE WHEN ok THEN base || quote END AS normalized, CASE WHEN ok THEN base END AS base, CASE WHEN ok THEN quote END AS quote, kind AS asset_class, CASE WHEN ok THEN base || '/' || quote END AS at_ccxt FROM normal",
        "timeframe_interval": f"WITH e AS (SELECT event_id, ts, {_pick([*TIMEFRAMES, '2h'], 'event_id')} AS timeframe, {_pick([*TIMEFRAMES.values(), None], 'event_id')}::INT AS minutes FROM events) SELECT event_id, timeframe, minutes, ts + to_minutes(minutes) AS close_time FROM e",
        "news_dedup_key": "SELECT doc_id, " + _key("source", "text", "TIMESTAMP '2024-01-05 06:30:00'") + " AS dedup_key FROM documents",
        "news_batch_dedup": f"WITH {_KEYED} SELECT seq, dedup_key FROM firsts",
        "news_sentiment": f"""WITH {_CANDS}, {_sent("cand0", "sen", "title || ' ' || summary")} SELECT seq, sentiment_label, round(sentiment_score, 6) AS sentiment_score FROM sen""",
        "sentiment_lexicon": f"""WITH d AS (SELECT doc_id, text, NULL::VARCHAR AS provider_label, NULL::DOUBLE AS provider_score FROM documents), {_sent("d", "sen", "text || ' '", ("the", "der", "ion"), ("idiot", "scum", "le ", "que"))} SELECT doc_id, sentiment_label AS label, round(sentiment_score, 6) AS score FROM sen""",
        "news_tagging": f"WITH {_CANDS}, {_tags('cand0')} SELECT seq, symbol, relevance FROM tagged",
        "news_importance": f"WITH {_ITEMS} SELECT seq, importance_score FROM items",
        "news_ingest_counts": f"WITH {_ITEMS} SELECT (SELECT count(*) FROM cand0) AS fetched, (SELECT count(*) FROM cand0) - (SELECT count(*) FROM items) AS deduplicated, (SELECT count(*) FROM tagged) AS tagged_links",
        "candle_upsert": f"{ups} SELECT asset_id, open_time, CASE WHEN action = 'kept' THEN close ELSE close END AS close, action FROM up",
        "candle_upsert_counts": f"{ups} SELECT count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated FROM up",
        "news_upsert_match": f"WITH {_KEYED}, st AS (SELECT * FROM keyed WHERE published_at < TIMESTAMP '{SPLIT}'), su AS (SELECT url, min(seq) AS m FROM st GROUP BY 1), sk AS (SELECT dedup_key, source_name, min(seq) AS m FROM st GROUP BY 1, 2) SELECT k.seq, least(su.m, sk.m) AS match_id FROM keyed k LEFT JOIN su USING (url) LEFT JOIN sk ON sk.dedup_key = k.dedup_key AND sk.source_name = k.source_name WHERE k.published_at >= TIMESTAMP '{SPLIT}'",
        "news_ingest": f"WITH {_BATCH} SELECT (SELECT count(*) FROM cand0) AS fetched, (SELECT count(*) FROM cand0) - (SELECT count(*) FROM firsts) AS deduplicated, (SELECT count(DISTINCT id) FROM met WHERE hit IS NULL) AS inserted, (SELECT count(*) FROM firsts) - (SELECT count(DISTINCT id) FROM met WHERE hit IS NULL) AS updated, (SELECT count(*) FROM tagged) AS tagged_links",
        "news_items_upsert": f"""WITH {_BATCH}, tagl AS (SELECT seq, string_agg(symbol, ',' ORDER BY relevance DESC, symbol) AS tagged FROM tagged GROUP BY seq)
          SELECT m.id, 'p-7' AS provider_id, NULL AS external_id, coalesce(st.source_name, m.source_name) AS source_name, m.title, m.url, m.published_at, sentiment_label, importance_score::DOUBLE AS importance_score, m.dedup_key, m.provider_label AS label, m.provider_score AS score, replace(array_to_string(m.tickers, ','), 'EUR', 'eur') AS tickers, coalesce(tagged, '') AS tagged,
            CASE WHEN hit IS NULL THEN 'insert' ELSE 'update' END AS action FROM (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) m JOIN items i USING (seq) LEFT JOIN st ON st.id = m.id LEFT JOIN tagl ON tagl.seq = m.seq
          UNION ALL SELECT id, 'p-7', 'e-' || seq, source_name, title, url, published_at, NULL, NULL, dedup_key, NULL, NULL, NULL, NULL, 'kept' FROM st WHERE id NOT IN (SELECT id FROM met)""",
        "news_links_upsert": f"WITH {_BATCH}, l AS (SELECT id AS news_item_id, 'a-' || symbol AS asset_id, seq, relevance FROM met JOIN tagged USING (seq) UNION ALL SELECT id, 'a-EURUSD', -1, 0.11 FROM st) SELECT news_item_id, asset_id, relevance::DECIMAL(5, 2)::DOUBLE AS relevance_score FROM l QUALIFY row_number() OVER (PARTITION BY news_item_id, asset_id ORDER BY seq DESC) = 1",
        "ohlcv_ingest": _runs("TRUE", "TRUE"),
        "ohlcv_landed": _runs(f"open_time >= TIMESTAMP '{SPLIT}'", "request_id <> 'failed 1'"),
        "ohlcv_candles": f"WITH {EV}, {_NAMED}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol, date_trunc('day', open_time) ORDER BY open_time) <= 20 AS sent, hour(open_time) < 12 AS here, hour(open_time) = 3 AS off FROM named) SELECT asset_id, normalized_symbol, 'ccxt' AS code, '1h' AS timeframe, date_trunc('millisecond', open_time)::TIMESTAMP AS open_time, round(open, 4) AS open, round(close, 4) + CASE WHEN off AND NOT sent THEN 1 ELSE 0 END AS close, volume, CASE WHEN here THEN hour(open_time)::DOUBLE END AS quality_score, CASE WHEN NOT here THEN 'insert' WHEN NOT sent THEN 'kept' WHEN off THEN 'update' ELSE 'same' END AS action FROM k WHERE here OR sent UNION ALL SELECT 'a-EURUSD', 'EURUSD', 'alpha_vantage', '1d', TIMESTAMP '2025-01-01', 1.0, 2.0, NULL, NULL, 'insert'",
        "provider_mappings": f"WITH {EV}, {_NAMED} SELECT DISTINCT asset_id, 'p-1' AS provider_id, display AS provider_symbol, TRUE AS is_primary FROM named UNION ALL SELECT 'a-EURUSD', sha256('alpha_vantage'), 'EURUSD', TRUE",
        "insert_if_absent": f"WITH {_NORMAL} SELECT DISTINCT base || quote AS normalized_symbol, base || '/' || quote AS display_symbol, base || ' / ' || quote AS name FROM normal WHERE ok AND base || quote NOT IN ({', '.join(_q(x[0]) for x in ASSETS)})",
        "link_upsert": f"WITH {_CANDS}, {_tags('cand0')} SELECT seq AS news_item_id, symbol AS asset_id, CASE WHEN seq % 3 <> 1 THEN relevance ELSE 0.1 END::DOUBLE AS relevance_score FROM tagged",
        "asset_listing": f"WITH {EV}, {_NAMED} SELECT DISTINCT asset_id AS id, normalized_symbol, display AS display_symbol, base || ' / ' || quote AS name, base AS base_currency, quote AS quote_currency, CASE WHEN quote IN ({', '.join(map(_q, FOREX))}) THEN 'forex' ELSE 'crypto' END AS asset_class, TRUE AS is_active FROM named WHERE asset_id NOT LIKE 'a-%' UNION ALL SELECT 'a-' || a, a, b, c || ' / ' || d, c, d, e, TRUE FROM (VALUES " + ", ".join("(" + ", ".join(map(_q, x)) + ")" for x in ASSETS) + ") v(a, b, c, d, e)",
        "price_change_30": f"WITH {EV}, {_change('ev')} SELECT symbol, round(change_pct, 4) AS change_pct FROM chg",
        "contradiction_signals": f"WITH {_SIG} SELECT * FROM sig",
        "news_feed": f"WITH {_feed(20)} SELECT * FROM feed",
        "news_feed_symbol": f"WITH {_feed(50, 'seq IN (SELECT seq FROM tagged WHERE symbol = ' + _q('EURUSD') + ')')} SELECT * FROM feed",
        "thesis_confidence": f"{_THESIS} SELECT symbol, direction, coalesce(setup_type, 'none') AS setup_type, cl AS label, round(cs, 2) AS score, len(fors)::BIGINT AS n_for, na::BIGINT AS n_against FROM th",
        "thesis_invalidation": f"""{_THESIS} SELECT symbol, round(CASE WHEN setup_type IS NOT NULL THEN round(stop, 8) WHEN direction = 'bullish' THEN support WHEN direction = 'bearish' THEN resistance END, 6) AS level,
          CASE WHEN setup_type IS NOT NULL THEN printf('Invalidate if price closes %s %.6f.', CASE direction WHEN 'bullish' THEN 'below' ELSE 'above' END, round(stop, 6)) WHEN direction = 'bullish' AND support IS NOT NULL THEN printf('Invalidate if price loses support near %.6f.', round(support, 6))
          WHEN direction = 'bearish' AND resistance IS NOT NULL THEN printf('Invalidate if price reclaims resistance near %.6f.', round(resistance, 6)) WHEN support IS NOT NULL AND resistance IS NOT NULL THEN printf('No directional thesis until price breaks above %.6f or below %.6f.', round(resistance, 6), round(support, 6))
          ELSE 'Insufficient structure for a precise invalidation level.' END AS condition FROM th""",
        "thesis_text": f"""{_THESIS} SELECT symbol, timeframe, array_to_string(fors, ' | ') AS supporting, array_to_string(against, ' | ') AS contradicting,
          printf('%s %s: %s thesis from %s with %s confidence. View this as a conditional scenario, not a prediction, and monitor %d opposing signal(s).', symbol, timeframe, direction, coalesce(setup_type, 'no clear setup'), cl, na) AS summary, {_q(DISCLAIMER)} AS disclaimer FROM th""",
        "headline_returns": f"WITH {EV}, h AS (SELECT event_id AS seq, event_type AS symbol, ts FROM events), c AS (SELECT *, open_time + INTERVAL 1 HOUR AS close_time FROM ev) SELECT h.seq, h.symbol, a.close_time AS closed_at, b.open_time AS opened_at, round((b.open - a.close) / nullif(a.close, 0) * 100, 6) AS change_pct FROM h ASOF LEFT JOIN c a ON h.symbol = a.symbol AND h.ts >= a.close_time ASOF LEFT JOIN c b ON h.symbol = b.symbol AND h.ts + INTERVAL 1 DAY <= b.open_time",
        "headline_windows": f"WITH {EV} SELECT event_id AS seq, event_type AS symbol, count(*) AS candles, round(max(high), 6) AS highest, round(min(low), 6) AS lowest, sum(volume) AS volume FROM events JOIN ev ON symbol = event_type AND open_time BETWEEN ts - INTERVAL 6 HOUR AND ts + INTERVAL 6 HOUR GROUP BY 1, 2",
        "news_sessions": f"""WITH {_CANDS}, {_sent("cand0", "sen", "title || ' ' || summary")}, g AS (SELECT *, CASE WHEN source_name = 'click' THEN 600 ELSE 1800 END AS gap FROM sen),
          n AS (SELECT *, coalesce(epoch_us(published_at) - epoch_us(lag(published_at) OVER w) >= gap * 1000000, TRUE)::INT AS fresh FROM g WINDOW w AS (PARTITION BY source_name ORDER BY published_at, seq)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY source_name ORDER BY published_at, seq ROWS UNBOUNDED PRECEDING) AS k FROM n)
          SELECT source_name, min(published_at) AS first_at, max(published_at) AS last_at, first(seq ORDER BY published_at, seq) AS first_item, count(*) AS items, round(sum(coalesce(sentiment_score, 0)), 6) AS net_sentiment FROM i GROUP BY source_name, k""",
        "candle_cascade": f"""WITH {EV}, tf AS (SELECT event_type AS symbol, event_id, ts, value, n AS timeframe, w, time_bucket(w, ts, TIMESTAMP '2000-01-01') AS open_time FROM events, (VALUES ('4h', INTERVAL 4 HOUR), ('1d', INTERVAL 24 HOUR)) v(n, w)),
          c AS (SELECT symbol, timeframe, w, open_time, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume, count(DISTINCT date_trunc('hour', ts)) AS candles FROM tf GROUP BY 1, 2, 3, 4),
          n AS (SELECT *, coalesce(lead(open_time) OVER (PARTITION BY symbol, timeframe ORDER BY open_time), open_time + w) AS upto FROM c), g AS (SELECT *, unnest(range(0, epoch_us(upto) - epoch_us(open_time), epoch_us(TIMESTAMP '1970-01-01' + w))) AS us FROM n)
          SELECT symbol, timeframe, open_time + to_microseconds(us) AS open_time, round(CASE WHEN us > 0 THEN close ELSE open END, 6) AS open, round(CASE WHEN us > 0 THEN close ELSE high END, 6) AS high, round(CASE WHEN us > 0 THEN close ELSE low END, 6) AS low, round(close, 6) AS close, CASE WHEN us > 0 THEN 0 ELSE volume END::DOUBLE AS volume, CASE WHEN us > 0 THEN 0 ELSE candles END AS candles, us > 0 AS filled FROM g""",
        "timeframe_trends": f"""WITH {WALK}, a AS (SELECT symbol, n AS timeframe, time_bucket(w, open_time, TIMESTAMP '2000-01-01') AS b, last(close ORDER BY open_time) AS close FROM walk, (VALUES ('1h', INTERVAL 1 HOUR), ('4h', INTERVAL 4 HOUR), ('1d', INTERVAL 24 HOUR)) v(n, w) GROUP BY 1, 2, 3),
          r AS (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY b DESC) AS k FROM a), e AS (SELECT symbol, timeframe, sign(max(CASE WHEN k = 1 THEN close END) - max(CASE WHEN k = 4 THEN close END))::INT AS s FROM r GROUP BY 1, 2)
          SELECT symbol, max(CASE WHEN timeframe = '1h' THEN s END) AS trend_1h, max(CASE WHEN timeframe = '4h' THEN s END) AS trend_4h, max(CASE WHEN timeframe = '1d' THEN s END) AS trend_1d, CASE WHEN min(s) = 1 THEN 'up' WHEN max(s) = -1 THEN 'down' ELSE 'mixed' END AS alignment FROM e WHERE s IS NOT NULL GROUP BY symbol""",
        "drawdown_episodes": f"""WITH {WALK}, p AS (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING) AS peak FROM walk), g AS (SELECT *, max(CASE WHEN close >= peak THEN open_time END) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak_at FROM p)
          SELECT symbol, peak_at, round(max(peak) FILTER (close < peak), 6) AS peak, min(open_time) FILTER (close < peak) AS start_at, arg_min(open_time, (close, open_time)) FILTER (close < peak) AS trough_at, round(min(close) FILTER (close < peak), 6) AS trough, min(open_time) FILTER (close >= peak) AS recovered_at, round((min(close) FILTER (close < peak) / max(peak) FILTER (close < peak) - 1) * 100, 6) AS depth_pct, count(*) FILTER (close < peak) AS rows
          FROM g WHERE peak_at IS NOT NULL GROUP BY symbol, peak_at HAVING count(*) FILTER (close < peak) > 0""",
        "structure_breaks": f"""{walk_f}, a AS (SELECT *, lag(close) OVER w AS pc, CASE WHEN t >= 7 AND lag(high, 3) OVER w = max(high) OVER x THEN lag(high, 3) OVER w END AS sh, CASE WHEN t >= 7 AND lag(low, 3) OVER w = min(low) OVER x THEN lag(low, 3) OVER w END AS sl FROM f WINDOW w AS (PARTITION BY symbol ORDER BY t), x AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
          hs AS (SELECT symbol, t, sh AS v, lag(sh) OVER (PARTITION BY symbol ORDER BY t) AS pv FROM a WHERE sh IS NOT NULL), ls AS (SELECT symbol, t, sl AS v, lag(sl) OVER (PARTITION BY symbol ORDER BY t) AS pv FROM a WHERE sl IS NOT NULL),
          b AS (SELECT a.*, hs.v AS last_high, hs.pv AS ph, ls.v AS last_low, ls.pv AS pl FROM a ASOF LEFT JOIN hs ON a.symbol = hs.symbol AND a.t >= hs.t ASOF LEFT JOIN ls ON a.symbol = ls.symbol AND a.t >= ls.t),
          c AS (SELECT *, CASE WHEN ph IS NULL OR pl IS NULL THEN NULL WHEN last_high > ph AND last_low > pl THEN 'up' WHEN last_high < ph AND last_low < pl THEN 'down' ELSE 'mixed' END AS state, CASE WHEN close > last_high AND pc <= last_high THEN 'break_up' WHEN close < last_low AND pc >= last_low THEN 'break_down' END AS event FROM b)
          SELECT symbol, open_time, last_high, last_low, state, event, CASE WHEN event IS NOT NULL THEN coalesce(event = 'break_up' AND state = 'down' OR event = 'break_down' AND state = 'up', FALSE) END AS reversal FROM c""",
        "volatility_ranks": f"""{ev_f}, {_moves('f')}, {_strength('mv')}, v AS (SELECT symbol, t, round(atr_pct, 9) AS atr_pct FROM str), c AS (SELECT v.symbol, v.t, v.atr_pct, count(*) FILTER (p.atr_pct <= v.atr_pct) AS below, count(p.atr_pct) AS n FROM v JOIN v p ON p.symbol = v.symbol AND p.t BETWEEN v.t - 249 AND v.t GROUP BY 1, 2, 3), r AS (SELECT *, CASE WHEN atr_pct IS NOT NULL AND n >= 50 THEN below / n END AS rank_pct FROM c)
          SELECT symbol, t, atr_pct, round(rank_pct, 6) AS rank_pct, CASE WHEN rank_pct <= 0.2 THEN 'low' WHEN rank_pct >= 0.8 THEN 'high' WHEN rank_pct IS NOT NULL THEN 'normal' END AS volatility FROM r""",
        "score_bands": f"{ROWS}, d AS (SELECT *, {_MR} AS direction FROM al WHERE t >= 60), s AS (SELECT *, coalesce({_MR_SCORE}, 35.0) AS setup, {_SCORES} FROM d), o AS (SELECT symbol, open_time, {_SCORE_OUT}, {_clamped('0.35 * trend + 0.25 * momentum + 0.15 * volatility + 0.25 * setup')} AS total_score FROM s WHERE open_time::DATE BETWEEN DATE '{SPLIT[:10]}' AND DATE '{AS_OF[:10]}') SELECT symbol, count(*) AS n, {', '.join(f'round(quantile_disc({c}, {p / 100}), 2) AS {c}_p{p}' for c in ('total_score', 'trend_score') for p in (10, 50, 90))} FROM o GROUP BY symbol",
        "sketch_errors": "SELECT event_type, share::DOUBLE AS share, count(*) AS n, TRUE AS rank_within, count(DISTINCT user_id) AS users, TRUE AS distinct_within FROM events, (VALUES (0.05), (0.25), (0.5), (0.75), (0.95)) v(share) GROUP BY 1, 2",
        "payload_paths": "SELECT event_id, CASE WHEN event_id % 10 <> 3 THEN event_type END AS kind, CASE WHEN event_id % 10 <> 3 THEN json_extract(props, '$.k')::INT END AS k, CASE WHEN event_id % 10 <> 3 THEN user_id END AS user_id, NULL::BIGINT AS odd, NULL::VARCHAR AS nothing FROM events",
        "payload_damage": "SELECT event_type, count(*) AS texts, count(*) FILTER (event_id % 7 = 1) AS missing, count(*) FILTER (event_id % 7 <> 1 AND event_id % 10 = 3) AS damaged FROM events GROUP BY event_type",
        "exchange_payloads": "SELECT event_id, date_trunc('millisecond', ts)::TIMESTAMP AS open_time, date_trunc('millisecond', ts)::TIMESTAMP + INTERVAL 1 HOUR AS close_time, event_id::DOUBLE AS close, NULL::DOUBLE AS volume FROM events",
        "stream_hourly": f"WITH {EV} SELECT symbol, open_time, {r('open', 'high', 'low', 'close')}, volume FROM ev",
    }
