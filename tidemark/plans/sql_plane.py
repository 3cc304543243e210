"""DuckDB SQL for queries whose SQL is long: recurrences, segments, event detection, news rules, performance."""

from __future__ import annotations

from tidemark.plans import base, feature_plane
from tidemark.plans.feature_plane import _change, _frame, _rolling
from tidemark.plans.portfolio_plane import _CORR, _T

QUERIES: dict = {}

# --- recurrences -----------------------------------------------------------------------------
_STEPS = f"steps as (select ticker, trading_date, close, close - lag(close) {_T} as step, row_number() {_T} as n from bars)"
_SMOOTH = """smooth as (
  select ticker, trading_date, close, n, null::double as gain, null::double as loss, close as fast, close as slow, 0.0::double as signal from steps where n = 1
  union all
  select s.ticker, s.trading_date, s.close, s.n,
    case when p.gain is null then greatest(s.step, 0) else p.gain * 13 / 14 + greatest(s.step, 0) / 14 end,
    case when p.loss is null then greatest(-s.step, 0) else p.loss * 13 / 14 + greatest(-s.step, 0) / 14 end,
    p.fast * 11 / 13 + s.close * 2 / 13, p.slow * 25 / 27 + s.close * 2 / 27,
    p.signal * 8 / 10 + ((p.fast * 11 / 13 + s.close * 2 / 13) - (p.slow * 25 / 27 + s.close * 2 / 27)) * 2 / 10
  from smooth p join steps s on s.ticker = p.ticker and s.n = p.n + 1)"""
_SMOOTHED = (
    f"with recursive {base.CTE}, {_STEPS}, {_SMOOTH} select ticker, trading_date, "
    "round(case when n > 14 then case when loss = 0 then 100.0 else 100 - 100 / (1 + gain / loss) end end, 6) as rsi_14, "
    "round(fast - slow, 6) as macd, round(signal, 6) as macd_signal, round(fast - slow - signal, 6) as macd_histogram, "
    "round((fast - slow) / close, 6) as macd_pct, round(signal / close, 6) as macd_signal_pct, round((fast - slow - signal) / close, 6) as macd_histogram_pct from smooth"
)

_PARTS = {
    "w01_returns": "return_60d", "w02_momentum": "momentum_120d", "w03_volatility": "volatility_60d", "w07_true_range": "atr_pct", "w08_moving_averages": "distance_ma200",
    "w09_w11_volumes": "volume_ratio_20d", "w12_drawdowns": "max_drawdown_60d", "w16_j04_against_market": "spy_return_20d", "w17_w18_co_movement": "correlation_spy_20d, beta_20d",
}
_ESSENTIAL = "return_60d, momentum_120d, volatility_60d, rsi_14, atr_pct, distance_ma200, volume_ratio_20d, max_drawdown_60d, spy_return_20d, correlation_spy_20d, beta_20d"
#: volume ratios are rounded to 4 digits in their own query
_RATIO = feature_plane._select({"volume_ratio_20d": f"volume / ({_rolling('avg', 'volume', 20)})"})
FEATURE_ROWS = (
    f"select ticker, trading_date, history_count, has_252d_history, history_count > 252 and {' and '.join(c + ' is not null' for c in _ESSENTIAL.split(', '))} as model_eligible, {_ESSENTIAL} from ({feature_plane.ORACLES['f07_history_flags']}) "
    + " ".join(f"join (select ticker, trading_date, {columns} from ({_RATIO if name == 'w09_w11_volumes' else feature_plane.ORACLES[name]})) using (ticker, trading_date)" for name, columns in _PARTS.items())
    + f" join (select ticker, trading_date, rsi_14 from ({_SMOOTHED})) using (ticker, trading_date)"
)

# --- moves, outliers, events -----------------------------------------------------------------
_MOVES = (
    f"r as (select *, {_change('close', 1)} as r1, {_change('close', 5)} as r5, greatest(high - low, abs(high - lag(close) {_T}), abs(low - lag(close) {_T})) as tr from bars), "
    f"moves as (select ticker, trading_date, round(r1, 6) as return_1d, round(r5, 6) as return_5d, round(({_rolling('stddev_samp', 'r1', 20)}) * sqrt(252), 6) as volatility_20d, round(volume / ({_rolling('avg', 'volume', 20)}), 6) as volume_ratio_20d, round(({_rolling('avg', 'tr', 14)}) / close, 6) as atr_pct from r)"
)
_BOUNDS = {"return_1d": 0.30, "return_5d": 0.60, "volatility_20d": 1.5, "volume_ratio_20d": 10.0, "atr_pct": 0.25}
_EVENTS = f"""moved as (
  select ticker, trading_date, available_at, close / lag(close) {_T} - 1 as own, open / lag(open) {_T} - 1 as other, lag(close) {_T} as prior
  from (select *, cast(trading_date as timestamp) + interval 20 hour + case when {{summer}} then interval 4 hour else interval 5 hour end as available_at from bars)),
day as (select ticker, effective_date as trading_date, bool_or(action_type like '%split') as split, max(dividend_cash) as cash, max(available_at) as known from actions group by 1, 2),
flagged as (
  select m.*, coalesce(split, false) as split, coalesce(cash / prior >= 0.1, false) as large, coalesce(abs(other) <= 0.2 and abs(own - other) >= 0.3, false) as smooth, known
  from moved m left join day using (ticker, trading_date) where abs(own) > 0.3)"""
_SUMMER = " or ".join(f"trading_date >= date '{a}' and trading_date < date '{b}'" for a, b in (("1995-04-02", "1995-10-29"), ("1996-04-07", "1996-10-27"), ("1997-04-06", "1997-10-26"), ("1998-04-05", "1998-10-25"), ("1999-04-04", "1999-10-31"), ("2000-04-02", "2000-10-29"), ("2001-04-01", "2001-10-28")))
EVENTS = _EVENTS.format(summer=_SUMMER)

# --- segments --------------------------------------------------------------------------------
#: A session's cutoff is 00:15 or 01:15 of the next day in UTC, and nothing becomes available between both.
ACTIVE = "active as (select a.ticker, a.effective_date, a.split_factor, min(c.seq) as active_seq from actions a join calendar c on c.session >= a.effective_date and cast(c.session as timestamp) + interval 24 hour + interval 15 minute >= a.available_at where a.action_type = 'split' group by all)"
SEGMENTS = ACTIVE + ", points as (select ticker, active_seq from active union select distinct ticker, 0 from bars), segments as (select ticker, active_seq as first_seq, coalesce(lead(active_seq) over (partition by ticker order by active_seq) - 1, (select max(seq) from calendar)) as last_seq from points)"
HISTORY = SEGMENTS + ", history as (select s.ticker, first_seq, last_seq, b.trading_date, c.seq as bar_seq, b.close / coalesce((select product(split_factor) from active x where x.ticker = s.ticker and x.active_seq <= s.first_seq and x.effective_date > b.trading_date), 1.0) as p from segments s join bars b on b.ticker = s.ticker join calendar c on c.session = b.trading_date where c.seq <= s.last_seq)"

# --- news ------------------------------------------------------------------------------------
_WORDS = "regexp_extract_all(replace(lower(nfc_normalize({})), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+')"
_KINDS = {
    "earnings": ("earnings", "results", "quarter", "quarterly", "revenue"), "acquisition": ("acquisition", "acquire", "acquires", "merger", "buyout"), "product": ("launch", "launches", "launched", "unveils", "release"),
    "legal": ("lawsuit", "court", "settlement", "sues", "filed", "settled"), "analyst": ("analyst", "upgrade", "downgrade", "coverage", "rating"), "dividend": ("dividend", "distribution", "buyback"),
}
_STATES = "increase increases increased decrease decreases decreased approve approves reject rejects announce announces complete completes rumor rumour confirmed confirmation raised lowered denied no without".split()


def _common(words: str, listed) -> str:
    return f"list_sort(list_intersect({words}, {list(listed)}))"


_ARTICLES = f"""texts as (
  select doc_id as id, text, source, lang, split_part(text, chr(10), 1) as headline, substr(text, length(split_part(text, chr(10), 1)) + 2) as summary,
    1700000000 + doc_id * 600 as moment, case when doc_id % 7 = 0 then cast(make_timestamp((1700000000 + doc_id * 600) * 1000000) as date) end as event_date
  from documents where text is not null),
worded as (select *, {_WORDS.format('headline')} as head, {_WORDS.format("headline || ' ' || summary")} as words from texts),
articles as (
  select *, list_filter([{', '.join(f"case when list_has_any(words, {list(v)}) then '{k}' end" for k, v in _KINDS.items())}], lambda x: x is not null) as kinds,
    list_sort(list_distinct(list_concat(list_filter(words, lambda w: regexp_full_match(w, '\\d+|q[1-4]|20\\d\\d')),
      case when list_has_any(words, ['quarter', 'quarterly']) then list_intersect(words, ['first', 'second', 'third', 'fourth']) else [] end,
      list_intersect(words, {['january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december']})))) as numbers,
    {_common('words', ('filed', 'settled', 'announced', 'completed', 'approved', 'rejected', 'not', 'never', 'denies'))} as actions,
    {_common('words', ('iphone', 'ipad', 'watch', 'tablet', 'phone', 'processor', 'gpu'))} as objects, {_common('words', _STATES)} as states,
    list_filter(head, lambda w: w not in ('a', 'an', 'the', 'today', 'now')) as core
  from worded),
grams as (
  select id, part, gram, count(*) as n from (
    select id, 'full' as part, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) as gram from articles
    union all select id, 'head', unnest(list_concat(head, list_transform(range(1, len(head)), lambda i: head[i] || ' ' || head[i + 1]))) from articles)
  group by all),
norms as (select id, part, sqrt(sum(n * n)) as size from grams group by all),
keyed as (select id, source as k, moment from articles union all select id, sha256(text), moment from articles),
candidates as (select distinct a.id as left_id, b.id as right_id from keyed a join keyed b on a.k = b.k and a.id < b.id and abs(a.moment - b.moment) <= 172800),
dots as (select left_id, right_id, a.part, sum(a.n * b.n) as dot from candidates join grams a on a.id = left_id join grams b on b.id = right_id and b.part = a.part and b.gram = a.gram group by all),
cosines as (select left_id, right_id, max(case when part = 'full' then c end) as similarity, max(case when part = 'head' then c end) as headline from (select d.*, dot / (x.size * y.size) as c from dots d join norms x on x.id = left_id and x.part = d.part join norms y on y.id = right_id and y.part = d.part) group by all),
judged as (
  select c.left_id, c.right_id, coalesce(k.similarity, 0) as s, coalesce(k.headline, 0) as h, a.text as a_text, b.text as b_text, a.states <> b.states or a.numbers <> b.numbers or a.actions <> b.actions as moved,
    case when (len(a.kinds) > 0 and len(b.kinds) > 0 and not list_has_any(a.kinds, b.kinds)) or (len(a.numbers) > 0 and len(b.numbers) > 0 and a.numbers <> b.numbers) or a.actions <> b.actions
        or (len(a.objects) > 0 and len(b.objects) > 0 and a.objects <> b.objects) or coalesce(a.event_date <> b.event_date, false) or a.source <> b.source then 'different'
      when least(len(a.words), len(b.words)) < 6 then 'different'
      when a.words = b.words and a.head = b.head then 'exact_duplicate'
      when a.source = b.source and a.core = b.core and s >= 0.90 and h >= 0.65 then 'editorial_duplicate'
      when a.source = b.source and list_has_any(a.kinds, b.kinds) and s >= 0.55 and h >= 0.65 then 'shared_event' else 'different' end as relationship
  from candidates c join articles a on a.id = c.left_id join articles b on b.id = c.right_id left join cosines k on k.left_id = c.left_id and k.right_id = c.right_id)"""
_PAIRED = _WORDS.format("text")

# --- performance -----------------------------------------------------------------------------
_PERFORMANCE = """nav as (select ticker, trading_date as as_of, close / factor as nav from adjusted),
rows_ as (select *, nav / lag(nav) over w - 1 as r, nav / max(nav) over (partition by ticker order by as_of rows unbounded preceding) - 1 as dd from nav window w as (partition by ticker order by as_of)),
summary as (
  select ticker, count(*) as observations, last(nav order by as_of) / first(nav order by as_of) as growth, max(as_of) - min(as_of) as days, count(r) as n, avg(r) as m, stddev_samp(r) as sd, sqrt(avg(least(r, 0) * least(r, 0))) as fall, min(dd) as max_drawdown, first(as_of order by dd, as_of) as trough_date
  from rows_ group by 1),
peaks as (select s.ticker, first(as_of order by nav desc, as_of) as peak_date, max(nav) as top from rows_ r join summary s on s.ticker = r.ticker and r.as_of <= s.trough_date group by 1),
back as (select r.ticker, min(as_of) as recovery_date from rows_ r join summary s on s.ticker = r.ticker join peaks p on p.ticker = r.ticker where as_of > trough_date and nav >= top group by 1)"""

from tidemark.plans.pit_plane import _LATEST  # noqa: E402  the adjusted series


def _score(lag: int) -> str:
    scores = f"(select * from (select ticker, trading_date as decision_date, close / lag(close, {lag}) {_T} - 1 as score, lead(close) {_T} / close - 1 as actual from bars) where score is not null and actual is not null)"
    return f"select round(avg(ic), 6) as mean_ic, {lag} as lag from ({_CORR.format(scores)})"


ORACLES = {
    "w06_w13_rsi_macd": _SMOOTHED,
    "p06_feature_rows": FEATURE_ROWS,
    "q06_outliers": base.sql(" union all ".join(f"select ticker, trading_date, '{c}' as rule, {c} as \"value\" from moves where abs({c}) > {b}" for c, b in _BOUNDS.items()), _MOVES),
    "a12_health": base.sql(" union all ".join(f"select '{c}' as column, round(avg(cast({c} is null as integer)), 9) as null_share, min({c}) as least, max({c}) as most from moves" for c in _BOUNDS), _MOVES),
    "p10_detect_events": base.sql("select ticker, trading_date as event_date, case when split and (large or smooth) then 'complex_recapitalization' when large and smooth then 'complex_distribution' when smooth then 'provider_adjustment_inconsistency' when split then 'split_adjustment_inconsistency' else 'unexplained_price_discontinuity' end as event_type, case when (split and (large or smooth)) or (large and smooth) then 0.95 when smooth then 0.80 when split then 0.70 else 0.40 end as confidence, split or large or smooth as training_exclusion, greatest(available_at, known) as known_at from flagged", EVENTS),
    "j07_segments": base.sql("select ticker, cast(first_seq as integer) as first_seq, cast(last_seq as integer) as last_seq from segments", SEGMENTS),
    "p04_segment_features": base.sql("select ticker, trading_date, cast(first_seq as integer) as first_seq, round(p, 6) as split_adjusted_close, round(m, 6) as momentum_20d from (select *, p / lag(p, 20) over (partition by ticker, first_seq order by trading_date) - 1 as m from history) where bar_seq >= first_seq", HISTORY),
    "a03_history_count": base.sql(f"select ticker, cast(seq as integer) as active_seq, count(*) {_T} as history_count from bars join calendar on session = trading_date"),
    "t06_select": base.sql(f"select * from (select * from ({' union all '.join(_score(lag) for lag in (1, 5, 20))}) where mean_ic >= (select max(mean_ic) from ({' union all '.join(_score(lag) for lag in (1, 5, 20))})) - 0.01 order by lag limit 1)"),
    "f16_registry": "select day, security_id from (select distinct cast(ts as date) as day from events), (values ('s1', null), ('s2', date '2024-01-01'), ('s3', null)) r(security_id, until) where until is null or day < until",
    "x02_links": "select page_id, case when lower(scheme) in ('http', 'https') then lower(scheme) || '://' || lower(host) || path || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as link from (select *, list_sort(list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '^[^=]*=.') and not regexp_matches(lower(x), '^(utm_[^=]*|fbclid|gclid)='))) as kept from (select page_id, regexp_extract(url, '^\\s*([A-Za-z]+)://', 1) as scheme, regexp_extract(url, '://([^/?#]+)', 1) as host, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) as path, regexp_extract(url, '\\?([^#]*)', 1) as query from pages))",
    "x07_json": "select event_id, sha256(replace(props, ' ', '')) as hash from events",
    "x08_jaccard": "with w as (select doc_id, list_distinct(string_split(lower(text), ' ')) as w from documents) select a.doc_id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) as jaccard from w a join w b on b.doc_id = a.doc_id + 1",
    "x08_word_pairs": f"with t as (select doc_id, list_transform({_PAIRED}, lambda x: regexp_replace(x, '\\p{{N}}+', '0', 'g')) as w from documents where text is not null), p as (select doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as p from t) select a.doc_id, round(case when len(a.p) + len(b.p) > 0 then len(list_intersect(a.p, b.p)) / len(list_distinct(list_concat(a.p, b.p))) end, 6) as jaccard from p a join p b on b.doc_id = a.doc_id + 1",
    "s02_sessions": "select user_id, min(ts) as start, count(*) as events from (select *, sum(fresh) over (partition by user_id order by ts, event_id) as k from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as fresh from events)) group by user_id, k",
    "sc25_parse_news": "select sha256('news' || chr(0) || 'finn' || chr(0) || doc_id) as news_id, array_to_string(list_sort(list_distinct(list_filter([upper(trim(lang)), upper(trim(source))], lambda x: x is not null and x <> ''))), ',') as direct_tickers, greatest(make_timestamp((1700000000 + doc_id) * 1000000), timestamp '2023-11-14 22:20:00') as available_at from documents",
    "sc28_rebuilt_news": "select sha256('news' || chr(0) || 'finn' || chr(0) || doc_id) as news_id, array_to_string(list_sort(list_distinct(list_filter([upper(trim(lang)), upper(trim(source))], lambda x: x is not null and x <> ''))), ',') as direct_tickers, greatest(make_timestamp((1700000000 + doc_id) * 1000000), timestamp '2023-11-20 00:00:00') as available_at from documents",
    "n03_entities": f"""with {_ARTICLES.split('articles as (')[0].rstrip().rstrip(',')},
registry(entity, security, matched, until) as (values ('e1', 's1', 'src1', null), ('e1', 's1', 'The', null), ('e1', 's1', 'hat', null), ('e1', 's2', 'src2', date '2024-01-01'), ('e1', 's2', 'The', date '2024-01-01'), ('e2', 's3', 'src3', null), ('e2', 's3', 'Anan', null), ('e2', 's3', 'the', null)),
found as (
  select id, moment, 'provider_ticker' as evidence, source as matched from worded
  union select id, moment, 'explicit_ticker', unnest(list_distinct(list_concat(regexp_extract_all(headline || ' ' || summary, '\\$([A-Z][A-Z0-9.]{{0,5}})\\b', 1), regexp_extract_all(headline || ' ' || summary, '(?:NYSE|NASDAQ):\\s*([A-Z][A-Z0-9.]{{0,5}})\\b', 1)))) from worded
  union select id, moment, 'corporate_alias', alias from (select distinct id, moment, unnest(words) as w from worded) join (values ('The', 'the'), ('the', 'the'), ('hat', 'hat'), ('Anan', 'anan')) a(alias, run) on run = w),
linked as (select f.id, f.evidence, f.matched, list_sort(list_distinct(list(entity) filter (entity is not null))) as e, list_sort(list_distinct(list(security) filter (security is not null))) as s from found f left join registry r on r.matched = f.matched and (r.until is null or cast(make_timestamp(moment * 1000000) as date) < r.until) group by 1, 2, 3)
select id, evidence, matched, case when coalesce(len(e), 0) = 0 then 'unresolved' when len(e) > 1 then 'ambiguous_entity' when len(s) > 1 then 'ambiguous_security' else 'resolved' end as status, case when len(e) = 1 then e[1] end as entity_id, case when len(e) = 1 and len(s) = 1 then s[1] end as security_id from linked""",
    "n05_relationships": f"with {_ARTICLES} select left_id, right_id, relationship from judged",
    "n06_editorial_rules": f"with {_ARTICLES} select left_id, right_id, case when moved then 'different' else relationship end as relationship from judged",
    "n10_evaluation": f"with {_ARTICLES} select count(case when a_text <> b_text and relationship = 'exact_duplicate' then 1 end) as fp, count(case when a_text = b_text and relationship <> 'exact_duplicate' then 1 end) as fn from judged",
    "b11_drawdowns": base.sql("select ticker, observations, round(growth - 1, 6) as cumulative_return, round(case when days > 0 then pow(growth, 365.25 / days) - 1 end, 6) as cagr, round(case when n >= 2 then sd * sqrt(252) end, 6) as annualized_volatility, round(case when n >= 2 and sd > 1e-15 then m / sd * sqrt(252) end, 6) as sharpe, round(case when n >= 2 and fall > 1e-15 then m * 252 / (fall * sqrt(252)) end, 6) as sortino, round(max_drawdown, 6) as max_drawdown, trough_date, peak_date, recovery_date from summary join peaks using (ticker) left join back using (ticker)", _LATEST + ", " + _PERFORMANCE),
}
