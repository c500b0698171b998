"""DuckDB twins of the registered queries (the correctness gate).

Each string runs on DuckDB with the data folder's tables registered as views
(events, ...). The common table expressions restate the adapter, the window
summary, the offers and the fixture ledger in SQL; money leaves as DOUBLE.
Window, interval and time-filter arithmetic is SQL's own (``time_bucket``,
``date_trunc``, intervals): nothing here calls the functions under test.
"""

from __future__ import annotations

from perkflow import config
from perkflow.plans.inputs import Params
from perkflow.sources import events_adapter as ea
from perkflow.sources import fixtures as fx

P = Params()


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ts(v) -> str:
    return f"TIMESTAMP '{v}'" if not hasattr(v, "isoformat") else f"TIMESTAMP '{v.isoformat(sep=' ')}'"


def _in(values) -> str:
    return ", ".join(_q(v) for v in values)


def tx_cte() -> str:
    game = " ".join(f"WHEN k < {cut} THEN {_q(name)}" for cut, name in ea.GAME_CUTS)
    return f"""tx AS (
  SELECT event_id AS transaction_id,
         user_id AS member_id,
         {_q(ea.MEMBER_NAME_PREFIX)} || CAST(user_id AS VARCHAR) AS member_name,
         CASE WHEN event_type IN ({_in(ea.BET_EVENT_TYPES)}) THEN 'bet'
              WHEN event_type IN ({_in(ea.WIN_EVENT_TYPES)}) THEN 'win'
              WHEN event_type IN ({_in(ea.CASHOUT_EVENT_TYPES)}) THEN 'cashout' END AS transaction_type,
         CAST(CAST(value AS DECIMAL(18,2)) * {ea.AMOUNT_FACTOR} AS DECIMAL(18,2)) AS amount,
         CASE {game} ELSE {_q(ea.GAME_REST)} END AS game_type,
         ts AS transaction_time
  FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e)"""


def summary_cte(window: str, name: str = "summary", source: str = "tx", where: str = "TRUE") -> str:
    return f"""{name} AS (
  SELECT member_id, member_name, window_start,
         window_start + INTERVAL '{window}' AS window_end,
         SUM(CASE WHEN transaction_type = 'bet' THEN amount ELSE 0 END) AS total_spend,
         SUM(CASE WHEN transaction_type = 'win' THEN amount ELSE 0 END) AS total_winnings,
         SUM(CASE WHEN transaction_type = 'win' THEN amount
                  WHEN transaction_type = 'bet' THEN -amount ELSE 0 END) AS net_amount,
         COUNT(*) AS transaction_count,
         MAX(transaction_time) AS last_transaction
  FROM (SELECT *, time_bucket(INTERVAL '{window}', transaction_time) AS window_start
        FROM {source} WHERE transaction_time IS NOT NULL AND ({where})) t
  GROUP BY member_id, member_name, window_start)"""


HOTEL_PRED = f"total_spend >= {P.hotel_threshold}"
DRINK_PRED = f"net_amount < 0 AND ABS(net_amount) >= {P.drink_threshold}"
OFFER_COLS = "member_id, member_name, total_spend, transaction_count, net_amount, last_transaction, window_start, window_end"
DRINK_COLS = ("member_id, member_name, total_spend, transaction_count, net_amount, "
              "ABS(net_amount) AS loss_amount, last_transaction, window_start, window_end")


def offers_ctes(summary: str = "summary") -> str:
    return f"""hotel AS (
  SELECT {OFFER_COLS}, {_q(config.HOTEL_REWARD_TYPE)} AS reward_type
  FROM {summary} WHERE total_spend >= {config.DEFAULT_HOTEL_THRESHOLD}),
drink AS (
  SELECT {DRINK_COLS}, {_q(config.DRINK_REWARD_TYPE)} AS reward_type
  FROM {summary} WHERE net_amount < 0 AND ABS(net_amount) >= {config.DEFAULT_DRINK_THRESHOLD})"""


def ledger_ctes() -> str:
    m = fx.ACCEPT_MODULUS
    return f"""requests AS (
  SELECT member_id, member_name, 'hotel' AS offer_type, window_end AS requested_at
  FROM hotel WHERE member_id % {m} = {fx.HOTEL_ACCEPT_REMAINDER}
  UNION ALL
  SELECT member_id, member_name, 'drink' AS offer_type, window_end AS requested_at
  FROM drink WHERE member_id % {m} = {fx.DRINK_ACCEPT_REMAINDER}),
req_rows AS (
  SELECT member_id, member_name, offer_type,
         date_trunc('second', requested_at) AS redeemed_at,
         CAST(date_trunc('second', requested_at) AS DATE) AS redemption_date
  FROM requests
  WHERE member_id IS NOT NULL AND member_name IS NOT NULL AND offer_type IS NOT NULL
    AND requested_at IS NOT NULL),
ledger AS (
  SELECT member_id, member_name, offer_type, redeemed_at, redemption_date FROM (
    SELECT *, row_number() OVER (PARTITION BY member_id, offer_type, redemption_date
                                 ORDER BY redeemed_at, member_name) AS rn
    FROM req_rows) r WHERE rn = 1)"""


def latest_cte() -> str:
    return f"""latest AS (
  SELECT member_id, member_name, 'hotel' AS offer_type, {_q(config.HOTEL_LABEL)} AS offer_display,
         total_spend AS metric_value,
         {_q(config.SPEND_LABEL_PREFIX)} || CAST(ROUND(total_spend, 2) AS VARCHAR) AS metric_label,
         window_start, window_end
  FROM (SELECT *, row_number() OVER (PARTITION BY member_id
                  ORDER BY window_end DESC, total_spend DESC, member_name DESC) AS rn FROM hotel) h
  WHERE rn = 1
  UNION ALL
  SELECT member_id, member_name, 'drink' AS offer_type, {_q(config.DRINK_LABEL)} AS offer_display,
         loss_amount AS metric_value,
         {_q(config.LOSS_LABEL_PREFIX)} || CAST(ROUND(loss_amount, 2) AS VARCHAR) AS metric_label,
         window_start, window_end
  FROM (SELECT *, row_number() OVER (PARTITION BY member_id
                  ORDER BY window_end DESC, loss_amount DESC, member_name DESC) AS rn FROM drink) d
  WHERE rn = 1)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def std(window: str = P.window) -> str:
    """tx + summary + offers + ledger."""
    return with_(tx_cte(), summary_cte(window), offers_ctes(), ledger_ctes())


SUMMARY_OUT = ("member_id, member_name, window_start, window_end, CAST(total_spend AS DOUBLE) AS total_spend, "
               "CAST(total_winnings AS DOUBLE) AS total_winnings, CAST(net_amount AS DOUBLE) AS net_amount, "
               "transaction_count, last_transaction")
HOTEL_OUT = ("member_id, member_name, CAST(total_spend AS DOUBLE) AS total_spend, transaction_count, "
             "CAST(net_amount AS DOUBLE) AS net_amount, last_transaction, window_start, window_end")
DRINK_OUT = ("member_id, member_name, CAST(total_spend AS DOUBLE) AS total_spend, transaction_count, "
             "CAST(net_amount AS DOUBLE) AS net_amount, CAST(loss_amount AS DOUBLE) AS loss_amount, "
             "last_transaction, window_start, window_end")
LATEST_OUT = ("member_id, member_name, offer_type, offer_display, CAST(metric_value AS DOUBLE) AS metric_value, "
              "metric_label, window_start, window_end")


def _bounds(p: Params) -> tuple[str, str, str]:
    """SQL of the previous interval's start, the current one's start and its end."""
    step = f"INTERVAL '{p.interval_seconds} seconds'"
    start = f"time_bucket({step}, {_ts(p.as_of)}, TIMESTAMP '1970-01-01')"
    return f"({start} - {step})", start, f"({start} + {step})"


def _lower(kind: str, p: Params) -> str | None:
    """SQL of the bound that a time filter's window ends must exceed."""
    return {"All Time": None, "Today": f"date_trunc('day', {_ts(p.as_of)})",
            "Last Hour": f"({_ts(p.as_of)} - INTERVAL '1 hour')",
            "Last 5 Minutes": f"({_ts(p.as_of)} - INTERVAL '5 minutes')"}[kind]


def _interval_sql(kind: str, which: str, p: Params = P) -> str:
    before, middle, after = _bounds(p)
    start, end = (middle, after) if which == "current" else (before, middle)
    pred = HOTEL_PRED if kind == config.HOTEL else DRINK_PRED
    loss = "" if kind == config.HOTEL else " CAST(m.loss_amount AS DOUBLE) AS loss_amount,"
    return std() + f"""
, base AS (
  SELECT {OFFER_COLS if kind == config.HOTEL else DRINK_COLS} FROM summary
  WHERE {pred} AND window_start >= {start} AND window_end <= {end}),
today_offers AS (
  SELECT DISTINCT member_id FROM ledger
  WHERE offer_type = {_q(kind)} AND redemption_date = DATE '{p.today}')
SELECT m.member_id, m.member_name, CAST(m.total_spend AS DOUBLE) AS total_spend, m.transaction_count,
       CAST(m.net_amount AS DOUBLE) AS net_amount,{loss}
       m.last_transaction, m.window_start, m.window_end,
       r.member_id IS NOT NULL AS already_redeemed
FROM base m LEFT JOIN today_offers r ON m.member_id = r.member_id
ORDER BY m.member_id, m.window_start DESC"""


def _history_sql(kind: str, last_k: bool = False, counts: bool = False, p: Params = P,
                 time_window: str = "All Time") -> str:
    before, lower = _bounds(p)[0], _lower(time_window, p)
    recent = "" if lower is None else f" AND window_end > {lower}"
    pred = HOTEL_PRED if kind == config.HOTEL else DRINK_PRED
    cols = HOTEL_OUT if kind == config.HOTEL else DRINK_OUT
    inner = OFFER_COLS if kind == config.HOTEL else DRINK_COLS
    head = with_(tx_cte(), summary_cte(P.window)) + f"""
, hist AS (SELECT {inner} FROM summary WHERE {pred} AND window_end < {before}{recent})"""
    if not last_k:
        return head + f"\nSELECT {cols} FROM hist ORDER BY window_start DESC"
    head += f""",
newest AS (SELECT DISTINCT window_start, window_end FROM hist
           ORDER BY window_start DESC, window_end DESC LIMIT {P.history_windows}),
kept AS (SELECT h.*, strftime(h.window_start, '%H:%M:%S') || ' - ' || strftime(h.window_end, '%H:%M:%S')
                AS interval_label
         FROM hist h SEMI JOIN newest n ON h.window_start = n.window_start AND h.window_end = n.window_end)"""
    if counts:
        return head + """
SELECT window_start, window_end, interval_label, COUNT(*) AS qualifying_members
FROM kept GROUP BY window_start, window_end, interval_label ORDER BY window_start DESC"""
    return head + f"\nSELECT {cols}, interval_label FROM kept ORDER BY window_start DESC, member_id"


def _filtered(kind: str, p: Params = P) -> tuple[str, str]:
    """(summary CTE, predicate of the time filter) for the analytics queries."""
    lower = _lower(kind, p)
    pred = "TRUE" if lower is None else f"window_end > {lower}"
    return with_(tx_cte(), summary_cte(P.window)), pred


def _all_members(where: str = "TRUE") -> str:
    return f"""
SELECT member_id, member_name, CAST(total_spend AS DOUBLE) AS total_spend, transaction_count,
       CAST(net_amount AS DOUBLE) AS net_amount, last_transaction,
       CASE WHEN {HOTEL_PRED} THEN {_q(config.HOTEL_LABEL)}
            WHEN {DRINK_PRED} THEN {_q(config.DRINK_LABEL)}
            ELSE {_q(config.NO_REWARD_LABEL)} END AS reward_status
FROM summary WHERE {where}
ORDER BY total_spend DESC, member_id, last_transaction"""


def _stats(where: str = "TRUE") -> str:
    return f"""
SELECT COUNT(DISTINCT member_id) AS total_members,
       CAST(SUM(total_spend) AS DOUBLE) AS total_revenue,
       CAST(SUM(transaction_count) AS BIGINT) AS total_transactions,
       CAST(SUM(total_spend) AS DOUBLE) / COUNT(total_spend) AS avg_spend_per_member,
       CAST(SUM(CASE WHEN net_amount >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS winning_members,
       CAST(SUM(CASE WHEN net_amount < 0 THEN 1 ELSE 0 END) AS BIGINT) AS losing_members
FROM summary WHERE {where}"""


def _top(where: str = "TRUE") -> str:
    return f"""
SELECT member_name, CAST(total_spend AS DOUBLE) AS total_spend, transaction_count,
       CAST(net_amount AS DOUBLE) AS net_amount
FROM summary WHERE {where}
ORDER BY summary.total_spend DESC, member_id, window_start LIMIT {P.top_k}"""


def _reward_counts(where: str = "TRUE") -> str:
    return f"""
SELECT CAST(SUM(CASE WHEN {HOTEL_PRED} THEN 1 ELSE 0 END) AS BIGINT) AS hotel_eligible,
       CAST(SUM(CASE WHEN {DRINK_PRED} THEN 1 ELSE 0 END) AS BIGINT) AS drink_eligible,
       COUNT(*) AS total
FROM summary WHERE {where}"""


def _reward_distribution(where: str = "TRUE") -> str:
    return f"""
, c AS ({_reward_counts(where)})
SELECT 'Hotel Room' AS reward, COALESCE(hotel_eligible, 0) AS reward_count FROM c
UNION ALL SELECT 'Free Drink', COALESCE(drink_eligible, 0) FROM c
UNION ALL SELECT 'No Reward', COALESCE(total, 0) - COALESCE(hotel_eligible, 0) - COALESCE(drink_eligible, 0) FROM c"""


def _win_loss(where: str = "TRUE") -> str:
    return f"""
, s AS ({_stats(where)}),
t AS (SELECT COALESCE(winning_members, 0) AS w, COALESCE(losing_members, 0) AS l FROM s)
SELECT 'Winners' AS status, w AS status_count,
       CASE WHEN w + l > 0 THEN CAST(w AS DOUBLE) * 100.0 / CAST(w + l AS DOUBLE) END AS percent FROM t
UNION ALL
SELECT 'Losers', l, CASE WHEN w + l > 0 THEN CAST(l AS DOUBLE) * 100.0 / CAST(w + l AS DOUBLE) END FROM t"""


def _qualifier_counts(p: Params = P) -> str:
    before, middle, after = _bounds(p)
    return with_(tx_cte(), summary_cte(p.window)) + f"""
SELECT COUNT(*) FILTER (WHERE {HOTEL_PRED} AND window_start >= {middle} AND window_end <= {after}) AS hotel_current,
       COUNT(*) FILTER (WHERE {HOTEL_PRED} AND window_start >= {before} AND window_end <= {middle}) AS hotel_previous,
       COUNT(*) FILTER (WHERE {DRINK_PRED} AND window_start >= {middle} AND window_end <= {after}) AS drink_current,
       COUNT(*) FILTER (WHERE {DRINK_PRED} AND window_start >= {before} AND window_end <= {middle}) AS drink_previous
FROM summary"""


def _report(where: str) -> str:
    h = config.FULFILLMENT_CSV_HEADERS
    return std() + FULFILLED + f"""
SELECT member_id AS "{h[0]}", member_name AS "{h[1]}", offer_display AS "{h[2]}",
       strftime(redeemed_at, '%Y-%m-%d %H:%M:%S') AS "{h[3]}"
FROM fulfilled WHERE {where} ORDER BY redeemed_at DESC, member_id, offer_type"""

GAME_STATS = """
SELECT game_type,
       COUNT(*) FILTER (WHERE transaction_type = 'bet') AS bet_count,
       COUNT(*) FILTER (WHERE transaction_type = 'win') AS win_count,
       CAST(SUM(CASE WHEN transaction_type = 'bet' THEN amount ELSE 0 END) AS DOUBLE) AS total_bet,
       CAST(SUM(CASE WHEN transaction_type = 'win' THEN amount ELSE 0 END) AS DOUBLE) AS total_won,
       CASE WHEN CAST(SUM(CASE WHEN transaction_type = 'bet' THEN amount ELSE 0 END) AS DOUBLE) <> 0
            THEN (CAST(SUM(CASE WHEN transaction_type = 'bet' THEN amount ELSE 0 END) AS DOUBLE)
                  - CAST(SUM(CASE WHEN transaction_type = 'win' THEN amount ELSE 0 END) AS DOUBLE))
                 / CAST(SUM(CASE WHEN transaction_type = 'bet' THEN amount ELSE 0 END) AS DOUBLE)
       END AS house_edge
FROM tx GROUP BY game_type ORDER BY house_edge DESC NULLS LAST, game_type"""


def _win_rate(by_game: bool) -> str:
    g = "game_type, " if by_game else ""
    grp = " GROUP BY game_type" if by_game else ""
    return f"""
SELECT {g}COUNT(*) FILTER (WHERE transaction_type = 'bet') AS bets,
       COUNT(*) FILTER (WHERE transaction_type = 'win') AS wins,
       CASE WHEN COUNT(*) FILTER (WHERE transaction_type = 'bet') > 0
            THEN CAST(COUNT(*) FILTER (WHERE transaction_type = 'win') AS DOUBLE)
                 / COUNT(*) FILTER (WHERE transaction_type = 'bet') END AS win_rate
FROM tx{grp}"""


LEADERBOARD = """
, totals AS (
  SELECT member_id, member_name, SUM(total_spend) AS total_spend, SUM(total_winnings) AS total_winnings,
         SUM(net_amount) AS net_amount, CAST(SUM(transaction_count) AS BIGINT) AS transaction_count,
         COUNT(*) AS active_windows, MAX(last_transaction) AS last_transaction
  FROM summary GROUP BY member_id, member_name)
SELECT member_id, member_name, CAST(total_spend AS DOUBLE) AS total_spend,
       CAST(total_winnings AS DOUBLE) AS total_winnings, CAST(net_amount AS DOUBLE) AS net_amount,
       transaction_count, active_windows, last_transaction,
       rank() OVER (ORDER BY total_spend DESC) AS spend_rank
FROM totals ORDER BY spend_rank, member_id, member_name"""

PENDING_SELECT = f"""SELECT {LATEST_OUT} FROM latest lo
WHERE NOT EXISTS (SELECT 1 FROM ledger rt WHERE rt.redemption_date = DATE '{P.today}'
                  AND rt.member_id = lo.member_id AND rt.offer_type = lo.offer_type)"""
PENDING = f"""
, {latest_cte()}
{PENDING_SELECT}
ORDER BY window_end DESC, metric_value DESC, member_id, offer_type"""

FULFILLED = f"""
, fulfilled AS (
  SELECT member_id, member_name, offer_type, redeemed_at,
         CASE WHEN offer_type = 'hotel' THEN {_q(config.HOTEL_LABEL)}
              WHEN offer_type = 'drink' THEN {_q(config.DRINK_LABEL)}
              ELSE offer_type END AS offer_display
  FROM ledger)"""


LEDGER_OUT = """SELECT member_id, member_name, offer_type, redeemed_at,
       strftime(redemption_date, '%Y-%m-%d') AS redemption_date FROM ledger"""


def _decode_sql() -> str:
    return with_(tx_cte()) + """
SELECT transaction_id, member_id, member_name, transaction_type, CAST(amount AS DOUBLE) AS amount, game_type,
       date_trunc('second', transaction_time) AS transaction_time
FROM tx"""


def build() -> dict[str, str]:
    today_sql, today_pred = _filtered("Today")
    hour_sql, hour_pred = _filtered("Last Hour")
    q = {
        "transactions": with_(tx_cte()) + """
SELECT transaction_id, member_id, member_name, transaction_type, CAST(amount AS DOUBLE) AS amount, game_type,
       transaction_time FROM tx""",
        "decode_transactions": _decode_sql(),
        "member_window_summary": with_(tx_cte(), summary_cte("5 minutes")) + f"SELECT {SUMMARY_OUT} FROM summary",
        "member_window_summary_1h": with_(tx_cte(), summary_cte("1 hour")) + f"SELECT {SUMMARY_OUT} FROM summary",
        "member_window_summary_1d": with_(tx_cte(), summary_cte("1 day")) + f"SELECT {SUMMARY_OUT} FROM summary",
        "daily_rollup": with_(tx_cte(), summary_cte("1 day")) + f"SELECT {SUMMARY_OUT} FROM summary",
        "summary_row_count": with_(tx_cte(), summary_cte(P.window)) + "SELECT COUNT(*) AS row_count FROM summary",
        "hotel_room_offers": with_(tx_cte(), summary_cte(P.window), offers_ctes())
        + f"SELECT {HOTEL_OUT}, reward_type FROM hotel",
        "drink_offers": with_(tx_cte(), summary_cte(P.window), offers_ctes())
        + f"SELECT {DRINK_OUT}, reward_type FROM drink",
        "hotel_room_offers_1d": with_(tx_cte(), summary_cte("1 day"), offers_ctes())
        + f"SELECT {HOTEL_OUT}, reward_type FROM hotel",
        "drink_offers_1d": with_(tx_cte(), summary_cte("1 day"), offers_ctes())
        + f"SELECT {DRINK_OUT}, reward_type FROM drink",
        "hotel_current": _interval_sql(config.HOTEL, "current"),
        "hotel_previous": _interval_sql(config.HOTEL, "previous"),
        "drink_current": _interval_sql(config.DRINK, "current"),
        "drink_previous": _interval_sql(config.DRINK, "previous"),
        "interval_qualifier_count": _qualifier_counts(),
        "hotel_history": _history_sql(config.HOTEL),
        "drink_history": _history_sql(config.DRINK),
        "hotel_last_windows": _history_sql(config.HOTEL, last_k=True),
        "drink_last_windows": _history_sql(config.DRINK, last_k=True),
        "hotel_history_window_counts": _history_sql(config.HOTEL, last_k=True, counts=True),
        "drink_history_window_counts": _history_sql(config.DRINK, last_k=True, counts=True),
        "all_members": with_(tx_cte(), summary_cte(P.window)) + _all_members(),
        "all_members_today": today_sql + _all_members(today_pred),
        "all_members_display": with_(tx_cte(), summary_cte(P.window)) + f"""
SELECT member_id, member_name, '$' || format('{{:,.2f}}', CAST(total_spend AS DOUBLE)) AS total_spend,
       transaction_count, '$' || format('{{:,.2f}}', CAST(net_amount AS DOUBLE)) AS net_amount, last_transaction,
       CASE WHEN {HOTEL_PRED} THEN {_q(config.HOTEL_LABEL)}
            WHEN {DRINK_PRED} THEN {_q(config.DRINK_LABEL)}
            ELSE {_q(config.NO_REWARD_LABEL)} END AS reward_status
FROM summary""",
        "top_spenders": with_(tx_cte(), summary_cte(P.window)) + _top(),
        "top_spenders_last_hour": hour_sql + _top(hour_pred),
        "overall_stats": with_(tx_cte(), summary_cte(P.window)) + _stats(),
        "overall_stats_today": today_sql + _stats(today_pred),
        "reward_eligibility_counts": with_(tx_cte(), summary_cte(P.window)) + _reward_counts(),
        "reward_eligibility_distribution": with_(tx_cte(), summary_cte(P.window)) + _reward_distribution(),
        "win_loss_distribution": with_(tx_cte(), summary_cte(P.window)) + _win_loss(),
        "game_stats": with_(tx_cte()) + GAME_STATS,
        "win_rate": with_(tx_cte()) + _win_rate(False),
        "win_rate_by_game": with_(tx_cte()) + _win_rate(True),
        "member_leaderboard": with_(tx_cte(), summary_cte(P.window)) + LEADERBOARD,
        "redeemed_ledger": std() + LEDGER_OUT,
        "redeemed_today": std() + f"SELECT DISTINCT member_id, offer_type FROM ledger WHERE redemption_date = DATE '{P.today}'",
        "latest_hotel_offer": std() + f"""
SELECT {HOTEL_OUT}, reward_type FROM (
  SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY window_end DESC, total_spend DESC,
                                member_name DESC) AS rn FROM hotel) x WHERE rn = 1""",
        "latest_drink_offer": std() + f"""
SELECT {DRINK_OUT}, reward_type FROM (
  SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY window_end DESC, loss_amount DESC,
                                member_name DESC) AS rn FROM drink) x WHERE rn = 1""",
        "latest_offers": std() + f", {latest_cte()}\nSELECT {LATEST_OUT} FROM latest",
        "pending_offers": std() + PENDING,
        "pending_offers_1d": std("1 day") + PENDING,
        "pending_counts": std() + f""", {latest_cte()}
, p AS ({PENDING_SELECT})
SELECT COUNT(*) AS total_pending, COUNT(*) FILTER (WHERE offer_type = 'hotel') AS pending_hotel,
       COUNT(*) FILTER (WHERE offer_type = 'drink') AS pending_drink FROM p""",
        "fulfilled_offers": std() + FULFILLED + "\nSELECT * FROM fulfilled ORDER BY redeemed_at DESC, member_id, offer_type",
        "fulfilled_counts": std() + FULFILLED + """
SELECT COUNT(*) AS total_fulfilled, COUNT(*) FILTER (WHERE offer_type = 'hotel') AS fulfilled_hotel,
       COUNT(*) FILTER (WHERE offer_type = 'drink') AS fulfilled_drink,
       COUNT(DISTINCT member_id) AS unique_members FROM fulfilled""",
        "fulfilled_report": _report(
            "offer_type = 'drink' AND COALESCE(regexp_matches(member_name, '(?i)member 1'), FALSE)"),
        "offer_redeemed_check": std() + f", {latest_cte()}" + f"""
, counts AS (SELECT member_id, offer_type, COUNT(*) AS redeemed_count FROM ledger
             WHERE redemption_date = DATE '{P.today}' GROUP BY member_id, offer_type)
SELECT l.member_id, l.offer_type, COALESCE(c.redeemed_count, 0) AS redeemed_count,
       COALESCE(c.redeemed_count, 0) > 0 AS already_redeemed
FROM latest l LEFT JOIN counts c ON l.member_id = c.member_id AND l.offer_type = c.offer_type""",
        "redeem_offers": std() + f", {latest_cte()}" + f"""
, rq AS (SELECT member_id, member_name, offer_type,
                date_trunc('second', {_ts(P.as_of)}) AS redeemed_at,
                CAST(date_trunc('second', {_ts(P.as_of)}) AS DATE) AS redemption_date FROM latest),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY member_id, offer_type, redemption_date
                                                      ORDER BY redeemed_at, member_name) AS rn FROM rq) x
           WHERE rn = 1)
SELECT member_id, member_name, offer_type, redeemed_at,
       strftime(redemption_date, '%Y-%m-%d') AS redemption_date FROM firsts f
WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.member_id = f.member_id AND l.offer_type = f.offer_type
                  AND l.redemption_date = f.redemption_date)""",
        "sql_over_views": with_(tx_cte(), summary_cte(P.window), offers_ctes()) + """
SELECT member_id, member_name, COUNT(*) AS offer_windows, CAST(SUM(total_spend) AS DOUBLE) AS offer_spend
FROM hotel WHERE total_spend >= 7500 GROUP BY member_id, member_name""",
    }
    return q


def build_at(p: Params) -> dict[str, str]:
    """Twins of the entries at the live dashboard's own interval and short time filters."""
    five, five_pred = _filtered("Last 5 Minutes", p)
    hour, hour_pred = _filtered("Last Hour", p)
    day, day_pred = _filtered("Today", p)
    never, never_pred = _filtered("Last 5 Minutes", EMPTY)
    q = {f"{kind}_{which}_5m": _interval_sql(kind, which, p)
         for kind in (config.HOTEL, config.DRINK) for which in ("current", "previous")}
    q |= {
        "interval_qualifier_count_5m": _qualifier_counts(p),
        "hotel_history_today": _history_sql(config.HOTEL, p=p, time_window="Today"),
        "drink_history_last_hour": _history_sql(config.DRINK, p=p, time_window="Last Hour"),
        "drink_last_windows_today": _history_sql(config.DRINK, last_k=True, p=p, time_window="Today"),
        "hotel_history_window_counts_today": _history_sql(config.HOTEL, last_k=True, counts=True, p=p,
                                                          time_window="Today"),
        "all_members_last_5_minutes": five + _all_members(five_pred),
        "overall_stats_last_5_minutes": five + _stats(five_pred),
        "top_spenders_last_5_minutes": five + _top(five_pred),
        "reward_eligibility_counts_last_hour": hour + _reward_counts(hour_pred),
        "reward_eligibility_distribution_today": day + _reward_distribution(day_pred),
        "win_loss_distribution_last_hour": hour + _win_loss(hour_pred),
        "overall_stats_empty": never + f"""
, s AS ({_stats(never_pred)})
SELECT COALESCE(total_members, 0) AS total_members, COALESCE(total_revenue, 0) AS total_revenue,
       COALESCE(total_transactions, 0) AS total_transactions,
       COALESCE(avg_spend_per_member, 0) AS avg_spend_per_member,
       COALESCE(winning_members, 0) AS winning_members, COALESCE(losing_members, 0) AS losing_members FROM s""",
        "reward_eligibility_distribution_empty": never + _reward_distribution(never_pred),
        "win_loss_distribution_empty": never + _win_loss(never_pred),
        "hotel_previous_badges": with_(f"base AS ({_interval_sql(config.HOTEL, 'previous')})") + f"""
SELECT member_id, window_start, strftime(window_start, '%H:%M:%S') AS starts_at,
       CASE WHEN already_redeemed THEN {_q(config.REDEEMED_BADGE)} ELSE {_q(config.PENDING_BADGE)} END AS badge
FROM base""",
        "interval_activity": with_(tx_cte()) + f"""
SELECT time_bucket(INTERVAL '{config.DEFAULT_INTERVAL_SECONDS} seconds', transaction_time) AS interval_start,
       COUNT(*) AS transactions FROM tx WHERE transaction_time IS NOT NULL GROUP BY 1""",
        "fulfilled_report_hotel": _report("offer_type = 'hotel'"),
        "fulfilled_report_all": _report("TRUE"),
        "fulfilled_report_literal": _report("contains(lower(member_name), lower('MEMBER 1'))"),
        "sql_over_summary": with_(tx_cte(), summary_cte(P.window)) + """
SELECT member_id, COUNT(*) AS windows, CAST(SUM(net_amount) AS DOUBLE) AS net FROM summary
GROUP BY member_id HAVING COUNT(*) >= 3""",
        "sql_over_game_stats": with_(tx_cte()) + f"""
, game_stats AS ({GAME_STATS})
SELECT game_type, house_edge FROM game_stats WHERE bet_count >= 10""",
        "sql_over_ledger": std() + """
SELECT offer_type, COUNT(*) AS redemptions, COUNT(DISTINCT member_id) AS members FROM ledger GROUP BY offer_type""",
        "sql_over_leaderboard": with_(tx_cte(), summary_cte(P.window)) + f"""
, board AS (SELECT * FROM ({LEADERBOARD.replace(", totals AS", "WITH totals AS", 1)}) x)
SELECT member_id, total_spend, spend_rank FROM board WHERE spend_rank <= 20""",
        "summary_typed": with_(tx_cte(), summary_cte(P.window)) + """
SELECT member_id, window_start, CAST(window_start AS DATE) AS window_date,
       CAST(total_spend AS DECIMAL(38,2)) AS total_spend, CAST(net_amount AS DECIMAL(38,2)) AS net_amount
FROM summary""",
        "approx_member_count": with_(tx_cte(), summary_cte(P.window)) + """
SELECT window_start, window_end, COUNT(DISTINCT member_id) AS members, TRUE AS approximation_holds
FROM summary GROUP BY window_start, window_end""",
    }
    return q


#: A clock after all events, for the queries over an empty time range.
EMPTY = Params(as_of="2031-01-01 00:00:00", today="2031-01-01")
#: A clock and interval as on the live dashboard, at which every offer tab has rows.
LIVE = Params(as_of="2024-01-04 06:17:00", today="2024-01-04", interval_seconds=config.DEFAULT_INTERVAL_SECONDS)

ORACLE_SQL = build() | build_at(LIVE)
