"""Queries that run as streams over the event files and give the closed windows."""

from __future__ import annotations

from skyledger.streaming.windows import event_stream, filtered_positions, run_to_end, sessions, windowed

CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
QUERIES = {
    "m_tumbling_window": lambda s, d: run_to_end(windowed(event_stream(s, d), "1 hour")),
    "m_sliding_window": lambda s, d: run_to_end(windowed(event_stream(s, d), "1 hour", "30 minutes")),
    "m_session_window": lambda s, d: run_to_end(sessions(event_stream(s, d), "10 minutes")),
    "m_keyed_state_filter": lambda s, d: run_to_end(filtered_positions(event_stream(s, d))),
}
SQL = {
    "m_tumbling_window": f"WITH e AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS start_s, event_type, value FROM events) SELECT start_s, event_type, count(*) AS n, round(sum(value), 6) AS total FROM e GROUP BY ALL HAVING start_s + 3600 <= epoch({CLOSED})",
    "m_sliding_window": f"WITH e AS (SELECT CAST(floor(epoch(ts) / 1800) AS BIGINT) * 1800 - o * 1800 AS start_s, event_type, value FROM events, range(2) AS r(o)) SELECT start_s, event_type, count(*) AS n, round(sum(value), 6) AS total FROM e GROUP BY ALL HAVING start_s + 3600 <= epoch({CLOSED})",
    "m_session_window": f"WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 10 MINUTE <= {CLOSED}",
}
