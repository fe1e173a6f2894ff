"""The derived inputs as SQL, one CTE each; ``with_views`` adds those a query needs, once
all query modules have entered theirs."""

from __future__ import annotations

import re

# Days that move the order dates so that the last one falls inside the month of the bars.
SHIFT_DAYS = 8212

VIEWS: dict[str, str] = {}


def view(name: str, body: str) -> None:
    VIEWS[name] = body.strip()


view("trades", """
SELECT event_type AS symbol, event_id AS trade_id, ts, 1000 + 0.5 * value AS price,
       CAST(json_extract_string(props, '$.k') AS DECIMAL(38,8)) AS qty
FROM events
""")

# the same trades on a clock of one event per 100 ms, the rate of the live feed
view("tape", """
SELECT symbol, trade_id, TIMESTAMP '2024-01-01' + to_milliseconds(100 * trade_id) AS ts, price, qty
FROM trades
""")

view("bars4h", """
SELECT symbol, time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') AS ts,
       arg_min(price, (ts, trade_id)) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, (ts, trade_id)) AS close, sum(CAST(qty AS DOUBLE)) AS volume
FROM trades GROUP BY 1, 2
""")

view("macro", "SELECT ts, close AS BTCDOM FROM bars4h WHERE symbol = 'view'")

view("orders_by_asset", f"""
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'click' WHEN '2-HIGH' THEN 'error'
            WHEN '3-MEDIUM' THEN 'purchase' WHEN '4-NOT SPECIFIED' THEN 'signup' ELSE 'view' END AS symbol,
       date_trunc('day', o_orderdate) + INTERVAL {SHIFT_DAYS} DAY AS ts,
       o_orderstatus AS status, o_totalprice AS amount
FROM orders
""")

view("flows_daily", """
SELECT symbol, ts, (sum(CASE WHEN status = 'F' THEN amount ELSE 0 END)
                  - sum(CASE WHEN status = 'O' THEN amount ELSE 0 END)) / 1234567.89 AS net_flow
FROM orders_by_asset WHERE status IN ('F', 'O') GROUP BY 1, 2
""")

view("reserve_daily", """
SELECT symbol, ts, sum(amount) / 1234567.89 AS reserve FROM orders_by_asset WHERE status = 'P' GROUP BY 1, 2
""")

view("mcap_daily", """
SELECT symbol, ts, 123456.789 * sum(amount) AS total_mcap FROM orders_by_asset GROUP BY 1, 2
""")

view("oi_daily", """
SELECT symbol, date_trunc('day', ts) AS ts, 1e7 * sum(price * CAST(qty AS DOUBLE) / 1000) AS open_interest
FROM trades GROUP BY 1, 2
""")

view("funding_8h", """
SELECT symbol, time_bucket(INTERVAL '8 hours', ts, TIMESTAMP '1970-01-01') AS ts,
       avg(price) / 98765.4321 AS ex1, max(price) / 98765.4321 AS ex2
FROM trades GROUP BY 1, 2
""")

view("book_diffs", """
SELECT event_type AS symbol, event_id AS arrival,
       TIMESTAMP '2024-01-01' + to_milliseconds(100 * event_id) AS ts,
       CASE WHEN event_id % 17 = 0 THEN event_id - 30 ELSE event_id END AS u,
       CASE WHEN user_id % 2 = 0 THEN 'b' ELSE 'a' END AS side,
       CAST(CASE WHEN user_id % 2 = 0 THEN 100 - (user_id // 2) % 60
                 ELSE 101 + (user_id // 2) % 60 END AS DOUBLE) AS price,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty
FROM events
""")

view("fresh_diffs", """
SELECT * EXCLUDE (seen) FROM (
  SELECT *, max(u) OVER (PARTITION BY symbol ORDER BY arrival
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM book_diffs)
WHERE seen IS NULL OR u > seen
""")

view("final_book", """
SELECT symbol, side, price, arg_max(qty, arrival) AS qty FROM fresh_diffs
GROUP BY 1, 2, 3 HAVING arg_max(qty, arrival) > 0
""")

view("book_snapshots", """
SELECT symbol, event_id AS arrival, ts, event_id - 25 AS last_id,
       row_number() OVER w AS epoch, lead(event_id) OVER w AS closed, lead(ts) OVER w AS closed_at
FROM (SELECT event_type AS symbol, event_id, TIMESTAMP '2024-01-01' + to_milliseconds(100 * event_id) AS ts
      FROM events WHERE event_id % 97 = 5)
WINDOW w AS (PARTITION BY symbol ORDER BY event_id)
""")

# messages once for each epoch they may count in: their own, and later ones that replay them
view("epoch_diffs", """
SELECT * EXCLUDE (seen) FROM (
  SELECT d.symbol, s.epoch, d.arrival, greatest(d.ts, s.ts) AS ts, d.u, d.side, d.price, d.qty, s.last_id,
         max(d.u) OVER (PARTITION BY d.symbol, s.epoch ORDER BY d.arrival
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM book_diffs d JOIN book_snapshots s ON s.symbol = d.symbol AND (
    (d.arrival >= s.arrival AND (s.closed IS NULL OR d.arrival < s.closed))
    OR (d.arrival < s.arrival AND d.u > s.last_id AND (s.epoch = 1 OR d.ts >= s.ts - INTERVAL 10 SECOND))))
WHERE u > last_id AND (seen IS NULL OR u > seen)
""")

view("epoch_levels", """
SELECT symbol, epoch, arrival, ts, side, price, qty FROM epoch_diffs
UNION ALL
SELECT symbol, epoch, -1, ts, side, CASE WHEN side = 'b' THEN 100 - 1.5 * i ELSE 101 + 1.5 * i END,
       CAST(1 + (arrival + 3 * i) % 11 AS DOUBLE)
FROM (SELECT *, unnest(['b', 'a']) AS side FROM (SELECT *, unnest(range(45)) AS i FROM book_snapshots))
""")

view("level_states", """
SELECT l.symbol, l.side, l.price, l.qty, l.ts AS valid_from,
       least(lead(l.ts) OVER (PARTITION BY l.symbol, l.epoch, l.side, l.price ORDER BY l.arrival), s.closed_at) AS valid_to
FROM epoch_levels l JOIN book_snapshots s USING (symbol, epoch)
""")

# every second from the first snapshot on that both feeds have passed
view("sample_times", """
SELECT symbol, unnest(generate_series(first_s, last_s, INTERVAL 1 SECOND)) AS ts
FROM (SELECT symbol, date_trunc('second', min(ts) + INTERVAL '999999 microseconds') AS first_s,
             (SELECT date_trunc('second', least((SELECT max(ts) FROM book_diffs), (SELECT max(ts) FROM tape))
                     - INTERVAL 1 MILLISECOND)) AS last_s
      FROM book_snapshots GROUP BY 1)
""")

view("books_1s", """
SELECT t.symbol, t.ts, s.side, s.price, s.qty
FROM sample_times t JOIN level_states s
  ON s.symbol = t.symbol AND s.valid_from <= t.ts AND (s.valid_to IS NULL OR t.ts < s.valid_to)
WHERE s.qty > 0
""")

view("ranked_1s", """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, ts, side
                               ORDER BY CASE WHEN side = 'b' THEN -price ELSE price END) AS level
  FROM books_1s) WHERE level <= 20
""")

view("headlines", """
SELECT d.doc_id, d.text AS title, d.source,
       CAST(substr(d.source, 4) AS INT) % 2 AS source_rank,
       TIMESTAMP '2024-01-01' + to_minutes(37 * d.doc_id) AS ts,
       4.0 * coalesce(l.quality, 0) AS logit_pos, 5.0 * coalesce(l.toxic, 0) AS logit_neg, 0.0 AS logit_neu
FROM documents d LEFT JOIN labels l USING (doc_id)
""")

view("scored_headlines", """
SELECT doc_id, title, source, source_rank, ts,
       p[1] - p[2] AS sentiment_score, greatest(p[1], p[2], p[3]) AS confidence
FROM (SELECT *, [exp(logit_pos) / z, exp(logit_neg) / z, exp(logit_neu) / z] AS p
      FROM (SELECT *, exp(logit_pos) + exp(logit_neg) + exp(logit_neu) AS z FROM headlines))
""")


def rounded(keys: str, values: str, body: str, places: int = 6) -> str:
    """``body`` with its value columns rounded (adding 0 turns -0 into 0)."""
    cols = [k.strip() for k in keys.split(",") if k.strip()]
    cols += [f'round(CAST("{v}" AS DOUBLE), {places}) + 0.0 AS "{v}"' for v in values.split()]
    return f"SELECT {', '.join(cols)} FROM (\n{body.strip()}\n)"


def exact(body: str) -> str:
    """``body`` as it is, for results without computed doubles."""
    return body.strip()


def with_views(body: str) -> str:
    """Prefix ``body`` with the CTEs it mentions, directly or through other views."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                add(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    add(body)
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in needed)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
