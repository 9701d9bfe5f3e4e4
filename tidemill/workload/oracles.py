"""The same answers in plain SQL, for comparison with the queries."""

from __future__ import annotations

_BRONZE = """
customers AS (
  SELECT c_custkey AS customer_id,
         CASE WHEN c_mktsegment <> 'BUILDING' THEN n_name END AS region
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
gold AS (
  SELECT date_trunc('day', o_orderdate) AS order_date, region, count(o_orderkey) AS order_count,
         CAST(sum(CAST(o_totalprice AS DECIMAL(10,2))) AS DECIMAL(20,2)) AS total_revenue
  FROM orders LEFT JOIN customers ON o_custkey = customer_id
  WHERE o_orderstatus = 'F' GROUP BY 1, 2)
"""

_GOLD = f"""
WITH {_BRONZE}
SELECT CAST(order_date AS TIMESTAMP) AS order_date, region, order_count, total_revenue FROM gold
"""

_UPSERTED = """
SELECT o_orderkey, o_orderstatus,
       CAST(CAST(o_totalprice AS DECIMAL(12,2))
            + CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS DECIMAL(12,2)) AS price
FROM orders
"""


def _windows(minutes: int) -> str:
    return f"""
SELECT time_bucket(INTERVAL {minutes} MINUTE, ts, TIMESTAMP '2000-01-01') AS window_start,
       time_bucket(INTERVAL {minutes} MINUTE, ts, TIMESTAMP '2000-01-01')
         + INTERVAL {minutes} MINUTE AS window_end,
       event_type, count(*) AS event_count, count(DISTINCT user_id) AS distinct_sessions
FROM events GROUP BY 1, 2, 3
"""


_CLOSED = f"""
SELECT * FROM ({_windows(1)})
WHERE window_end <= (SELECT max(ts) - INTERVAL 30 SECOND FROM events)
"""

_RUNS = """
runs AS (
  SELECT 'run_' || o_orderkey AS run_id, 'job_' || (o_custkey % 50) AS job_name,
         CASE o_custkey % 3 WHEN 0 THEN 'batch_ingestion' WHEN 1 THEN 'streaming'
              ELSE 'dbt' END AS job_type,
         CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed'
              ELSE 'running' END AS status,
         o_orderdate + to_seconds(o_orderkey % 86400) AS started_at,
         CASE WHEN o_orderstatus IN ('F', 'P')
              THEN o_orderdate + to_seconds(o_orderkey % 86400)
                   + to_seconds(o_orderkey % 900 + 30) END AS ended_at,
         CASE WHEN o_orderstatus = 'F'
              THEN CAST(o_orderkey % 900 + 30 AS DOUBLE) END AS duration_seconds,
         CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS rows_written,
         ['tbl_' || (o_custkey % 45)] AS input_tables,
         CASE WHEN o_orderstatus = 'F'
              THEN ['tbl_' || (o_custkey % 60), 'tbl_' || (o_custkey % 60 + 1)]
              ELSE CAST([] AS VARCHAR[]) END AS output_tables,
         CASE WHEN o_orderstatus = 'P' THEN 'error ' || (o_orderkey % 7) END AS error_message,
         CASE WHEN o_orderstatus = 'F'
              THEN CAST(o_orderkey % 900 + 30 AS DOUBLE) * CAST(0.2 AS DOUBLE) / 3600
              END AS estimated_cost_usd
  FROM orders),
reads AS (
  SELECT 'tbl_' || (user_id % 7 + 50) AS table_name FROM events)
"""

_UNUSED = """
unused AS (
  SELECT table_name, max(ended_at) AS last_written
  FROM (SELECT unnest(output_tables) AS table_name, ended_at FROM runs WHERE status = 'success')
  WHERE table_name NOT IN (SELECT unnest(input_tables) FROM runs
                           UNION SELECT table_name FROM reads)
  GROUP BY 1)
"""

_TREND = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY job_name ORDER BY ended_at DESC, run_id) AS rk
  FROM runs WHERE status = 'success'),
trend AS (
  SELECT job_name, sum(estimated_cost_usd) AS total_cost,
         avg(duration_seconds) FILTER (WHERE rk <= 5) AS recent,
         avg(duration_seconds) FILTER (WHERE rk BETWEEN 6 AND 10) AS prior
  FROM ranked GROUP BY 1),
ratios AS (SELECT *, round(recent / nullif(prior, 0), 2) AS ratio FROM trend)
"""

_TREND_OUT = """
SELECT job_name, ratio AS runtime_trend_ratio, round(total_cost, 6) AS total_estimated_cost_usd,
       round(recent, 6) AS avg_recent_duration, round(prior, 6) AS avg_prior_duration
FROM ratios
"""

# Every set also holds the load stamp. Two sets sharing nothing else stay below
# one half, so pairs are looked for among the other columns and 1 is added.
_PAIRS = """
cols AS (SELECT DISTINCT 'ord_' || l_orderkey AS t, 'p_' || l_partkey AS c FROM lineitem),
sizes AS (SELECT t, count(*) + 1 AS n FROM cols GROUP BY 1),
common AS (
  SELECT a.t AS table_a, b.t AS table_b, count(*) + 1 AS k,
         '_ingested_at,' || string_agg(a.c, ',' ORDER BY a.c) AS shared_columns
  FROM cols a JOIN cols b ON a.c = b.c AND a.t < b.t GROUP BY 1, 2),
pairs AS (
  SELECT table_a, table_b, CAST(k AS DOUBLE) / (sa.n + sb.n - k) AS overlap, shared_columns
  FROM common JOIN sizes sa ON sa.t = table_a JOIN sizes sb ON sb.t = table_b
  WHERE CAST(k AS DOUBLE) / (sa.n + sb.n - k) >= 0.5)
"""

# The least name of equal schemas stands for them.
_CLASSES = """
cols AS (SELECT DISTINCT 'ord_' || l_orderkey AS t, 'p_' || l_partkey AS c FROM lineitem),
shapes AS (SELECT t, string_agg(c, ',' ORDER BY c) AS items, count(*) + 1 AS n FROM cols GROUP BY 1),
classes AS (SELECT items, any_value(n) AS n, min(t) AS rep, count(*) AS names FROM shapes GROUP BY 1),
own AS (SELECT rep, unnest(string_split(items, ',')) AS c FROM classes),
common AS (
  SELECT a.rep AS table_a, b.rep AS table_b, count(*) + 1 AS k,
         '_ingested_at,' || string_agg(a.c, ',' ORDER BY a.c) AS shared_columns
  FROM own a JOIN own b ON a.c = b.c AND a.rep < b.rep GROUP BY 1, 2),
class_pairs AS (
  SELECT table_a, table_b, ca.names AS tables_a, cb.names AS tables_b,
         CAST(k AS DOUBLE) / (ca.n + cb.n - k) AS overlap, shared_columns
  FROM common JOIN classes ca ON ca.rep = table_a JOIN classes cb ON cb.rep = table_b
  WHERE CAST(k AS DOUBLE) / (ca.n + cb.n - k) >= 0.5)
"""

_FINDINGS = f"""
{_RUNS}, {_UNUSED}, {_TREND}, {_PAIRS},
findings AS (
  SELECT 'Unused tables' AS "check", table_name AS finding,
         'written by a pipeline (last: ' || strftime(last_written, '%Y-%m-%d %H:%M:%S')
         || '+00:00) but never read as an input by any other tracked run' AS reason
  FROM unused
  UNION ALL
  SELECT 'Rising cost / runtime trend', job_name,
         format('runtime trending up: recent runs average {{:.2f}}s vs {{:.2f}}s before '
                || '({{:+d}}%), total est. cost so far ${{:.4f}}',
                recent, prior, CAST(round_even((ratio - 1) * 100, 0) AS INTEGER), total_cost)
  FROM ratios WHERE ratio >= 1.2
  UNION ALL
  SELECT 'Near-duplicate output schemas', table_a || ' <-> ' || table_b,
         format('{{:d}}% of columns overlap ([{{}}]) -- possible redundant pipelines',
                CAST(round_even(overlap * 100, 0) AS INTEGER),
                '''' || replace(shared_columns, ',', ''', ''') || '''')
  FROM pairs)
"""

_MD = """
md AS (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), chr(10) || chr(10))
                      WHEN 1 THEN replace(text, chr(10), chr(10) || '| ')
                      ELSE text END AS text
  FROM documents)
"""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) " \
         "|| chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8232) || chr(8233) " \
         "|| chr(8239) || chr(8287) || chr(12288)"

# Lines in order; a table row opens a block, and so does text not preceded by text.
_BLOCKS = rf"""
{_MD},
lines AS (
  SELECT doc_id, unnest(list_zip(range(len(l)), l)) AS pair
  FROM (SELECT doc_id, string_split(regexp_replace(text,
               '\r\n|[\n\r\v\f\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'),
               chr(10)) AS l FROM md)),
kinds AS (
  SELECT doc_id, pair[1] AS n, pair[2] AS line,
         CASE WHEN trim(pair[2], {_SPACE}) = '' THEN 'gap'
              WHEN starts_with(trim(pair[2], {_SPACE}), '|') THEN 'row' ELSE 'text' END AS kind
  FROM lines),
opened AS (
  SELECT *, CASE WHEN kind = 'row' THEN 1
                 WHEN kind = 'text' AND lag(kind, 1, 'gap') OVER w <> 'text' THEN 1
                 ELSE 0 END AS opens
  FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS block_index FROM opened),
blocks AS (
  SELECT doc_id, CAST(block_index AS INTEGER) AS block_index,
         trim(string_agg(line, chr(10) ORDER BY n), {_SPACE}) AS block
  FROM numbered WHERE kind <> 'gap' GROUP BY 1, 2)
"""

# One block per document and round; "out" holds what the round closes.
_CHUNKS = f"""
{_BLOCKS},
fold AS (
  SELECT doc_id, -1 AS i, '' AS buf, CAST([] AS VARCHAR[]) AS out FROM md
  UNION ALL
  SELECT f.doc_id, f.i + 1,
         CASE WHEN length(b.block) > 800 THEN ''
              WHEN f.buf = '' OR length(f.buf) + length(b.block) + 1 > 800 THEN b.block
              ELSE f.buf || chr(10) || b.block END,
         list_concat(
           CASE WHEN f.buf <> '' AND length(f.buf) + length(b.block) + 1 > 800
                THEN [f.buf] ELSE CAST([] AS VARCHAR[]) END,
           CASE WHEN length(b.block) > 800
                THEN list_transform(range(0, length(b.block), 700),
                                    lambda s: substring(b.block, s + 1, 800))
                ELSE CAST([] AS VARCHAR[]) END)
  FROM fold f JOIN blocks b ON b.doc_id = f.doc_id AND b.block_index = f.i + 1),
closed AS (
  SELECT doc_id, i, 0 AS late, unnest(list_zip(range(len(out)), out)) AS pair FROM fold
  UNION ALL
  SELECT doc_id, i, 1, {{'a': 0, 'b': buf}} AS pair FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS back FROM fold)
  WHERE back = 1 AND buf <> ''),
chunks AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, late, pair[1]) - 1
                      AS INTEGER) AS chunk_index, pair[2] AS chunk
  FROM closed)
"""

_QUESTIONS = """
asked AS (
  SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'Which jobs COST most? '
           WHEN 1 THEN 'Why did it fail? ' WHEN 2 THEN 'Which tables are unused? '
           WHEN 3 THEN 'What is getting slow? ' ELSE 'Tell me about ' END || text AS question
  FROM conversations WHERE role = 'user')
"""


def _word_slots(source: str, key: str, text: str) -> str:
    return rf"""
  SELECT {key}, CAST(('0x' || substring(md5(word), 1, 8)) AS BIGINT) % 64 AS slot,
         count(*) AS words
  FROM (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[ \t\n\v\f\r]+')) AS word
        FROM {source})
  WHERE word <> '' GROUP BY 1, 2
"""


_HITS = f"""
{_CHUNKS}, {_QUESTIONS},
stored AS (
  SELECT sha256('doc_' || doc_id || chr(10) || chunk_index) AS id, chunk AS text,
         'doc_' || doc_id AS source FROM chunks),
queries AS (SELECT conv_id || '-' || turn AS qid, question FROM asked),
sv AS ({_word_slots('stored', 'id', 'text')}),
qv AS ({_word_slots('queries', 'qid', 'question')}),
sn AS (SELECT id, CAST(sum(words * words) AS DOUBLE) AS sq FROM sv GROUP BY 1),
qn AS (SELECT qid, CAST(sum(words * words) AS DOUBLE) AS sq FROM qv GROUP BY 1),
scores AS (
  SELECT qid, id, CAST(sum(qv.words * sv.words) AS DOUBLE) AS dot
  FROM qv JOIN sv USING (slot) GROUP BY 1, 2),
ranked_hits AS (
  SELECT qid, id, row_number() OVER (PARTITION BY qid
           ORDER BY dot / sqrt(qn.sq * sn.sq) DESC, id) AS rank
  FROM scores JOIN sn USING (id) JOIN qn USING (qid)),
hits AS (SELECT * FROM ranked_hits JOIN stored USING (id) WHERE rank <= 4)
"""

_COSINES = """
scores AS (
  SELECT q.vec_id AS qid, s.vec_id AS id,
         list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[]))
           AS score
  FROM embeddings q, embeddings s),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scores)
"""

ORACLES: dict[str, str] = {
    "daily_revenue": _GOLD,
    "bronze_ingest": _GOLD,
    "revenue_by_day": f"""
WITH {_BRONZE}
SELECT CAST(order_date AS TIMESTAMP) AS order_date,
       CAST(sum(total_revenue) AS DECIMAL(20,2)) AS total_revenue FROM gold GROUP BY 1""",
    "revenue_by_region": f"""
WITH {_BRONZE}
SELECT region, CAST(sum(total_revenue) AS DECIMAL(20,2)) AS total_revenue
FROM gold WHERE region IS NOT NULL GROUP BY 1""",
    "latest_lineitem": """
SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity,
       l_discount, l_tax
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount,
           l_tax) = 1""",
    "latest_customer_order": """
SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""",
    "sample_orders":
        "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10",
    "upsert_orders": _UPSERTED,
    "incremental_ingest": """
WITH base AS (
  SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(12,2)) AS price,
         CAST(o_orderdate AS DATE) AS d FROM orders),
drops AS (
  SELECT k, price, CASE WHEN k % 11 <> 0 THEN d END AS marker FROM base
  UNION ALL SELECT k, price + 1, d + 1 FROM base WHERE k % 5 = 0
  UNION ALL SELECT k, price - 1, d - 1 FROM base WHERE k % 7 = 0)
SELECT CAST(k AS VARCHAR) AS order_id, CAST(price AS DECIMAL(12,2)) AS order_amount,
       strftime(marker, '%Y-%m-%d') AS updated_at
FROM drops QUALIFY row_number() OVER (PARTITION BY k ORDER BY marker DESC NULLS LAST) = 1""",
    "incremental_files": """
SELECT CAST(1 AS INTEGER) AS load, count(*) AS rows_read, count(*) AS rows_written FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT 2, count(*), count(*) FROM orders WHERE o_orderkey % 3 = 1
UNION ALL SELECT 3, count(*) FILTER (WHERE o_orderkey % 3 = 2) + count(*) FILTER (WHERE o_orderkey % 5 = 0)
                      + count(*) FILTER (WHERE o_orderkey % 7 = 0),
                    count(*) FILTER (WHERE o_orderkey % 3 = 2 OR o_orderkey % 5 = 0) FROM orders
UNION ALL SELECT 4, 0, 0""",
    "quarantine_counts": """
SELECT source, reason, count(*) AS rows FROM (
  SELECT 'orders' AS source, CASE WHEN o_orderkey % 13 = 0 THEN 'not a JSON object'
           WHEN o_orderkey % 17 = 0 THEN 'order_amount is no double'
           WHEN o_orderkey % 19 = 0 THEN 'order_id is missing' ELSE 'good' END AS reason FROM orders
  UNION ALL
  SELECT 'customers', CASE WHEN c_custkey % 13 = 0 AND c_custkey % 11 = 0
           THEN 'more cells than columns, balance is no double'
           WHEN c_custkey % 13 = 0 THEN 'more cells than columns'
           WHEN c_custkey % 11 = 0 THEN 'balance is no double' ELSE 'good' END FROM customer
  UNION ALL
  SELECT 'events', CASE WHEN user_id % 3 = 0 THEN 'not a JSON event' WHEN user_id % 7 = 0 THEN 'event_time is missing'
           WHEN user_id % 5 = 0 THEN 'event_time is no timestamp' ELSE 'good' END FROM events)
GROUP BY 1, 2""",
    "csv_options": """
SELECT c_custkey AS customer_id, 'a "note"' || chr(10) || 'on |' || c_custkey AS note,
       CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS segment FROM customer""",
    "load_stamps": """
SELECT 'orders' AS source, count(*) AS rows, CAST(1 AS BIGINT) AS loads FROM orders
UNION ALL SELECT 'customers', count(*), 1 FROM customer UNION ALL SELECT 'none', 0, 0""",
    "catalog_revenue": _GOLD,
    "catalog_columns": f"""
WITH {_BRONZE}, counts AS (
  SELECT 'silver.stg_orders' AS table_name, count(*) AS rows FROM orders
  UNION ALL SELECT 'silver.stg_customers', count(*) FROM customer
  UNION ALL SELECT 'gold.daily_revenue', count(*) FROM gold)
SELECT table_name, column_name, data_type, rows FROM counts JOIN (VALUES
  ('silver.stg_orders', 'order_id', 'bigint'), ('silver.stg_orders', 'customer_id', 'bigint'),
  ('silver.stg_orders', 'order_amount', 'decimal(10,2)'), ('silver.stg_orders', 'order_status', 'string'),
  ('silver.stg_orders', 'created_at', 'timestamp'), ('silver.stg_orders', 'updated_at', 'timestamp'),
  ('silver.stg_customers', 'customer_id', 'bigint'), ('silver.stg_customers', 'email', 'string'),
  ('silver.stg_customers', 'signup_date', 'date'), ('silver.stg_customers', 'region', 'string'),
  ('silver.stg_customers', 'updated_at', 'timestamp'),
  ('gold.daily_revenue', 'order_date', 'timestamp'), ('gold.daily_revenue', 'region', 'string'),
  ('gold.daily_revenue', 'order_count', 'bigint'), ('gold.daily_revenue', 'total_revenue', 'decimal(20,2)')
) AS c(table_name, column_name, data_type) USING (table_name)""",
    "stream_flush": _windows(1),
    "stream_timed": _windows(1),
    "schema_classes": f"""
WITH {_CLASSES}
SELECT s.t AS table_name, c.rep AS class, c.names AS tables, c.names - 1 + coalesce(m.links, 0)::BIGINT AS links
FROM shapes s JOIN classes c USING (items)
     LEFT JOIN (SELECT rep, sum(n) AS links FROM (SELECT table_a AS rep, tables_b AS n FROM class_pairs
                UNION ALL SELECT table_b, tables_a FROM class_pairs) GROUP BY 1) m ON m.rep = c.rep""",
    "schema_class_pairs": f"""
WITH {_CLASSES}
SELECT table_a, table_b, tables_a, tables_b, tables_a * tables_b AS pairs, round(overlap, 6) AS overlap, shared_columns
FROM class_pairs
UNION ALL
SELECT rep, rep, names, names, names * (names - 1) // 2, 1.0, '_ingested_at,' || items FROM classes WHERE names > 1""",
    "manifest_reads": """
SELECT '/lake/bronze/' || n_name AS table_name, 'dbt_run' AS reader_job, count(*) AS reads
FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey <> 0 GROUP BY 1, 2""",
    "corpus_files": """
SELECT lang, CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS chars FROM documents GROUP BY 1""",
    "chunk_metadata": f"""
WITH RECURSIVE {_CHUNKS}
SELECT sha256('doc_' || doc_id || chr(10) || chunk_index) AS id,
       '{{"source":"doc_' || doc_id || '","chunk_index":' || chunk_index || '}}' AS metadata FROM chunks""",
    "embed_model": " UNION ALL ".join(
        f"SELECT doc_id, CAST({i} AS BIGINT) AS slot, length(text) - length(replace(text, '{letter}', '')) AS value FROM documents"
        for i, letter in enumerate("aeinorst")),
    "csv_by_name": """
SELECT 'declared' AS how, c_custkey AS customer_id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS email,
       c_acctbal AS balance FROM customer
UNION ALL
SELECT 'inferred', c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END, c_acctbal FROM customer""",
    "model_run_log": f"""
WITH {_BRONZE}
SELECT 'dbt_run' AS job_name, 'dbt' AS job_type, 'success' AS status,
       (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer)
         + (SELECT count(*) FROM gold) AS rows_written,
       'gold.daily_revenue,silver.stg_customers,silver.stg_orders' AS output_tables""",
    "model_schema_overlap": """
SELECT 'silver.stg_customers' AS table_a, 'silver.stg_orders' AS table_b,
       round(CAST(2 AS DOUBLE) / 9, 6) AS overlap, 'customer_id,updated_at' AS shared_columns
WHERE EXISTS (SELECT * FROM orders) AND EXISTS (SELECT * FROM customer)""",
    "failed_runs": """
SELECT 'check_segments' AS job_name, 'batch_ingestion' AS job_type, 'failed' AS status,
       count(*) || ' customers without a segment' AS error_message
FROM customer WHERE c_mktsegment IS NULL OR c_mktsegment = 'BUILDING'""",
    "read_log": """
SELECT table_name, reader_job, count(*) AS reads FROM (
  SELECT 'tbl_' || (user_id % 7 + 50) AS table_name,
         CASE WHEN event_type = 'view' THEN 'dash_' ELSE 'export_' END || (user_id % 3) AS reader_job
  FROM events UNION ALL SELECT 'gold.orders', 'dashboard') GROUP BY 1, 2""",
    "stream_json_counts": f"SELECT * FROM ({_windows(1)})\n"
        "WHERE window_end <= (SELECT max(ts) - INTERVAL 30 SECOND FROM events)",
    "time_travel_counts": """
SELECT 0 AS version, 'overwrite' AS operation, count(*) AS rows
FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 1, 'upsert', count(*) FROM orders""",
    "quality_not_null": """
SELECT 'not_null' AS "check", 'orders' AS "table", 'o_orderkey' AS "column",
       count(*) FILTER (WHERE o_orderkey IS NULL) AS failures FROM orders
UNION ALL SELECT 'not_null', 'orders', 'o_custkey',
       count(*) FILTER (WHERE o_custkey IS NULL) FROM orders
UNION ALL SELECT 'not_null', 'customer', 'c_custkey',
       count(*) FILTER (WHERE c_custkey IS NULL) FROM customer
UNION ALL SELECT 'not_null', 'customer', 'c_mktsegment',
       count(*) FILTER (WHERE c_mktsegment IS NULL OR c_mktsegment = 'BUILDING') FROM customer""",
    "quality_unique": """
SELECT 'unique' AS "check", 'lineitem' AS "table", 'l_orderkey' AS "column",
       count(*) AS failures
FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'unique', 'lineitem', 'l_partkey', count(*)
FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'unique', 'customer', 'c_custkey', count(*)
FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)""",
    "window_counts_1min": _windows(1),
    "window_counts_1h": _windows(60),
    "event_pivot": f"""
SELECT window_start,
       coalesce(avg(event_count) FILTER (WHERE event_type = 'click'), 0) AS click,
       coalesce(avg(event_count) FILTER (WHERE event_type = 'error'), 0) AS error,
       coalesce(avg(event_count) FILTER (WHERE event_type = 'purchase'), 0) AS purchase,
       coalesce(avg(event_count) FILTER (WHERE event_type = 'signup'), 0) AS signup,
       coalesce(avg(event_count) FILTER (WHERE event_type = 'view'), 0) AS view
FROM ({_windows(60)}) GROUP BY 1""",
    "stream_window_counts": _CLOSED,
    "stream_heartbeats": f"""
SELECT 'clickstream_sessionization' AS job_name, 'streaming' AS job_type, 'success' AS status,
       (SELECT count(*) FROM events) AS rows_read,
       (SELECT count(*) FROM ({_CLOSED})) AS rows_written""",
    "run_log_latest": f"""
WITH {_RUNS}
SELECT run_id, job_name, job_type, status, started_at, ended_at, duration_seconds, error_message
FROM runs""",
    "runs_by_type": f"""
WITH {_RUNS}
SELECT job_name, job_type, status, started_at, CAST(NULL AS BIGINT) AS rows_read, rows_written
FROM runs WHERE job_type = 'streaming'""",
    "top_cost_jobs": f"""
WITH {_RUNS}
SELECT job_name,
       CAST(sum(CAST(estimated_cost_usd AS DECIMAL(18,8))) AS DECIMAL(28,8)) AS total_cost
FROM runs WHERE status = 'success'
  AND ended_at >= (SELECT max(ended_at) FROM runs) - INTERVAL 7 DAY
GROUP BY 1 ORDER BY total_cost DESC, job_name LIMIT 10""",
    "recent_failures": f"""
WITH {_RUNS}
SELECT job_name, ended_at, error_message FROM runs
WHERE status = 'failed' AND ended_at >= (SELECT max(ended_at) FROM runs) - INTERVAL 3 DAY""",
    "unused_tables": f"WITH {_RUNS}, {_UNUSED} SELECT table_name, last_written FROM unused",
    "runtime_trend": f"WITH {_RUNS}, {_TREND} {_TREND_OUT}",
    "runtime_regressions": f"WITH {_RUNS}, {_TREND} {_TREND_OUT} WHERE ratio >= 1.2",
    "duplicate_schemas": f"""
WITH {_PAIRS}
SELECT table_a, table_b, round(overlap, 6) AS overlap, shared_columns FROM pairs""",
    "wastage_report": f'WITH {_FINDINGS} SELECT "check", finding, reason FROM findings',
    "wastage_totals":
        f'WITH {_FINDINGS} SELECT "check", count(*) AS findings FROM findings '
        'GROUP BY ROLLUP ("check")',
    "run_edges": f"""
WITH {_RUNS}
SELECT unnest(input_tables) AS from_node, job_name AS to_node FROM runs
UNION SELECT job_name, unnest(output_tables) FROM runs""",
    "dependency_reads": """
SELECT table_name, 'dbt_run' AS reader_job, count(*) AS reads FROM (
  SELECT 'silver.' || s_name AS table_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  WHERE l_suppkey % 3 = 0
  UNION ALL
  SELECT '/lake/bronze/' || n_name FROM lineitem JOIN nation ON n_nationkey = l_suppkey % 25
  WHERE l_suppkey % 3 = 1 AND n_regionkey <> 0) GROUP BY 1""",
    "chunk_sliding": """
SELECT doc_id, CAST(s // 700 AS INTEGER) AS chunk_index, substring(text, s + 1, 800) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, length(text), 700)) AS s FROM documents)""",
    "chunk_blocks": f"WITH {_BLOCKS} SELECT doc_id, block_index, block FROM blocks",
    "chunk_replacement": f"""
WITH RECURSIVE documents AS (
  SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 3 = 0 THEN left(text, 300)
                      ELSE text END AS text FROM main.documents),
{_CHUNKS} SELECT 'doc_' || doc_id AS source, chunk_index, chunk AS text FROM chunks""",
    "chunk_packed": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, chunk_index, chunk FROM chunks",
    "embed_chunks": _word_slots("documents", "doc_id", "text").strip(),
    "vector_topk": f"""
WITH {_COSINES}
SELECT id, round(score, 4) AS score FROM ranked
WHERE rank <= 5 AND qid = (SELECT min(vec_id) FROM embeddings)""",
    "vector_topk_batch":
        f"WITH {_COSINES} SELECT qid, CAST(rank AS INTEGER) AS rank, id, "
        "round(score, 4) AS score FROM ranked WHERE rank <= 5 AND qid % 50 = 0",
    "vector_topk_copies": f"""
WITH {_COSINES},
twice AS (SELECT qid, id, score FROM scores WHERE qid % 50 = 0
          UNION ALL SELECT qid, id + 10000000, score FROM scores WHERE qid % 50 = 0)
SELECT qid, CAST(rank AS INTEGER) AS rank, id FROM (
  SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, id) AS rank
  FROM twice) WHERE rank <= 6""",
    "retrieval_context": f"""
WITH RECURSIVE {_HITS}
SELECT qid, string_agg('[' || source || ']' || chr(10) || text,
                       chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
FROM hits GROUP BY 1""",
    "citations": f"""
WITH RECURSIVE {_HITS}
SELECT qid, source, CAST(min(rank) AS INTEGER) AS first_rank FROM hits GROUP BY 1, 2""",
    "tool_answers": f"""
WITH RECURSIVE {_HITS}, {_RUNS}, {_UNUSED}, {_TREND},
exact AS (
  SELECT job_name, CAST(sum(CAST(estimated_cost_usd AS DECIMAL(18,8))) AS DECIMAL(28,8)) AS total_cost
  FROM runs WHERE status = 'success' GROUP BY 1),
costs AS (
  SELECT job_name, CAST(sum(CAST(estimated_cost_usd AS DECIMAL(18,8))) AS DECIMAL(28,8)) AS total_cost
  FROM runs WHERE status = 'success' AND ended_at >= (SELECT max(ended_at) FROM runs) - INTERVAL 7 DAY
  GROUP BY 1 ORDER BY total_cost DESC NULLS LAST, job_name LIMIT 10),
failures AS (
  SELECT job_name || ' | ' || ended_at || ' | ' || error_message AS line, ended_at, job_name, error_message
  FROM runs WHERE status = 'failed' AND ended_at >= (SELECT max(ended_at) FROM runs) - INTERVAL 3 DAY),
texts AS (
  SELECT 'top_cost_pipelines' AS tool, coalesce(string_agg(job_name || ' | ' || total_cost, chr(10)
           ORDER BY total_cost DESC, job_name), '') AS context FROM costs
  UNION ALL
  SELECT 'recent_failures' AS tool, coalesce(string_agg(line, chr(10) ORDER BY ended_at DESC, job_name, error_message), '')
  FROM failures
  UNION ALL
  SELECT 'unused_tables', coalesce(string_agg(table_name || ' | ' || last_written, chr(10)
           ORDER BY last_written DESC NULLS LAST, table_name), '') FROM unused
  UNION ALL
  SELECT 'runtime_trend', coalesce(string_agg(job_name || ' | ' || exact.total_cost || ' | ' || coalesce(recent::VARCHAR, 'None')
           || ' | ' || coalesce(prior::VARCHAR, 'None') || ' | ' || coalesce(ratio::VARCHAR, 'None'), chr(10)
           ORDER BY ratio DESC NULLS LAST, job_name), '') FROM ratios JOIN exact USING (job_name)),
routed AS (
  SELECT conv_id || '-' || turn AS qid, CASE
    WHEN regexp_matches(lower(question), 'cost|expensive|spend') THEN 'top_cost_pipelines'
    WHEN regexp_matches(lower(question), 'fail|error|broke') THEN 'recent_failures'
    WHEN regexp_matches(lower(question), 'unused|waste|orphan') THEN 'unused_tables'
    WHEN regexp_matches(lower(question), 'slow|trend|degrad') THEN 'runtime_trend'
    ELSE 'doc_search' END AS tool FROM asked)
SELECT qid, tool, context FROM routed JOIN texts USING (tool)
UNION ALL
SELECT qid, tool, string_agg('[' || source || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10)
                             ORDER BY rank) FROM routed JOIN hits USING (qid) WHERE tool = 'doc_search' GROUP BY 1, 2""",
    "route_questions": f"""
WITH {_QUESTIONS}
SELECT conv_id, turn, question, CASE
  WHEN regexp_matches(lower(question), 'cost|expensive|spend') THEN 'top_cost_pipelines'
  WHEN regexp_matches(lower(question), 'fail|error|broke') THEN 'recent_failures'
  WHEN regexp_matches(lower(question), 'unused|waste|orphan') THEN 'unused_tables'
  WHEN regexp_matches(lower(question), 'slow|trend|degrad') THEN 'runtime_trend'
  ELSE 'doc_search' END AS tool
FROM asked""",
}
ORACLES["vector_topk_pruned"] = ORACLES["vector_topk_batch"]
