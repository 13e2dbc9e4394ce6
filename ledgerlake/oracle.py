"""DuckDB SQL giving the same results as the registered queries."""

from __future__ import annotations

from .schemas import CATEGORIES, METRICS


def _hash(key: str, buckets: int, salt: str = "") -> str:
    text = f"'{salt}' || {key}" if salt else key
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) % {buckets}"


def _pad(expression: str, width: int) -> str:
    """Zeros in front; a longer text is not cut."""
    text = f"CAST({expression} AS VARCHAR)"
    return f"lpad({text}, CAST(greatest(length({text}), {width}) AS INTEGER), '0')"


_CATEGORIES = str(list(CATEGORIES))

_CUSTOMERS = f"""
v_customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name AS name, '1970-01-01' AS birthdate,
         '(0, 0)' AS current_location, c_custkey || '@example.com' AS mail,
         'user' || c_custkey AS username, c_custkey || ' Main Street' || chr(10) || 'Town' AS address,
         'ACC' || {_pad('c_custkey', 10)} AS account_number,
         'SSN' || c_custkey AS ssn, 'O+' AS blood_group, c_mktsegment AS company, 'clerk' AS job,
         'X' AS sex,
         lower(replace(n_name, '_', ' ')) || CASE WHEN n_nationkey % 2 = 1 THEN 'x' ELSE '' END AS county,
         {_pad('n_regionkey', 2)} AS country_code
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

_TRANSACTIONS = f"""
v_transactions AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS _id,
         'ACC' || {_pad('o_orderkey * 31 % 997', 10)} AS sender_account,
         CASE WHEN o_orderkey % 10 = 0 THEN 'EXT' || o_orderkey
              ELSE 'ACC' || {_pad('o_custkey', 10)} END AS receiver_account,
         round(o_totalprice, 2) AS amount,
         CAST(epoch(o_orderdate) AS DOUBLE) AS transaction_date,
         o_orderkey AS seq
  FROM orders)"""

_COUNTRIES = f"""
v_countries AS (
  SELECT {_pad('r_regionkey', 2)} AS country_code, r_name AS country
  FROM region WHERE r_regionkey < (SELECT max(r_regionkey) FROM region))"""

_COUNTIES = """
counties AS (SELECT DISTINCT county FROM v_customers),
candidates AS (
  SELECT county, 'N-' || n_nationkey AS code, lower(n_name) AS name, lower(trim(county)) AS q FROM counties, nation),
ranked AS (
  SELECT county, code,
         CASE WHEN q = name OR q = lower(code) OR contains(name, q)
              THEN CASE WHEN q = name OR q = lower(code) THEN 50 ELSE 0 END
                   + CASE WHEN contains(name, q) THEN greatest(5, 30 - 2 * (instr(name, q) - 1)) ELSE 0 END
              WHEN levenshtein(q, name) <= 2 THEN -levenshtein(q, name) END AS points
  FROM candidates),
matches AS (
  SELECT county, code AS iso3166_2 FROM ranked WHERE points IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY county ORDER BY points DESC, code) = 1)"""

_SILVER_CUSTOMERS = f"""{_CUSTOMERS},{_COUNTRIES},{_COUNTIES},
s_customers AS (
  SELECT c.* REPLACE ('********' AS birthdate, '****' AS current_location),
         coalesce(k.country, 'not found') AS country, m.iso3166_2
  FROM v_customers c LEFT JOIN v_countries k ON c.country_code = k.country_code
       LEFT JOIN matches m ON c.county = m.county)"""

_PROFILES = f"""
s_profiles AS (
  SELECT c._id, {_hash('t._id', 101, 'profile:')} AS score
  FROM v_transactions t JOIN v_customers c ON t.receiver_account = c.account_number
  QUALIFY row_number() OVER (PARTITION BY c._id ORDER BY t.seq DESC) = 1)"""

_SILVER_TRANSACTIONS = f"""{_TRANSACTIONS},
s_transactions AS (
  SELECT _id, sender_account, receiver_account, amount, transaction_date,
         {_CATEGORIES}[1 + {_hash('_id', 11)}] AS category
  FROM v_transactions)"""

_GOLD_CUSTOMERS = f"""{_SILVER_CUSTOMERS},{_TRANSACTIONS},{_PROFILES},
g_customers AS (
  SELECT c._id, blood_group, company, country, country_code, county, iso3166_2, job, sex,
         coalesce(p.score, 0) AS score
  FROM s_customers c LEFT JOIN s_profiles p ON c._id = p._id)"""

_GOLD_TRANSACTIONS = f"""{_SILVER_TRANSACTIONS},
g_transactions AS (
  SELECT _id, amount, transaction_date, category, false AS fraud FROM s_transactions),
flagged AS (
  SELECT _id, amount, transaction_date, true AS fraud FROM v_transactions
  WHERE {_hash('_id', 101, 'fraud:')} > 85),
g_after AS (
  SELECT coalesce(g._id, f._id) AS _id,
         CASE WHEN f._id IS NOT NULL THEN f.amount ELSE g.amount END AS amount,
         CASE WHEN f._id IS NOT NULL THEN f.transaction_date ELSE g.transaction_date END AS transaction_date,
         category,
         CASE WHEN f._id IS NOT NULL THEN f.fraud ELSE g.fraud END AS fraud
  FROM g_transactions g FULL JOIN flagged f ON g._id = f._id)"""

_LINE_ORDER = (
    "l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, "
    "l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC"
)


def _line_documents(name: str, which: str, extra: str) -> str:
    return f"""
{name} AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS _id, l_partkey AS part,
         CASE WHEN l_linestatus <> 'O' THEN l_quantity END AS quantity, {extra}
  FROM lineitem WHERE {which}
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) = 1)"""


_LINES = (
    _line_documents("t", "l_returnflag <> 'R'", "l_linestatus AS status")
    + ","
    + _line_documents("s", "l_returnflag = 'R'", "l_tax AS tax")
)

_CURSORS = """
positions AS (
  SELECT event_type AS consumergroup, user_id % 4 AS partitionid,
         max(event_id) AS committedoffset, max(ts) AS seen
  FROM events GROUP BY 1, 2),
cursors AS (
  SELECT consumergroup, partitionid, committedoffset,
         date_diff('millisecond', seen, max(seen) OVER w) AS gap,
         (epoch_us(max(seen) OVER w) - epoch_us(seen)) // 1000 AS consumerlagmillis,
         max(committedoffset) OVER w AS produceroffset
  FROM positions WINDOW w AS (PARTITION BY partitionid)),
progress AS (
  SELECT partitionid, max(produceroffset) + 1 AS published, min(committedoffset) AS processed
  FROM cursors GROUP BY 1),
lag AS (
  SELECT consumergroup, partitionid, max(CAST(consumerlagmillis AS DOUBLE) / 1000) AS lag_s,
         max(produceroffset) + 1 - max(committedoffset) AS offsets_behind
  FROM cursors GROUP BY 1, 2)"""

_COUNTS = f"""{_GOLD_CUSTOMERS},
s_transactions AS (
  SELECT _id, sender_account, receiver_account, amount, transaction_date FROM v_transactions),
flagged AS (SELECT _id FROM v_transactions WHERE {_hash('_id', 101, 'fraud:')} > 85),
counts AS (
  SELECT 'bronze' AS tier, 'transactions' AS series, count(*) AS value FROM v_transactions
  UNION ALL SELECT 'bronze', 'customers', count(*) FROM v_customers
  UNION ALL SELECT 'silver', 'profiles', count(*) FROM s_profiles
  UNION ALL SELECT 'silver', 'transactions', count(*) FROM s_transactions
  UNION ALL SELECT 'silver', 'customers', count(*) FROM s_customers
  UNION ALL SELECT 'gold', 'customers', count(*) FROM g_customers
  UNION ALL SELECT 'gold', 'transactions', count(*) FROM s_transactions
  UNION ALL SELECT 'gold', 'fraud_activity', count(*) FROM flagged)"""

_MONEY = """count(*) AS transactions,
  CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS total_amount,
  CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE / count(amount) AS average_amount,
  count(*) FILTER (WHERE fraud) AS fraud"""

_RAW = "_id, sender_account, receiver_account, amount, transaction_date"


def _merge(columns: str) -> str:
    return f"WITH {_LINES} SELECT coalesce(t._id, s._id) AS _id, {columns} FROM t FULL JOIN s ON t._id = s._id"


def _source_wins(c: str) -> str:
    return f"CASE WHEN s._id IS NOT NULL THEN s.{c} ELSE t.{c} END AS {c}"


_FLOW = f"""WITH {_TRANSACTIONS} SELECT _id, sender_account, receiver_account, amount, transaction_date,
  {_CATEGORIES}[1 + {_hash('_id', 10)}] AS category FROM v_transactions"""

ORACLE: dict[str, str] = {
    "customers_silver": f"WITH {_SILVER_CUSTOMERS} SELECT * FROM s_customers",
    "transactions_silver": f"WITH {_SILVER_TRANSACTIONS} SELECT * FROM s_transactions",
    "category_mod10": f"SELECT _id, category FROM ({_FLOW})",
    "profile_latest": f"WITH {_CUSTOMERS},{_TRANSACTIONS},{_PROFILES} SELECT * FROM s_profiles",
    "receiver_lookup": f"""WITH {_CUSTOMERS},{_TRANSACTIONS}
        SELECT t._id, t.receiver_account, c._id AS customer_id
        FROM v_transactions t JOIN v_customers c ON t.receiver_account = c.account_number""",
    "country_lookup": f"""WITH {_CUSTOMERS},{_COUNTRIES}
        SELECT c._id, c.country_code, coalesce(k.country, 'not found') AS country
        FROM v_customers c LEFT JOIN v_countries k ON c.country_code = k.country_code""",
    "county_fuzzy": f"""WITH {_CUSTOMERS},{_COUNTIES}
        SELECT c._id, c.county, m.iso3166_2 FROM v_customers c LEFT JOIN matches m ON c.county = m.county""",
    "part_name_contained": f"""
        WITH names AS (
          SELECT lower(trim(p_name)) AS name, min({_pad('p_partkey', 12)}) AS code
          FROM part GROUP BY p_name),
        wanted AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS county FROM part),
        ranked AS (
          SELECT county, code, CASE WHEN lower(county) = name THEN 50 ELSE 0 END
                 + greatest(5, 30 - 2 * (instr(name, lower(county)) - 1)) AS points
          FROM wanted JOIN names ON contains(name, lower(county)) WHERE county <> '')
        SELECT county, code AS iso3166_2 FROM ranked
        QUALIFY row_number() OVER (PARTITION BY county ORDER BY points DESC, code) = 1""",
    "mask_account": f"""WITH {_CUSTOMERS}
        SELECT _id, left(account_number, greatest(length(account_number) - 8, 0)) || '********' AS account_number,
               left(_id, greatest(length(_id) - 3, 0)) || '***' AS short_text,
               '********' AS birthdate, '****' AS current_location FROM v_customers""",
    "blank_accounts": f"""WITH {_SILVER_TRANSACTIONS}
        SELECT * REPLACE ('' AS sender_account, '' AS receiver_account) FROM s_transactions""",
    "gold_customers": f"WITH {_GOLD_CUSTOMERS} SELECT * FROM g_customers",
    "gold_transactions": f"WITH {_GOLD_TRANSACTIONS} SELECT * FROM g_transactions",
    "fraud_flagged": f"WITH {_GOLD_TRANSACTIONS} SELECT * FROM flagged",
    "fraud_count": f"""WITH {_TRANSACTIONS}
        SELECT count(*) FILTER (WHERE {_hash('_id', 101, 'fraud:')} > 85) AS fraud_count,
               count(*) FILTER (WHERE {_hash('_id', 101, 'fraud:')} <= 85) AS valid_count FROM v_transactions""",
    "pandas_scored": f"""WITH {_TRANSACTIONS}
        SELECT _id, CAST(floor(amount / 1000) AS BIGINT) % 101 AS score FROM v_transactions""",
    "gold_after_fraud": f"WITH {_GOLD_TRANSACTIONS} SELECT * FROM g_after",
    "gold_preserve_flags": f"WITH {_GOLD_TRANSACTIONS} SELECT * FROM g_after",
    "gold_flags_reset": f"WITH {_GOLD_TRANSACTIONS} SELECT * FROM g_transactions",
    "fraud_before_gold": f"WITH {_GOLD_TRANSACTIONS} SELECT *, CAST(NULL AS VARCHAR) AS category FROM flagged",
    "fraud_view": f"WITH {_GOLD_TRANSACTIONS} SELECT * FROM g_after WHERE fraud",
    "summary_category": f"WITH {_GOLD_TRANSACTIONS} SELECT category, {_MONEY} FROM g_after GROUP BY category",
    "summary_rollup": f"""WITH {_GOLD_TRANSACTIONS}
        SELECT category, strftime(to_timestamp(transaction_date) AT TIME ZONE 'UTC', '%Y-%m') AS month, {_MONEY}
        FROM g_after GROUP BY ROLLUP (category, month)""",
    "summary_country": f"""WITH {_GOLD_CUSTOMERS}
        SELECT country, count(*) AS customers, CAST(sum(score) AS BIGINT) AS total_score,
               count(*) FILTER (WHERE score > 85) AS high_scores FROM g_customers GROUP BY country""",
    "dedup_keep_last": """SELECT * FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
    "dedup_lineitem": f"""SELECT * FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER}) = 1""",
    "upsert_replace": _merge(
        f"{_source_wins('part')}, {_source_wins('quantity')}, "
        "CASE WHEN s._id IS NULL THEN t.status END AS status, s.tax"
    ),
    "merge_update": _merge(f"{_source_wins('part')}, {_source_wins('quantity')}, t.status, s.tax"),
    "merge_patch_nulls": _merge(
        "coalesce(s.part, t.part) AS part, coalesce(s.quantity, t.quantity) AS quantity, t.status, s.tax"
    ),
    "wide_column_puts": _merge(
        "coalesce(s.part, t.part) AS part, coalesce(s.quantity, t.quantity) AS quantity, t.status, s.tax"
    ),
    "reload_idempotent": f"WITH {_TRANSACTIONS} SELECT {_RAW} FROM v_transactions",
    "late_profiles": f"WITH {_CUSTOMERS},{_TRANSACTIONS},{_PROFILES} SELECT * FROM s_profiles",
    "customer_reload": f"""WITH {_CUSTOMERS}
        SELECT _id, CASE WHEN c_acctbal < 0 THEN 'COLLECTION' ELSE company END AS company, account_number
        FROM v_customers JOIN customer ON _id = CAST(c_custkey AS VARCHAR)""",
    "replayed_batches": _merge(f"{_source_wins('part')}, {_source_wins('quantity')}"),
    "table_history": """SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS date,
        CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS id, count(*) AS rows
        FROM events GROUP BY 2""",
    "schema_evolution": """
        SELECT o_orderkey, o_totalprice, o_orderstatus, CAST(NULL AS VARCHAR) AS o_orderpriority
        FROM orders WHERE o_orderstatus = 'F'
        UNION ALL
        SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority
        FROM orders WHERE o_orderstatus <> 'F'""",
    "json_decode": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "json_dead_letter": """
        WITH messages AS (
          SELECT CASE WHEN event_type = 'error' THEN left(props, length(props) - 1) ELSE props END AS raw FROM events)
        SELECT 'damaged' AS reason, raw, 'events' AS source FROM messages WHERE NOT json_valid(raw)""",
    "csv_decode": f"""WITH {_CUSTOMERS}
        SELECT * REPLACE (translate(address, chr(10) || chr(13), '  ') AS address) FROM v_customers""",
    "csv_file_scan": """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source,
        CAST(n_chars AS VARCHAR) AS n_chars, text FROM documents""",
    "csv_typed_scan": "SELECT * FROM part",
    "parquet_export": "SELECT * FROM supplier",
    "bi_table": f"WITH {_GOLD_TRANSACTIONS} SELECT * FROM g_after",
    "relational_columns": f"""WITH {_TRANSACTIONS}
        SELECT _id AS "ID", amount AS "Amount", transaction_date AS "TransactionDate" FROM v_transactions""",
    "clean_text": "SELECT doc_id, translate(text, chr(10) || chr(13), '  ') AS text FROM documents",
    "iso_ampm": "SELECT event_id, epoch_us(ts) // 1000 AS millis FROM events",
    "epoch_format": """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment,
        strftime(ts, '%H:%M:%S') AS clock FROM events""",
    "round_amounts": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 4 / 100, 2) AS fee FROM lineitem",
    "find_by_field": f"WITH {_CUSTOMERS} SELECT _id FROM v_customers WHERE company = 'BUILDING'",
    "find_by_id": f"WITH {_TRANSACTIONS} SELECT {_RAW} FROM v_transactions WHERE _id = '42'",
    "search_select_where": f"""WITH {_TRANSACTIONS} SELECT _id, amount FROM v_transactions
        WHERE (amount > 250000 AND receiver_account LIKE 'EXT%') OR NOT amount >= 2000""",
    "peek_15": f"WITH {_CUSTOMERS} SELECT _id, name, county FROM v_customers ORDER BY _id LIMIT 15",
    "tail_100": f"WITH {_TRANSACTIONS} SELECT {_RAW} FROM v_transactions ORDER BY seq DESC LIMIT 100",
    "tier_counts": f"WITH {_COUNTS} SELECT * FROM counts",
    "topic_progress": f"WITH {_CURSORS} SELECT * FROM progress",
    "consumer_lag": f"WITH {_CURSORS} SELECT * FROM lag",
    "lag_series": f"""WITH {_CURSORS}
        SELECT consumergroup || '_' || partitionid || '_lag(s)' AS series, CAST(trunc(lag_s) AS BIGINT) AS value FROM lag
        UNION ALL
        SELECT consumergroup || '_' || partitionid || '_offsetBehind', offsets_behind FROM lag""",
    "metrics_row": f"""WITH {_COUNTS},{_CURSORS},
        m AS (SELECT tier || '_' || replace(series, 'fraud_activity', 'fraud') AS metric, value FROM counts)
        SELECT (SELECT max(published) FROM progress) AS transactions_ingested,
               (SELECT min(processed) FROM progress) AS transactions_processed,
               """
    + ",\n               ".join(
        f"max(value) FILTER (WHERE metric = '{m}') AS {m}"
        for m in METRICS
        if not m.startswith("transactions_")
    )
    + " FROM m",
    "flattened_series": "SELECT 'events_' || event_type AS series, CAST(trunc(value) AS BIGINT) AS value FROM events",
    "metric_stream_filter": """SELECT 'cluster' || user_id % 3 AS name, strftime(ts, '%H:%M:%S') AS time,
               'app.' || event_type AS series, value
        FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup')""",
    "topic_round_trip": f"""WITH {_TRANSACTIONS}
        SELECT {_RAW}, seq AS "offset", _id AS message_key FROM v_transactions""",
    "stream_bronze": f"WITH {_TRANSACTIONS} SELECT {_RAW} FROM v_transactions",
    "stream_profiles": f"WITH {_CUSTOMERS},{_TRANSACTIONS},{_PROFILES} SELECT * FROM s_profiles",
    "stream_dead_letter": f"""WITH {_TRANSACTIONS}
        SELECT CASE WHEN receiver_account LIKE 'EXT%' THEN 'damaged' ELSE 'stored' END AS reason,
               count(*) AS messages FROM v_transactions GROUP BY 1""",
    "stream_flow_bronze": f"WITH {_TRANSACTIONS} SELECT {_RAW} FROM v_transactions",
    "stream_flow_silver": _FLOW,
    "stream_flow_relational": f"SELECT * REPLACE ('' AS sender_account, '' AS receiver_account) FROM ({_FLOW})",
    "file_to_topic": f"WITH {_TRANSACTIONS} SELECT {_RAW} FROM v_transactions",
    "file_to_topic_rejects": f"""WITH {_TRANSACTIONS}
        SELECT CASE WHEN receiver_account LIKE 'EXT%' THEN 'missing key' ELSE 'logged' END AS outcome,
               receiver_account FROM v_transactions""",
    "cdc_fraud": f"WITH {_GOLD_TRANSACTIONS} SELECT * FROM flagged",
    "medallion_customers": f"WITH {_GOLD_CUSTOMERS} SELECT * FROM g_customers",
    "medallion_transactions": f"WITH {_GOLD_TRANSACTIONS} SELECT * FROM g_after",
    "typed_customer_load": f"WITH {_CUSTOMERS} SELECT _id, name, mail, account_number, company, county FROM v_customers",
    "pandas_scored_nulls": f"""WITH {_TRANSACTIONS},
        scored AS (SELECT _id, CASE WHEN receiver_account NOT LIKE 'EXT%'
                   THEN CAST(floor(amount / 1000) AS BIGINT) % 101 END AS score FROM v_transactions)
        SELECT _id, score, coalesce(score > 85, false) AS fraud FROM scored""",
    "customers_renamed_id": f"WITH {_SILVER_CUSTOMERS} SELECT * FROM s_customers",
    "country_doubled_names": f"""WITH {_CUSTOMERS},{_COUNTRIES}
        SELECT c._id, c.country_code, coalesce(k.country, 'not found') AS country
        FROM v_customers c LEFT JOIN v_countries k ON c.country_code = k.country_code""",
    "csv_reordered_columns": f"WITH {_CUSTOMERS} SELECT * EXCLUDE (address) FROM v_customers",
    "csv_line_breaks": f"WITH {_CUSTOMERS} SELECT _id, address FROM v_customers",
    "load_rejects": f"""WITH {_CUSTOMERS}
        SELECT CASE WHEN CAST(_id AS BIGINT) % 7 = 0 THEN 'missing key' ELSE 'landed' END AS outcome,
               count(*) AS rows FROM v_customers GROUP BY 1""",
    "upsert_repeated_keys": f"""SELECT CAST(l_orderkey AS VARCHAR) AS _id, l_linenumber, l_shipdate, l_quantity
        FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) = 1""",
    "bi_table_preview": f"WITH {_GOLD_TRANSACTIONS} SELECT * FROM g_transactions ORDER BY _id LIMIT 10",
    "tail_with_total": f"""WITH {_TRANSACTIONS}
        SELECT _id, (SELECT count(*) FROM v_transactions) AS total FROM v_transactions ORDER BY seq DESC LIMIT 100""",
    "stream_bronze_extra_fields": f"""WITH {_TRANSACTIONS}
        SELECT _id, CASE WHEN amount > 150000 THEN 'USD' ELSE 'GBP' END AS currency FROM v_transactions""",
    "profiles_tied_times": f"""WITH {_CUSTOMERS},{_TRANSACTIONS}
        SELECT c._id, {_hash('t._id', 101, 'profile:')} AS score
        FROM v_transactions t JOIN v_customers c ON t.receiver_account = c.account_number
        QUALIFY row_number() OVER (PARTITION BY c._id ORDER BY seq // 64 DESC, seq % 4 DESC, seq DESC) = 1""",
    "file_to_topic_bad_values": f"""WITH {_TRANSACTIONS}
        SELECT CASE WHEN receiver_account LIKE 'EXT%' THEN 'bad value' ELSE 'sent' END AS outcome,
               receiver_account LIKE 'EXT%' AS no_amount, count(*) AS rows FROM v_transactions GROUP BY ALL""",
}
