"""The service's tables as views over the test tables; each also as SQL for the oracle.

The texts are written once; `{...}` marks what the two dialects spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DIALECTS = {
    "spark": {"day": "DATE '{}'", "plus_days": "date_add({}, CAST({} AS INT))", "plus_minutes": "timestampadd(MINUTE, CAST({} AS INT), TIMESTAMP_NTZ '{}')", "bytes": "encode({}, 'UTF-8')"},
    "duckdb": {"day": "DATE '{}'", "plus_days": "({} + CAST({} AS INT))", "plus_minutes": "(TIMESTAMP '{1}' + to_minutes(CAST({0} AS INT)))", "bytes": "encode({})"},
}

VIEWS = {
    "users": """
        SELECT c_custkey AS id, c_name AS username, concat('u', c_custkey, '@example.com') AS email,
          CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('Person ', c_custkey) END AS full_name,
          CASE WHEN c_custkey % 100 = 0 THEN 'super_user' WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'user' END AS role,
          c_custkey % 7 <> 0 AS is_active, CAST(c_custkey % 5 AS INT) AS free_ocr_used,
          c_nationkey * 10 AS subscription_pages_total, CAST(c_custkey % 120 AS INT) AS subscription_pages_used
        FROM customer""",
    "payment_history": """
        SELECT o_orderkey AS id, o_custkey AS user_id, concat(o_custkey, '-', lpad(hex(o_orderkey), 12, '0')) AS invoice_number,
          CAST(o_orderkey % 500 + 1 AS INT) AS pages_purchased, CAST((o_orderkey % 500 + 1) * 10 AS DOUBLE) AS payment_amount, 'BDT' AS currency,
          CASE WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderstatus = 'O' THEN 'pending'
            WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'failed' ELSE 'cancelled' END AS status,
          o_orderdate AS created_at
        FROM orders""",
    "payment_callbacks": """
        SELECT e.event_id AS callback_id, e.ts AS received_at,
          CASE WHEN e.event_id % 29 = 0 OR o.o_orderkey IS NULL THEN 'no-such-invoice' ELSE concat(o.o_custkey, '-', lpad(hex(o.o_orderkey), 12, '0')) END AS invoice_number,
          CASE WHEN e.event_id % 5 = 0 THEN 'Failed' WHEN e.event_id % 7 = 0 THEN 'Canceled' ELSE ' Successful ' END AS reported_status,
          CASE WHEN e.event_id % 3 = 0 THEN NULL WHEN e.event_id % 11 = 0 THEN -1.0 ELSE CAST((o.o_orderkey % 500 + 1) * 10 AS DOUBLE) END AS reported_amount
        FROM (SELECT *, event_id % greatest(1, (SELECT CAST(floor(count(*) / 20) AS BIGINT) FROM events)) AS billed FROM events) e
          LEFT JOIN orders o ON o.o_orderkey = e.billed""",
    "enterprises": """
        SELECT p_partkey AS id, p_name AS name, p_size * 20 AS total_pages, CAST(5 + p_partkey % 11 AS DOUBLE) AS unit_price,
          CAST((p_partkey % 15) * 10 AS BIGINT) AS created_by,
          CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE {plus_days:{day:2024-01-01}|p_partkey % 365} END AS start_date,
          CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE {plus_days:{day:2024-06-01}|p_partkey % 200} END AS end_date,
          CAST(p_size * 20 * (5 + p_partkey % 11) * (p_partkey % 3) AS DOUBLE) / 2 AS advance_bill, p_partkey % 13 = 0 AS is_deleted
        FROM part""",
    "enterprise_ocr_documents": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS enterprise_id, l_suppkey AS processed_by, CAST(l_quantity AS INT) AS total_pages,
          60 + l_discount * 400 AS confidence, l_shipdate AS created_at
        FROM lineitem""",
    "ocr_documents": """
        SELECT doc_id AS id, doc_id % greatest(1, (SELECT CAST(floor(count(*) / 10) AS BIGINT) FROM customer)) AS user_id, concat(source, '_', doc_id, '.pdf') AS filename,
          CASE WHEN doc_id % 3 = 0 THEN 'Mistral OCR' ELSE 'Google Document AI' END AS ocr_engine,
          lang, text AS extracted_text, n_chars AS character_count, CAST(doc_id % 6 + 1 AS INT) AS total_pages, doc_id % 17 = 0 AS is_deleted,
          CAST(doc_id % 23 AS DOUBLE) AS processing_time, {plus_minutes:doc_id % 400|2024-01-01 00:00:00} AS created_at
        FROM documents""",
    "page_results": "SELECT conv_id AS document_id, CAST(turn + 1 AS INT) AS page_number, text FROM conversations",
    "ocr_requests": """
        SELECT event_id AS request_id, ts AS requested_at, user_id, CAST(CASE WHEN event_id % 3 = 0 THEN 1 + event_id % 9 ELSE 1 END AS INT) AS pages_needed,
          CAST(CASE WHEN event_id % 41 = 0 THEN 0 WHEN event_id % 43 = 0 THEN 104857601 ELSE floor(value) * 100000 END AS BIGINT) AS file_size
        FROM events""",
    "trial_requests": """
        SELECT event_id AS request_id, ts AS requested_at, concat('10.0.', user_id % 10, '.', user_id) AS ip_address,
          CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'bn-BD' END AS accept_language, CASE WHEN event_id % 2 = 0 THEN NULL ELSE concat('ck-', user_id) END AS cookie_id
        FROM events""",
    "contract_forms": """
        SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 0 THEN '' WHEN p_partkey % 51 = 0 THEN NULL WHEN p_partkey % 53 = 0 THEN repeat('x', 256) ELSE p_name END AS name,
          CASE WHEN p_partkey % 17 = 0 THEN repeat('0', 51) WHEN p_partkey % 2 = 0 THEN '0170' END AS phone,
          CASE WHEN p_partkey % 19 = 0 THEN 'no address' WHEN p_partkey % 7 = 0 THEN concat('c', p_partkey, '@example.com') END AS email,
          CASE WHEN p_partkey % 23 = 0 THEN 0 WHEN p_partkey % 59 = 0 THEN NULL ELSE p_size * 20 END AS total_pages,
          CAST(CASE WHEN p_partkey % 29 = 0 THEN -1 WHEN p_partkey % 9 = 0 THEN NULL ELSE 5 + p_partkey % 11 END AS DOUBLE) AS unit_price,
          CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE {plus_days:{day:2024-01-01}|p_partkey % 365} END AS start_date,
          CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE {plus_days:{day:2024-06-01}|p_partkey % 200} END AS end_date,
          CAST(CASE WHEN p_partkey % 31 = 0 THEN -5 WHEN p_partkey % 10 = 3 THEN NULL ELSE p_size * 20 * (5 + p_partkey % 11) * (p_partkey % 5) END AS DOUBLE) / 4 AS advance_bill,
          CASE WHEN p_partkey % 43 = 0 THEN -1 ELSE CAST(p_partkey % 9 AS INT) END AS no_of_documents,
          CASE p_partkey % 5 WHEN 0 THEN 'paid' WHEN 1 THEN 'partial_paid' WHEN 2 THEN 'due' WHEN 3 THEN CASE WHEN p_partkey % 4 = 0 THEN 'unpaid' END END AS payment_status
        FROM part""",
    "payment_forms": """
        SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 0 WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 500 + 1 AS INT) END AS pages,
          CASE WHEN o_orderkey % 11 = 0 THEN 'x' WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN repeat('n', 101) ELSE concat('Person ', o_custkey) END AS cust_name,
          CASE WHEN o_orderkey % 7 = 0 THEN '123456' WHEN o_orderkey % 29 = 0 THEN repeat('1', 21) ELSE '01700000000' END AS cust_phone,
          CASE WHEN o_orderkey % 31 = 0 THEN repeat('a', 256) WHEN o_orderkey % 2 = 0 THEN 'street' END AS cust_address
        FROM orders""",
    "account_forms": """
        SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN 'ab' WHEN c_custkey % 17 = 0 THEN repeat('u', 51) WHEN c_custkey % 19 = 0 THEN NULL ELSE c_name END AS username,
          CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'a@b' WHEN 2 THEN 'a b@example.com' WHEN 3 THEN concat('x.y+', c_custkey, '@mail.example.org') ELSE concat('u', c_custkey, '@example.com') END AS email,
          CASE WHEN c_custkey % 23 = 0 THEN repeat('f', 256) WHEN c_custkey % 2 = 0 THEN 'Full' END AS full_name,
          CASE c_custkey % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'ENTERPRISE' WHEN 2 THEN 'super_user' WHEN 3 THEN 'user' END AS role
        FROM customer""",
    "raw_files": """
        SELECT doc_id AS file_id, unhex(concat(CASE doc_id % 10 WHEN 0 THEN '255044462D312E37' WHEN 1 THEN 'FFD8FFE0' WHEN 2 THEN '89504E470D0A1A0A'
            WHEN 3 THEN '474946383961' WHEN 4 THEN '424D' WHEN 5 THEN '524946460000000057454250' WHEN 6 THEN '49492A00'
            WHEN 7 THEN '4D4D002A' WHEN 8 THEN '00' ELSE '' END, hex({bytes:text}))) AS content
        FROM documents""",
}


def spelled(sql: str, dialect: str) -> str:
    """The text with its marks filled in, innermost first."""
    forms = DIALECTS[dialect]
    while found := re.search(r"\{(\w+):([^{}]*)\}", sql):
        sql = sql[: found.start()] + forms[found[1]].format(*found[2].split("|")) + sql[found.end() :]
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, or a view over them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = spelled(VIEWS[name], "spark")
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", rf"\1 parquet.`{sf_dir}/\2.parquet` AS \2", text).replace(" AS events e", " e").replace(" AS orders o", " o"))


def oracle(sql: str) -> str:
    """SQL for the oracle, with the views that it names in front."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    heads = ", ".join(f"{n} AS ({spelled(VIEWS[n], 'duckdb')})" for n in used)
    body = sql.strip()
    if not heads:
        return body
    return re.sub(r"^WITH (RECURSIVE )?", lambda m: f"WITH {m[1] or ''}{heads}, ", body) if body.startswith("WITH") else f"WITH {heads} {body}"
