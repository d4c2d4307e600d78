"""The driver's tables as model tables, in Spark and, for the oracle, as SQL views.

Derivations are row-wise and deterministic, so both engines read the same rows.
Duplicate e-mails and telephone numbers come in small groups whose size does not
grow with the table.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load

#: The moment the derived tables are looked at.
NOW = "2024-01-20 00:00:00"

#: Views in the SQL that both Spark and DuckDB read; each may use those before it.
VIEWS: dict[str, str] = {
    "contacts": """
        SELECT c_custkey AS id, c_nationkey AS workspace_id, c_name AS first_name, c_mktsegment AS company,
            CASE WHEN c_custkey % 5 <> 0 THEN concat(' User', CAST(floor(c_custkey / 3.0) AS BIGINT), '@Example.com ') END AS email,
            CASE WHEN c_custkey % 4 <> 0 THEN concat('04', lpad(CAST(CAST(floor((c_custkey + 1) / 2.0) AS BIGINT) AS VARCHAR(20)), 8, '0')) END AS phone,
            CASE WHEN c_nationkey % 2 = 0 THEN 'AU' ELSE 'US' END AS region,
            c_custkey % 11 = 0 AS is_deleted, c_custkey % 13 = 0 AS is_merged, c_custkey % 17 = 0 AS is_erased,
            CASE WHEN c_custkey % 13 = 0 AND c_custkey > 0 THEN c_custkey - 1 END AS merged_into
        FROM customer""",
    "opportunities": """
        SELECT o_orderkey AS id, o_custkey AS contact_id, c.c_nationkey AS workspace_id, o_orderpriority AS stage,
            CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'won' ELSE 'lost' END AS status,
            CAST(round(o_totalprice * 100) AS BIGINT) AS value_minor, o_orderdate AS created_at
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "touches": """
        SELECT event_id AS id, user_id AS contact_id, ts AS captured_at,
            CASE WHEN event_id % 7 = 0 THEN concat('g', event_id) END AS gclid,
            CASE WHEN event_id % 11 = 1 THEN concat('f', event_id) END AS fbclid,
            CASE event_id % 5 WHEN 0 THEN 'CPC' WHEN 1 THEN 'email' WHEN 2 THEN 'social' END AS utm_medium,
            CASE event_id % 6 WHEN 0 THEN 'google' WHEN 1 THEN 'Facebook' WHEN 2 THEN 'newsletter' END AS utm_source,
            CASE event_id % 9 WHEN 0 THEN 'spring' END AS utm_campaign,
            CASE event_id % 8 WHEN 0 THEN 'https://www.google.com' WHEN 1 THEN 'https://m.facebook.com/' WHEN 2 THEN 'https://blog.example.org'
                WHEN 3 THEN 'https://notgoogle.com' WHEN 4 THEN '/relative' WHEN 5 THEN 'duckduckgo.com' END AS referrer
        FROM events""",
    "tasks": """
        SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS contact_id, l_orderkey AS opportunity_id, o_orderpriority AS priority,
            CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'done' END AS status, CASE WHEN l_partkey % 10 <> 0 THEN l_shipdate END AS due_at
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "graph_pages": """
        SELECT 1 AS crawl_id, p_partkey AS page_id, concat('https://site.test/p/', p_partkey) AS url, p_size % 10 AS depth,
            CASE p_size % 6 WHEN 0 THEN 'redirected' WHEN 1 THEN 'unchanged' ELSE 'fetched' END AS outcome
        FROM part""",
    "graph_links": """
        SELECT 1 AS crawl_id, l_partkey AS source_page_id, concat('https://site.test/p/', next_part) AS target_url,
            CASE l_returnflag WHEN 'R' THEN 'external' ELSE 'internal' END AS scope
        FROM (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_suppkey) AS next_part FROM lineitem) x
        WHERE l_quantity >= 48 AND next_part IS NOT NULL""",
    "submissions": """
        SELECT event_id AS id, user_id AS subject, event_type AS form, ts, value,
            CASE WHEN event_id % 10 = 0 THEN 'rejected' ELSE 'accepted' END AS outcome,
            CASE event_id % 40 WHEN 0 THEN 'honeypot' WHEN 10 THEN 'too_fast' WHEN 20 THEN 'rate_limited' WHEN 30 THEN 'origin' END AS rejection_reason
        FROM events""",
    "outputs": """
        SELECT doc_id AS id, lang AS workspace_id, source <> 'src0' AS published, text, n_chars FROM documents""",
}


TABLES = ("customer", "orders", "events", "lineitem", "part", "documents")


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named model tables over one directory of driver tables; the session's own views stay as they are."""
    own = f"marlpit_{uuid.uuid4().hex}_"
    for name in TABLES:
        load(spark, sf_dir, name).createOrReplaceTempView(own + name)
    out = [spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", rf"\1 {own}\2", VIEWS[name])) for name in names]
    for name in TABLES:
        spark.catalog.dropTempView(own + name)
    return out


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL: the views as common table expressions before a query."""
    own = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    begins = re.match(r"\s*WITH( RECURSIVE)? ", sql)
    return f"WITH{begins[1] or ''} {own}, {sql[begins.end() :]}" if begins else f"WITH {own} {sql}"
