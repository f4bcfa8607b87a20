"""Views of the driver tables in the shape of memory data, one SQL text for Spark and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from recollect.sources.tables import table

TABLES = ("documents", "labels", "customer", "orders", "lineitem", "part", "supplier", "nation", "region", "events", "conversations", "embeddings", "benchmark", "pages")

VIEWS = {
    "v_items": """
        SELECT concat('doc-', CAST(d.doc_id AS STRING)) AS item_id, d.text AS content,
               CASE d.doc_id % 9 WHEN 0 THEN 'pending' WHEN 1 THEN 'semantic' WHEN 2 THEN 'episodic' WHEN 3 THEN 'procedural' WHEN 4 THEN 'zettel'
                    WHEN 5 THEN 'reasoning' WHEN 6 THEN 'opinion' WHEN 7 THEN 'observation' ELSE 'decision' END AS memory_type,
               CASE WHEN l.quality = 1 THEN 0.9e0 WHEN l.quality = 0 THEN 0.4e0 ELSE 1.0e0 END AS confidence,
               coalesce(l.toxic, 0) = 1 AS stale, d.source = 'src0' AS reference,
               CASE d.doc_id % 7 WHEN 0 THEN 'cli:add' WHEN 1 THEN 'hook:observe' WHEN 2 THEN 'structured:tool_call' WHEN 3 THEN 'code:index'
                    WHEN 4 THEN 'seed:demo' WHEN 5 THEN 'unknown' ELSE NULL END AS origin,
               CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE concat('ws_', CAST(d.doc_id % 4 AS STRING)) END AS workspace_id,
               d.doc_id AS created_seq
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_nodes": """
        SELECT item_id, memory_type, content, content AS label, CAST(NULL AS STRING) AS node_category, reference, confidence FROM v_items
        UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), 'semantic', c_name, c_name, NULL, FALSE, 1.0e0 FROM customer
        UNION ALL SELECT concat('o', CAST(o_orderkey AS STRING)), CASE WHEN o_orderkey % 50 = 0 THEN 'Version' ELSE 'episodic' END, NULL, o_orderpriority, NULL, FALSE, 1.0e0 FROM orders
        UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), NULL, p_name, p_name, NULL, FALSE, 1.0e0 FROM part
        UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), 'semantic', s_name, s_name, NULL, FALSE, 1.0e0 FROM supplier
        UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), 'entity', n_name, n_name, 'entity', FALSE, 1.0e0 FROM nation
        UNION ALL SELECT concat('r', CAST(r_regionkey AS STRING)), 'concept', r_name, r_name, 'entity', FALSE, 1.0e0 FROM region""",
    "v_edges": """
        SELECT concat('c', CAST(o_custkey AS STRING)) AS source_id, concat('o', CAST(o_orderkey AS STRING)) AS target_id, CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE 'PLACED' END AS edge_type FROM orders
        UNION ALL SELECT concat('o', CAST(l_orderkey AS STRING)), concat('p', CAST(l_partkey AS STRING)), 'CONTAINS' FROM lineitem
        UNION ALL SELECT concat('p', CAST(l_partkey AS STRING)), concat('s', CAST(l_suppkey AS STRING)), 'SUPPLIED_BY' FROM lineitem
        UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)), 'IN' FROM customer
        UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('c', CAST(c_custkey AS STRING)), 'SELF' FROM customer WHERE c_custkey % 97 = 0""",
    "v_pattern_log": "SELECT p_partkey AS seq, p_name AS name, p_type AS label, (800 + p_size) / 1000e0 AS confidence, 1 AS cnt, p_brand AS source FROM part",
    "v_jobs": """
        SELECT event_id AS id, concat('item-', CAST(user_id AS STRING)) AS item_id, CAST(event_id * 10 AS BIGINT) AS enqueued_at,
               CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' ELSE 'failed' END AS status FROM events""",
    "v_spans": """
        SELECT event_id, CASE event_type WHEN 'click' THEN 'add_node' WHEN 'view' THEN 'add_edge' ELSE event_type END AS operation,
               concat('t', CAST(user_id AS STRING)) AS trace_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('s', CAST(event_id AS STRING)) END AS span_id, value, props FROM events""",
    "v_mutations": """
        SELECT concat('i', CAST(o_custkey AS STRING)) AS item_id, o_orderkey AS tx_seq,
               CASE o_orderkey % 8 WHEN 0 THEN 'put' WHEN 1 THEN 'replace' WHEN 2 THEN 'delete' ELSE 'merge' END AS op,
               CAST(o_orderkey % 5 AS STRING) AS k, o_orderpriority AS v FROM orders""",
}
_NEEDS = {name: [v for v in VIEWS if v != name and re.search(rf"\b{v}\b", text)] for name, text in VIEWS.items()}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a lazy DataFrame."""
    text = VIEWS[name]
    frames = {v: view(spark, sf_dir, v) for v in _NEEDS[name]}
    frames |= {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", text)}
    for t in frames:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **frames)


def with_views(sql: str) -> str:
    """SQL text preceded by the views it names."""
    used: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS[name]:
            add(other)
        if name not in used:
            used.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    heads = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in used)
    body = sql.strip()
    if not heads:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads},\n{body[15:]}"
    return f"WITH {heads},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {heads}\n{body}"
