"""Registered queries over the driver tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import scalar as X
from recollect.operators import events, evolve, graph, mutations, patterns, predicates, queue, recall, search, sessions
from recollect.sources.tables import table

from .adapters import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
STRIP = r"regexp_replace(regexp_replace(coalesce({0}, ''), '^\s+', ''), '\s+$', '')"
LIVE = "edge_type IS NOT NULL AND source_id <> target_id"
TIER12 = "(origin IS NULL OR origin = '' OR origin LIKE 'cli:%' OR origin LIKE 'user:%' OR origin LIKE 'code:%' OR origin LIKE 'unknown%')"
SCOPE = f"{TIER12} AND coalesce(workspace_id = 'ws_1', TRUE) AND coalesce(confidence, 1.0) >= 0.3 AND NOT coalesce(reference, FALSE) AND memory_type IS DISTINCT FROM 'snapshot' AND {STRIP.format('content')} <> ''"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


@query("SELECT item_id, memory_type, coalesce(content, label, '') AS content FROM v_nodes WHERE coalesce(memory_type, '') NOT IN ('Version', 'entity', 'relation', 'pattern') AND coalesce(node_category, '') NOT IN ('entity', 'relation') AND NOT coalesce(reference, FALSE)")
def wildcard_list(spark, d):
    n = view(spark, d, "v_nodes").where(predicates.not_internal() & predicates.not_reference())
    return n.select("item_id", "memory_type", F.coalesce("content", "label", F.lit("")).alias("content"))


@query("SELECT item_id FROM v_items WHERE memory_type = 'decision' AND workspace_id = 'ws_1'")
def property_filter(spark, d):
    items = view(spark, d, "v_items").withColumn("props", F.create_map(F.lit("workspace_id"), F.col("workspace_id"))).drop("workspace_id")
    return items.where(predicates.has_properties(items, {"memory_type": "decision", "workspace_id": "ws_1"})).select("item_id")


@query(f"SELECT item_id, origin FROM v_items WHERE {TIER12}")
def tier_filter(spark, d):
    return view(spark, d, "v_items").where(predicates.in_tiers()).select("item_id", "origin")


@query("SELECT item_id FROM v_items WHERE coalesce(workspace_id = 'ws_1', TRUE)")
def workspace_scope(spark, d):
    return view(spark, d, "v_items").where(predicates.in_workspace("ws_1")).select("item_id")


@query("SELECT item_id FROM v_items WHERE workspace_id = 'ws_1'")
def workspace_strict(spark, d):
    return view(spark, d, "v_items").where(predicates.in_workspace("ws_1", strict=True)).select("item_id")


@query("SELECT item_id, confidence FROM v_items WHERE coalesce(confidence, 1.0) >= 0.5")
def confidence_floor(spark, d):
    return view(spark, d, "v_items").where(predicates.confident(0.5)).select("item_id", "confidence")


RECALL = f"""
WITH s AS (SELECT *, {STRIP.format('content')} AS body FROM v_items WHERE {SCOPE}),
u AS (SELECT *, row_number() OVER (PARTITION BY memory_type, lower(substring(body, 1, 120)) ORDER BY created_seq DESC, item_id) AS n FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY created_seq DESC, item_id) AS rank FROM u WHERE n = 1)
"""


@query(RECALL + "SELECT item_id, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10")
def recall_recent(spark, d):
    return recall.recall(view(spark, d, "v_items"), 10, "ws_1").select("item_id", "rank")


@query(RECALL + "SELECT CAST(rank AS BIGINT) AS rank, item_id, concat('- ', CASE WHEN stale THEN '⚠' ELSE '' END, CASE WHEN confidence < 0.5 THEN '~' ELSE '' END, '[', memory_type, '] ', substring(body, 1, 200)) AS line FROM r WHERE rank <= 10")
def recall_lines(spark, d):
    return recall.recall(view(spark, d, "v_items"), 10, "ws_1")


@query("SELECT event_id, (86400 * 45 + 3600 * 1 - (event_id % 60) * 86400) / 86400 IS NOT NULL AND CAST(floor((event_id % 60 * 86400 + 3600) / 86400) AS BIGINT) <= 7 AS fresh FROM events")
def snapshot_fresh(spark, d):
    e = table(spark, d, "events")
    now = F.to_timestamp(F.lit("2024-03-01T01:00:00Z"))
    at = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit("2024-03-01T00:00:00Z"))) - F.col("event_id") % 60 * 86400), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return e.select("event_id", X.fresh(at, now).alias("fresh"))


@query("SELECT item_id, coalesce(memory_type, 'semantic') AS memory_type, coalesce(label, '') AS label, coalesce(content, '') AS content, coalesce(confidence, 1.0) AS confidence FROM v_nodes")
def flatten_nodes(spark, d):
    return view(spark, d, "v_nodes").select("item_id", F.coalesce("memory_type", F.lit("semantic")).alias("memory_type"), F.coalesce("label", F.lit("")).alias("label"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


SNAP = "WITH k AS (SELECT item_id FROM v_nodes WHERE memory_type IS DISTINCT FROM 'Version'), e AS (SELECT * FROM v_edges WHERE source_id IN (SELECT item_id FROM k) AND target_id IN (SELECT item_id FROM k))"


@query(SNAP + " SELECT coalesce(edge_type, 'none') AS edge_type, count(*) AS n FROM e GROUP BY 1")
def graph_full_edges(spark, d):
    e = graph.snapshot_edges(view(spark, d, "v_nodes"), view(spark, d, "v_edges"))
    return e.groupBy(F.coalesce("edge_type", F.lit("none")).alias("edge_type")).agg(F.count(F.lit(1)).alias("n"))


@query(SNAP + " SELECT (SELECT count(*) FROM k) AS node_count, (SELECT count(*) FROM e) AS edge_count")
def graph_counts(spark, d):
    nodes, edges = view(spark, d, "v_nodes"), view(spark, d, "v_edges")
    found = graph.snapshot_edges(nodes, edges).agg(F.count(F.lit(1)).alias("edge_count"))
    return nodes.where(predicates.not_version()).agg(F.count(F.lit(1)).alias("node_count")).withColumn("edge_count", found.scalar())


@query("SELECT DISTINCT source_id, target_id, edge_type FROM v_edges WHERE source_id IN ('c1', 'p7', 'o3') OR target_id IN ('c1', 'p7', 'o3')")
def edges_bulk(spark, d):
    return graph.edges_of(view(spark, d, "v_edges"), ["c1", "p7", "o3"])


@query("SELECT count(*) AS n FROM (SELECT DISTINCT source_id, target_id, edge_type FROM v_edges)")
def edges_distinct(spark, d):
    return graph.distinct_edges(view(spark, d, "v_edges")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT target_id AS other, edge_type, 'outgoing' AS direction FROM v_edges WHERE source_id = 'p7' AND {LIVE} UNION SELECT DISTINCT source_id, edge_type, 'incoming' FROM v_edges WHERE target_id = 'p7' AND {LIVE}")
def neighbors_direction(spark, d):
    return graph.neighbours(view(spark, d, "v_edges"), "p7")


@query("SELECT item_id FROM v_nodes ORDER BY item_id LIMIT 200 OFFSET 200")
def list_page(spark, d):
    return graph.page(view(spark, d, "v_nodes").select("item_id"), 200, 200)


@query(f"WITH RECURSIVE hop AS (SELECT 'c1' AS item_id, 0 AS hops UNION SELECT e.target_id, hops + 1 FROM hop JOIN v_edges e ON e.source_id = hop.item_id WHERE hops < 3 AND e.edge_type IS NOT NULL AND e.source_id <> e.target_id) SELECT item_id, CAST(min(hops) AS BIGINT) AS hops FROM hop GROUP BY item_id")
def multi_hop(spark, d):
    return graph.within_hops(view(spark, d, "v_edges"), "c1", 3).select("item_id", F.col("hops").cast("bigint").alias("hops"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def substring_search(spark, d):
    return table(spark, d, "documents").where(predicates.mentions("License", "text")).select("doc_id")


@query("SELECT item_id, 'cli:retag' AS origin FROM v_items WHERE contains(lower(content), 'license') ORDER BY item_id LIMIT 100")
def retag_preview(spark, d):
    return view(spark, d, "v_items").where(predicates.mentions("license")).orderBy("item_id").limit(100).select("item_id", F.lit("cli:retag").alias("origin"))


BM25 = """
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
g AS (SELECT count(*) AS n, avg(len(w)) AS al FROM t),
h AS (SELECT doc_id, any_value(len) AS len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM t) WHERE term IN ('thing', 'attion', 'erble') GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
b AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))) AS score FROM h JOIN f USING (term), g GROUP BY doc_id)
"""


@query(BM25 + "SELECT doc_id, round(score, 4) AS score FROM b ORDER BY round(score, 4) DESC, doc_id LIMIT 10")
def bm25_top(spark, d):
    s = search.bm25(table(spark, d, "documents"), ["thing", "attion", "erble"]).select("doc_id", F.round("score", 4).alias("score"))
    return s.orderBy(F.col("score").desc(), "doc_id").limit(10)


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY quality DESC, toxic, doc_id) AS rank FROM labels),
u AS (SELECT * FROM a WHERE rank <= 100 UNION ALL SELECT * FROM b WHERE rank <= 100)
SELECT doc_id, round(sum(1.0e0 / (60 + rank)), 6) AS score FROM u GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 5""")
def rrf_top(spark, d):
    a = search.ranked(table(spark, d, "documents"), "doc_id", F.col("n_chars").desc(), "doc_id", depth=100)
    b = search.ranked(table(spark, d, "labels"), "doc_id", F.col("quality").desc(), "toxic", "doc_id", depth=100)
    return search.fuse([a, b], "doc_id").select("doc_id", F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(5)


@query("""SELECT query_id, vec_id, score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 10""")
def knn_top(spark, d):
    v = table(spark, d, "embeddings")
    return search.knn_join(v, v.where("vec_id % 50 = 0"), 10).withColumn("rank", F.col("rank").cast("bigint"))


@query("""SELECT vec_id, next_id, score FROM (SELECT vec_id, lead(vec_id) OVER w AS next_id, round(list_cosine_similarity(embedding::DOUBLE[], (lead(embedding) OVER w)::DOUBLE[]), 6) AS score FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))
WHERE next_id IS NOT NULL AND score >= 0.1""")
def cosine_pairs(spark, d):
    return search.near_pairs(table(spark, d, "embeddings"), "label", 0.1)


@query("""WITH RECURSIVE t AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
g AS (SELECT label, vec_id, n, e AS last, TRUE AS fires FROM t WHERE n = 1 UNION ALL
SELECT t.label, t.vec_id, t.n, CASE WHEN list_cosine_similarity(t.e, g.last) < 0.1 THEN t.e ELSE g.last END, list_cosine_similarity(t.e, g.last) < 0.1 FROM g JOIN t ON t.label = g.label AND t.n = g.n + 1)
SELECT vec_id, fires FROM g""")
def topic_gate(spark, d):
    return sessions.topic_gate(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.1).select("vec_id", "fires")


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], prev::DOUBLE[]), 6) < 0.0 AS changed FROM (SELECT vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings) WHERE prev IS NOT NULL")
def topic_change(spark, d):
    w = Window.partitionBy("label").orderBy("vec_id")
    v = table(spark, d, "embeddings").withColumn("prev", F.lag("embedding").over(w)).where("prev IS NOT NULL")
    return v.select("vec_id", (F.round(X.cosine(F.col("embedding"), F.col("prev")), 6) < 0.0).alias("changed"))


FOLD = "WITH f AS (SELECT lower(name) AS key, arg_min(name, seq) AS name, arg_min(label, seq) AS label, arg_min(source, seq) AS source, max(confidence) AS confidence, CAST(arg_min(cnt, seq) + count(*) - 1 AS BIGINT) AS frequency FROM v_pattern_log GROUP BY 1)"


@query(FOLD + " SELECT key, name, label, source, confidence, frequency FROM f")
def pattern_fold(spark, d):
    return patterns.fold(view(spark, d, "v_pattern_log"))


@query(FOLD + " SELECT key, frequency FROM f WHERE frequency >= 2 AND length(name) >= 2 AND key NOT IN (SELECT lower(min(p_name)) FROM part)")
def pattern_gate(spark, d):
    first = table(spark, d, "part").agg(F.lower(F.min("p_name"))).first()[0]
    return patterns.quality(patterns.active(patterns.fold(view(spark, d, "v_pattern_log"))), (first,)).select("key", "frequency")


@query("WITH s AS (SELECT name, label, seq, row_number() OVER (PARTITION BY lower(name) ORDER BY seq) AS n FROM (SELECT lower(s_name) AS name, 'ORG' AS label, s_suppkey AS seq FROM supplier UNION ALL SELECT p_name, p_type, p_partkey + 1000000 FROM part)) SELECT name, label, seq FROM s WHERE n = 1 AND lower(name) NOT IN (SELECT lower(p_name) FROM part)")
def seed_anti_join(spark, d):
    part, supplier = table(spark, d, "part"), table(spark, d, "supplier")
    seeds = supplier.select(F.lower("s_name").alias("name"), F.lit("ORG").alias("label"), F.col("s_suppkey").alias("seq")).unionByName(part.select(F.col("p_name").alias("name"), F.col("p_type").alias("label"), (F.col("p_partkey") + 1000000).alias("seq")))
    return patterns.new_seeds(seeds, part.select(F.col("p_name").alias("name")))


GAZ = """WITH g AS (SELECT name, CAST(count(*) AS BIGINT) AS frequency, CASE length(name) % 4 WHEN 0 THEN 'CONCEPT' WHEN 1 THEN 'TOOL' WHEN 2 THEN 'PERSON' ELSE 'PLACE' END AS label
FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM benchmark) WHERE length(name) >= 5 GROUP BY name),
m AS (SELECT DISTINCT t.doc_id, t.name, g.label FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM documents) t JOIN g ON t.name = g.name WHERE g.frequency >= 2)"""


def _matches(spark, d):
    names = patterns.active(patterns.gazetteer(table(spark, d, "benchmark")))
    return patterns.match(table(spark, d, "documents"), names)


@query(GAZ + " SELECT doc_id, name, label FROM m")
def entity_ruler(spark, d):
    return _matches(spark, d)


@query(GAZ + ", p AS (SELECT concat('doc-', doc_id::VARCHAR) AS item, substring(sha256(concat(lower(name), '|', lower(label))), 1, 16) AS ent FROM m) SELECT item AS source_id, ent AS target_id, 'CONTAINS_ENTITY' AS edge_type FROM p UNION ALL SELECT ent, item, 'MENTIONED_IN' FROM p")
def entity_edges(spark, d):
    return patterns.entity_edges(_matches(spark, d))


@query(GAZ + " SELECT doc_id, name FROM m WHERE name NOT IN (SELECT lower(name) FROM g WHERE label = 'TOOL')")
def net_new_entities(spark, d):
    known = patterns.gazetteer(table(spark, d, "benchmark")).where("label = 'TOOL'").select("name")
    return _matches(spark, d).select("doc_id", "name").join(known, "name", "left_anti").select("doc_id", "name")


@query(FOLD + " SELECT name, label, concat(lower(name), '::', lower(label)) AS canonical_key, substring(sha256(concat(lower(name), '|', lower(label))), 1, 16) AS entity_id FROM f")
def canonical_keys(spark, d):
    return patterns.keyed(patterns.fold(view(spark, d, "v_pattern_log")))


@query("SELECT page_id, concat('ws_', substring(sha1(url), 1, 12)) AS workspace_id FROM pages")
def workspace_hash(spark, d):
    return table(spark, d, "pages").select("page_id", X.workspace_id(F.col("url")).alias("workspace_id"))


@query("SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in queue.STATUSES) + " FROM v_jobs")
def queue_stats(spark, d):
    return queue.stats(view(spark, d, "v_jobs"))


@query("SELECT id, item_id FROM v_jobs WHERE status = 'pending' ORDER BY enqueued_at, id LIMIT 25")
def queue_claim(spark, d):
    return queue.claim(view(spark, d, "v_jobs"), 25).select("id", "item_id")


@query("SELECT id, status FROM v_jobs WHERE NOT (status = 'done' AND enqueued_at < 20000)")
def queue_cleanup(spark, d):
    return queue.cleanup(view(spark, d, "v_jobs"), 20000).select("id", "status")


@query("SELECT item_id, arg_min(id, enqueued_at) AS id FROM v_jobs GROUP BY item_id")
def dedup_jobs(spark, d):
    return queue.first_jobs(view(spark, d, "v_jobs"))


@query("SELECT id FROM v_jobs ORDER BY enqueued_at DESC, id DESC LIMIT 500")
def overflow_queue(spark, d):
    return queue.overflow(view(spark, d, "v_jobs"), 500).select("id")


MUT = """WITH b AS (SELECT item_id, max(tx_seq) AS base, arg_max(op, tx_seq) AS base_op FROM v_mutations WHERE op <> 'merge' {0} GROUP BY item_id),
l AS (SELECT m.* FROM v_mutations m LEFT JOIN b ON m.item_id = b.item_id WHERE (b.base IS NULL OR (b.base_op <> 'delete' AND m.tx_seq >= b.base)) {1})
SELECT item_id, k, arg_max(v, tx_seq) AS v FROM l GROUP BY item_id, k"""


@query(MUT.format("", ""))
def fold_merge(spark, d):
    return mutations.fold(view(spark, d, "v_mutations"))


@query(MUT.format("AND tx_seq <= 3000", "AND m.tx_seq <= 3000"))
def fold_as_of(spark, d):
    return mutations.fold(view(spark, d, "v_mutations"), as_of=3000)


@query("SELECT item_id FROM (SELECT item_id, arg_max(op, tx_seq) AS op FROM v_mutations WHERE op <> 'merge' GROUP BY item_id) WHERE op = 'delete'")
def fold_delete(spark, d):
    return mutations.deleted(view(spark, d, "v_mutations"))


@query("SELECT conv_id, turn, concat('User: ', substring(text, 1, 500), chr(10), 'Assistant: ', substring(reply, 1, 1000)) AS content FROM (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'")
def distill_pairs(spark, d):
    return sessions.distill(table(spark, d, "conversations"))


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS turn_count, count(*) FILTER (role = 'assistant') AS observation_count FROM conversations GROUP BY conv_id")
def session_counters(spark, d):
    return sessions.counters(table(spark, d, "conversations"))


@query("SELECT conv_id, turn, used FROM (SELECT conv_id, turn, CAST(sum(greatest(1, length(text) // 4)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) + 5 AS BIGINT) AS used FROM conversations) WHERE used <= 100")
def token_budget_prefix(spark, d):
    return recall.budget_prefix(table(spark, d, "conversations"), "conv_id", "turn", "text", 100, 5).select("conv_id", "turn", F.col("used").cast("bigint").alias("used"))


GATE = f"""WITH u AS (SELECT conv_id, turn, {STRIP.format('text')} AS p FROM conversations WHERE role = 'user'),
a AS (SELECT *, NOT (p = '' OR p LIKE '/%' OR (len(string_split_regex(p, '\\s+')) <= 3 AND lower(p) IN ('yes', 'no', 'ok', 'sure', 'y', 'n', 'k', 'yep', 'nope', 'yeah'))) AS able FROM u),
g AS (SELECT conv_id, turn, able AND NOT coalesce(lag(p) OVER (PARTITION BY conv_id, able ORDER BY turn) = p, FALSE) AS fires FROM a)"""


@query(GATE + " SELECT conv_id, turn, fires FROM g")
def recall_gate(spark, d):
    return sessions.gate(table(spark, d, "conversations"))


@query(GATE + " SELECT conv_id, turn, FALSE AS session_only, fires AS every_prompt FROM g")
def recall_strategies(spark, d):
    return sessions.strategies(table(spark, d, "conversations"))


@query("SELECT event_id, 'new_event' AS type, operation, 'unknown' AS component, nullif(trace_id, '') AS trace_id, nullif(span_id, '') AS span_id FROM v_spans")
def viewer_messages(spark, d):
    return events.messages(view(spark, d, "v_spans"))


@query("SELECT event_id, CASE operation WHEN 'add_node' THEN 'graph.node' ELSE 'graph.edge' END AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM v_spans WHERE operation IN ('add_node', 'add_edge')")
def progress_frames(spark, d):
    return events.frames(view(spark, d, "v_spans"))


@query("SELECT item_id, round(confidence * pow(0.5, (1000000 - created_seq) / 500000.0), 6) AS confidence, confidence * pow(0.5, (1000000 - created_seq) / 500000.0) < 0.2 AS archived FROM v_items")
def decay_confidence(spark, d):
    return evolve.decayed(view(spark, d, "v_items"), 1_000_000, 500_000.0, 0.2)


@query("SELECT item_id, confidence FROM (SELECT item_id, confidence, row_number() OVER (PARTITION BY coalesce(content, item_id) ORDER BY confidence DESC, created_seq) AS n FROM v_items) WHERE n = 1")
def prune_duplicates(spark, d):
    return evolve.pruned(view(spark, d, "v_items"))


@query("WITH s AS (SELECT DISTINCT user_id, event_type FROM events) SELECT a.event_type AS a, b.event_type AS b, count(*) AS weight FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2")
def hebbian_pairs(spark, d):
    return evolve.together(table(spark, d, "events"), "user_id", "event_type")


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_events(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.unix_timestamp(F.window("ts", "1 day").start).alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(floor(epoch(min(ts))) AS BIGINT) AS start FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS g FROM events)) GROUP BY user_id, s")
def session_events(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", "n", F.unix_timestamp(F.col("w.start")).alias("start"))


def queries() -> dict:
    from . import memory_catalog  # noqa: F401  registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict:
    from . import memory_catalog  # noqa: F401

    return dict(ORACLES)
