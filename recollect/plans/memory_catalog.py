"""Registered queries of search, recall, ingest, enrichment and evolution, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import scalar as X
from recollect.operators import enrich, events, ingest, patterns, predicates, project, recall, search, sessions
from recollect.sources.tables import table

from .adapters import view
from .catalog import GAZ, SCOPE, STRIP, _matches, query

NONE = "map<string,string>"


def _bm25(source: str, words: str, key: str = "item_id", text: str = "content") -> str:
    """CTEs that end in b (key, score), as search.bm25 has it."""
    return f"""t AS (SELECT {key}, regexp_extract_all(lower(coalesce({text}, '')), '[a-z]+') AS w FROM {source}), gl AS (SELECT count(*) AS n, avg(len(w)) AS al FROM t),
h AS (SELECT {key}, any_value(len) AS len, term, count(*) AS tf FROM (SELECT {key}, len(w) AS len, unnest(w) AS term FROM t) WHERE term IN ({words}) GROUP BY {key}, term),
fr AS (SELECT term, count(*) AS df FROM h GROUP BY term),
b AS (SELECT {key}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 4) AS score FROM h JOIN fr USING (term), gl GROUP BY {key})"""


WORDS, ASKED = "'thing', 'attion', 'erble'", "thing attion erble"


def _items(spark, d):
    return view(spark, d, "v_items").withColumn("node_category", F.lit(None).cast("string"))


def _props(spark, d):
    items = view(spark, d, "v_items")
    props = F.create_map(F.lit("content"), F.col("content"), F.lit("label"), F.substring("content", 1, 20), F.lit("origin"), F.col("origin"), F.lit("workspace_id"), F.col("workspace_id"), F.lit("confidence"), F.col("confidence").cast("string"), F.lit("memory_type"), F.lit("zettel"))
    kind = F.when(F.col("created_seq") % 11 == 0, F.lit(None)).otherwise(F.col("memory_type"))
    return items.select("item_id", kind.alias("memory_type"), F.lit(None).cast("string").alias("created_at"), props.alias("props"), "created_seq")


# --- projections

@query("SELECT item_id, CASE WHEN created_seq % 11 = 0 THEN 'zettel' ELSE memory_type END AS memory_type, coalesce(substring(content, 1, 20), '') AS label, length(coalesce(content, '')) AS n, k, v FROM (SELECT *, 'origin' AS k, origin AS v FROM v_items UNION ALL SELECT *, 'workspace_id', workspace_id FROM v_items)")
def flatten_metadata(spark, d):
    f = project.flatten(_props(spark, d))
    return f.select("item_id", "memory_type", "label", F.length("content").cast("bigint").alias("n"), F.explode("metadata").alias("k", "v"))


@query("SELECT item_id, CASE WHEN created_seq % 11 = 0 THEN 'zettel' ELSE memory_type END AS memory_type, content, round(confidence, 6) AS confidence, FALSE AS stale, 2 AS n FROM v_items")
def wildcard_rows(spark, d):
    return project.wildcard_rows(_props(spark, d)).select("item_id", "memory_type", "content", F.round("confidence", 6).alias("confidence"), "stale", F.size(F.map_keys("metadata")).alias("n"))


@query("SELECT concat(CASE WHEN stale THEN '⚠' ELSE '' END, CASE WHEN confidence < 0.5 THEN '~' ELSE '' END, '[', memory_type, '] ', substring(item_id, 1, 8), '  ', substring(coalesce(content, ''), 1, 200)) AS line FROM v_items")
def search_lines(spark, d):
    return view(spark, d, "v_items").select(project.search_line().alias("line"))


@query("SELECT item_id, '?' AS memory_type, coalesce(content, '') AS content, '' AS origin, confidence, FALSE AS stale FROM v_items")
def recall_shape(spark, d):
    rows = view(spark, d, "v_items").select(F.col("item_id").alias("id"), F.coalesce("content", F.lit("")).alias("content"), "confidence")
    return project.recall_shape(rows)


@query("SELECT 'ok' AS status, (SELECT count(*) FROM v_nodes WHERE memory_type IS DISTINCT FROM 'Version') AS memory_count, 'local' AS mode, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed FROM v_jobs")
def health(spark, d):
    from recollect.operators.queue import STATUSES

    return project.health(view(spark, d, "v_nodes"), view(spark, d, "v_jobs"), STATUSES).select("status", "memory_count", "mode", "queue.pending", "queue.failed")


@query("SELECT count(*) AS total FROM v_nodes")
def list_total(spark, d):
    return project.list_total(view(spark, d, "v_nodes"))


@query("SELECT id, item_id, CASE id % 3 WHEN 2 THEN 1 ELSE 0 END AS n, CASE WHEN id % 2 = 0 THEN '' ELSE 'ws_1' END AS workspace_id FROM v_jobs")
def job_view(spark, d):
    jobs = view(spark, d, "v_jobs").withColumn("entity_ids", F.when(F.col("id") % 3 == 1, "").when(F.col("id") % 3 == 2, '{"a": "1"}')).withColumn("workspace_id", F.when(F.col("id") % 2 == 1, "ws_1"))
    return project.job_view(jobs).select("id", "item_id", F.size(F.map_keys("entity_ids")).alias("n"), "workspace_id")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('id-', event_id) WHEN 1 THEN concat('x', event_id) ELSE '{\"queued\":true}' END AS item_id FROM events")
def result_ids(spark, d):
    e = table(spark, d, "events")
    r = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("id-"), F.col("event_id").cast("string"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"item_id":"x'), F.col("event_id").cast("string"), F.lit('","queued":true}'))).otherwise(F.lit('{"queued":true}'))
    return e.select("event_id", project.result_id(r).alias("item_id"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'set' ELSE concat('ws_', substring(sha1(url), 1, 12)) END AS workspace_id FROM pages")
def workspace_stamp(spark, d):
    n = F.col("page_id") % 3
    return table(spark, d, "pages").select("page_id", project.workspace(F.when(n == 0, "own"), F.when(n < 2, "set").otherwise(""), X.workspace_id(F.col("url"))).alias("workspace_id"))


# --- predicates

@query("SELECT item_id, coalesce(workspace_id IS NULL OR workspace_id = 'ws_1', FALSE) AS matches FROM v_items")
def snapshot_workspace(spark, d):
    return view(spark, d, "v_items").select("item_id", predicates.snapshot_matches("ws_1", F.col("workspace_id")).alias("matches"))


@query(f"SELECT item_id FROM v_nodes WHERE memory_type IN ('pending', 'semantic', 'episodic', 'procedural', 'zettel', 'reasoning', 'opinion', 'observation', 'decision') AND length({STRIP.format('content')}) >= 3")
def reextract_eligible(spark, d):
    return enrich.extractable(view(spark, d, "v_nodes")).select("item_id")


@query("SELECT item_id, coalesce(nullif(content, ''), label, '') <> '' AS indexed FROM v_nodes WHERE memory_type IS NOT NULL AND memory_type <> 'Version'")
def reindex_eligible(spark, d):
    return enrich.reindexable(view(spark, d, "v_nodes")).select("item_id", (F.col("text") != "").alias("indexed"))


@query("SELECT item_id FROM v_items WHERE memory_type IN ('decision', 'constraint', 'learned', 'opinion', 'observation')")
def expertise(spark, d):
    return search.expert(view(spark, d, "v_items")).select("item_id")


@query("SELECT item_id, coalesce(memory_type IN ('pending', 'semantic', 'episodic', 'procedural', 'zettel', 'reasoning', 'opinion', 'observation', 'decision'), FALSE) AS valid FROM v_nodes")
def valid_types(spark, d):
    return view(spark, d, "v_nodes").select("item_id", ingest.valid_type(F.col("memory_type")).alias("valid"))


@query("SELECT item_id FROM v_items WHERE workspace_id = 'ws_1' AND memory_type = 'opinion'")
def type_folding(spark, d):
    items = view(spark, d, "v_items")
    wanted = search.with_type({"workspace_id": "ws_1", "memory_type": "opinion"}, "decision")
    return items.where(predicates.has_properties(items, wanted)).select("item_id")


@query("SELECT event_id, event_type IN ('click', 'purchase') AS kept FROM events")
def launch_whitelist(spark, d):
    kept, refused = events.launch_events(table(spark, d, "events"), ["click", "purchase"])
    return kept.select("event_id", F.lit(True).alias("kept")).unionByName(refused.select("event_id", F.lit(False).alias("kept")))


@query("SELECT doc_id FROM documents WHERE lang = 'de'")
def domain_filter(spark, d):
    return table(spark, d, "documents").where(predicates.in_domain("de", F.col("lang"))).select("doc_id")


@query("SELECT p_partkey, p_partkey % 4 IN (0, 3) AS code FROM part")
def code_paths(spark, d):
    n = F.col("p_partkey") % 4
    path = F.when(n == 0, "src/a/builder.py").when(n == 1, "src/build/x.py").when(n == 2, "own/x.py").otherwise("lib/environment/y.py")
    return table(spark, d, "part").select("p_partkey", predicates.code_path(path, ("own",)).alias("code"))


@query("SELECT user_id FROM (SELECT user_id, max(event_id) AS updated_at FROM events GROUP BY user_id) WHERE updated_at < (SELECT max(event_id) FROM events) - 100")
def stale_sessions(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("event_id")).first()[0] or 0
    return events.stale_sessions(e.groupBy("user_id").agg(F.max("event_id").alias("updated_at")), last + 24 * 3600 - 100).select("user_id")


# --- search and recall

@query("SELECT item_id FROM v_items WHERE NOT coalesce(reference, FALSE) AND origin = 'cli:add' AND memory_type = 'decision'")
def search_wildcard(spark, d):
    return search.search(_items(spark, d), " * ", 1, {"origin": "cli:add"}, memory_type="decision").select("item_id")


@query("WITH " + _bm25("(SELECT * FROM v_items WHERE NOT coalesce(reference, FALSE) AND workspace_id = 'ws_1')", WORDS) + " SELECT item_id, round(1.0e0 / (60 + row_number() OVER (ORDER BY score DESC, item_id)), 6) AS score FROM b ORDER BY score DESC, item_id LIMIT 5")
def search_filtered(spark, d):
    return search.search(_items(spark, d), ASKED, 5, {"workspace_id": "ws_1"})


@query("WITH " + _bm25("(SELECT * FROM v_items WHERE NOT coalesce(reference, FALSE))", WORDS) + """,
e AS (SELECT concat('doc-', v.vec_id) AS item_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE concat('doc-', v.vec_id) IN (SELECT item_id FROM v_items WHERE NOT coalesce(reference, FALSE))),
u AS (SELECT item_id, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM b UNION ALL SELECT item_id, row_number() OVER (ORDER BY score DESC, item_id) FROM e)
SELECT item_id, round(sum(1.0e0 / (60 + rank)), 6) AS score FROM u WHERE rank <= 100 GROUP BY item_id ORDER BY score DESC, item_id LIMIT 20""")
def search_fused(spark, d):
    v = table(spark, d, "embeddings")
    probe = v.where("vec_id = 0").select("embedding").limit(1).collect()  # the query vector: one row
    return search.search(_items(spark, d), ASKED, 20, vectors=v.select(F.concat(F.lit("doc-"), F.col("vec_id").cast("string")).alias("item_id"), "embedding"), probe=list(probe[0][0]) if probe else None)


@query("SELECT item_id, min(channel) AS channel FROM (SELECT item_id, 0 AS channel FROM v_items WHERE contains(lower(content), 'apache license') UNION ALL SELECT item_id, 1 FROM v_items WHERE list_has_any(regexp_extract_all(lower(coalesce(content, '')), '[a-z]+'), ['apache', 'license'])) GROUP BY item_id ORDER BY channel, item_id LIMIT 50")
def text_first(spark, d):
    return search.text_first(view(spark, d, "v_items"), "Apache License", 50)


CANDIDATES = "WITH " + _bm25("v_items", WORDS) + f""",
c AS (SELECT v.* EXCLUDE (place), place AS rank FROM (SELECT *, row_number() OVER (ORDER BY created_seq DESC, item_id) AS place FROM v_items) v WHERE place <= {{0}}
UNION ALL SELECT v.*, 200 + place FROM v_items v JOIN (SELECT item_id, row_number() OVER (ORDER BY score DESC, item_id) AS place FROM b) s ON v.item_id = s.item_id WHERE place <= {{1}}),
s AS (SELECT *, {STRIP.format('content')} AS body FROM c WHERE {SCOPE}),
u AS (SELECT *, row_number() OVER (PARTITION BY memory_type, lower(substring(body, 1, 120)) ORDER BY rank) AS n FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY rank) AS place FROM u WHERE n = 1)"""


@query(CANDIDATES.format(100, 100) + " SELECT CAST(place AS BIGINT) AS rank, concat('- ', CASE WHEN stale THEN '⚠' ELSE '' END, CASE WHEN confidence < 0.5 THEN '~' ELSE '' END, '[', memory_type, '] ', substring(body, 1, 200)) AS line FROM r WHERE place <= 200")
def recall_block(spark, d):
    return recall.recall_block(view(spark, d, "v_items"), 200, words=ASKED.split(), workspace="ws_1")


def _snapshots(spark, d):
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("created_seq") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return view(spark, d, "v_items").withColumns({"created_at": stamp, "memory_type": F.when(F.col("stale"), "snapshot").otherwise(F.col("memory_type"))})


@query(f"SELECT {STRIP.format('content')} AS frame FROM v_items WHERE created_seq = (SELECT max(created_seq) FROM v_items WHERE stale)")
def snapshot_frame(spark, d):
    return recall.snapshot_frame(_snapshots(spark, d), F.to_timestamp(F.lit("2024-01-02T00:00:00Z")))


@query("SELECT n_nationkey, CAST(greatest(1, (greatest(1, n_nationkey) + 1) // 2) AS INTEGER) AS recent, CAST(greatest(1, n_nationkey) - greatest(1, (greatest(1, n_nationkey) + 1) // 2) AS INTEGER) AS semantic FROM nation")
def recall_split(spark, d):
    recent, semantic = recall.split_columns(F.col("n_nationkey"))
    return table(spark, d, "nation").select("n_nationkey", recent.alias("recent"), semantic.alias("semantic"))


@query("WITH " + _bm25("v_items", WORDS) + " SELECT item_id, score FROM b ORDER BY score DESC, item_id LIMIT 20")
def recall_overfetch(spark, d):
    s = search.bm25(view(spark, d, "v_items"), ASKED.split(), "item_id", "content").select("item_id", F.round("score", 4).alias("score"))
    return s.orderBy(F.col("score").desc(), "item_id").limit(2 * 10)


ORIENT = """WITH c AS (SELECT conv_id, arg_min(text, turn) AS context FROM conversations GROUP BY conv_id), f AS (SELECT conv_id, context, greatest(1, length(context) // 4) AS cost FROM c),
l AS (SELECT conv_id, CASE WHEN context <> '' AND cost <= 150 THEN 150 - cost ELSE 150 END AS room FROM f),
p AS (SELECT conv_id, turn, concat('- [', role, '] ', substring(text, 1, 150)) AS line FROM conversations),
q AS (SELECT *, sum(greatest(1, length(line) // 4)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM p)
SELECT conv_id, CAST(0 AS BIGINT) AS place, context AS line FROM f WHERE context <> '' AND cost <= 150 UNION ALL SELECT conv_id, CAST(place AS BIGINT), line FROM q JOIN l USING (conv_id) WHERE room > 100 AND used <= room"""


@query(ORIENT)
def orient_block(spark, d):
    turns = table(spark, d, "conversations")
    context = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("context"))
    return recall.orient_block(context, turns.select("conv_id", "turn", F.col("role").alias("memory_type"), F.col("text").alias("content")), "conv_id", "turn", 150)


# --- lifecycle texts

@query("SELECT event_id, concat('Tool `', event_type, '` called. Input: ', substring(props, 1, 200), '. Result: ', substring(CAST(event_id * 7 AS VARCHAR), 1, 300)) AS content FROM events")
def observed_calls(spark, d):
    return table(spark, d, "events").select("event_id", X.tool_text(F.col("event_type"), F.col("props"), (F.col("event_id") * 7).cast("string")).alias("content"))


@query("SELECT doc_id, concat('Error in `', source, '`: ', substring(text, 1, 500)) AS content FROM documents")
def learned_errors(spark, d):
    return table(spark, d, "documents").select("doc_id", X.error_text(F.col("source"), F.col("text")).alias("content"))


@query("SELECT conv_id, concat('Session summary (turns=', count(*) FILTER (role = 'user'), ', observations=', count(*) FILTER (role = 'tool'), '): ', substring(arg_max(text, turn) FILTER (role = 'assistant'), 1, 1000)) AS content FROM conversations GROUP BY conv_id HAVING coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') <> ''")
def session_summaries(spark, d):
    return sessions.summaries(table(spark, d, "conversations"))


@query("SELECT page_id, concat('patterns conventions decisions for ', list_extract(string_split(url, '/'), -1)) AS asked FROM pages")
def pattern_queries(spark, d):
    return table(spark, d, "pages").select("page_id", X.pattern_query(F.col("url")).alias("asked"))


# --- what callers write

@query("SELECT concat('doc-', doc_id) AS item_id, doc_id AS tx_seq, 'put' AS op, k, v FROM (SELECT doc_id, 'content' AS k, coalesce(text, '') AS v FROM documents UNION ALL SELECT doc_id, 'memory_type', CASE WHEN doc_id % 2 = 0 THEN 'episodic' ELSE 'semantic' END FROM documents UNION ALL SELECT doc_id, 'project', source FROM documents)")
def ingest_properties(spark, d):
    docs = table(spark, d, "documents")
    props = F.create_map(F.lit("project"), F.col("source"), F.lit("memory_type"), F.lit("forged"), F.lit("embedding"), F.lit("x"))
    return ingest.put_rows(docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("item_id"), F.col("doc_id").alias("tx_seq"), F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 1, "semantic").alias("memory_type"), props.alias("props")))


def _requests(spark, d):
    o = table(spark, d, "orders")
    meta = F.create_map(F.lit("content"), F.lit("from metadata"), F.lit("a"), F.lit("meta"), F.lit("m"), F.col("o_orderstatus"))
    own = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("own"), F.lit("content"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("own text")).otherwise(F.lit("other text"))))
    return o.select(F.concat(F.lit("i"), F.col("o_custkey").cast("string")).alias("item_id"), F.col("o_orderkey").alias("tx_seq"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).alias("content"), meta.alias("metadata"), own.alias("properties"))


def _stored(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("i"), F.col("c_custkey").cast("string")).alias("item_id"))


PATCH = "WITH q AS (SELECT concat('i', o_custkey) AS item_id, o_orderkey AS tx_seq, * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))"


@query(PATCH + """ SELECT item_id, tx_seq, 'merge' AS op, k, v FROM (SELECT item_id, tx_seq, 'a' AS k, CASE WHEN tx_seq % 2 = 0 THEN 'own' ELSE 'meta' END AS v FROM q UNION ALL SELECT item_id, tx_seq, 'm', o_orderstatus FROM q
UNION ALL SELECT item_id, tx_seq, 'content', CASE WHEN tx_seq % 2 = 0 THEN CASE WHEN tx_seq % 3 = 0 THEN 'own text' ELSE 'other text' END WHEN tx_seq % 5 = 0 THEN o_orderpriority ELSE 'from metadata' END FROM q)""")
def patch_rows(spark, d):
    return ingest.patch_rows(_requests(spark, d), _stored(spark, d))[0]


@query("SELECT DISTINCT concat('i', o_custkey) AS item_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def patch_refused(spark, d):
    return ingest.patch_rows(_requests(spark, d), _stored(spark, d))[1]


@query("SELECT concat('i', o_custkey) AS item_id, o_orderkey AS tx_seq, 'delete' AS op, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS known FROM orders WHERE o_orderstatus = 'F'")
def delete_rows(spark, d):
    ids = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("i"), F.col("o_custkey").cast("string")).alias("item_id"), F.col("o_orderkey").alias("tx_seq"))
    rows, unknown = ingest.delete_rows(ids, _stored(spark, d))
    back = ids.join(unknown.distinct(), "item_id", "left_semi")
    return rows.select("item_id", "tx_seq", "op", F.lit(True).alias("known")).unionByName(back.select("item_id", "tx_seq", F.lit("delete").alias("op"), F.lit(False).alias("known")))


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def live_vectors(spark, d):
    gone = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("item_id"))
    return ingest.live_vectors(table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id")), gone).select(F.col("item_id").alias("vec_id"))


@query("SELECT label AS item_id, max(vec_id) AS tx_seq, round(arg_max(embedding, vec_id)[1]::DOUBLE, 6) AS first FROM embeddings GROUP BY label")
def latest_vectors(spark, d):
    log = table(spark, d, "embeddings").select(F.col("label").alias("item_id"), F.col("vec_id").alias("tx_seq"), "embedding")
    return ingest.latest_vectors(log).select("item_id", "tx_seq", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("SELECT concat('item-', o_custkey) AS item_id, min(o_orderkey) AS enqueued_at, lower(arg_min(o_orderpriority, o_orderkey)) AS name FROM orders WHERE concat('item-', o_custkey) NOT IN (SELECT item_id FROM v_jobs WHERE status IN ('pending', 'processing')) GROUP BY o_custkey")
def enqueue_jobs(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("item-"), F.col("o_custkey").cast("string")).alias("item_id"), F.col("o_orderkey").alias("enqueued_at"), F.create_map(F.col("o_orderpriority"), F.lit("n")).alias("entity_ids"))
    return ingest.enqueue(o, view(spark, d, "v_jobs")).select("item_id", "enqueued_at", F.get(F.map_keys("entity_ids"), F.lit(0)).alias("name"))


@query("WITH l AS (SELECT o_custkey AS id, o_orderkey AS at_, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) - 1 AS s FROM orders WHERE o_orderpriority NOT LIKE '5%') SELECT id, CASE max(s) WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'done' END AS status, max(at_) AS last_at FROM l GROUP BY id")
def fold_jobs(spark, d):
    # the last priority stands for an event that is no change of status
    s = F.try_element_at(F.array(*map(F.lit, ("pending", "processing", "failed", "done"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    return ingest.fold_jobs(table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("at"), s.alias("status"))).withColumnRenamed("at", "last_at")


@query("SELECT item_id, CAST(9 AS BIGINT) AS tx_seq, 'merge' AS op, 'origin' AS k, 'cli:retag' AS v FROM v_items WHERE contains(lower(content), 'license')")
def retag_rows(spark, d):
    return ingest.retag_rows(view(spark, d, "v_items"), "License", "cli:retag", 0, 9)


@query("SELECT concat('doc-', doc_id) AS item_id, 'decision' AS memory_type, k, v FROM (SELECT doc_id, 'rationale' AS k, source AS v FROM documents UNION ALL SELECT doc_id, 'domain', lang FROM documents) WHERE v IS NOT NULL")
def typed_capture(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("item_id"), F.col("doc_id").alias("tx_seq"), F.col("text").alias("content"), F.col("source").alias("rationale"), F.col("lang").alias("domain"))
    return ingest.typed(docs, "decision", ["rationale", "domain"]).select("item_id", "memory_type", F.explode("props").alias("k", "v"))


@query("SELECT count(*) AS n FROM documents WHERE source = 'src1'")
def delete_run(spark, d):
    return ingest.delete_run(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("run_id")), "src1").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'TOP' ELSE o_orderpriority END AS entity_type, count(*) AS n, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS changed FROM orders GROUP BY 1")
def merge_types(spark, d):
    nodes = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("entity_type"))
    return ingest.merge_types(nodes, ["1-URGENT", "2-HIGH"], "TOP").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("changed"))


# --- patterns

@query("SELECT p_name AS name, p_type AS label FROM part WHERE NOT (lower(p_name) = (SELECT lower(min(p_name)) FROM part) AND p_type = (SELECT arg_min(p_type, (p_name, p_partkey)) FROM part))")
def pattern_delete(spark, d):
    store = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("label"), "p_partkey")
    first = store.agg(F.min(F.struct("name", "p_partkey", "label")).alias("m")).select("m.name", "m.label").first()
    return patterns.without_pattern(store.select("name", "label"), first["name"], first["label"])


BUNDLED, APPLIED = "SELECT n_name AS file, sha1(CAST(n_regionkey AS STRING)) AS checksum FROM nation", "SELECT n_name AS file, sha1(CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey ELSE 9 END AS STRING)) AS checksum FROM nation WHERE n_regionkey < 3"
CHANGES = f"SELECT b.file, CASE WHEN a.checksum IS NULL THEN 'new' ELSE 'changed' END AS change FROM ({BUNDLED}) b LEFT JOIN ({APPLIED}) a ON a.file = b.file WHERE b.checksum IS DISTINCT FROM a.checksum"


def _changes(spark, d):
    n = table(spark, d, "nation")
    return patterns.manifest_changes(spark.sql(APPLIED.replace("FROM nation", "FROM {n}"), n=n), spark.sql(BUNDLED.replace("FROM nation", "FROM {n}"), n=n))


@query(CHANGES)
def manifest_changes(spark, d):
    return _changes(spark, d)


@query(f"WITH ch AS ({CHANGES}), st AS (SELECT lower(p_name) AS name FROM part), sd AS (SELECT s_name AS name, row_number() OVER (PARTITION BY lower(s_name) ORDER BY s_suppkey) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN (SELECT file FROM ch)) SELECT name, 'SEED' AS label FROM sd WHERE n = 1 AND lower(name) NOT IN (SELECT name FROM st) UNION ALL SELECT p_name, p_type FROM part")
def seed_union(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("file"))
    extra = [F.lit(0.9).alias("confidence"), F.lit(2).alias("frequency"), F.lit("seed").alias("source")]
    seeds = table(spark, d, "supplier").join(n, "s_nationkey").select("file", F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name"), F.lit("SEED").alias("label"), *extra)
    store = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("label"), *extra)
    return patterns.sync_seeds(store, seeds, _changes(spark, d)).select("name", "label")


@query("SELECT name, label, CASE WHEN is_alias THEN 0.95e0 ELSE 0.99e0 END AS confidence, 2 AS frequency FROM (SELECT p_name AS name, p_type AS label, p_partkey % 2 = 1 AS is_alias, row_number() OVER (PARTITION BY p_name ORDER BY p_size, p_partkey, p_partkey % 2 = 1) AS n FROM part) WHERE n = 1")
def generated_seeds(spark, d):
    return patterns.generated(table(spark, d, "part").select(F.col("p_size").alias("category_no"), F.col("p_partkey").alias("place"), (F.col("p_partkey") % 2 == 1).alias("is_alias"), F.col("p_name").alias("name"), F.col("p_type").alias("label")))


@query("SELECT p_type AS label, count(*) AS n FROM part GROUP BY 1")
def manifest_counts(spark, d):
    return patterns.counts(table(spark, d, "part").select(F.col("p_type").alias("label")))


# --- events and counters

@query("SELECT event_id, user_id, CAST(seq AS BIGINT) AS seq FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seq FROM events WHERE props <> '{}' AND value >= 20) WHERE event_type IN ('click', 'view')")
def event_sequence(spark, d):
    spans = view(spark, d, "v_spans").withColumn("run", F.col("trace_id")).withColumn("subscribers", F.when((F.col("props") != "{}") & (F.col("value") >= 20), 1).otherwise(0))
    return events.sequenced(spans, "subscribers", "event_id").select("event_id", F.substring("run", 2, 20).cast("bigint").alias("user_id"), "seq")


@query("SELECT count(*) AS enqueued, count(*) FILTER (status = 'done') AS processed, count(*) FILTER (status = 'failed') AS failed, CAST(greatest(count(*) - 500, 0) AS BIGINT) AS dropped FROM v_jobs")
def queue_counters(spark, d):
    return events.queue_counters(view(spark, d, "v_jobs"), 500)


@query("SELECT count(*) FILTER (coalesce(text, '') <> '') AS imported, count(*) FILTER (coalesce(text, '') = '') AS errors FROM documents WHERE lang = 'en'")
def import_stats(spark, d):
    return events.import_stats(table(spark, d, "documents").select(F.col("text").alias("content"), F.col("lang").alias("domain")), "en")


@query("SELECT p_type AS domain, count(*) AS n, count(DISTINCT p_name) AS entities FROM part GROUP BY 1")
def mining_counts(spark, d):
    return events.mining_counts(table(spark, d, "part").select(F.col("p_type").alias("domain"), F.col("p_name").alias("entity")))


# --- stages and jobs

@query("SELECT item_id, CASE WHEN memory_type <> 'pending' THEN memory_type WHEN regexp_matches(lower(coalesce(content, '')), '\\b(decided|decision|we will)\\b') THEN 'decision' WHEN regexp_matches(lower(coalesce(content, '')), '\\b(how to|steps?|install)\\b') THEN 'procedural' WHEN regexp_matches(lower(coalesce(content, '')), '\\b(i think|believe|prefer)\\b') THEN 'opinion' ELSE 'semantic' END AS memory_type FROM v_items")
def stage_classify(spark, d):
    return enrich.classify(view(spark, d, "v_items")).select("item_id", "memory_type")


@query(f"SELECT item_id, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM (SELECT item_id, {STRIP.format('x')} AS s FROM (SELECT item_id, unnest(string_split_regex(regexp_replace(coalesce(content, ''), '([.!?])\\s+', '\\1' || chr(10), 'g'), '\n+')) AS x FROM v_items)) WHERE s <> '' GROUP BY item_id")
def stage_simplify(spark, d):
    return enrich.simplify(view(spark, d, "v_items")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).cast("bigint").alias("chars"))


@query(GAZ + " SELECT doc_id, name FROM m WHERE label IN ('TOOL', 'PLACE')")
def stage_constrain(spark, d):
    allowed = spark.createDataFrame([("TOOL",), ("PLACE",), ("TOOL",)], "entity_type string")
    return enrich.constrain(_matches(spark, d).withColumnRenamed("label", "entity_type"), allowed).select("doc_id", "name")


@query(GAZ + ", ch AS (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY name ORDER BY doc_id) AS b FROM m) SELECT a, b, count(*) AS shared FROM ch WHERE b IS NOT NULL GROUP BY a, b")
def stage_link(spark, d):
    return enrich.link(_matches(spark, d).select(F.col("doc_id").alias("item_id"), F.col("name").alias("entity")))


@query("SELECT item_id, length(coalesce(content, '')) AS n_chars, CAST(len(w) AS BIGINT) AS n_words, nullif(regexp_extract(coalesce(content, ''), '\\b(\\d{4}-\\d{2}-\\d{2})\\b', 1), '') AS named_date, CAST(len(list_filter(w, lambda x: x IN ('the', 'la'))) - len(list_filter(w, lambda x: x IN ('trash', 'stupid'))) AS BIGINT) AS balance FROM (SELECT item_id, content, list_filter(string_split_regex(lower(coalesce(content, '')), '[^\\p{L}]+'), lambda x: x <> '') AS w FROM v_items)")
def stage_enrich(spark, d):
    return enrich.annotate(view(spark, d, "v_items"), ["the", "la"], ["trash", "stupid"])


@query("SELECT p_partkey, k.public_id FROM part p LEFT JOIN (SELECT lower(p_name) || '::' || lower(p_type) AS key, min(concat('Q', p_partkey)) AS public_id FROM part WHERE p_size > 25 GROUP BY 1) k ON lower(p.p_name) || '::' || lower(p.p_type) = k.key")
def stage_ground(spark, d):
    p = table(spark, d, "part")
    known = p.where("p_size > 25").select(F.upper("p_name").alias("name"), F.col("p_type").alias("label"), F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("public_id"))
    return enrich.ground(p.select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("label")), known).select("p_partkey", "public_id")


@query("SELECT count(*) FILTER (t <> '') AS reindexed, count(*) FILTER (t = '') AS skipped, count(*) AS total FROM (SELECT coalesce(nullif(content, ''), label, '') AS t FROM v_nodes WHERE memory_type IS NOT NULL AND memory_type <> 'Version')")
def reindex_stats(spark, d):
    return enrich.reindex_stats(view(spark, d, "v_nodes"))


def _entity_edges(spark, d):
    return patterns.entity_edges(_matches(spark, d))


@query(GAZ + " SELECT item_id FROM v_items WHERE item_id NOT IN (SELECT concat('doc-', doc_id) FROM m)")
def not_enriched(spark, d):
    return enrich.not_enriched(view(spark, d, "v_items"), _entity_edges(spark, d)).select("item_id")


def _extracted(spark, d):
    m = _matches(spark, d)
    return m.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("item_id"), F.initcap("name").alias("name"), F.when(F.col("label") != "PLACE", F.col("label")).alias("label"), F.lit(None).cast("double").alias("confidence"))


def _known(spark, d):
    return patterns.gazetteer(table(spark, d, "benchmark")).where("label = 'TOOL'").select("name", "label", F.concat(F.lit("known-"), F.col("name")).alias("entity_id"))


FOUND = GAZ + ", x AS (SELECT concat('doc-', doc_id) AS item_id, name, CASE WHEN label = 'PLACE' THEN 'concept' ELSE label END AS label FROM m), fe AS (SELECT item_id, name, label, CASE WHEN label = 'TOOL' THEN concat('known-', name) ELSE substring(sha256(concat(name, '|', lower(label))), 1, 16) END AS entity_id, label <> 'TOOL' AS is_new FROM x)"


@query(FOUND + " SELECT item_id, name, label, 0.85e0 AS confidence, entity_id, is_new FROM fe")
def found_entities(spark, d):
    return enrich.found_entities(_extracted(spark, d), _known(spark, d)).withColumn("name", F.lower("name"))


@query(FOUND + " SELECT item_id, CASE WHEN is_new THEN entity_id ELSE substring(sha256(concat('entity ', entity_id)), 1, 16) END AS entity_id FROM fe")
def guarded_ids(spark, d):
    items = _known(spark, d).select(F.col("entity_id").alias("item_id"))  # every known id is an item's here
    return enrich.guard_ids(enrich.found_entities(_extracted(spark, d), _known(spark, d)), items).select("item_id", "entity_id")


JOBS = "jb AS (SELECT concat('doc-', doc_id) AS item_id FROM labels WHERE quality = 1), ab AS (SELECT v.item_id FROM v_items v WHERE v.item_id IN (SELECT item_id FROM jb) AND length(" + STRIP.format("content") + ") >= 3)"


def _job(spark, d):
    jobs = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("item_id"), F.when(F.col("quality") == 1, "pending").otherwise("done").alias("status"))
    none = spark.createDataFrame([], "source_id string, target_id string, edge_type string")
    extracted = _extracted(spark, d)
    return enrich.enrich_job(jobs, view(spark, d, "v_items"), none, _known(spark, d), lambda items: extracted.join(items.select("item_id"), "item_id", "left_semi"))


@query(FOUND + ", " + JOBS + " SELECT item_id AS source_id, entity_id AS target_id, 'CONTAINS_ENTITY' AS edge_type FROM fe WHERE item_id IN (SELECT item_id FROM ab) UNION ALL SELECT entity_id, item_id, 'MENTIONED_IN' FROM fe WHERE item_id IN (SELECT item_id FROM ab)")
def job_edges(spark, d):
    return _job(spark, d)["edges"]


@query(FOUND + ", " + JOBS + " SELECT entity_id, min(name) AS name, min(label) AS label, 0.85e0 AS confidence FROM fe WHERE is_new AND item_id IN (SELECT item_id FROM ab) GROUP BY entity_id")
def job_nodes(spark, d):
    return _job(spark, d)["nodes"].withColumn("name", F.lower("name"))


@query(FOUND + ", " + JOBS + " SELECT (SELECT count(*) FROM ab) AS extracted, (SELECT count(DISTINCT entity_id) FROM fe WHERE is_new AND item_id IN (SELECT item_id FROM ab)) AS entities_created, (SELECT count(*) FROM v_items) AS total, (SELECT count(*) FROM v_items) - (SELECT count(*) FROM ab) AS skipped")
def reextract_stats(spark, d):
    job = _job(spark, d)
    return enrich.job_stats(view(spark, d, "v_items"), job["extracted"], job["nodes"].withColumn("is_new", F.lit(True)))


# --- evolution

@query("SELECT concat('semantic:', item_id) AS source_id, item_id AS target_id, 'SUPERSEDES' AS edge_type FROM v_items WHERE memory_type = 'episodic' AND confidence >= 0.8")
def promoted_items(spark, d):
    return enrich.promoted(view(spark, d, "v_items"), "episodic", "semantic", 0.8)[1]


@query("SELECT item_id, round(confidence * pow(0.5, (2000 - created_seq) / 1000.0), 6) AS confidence, round(confidence * pow(0.5, (2000 - created_seq) / 1000.0), 6) < 0.25 AS retracted FROM v_items WHERE memory_type = 'decision'")
def decision_confidence(spark, d):
    return enrich.decided(view(spark, d, "v_items"), 2000, 1000.0, 0.25)


SYNTHESIS = "SELECT workspace_id, count(*) AS n, round(avg(confidence), 6) AS confidence, arg_max(item_id, confidence * 1000000 + created_seq) AS strongest FROM v_items WHERE memory_type = '{0}' GROUP BY workspace_id"


@query(SYNTHESIS.format("opinion"))
def opinion_synthesis(spark, d):
    return enrich.synthesis(view(spark, d, "v_items"), "workspace_id", "opinion")


@query(SYNTHESIS.format("observation"))
def observation_synthesis(spark, d):
    return enrich.synthesis(view(spark, d, "v_items"), "workspace_id", "observation")


@query("SELECT item_id, round(least(1.0e0, confidence + 0.05e0 * coalesce(n, 0)), 6) AS confidence FROM v_items LEFT JOIN (SELECT concat('doc-', user_id) AS id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) ON id = item_id")
def retrieval_strength(spark, d):
    hits = table(spark, d, "events").where("event_type = 'click'").select(F.concat(F.lit("doc-"), F.col("user_id").cast("string")).alias("item_id"))
    return enrich.reinforced(view(spark, d, "v_items"), hits, 0.05)


@query("WITH c AS (SELECT user_id AS path, max(event_id) AS changed FROM events GROUP BY 1) SELECT item_id, coalesce(changed > 9000, FALSE) AS stale FROM v_items LEFT JOIN c ON path = created_seq")
def stale_memory(spark, d):
    items = view(spark, d, "v_items")
    return enrich.outdated(items, items.select("item_id", F.col("created_seq").alias("path"), F.lit(9000).alias("seen")), table(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("changed")))


@query("""WITH p AS (SELECT item_id AS a, lead(item_id) OVER (PARTITION BY memory_type ORDER BY created_seq) AS b, confidence AS ca, lead(confidence) OVER (PARTITION BY memory_type ORDER BY created_seq) AS cb FROM v_items),
w AS (SELECT CASE WHEN ca >= cb THEN b ELSE a END AS item_id, CASE WHEN ca >= cb THEN a ELSE b END AS dominant, greatest(ca, cb) AS c FROM p WHERE b IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY c DESC, dominant DESC) AS n FROM w) SELECT item_id, dominant FROM r WHERE n = 1""")
def interference(spark, d):
    from pyspark.sql import Window

    items = view(spark, d, "v_items")
    pairs = items.select(F.col("item_id").alias("a"), F.lead("item_id").over(Window.partitionBy("memory_type").orderBy("created_seq")).alias("b")).where("b IS NOT NULL")
    return enrich.consolidated(pairs, items)


@query("SELECT item_id, CASE WHEN content LIKE 'User: %' THEN 'episodic' WHEN regexp_matches(lower(coalesce(content, '')), '\\b(step|install|run|how to)\\b') THEN 'procedural' ELSE 'semantic' END AS memory_type FROM v_items WHERE memory_type = 'pending'")
def consolidation_router(spark, d):
    return enrich.routed(view(spark, d, "v_items"))


@query("WITH s AS (SELECT DISTINCT user_id, event_type FROM events), t AS (SELECT a.event_type AS a, b.event_type AS b, count(*) AS n FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2) SELECT a, b, round(1 - (1 - CASE WHEN a = 'click' THEN 0.2e0 ELSE 0.0e0 END) * pow(0.999e0, n), 6) AS weight FROM t")
def hebbian_weights(spark, d):
    from recollect.operators.evolve import together

    pairs = together(table(spark, d, "events"), "user_id", "event_type")
    old = pairs.where("a = 'click'").select("a", "b", F.lit(0.2).alias("weight"))
    return enrich.strengthened(old, pairs, 0.001)


@query("SELECT item_id, min(item_id) OVER (PARTITION BY r) AS cluster FROM (SELECT concat('c', c_custkey) AS item_id, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT concat('n', n_nationkey), n_regionkey FROM nation UNION ALL SELECT concat('r', r_regionkey), r_regionkey FROM region)")
def clusters(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    name = lambda letter, col: F.concat(F.lit(letter), F.col(col).cast("string"))
    edges = c.select(name("c", "c_custkey").alias("source_id"), name("n", "c_nationkey").alias("target_id")).unionAll(n.select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    return enrich.clusters(edges)
