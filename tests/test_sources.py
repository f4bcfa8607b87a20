"""Readers, settings, code index, plugins, streams and the store on small files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from recollect import config, plugins
from recollect.functions import scalar as X
from recollect.operators import enrich, ingest, patterns, project, recall, search, sessions
from recollect.sources import code, files
from recollect.store import Store, sync_remote
from recollect.streaming import enrichment


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_patterns_file(spark, tmp_path):
    path = write(tmp_path / "p.jsonl", '{"name": "Spark", "label": "T", "frequency": 2}', "", "not json", '{"name": "Once", "label": "T"}', '{"name": "Late", "label": "T", "frequency": 5}')
    assert sorted(r.name for r in files.read_patterns(spark, path).collect()) == ["Late", "Spark"]
    assert files.all_patterns(spark, path).count() == 3


def test_seeds_are_synced(spark, tmp_path):
    manifest = {"version": "2", "files": {"a.jsonl": {"checksum": "1", "count": 2, "label": "A"}, "b.jsonl": {"checksum": "2", "count": 1, "label": "B"}, "c.jsonl": {"checksum": "3", "count": 1, "label": "C"}}}
    applied = {"version": "1", "files": {"a.jsonl": {"checksum": "1", "count": 2, "label": "A"}, "b.jsonl": {"checksum": "old", "count": 1, "label": "B"}}}
    one, two = write(tmp_path / "m.json", json.dumps(manifest)), write(tmp_path / "ap.json", json.dumps(applied))
    write(tmp_path / "b.jsonl", '{"name": "Own", "label": "B", "confidence": 0.9, "frequency": 2}', '{"name": "New", "label": "B", "confidence": 0.9, "frequency": 2}')
    write(tmp_path / "c.jsonl", '{"name": "NEW", "label": "C", "confidence": 0.9, "frequency": 2}')
    changes = patterns.manifest_changes(files.read_manifest(spark, two), files.read_manifest(spark, one))
    assert sorted(map(tuple, changes.collect())) == [("b.jsonl", "changed"), ("c.jsonl", "new")]
    store = spark.createDataFrame([("own", "MINE", 0.5, 7, "user")], "name string, label string, confidence double, frequency int, source string")
    synced = patterns.sync_seeds(store, files.read_seeds(spark, str(tmp_path), ["b.jsonl", "c.jsonl"]), changes)
    assert sorted((r.name, r.label) for r in synced.collect()) == [("New", "B"), ("own", "MINE")]
    assert files.read_manifest(spark, str(tmp_path / "none.json")) is None and files.read_manifest(spark, write(tmp_path / "bad.json", "{")) is None
    assert files.seed_legacy(spark, str(tmp_path / "c.jsonl"), None).count() == 1 and files.seed_legacy(spark, "unread", store) is store


def test_corpus_round_trip(spark, tmp_path):
    items = spark.createDataFrame([("a", "one", "semantic", {"domain": "d"}), ("b", "two", "decision", {"domain": "e"}), ("c", "x", "entity", None)], "item_id string, content string, memory_type string, metadata map<string,string>")
    path = str(tmp_path / "corpus")
    assert files.write_corpus(items, path, "here", "dom") == 2
    assert files.corpus_header(spark, path) == {"source": "here", "domain": "dom", "item_count": 2}
    records, broken = files.read_corpus(spark, path)
    assert sorted(r.item_id for r in records.collect()) == ["a", "b"] and broken.count() == 0
    assert [r.item_id for r in files.read_corpus(spark, path, "e")[0].collect()] == ["b"]
    assert files.write_corpus(items, path, limit=1, entities=True) == 1 and files.write_corpus(items, path, memory_type="decision") == 1
    rows = spark.createDataFrame([("1", "text", [("s", "r", "o")]), ("2", "", [])], "id string, text string, triplets array<struct<head:string,type:string,tail:string>>")
    assert files.convert_triplets(rows, domain="d").first().metadata["relations"] == '[{"head":"s","type":"r","tail":"o"}]' and files.convert_triplets(rows).count() == 1


def test_lines_packs_and_logs(spark, tmp_path):
    path = write(tmp_path / "in.txt", "  one ", "", "\ttwo")
    assert sorted(r.content for r in files.read_lines(spark, path).collect()) == ["one", "two"] and files.read_lines(spark, path, whole=True).count() == 1
    with pytest.raises(ValueError):
        files.read_lines(spark, write(tmp_path / "blank.txt", " ", ""))
    pack = tmp_path / "pack"
    pack.mkdir()
    write(pack / "corpus.jsonl", '{"source": "s", "item_count": 1}', '{"item_id": "a", "content": "x"}', '{"item_id": "b"}')
    write(pack / "patterns.jsonl", '{"name": "n", "label": "l"}')
    write(pack / "entities.jsonl", '{"name": "n"}')
    assert {r.part: r.faults for r in files.pack_faults(files.read_pack(spark, str(pack))).collect()} == {"corpus": 1, "patterns": 0, "entities": 1}
    rows = spark.createDataFrame([("session_start", 3)], "phase string, emitted int")
    assert files.traces(rows, str(tmp_path / "trace")) and files.traces(rows, str(tmp_path / "trace")) and spark.read.json(str(tmp_path / "trace")).count() == 2
    files.append_json(rows, str(tmp_path / "log"))
    assert files.flags(["--a", "1", "--b", "--c", "x", "y"]) == {"a": "1", "c": "x"} and files.truthy("YES") and not files.truthy(None)
    os.makedirs(tmp_path / "repo" / ".git")
    os.makedirs(tmp_path / "repo" / "sub")
    assert files.folder_workspace(str(tmp_path / "repo" / "sub")) == files.folder_workspace(str(tmp_path / "repo")) and files.folder_workspace(None) is None and files.folder_workspace("x", "ws") == "ws"


def test_settings(tmp_path):
    path = write(tmp_path / "c.toml", "[main]", 'mode = "local"', 'data_dir = "d"')
    assert config.load(path, {}).mode == "local" and config.load(path, {"RECOLLECT_MODE": "remote"}).mode == "remote" and config.load(None, {}).mode is None
    with pytest.raises(ValueError):
        config.load(path, {"RECOLLECT_MODE": "odd"})
    with pytest.warns(UserWarning):
        assert config.load(write(tmp_path / "bad.toml", "= ="), {}).mode is None
    with pytest.warns(UserWarning):
        assert config.load(write(tmp_path / "odd.toml", "[a]", 'mode = "odd"'), {}).mode is None
    life = config.Lifecycle().over({"recall_strategy": "odd", "recall_budget": 9, "unknown": 1})
    assert life.recall_strategy == "topic_change" and life.recall_budget == 9 and life.over({"recall_strategy": "every_prompt"}).recall_budget == 9 and life.over(None) == life


def test_code_index(spark, tmp_path):
    for folder in ("pkg", "venv", "own"):
        os.makedirs(tmp_path / folder)
    write(tmp_path / "pkg" / "a.py", "def helper():", '    """Help."""', "    return 1", "class C:", "    def m(self):", "        return helper()")
    write(tmp_path / "pkg" / "b.py", "from pkg.a import helper", "def user():", "    return helper() + user()")
    write(tmp_path / "pkg" / "bad.py", "def (")
    write(tmp_path / "venv" / "x.py", "def hidden(): pass")
    write(tmp_path / "own" / "y.py", "def mine(): pass")
    found = code.definitions(code.read_code(spark, str(tmp_path), excluded=("own",))).cache()
    assert {r.qualified for r in found.collect() if r.name} == {"pkg.a.helper", "pkg.a.C", "pkg.a.C.m", "pkg.b.user"} and found.where("error IS NOT NULL").count() == 1
    assert {(r.source_id, r.target_id) for r in code.calls(found).collect()} == {("pkg.a.C", "pkg.a.helper"), ("pkg.a.C.m", "pkg.a.helper"), ("pkg.b.user", "pkg.a.helper")}
    item = code.code_items(found, "r").where("item_id = 'code:r:pkg.a.helper'").first()
    assert (item.content, item.origin) == ("Help.", "code:index")


def test_plugins(spark):
    held = plugins.Registry()
    held.add(plugins.Plugin("upper", "enricher", lambda items, col="t": items.withColumn(col, F.upper(col))))
    held.add(plugins.Plugin("second", "stage", lambda items: items, needs=("absent",)))
    assert held.apply("enricher", "upper", spark.createDataFrame([("a",)], "t string")).first().t == "A" and held.names("enricher") == ["upper"]
    with pytest.raises(LookupError):
        held.get("stage", "second")
    with pytest.raises(PermissionError):
        held.add(plugins.Plugin("net", "grounder", print, network=True))
    with pytest.raises(ValueError):
        held.add(plugins.Plugin("x", "odd", print))
    assert held.discover("recollect.none") == 0
    steps = [("a", lambda d: d.withColumn("x", F.lit(1))), ("b", lambda d: d.withColumn("y", F.lit(2))), ("c", lambda d: d.drop("x"))]
    out = enrich.run(spark.range(1), steps, stop="b")
    assert list(out) == ["a", "b"] and out["a"].columns == ["id", "x"] and list(enrich.run(out["b"], steps, start="c")) == ["c"]


def extractor(items):
    words = F.regexp_extract_all("content", F.lit(r"\b[A-Z][a-z]+\b"), 0)
    return items.select("item_id", F.explode(words).alias("name"), F.lit("concept").alias("label"), F.lit(None).cast("double").alias("confidence"))


def put(spark, *rows):
    return spark.createDataFrame([(i, c, t, p) for i, c, t, p in rows], "item_id string, content string, memory_type string, props map<string,string>")


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), extractor)
    assert store.get("a") == {} and store.items().count() == 0
    store.ingest(put(spark, ("a", "Spark and Arrow", None, {"project": "p", "memory_type": "forged"}), ("b", "plain words", "decision", None)))
    assert store.get("a")["project"] == "p" and store.get("a")["memory_type"] == "episodic"
    assert store.edges().count() == 4 and store.nodes().where("memory_type = 'entity'").count() == 2
    store.ingest(put(spark, ("c", "Spark again", "semantic", None)), sync=False, now=5)
    assert store.health().select("queue.pending").first()[0] == 1 and store.edges().count() == 4
    assert store.drain(now=6) == 1 and store.health().select("queue.done").first()[0] == 1 and store.edges().count() == 6
    assert store.nodes().where("memory_type = 'entity'").count() == 2  # found by its canonical key, not made again
    request = spark.createDataFrame([("b", "new", {"m": "1"}, {"content": "newer"}), ("z", None, None, None)], "item_id string, content string, metadata map<string,string>, properties map<string,string>")
    assert [r.item_id for r in store.update(request).collect()] == ["z"] and store.get("b")["content"] == "newer" and store.get("b")["m"] == "1"
    assert {r.item_id for r in store.search("*", filters={"project": "p"}).collect()} == {"a"} and store.search("newer", 3).first().item_id == "b"
    assert store.delete(spark.createDataFrame([("b",), ("q",)], "item_id string")).collect()[0].item_id == "q" and store.get("b") == {}
    assert store.properties(as_of=1).count() == 2
    page, total = store.list(2)
    assert page.count() == 2 and total == 4 and store.neighbours("a").count() == 4 and store.graph()[1].count() == 6
    assert store.recall(5).count() >= 1 and store.reindex().first().reindexed == 4
    store.add(put(spark, ("r1", "x", None, {"run_id": "7"}), ("r2", "y", None, {"run_id": "7"})))
    assert store.delete_run("7") == 2
    store.save_pattern(spark.createDataFrame([(1, "Spark", "T", 0.9, 2, "s")], "seq bigint, name string, label string, confidence double, cnt int, source string"))
    assert store.patterns().first().frequency == 2
    store.clear()
    assert store.items().count() == 0 and sync_remote() is None
    with pytest.raises(NotImplementedError):
        ingest.refuse_entities("x")


def test_enrichment_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    jobs = spark.createDataFrame([(1, "a", "pending"), (2, "a", "pending"), (3, "gone", "pending"), (4, "b", "done")], "id bigint, item_id string, status string")
    jobs.write.parquet(str(tmp_path / "jobs"))
    items = put(spark, ("a", "Spark and Arrow", "episodic", None), ("b", "Arrow", "episodic", None))
    none = lambda schema: spark.createDataFrame([], schema)
    source = spark.readStream.schema(jobs.schema).parquet(str(tmp_path / "jobs"))
    known = lambda: none("name string, label string, entity_id string")
    q = enrichment.worker(source, str(tmp_path / "out"), lambda: items, lambda: none("source_id string, target_id string, edge_type string"), known, extractor, str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/edges")).count() == 4 and spark.read.parquet(str(tmp_path / "out/done")).count() == 2

    def broken(_):
        raise RuntimeError("no model")

    q = enrichment.worker(source, str(tmp_path / "out2"), lambda: items, lambda: none("source_id string, target_id string, edge_type string"), known, broken, str(tmp_path / "ck2")).start()
    q.awaitTermination()
    assert {r.error for r in spark.read.parquet(str(tmp_path / "out2/failed")).collect()} == {"no model"}
    seen = []
    q = enrichment.broadcast(source, [broken_sink, lambda b, n: seen.append(b.count())], str(tmp_path / "ck3")).start()
    q.awaitTermination()
    assert seen == [4] and enrichment.evolution(items, [lambda d: d.where("item_id = 'a'")]).count() == 1


def broken_sink(batch, n):
    raise OSError("closed")


def test_ordered_fold_and_split(spark):
    rows = [("A", "x"), ("A", "y"), ("B", "y"), (None, "Y"), ("", "z"), ("", "w"), ("C", " \t")]
    df = spark.createDataFrame([(i, a, b, None) for i, (a, b) in enumerate(rows)], "rank int, item_id string, content string, memory_type string")
    assert [(r.item_id, r.content) for r in recall.ordered_dedup(df, 10).orderBy("rank").collect()] == [("A", "x"), ("B", "y"), ("", "z"), ("", "w")]
    with pytest.raises(Exception, match="too many candidates"):
        recall.ordered_dedup(spark.range(401).selectExpr("id AS rank", "CAST(id AS STRING) AS item_id", "'c' AS content", "'t' AS memory_type"), 5).collect()
    assert recall.split_counts(1) == (1, 0) and recall.split_counts(10) == (5, 5) and recall.split_counts(0) == (1, 0)


def test_gate_is_a_fold_on_the_last_recalled(spark):
    said = ["first", "yes", "first", " first ", "/cmd", "k", "second", "first", "okay", ""]
    turns = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(said)], "conv_id long, turn long, role string, text string")
    fires = [r.fires for r in sessions.gate(turns).orderBy("turn").collect()]
    assert fires == [True, False, False, False, False, False, True, True, True, False]
    # a vector far from the one recalled last fires, however near it is to the one before
    vectors = spark.createDataFrame([("s", 0, [1.0, 0.0]), ("s", 1, [0.8, 0.6]), ("s", 2, [0.5, 0.87]), ("s", 3, [0.0, 0.0]), ("t", 0, [1.0, 0.0])], "s string, n int, v array<double>")
    got = {(r.s, r.n): r.fires for r in sessions.topic_gate(vectors, "s", "n", "v", 0.7).collect()}
    assert got == {("s", 0): True, ("s", 1): False, ("s", 2): True, ("s", 3): True, ("t", 0): True}


def test_texts_and_embedding(spark):
    row = spark.createDataFrame([("t", None, "r" * 400, "a/b", "Some words here", "")], "n string, i string, r string, f string, c string, e string")
    got = row.select(X.tool_text(F.col("n"), F.col("i"), F.col("r")).alias("tool"), X.pattern_query(F.col("f")).alias("q"), X.embed(F.col("c")).alias("v"), X.embed(F.col("e")).alias("z")).first()
    assert got.tool == "Tool `t` called. Input: . Result: " + "r" * 300 and got.q.endswith("for b")
    assert abs(sum(x * x for x in got.v) - 1) < 1e-9 and not any(got.z) and len(got.v) == 64


def test_shapes_and_typed_captures(spark):
    rows = spark.createDataFrame([("i", "x")], "id string, content string")
    assert project.recall_shape(rows).first().asDict() == {"item_id": "i", "memory_type": "?", "content": "x", "origin": "", "confidence": 1.0, "stale": False}
    with pytest.raises(ValueError):
        ingest.typed(rows, "odd", [])
    with pytest.raises(ValueError):
        ingest.patch_rows(rows, rows, "odd")
    assert search.with_type(None, "a") == {"memory_type": "a"} and search.with_type({"memory_type": "b"}, "a") == {"memory_type": "b"}


def test_many_hops(spark):
    from recollect.operators import graph

    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "E") for i in range(12)] + [("n3", "n0", "E"), ("n0", "n0", "E"), ("n1", "n9", None)], "source_id string, target_id string, edge_type string")
    assert {r.item_id: r.hops for r in graph.within_hops(edges, "n0", 12).collect()} == {f"n{i}": i for i in range(13)}
