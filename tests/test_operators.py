import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions import scalar as X
from recollect.functions.scalar import cosine
from recollect.operators import evolve, mutations, patterns, recall, search
from recollect.streaming import sessions


def scan(spark, rows, k=10):
    df = spark.createDataFrame([(i, a, b, "semantic") for i, (a, b) in enumerate(rows)], "rank int, item_id string, content string, memory_type string")
    return [(r.item_id, r.content) for r in recall.ordered_dedup(df, k).orderBy("rank").collect()]


def test_only_survivors_register_keys(spark):
    assert scan(spark, [("A", "x"), ("B", "x"), ("B", "y")]) == [("A", "x"), ("B", "y")]
    assert scan(spark, [("A", "x"), ("A", "y"), ("B", "y")]) == [("A", "x"), ("B", "y")]
    assert scan(spark, [("A", " \t"), ("B", "y"), (None, "Y")]) == [("B", "y")]
    assert scan(spark, [("A", "x"), ("B", "y")], 1) == [("A", "x")]


def test_origin_policy(spark):
    df = spark.createDataFrame([("cli:add",), ("hook:x",), ("structured:y",), ("seed:demo",), ("unknown",), (None,), ("user:a",)], "origin string")
    got = {r.origin: (r.t, r.c) for r in df.select("origin", X.origin_tier(F.col("origin")).alias("t"), X.confidence_ceiling(F.col("origin")).alias("c")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"cli:add": 1, "hook:x": 4, "structured:y": 4, "seed:demo": 4, "unknown": 1, None: 1, "user:a": 1}
    assert got["unknown"][1] == 0.3 and got["user:a"][1] == 1.0


@pytest.mark.parametrize("at, fresh", [("2024-01-03T01:00:00Z", True), ("2024-01-02T00:00:00Z", False), (None, True), ("rubbish", True)])
def test_snapshot_age(spark, at, fresh):
    df = spark.createDataFrame([(at,)], "at string")
    assert df.select(X.fresh(F.col("at"), F.to_timestamp(F.lit("2024-01-11T00:00:00Z")))).first()[0] is fresh


def test_strip_and_session_key(spark):
    df = spark.createDataFrame([("\t a b \n", "a/b c!"), (None, "//")], "t string, s string")
    assert [tuple(r) for r in df.select(X.strip(F.col("t")), X.session_key(F.col("s"))).collect()] == [("a b", "abc"), ("", "unknown")]


def test_mutation_fold(spark):
    log = spark.createDataFrame(
        [("i", 1, "put", "a", "1"), ("i", 2, "merge", "b", "2"), ("i", 3, "merge", "a", "3"), ("j", 1, "put", "a", "1"), ("j", 2, "delete", None, None), ("j", 3, "merge", "z", "9"), ("k", 1, "put", "a", "1"), ("k", 2, "replace", "c", "4")],
        "item_id string, tx_seq long, op string, k string, v string",
    )
    assert sorted(map(tuple, mutations.fold(log).collect())) == [("i", "a", "3"), ("i", "b", "2"), ("k", "c", "4")]
    assert sorted(map(tuple, mutations.fold(log, as_of=1).collect())) == [("i", "a", "1"), ("j", "a", "1"), ("k", "a", "1")]


def test_pattern_fold(spark):
    log = spark.createDataFrame([(1, "Spark", "T", 0.5, 1, "s"), (2, "spark", "U", 0.9, 5, "t")], "seq long, name string, label string, confidence double, cnt int, source string")
    r = patterns.fold(log).first()
    assert (r.name, r.label, r.confidence, r.frequency) == ("Spark", "T", 0.9, 2)


def test_streamed_session_state(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "system", "s")], "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a processing-time timeout else asks for batches for ever
    turns.write.parquet(str(tmp_path / "in"))
    stream = sessions.session_state(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("state").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert sorted((r.conv_id, r.turn_count, r.observation_count, r.last_prompt) for r in spark.table("state").collect()) == [(1, 2, 1, "c"), (2, 0, 0, None)]


def test_together_counts_large_buckets(spark):
    rows = [(u, f"i{k:03}") for u in (1, 2) for k in range(60)] + [(3, "i000"), (3, "i001"), (3, None), (None, "i000"), (None, "i001"), (4, "i005")]
    for block in (7, 256):
        got = {(r.a, r.b): r.weight for r in evolve.together(spark.createDataFrame(rows, "u int, item string"), "u", "item", block=block).collect()}
        assert len(got) == 60 * 59 // 2 and got.pop(("i000", "i001")) == 3 and set(got.values()) == {2}


def test_knn_join_same_as_pairs(spark):
    r = random.Random(5)
    vecs = [[r.choice((-1.0, 0.5, 2.0)) if i % 3 else r.gauss(0, 1) for _ in range(4)] for i in range(300)] + [[0.0] * 4, [1e-30] * 4, [3e38] * 4, [float("nan"), 1.0, 0.0, 0.0], [1.0, None, 0.0, 0.0], None, [1.0], []] + [[1.0, 2.0, 3.0, 4.0]] * 40
    v = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<float>")
    pairs = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("probe")).crossJoin(v).select("query_id", "vec_id", F.round(cosine(F.col("embedding"), F.col("probe")), 6).alias("score"))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))).where("rank <= 7")
    assert want.count() == 7 * len(vecs)
    for block, chunk in ((4096, 16384), (50, 90)):
        found = search.knn_join(v, v, 7, block=block, chunk=chunk)
        assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoopJoin" not in plan
        assert {str(tuple(x)) for x in found.select(*want.columns).collect()} == {str(tuple(x)) for x in want.collect()}
