"""Files that the engine reads and writes: pattern lists, seed manifests, corpora, plain lines, event and trace logs.

All go through Spark's readers and writers, so any file system it knows works, and a finished write is renamed into place."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN = "name string, label string, confidence double, frequency int, source string, broken string"
RECORD = "item_id string, content string, memory_type string, metadata map<string,string>, broken string"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; `broken` has the line where it is none. Blank lines give rows of nulls."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    return spark.read.text(path).select(F.from_json("value", schema, options).alias("row")).select("row.*")


def read_patterns(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """name and label of active patterns from a file of JSON lines. Blank and broken lines are left out; good ones after them stay."""
    rows = _json(spark, path, PATTERN).where("broken IS NULL AND name IS NOT NULL")
    return rows.where(F.coalesce("frequency", F.lit(1)) >= least).select("name", "label")


def all_patterns(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, PATTERN).where("broken IS NULL AND name IS NOT NULL").drop("broken")


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """file, checksum, count and label of a manifest; None where it cannot be read, which callers take as none bundled or none applied."""
    try:
        raw = spark.read.text(path, wholetext=True)
        files = F.from_json("value", "struct<version:string,files:map<string,struct<checksum:string,count:int,label:string>>>")["files"]
        rows = raw.select(F.explode(files).alias("file", "info")).select("file", "info.checksum", "info.count", "info.label")
        return rows if rows.limit(1).count() else None
    except Exception as error:  # a missing path is an analysis error of its own kind
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def read_seeds(spark: SparkSession, folder: str, files: list[str]) -> DataFrame:
    """The patterns of seed files in the order given: file and seq, then the pattern."""
    out = None
    for n, name in enumerate(files):
        rows = all_patterns(spark, f"{folder}/{name}")
        one = rows.select(F.lit(name).alias("file"), (F.lit(n) * F.lit(1 << 40) + F.monotonically_increasing_id()).alias("seq"), *(c for c in rows.columns))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "file string, seq bigint, name string, label string, confidence double, frequency int, source string")


def seed_legacy(spark: SparkSession, seed: str, store: DataFrame | None) -> DataFrame:
    """One seed file for all, taken over only where there is no store yet."""
    return all_patterns(spark, seed) if store is None else store


def read_corpus(spark: SparkSession, path: str, domain: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, broken lines) of a corpus of JSON lines: a header line, then records; `domain` filters by metadata."""
    rows = _json(spark, path, RECORD + ", source string, item_count bigint")
    own = rows.where("broken IS NULL AND source IS NULL AND item_count IS NULL AND coalesce(item_id, content) IS NOT NULL")
    if domain is not None:
        own = own.where(F.coalesce(F.try_element_at("metadata", F.lit("domain")) == domain, F.lit(False)))
    return own.select("item_id", "content", "memory_type", "metadata"), rows.where("broken IS NOT NULL").select("broken")


def corpus_header(spark: SparkSession, path: str) -> dict:
    """source, domain and item_count of a corpus's header line."""
    found = spark.read.schema("source string, domain string, item_count bigint").json(path).where("source IS NOT NULL").limit(1).collect()
    return found[0].asDict() if found else {"source": None, "domain": None, "item_count": None}


def write_corpus(items: DataFrame, path: str, source: str = "export", domain: str = "", memory_type: str | None = None, limit: int = 0, entities: bool = False) -> int:
    """Write items as a corpus folder and return their number: the header is one line in a part of its own. `limit` 0 means all."""
    rows = items if entities else items.where(~F.coalesce(F.col("memory_type"), F.lit("")).isin("entity", "relation", "Version", "pattern"))
    rows = rows if memory_type is None else rows.where(F.col("memory_type") == memory_type)
    rows = rows.orderBy("item_id").limit(limit) if limit else rows
    columns = [c for c in ("item_id", "content", "memory_type", "metadata") if c in rows.columns]
    count = rows.count()
    head = items.sparkSession.createDataFrame([(source, domain, count)], "source string, domain string, item_count bigint")
    head.coalesce(1).write.mode("overwrite").json(path)
    rows.select(*columns).write.mode("append").json(path)
    return count


def convert_triplets(rows: DataFrame, limit: int = 0, domain: str = "") -> DataFrame:
    """Corpus records from rows of a relation dataset (id, text, triplets): text as content, triplets as JSON in the metadata."""
    rows = rows.orderBy("id").limit(limit) if limit else rows
    meta = F.create_map(F.lit("domain"), F.lit(domain), F.lit("relations"), F.to_json("triplets"))
    return rows.where("coalesce(text, '') <> ''").select(F.col("id").cast("string").alias("item_id"), F.col("text").alias("content"), F.lit("semantic").alias("memory_type"), meta.alias("metadata"))


def read_lines(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """content of each line that is not blank, stripped, or of the whole input; empty input is an error."""
    rows = spark.read.text(path, wholetext=whole).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("content")).where("content <> ''")
    if rows.limit(1).count() == 0:
        raise ValueError("no input")
    return rows


def append_json(rows: DataFrame, path: str) -> None:
    """Add rows to a log of JSON lines."""
    rows.write.mode("append").json(path)


def read_pack(spark: SparkSession, folder: str, corpus: bool = True, patterns: bool = True) -> dict[str, DataFrame]:
    """A pack's parts from a local folder: corpus, patterns and entities; skipped parts are not read."""
    out: dict[str, DataFrame] = {}
    if corpus:
        out["corpus"] = read_corpus(spark, f"{folder}/corpus.jsonl")[0]
    if patterns:
        out["patterns"] = all_patterns(spark, f"{folder}/patterns.jsonl")
        out["entities"] = all_patterns(spark, f"{folder}/entities.jsonl")
    return out


def pack_faults(pack: dict[str, DataFrame]) -> DataFrame:
    """part and number of rows that lack what they need: content, or a name and a label."""
    out = None
    for part, rows in sorted(pack.items()):
        bad = F.col("content").isNull() if part == "corpus" else F.col("name").isNull() | F.col("label").isNull()
        one = rows.agg(F.lit(part).alias("part"), F.count_if(bad).alias("faults"))
        out = one if out is None else out.unionByName(one)
    return out


def traces(rows: DataFrame, path: str, most_bytes: int = 10 << 20) -> bool:
    """Add recall traces to a log cut into files of at most about `most_bytes`; a failure is reported, never raised."""
    try:
        rows.write.mode("append").option("maxRecordsPerFile", max(1, most_bytes // 512)).json(path)
        return True
    except Exception:
        return False


def truthy(value: str | None) -> bool:
    """Environment flags: 1, true and yes in any case."""
    return (value or "").lower() in ("1", "true", "yes")


def flags(args: list[str]) -> dict[str, str]:
    """`--key value` pairs; a value that is a flag itself is not one."""
    found, k = {}, 0
    while k < len(args):
        pair = args[k].startswith("--") and k + 1 < len(args) and not args[k + 1].startswith("--")
        if pair:
            found[args[k][2:]] = args[k + 1]
        k += 2 if pair else 1
    return found


def folder_workspace(folder: str | None, env: str | None = None) -> str | None:
    """A configured workspace, else one derived from the real path of the folder's repository root (or the folder)."""
    import hashlib

    if env:
        return env
    if not folder:
        return None
    real = os.path.realpath(folder)
    top = real
    while not os.path.isdir(os.path.join(top, ".git")):
        up = os.path.dirname(top)
        if up == top:
            top = real
            break
        top = up
    return "ws_" + hashlib.sha1(os.path.realpath(top).encode()).hexdigest()[:12]
