"""Code repositories as items: definitions, and the calls between them."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators.predicates import code_path

FOUND = "path string, kind string, name string, qualified string, line int, docstring string, calls array<string>, error string"
ENDINGS = {"python": ("*.py",), "typescript": ("*.ts", "*.tsx")}


def read_code(spark: SparkSession, root: str, languages: tuple[str, ...] = ("python",), excluded: tuple[str, ...] = ()) -> DataFrame:
    """path (below `root`) and source of the files of these languages, folders left out as `code_path` says."""
    out = None
    for ending in [e for name in languages for e in ENDINGS[name]]:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", ending).load(root)
        below = F.regexp_replace("path", r"^[a-z]+:/*" + root.strip("/").replace("\\", "/").replace(".", "[.]") + "/", "")
        one = rows.select(below.alias("path"), F.decode("content", "UTF-8").alias("source")).where(code_path(F.col("path"), excluded))
        out = one if out is None else out.unionByName(one)
    return out


def _definitions(path: str, source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as error:
        return [(path, None, None, None, None, None, [], str(error))]
    module, out = path.removesuffix(".py").removesuffix("/__init__").replace("/", "."), []
    todo = [(module, node) for node in tree.body]
    while todo:
        above, node = todo.pop()
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            calls = sorted({c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name | ast.Attribute)})
            out.append((path, kind, node.name, f"{above}.{node.name}", node.lineno, ast.get_docstring(node), calls, None))
            todo += [(f"{above}.{node.name}", child) for child in node.body]
    return out


def definitions(files: DataFrame) -> DataFrame:
    """Functions and classes of Python files with what they call; a file that does not parse gives one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in FOUND.split(", ")]
        for frame in frames:
            rows = [r for path, source in zip(frame["path"], frame["source"]) for r in _definitions(path, source)]
            yield pd.DataFrame(rows, columns=columns).astype({"line": "Int32"})

    return files.where("path LIKE '%.py'").select("path", "source").mapInPandas(run, FOUND)


def calls(found: DataFrame) -> DataFrame:
    """Call edges between definitions: a name called in one place and defined in others links to each; recursion is no edge."""
    targets = found.where("name IS NOT NULL").select("name", F.col("qualified").alias("target_id"))
    made = found.where("name IS NOT NULL").select(F.col("qualified").alias("source_id"), F.explode("calls").alias("name"))
    return made.join(targets, "name").where("source_id <> target_id").select("source_id", "target_id", F.lit("CALLS").alias("edge_type")).distinct()


def code_items(found: DataFrame, repo: str) -> DataFrame:
    """Definitions as items of origin code:index; the id is the repository and the qualified name."""
    named = found.where("name IS NOT NULL")
    return named.select(F.concat(F.lit(f"code:{repo}:"), "qualified").alias("item_id"), F.coalesce("docstring", "qualified").alias("content"), F.lit("code").alias("memory_type"), F.lit("code:index").alias("origin"), "path")
