"""What the corpus operators share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Held-out rows are those whose crc32(doc_id as text) mod 5 is 0.
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS


def width(spark: SparkSession) -> int:
    """Partitions for explicit exchanges: the session's own setting, which the cluster sizes to the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def packed(docs: DataFrame) -> Column:
    """The whole row as one struct, so that no name of its columns can clash with another."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it from there: lineage ends, lost executors cost nothing."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        where = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors of a cluster need a shared folder")
        # a local master shares the machine's folders
        context.setCheckpointDir(where or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return df.checkpoint(eager=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once: what a lambda names from outside is evaluated anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(lengths: Column, block: int = 256) -> Column:
    """Exclusive prefix sums of a non-empty array<bigint>, in blocks so that the work stays near linear for long arrays."""
    zero = F.lit(0).cast("bigint")
    total = lambda a: F.aggregate(a, zero, lambda acc, x: acc + x)
    of = lambda i: F.floor(i / F.lit(block)).cast("int")

    def before(own: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), of(F.size(own) - 1)), lambda b: total(F.slice(own, b * block + 1, F.lit(block))))
        return F.aggregate(sums, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    return let(lengths, lambda own: let(before(own), lambda ahead: F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.get(ahead, of(i)) + total(F.slice(own, of(i) * block + 1, i % block)))))
