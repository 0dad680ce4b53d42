"""Shared storage for intermediate tables, and small helpers all operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shuffles_released

#: Words are runs of characters other than the space and U+0009 to U+000D.
WORD_SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary folder is
    made; on a cluster that would be each executor's own, so it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='caminho-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage: a lost executor costs a re-read, not the work behind the table. So the
    shuffles behind it need not outlive the write, and are deleted after it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/caminho/{tag}-{uuid.uuid4().hex}"
    with shuffles_released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salts: int = 8) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, where right has one (small) row a key and left
    may have very many: rows of one key are dealt over ``salts`` tasks by a hash of the rest,
    and right is repeated for each."""
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(repeated, [key, "_salt"], how).drop("_salt")


def words(text: Column) -> Column:
    """Array of the words of ``text``; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, counted without keeping them."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WORD_SPACE))).cast("long")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where body uses it in lambdas."""
    return F.transform(F.array(value), body)[0]
