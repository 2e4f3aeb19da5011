"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.session import ensure_checkpoint_dir

#: A word is a maximal run without the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
#: Stands for a null doc_id inside operators that join on it; turned back into null at the end.
NO_ID = -(1 << 63)


def ship(module: str) -> None:
    """Pickle the functions of ``module`` by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: Catalyst may otherwise inline it into every lambda call."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` (long) and ``text`` (null: empty) only; other columns, clashing or not, are left behind."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def words_of(text: Column) -> Column:
    """Array of the words of a text."""
    return let(F.btrim(text, F.lit(" \t\n\x0b\f\r")), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE + "+")))


def n_words_of(text: Column) -> Column:
    """Number of words, without keeping the array of them."""
    return F.size(words_of(text)).cast("long")


def shingles_of(words: Column) -> Column:
    """64-bit hashes of all five-word windows; one hash of all words when there are one to four; empty without words."""
    return let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
               .when(F.size(w) < SHINGLE_WORDS, F.array(F.xxhash64(F.array_join(w, " "))))
               .otherwise(F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SHINGLE_WORDS)])), F.lit(1), F.size(w) - (SHINGLE_WORDS - 1))))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder; it outlives lost executors."""
    path = shared_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
