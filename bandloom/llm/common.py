"""What the corpus operators share: table access, intermediate tables, word patterns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.plans.session import shared_dir
from bandloom.plans.ship import ship

#: Words are runs of anything but these ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: The same six characters, for translate().
BLANK_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def set_aside(docs: DataFrame, *needed: str, made: Sequence[str] = ()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the needed ones under names that clash with none, and the way back to docs' columns and
    the made ones. A column of docs that has the name of a made one gives way to it."""
    safe = {c: c if c in needed else f"_extra{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*safe.values()), lambda df: df.select(*(F.col(s).alias(c) for c, s in safe.items() if c not in made), *made)


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text. (translate() and a plain split would be slower: it looks up each character.)"""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
