"""Running statistics over a stream of values: the same sums as the batch form, kept as state by group."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.operators.stats import summary
from bandloom.plans.session import shared_dir


def running_statistics(stream: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, min_v, max_v, mean_v, std_v) of a stream so far; the state is a few sums for each group."""
    return stream.groupBy(group).agg(*summary(value))


def windowed_statistics(stream: DataFrame, time: str, group: str, value: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """The same by window of time; groups later than the watermark are dropped and their state forgotten."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every), group).agg(*summary(value))


def statistics_of_stream(spark: SparkSession, path: str, group: str, value: str) -> DataFrame:
    """Reads a Parquet path to its end as a stream and gives the final statistics."""
    batch = spark.read.parquet(path)
    folder, name = os.path.split(path.rstrip("/"))
    reader = spark.readStream.schema(batch.schema)
    single = [os.path.basename(f) for f in batch.inputFiles()] == [name]  # a stream reads folders
    source = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    table = f"running_{uuid.uuid4().hex}"
    base = shared_dir(spark)
    writer = running_statistics(source, group, value).writeStream.outputMode("complete").format("memory").queryName(table)
    run = writer.option("checkpointLocation", f"{base}/{table}").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(table)
