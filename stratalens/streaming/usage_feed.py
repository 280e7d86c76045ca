"""The usage log as a stream of appended files, and the popularity table kept from it.

The published table is a folder with the rows each batch changed (``changes/<batch>``) and, every few batches, the whole
table (``tables/<batch>``). A folder counts once it is written to its end and is never written again, so readers see whole
batches only, and a batch that is replayed after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.usage import repo_popularity
from ..schemas import ANALYSES, POPULARITY

# Batches from one whole table to the next: what a reader merges at most.
TABLE_EVERY = 20

CHANGES, TABLES = "changes", "tables"


def stream_analyses(spark: SparkSession, folder: str) -> DataFrame:
    """Analyses as they are appended. A batch that is appended again after it was streamed comes twice."""
    return spark.readStream.schema(ANALYSES).option("recursiveFileLookup", "true").parquet(folder)


def _complete(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches below ``folder`` that were written to their end."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(int(mark.getPath().getParent().getName()) for mark in found or [])


def _write(table: DataFrame, folder: str) -> None:
    marked = table.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
    marked.parquet(folder)


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of each address."""
    tables = _complete(spark, f"{folder}/{TABLES}")[-1:]
    since = [batch for batch in _complete(spark, f"{folder}/{CHANGES}") if batch > max(tables, default=-1)]
    parts = [f"{folder}/{TABLES}/{batch}" for batch in tables] + [f"{folder}/{CHANGES}/{batch}" for batch in since]
    if not parts:
        return spark.createDataFrame([], POPULARITY)
    rows = spark.read.schema(POPULARITY).parquet(*parts)
    row = F.struct("batch", *[name for name in POPULARITY.names if name not in ("repo_url", "batch")])
    return rows.groupBy("repo_url").agg(F.max(row).alias("row")).select("repo_url", "row.*").select(*POPULARITY.names)


def read_popularity(spark: SparkSession, folder: str) -> DataFrame:
    """The published table as of its last whole batch."""
    return _merged(spark, folder).drop("batch")


def publish(changed: DataFrame, batch: int, folder: str, table_every: int = TABLE_EVERY) -> None:
    """Add the rows that ``batch`` changed, unless the batch is there already."""
    spark = changed.sparkSession
    if batch not in _complete(spark, f"{folder}/{CHANGES}"):
        _write(changed.withColumn("batch", F.lit(batch).cast("bigint")), f"{folder}/{CHANGES}/{batch}")
    if (batch + 1) % table_every == 0 and batch not in _complete(spark, f"{folder}/{TABLES}"):
        _write(_merged(spark, folder), f"{folder}/{TABLES}/{batch}")


def keep_popularity(
    feed: DataFrame, folder: str, checkpoint: str, table_every: int = TABLE_EVERY
) -> StreamingQuery:
    """Publish the popularity table in ``folder`` as analyses arrive; ``read_popularity`` reads it.

    State is one small row per address, and a batch writes only the addresses it saw. Both folders must be shared by
    all executors.
    """
    return (
        repo_popularity(feed)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda changed, batch: publish(changed, batch, folder, table_every))
        .trigger(availableNow=True)
        .start()
    )
