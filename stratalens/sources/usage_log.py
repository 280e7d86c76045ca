"""The stored usage log and its CSV exports.

A log is a folder of Parquet files. Each append is a folder ``batch=<key>`` in it; files beside those are read too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.usage import valid_leads
from ..schemas import ANALYSES, LEADS, conform_analyses, conform_leads


def _append(records: DataFrame, folder: str, batch: str | None) -> None:
    keyed = records.withColumn("batch", F.lit(batch or uuid.uuid4().hex))
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)


def append_analyses(records: DataFrame, folder: str, batch: str | None = None) -> None:
    """Append analyses as one batch.

    An append that is tried again under its ``batch`` key takes the place of what the first try left, so nothing
    counts twice; one without a key is a batch of its own. A batch without rows leaves the log as it is.
    """
    _append(conform_analyses(records), folder, batch)


def append_leads(records: DataFrame, folder: str, batch: str | None = None) -> None:
    """Append leads like analyses; those without any contact are refused."""
    _append(conform_leads(valid_leads(records)), folder, batch)


def _read(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def read_analyses(spark: SparkSession, folder: str) -> DataFrame:
    """All analyses, also those written before the newer columns existed; those read as 0 or null.

    Columns once written in a narrower type are widened by the scan; no file is opened to find the schema.
    """
    return conform_analyses(_read(spark, folder, ANALYSES))


def read_leads(spark: SparkSession, folder: str) -> DataFrame:
    return conform_leads(_read(spark, folder, LEADS))


def merge_analyses(*parts: DataFrame) -> DataFrame:
    """Union of analyses tables of different ages."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return conform_analyses(merged)


def newest_first(log: DataFrame) -> DataFrame:
    return log.orderBy(F.desc("timestamp"), F.desc("id"))


# Times in exports, to the microsecond.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _export(log: DataFrame, folder: str) -> None:
    times = {"header": True, "timestampNTZFormat": TIME_FORMAT}
    newest_first(log).write.mode("overwrite").options(**times).csv(folder)


def export_analyses(analyses: DataFrame, folder: str) -> None:
    """All analyses as CSV, newest first; the parts in name order are one sorted listing."""
    _export(conform_analyses(analyses), folder)


def export_leads(leads: DataFrame, folder: str) -> None:
    _export(conform_leads(leads), folder)
