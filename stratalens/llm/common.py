"""What several operators share: stored intermediate tables, words, positions and running sums."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="stratalens-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share; it goes when the session ends.

    Only a local session may lack that setting (tests); on a cluster its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_folder()
    folder = f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a frame that reads it back.

    This cuts lineage: later jobs read finished files, whichever executors are lost. Unlike ``checkpoint()`` the plan
    runs once, and the files are columnar and compressed.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct: whatever their names, they cannot clash with an operator's own."""
    return F.struct(*(docs[c].alias(c) for c in docs.columns))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it if ``docs`` has a column of that name."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sums(df: DataFrame, values: dict[str, Column], order: list[str], by: list[str] | None = None) -> DataFrame:
    """Add a long column per entry of ``values``: its sum over the rows earlier in ``order`` (within ``by``).

    Two passes, so that no group is summed in one task: rows are range-partitioned by (by, order) and stored; sums per
    partition and group, a row each, give every partition its offset; inside a partition a window adds the rows up.
    ``df`` should be narrow. Rows that tie in ``order`` count in any order.
    """
    by = by or []
    dealt = store(
        df.withColumns({f"_v_{name}": value.cast("long") for name, value in values.items()})
        .repartitionByRange(max(partitions(df.sparkSession), 1), *by, *order)
        .withColumn("_part", F.spark_partition_id())
    )
    # Range partitions follow each other, so the earlier rows of a group are those of its earlier partitions.
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = dealt.groupBy("_part", *by).agg(*(F.sum(f"_v_{name}").alias(f"_s_{name}") for name in values))
    offsets = sums.select(
        F.col("_part").alias("_p"),
        *(F.col(c).alias(f"_b_{c}") for c in by),
        *(F.coalesce(F.sum(f"_s_{name}").over(earlier), zero).alias(f"_o_{name}") for name in values),
    )
    on = F.col("_part") == F.col("_p")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_b_{c}"))  # null is a group like any other
    return dealt.join(offsets, on).select(
        *df.columns,
        *(
            (F.col(f"_o_{name}") + F.coalesce(F.sum(f"_v_{name}").over(inside), zero)).alias(name)
            for name in values
        ),
    )
