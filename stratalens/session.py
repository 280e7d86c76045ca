"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "stratalens", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    The master and ``spark.checkpoint.dir`` normally come from the cluster; pass them only in tests.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # A repository that holds much of a table is split also where joins on it follow each other.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.checkpoint.compress": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A private folder is made only in local mode, where no cluster names one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="stratalens-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """Name of a new folder below the checkpoint folder; it goes when the session ends."""
    folder = f"{_checkpoint_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the checkpoint folder and return a frame that reads it back.

    What is read back has the size of its files, so Spark's size checks see how large it is. After ``checkpoint()`` they see
    what was guessed before, which is far too small where rows were made from texts, and such a table would be broadcast.
    """
    folder = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
