"""Git history from exported logs.

The export is ``git log --numstat --pretty=format:COMMIT:%H:%ae:%ct``, one text file per repository.

Logs are read line by line in splits, so no row is longer than a line, however many files a commit touches. What a line
needs from its surroundings is the header of its commit, which may stand in an earlier split. Headers are carried by a
segmented scan: within a split along its lines, from split to split by a table of one row per split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import COMMIT_FILES
from ..session import cut_lineage
from .files import file_system, list_files

HEADER = "COMMIT:"

# Bytes of a log that one task reads where Spark's reader passes it over, and bytes taken up at a time.
SPLIT_BYTES = 128 * 1024 * 1024
_CHUNK = 4 * 1024 * 1024

_LINES = "repo_id string, log string, start bigint, line string"
_CARRIED = "repo_id string, log string, start bigint, header string, line string"


def _lines_between(file, start: int, end: int) -> Iterator[list[bytes]]:
    """Lines of an open file that begin at ``start`` or later and before ``end``."""
    # From the byte before: what follows the first line break begins inside.
    at, skip, rest = max(start - 1, 0), start > 0, b""
    file.seek(at)
    while at < end:
        chunk = file.read(_CHUNK)
        if not chunk:
            if rest and not skip:
                yield [rest]
            return
        *whole, rest = (rest + chunk).split(b"\n")
        if skip and whole:
            at, skip = at + len(whole.pop(0)) + 1, False
        lines = []
        for line in whole:
            if at >= end:
                break
            lines.append(line)
            at += len(line) + 1
        if lines:
            yield lines


def _read_splits(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(row["location"]) as file:
                    for lines in _lines_between(file, row["start"], row["end"]):
                        texts = [line.decode("utf-8", "replace") for line in lines]
                        n = len(texts)
                        values = [[row["repo_id"]] * n, [row["location"]] * n, [row["start"]] * n, texts]
                        types = [pa.string(), pa.string(), pa.int64(), pa.string()]
                        arrays = [pa.array(v, t) for v, t in zip(values, types)]
                        yield pa.RecordBatch.from_arrays(arrays, names=["repo_id", "log", "start", "line"])

    return read


def _carry_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line of a split with the last header before it in the split; at the end of a split its last header, without a line.

    A split's lines come one after the other. A line before the first header of its split comes without one.
    """
    names = ["repo_id", "log", "start", "header", "line"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    split, last = None, None  # the split being read, and its last header

    def batch_of(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        repo, log, start, line = (batch.column(c) for c in names if c != "header")
        log_code = log.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        offset = start.to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.r_[True, (log_code[1:] != log_code[:-1]) | (offset[1:] != offset[:-1])])
        is_header = pc.starts_with(line, HEADER).to_numpy(zero_copy_only=False)
        row = np.arange(batch.num_rows)
        found = np.maximum.accumulate(np.where(is_header, row, -1))
        headless = found < np.repeat(begins, np.diff(np.r_[begins, batch.num_rows]))
        header = line.take(pa.array(found, mask=headless))
        first = (repo[0].as_py(), log[0].as_py(), start[0].as_py())
        ended = []
        if first == split and last is not None:
            reaches = np.zeros(batch.num_rows, bool)
            reaches[: begins[1] if len(begins) > 1 else batch.num_rows] = True
            header = pc.if_else(pa.array(reaches & headless), pa.scalar(last, pa.string()), header)
        elif last is not None:
            ended.append((*split, last, None))
        for end in (begins[1:] - 1).tolist():
            if header[end].is_valid:
                ended.append((repo[end].as_py(), log[end].as_py(), start[end].as_py(), header[end].as_py(), None))
        split, last = (repo[-1].as_py(), log[-1].as_py(), start[-1].as_py()), header[-1].as_py()
        if ended:
            yield batch_of(list(zip(*ended)))
        yield pa.RecordBatch.from_arrays([repo, log, start, header, line], names=names).filter(pa.array(~is_header))
    if last is not None:
        yield batch_of([[value] for value in (*split, last, None)])


def repository_of(address: str, base: str) -> str:
    """The repository of a log by its percent-encoded address: as ``_repository`` of its path below ``base``, else of its name."""
    path = unquote(address)  # a plus stands for itself
    _, below, inside = path.partition(f"{base}/")
    path = inside if below else path.rpartition("/")[2]
    folder = re.search(r"(?:^|/)repo_id=([^/]*)/", path)
    return (folder and folder.group(1)) or re.sub(r"(?<=[^/])\.[^./]*$", "", path)


def _carry_in_logs(base: str):
    """``_carry_headers`` for lines that come without a repository, which is found once per log and batch, not per line."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = batch.column("log").dictionary_encode()
            repos = pa.array([repository_of(log, base) for log in logs.dictionary.to_pylist()], pa.string())
            columns = [repos.take(logs.indices), *(batch.column(c) for c in ("log", "start", "line"))]
            yield pa.RecordBatch.from_arrays(columns, names=["repo_id", "log", "start", "line"])

    return lambda batches: _carry_headers(named(batches))


def _headers_between_splits(edges: DataFrame) -> DataFrame:
    """Lines before the first header of their split, with the last header of an earlier split of the log.

    ``edges`` holds those lines and the last header of each split. The window runs over one row per split.
    """
    last = F.max(F.when(F.col("line").isNull(), F.col("header"))).alias("_last")
    splits = edges.groupBy("log", "start").agg(last)
    earlier = Window.partitionBy("log").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reaching = splits.select("log", "start", F.last("_last", True).over(earlier).alias("_reaching"))
    lines = edges.where(F.col("line").isNotNull())
    joined = lines.join(reaching.where(F.col("_reaching").isNotNull()), ["log", "start"])
    return joined.select("repo_id", F.col("_reaching").alias("header"), "line")


def read_history(spark: SparkSession, folder: str) -> DataFrame:
    """(repo_id, header, line): lines that may be counts of a file, each with the header line of its commit.

    Logs are read in splits, of which each task reads its own lines. A repository is the ``repo_id=...`` folder a log is in,
    or else the path of the log below ``folder`` without extension, so logs of one name in different folders stay apart.
    Spark's reader passes over names that start with ``_`` or ``.``; splits of such logs are read by offset. Lines before
    the first header of a log belong to no commit and are left out. A log that cannot be read fails the job.

    Logs longer than the smallest split are read twice, the first time to store the headers that reach into a later split.
    """
    base = file_system(folder)[1].rstrip("/")
    logs = list_files(spark, folder, repo_id="").where(~F.col("path").rlike(r"(^|/)(_SUCCESS|[._].*\.crc)$"))
    passed_over = F.col("path").rlike(r"(^|/)(\.|_(?![^/]*=))")
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(SPLIT_BYTES).cast("bigint"))
    in_tasks = (
        logs.where(passed_over & (F.col("length") > 0))
        .select(_repository(F.col("path")).alias("repo_id"), "location", "length", F.explode(starts).alias("start"))
        .select("repo_id", "location", "start", F.least(F.col("start") + SPLIT_BYTES, F.col("length")).alias("end"))
        .repartition("location", "start")
        .mapInArrow(_read_splits(folder), _LINES)
    )
    # Spark makes no smaller splits than this; shorter logs are whole.
    whole = min(_bytes(spark, "spark.sql.files.maxPartitionBytes"), _bytes(spark, "spark.sql.files.openCostInBytes"))
    sizes = logs.groupBy(passed_over.alias("hidden")).agg(F.max("length").alias("longest")).collect()
    longest = {row.hidden: row.longest for row in sizes}
    sources, split_sources = [in_tasks], []
    if longest.get(True, 0) > SPLIT_BYTES:
        split_sources.append(in_tasks)
    if False in longest:
        lines = _spark_lines(spark, folder)
        sources.append(lines.drop("size"))
        if longest[False] > whole:
            split_sources.append(lines.where(F.col("size") > whole).drop("size"))
    headed = _united(sources, base).where(F.col("header").isNotNull() & F.col("line").isNotNull()).select("repo_id", "header", "line")
    if not split_sources:
        return headed
    edges = cut_lineage(_united(split_sources, base).where(F.col("header").isNull() | F.col("line").isNull()))
    return headed.unionByName(_headers_between_splits(edges))


def _united(sources: list[DataFrame], base: str) -> DataFrame:
    carried = [
        source.where(_counts_or_header(F.col("line"))).mapInArrow(
            _carry_headers if "repo_id" in source.columns else _carry_in_logs(base), _CARRIED
        )
        for source in sources
    ]
    return carried[0] if len(carried) == 1 else carried[0].unionByName(carried[1])


def _counts_or_header(line: Column) -> Column:
    return F.startswith(line, F.lit(HEADER)) | F.contains(line, F.lit("\t"))


def _spark_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(log, start, line, size) of the logs that Spark's reader sees, the lines of a split in order."""
    texts = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(folder)
    return texts.select(
        F.col("_metadata.file_path").alias("log"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").alias("line"),
        F.col("_metadata.file_size").alias("size"),
    )


def _bytes(spark: SparkSession, setting: str) -> int:
    """A size setting in bytes."""
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting))


def _repository(path: Column) -> Column:
    """The repo_id=... folder a log is in, or its path without extension."""
    folder = F.nullif(F.regexp_extract(path, r"(?:^|/)repo_id=([^/]*)/", 1), F.lit(""))
    return F.coalesce(folder, F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""))


# Fixed value: white space that does not count at the ends of a line.
BLANKS = " \t\r\f\v"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def record_lines(records: DataFrame) -> DataFrame:
    """(repo_id, header, line) of (repo_id, record), where a record is the text of a commit, with or without the header's mark."""
    # An outer explode: for a plain one Spark would add a test that there are lines, splitting each record twice.
    marked = F.when(F.startswith("record", F.lit(HEADER)), F.col("record")).otherwise(
        F.concat(F.lit(HEADER), "record")
    )
    return records.select("repo_id", F.split(marked, "\n").alias("lines")).select(
        "repo_id",
        F.get("lines", F.lit(0)).alias("header"),
        F.explode_outer(F.slice("lines", 2, F.size("lines"))).alias("line"),
    )


def parse_history(history: DataFrame) -> DataFrame:
    """The commit_files table of ``read_history``'s lines, or of commit records (repo_id, record).

    A line counts when it has exactly three tab-separated fields, of which the first two are integers; that
    leaves out binary files, which show dashes. Renamed paths stay as git writes them. The author ends at the
    next colon.
    """
    lines = record_lines(history) if "record" in history.columns else history
    header = F.col("parts")
    seconds = F.try_element_at(header, F.lit(-1)).try_cast("bigint")
    stamp = F.when(F.size(header) > 3, F.timestamp_seconds(seconds).cast("timestamp_ntz"))
    count = lambda i: F.get("fields", F.lit(i)).try_cast("int")
    return (
        lines.withColumn("fields", F.split(_trimmed(F.col("line")), "\t"))
        .where(F.size("fields") == 3)
        .withColumns({"path": F.get("fields", F.lit(2)), "added": count(0), "removed": count(1)})
        .where(F.col("added").isNotNull() & F.col("removed").isNotNull())
        .withColumn("parts", F.split(_trimmed(F.col("header")), ":"))
        .withColumns(
            {
                "commit_hash": F.get(header, F.lit(1)),
                "author_email": F.coalesce(F.get(header, F.lit(2)), F.lit("")),
                "commit_ts": stamp,
            }
        )
        .select(*COMMIT_FILES.names)
    )
