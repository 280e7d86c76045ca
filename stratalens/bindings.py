"""Views over the test tables that stand in for the engine's inputs.

Each is one SQL text that both Spark and DuckDB read the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.samples import SAMPLES

COMMIT_FILES = """
SELECT concat('r', l_suppkey % 3) AS repo_id,
       concat('h', l_orderkey) AS commit_hash,
       concat('c', o_custkey % 400, '@example.org') AS author_email,
       o_orderdate AS commit_ts,
       concat('dir', (l_partkey % 200) % 7, '/f', l_partkey % 200, '.py') AS path,
       CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN NULL ELSE CAST(l_quantity AS INT) END AS added,
       CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN NULL ELSE CAST(l_linenumber AS INT) END AS removed
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

TAGS = """
SELECT concat('r', user_id % 3) AS repo_id,
       concat('dir', (user_id % 200) % 7, '/f', user_id % 200, '.py') AS path,
       CAST(event_id % 500 AS INT) AS line,
       CASE WHEN k % 10 = 0 THEN concat('_k', k) ELSE concat('k', k) END AS name,
       CASE WHEN event_type = 'signup' OR user_id % 25 = 3 THEN 'def' ELSE 'ref' END AS kind
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e
"""

SOURCE_FILES = """
SELECT source AS repo_id,
       concat(lang, '/d', doc_id % 10, '/', doc_id, '.', lang) AS path,
       text AS content
FROM {documents}
"""

ANALYSES = """
SELECT event_id AS id,
       concat('https://github.com/org', user_id % 20, '/repo', user_id % 97) AS repo_url,
       concat('repo', user_id % 97, '-', event_type) AS repo_name,
       ts AS timestamp,
       CAST(event_id % 300 AS INT) AS file_count,
       CAST(event_id % 30 AS INT) AS churn_files_count,
       value AS duration_seconds
FROM {events}
"""

LEADS = """
SELECT event_id AS id,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('u', user_id, '@example.org') END AS email,
       CASE WHEN event_id % 2 = 0 THEN NULL ELSE concat('https://linkedin.com/in/u', user_id) END AS linkedin,
       concat('https://github.com/org', user_id % 20, '/repo', user_id % 97) AS repo_url,
       concat('repo', user_id % 97) AS repo_name,
       ts AS timestamp
FROM {events} WHERE event_type IN ('signup', 'purchase')
"""

URLS = r"""
SELECT url FROM {pages}
UNION ALL SELECT concat('  https://github.com/org', p_partkey % 50, '/Repo.', p_size, '/ ') FROM {part}
UNION ALL SELECT concat('https://github.com/', p_brand, '/', p_name) FROM {part}
"""

# Place of a file of code for each part; the text is a sample with the part's number put in.
_CODE_REPO = "concat('r', p_partkey % 5)"
_CODE_PATH = "concat('src/d', p_size % 3, '/f', p_partkey, '.{extension}')"

CODE_PARTITIONS = 32

# Instant and length of the history window used with COMMIT_FILES.
AS_OF = "2001-08-01"
MONTHS = 6

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def bind(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """The binding ``text`` over the parquet tables in ``folder``."""
    used = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in TABLES if f"{{{name}}}" in text}
    return spark.sql(text, **used)


def code_files(spark: SparkSession, folder: str, langs: list[str]) -> DataFrame:
    """A file in each language for each row of the part table."""
    part = spark.read.parquet(f"{folder}/part.parquet")
    texts = F.explode(F.array(*(F.struct(F.lit(SAMPLES[x].extension).alias("extension"), F.lit(SAMPLES[x].text).alias("text")) for x in langs)))
    path = F.concat(F.expr(_CODE_PATH.removesuffix("{extension}')") + "')"), F.col("s.extension"))
    number = F.col("p_partkey").cast("string")
    # Narrow rows become texts: they are spread before, whatever the number of files.
    rows = part.select("p_partkey", "p_size").repartition(CODE_PARTITIONS).select("p_partkey", "p_size", texts.alias("s"))
    return rows.select(F.expr(_CODE_REPO).alias("repo_id"), path.alias("path"), F.replace("s.text", F.lit("{k}"), number).alias("content"))


def code_sql(lang: str, values: str, columns: str, select: str) -> str:
    """SQL for what each file of ``code_files`` gives: rows of ``values`` as ``columns``, with the part's number put in."""
    path = _CODE_PATH.format(extension=SAMPLES[lang].extension)
    return f"SELECT {_CODE_REPO} AS repo_id, {path} AS path, {select} FROM part, (VALUES {values}) v({columns})"


def plain_sql(text: str) -> str:
    """The binding ``text`` with its tables named directly."""
    return text.format(**{name: name for name in TABLES})
