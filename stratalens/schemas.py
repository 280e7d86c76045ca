"""Table schemas. Every table of repository data leads with ``repo_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_TYPES = {
    "string": StringType(),
    "int": IntegerType(),
    "bigint": LongType(),
    "double": DoubleType(),
    "timestamp_ntz": TimestampNTZType(),
}


def _table(columns: str) -> StructType:
    pairs = [column.split() for column in columns.split(",")]
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


SOURCE_FILES = _table("repo_id string, path string, content string")

TAGS = _table("repo_id string, path string, line int, name string, kind string")

EDGES = _table("repo_id string, source string, target string, ident string, weight double")

COMMIT_FILES = _table(
    "repo_id string, commit_hash string, author_email string, commit_ts timestamp_ntz,"
    " path string, added int, removed int"
)

RULES = _table("lang string, kind string, category string, pattern string")

EXTENSIONS = _table("ext string, lang string")

ANALYSES = _table(
    "id bigint, repo_url string, repo_name string, timestamp timestamp_ntz, ip_address string,"
    " user_agent string, file_count int, ranked_files_count int, churn_files_count int,"
    " hotspot_count int, top_ranked_file string, top_churned_file string, top_hotspot_file string,"
    " graph_nodes int, graph_edges int, ast_symbol_count int, churn_total_contributors int,"
    " duration_seconds double"
)

LEADS = _table(
    "id bigint, email string, linkedin string, repo_url string, repo_name string,"
    " timestamp timestamp_ntz, ip_address string, user_agent string"
)

# Columns of ANALYSES that read as 0 where a record does not hold them.
ANALYSES_COUNTERS = [
    "file_count",
    "ranked_files_count",
    "churn_files_count",
    "hotspot_count",
    "graph_nodes",
    "graph_edges",
    "ast_symbol_count",
    "churn_total_contributors",
    "duration_seconds",
]

RESULTS = _table(
    "cache_key string, computed_at timestamp_ntz, section string, position bigint, doc string"
)

# The published table of popular repositories; ``batch`` is the one that changed the row last.
POPULARITY = _table(
    "repo_url string, repo_name string, analysis_count bigint, last_analyzed timestamp_ntz, batch bigint"
)

# Runs of the result store that are written in full, and the runs each takes the place of.
RUNS = _table("run string, computed_at timestamp_ntz, replaced string")


def conform(df: DataFrame, schema: StructType, zero: list[str] | None = None) -> DataFrame:
    """Give ``df`` exactly the columns of ``schema``.

    Missing columns are added as nulls, so records written before a column existed still load; the
    columns named in ``zero`` then read as 0.
    """
    zero = zero or []
    present = set(df.columns)

    def column(field):
        value = F.col(field.name) if field.name in present else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in zero:
            value = F.coalesce(value, F.lit(0).cast(field.dataType))
        return value.alias(field.name)

    return df.select(*[column(field) for field in schema.fields])


def conform_analyses(df: DataFrame) -> DataFrame:
    return conform(df, ANALYSES, ANALYSES_COUNTERS)


def conform_leads(df: DataFrame) -> DataFrame:
    return conform(df, LEADS)
