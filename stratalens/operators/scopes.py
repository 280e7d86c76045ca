"""Where definitions stand: the definitions and heads that enclose each of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PLACE = ["repo_id", "path", "line"]


def tag_scopes(definitions: DataFrame) -> DataFrame:
    """(repo_id, path, line, name, depth, heads, qualified_name) of each definition of ``tag_files(..., with_scopes=True)``.

    ``heads`` are the lines of the blocks that enclose it, outermost first, ``depth`` their number. ``qualified_name`` leads with
    the names defined on those lines; a block without a definition, such as a loop, adds none. Definitions are dealt out by their
    file once. All that follows happens in place, by sorted rows: each stands on its own line and on those of its heads, where it
    meets the names defined there.
    """
    # Heads differ by their texts too, of which a number is enough.
    found = (
        definitions.where(F.col("kind") == "def")
        .select(*_PLACE, "name", F.col("scopes.line").alias("_heads"), F.xxhash64("scopes").alias("_texts"))
        .repartition("repo_id", "path")
        .distinct()
    )
    lines = F.concat(F.array("line"), F.coalesce("_heads", F.array().cast("array<int>")))
    rows = found.select("repo_id", "path", F.col("line").alias("_line"), "name", F.posexplode(lines).alias("_at", "line"))
    known = reduce(Column.__and__, (F.col(c).isNotNull() for c in _PLACE))
    # Of several definitions on one line the first by name stands for it.
    enclosing = F.min(F.when((F.col("_at") == 0) & known, F.col("name"))).over(Window.partitionBy(*_PLACE))
    chains = (
        rows.withColumn("_enclosing", enclosing)
        .groupBy("repo_id", "path", F.col("_line").alias("line"), "name")
        .agg(F.array_sort(F.collect_list(F.when(F.col("_at") > 0, F.struct("_at", "line", "_enclosing")))).alias("_chain"))
    )
    return chains.select(
        *_PLACE,
        "name",
        F.size("_chain").alias("depth"),
        F.col("_chain.line").alias("heads"),
        F.concat_ws(".", F.col("_chain._enclosing"), "name").alias("qualified_name"),
    )
