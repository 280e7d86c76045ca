import pytest
from pyspark.sql import functions as F

from stratalens.functions.positions import all_positions, top_positions


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_positions_of_a_group_spread_over_partitions(spark, adaptive):
    """One group holds most rows and its range partitions do not coalesce."""
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        table = spark.range(20_000).select(
            F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
            F.hash("id").alias("v"),
            "id",
        )
        order = [F.desc("v"), F.asc("id")]
        got = {(r.g, r.id): r.p for r in all_positions(table, ["g"], order, "p").collect()}
        want, groups = {}, {}
        for row in table.collect():
            groups.setdefault(row.g, []).append((-row.v, row.id))
        for g, members in groups.items():
            want |= {(g, i): n + 1 for n, (_, i) in enumerate(sorted(members))}
        assert got == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_top_positions_are_cut_before_the_shuffle(spark):
    table = spark.range(1000).select(F.when(F.col("id") >= 0, "hot").otherwise("cold").alias("g"), "id")
    top = top_positions(table, ["g"], [F.desc("id")], 3, "p")
    assert [(r.id, r.p) for r in top.orderBy("p").collect()] == [(999, 1), (998, 2), (997, 3)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
