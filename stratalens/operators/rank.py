"""PageRank of files and its spread over definitions.

The weight of an edge depends on the name and the referring file, not on the defining file. Rank therefore
flows through names: each file gives its rank to the names it refers to, each name passes what it got to all
its definers. One round costs as many rows as there are (name, file) pairs, while an edge list would hold the
product of referrers and definers of every name.

The random jump and the rank of files that refer to nothing flow through one more name per repository, which
every file refers to and every file defines. A round is then a linear map from ranks to ranks: two joins and
two sums, with no other step, and rounds chain into one Spark job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..functions.positions import all_positions, top_positions
from ..session import cut_lineage
from .graph import REPO_FILE, REPO_NAME, centrality_of, edge_weight, linked_pairs

# The usual PageRank settings.
DAMPING = 0.85
TOLERANCE = 1e-6
MAX_ROUNDS = 100

# Rounds per Spark job.
ROUNDS_PER_JOB = 5

# Largest number of pair rows of one file, or of one name, that stay together in a partition.
CHUNK_ROWS = 1_000_000

# Pair rows of a partition of the kept tables.
PARTITION_ROWS = 5_000_000

# The name that every file of a repository refers to and defines. Other names carry the mark before them in the kept
# tables, so whatever a user's tags hold, also an empty name, is none of theirs.
EVERY_FILE, NAME_MARK = "*", "="

# Ranks equal up to this many decimals are the same rank computed in another order of additions.
TIE_DIGITS = 12


def _chunks(rows: str) -> Column:
    return F.ceil(F.col(rows) / F.lit(CHUNK_ROWS)).cast("int")


def _per_chunk(df: DataFrame, rows: str) -> DataFrame:
    """Repeat each row for every chunk of its key's pair rows; one for all but very large keys."""
    return df.withColumn("chunk", F.explode(F.sequence(F.lit(0), _chunks(rows) - 1)))


def _keep(df: DataFrame, keys: list[str], spread: str, rows: str, total: int) -> DataFrame:
    """Partition and sort a pair table of ``total`` rows by ``keys`` once and keep it for all rounds.

    Small tables have as many partitions as the session's shuffles, so the sums of each round arrive in place.
    """
    df = df.withColumn("chunk", F.pmod(F.xxhash64(spread), _chunks(rows)).cast("int"))
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*keys, "chunk"]
    return df.repartition(max(2, session, total // PARTITION_ROWS + 1), *keys).sortWithinPartitions(*keys).persist()


def _marked() -> Column:
    return F.concat(F.lit(NAME_MARK), "name").alias("name")


def graph_files(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """One row per file of the graph, from its two pair tables: degrees, outgoing weight, pair rows."""
    zero = F.lit(0).cast("bigint")
    outgoing = refs.select(
        "repo_id",
        F.col("path").alias("file"),
        F.col("name_definers").alias("out_degree"),
        zero.alias("in_degree"),
        (edge_weight() * F.col("name_definers")).alias("out_weight"),
        F.lit(1).alias("pairs"),
    )
    incoming = defs.select(
        "repo_id",
        F.col("path").alias("file"),
        zero.alias("out_degree"),
        F.col("name_referrers").alias("in_degree"),
        F.lit(0.0).alias("out_weight"),
        F.lit(0).alias("pairs"),
    )
    columns = ["out_degree", "in_degree", "out_weight", "pairs"]
    files = outgoing.unionByName(incoming).groupBy(*REPO_FILE).agg(*[F.sum(c).alias(c) for c in columns])
    counts = files.groupBy("repo_id").agg(F.count("*").alias("n"))
    return files.join(counts, "repo_id")


def _shares(refs: DataFrame, files: DataFrame, damping: float) -> DataFrame:
    """(repo_id, file, name, share): the part of a file's rank that goes to a name."""
    weights = files.select("repo_id", F.col("file").alias("path"), "out_weight", "pairs")
    to_names = refs.join(weights, ["repo_id", "path"]).select(
        "repo_id",
        F.col("path").alias("file"),
        _marked(),
        (F.lit(damping) * edge_weight() / F.col("out_weight")).alias("share"),
        F.col("name_definers").alias("definers"),
        (F.col("pairs") + 1).alias("pairs"),
    )
    to_every_file = files.select(
        *REPO_FILE,
        F.lit(EVERY_FILE).alias("name"),
        (F.when(F.col("pairs") > 0, F.lit(1 - damping)).otherwise(F.lit(1.0)) / F.col("n")).alias("share"),
        F.col("n").alias("definers"),
        (F.col("pairs") + 1).alias("pairs"),
    )
    return to_names.unionByName(to_every_file)


def _defined(defs: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, name, file): who receives what goes to a name."""
    sizes = files.select("repo_id", F.col("file").alias("path"), "n", (F.col("pairs") + 1).alias("pairs"))
    of_names = defs.join(sizes, ["repo_id", "path"]).select(
        "repo_id", _marked(), F.col("path").alias("file"), F.col("name_definers").alias("definers"), "n", "pairs"
    )
    of_every_file = files.select(
        "repo_id",
        F.lit(EVERY_FILE).alias("name"),
        "file",
        F.col("n").alias("definers"),
        "n",
        (F.col("pairs") + 1).alias("pairs"),
    )
    return of_names.unionByName(of_every_file)


def _one_round(vector: DataFrame, shares: DataFrame, defined: DataFrame, columns: list[str]) -> DataFrame:
    """Send every rank column through the names once."""
    held = shares.drop("pairs")
    got = (
        _per_chunk(vector.select(*REPO_FILE, "pairs", *columns), "pairs")
        .join(held, [*REPO_FILE, "chunk"])
        .groupBy(*REPO_NAME)
        .agg(*[F.sum(F.col(c) * F.col("share")).alias(c) for c in columns], F.max("definers").alias("definers"))
    )
    return (
        _per_chunk(got, "definers")
        .drop("definers")
        .join(defined.drop("definers"), [*REPO_NAME, "chunk"])
        .groupBy(*REPO_FILE)
        .agg(*[F.sum(c).alias(c) for c in columns], F.max("pairs").alias("pairs"), F.max("n").alias("n"))
    )


def _settle(vector: DataFrame, columns: list[str], tolerance: float) -> DataFrame:
    """Per repository, how many rounds ago it settled (null while it has not)."""
    changes = [F.sum(F.abs(F.col(a) - F.col(b))) for a, b in zip(columns, columns[1:])]
    totals = vector.groupBy("repo_id").agg(
        *[change.alias(f"_change{lag}") for lag, change in enumerate(changes)], F.max("n").alias("n")
    )
    below = lambda lag: F.col(f"_change{lag}") < F.col("n") * tolerance
    earliest = reduce(lambda case, lag: case.when(below(lag), lag), reversed(range(len(changes))), F)
    return totals.select("repo_id", earliest.alias("lag"))


def rank_files(
    pairs: DataFrame,
    damping: float = DAMPING,
    tolerance: float = TOLERANCE,
    max_rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """``repo_id, file, rank, centrality`` of every file in the graph. The result is materialised.

    A repository stops in the first round whose total change is below nodes * ``tolerance``; with a tolerance
    of 0 all run ``max_rounds``. Several rounds run as one job. So that each repository can still stop in its own
    round, the vector carries the ranks of the last rounds side by side (one application of the round moves
    them all on), and the right one is picked when the job is done. Settled repositories leave the vector.

    The pair tables are partitioned once. A file or name with very many pairs is split into chunks of bounded
    size there, and only the one-row-per-key side of each join is repeated per chunk, so no partition grows
    with the largest key. Every job's vector is checkpointed, so lineage stays short; ``pairs`` is read several
    times and should be a materialised table (``keep_pairs``).
    """
    refs, defs = linked_pairs(pairs)
    files = cut_lineage(graph_files(refs, defs))
    total = files.agg(F.sum("pairs") + F.count("*")).first()[0] or 0

    shares = _keep(_shares(refs, files, damping), REPO_FILE, "name", "pairs", total)
    defined = _keep(_defined(defs, files), REPO_NAME, "file", "definers", total)
    lags = ROUNDS_PER_JOB + 1 if tolerance > 0 else 1
    columns = [f"r{lag}" for lag in range(lags)]
    start = F.lit(1.0) / F.col("n")
    vector = files.select(*REPO_FILE, "n", (F.col("pairs") + 1).alias("pairs"), *[start.alias(c) for c in columns])
    settled = []
    done = 0
    try:
        while done < max_rounds:
            for _ in range(min(ROUNDS_PER_JOB, max_rounds - done)):
                known = columns[: done + 1]
                vector = _one_round(vector, shares, defined, known)
                # Before enough rounds have run, the older columns hold the start vector.
                vector = vector.select("*", *[start.alias(c) for c in columns[len(known) :]])
                done += 1
            vector = cut_lineage(vector)
            if tolerance > 0:
                stops = cut_lineage(_settle(vector, columns, tolerance))
                stopped = vector.join(stops.where(F.col("lag").isNotNull()), "repo_id")
                ranks = F.element_at(F.array(*columns), F.col("lag") + 1)
                settled.append(stopped.select(*REPO_FILE, ranks.alias("rank")))
                moving = stops.where(F.col("lag").isNull())
                vector = vector.join(moving, "repo_id", "left_semi")
                if moving.isEmpty():
                    break
        settled.append(vector.select(*REPO_FILE, F.col("r0").alias("rank")))
        ranks = reduce(DataFrame.unionByName, settled)
        return cut_lineage(ranks.join(centrality_of(files), REPO_FILE))
    finally:
        shares.unpersist()
        defined.unpersist()


def rank_order() -> list[Column]:
    """Highest rank first, equal ranks by name, last name first."""
    return [F.desc(F.round("rank", TIE_DIGITS)), F.desc("file")]


def ranked_files(ranks: DataFrame) -> DataFrame:
    """Published listing of all files with their position per repository."""
    return all_positions(ranks, ["repo_id"], rank_order(), "rank_position").select(
        "repo_id",
        F.col("rank_position").cast("int").alias("rank_position"),
        "file",
        F.round("rank", 6).alias("pagerank_score"),
        F.round("centrality", 6).alias("centrality"),
    )


def top_ranked_files(ranks: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of ``ranked_files`` per repository, without numbering the rest."""
    return top_positions(ranks, ["repo_id"], rank_order(), k, "rank_position").select(
        "repo_id",
        "rank_position",
        "file",
        F.round("rank", 6).alias("pagerank_score"),
        F.round("centrality", 6).alias("centrality"),
    )


def rank_bars(ranked: DataFrame) -> DataFrame:
    """Each file's score in percent of the first one's."""
    first = ranked.where(F.col("rank_position") == 1).select("repo_id", F.col("pagerank_score").alias("_first"))
    return ranked.join(first, "repo_id").select(
        "repo_id",
        "rank_position",
        "file",
        "pagerank_score",
        (ratio(F.col("pagerank_score"), F.col("_first")) * 100).alias("percent"),
    )


def node_listing(ranks: DataFrame) -> DataFrame:
    return ranks.select(
        "repo_id",
        F.col("file").alias("id"),
        F.round("rank", 6).alias("pagerank"),
        F.round("centrality", 6).alias("centrality"),
    )


def ranked_definitions(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """Rank each definition receives: ``repo_id, file, ident, rank``.

    A name passes on the same mass to each of its definers, so the spread is one join per pair table.
    """
    refs, defs = linked_pairs(pairs)
    refs = refs.withColumn("_u", edge_weight())
    given = refs.groupBy("repo_id", "path").agg(F.sum(F.col("_u") * F.col("name_definers")).alias("_out"))
    per_out = (
        ranks.select("repo_id", F.col("file").alias("path"), "rank")
        .join(given, ["repo_id", "path"])
        .select("repo_id", "path", (F.col("rank") / F.col("_out")).alias("_unit"))
    )
    mass = (
        refs.join(per_out, ["repo_id", "path"])
        .groupBy("repo_id", "name")
        .agg(F.sum(F.col("_unit") * F.col("_u")).alias("rank"))
    )
    return defs.join(mass, ["repo_id", "name"]).select(
        "repo_id", F.col("path").alias("file"), F.col("name").alias("ident"), "rank"
    )


def definition_order() -> list[Column]:
    return [F.desc(F.round("rank", TIE_DIGITS)), F.desc("file"), F.desc("ident")]


def ordered_definitions(definitions: DataFrame) -> DataFrame:
    """All ranked definitions with their position per repository."""
    return all_positions(definitions, ["repo_id"], definition_order(), "position")


RANKED_TAG, BARE_FILE = 1, 2


def ranked_tags(tags: DataFrame, pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """Tags of ranked definitions, then the ranked files that have none.

    Rows sort by ``section`` (1 tags, 2 bare files), then rank and names descending, then line. ``tags`` may come straight from
    texts, whose size Spark cannot guess, so they are never broadcast.
    """
    found = tags.where(F.col("kind") == "def").select(
        "repo_id", F.col("path").alias("file"), F.col("name").alias("ident"), "line"
    ).distinct()
    tagged = (
        ranked_definitions(pairs, ranks)
        .join(found.hint("merge"), ["repo_id", "file", "ident"])
        .select("repo_id", F.lit(RANKED_TAG).alias("section"), "file", "ident", "line", "rank")
    )
    bare = (
        ranks.join(tagged.select(*REPO_FILE).distinct(), REPO_FILE, "left_anti")
        .select(
            "repo_id",
            F.lit(BARE_FILE).alias("section"),
            "file",
            F.lit(None).cast("string").alias("ident"),
            F.lit(None).cast("int").alias("line"),
            "rank",
        )
    )
    return tagged.unionByName(bare)


def in_tag_order(tagged: DataFrame) -> DataFrame:
    return tagged.orderBy("repo_id", "section", *definition_order(), "line")


def file_rank_lookup(ranked: DataFrame, file: str, top: int = 3) -> DataFrame:
    """Rank and position of one file per repository, the number of ranked files, and the first ``top`` files."""
    totals = ranked.groupBy("repo_id").agg(F.count("*").alias("total_files"))
    first = (
        ranked.where(F.col("rank_position") <= top)
        .groupBy("repo_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank_position", "file"))).alias("_first"))
        .select("repo_id", F.transform("_first", lambda row: row["file"]).alias("top_files"))
    )
    return (
        ranked.where(F.col("file") == file)
        .join(totals, "repo_id")
        .join(first, "repo_id")
        .select("repo_id", "file", "pagerank_score", "rank_position", "total_files", "top_files")
    )
