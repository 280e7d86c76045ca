"""URL filter: rules on hosts and paths, and for other pages naive Bayes over segmented host and path tokens.

Host names are concatenated words. A unigram Viterbi splits each distinct name part into the words that are most likely
under the word counts of the pages themselves; multinomial naive Bayes, trained on the pages that a rule decides, then
scores host words and path tokens of the rest.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; a null html adds no words;
with no labelled page every score is 0 and the verdict is allow, as for any tie; repeated rows are judged each; an empty
table gives an empty table.

No table is broadcast by size: the substrings of distinct host parts meet the word counts in a join, and the
naive Bayes model has ``BUCKETS`` rows whatever the number of tokens (feature hashing).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

# Fixed values: (rule, verdict). A rule is a host, then the start of a path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

BUCKETS = 1 << 16
SMOOTHING = 1.0
LONGEST_WORD = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty for null or an address without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: len(r[0])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """word, count over the text of all pages: words of a-z of at most ``LONGEST_WORD`` letters."""
    text = F.lower(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"<[^>]*>", " "))
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}+"), 0)).alias("word"))
    return words.where(F.col("word").rlike(f"^[a-z]{{1,{LONGEST_WORD}}}$")).groupBy("word").agg(F.count("*").alias("count"))


def best_split(part: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """Most likely split of ``part``; known: count of the word at (start, length). First of equals: longest last word.

    An unknown word of n letters has probability 10 / (total 10^n), so it is worse the longer it is.
    """
    best = [0.0] + [-np.inf] * len(part)
    length = [0] * (len(part) + 1)
    for end in range(1, len(part) + 1):
        for n in range(min(end, LONGEST_WORD), 0, -1):
            count = known.get((end - n, n))
            cost = np.log10(count / total) if count else np.log10(10.0 / total) - n
            if best[end - n] + cost > best[end]:
                best[end], length[end] = best[end - n] + cost, n
    words, end = [], len(part)
    while end:
        words.append(part[end - length[end] : end])
        end -= length[end]
    return words[::-1]


def split_parts(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """part, words for each distinct ``part``. Only counts of substrings of the part reach its row."""
    total = max(counts.agg(F.sum("count")).first()[0] or 0, 1)
    size = F.length("part")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(1), size),
            lambda s: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), size - s + 1)),
                lambda n: F.struct(s.alias("start"), n.alias("n")),
            ),
        )
    )
    pieces = parts.select("part", F.explode(spans).alias("span")).select(
        "part", "span", F.substring(F.col("part"), F.col("span.start"), F.col("span.n")).alias("word")
    )
    found = (
        pieces.join(counts, "word", "left")
        .groupBy("part")
        .agg(F.collect_list(F.when(F.col("count").isNotNull(), F.struct("span.start", "span.n", "count"))).alias("known"))
    )

    def split(names: pa.Array, known: pa.Array) -> pa.Array:
        out = []
        for name, items in zip(names.to_pylist(), known.to_pylist()):
            out.append(best_split(name, {(k["start"] - 1, k["n"]): k["count"] for k in items or ()}, total))
        return pa.array(out, pa.list_(pa.string()))

    split.__annotations__ = {"names": pa.Array, "known": pa.Array, "return": pa.Array}
    return found.select("part", F.arrow_udf(split, "array<string>")("part", "known").alias("words"))


def segment_hosts(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host, words: the words of each distinct ``host``, in order; what is not a-z parts words."""
    parted = hosts.select("host", F.posexplode(F.split("host", "[^a-z]+")).alias("at", "part")).where("part <> ''")
    words = split_parts(parted.select("part").distinct(), counts)
    return (
        parted.join(words, "part")
        .groupBy("host")
        .agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("pieces"))
        .select("host", F.flatten("pieces.words").alias("words"))
    )


def path_tokens(path: Column) -> Column:
    """Lower-case words of the path; a number counts as the token #."""
    tokens = F.regexp_extract_all(F.lower(path), F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.transform(tokens, lambda t: F.when(t.rlike(r"^\p{N}+$"), "#").otherwise(t))


def features(words: Column, path: Column, buckets: int = BUCKETS) -> Column:
    tokens = F.concat(
        F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)),
        F.transform(path_tokens(path), lambda w: F.concat(F.lit("p:"), w)),
    )
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))


def train(labelled: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log odds of block against allow: one per bucket, and last that of the classes.

    ``labelled`` has features and verdict. At most ``buckets`` summed rows reach the driver.
    """
    block = F.col("verdict") == "block"
    classes = labelled.agg(F.sum(block.cast("long")).alias("b"), F.sum((~block).cast("long")).alias("a")).first()
    sums = (
        labelled.select("verdict", F.explode("features").alias("bucket"))
        .groupBy("bucket")
        .agg(F.sum(block.cast("long")).alias("b"), F.sum((~block).cast("long")).alias("a"))
        .collect()
    )
    counts = np.zeros((2, buckets))
    for row in sums:
        counts[:, row["bucket"]] = row["b"], row["a"]
    logs = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTHING * buckets)
    prior = np.log(((classes["b"] or 0) + 1) / ((classes["a"] or 0) + 1))
    return np.append(logs[0] - logs[1], prior)


def log_odds(features_: Column, model: np.ndarray) -> Column:
    def score(lists: pa.Array) -> pa.Array:
        values = model[lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)]
        sums = np.concatenate([[0.0], np.cumsum(values)])
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        return pa.array(sums[ends[1:]] - sums[ends[:-1]] + model[-1])

    score.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "double")(features_)


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, host_words, log_odds (positive: block), one row per page."""
    host, path = split_url(F.col(url))
    rule, verdict = matching_rule(F.col("host"), F.col("path"))
    split = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    ruled = split.withColumn("rule", rule).withColumn("verdict", verdict)
    words = store(segment_hosts(split.select("host").distinct(), store(word_counts(pages, html))))
    # ruled once for training and once for scoring: a scan of the url column, cheaper than storing it
    featured = ruled.join(words, "host", "left").withColumn("features", features(F.col("words"), F.col("path")))
    model = train(featured.where(F.col("verdict").isNotNull()))
    scored = featured.withColumn("log_odds", F.round(log_odds(F.col("features"), model), 6))
    method = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return scored.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("verdict", method).alias("verdict"),
        F.array_join("words", " ").alias("host_words"),
        "log_odds",
    )
