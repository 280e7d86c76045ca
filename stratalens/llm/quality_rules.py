"""Quality rules per document, and verdicts on whole hosts from the share of their documents that fail.

A document fails a rule by its own counts. Failures are summed per host (here the ``source`` column) and each host's
failure rate is shrunk towards the rate of all hosts with a beta prior fitted to the hosts themselves, so a host of few
documents is not judged on chance. A host whose shrunk rate is over a limit is bad: there one failed rule of any kind
rejects a document, elsewhere only the base rules do. Clean documents stay whatever their host.

Defined results: a null text counts as empty (no words, so it fails the base rules); a null host is a host of its own;
repeated rows are judged each; an empty table gives an empty table; other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, whole_row

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)  # odd multipliers


@dataclass(frozen=True)
class Rules:
    """Limits. The first two are the base rules; the others are soft and count for host rates and in bad hosts."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 3
    max_mean_word_chars: int = 25
    max_host_rate: float = 0.5
    max_prior_rows: float = 1e6


def _repeated_words(words: list[bytes]) -> int:
    """Words that lie in some 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    ids = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    keys = (ids[:-2] * _MIX[0] + ids[1:-1]) * _MIX[1] + ids[2:]  # 64 bits: words of one text do not collide
    order = np.sort(keys)
    repeated = order[1:][order[1:] == order[:-1]]
    if not len(repeated):
        return 0
    place = np.searchsorted(repeated, keys)
    place[place == len(repeated)] = 0
    twice = repeated[place] == keys
    covered = np.zeros(len(words), dtype=bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def count_text(text: bytes | None) -> tuple[int, int, int, int, int]:
    """The five counts of one text, in the order of ``COUNTS``."""
    text = text or b""
    words = text.split()  # of bytes: exactly blank, \t, \n, \v, \f and \r part words
    packed = text.translate(None, _SPACES)
    seen: set[bytes] = set()
    repeated_lines = 0
    for line in text.split(b"\n"):
        if line in seen:
            repeated_lines += 1
        elif line.strip():
            seen.add(line)
    return (
        len(words),
        len(packed) if packed.isascii() else len(packed.decode("utf-8", "replace")),
        len(text) - len(text.translate(None, _SYMBOLS)),
        repeated_lines,
        _repeated_words(words),
    )


def text_counts(text: Column) -> Column:
    """A struct of the counts of each text."""

    def count(texts: pa.Array) -> pa.Array:
        rows = [count_text(t.as_buffer().to_pybytes() if t.is_valid else None) for t in texts.cast(pa.large_binary())]
        columns = list(zip(*rows)) if rows else [[] for _ in COUNTS]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], COUNTS)

    count.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(count, ", ".join(f"{c} long" for c in COUNTS))(text)


def base_failed(c: dict[str, Column], rules: Rules) -> Column:
    return (c["n_words"] < rules.min_words) | (100 * c["n_repeat_words"] > rules.max_repeat_percent * c["n_words"])


def any_failed(c: dict[str, Column], rules: Rules) -> Column:
    """Whether any rule, base or soft, fails."""
    return (
        base_failed(c, rules)
        | (100 * c["n_symbols"] > rules.max_symbol_percent * c["word_chars"])
        | (100 * c["n_dup_lines"] > rules.max_dup_line_percent * c["n_words"])
        | (c["word_chars"] > rules.max_mean_word_chars * c["n_words"])
    )


def host_verdicts(judged: DataFrame, host: str, failed: str, rules: Rules = Rules()) -> DataFrame:
    """One row per host: host, n_docs, n_failed, host_rate (shrunk), bad_host.

    The prior is Beta(m s, (1 - m) s): m is the failure rate of all rows, s follows from how far the hosts' rates spread
    beyond what chance alone gives (method of moments). Only one row of sums reaches the driver.
    """
    # Stored, so that texts are counted once for it and its size is known when it is joined to them.
    hosts = store(
        judged.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    )
    total = hosts.agg(
        F.sum("n_docs").alias("n"),
        F.sum("n_failed").alias("k"),
        F.count("*").alias("hosts"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("squares"),
    ).first()
    a, b = prior(total["n"] or 0, total["k"] or 0, total["hosts"], total["squares"] or 0.0, rules)
    rate = F.round((F.col("n_failed") + a) / (F.col("n_docs") + (a + b)), 6)
    return hosts.withColumn("host_rate", rate).withColumn("bad_host", F.col("host_rate") > rules.max_host_rate)


def prior(n: int, k: int, hosts: int, squares: float, rules: Rules) -> tuple[float, float]:
    """Parameters of the beta prior from sums over hosts; ``squares`` is the sum of failures squared over rows."""
    if n == 0:
        return 0.5, 0.5
    mean = k / n
    spread = squares / n - mean * mean
    chance = mean * (1 - mean) * hosts / n
    between = spread - chance
    strength = mean * (1 - mean) / between - 1 if between > 0 else rules.max_prior_rows
    strength = min(max(strength, 1.0), rules.max_prior_rows)
    return mean * strength, (1 - mean) * strength


def judge(
    docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules(), result: str = "_quality"
) -> DataFrame:
    """All columns of ``docs`` plus ``result``, a name that none of them has: a struct of the counts, base_failed, host_rate, bad_host and kept.

    Two passes over the texts, none of which is shuffled: the first keeps only a row per host, the second judges
    each row against its host's verdict.
    """
    counted = docs.select(whole_row(docs).alias("_row"), F.col(host).alias("_at"), text_counts(F.col(text)).alias("_c"))
    c = {name: F.col(f"_c.{name}") for name in COUNTS}
    verdicts = host_verdicts(
        counted.select(F.col("_at").alias("_host"), any_failed(c, rules).alias("_failed")), "_host", "_failed", rules
    )
    joined = counted.join(verdicts, F.col("_at").eqNullSafe(F.col("_host")), "left")
    base = base_failed(c, rules)
    kept = ~base & ~(F.col("bad_host") & any_failed(c, rules))
    quality = F.struct(
        *(c[name].alias(name) for name in COUNTS),
        base.alias("base_failed"),
        F.col("host_rate"),
        F.col("bad_host"),
        kept.alias("kept"),
    )
    return joined.select("_row.*", quality.alias(result))
