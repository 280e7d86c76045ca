"""Column expressions on repository addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the address form that is accepted.
REPO_URL_PATTERN = r"(?U)^https://github\.com/[\w.\-]+/[\w.\-]+$"


def strip_blank(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_url(url: Column) -> Column:
    """Trim, then drop all trailing slashes."""
    return F.regexp_replace(strip_blank(url), "/+$", "")


def is_repo_url(cleaned: Column) -> Column:
    return F.rlike(cleaned, F.lit(REPO_URL_PATTERN))


def repo_name(cleaned: Column) -> Column:
    return F.element_at(F.split(cleaned, "/"), -1)


def repo_owner(cleaned: Column) -> Column:
    return F.try_element_at(F.split(cleaned, "/"), F.lit(-2))


def cache_key(url: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the cleaned, lower-cased address."""
    return F.substring(F.sha2(F.lower(clean_url(url)).cast("binary"), 256), 1, 16)
