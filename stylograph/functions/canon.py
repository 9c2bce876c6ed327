"""Canonical forms of text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letters_and_digits(text: Column) -> Column:
    """Letters and digits of `text` in order, case folded (sharp s equals ss, and both forms of sigma are one)."""
    low = F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    return F.regexp_replace(low, r"[^\p{L}\p{Nd}]+", "")


def word_runs(text: Column) -> Column:
    """Longest runs of letters and digits, lower case, in order; empty for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+")
    return F.filter(parts, lambda x: x != "")


def digest(*cols: Column) -> Column:
    """16 bytes of SHA-256 over the columns, which must not be null: equal digests are taken as equal content."""
    return F.substring(F.unhex(F.sha2(F.concat_ws("\x1f", *cols), 256)), 1, 16)
