"""Patterns that keep records out of an index."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# File names of financial paperwork (letters and digits are word characters, underscores are not).
NAME_PATTERNS = (
    r"1099",
    r"(?<![a-z0-9])w-?2(?![a-z0-9])",
    r"(?<![a-z0-9])1040(?![a-z0-9])",
    r"(?<![a-z0-9])tax(es|-?return)?(?![a-z0-9])",
    r"statement", r"invoice", r"receipt", r"payroll", r"paystub",
    r"(?<![a-z0-9])k-?1(?![a-z0-9])",
)
# Phrases of financial paperwork, in order of precedence.
CONTENT_MARKERS = (
    "account verification", "routing number", "account number",
    "social security number", "taxable income", "year-end summary",
    "form 1099", "form w-2", "form 1040", "consolidated 1099",
    "designated bene plan", "brokerage account", "statement period",
)
NUMBER_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
NUMBER_NAME = "social-security-number pattern"
READ = 4000


def name_excluded(file_name: Column, patterns: Iterable[str] | None = None) -> Column:
    """Own patterns replace the built-in ones; an empty list excludes nothing."""
    hit = F.lit(False)
    for p in NAME_PATTERNS if patterns is None else patterns:
        hit = hit | file_name.rlike(f"(?i){p}")
    return F.coalesce(hit, F.lit(False))


def content_marker(title: Column, body: Column) -> Column:
    """The first marker found in title and the body's beginning; null if there is none."""
    head = F.substring(F.coalesce(body, F.lit("")), 1, READ)
    hay = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), head))
    found = [F.when(F.contains(hay, F.lit(m)), F.lit(m)) for m in CONTENT_MARKERS]
    return F.coalesce(*found, F.when(head.rlike(NUMBER_PATTERN), F.lit(NUMBER_NAME)))
