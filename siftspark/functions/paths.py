"""Path expressions and path patterns."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """With its dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(name(path), r"(?<=.)(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]+$", "")


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def matches_any(path: Column, patterns: Iterable[str]) -> Column:
    """Globs, in which a star also crosses slashes; a pattern without wildcards covers its whole subtree."""
    hit = F.lit(False)
    for p in patterns:
        p = os.path.expanduser(p)
        regex = fnmatch.translate(p).replace(r"\z", "").replace(r"\Z", "")
        hit = hit | path.rlike(f"^(?:{regex})$")
        if not any(c in p for c in "*?["):
            hit = hit | path.startswith(p.rstrip("/") + "/")
    return F.coalesce(hit, F.lit(False))


def override_for(path: Column, overrides: dict[str, object]) -> Column:
    """Name of the first override that is a component of the path, whatever its case; null if none is."""
    own = F.transform(parts(path), lambda p: F.lower(p))
    out = F.lit(None).cast("string")
    for n in reversed(list(overrides)):
        out = F.when(F.array_contains(own, n.lower()), n).otherwise(out)
    return out
