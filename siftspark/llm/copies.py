"""Duplicates hidden by formatting: one record per canonical key, counted exactly, whatever the skew.

Exact partial counts find the hot keys, those with more than HOT_ROWS rows, so that at most one row in HOT_ROWS is a
hot key. Hot keys are aggregated on (key, salt) and then on key; all others in one shuffle. The representative is
the copy with the smallest identifier.

Defined cases: null and empty titles are one title, and so is a title without letters or digits; a null url
equals only a null url; an empty table gives no rows; other columns are ignored, whatever their names. Rows
with a null identifier count as copies but are no representative unless the group has no other row.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from siftspark.functions.urls import normalize_url
from siftspark.llm.buckets import sized
from siftspark.session import checkpoint

# Signs that set off title parts when there is space on both sides.
SEPARATORS = "|‖¦-‐‑‒–—―−·•∙‣»«›‹:/\\><~"
_SPLIT = re.compile(rf"\s[{re.escape(SEPARATORS)}]+(?=\s)")
_NOISE = re.compile(r"[\W_]+")
HOT_ROWS = 20_000
SALTS = 64


def title_key(title: str | None) -> str:
    """Letters and digits of the title's parts, parts in sorted order."""
    if not title:
        return ""
    text = unicodedata.normalize("NFC", title)
    parts = (_NOISE.sub("", p.casefold()) for p in _SPLIT.split(text))
    return "".join(sorted(parts))


@F.pandas_udf(StringType())
def title_keys(titles: pd.Series) -> pd.Series:
    """No built-in knows Unicode's composed form; each spelling of a batch is done once."""
    known = {t: title_key(t) for t in titles.unique()}
    return titles.map(known, na_action=None).fillna("")


def keyed(bookmarks: DataFrame) -> DataFrame:
    """bookmark_id and a 128-bit hash of the canonical url and title."""
    rows = bookmarks.select(F.col("bookmark_id").cast("long").alias("bookmark_id"), normalize_url(F.col("url").cast("string")).alias("u"), title_keys(F.col("title").cast("string")).alias("t"))
    null = F.col("u").isNull()
    return rows.select("bookmark_id", F.xxhash64("u", "t", null).alias("k1"), F.xxhash64(null, "t", F.lit(7), "u").alias("k2"))


def _split(rows: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows of hot keys, all other rows)."""
    counts = rows.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    hot = sized(checkpoint(counts.where(F.col("n") > hot_rows).select("k1", "k2")))
    return rows.join(hot, ["k1", "k2"]), rows.join(hot, ["k1", "k2"], "left_anti")


def _hot_records(hot_rows: DataFrame, salts: int) -> DataFrame:
    first = hot_rows.groupBy("k1", "k2", F.pmod(F.xxhash64("bookmark_id"), F.lit(salts)).alias("salt")).agg(F.min("bookmark_id").alias("keep_id"), F.count("*").alias("copies"))
    return first.groupBy("k1", "k2").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))


def records(bookmarks: DataFrame, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """keep_id, copies: one row per record."""
    rows = checkpoint(keyed(bookmarks))
    heavy, light = _split(rows, hot_rows)
    small = light.groupBy("k1", "k2").agg(F.min("bookmark_id").alias("keep_id"), F.count("*").alias("copies"))
    return small.unionByName(_hot_records(heavy, salts)).select("keep_id", "copies")


def copies(bookmarks: DataFrame, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """keep_id, bookmark_id: every copy but the representative of its record."""
    rows = checkpoint(keyed(bookmarks))
    heavy, light = _split(rows, hot_rows)
    small = light.withColumn("keep_id", F.min("bookmark_id").over(Window.partitionBy("k1", "k2")))
    kept = sized(checkpoint(_hot_records(heavy, salts).select("k1", "k2", "keep_id")))
    big = heavy.join(kept, ["k1", "k2"])
    return small.select("keep_id", "bookmark_id").unionByName(big.select("keep_id", "bookmark_id")).where("bookmark_id <> keep_id").distinct()
