"""Zero-shot tags, their ranks, and what is decided by them.

Defined cases: ties in score go to the earlier label; rows with a null id or score have no rank; tags without a
rank never match; several facets must all match; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftspark.functions import paths
from siftspark.functions import vectors as V

# The labels in order, rank limits and the labels that make a processor worth running.
LABELS = ("meme", "chart", "screenshot", "document", "photo", "art", "nsfw")
FACET_RANK, HIDDEN_RANK = 2, 1
GATES = {"ocr": (("meme", "chart", "screenshot", "document"), 2), "caption": (("meme", "chart", "screenshot", "document", "photo", "art"), 6)}
SOURCE = "clip-zs"


def zero_shot(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """id, tag, score, rank from rows (id, embedding) and at most a few labels (pos, tag, embedding)."""
    e = labels.select("pos", "tag", F.col("embedding").alias("label_vector"))
    rows = vectors.join(F.broadcast(e), how="cross").select("id", "pos", "tag", V.dot(F.col("embedding"), F.col("label_vector")).alias("score"))
    return ranked(rows)


def ranked(scores: DataFrame) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc("score"), "pos")
    return scores.where("id is not null and score is not null").withColumn("rank", F.row_number().over(w)).drop("pos")


def with_all(tags: DataFrame, wanted: Iterable[str], rank: int = FACET_RANK) -> DataFrame:
    """id of what carries every wanted tag within the rank."""
    wanted = sorted(set(wanted))
    rows = tags.where((F.col("rank") <= rank) & F.col("tag").isin(wanted))
    return rows.groupBy("id").agg(F.countDistinct("tag").alias("n")).where(F.col("n") == len(wanted)).select("id")


def allowed(tags: DataFrame, items: DataFrame, folder: str, explicit: Iterable[str], parsed: Iterable[str]) -> DataFrame:
    """id admitted by facets: parsed facets alone also admit all items of the folder."""
    explicit = set(explicit)
    out = with_all(tags, explicit | set(parsed))
    if not explicit:
        out = out.union(items.where(F.col("folder") == folder).select("id")).distinct()
    return out


def hidden(images: DataFrame, tags: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """id hidden from guests: private paths and what the hidden label ranks first for."""
    private = images.where(paths.matches_any(F.col("path"), patterns)).select("id")
    return private.union(tags.where((F.col("tag") == "nsfw") & (F.col("rank") <= HIDDEN_RANK)).select("id")).distinct()


def wants(kind: str, ranked_tags: Column, auto: bool = True, gates: dict | None = None) -> Column:
    """Whether a processor runs, given array<struct<tag, score, rank>>."""
    gate = (gates or GATES).get(kind)
    if not auto or gate is None:
        return F.lit(True)
    labels, rank = gate
    none = ranked_tags.isNull() | (F.size(ranked_tags) == 0)
    return none | F.exists(ranked_tags, lambda t: t["tag"].isin(list(labels)) & (t["rank"] <= rank))


def untagged(vectors: DataFrame, images: DataFrame, tags: DataFrame) -> DataFrame:
    """Vectors of known images that have no tag yet."""
    return vectors.join(images.select("id"), "id", "left_semi").join(tags.select("id").where("id is not null").distinct(), "id", "left_anti")


def top_label(tags: DataFrame, images: DataFrame, label: str = "nsfw", n: int = 30) -> DataFrame:
    """path, score of the n highest scores of a label."""
    return tags.where(F.col("tag") == label).join(images.select("id", "path"), "id").select("path", "score").orderBy(F.desc("score"), F.desc("path")).limit(n)


def facet_counts(tags: DataFrame, rank: int = FACET_RANK) -> DataFrame:
    """tag, n: how many ids each facet admits."""
    return tags.where(F.col("rank") <= rank).groupBy("tag").agg(F.countDistinct("id").alias("n"))
