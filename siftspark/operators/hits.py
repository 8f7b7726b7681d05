"""Lists of hits: filters, union, fusion and resolution to records.

A hit list is (id, score). Defined cases: a hit that is neither an image nor a shown item of the folder is
dropped; an image wins over an item; ties are ordered by id; empty lists are allowed on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftspark.functions.text import snippet

RRF = 60


def without(hits: DataFrame, exclude: DataFrame) -> DataFrame:
    return hits.join(exclude.select("id"), "id", "left_anti")


def only(hits: DataFrame, allowed: DataFrame) -> DataFrame:
    return hits.join(allowed.select("id"), "id", "left_semi")


def shown(status: Column) -> Column:
    return status.isNull() | (status == "ok")


def concatenated(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """id, score, source, part: all vector hits, then keyword hits of other ids (an id may come up twice there)."""
    v = vector.select("id", "score", F.lit("vector").alias("source"), F.lit(0).alias("part"))
    k = keyword.select("id", "score", F.lit("fts").alias("source"), F.lit(1).alias("part"))
    return v.unionByName(k.join(v.select("id").distinct(), "id", "left_anti"))


def resolved(hits: DataFrame, images: DataFrame, items: DataFrame, folder: str | None = None) -> DataFrame:
    """Adds path, kind, title, url, snippet; items may hold several rows of an id, of which the latest is taken."""
    own = (lambda d: d) if folder is None else (lambda d: d.where(F.col("folder") == folder))
    img = own(images).select("id", F.col("path").alias("img_path"))
    rows = own(items).where(shown(F.col("status")))
    last = rows.groupBy("id").agg(F.max_by(F.struct("kind", "src_path", "title", "url", snippet(F.col("body")).alias("snippet")), F.struct(F.coalesce("created_at", F.lit(0.0)), F.coalesce("title", F.lit("")))).alias("item"))
    out = hits.join(img, "id", "left").join(last, "id", "left").where("img_path is not null or item is not null")
    is_image = F.col("img_path").isNotNull()
    item = lambda c: F.when(~is_image, F.col(f"item.{c}"))
    return out.select(
        *hits.columns,
        F.coalesce("img_path", F.col("item.src_path")).alias("path"),
        F.when(is_image, "image").otherwise(F.col("item.kind")).alias("kind"),
        item("title").alias("title"),
        item("url").alias("url"),
        item("snippet").alias("snippet"),
    )


def cut(hits: DataFrame, k: int) -> DataFrame:
    return hits.orderBy("part", F.desc("score"), "id").limit(k)


def rrf(vector: DataFrame, keyword: DataFrame, k: int, c: int = RRF) -> DataFrame:
    """id, score, source: reciprocal rank fusion of two top-k lists, the best row of an id counting in each."""

    def placed(hits: DataFrame, source: str) -> DataFrame:
        best = hits.groupBy("id").agg(F.max("score").alias("score"))
        # a list is a top-k, so its ranking window is as small as k
        return best.select("id", (1.0 / (c + F.row_number().over(Window.orderBy(F.desc("score"), "id")))).alias("part"), F.lit(source).alias("source"))

    both = placed(vector, "vector").unionByName(placed(keyword, "fts"))
    out = both.groupBy("id").agg(F.sum("part").alias("score"), F.when(F.count("*") > 1, "both").otherwise(F.min("source")).alias("source"))
    return out.orderBy(F.desc("score"), "id").limit(k)


def rrf_lists(hits: DataFrame, group: str, c: int = RRF) -> DataFrame:
    """group, id, score, sources: fusion of any number of long lists (group, source, id, score) by places alone.

    Lists of different spaces are never compared by score. Null and NaN scores have no place."""
    ok = hits.where(F.col("score").isNotNull() & ~F.isnan("score"))
    best = ok.groupBy(group, "source", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy(group, "source").orderBy(F.desc("score"), "id")
    placed = best.select(group, "id", "source", (1.0 / (c + F.row_number().over(w))).alias("part"))
    return placed.groupBy(group, "id").agg(F.sum("part").alias("score"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))


def near_enough(hits: DataFrame, distance: float) -> DataFrame:
    """Hits above the relevance cliff."""
    return hits.where(-F.col("score") <= distance)


def as_json(hits: DataFrame) -> DataFrame:
    return hits.select(F.to_json(F.struct("*")).alias("hit"))
