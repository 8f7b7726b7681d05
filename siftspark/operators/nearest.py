"""Exact nearest neighbours inside one (space, model) partition, and reverse lookup.

Rows are (space, model, rowid, id, embedding). The partition filter reaches the scan; the query vector is a
literal, so a search is one scan with a top-k and no shuffle of vectors.

Defined cases: unusable vectors (null, wrong length, null or NaN numbers, all zero) are left out; an unknown
partition or id gives no rows; equal distances are ordered by id; an id with several vectors may come up with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions import vectors as V


def partition(vectors: DataFrame, space: str, model: str) -> DataFrame:
    return vectors.where((F.col("space") == space) & (F.col("model") == model))


def get_vector(vectors: DataFrame, space: str, model: str, id: str) -> list[float] | None:
    """The vector with the smallest rowid of that id."""
    row = partition(vectors, space, model).where(F.col("id") == id).where("embedding is not null").orderBy("rowid").select("embedding").first()
    return list(row[0]) if row else None


def nearest(vectors: DataFrame, space: str, model: str, query: list[float], k: int | None = 20, metric: str = "l2") -> DataFrame:
    """id, rowid, score; score is minus the distance, or the cosine."""
    q = F.lit([float(x) for x in query])
    e = F.col("embedding")
    score = F.lit(0.0) - V.l2(e, q) if metric == "l2" else V.cosine(e, q)
    rows = partition(vectors, space, model).where(V.usable(e, len(query))).select("id", "rowid", score.alias("score"))
    return rows if k is None else rows.orderBy(F.desc("score"), "id", "rowid").limit(k)


def similar(vectors: DataFrame, images: DataFrame, folder: str, model: str, image_id: str, k: int = 20, exclude: DataFrame | None = None, metric: str = "l2") -> DataFrame:
    """image_id, path, score: other images of the folder, most similar first.

    Over-fetches before the folder filter, so fewer than k may come out.
    """
    q = get_vector(vectors, "image", model, image_id)
    if q is None:
        raise ValueError(f"no {model!r} vector is stored for {image_id!r}")
    hits = nearest(vectors, "image", model, q, (5 * k if exclude is not None else k) + 1, metric).where(F.col("id") != image_id)
    if exclude is not None:
        hits = hits.join(exclude.select("id"), "id", "left_anti")
    rows = hits.join(images.where(F.col("folder") == folder).select("id", "path"), "id")
    return rows.select(F.col("id").alias("image_id"), "path", "score").orderBy(F.desc("score"), "image_id").limit(k)


def named(hits: DataFrame, vec_map: DataFrame, table: str) -> DataFrame:
    """Row numbers of one vector table resolved to ids."""
    return hits.join(vec_map.where(F.col("vec_table") == table).select("rowid", "image_id"), "rowid")
