"""Index state: what is new, what is gone, merges and cascades. Snapshots are never changed in place.

Defined cases: null modification times count as changed; a null key never matches; merging replaces whole rows
by key and keeps rows of other keys; the later of repeated new rows wins by the given order, else any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def changed(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Listed rows (path, mtime) whose path is unknown or has another modification time."""
    old = files.select("path", F.col("mtime").alias("old")).groupBy("path").agg(F.max("old").alias("old"))
    both = listing.join(old, "path", "left")
    return both.where(F.col("old").isNull() | F.col("mtime").isNull() | (F.col("old") != F.col("mtime"))).drop("old")


def vanished(files: DataFrame, listing: DataFrame) -> DataFrame:
    return files.join(listing.select("path"), "path", "left_anti")


def merge(old: DataFrame, new: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """The next snapshot: new rows replace old rows of their key."""
    one = new.dropDuplicates([key]) if order is None else new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    return old.join(one.select(key), key, "left_anti").unionByName(one, allowMissingColumns=True)


def orphan_images(images: DataFrame, files: DataFrame, folder: str | None = None) -> DataFrame:
    own = images if folder is None else images.where(F.col("folder") == folder)
    return own.join(files.select(F.col("image_id").alias("id")), "id", "left_anti")


def orphan_items(items: DataFrame, files: DataFrame, folder: str | None = None) -> DataFrame:
    """Notes whose content, and links whose file, no path holds; pdfs are never orphans."""
    own = items if folder is None else items.where(F.col("folder") == folder)
    notes = own.where("kind = 'note'").join(files.select(F.col("image_id").alias("id")), "id", "left_anti")
    links = own.where("kind = 'link'").join(files.select(F.col("path").alias("src_path")), "src_path", "left_anti")
    return notes.unionByName(links)


def purge(gone: DataFrame, **tables: tuple[DataFrame, str]) -> dict[str, DataFrame]:
    """Tables (frame, id column) without the rows of the gone ids."""
    return {n: t.join(gone.select(F.col("id").alias(c)).distinct(), c, "left_anti") for n, (t, c) in tables.items()}


def link_changes(current: DataFrame, items: DataFrame) -> DataFrame:
    """id, src_path, change (new, moved, stale) of listed links (id, src_path) against the stored ones."""
    old = items.where("kind = 'link'").select("id", F.col("src_path").alias("old_path")).distinct()
    listed = current.select("src_path").distinct()
    now = current.dropDuplicates(["id", "src_path"])
    kept = old.select("id", F.col("old_path").alias("src_path"))
    fresh = now.join(kept, ["id", "src_path"], "left_anti")
    moved = fresh.join(old.select("id").distinct(), "id", "left_semi").withColumn("change", F.lit("moved"))
    new = fresh.join(old.select("id").distinct(), "id", "left_anti").withColumn("change", F.lit("new"))
    stale = kept.join(listed, "src_path", "left_semi").join(now, ["id", "src_path"], "left_anti").withColumn("change", F.lit("stale"))
    cols = ["id", "src_path", "change"]
    return new.select(cols).unionByName(moved.select(cols)).unionByName(stale.select(cols))


def with_source(text_docs: DataFrame, ocr: DataFrame, captions: DataFrame) -> DataFrame:
    """Rows (id, text) with the source they came from: ocr, caption or none."""
    a = ocr.select(F.col("image_id").alias("id"), "text").distinct().withColumn("is_ocr", F.lit(True))
    b = captions.select(F.col("image_id").alias("id"), "text").distinct().withColumn("is_caption", F.lit(True))
    rows = text_docs.join(a, ["id", "text"], "left").join(b, ["id", "text"], "left")
    return rows.withColumn("source", F.when(F.col("is_ocr"), "ocr").when(F.col("is_caption"), "caption")).drop("is_ocr", "is_caption")
