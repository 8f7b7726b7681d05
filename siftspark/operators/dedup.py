"""Duplicate content, bookmarks and books.

Groups are aggregated with partial combining; only lists of paths, browsers and folders are collected, which are
as long as the answer itself. Defined cases: null keys form no group of files; null titles and folders count as
empty; ties go to the earlier row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions.text import plain_words
from siftspark.functions.urls import normalize_url, refusal_reason


def duplicate_groups(files: DataFrame) -> DataFrame:
    """image_id, paths (sorted) of content with several paths."""
    rows = files.where("image_id is not null").select("image_id", "path").distinct()
    return rows.groupBy("image_id").agg(F.sort_array(F.collect_list("path")).alias("paths")).where(F.size("paths") > 1)


def dupes_report(files: DataFrame) -> DataFrame:
    """image_id, kept, extra paths, number of them; nothing is deleted."""
    g = duplicate_groups(files)
    return g.select("image_id", F.element_at("paths", 1).alias("kept"), F.slice("paths", 2, F.size("paths") - 1).alias("extra"), (F.size("paths") - 1).alias("n_extra"))


def extra_copies(files: DataFrame) -> DataFrame:
    """image_id, kept, path: one row for every path of a content but the first, whatever their number; nothing is
    collected, so a content may have any number of paths."""
    rows = files.where("image_id is not null").select("image_id", "path").distinct()
    kept = rows.groupBy("image_id").agg(F.min("path").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(kept, "image_id").where("path <> kept").select("image_id", "kept", "path")


def judged_bookmarks(bookmarks: DataFrame) -> DataFrame:
    return bookmarks.select("bookmark_id", "url", F.coalesce("title", F.lit("")).alias("title"), "folder", "browser", refusal_reason("url").alias("reason"))


def merged_bookmarks(bookmarks: DataFrame) -> DataFrame:
    """url_key, url, title, browsers, folders: one row per canonical url worth fetching.

    The url is the first one, the title the longest (the first of that length).
    """
    ok = judged_bookmarks(bookmarks).where("reason = ''").withColumn("url_key", normalize_url("url"))
    return ok.groupBy("url_key").agg(
        F.min_by("url", "bookmark_id").alias("url"),
        F.max_by("title", F.struct(F.length("title"), -F.col("bookmark_id"))).alias("title"),
        F.sort_array(F.collect_set("browser")).alias("browsers"),
        F.sort_array(F.collect_set(F.when(F.col("folder") != "", F.col("folder")))).alias("folders"),
    )


def bookmark_stats(bookmarks: DataFrame) -> DataFrame:
    """stat, n: total, skipped by reason, duplicates merged, unique."""
    rows = judged_bookmarks(bookmarks)
    ok = rows.where("reason = ''").select(normalize_url("url").alias("u")).agg(F.count("*").alias("a"), F.countDistinct("u").alias("b"))
    by = rows.where("reason <> ''").groupBy(F.concat(F.lit("skipped: "), "reason").alias("stat")).agg(F.count("*").alias("n"))
    total = bookmarks.agg(F.count("*").alias("n")).select(F.lit("total").alias("stat"), "n")
    rest = ok.select(F.explode(F.array(F.struct(F.lit("duplicates merged").alias("stat"), (F.col("a") - F.col("b")).alias("n")), F.struct(F.lit("unique").alias("stat"), F.col("b").alias("n")))).alias("s")).select("s.*")
    return total.unionByName(by).unionByName(rest)


def link_lines(merged: DataFrame) -> DataFrame:
    """url, line: the text of a links file."""
    folders = F.when(F.size("folders") > 0, F.concat(F.lit("["), F.array_join("folders", "; "), F.lit("]")))
    browsers = F.concat(F.lit("("), F.array_join("browsers", ","), F.lit(")"))
    comment = F.trim(F.regexp_replace(F.concat_ws(" ", F.when(F.col("title") != "", F.col("title")), folders, browsers), "\n", " "))
    return merged.select("url", F.rtrim(F.concat_ws(" ", "url", comment)).alias("line"))


def merged_books(books: DataFrame) -> DataFrame:
    """title, author, confidence of each book, by plain title and author; seq is the reading order."""
    keyed = books.withColumn("t", plain_words(F.coalesce("title", F.lit("")))).withColumn("a", plain_words(F.coalesce("author", F.lit(""))))
    best = keyed.groupBy("t", "a").agg(F.max_by(F.struct("title", "author", "confidence"), F.struct("confidence", -F.col("seq"))).alias("b"))
    return best.select("b.*", F.col("t").alias("title_key"), F.col("a").alias("author_key"))


def split_books(books: DataFrame, least: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(sure, to be reviewed)"""
    return books.where(F.col("confidence") >= least), books.where(~(F.col("confidence") >= least) | F.col("confidence").isNull())


def same_title(found, wanted):
    """Whether a catalogue title may be the wanted one: equal first three words, or one holds the other."""
    f, w = plain_words(found), plain_words(wanted)
    return (F.slice(F.split(f, " "), 1, 3) == F.slice(F.split(w, " "), 1, 3)) | F.contains(w, f) | F.contains(f, w)
