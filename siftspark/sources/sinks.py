"""Text sinks: links files and book lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.functions.text import collapse_ws
from siftspark.operators.dedup import same_title, split_books

SUBJECTS, DESCRIPTION = 12, 1500


def write_lines(lines: DataFrame, path: str, order: list, column: str = "line") -> None:
    """One text file of ordered lines; meant for lists a person reads."""
    lines.orderBy(*order).select(column).coalesce(1).write.mode("overwrite").text(path)


def write_links(lines: DataFrame, path: str) -> None:
    write_lines(lines, path, ["url"])


def catalogued(books: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched: url, line; left over) of sure books against rows (title_key, key, title, authors, year, subjects,
    description) of a catalogue; a row whose title does not fit is no match."""
    sure, unsure = split_books(books)
    b = sure.alias("b").join(catalogue.withColumnsRenamed({c: f"c_{c}" for c in catalogue.columns}), F.col("b.title_key") == F.col("c_title_key"), "left")
    fits = F.col("c_key").isNotNull() & (F.col("c_key") != "") & same_title(F.coalesce("c_title", F.lit("")), F.col("b.title"))
    good = b.where(fits)
    author = F.coalesce(F.when(F.size("c_authors") > 0, F.array_join("c_authors", ", ")), F.col("b.author"))
    subjects = F.when(F.size("c_subjects") > 0, F.concat(F.lit("["), F.array_join(F.slice("c_subjects", 1, SUBJECTS), "; "), F.lit("]")))
    about = F.substring(collapse_ws(F.coalesce("c_description", F.lit(""))), 1, DESCRIPTION)
    year = F.when(F.col("c_year").isNotNull(), F.concat(F.lit("("), F.col("c_year").cast("string"), F.lit(")")))
    text: Column = F.concat_ws(" ", "c_title", F.lit("—"), author, year, subjects, F.when(about != "", about))
    matched = good.select(F.col("c_key").alias("url"), F.concat_ws(" ", "c_key", collapse_ws(text)).alias("line"))
    return matched, unsure.unionByName(b.where(~F.coalesce(fits, F.lit(False))).select("b.*"))


def review_lines(books: DataFrame) -> DataFrame:
    """confidence, line of books to be looked at."""
    return books.select("confidence", F.concat_ws("\t", F.format_string("%.2f", "confidence"), "title", "author").alias("line"))
