"""The pN_ queries over the test tables, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm import copies, edits, fusion, languages, leaks, mixing, neighbours, residue, scans
from siftspark.llm.sql import ORACLE
from siftspark.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return edits.pairs(edits.texts(table(spark, d, "items")), words=3, similarity=0.6).select("id_a", "id_b")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return edits.groups(edits.texts(table(spark, d, "items")), words=3, similarity=0.6)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "vectors")).select("vec_table", "id_a", "id_b")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_groups(table(spark, d, "vectors"))


def p2_top10(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.top_k(table(spark, d, "vectors"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return fusion.first_hits(table(spark, d, "search_hits"))


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    return fusion.ranking(table(spark, d, "search_hits"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.furniture(table(spark, d, "items"))


def p4_main_text(spark: SparkSession, d: str) -> DataFrame:
    return residue.main_text(table(spark, d, "items"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residues(table(spark, d, "items"))


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    return residue.kept(table(spark, d, "items")).select("id", "kind", "src_path")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, "bookmarks"))


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "bookmarks")
    first = marks.select(F.col("bookmark_id").alias("keep_id"), "url", "title")
    return copies.records(marks).join(first, "keep_id", "left")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.faults(table(spark, d, "items"), table(spark, d, "ocr_text"))


def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "items"), table(spark, d, "ocr_text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"), coverage=0.5)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.mislabelled(table(spark, d, "documents"))


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    return languages.documents(table(spark, d, "documents"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.segments(table(spark, d, "documents")).drop("letters", "lines")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_groups, p2_top10, p3_found, p3_ranking, p4_found, p4_main_text, p5_found, p5_kept, p6_found, p6_records, p7_found, p7_repaired, p8_found, p8_coverage, p9_found, p9_mix, p9_shares, p10_found, p10_documents, p10_segments)
}


__all__ = ["ORACLE", "QUERIES"]
