"""One ranking per query from lists whose scores differ in scale.

Scores become percentiles of their own list; every hit's percentiles, sorted ascending, are compared
lexicographically (leximin), so that a weak score cannot hide behind a strong one. The hit that has the better place
than every other hit in more than half of the query's lists is put first. Leximin names it: its first hit is
checked against all others; where the check fails, since one bad list decides that order, only hits that beat the
one that failed can still be it, and the first of these in leximin order is next, until none is left.

Places in a list are counted on distinct scores inside score buckets. A query is compared with one hit of its own at
a time, over salts, and aggregated with partial results, so no query or list is ever gathered in one task.

Defined cases: the best valid score of an id in a list counts; null and NaN scores are no place; an id without
a valid score in a list stands behind all that have one; equal scores have equal places; rows without query_id,
image_id or source are ignored; repeated rows change nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftspark.llm.buckets import sized
from siftspark.session import checkpoint

SALTS = 16  # tasks a query is spread over when it is compared with one of its hits
BUCKETS = 64  # score buckets of a large list
LARGE = 50_000  # distinct scores from which a list is cut into buckets
ABSENT = 2_147_483_647


def best_scores(hits: DataFrame) -> DataFrame:
    """query_id, source, image_id, score: one row per hit of a list; score is null where none is valid."""
    score = F.col("score").cast("double")
    rows = hits.select("query_id", "source", "image_id", F.when(~F.isnan(score), score).alias("score"))
    return rows.dropna(subset=["query_id", "source", "image_id"]).groupBy("query_id", "source", "image_id").agg(F.max("score").alias("score"))


def places(best: DataFrame, large: int = LARGE) -> DataFrame:
    """Adds place (1 + number of better hits of the list) and n (size of the list's valid part) by counting
    on distinct scores; lists with more than `large` of them are first cut at their score quantiles."""
    q = ["query_id", "source"]
    tied = best.where("score is not null").groupBy(*q, "score").agg(F.count("*").alias("m"))
    cuts = tied.groupBy(*q).agg(
        F.sum("m").alias("n"),
        F.count("*").alias("distinct_scores"),
        F.percentile_approx("score", [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("cuts"),
    )
    cuts = cuts.select(*q, "n", F.when(F.col("distinct_scores") > large, F.col("cuts")).alias("cuts"))
    cell = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("score"))), F.lit(0))
    cell = F.when(F.col("cuts").isNull(), 0).otherwise(cell)
    tied = tied.join(cuts, q).withColumn("cell", cell)
    per_cell = tied.groupBy(*q, "cell").agg(F.sum("m").alias("in_cell"))
    above = F.sum("in_cell").over(Window.partitionBy(*q).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1))
    per_cell = per_cell.select(*q, "cell", F.coalesce(above, F.lit(0)).alias("above"))
    inside = F.sum("m").over(Window.partitionBy(*q, "cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    placed = tied.join(per_cell, [*q, "cell"]).select(*q, "score", "n", (F.col("above") + F.coalesce(inside, F.lit(0)) + 1).alias("place"))
    return best.join(placed, [*q, "score"], "left")


def _short(hits: DataFrame) -> DataFrame:
    """Hits with 64-bit hashes for ids, which only have to differ within a query; ids are long texts."""
    ids = F.when(F.col("image_id").isNotNull(), F.xxhash64("image_id"))
    return hits.select("query_id", ids.alias("image_id"), "score", "source")


def profiles(hits: DataFrame, large: int = LARGE) -> DataFrame:
    """query_id, image_id (hashed), places (map source -> place), leximin (number of lists that place the hit, its
    percentiles there ascending): a list that does not place it counts as a percentile of 0, which is below all
    others, so that vectors filled up with zeros compare as these pairs do."""
    placed = places(best_scores(_short(hits)), large)
    part = F.col("place").isNotNull()
    share = (F.col("n") - F.col("place") + 1) / F.col("n")
    rows = placed.groupBy("query_id", "image_id").agg(
        F.map_from_entries(F.collect_list(F.when(part, F.struct("source", F.col("place").cast("int").alias("place"))))).alias("places"),
        F.array_sort(F.collect_list(F.when(part, share))).alias("got"),
        F.collect_set("source").alias("sources"),
    )
    return rows.select("query_id", "image_id", "places", "sources", F.struct(F.size("got").alias("placed"), "got").alias("leximin"))


def _wins(a: str, b: str) -> str:
    """SQL: the number of lists in which a's place is better than b's."""
    return f"size(filter(map_entries({a}.places), e -> e.value < coalesce({b}.places[e.key], {ABSENT})))"


def _lead(rows: DataFrame) -> DataFrame:
    """query_id, c: the first hit in leximin order."""
    return rows.groupBy("query_id").agg(F.max_by(F.struct("image_id", "places"), F.struct("leximin", "image_id")).alias("c"))


def _against(rows: DataFrame, lead: DataFrame) -> DataFrame:
    """rows with their query's c and lists; a long query is spread over salts."""
    spread = lead.withColumn("salt", F.explode(F.array([F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("salt", F.pmod(F.xxhash64("image_id"), F.lit(SALTS)).cast("int")).join(spread, ["query_id", "salt"]).drop("salt")


def _unbeaten(prof: DataFrame, lead: DataFrame) -> DataFrame:
    """The exact check: of (query_id, c, lists), those that beat every other hit of their query in most lists."""
    rows = _against(prof.select("query_id", "image_id", F.struct("places").alias("o")), lead)
    lost = F.expr(f"image_id <> c.image_id and 2 * {_wins('c', 'o')} <= lists")
    checked = rows.groupBy("query_id", F.col("c.image_id").alias("first")).agg(F.sum(lost.cast("int")).alias("lost"))
    return checked.where("lost = 0").select("query_id", F.col("first").alias("image_id"))


def list_counts(prof: DataFrame) -> DataFrame:
    """query_id, lists: sources are few."""
    return prof.groupBy("query_id").agg(F.size(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("lists"))


def majority_winner(prof: DataFrame) -> DataFrame:
    """query_id, image_id (hashed) of the hit that beats every other hit of its query in more than half of the lists."""
    lists = list_counts(prof)
    lead = _lead(prof).join(lists, "query_id")
    first = checkpoint(_unbeaten(prof, lead))
    left = prof.join(first.select("query_id"), "query_id", "left_anti")
    last = None
    rows, lead = left, checkpoint(_lead(left).join(lists, "query_id"))
    while not lead.isEmpty():
        # hits that do not beat the leading one cannot be first; every round leaves fewer
        rows = checkpoint(_against(rows.withColumn("o", F.struct("places")), lead).where(F.expr(f"2 * {_wins('o', 'c')} > lists")).select(prof.columns))
        new = checkpoint(_lead(rows).join(lists, "query_id"))
        done = lead.join(new.select("query_id"), "query_id", "left_anti")
        last = done if last is None else last.unionByName(done)
        lead = new
    return first if last is None else first.unionByName(_unbeaten(left, checkpoint(last)))


def ranking(hits: DataFrame, large: int = LARGE) -> DataFrame:
    """query_id, image_id, place, weakest (least percentile): the whole combined ranking; place 1 is best, the hit
    that beats all others in most lists stands first, all others in leximin order, ties by the smaller image_id."""
    prof = checkpoint(profiles(hits, large))
    first = majority_winner(prof).withColumn("first", F.lit(1))
    names = hits.dropna(subset=["query_id", "source", "image_id"]).select("query_id", F.xxhash64("image_id").alias("h"), "image_id").distinct()
    rows = prof.withColumnRenamed("image_id", "h").join(first.withColumnRenamed("image_id", "h"), ["query_id", "h"], "left").join(names, ["query_id", "h"])
    rows = rows.join(sized(checkpoint(list_counts(prof))), "query_id")
    weakest = F.when(F.col("leximin.placed") < F.col("lists"), 0.0).otherwise(F.element_at("leximin.got", 1))
    rows = rows.select("query_id", "image_id", "leximin", F.round(weakest, 6).alias("weakest"), F.coalesce("first", F.lit(0)).alias("first"))
    order = [F.desc("first"), F.desc("leximin"), F.col("image_id")]
    # ordered ranges, kept as a table so that their numbers stay what they are; a long query spans many of them
    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpoint(rows.repartitionByRange(parts, "query_id", *order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("query_id", "part").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("query_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("query_id", "part", before.alias("before"))
    inner = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))
    return ranged.withColumn("inner", inner).join(sizes, ["query_id", "part"]).select("query_id", "image_id", (F.col("before") + F.col("inner")).alias("place"), "weakest")


def first_hits(hits: DataFrame, large: int = LARGE) -> DataFrame:
    first = checkpoint(majority_winner(checkpoint(profiles(hits, large))).withColumnRenamed("image_id", "h"))
    rows = hits.dropna(subset=["query_id", "source", "image_id"]).select("query_id", "image_id", F.xxhash64("image_id").alias("h"))
    return rows.join(sized(first), ["query_id", "h"]).select("query_id", "image_id").distinct()
