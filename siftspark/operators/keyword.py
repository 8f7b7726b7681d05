"""Keyword search: an exact BM25 over folded words, with phrases, AND between them, and a field scope.

Rows are (id, text, source). Words of the id count like words of the text; a phrase must lie within one of the
two. Corpus figures (rows, average length, rows per phrase) are over all rows, whatever the filters. bm25 reads the
texts once, without a shuffle of them, and keeps their counts; for many searches, write_index stores postings with
positions, partitioned by a bucket of the word, and search_index reads the buckets of the query's words only.

Defined cases: null texts are empty; a query without words finds nothing; equal scores are ordered by id;
repeated rows are separate rows and may give an id twice; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions.text import phrases, words
from siftspark.session import checkpoint

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FIELDS = ("ocr", "caption")
BUCKETS = 256


def _count(tokens: Column, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    every = F.lit(True)
    for w in phrase:
        every = every & F.array_contains(tokens, w)
    # looked ahead for, so that overlapping phrases all count
    return F.when(every, F.regexp_count(joined, F.lit(f"(?= {' '.join(phrase)} )"))).otherwise(0)


def _counted(docs: DataFrame, query: str) -> tuple[DataFrame, int]:
    wanted = phrases(query)
    rows = docs.select("id", "source", words(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("a"), words(F.coalesce("text", F.lit(""))).alias("b"))
    counts = [(_count(F.col("a"), p) + _count(F.col("b"), p)).alias(f"f{i}") for i, p in enumerate(wanted)]
    return rows.select("id", "source", (F.size("a") + F.size("b")).alias("dl"), *counts), len(wanted)


def in_field(field: str | None) -> Column:
    """Rows without a source belong to every field."""
    if field is None:
        return F.lit(True)
    if field not in FIELDS:
        raise ValueError(f"field must be one of {FIELDS} or None, not {field!r}")
    return F.col("source").isNull() | (F.col("source") == field)


def bm25(docs: DataFrame, query: str, k: int | None = None, field: str | None = None) -> DataFrame:
    """id, source, score of the rows that have every phrase, best first, the first k of them."""
    scope = in_field(field)
    rows, n = _counted(docs, query)
    if n == 0:
        return docs.sparkSession.createDataFrame([], "id string, source string, score double")
    rows = checkpoint(rows)  # lengths and counts: the texts are cut into words once
    figures = rows.agg(F.count("*").alias("rows"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(n)])
    out = _scored(rows.where(scope), figures, n)
    return out if k is None else out.orderBy(F.desc("score"), "id").limit(k)


def _scored(rows: DataFrame, figures: DataFrame, n: int) -> DataFrame:
    """id, source, score of rows (id, source, dl, f0, f1, ...) that have every phrase; figures is one row."""
    for i in range(n):
        rows = rows.where(F.col(f"f{i}") > 0)
    rows = rows.join(F.broadcast(figures), how="cross")  # one row of figures
    score = F.lit(0.0)
    for i in range(n):
        idf = F.log((F.col("rows") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        f = F.col(f"f{i}").cast("double")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.select("id", "source", score.alias("score"))


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def write_index(docs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Postings (word, doc, id, source, dl, part, at) by bucket of the word, and one row of figures; a common word of a
    third of all rows is one bucket's files, of any number."""
    doc = docs.select(F.monotonically_increasing_id().alias("doc"), "id", "source", words(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("a"), words(F.coalesce("text", F.lit(""))).alias("b"))
    doc = checkpoint(doc.withColumn("dl", F.size("a") + F.size("b")))  # numbers of rows must stay what they are
    each = [doc.select("doc", "id", "source", "dl", F.lit(i).alias("part"), F.posexplode(c).alias("at", "word")) for i, c in enumerate("ab")]
    found = each[0].unionByName(each[1]).groupBy("word", "doc", "id", "source", "dl", "part").agg(F.sort_array(F.collect_list("at")).alias("at"))  # one row's own words
    found.withColumn("bucket", _bucket(F.col("word"), buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    doc.agg(F.count("*").alias("rows"), F.avg("dl").alias("avgdl")).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/figures")


def _moved(at: Column, n: int) -> Column:
    return F.transform(at, lambda x: x - n)


def search_index(spark: SparkSession, path: str, query: str, k: int | None = None, field: str | None = None) -> DataFrame:
    """bm25 over a stored index."""
    scope, wanted = in_field(field), phrases(query)
    if not wanted:
        return spark.createDataFrame([], "id string, source string, score double")
    figures = spark.read.parquet(f"{path}/figures")
    buckets = figures.first().buckets
    every = sorted({w for p in wanted for w in p})
    places = [r[0] for r in spark.createDataFrame([(w,) for w in every], "w string").select(_bucket(F.col("w"), buckets)).collect()]
    rows = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(places) & F.col("word").isin(every))
    at = [F.coalesce(F.max(F.when(F.col("word") == w, F.col("at"))), F.array().cast("array<int>")).alias(f"w{i}") for i, w in enumerate(every)]
    part = rows.groupBy("doc", "id", "source", "dl", "part").agg(*at)
    counts = []
    for i, p in enumerate(wanted):
        starts = [_moved(F.col(f"w{every.index(w)}"), j) for j, w in enumerate(p)]
        both = starts[0]
        for s in starts[1:]:
            both = F.array_intersect(both, s)
        counts.append(F.sum(F.size(both)).alias(f"f{i}"))
    found = checkpoint(part.groupBy("doc", "id", "source", "dl").agg(*counts))
    figures = figures.join(found.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(wanted))]), how="cross")  # one row each
    out = _scored(found.where(scope), figures, len(wanted))
    return out if k is None else out.orderBy(F.desc("score"), "id").limit(k)


def postings(docs: DataFrame, row: str = "doc_row") -> DataFrame:
    """doc_row, id, source, word, tf, dl: the inverted index, to be written partitioned by a bucket of word."""
    tokens = F.concat(words(F.coalesce(F.col("id").cast("string"), F.lit(""))), words(F.coalesce("text", F.lit(""))))
    rows = docs.select(row, "id", "source", tokens.alias("tokens"))
    rows = rows.select(row, "id", "source", F.size("tokens").alias("dl"), F.explode("tokens").alias("word"))
    return rows.groupBy(row, "id", "source", "word", "dl").agg(F.count("*").alias("tf"))
