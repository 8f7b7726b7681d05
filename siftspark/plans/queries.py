"""Core queries over the test tables and, where SQL can express them, the same in DuckDB's SQL.

Each query reads whole tables. Limits are top-k features only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftspark.functions import exclusions, paths, text, urls
from siftspark.functions import vectors as V
from siftspark.functions.html import WALLS, extract, page_state
from siftspark.operators import components, dedup, hits, keyword, nearest, state, tags
from siftspark.session import table
from siftspark.sources import capture
from siftspark.streaming import feeds

MODEL = "siglip2-base"
KEYWORDS = "lighthouse storm"
PHRASE = "borrowed-tools"
FOLDER = "saved"
PRIVATE = ("/lib/phone", "*/screenshots/*mirror*")


def _items(spark: SparkSession, d: str) -> DataFrame:
    """One row an id, the latest."""
    rows = table(spark, d, "items")
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("created_at"), F.asc_nulls_last("title"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _text_docs(spark: SparkSession, d: str) -> DataFrame:
    """id, text, source of everything with text: scans as ocr, captions, and items without a source."""
    ocr = table(spark, d, "ocr_text").where("text is not null").select(F.col("image_id").alias("id"), "text", F.lit("ocr").alias("source")).distinct()
    cap = table(spark, d, "documents").where(F.lower(F.trim("source")) == "captions").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("id"), "text", F.lit("caption").alias("source"))
    items = _items(spark, d).select("id", text.searchable(F.col("title"), F.col("url"), F.col("body")).alias("text"), F.lit(None).cast("string").alias("source"))
    return ocr.unionByName(cap).unionByName(items)


_SQL_ITEMS = "(SELECT * EXCLUDE (n_) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, title ASC NULLS LAST) AS n_ FROM items) WHERE n_ = 1)"
_WS = r"[\s\x{A0}\x{85}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]+"
_SQL_SEARCHABLE = rf"regexp_replace(concat_ws(chr(10), nullif(title, ''), nullif(url, ''), nullif(body, '')), '^{_WS}|{_WS}$', '', 'g')"
_SQL_DOCS = f"""docs AS (
  SELECT DISTINCT image_id AS id, text, 'ocr' AS source FROM ocr_text WHERE text IS NOT NULL
  UNION ALL SELECT sha256(CAST(doc_id AS VARCHAR)), text, 'caption' FROM documents WHERE lower(trim(source)) = 'captions'
  UNION ALL SELECT id, {_SQL_SEARCHABLE}, NULL FROM {_SQL_ITEMS}
)"""


def _sql_words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(strip_accents(lower({c})), '[^\pL\pN]+'), lambda x: x <> '')"


def _sql_bm25(query: str, scope: str = "TRUE") -> str:
    """A common table expression `scored` (id, source, score) for a query of single words or phrases."""
    n = text.phrases(query)

    def count(c: str, p: list[str]) -> str:
        cond = " AND ".join(f"{c}[i + {j}] = '{w}'" for j, w in enumerate(p))
        return f"len(list_filter(range(1, greatest(len({c}) - {len(p) - 1}, 0) + 1), lambda i: {cond}))"

    fs = ", ".join(f"{count('a', p)} + {count('b', p)} AS f{i}" for i, p in enumerate(n))
    ns = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(len(n)))
    every = " AND ".join(f"f{i} > 0" for i in range(len(n)))
    part = " + ".join(
        f"(CASE WHEN ln((rows_ - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((rows_ - n{i} + 0.5) / (n{i} + 0.5)) END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(n))
    )
    return f"""{_SQL_DOCS}, toks AS (SELECT id, source, {_sql_words("id")} AS a, {_sql_words("coalesce(text, '')")} AS b FROM docs),
counted AS (SELECT id, source, len(a) + len(b) AS dl, {fs} FROM toks),
figures AS (SELECT count(*) AS rows_, avg(dl) AS avgdl, {ns} FROM counted),
scored AS (SELECT id, source, {part} AS score FROM counted, figures WHERE {every} AND ({scope}))"""


_USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_SQL_VEC = f"SELECT *, embedding::DOUBLE[] AS e FROM vectors WHERE embedding IS NOT NULL AND {_USABLE}"
_SQL_QUERY = f"q AS (SELECT e AS qe, id AS qid FROM ({_SQL_VEC}) WHERE space = 'image' AND model = '{MODEL}' ORDER BY rowid LIMIT 1)"


def _query_vector(spark: SparkSession, d: str) -> tuple[str, list[float]]:
    rows = nearest.partition(table(spark, d, "vectors"), "image", MODEL).where(V.usable(F.col("embedding"), 64))
    r = rows.orderBy("rowid").select("id", "embedding").first()
    return r.id, list(r.embedding)


def content_hash_ids(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.sha2("text", 256).alias("id"), F.sha2(F.concat(F.lit("link:"), F.coalesce("origin", F.lit(""))), 256).alias("link_id"))


def duplicate_groups(spark, d):
    g = dedup.duplicate_groups(table(spark, d, "files"))
    return g.select("image_id", F.array_join("paths", "|").alias("paths"), F.size("paths").cast("long").alias("n"))


def dupes_report(spark, d):
    return dedup.extra_copies(table(spark, d, "files"))


def note_titles(spark, d):
    rows = table(spark, d, "items").where("kind = 'note'").select("id", "body", "src_path").distinct()
    return rows.select("id", text.note_title(F.coalesce("body", F.lit("")), paths.stem(F.col("src_path"))).alias("title"))


def searchable_text(spark, d):
    rows = table(spark, d, "items").select("id", "title", "url", "body").distinct()
    t = text.searchable(F.col("title"), F.col("url"), F.col("body"))
    return rows.select("id", F.sha2(t, 256).alias("digest"), F.length(t).cast("long").alias("chars"))


def snippets(spark, d):
    return table(spark, d, "items").select("id", F.sha2(F.coalesce(text.snippet(F.col("body")), F.lit("")), 256).alias("digest")).distinct()


def page_sampling(spark, d):
    n = F.col("n_chars") % 60
    spread = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.bround(i * (n - 1) / 4, 0).cast("int"))
    every = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.when(n <= 5, every).otherwise(spread), ",").alias("pages"))


def collapsed_words(spark, d):
    t = F.coalesce("title", F.lit(""))
    return table(spark, d, "bookmarks").select("bookmark_id", text.collapse_ws(t).alias("flat"), text.plain_words(t).alias("plain"))


def query_facets(spark, d):
    rest, found = text.facets(F.coalesce("title", F.lit("")))
    return table(spark, d, "documents").select("doc_id", rest.alias("rest"), F.array_join(found, ",").alias("facets"))


def normalize_urls(spark, d):
    return table(spark, d, "bookmarks").select("bookmark_id", urls.normalize_url("url").alias("url_key"))


def fetchable_reasons(spark, d):
    return table(spark, d, "bookmarks").select("bookmark_id", urls.refusal_reason("url").alias("reason"))


def bookmark_dedupe(spark, d):
    m = dedup.merged_bookmarks(table(spark, d, "bookmarks"))
    return m.select("url_key", "url", "title", F.array_join("browsers", ",").alias("browsers"), F.array_join("folders", "; ").alias("folders"))


def dedupe_stats(spark, d):
    return dedup.bookmark_stats(table(spark, d, "bookmarks"))


def link_lines(spark, d):
    return dedup.link_lines(dedup.merged_bookmarks(table(spark, d, "bookmarks")))


def financial_names(spark, d):
    rows = table(spark, d, "files").select("path").union(spark.createDataFrame([("/x/W-2_2023.pdf",), ("/x/taxi.pdf",), ("/x/tax-return.pdf",), ("/x/K1 final.pdf",), ("/x/1099.pdf",), ("/x/w23.pdf",)], "path string"))
    return rows.distinct().select("path", exclusions.name_excluded(paths.name(F.col("path"))).alias("excluded"))


def financial_contents(spark, d):
    rows = table(spark, d, "items").where("kind = 'pdf'").select("id", "title", "body").distinct()
    extra = spark.createDataFrame([("a", "Letter", "Your Account Number is 5"), ("b", None, "call 123-45-6789 now"), ("c", "Routing number", "account number")], "id string, title string, body string")
    return rows.unionByName(extra).select("id", exclusions.content_marker(F.col("title"), F.col("body")).alias("marker"))


def knn_topk_l2(spark, d):
    _, q = _query_vector(spark, d)
    out = nearest.nearest(table(spark, d, "vectors"), "image", MODEL, q, 20)
    return out.select("id", "rowid", F.round("score", 6).alias("score"))


def knn_cosine(spark, d):
    _, q = _query_vector(spark, d)
    out = nearest.nearest(table(spark, d, "vectors"), "image", MODEL, q, 20, "cosine")
    return out.select("id", "rowid", F.round("score", 6).alias("score"))


def knn_named(spark, d):
    """Row numbers of the nearest vectors resolved through the map of ids."""
    _, q = _query_vector(spark, d)
    out = nearest.named(nearest.nearest(table(spark, d, "vectors"), "image", MODEL, q, 20), table(spark, d, "vec_map"), "vec_image__siglip2_base")
    return out.select("image_id", F.round("score", 6).alias("score"))


def similar_images(spark, d):
    id, _ = _query_vector(spark, d)
    out = nearest.similar(table(spark, d, "vectors"), table(spark, d, "images"), "scans", MODEL, id, 50, table(spark, d, "images").where("width is null").select("id"))
    return out.select("image_id", "path", F.round("score", 6).alias("score"))


def vector_tables(spark, d):
    rows = table(spark, d, "vectors").select(V.table_name(F.col("space"), F.col("model")).alias("vec_table"), V.usable(F.col("embedding"), 64).alias("ok"), F.round(V.norm(F.col("embedding")), 6).alias("n"))
    return rows.groupBy("vec_table").agg(F.count("*").alias("vectors"), F.count_if("ok").alias("usable"), F.count_if(F.col("ok") & (F.abs(F.col("n") - 1) < 0.001)).alias("unit"))


def _labels(spark, d) -> DataFrame:
    """Seven stand-in label vectors: the means of the first classes of `embeddings`."""
    e = table(spark, d, "embeddings").where(F.col("label") < len(tags.LABELS)).select("label", F.posexplode(V.doubles(F.col("embedding"))).alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", F.round("x", 6).alias("x")))).alias("v"))
    tag = F.element_at(F.array([F.lit(x) for x in tags.LABELS]), F.col("label") + 1)
    return means.select(F.col("label").alias("pos"), tag.alias("tag"), F.expr("transform(v, p -> p.x)").alias("embedding"))


def _tags(spark, d) -> DataFrame:
    """id, tag, score, rank of every image by its vector with the smallest rowid."""
    v = nearest.partition(table(spark, d, "vectors"), "image", MODEL).where(V.usable(F.col("embedding"), 64))
    v = v.groupBy("id").agg(F.min_by("embedding", "rowid").alias("embedding"))
    return tags.zero_shot(v, _labels(spark, d)).withColumn("score", F.round("score", 9))


_SQL_TAGS = f"""labels AS (
  SELECT label AS pos, ['meme', 'chart', 'screenshot', 'document', 'photo', 'art', 'nsfw'][label + 1] AS tag, list(x ORDER BY i) AS le
  FROM (SELECT label, i, round(avg(embedding[i]::DOUBLE), 6) AS x FROM embeddings, range(1, 65) r(i) WHERE label < 7 GROUP BY label, i) GROUP BY label
), one AS (SELECT id, arg_min(e, rowid) AS e FROM ({_SQL_VEC}) WHERE space = 'image' AND model = '{MODEL}' GROUP BY id),
raw AS (SELECT id, pos, tag, list_dot_product(e, le) AS s FROM one, labels),
tags AS (SELECT id, tag, round(s, 9) AS score, row_number() OVER (PARTITION BY id ORDER BY s DESC, pos) AS rank FROM raw)"""


def zero_shot_tags(spark, d):
    return _tags(spark, d).select("id", "tag", (F.round("score", 6) + 0.0).alias("score"), F.col("rank").cast("long").alias("rank"))


def facet_all_tags(spark, d):
    return tags.with_all(_tags(spark, d), ["chart", "document"])


def facet_counts(spark, d):
    return tags.facet_counts(_tags(spark, d))


def facet_admits_items(spark, d):
    _, parsed = text.facets_of("unemployment graphs")
    return tags.allowed(_tags(spark, d), table(spark, d, "items"), FOLDER, [], parsed)


def routing_gate(spark, d):
    t = _tags(spark, d).groupBy("id").agg(F.collect_list(F.struct("tag", "score", "rank")).alias("ranked"))
    return t.select("id", tags.wants("ocr", F.col("ranked")).alias("ocr"), tags.wants("caption", F.col("ranked")).alias("caption"))


def hidden_ids(spark, d):
    return tags.hidden(table(spark, d, "images"), _tags(spark, d), PRIVATE)


def hits_without_hidden(spark, d):
    h = table(spark, d, "search_hits").select(F.col("image_id").alias("id"), "query_id", "source").distinct()
    return hits.without(h, tags.hidden(table(spark, d, "images"), _tags(spark, d), PRIVATE))


def top_labelled(spark, d):
    return tags.top_label(_tags(spark, d), table(spark, d, "images")).select("path", F.round("score", 6).alias("score"))


def backfill_untagged(spark, d):
    """Images with a vector but no tag, when tags exist only for images of one width."""
    t = _tags(spark, d).join(table(spark, d, "images").where("width = 1280").select("id"), "id", "left_semi")
    v = nearest.partition(table(spark, d, "vectors"), "image", MODEL).where(V.usable(F.col("embedding"), 64))
    return tags.untagged(v, table(spark, d, "images"), t).select("id").distinct()


def bm25_topk(spark, d):
    return keyword.bm25(_text_docs(spark, d), KEYWORDS, 50).select("id", "source", F.round("score", 6).alias("score"))


def bm25_all(spark, d):
    return keyword.bm25(_text_docs(spark, d), "lantern").select("id", "source", F.round("score", 6).alias("score"))


def bm25_field(spark, d):
    return keyword.bm25(_text_docs(spark, d), "lantern", None, "ocr").select("id", "source", F.round("score", 6).alias("score"))


def phrase_match(spark, d):
    return keyword.bm25(_text_docs(spark, d), PHRASE).select("id", "source", F.round("score", 6).alias("score"))


def corpus_words(spark, d):
    """Word, rows and occurrences over the whole text index, from its postings."""
    docs = _text_docs(spark, d).withColumn("doc_row", F.sha2(F.concat_ws("\x01", "id", "text", "source"), 256))
    return keyword.postings(docs).groupBy("word").agg(F.countDistinct("doc_row").alias("rows"), F.sum("tf").alias("occurrences")).where("rows >= 3")


def _lists(spark, d, k: int = 40) -> tuple[DataFrame, DataFrame]:
    v = nearest.partition(table(spark, d, "vectors"), "text", "bge-small-en-v1.5").where(V.usable(F.col("embedding"), 64))
    q = v.orderBy("rowid").select("embedding").first()[0]
    near = nearest.nearest(v, "text", "bge-small-en-v1.5", list(q), k).select("id", "score")
    return near, keyword.bm25(_text_docs(spark, d), "lantern", k).select("id", "score")


def hybrid_concat(spark, d):
    near, words = _lists(spark, d)
    both = hits.resolved(hits.concatenated(near, words), table(spark, d, "images"), table(spark, d, "items"))
    return hits.cut(both, 60).select("id", F.round("score", 6).alias("score"), "source", "path", "kind", "title", "url", "snippet")


def hybrid_rrf(spark, d):
    near, words = _lists(spark, d, 100)
    return hits.rrf(near, words, 60).select("id", F.round("score", 9).alias("score"), "source")


def hits_rrf(spark, d):
    h = table(spark, d, "search_hits").select("query_id", "source", F.col("image_id").alias("id"), "score")
    return hits.rrf_lists(h, "query_id").select("query_id", "id", F.round("score", 9).alias("score"), "sources")


def captured_notes(spark, d):
    rows = table(spark, d, "documents").select(F.lit(None).cast("string").alias("url"), "text", "title", F.lit(None).cast("string").alias("comment"))
    return capture.captured(rows).select("name", F.sha2("content", 256).alias("digest"))


def relevance_cliff(spark, d):
    _, q = _query_vector(spark, d)
    return hits.near_enough(nearest.nearest(table(spark, d, "vectors"), "image", MODEL, q, None), 1.2).select("id", "rowid", F.round("score", 6).alias("score"))


def resolve_hits(spark, d):
    h = table(spark, d, "search_hits").select(F.col("image_id").alias("id"), "query_id").distinct()
    return hits.resolved(h, table(spark, d, "images"), _items(spark, d)).select("id", "query_id", "path", "kind", "title", "url")


def folder_scope(spark, d):
    h = table(spark, d, "search_hits").select(F.col("image_id").alias("id"), "query_id").distinct()
    return hits.resolved(h, table(spark, d, "images"), _items(spark, d), FOLDER).select("id", "query_id", "path", "kind")


def _listing(spark, d) -> DataFrame:
    """A later listing: some files touched, some gone, some new."""
    f = table(spark, d, "files").select("path", "mtime").distinct()
    n = F.length("path") % 7
    kept = f.where(n != 3).withColumn("mtime", F.when(n == 1, F.col("mtime") + 1).otherwise(F.col("mtime")))
    return kept.unionByName(f.where(n == 3).select(F.concat(F.lit("/new"), "path").alias("path"), "mtime"))


_SQL_LISTING = """listing AS (
  SELECT path, CASE WHEN length(path) % 7 = 1 THEN mtime + 1 ELSE mtime END AS mtime FROM (SELECT DISTINCT path, mtime FROM files) WHERE length(path) % 7 <> 3
  UNION ALL SELECT '/new' || path, mtime FROM (SELECT DISTINCT path, mtime FROM files) WHERE length(path) % 7 = 3
)"""


def incremental_diff(spark, d):
    return state.changed(_listing(spark, d), table(spark, d, "files")).select("path", "mtime")


def vanished_files(spark, d):
    return state.vanished(table(spark, d, "files"), _listing(spark, d)).select("path").distinct()


def merged_files(spark, d):
    """The next snapshot of files: listed rows replace known ones."""
    new = _listing(spark, d).select("path", F.lit("lib").alias("folder"), F.sha2("path", 256).alias("image_id"), "mtime")
    old = table(spark, d, "files").select("path", "folder", "image_id", "mtime")
    return state.merge(old, new, "path", F.desc("mtime")).distinct()


def prune_orphans(spark, d):
    files = state.merge(table(spark, d, "files"), _listing(spark, d).where("false").select("path"), "path").join(_listing(spark, d).select("path"), "path", "left_semi")
    a = state.orphan_images(table(spark, d, "images"), files).select("id", F.lit("image").alias("kind"))
    b = state.orphan_items(table(spark, d, "items"), files).select("id", "kind")
    return a.unionByName(b).distinct()


def purged_counts(spark, d):
    gone = state.orphan_images(table(spark, d, "images"), table(spark, d, "files")).select("id")
    left = state.purge(gone, images=(table(spark, d, "images"), "id"), ocr=(table(spark, d, "ocr_text"), "image_id"), vectors=(table(spark, d, "vectors"), "id"))
    rows = [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("tbl"), "n") for n, t in left.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def links_diff(spark, d):
    now = table(spark, d, "items").where("kind = 'link'").where(F.length("url") % 5 != 0)
    now = now.select("id", F.when(F.length("url") % 5 == 1, F.lit("/lib/other.links")).otherwise(F.col("src_path")).alias("src_path")).distinct()
    return state.link_changes(now, table(spark, d, "items"))


def source_backfill(spark, d):
    ocr = table(spark, d, "ocr_text").where("text is not null")
    docs = ocr.select(F.col("image_id").alias("id"), "text").unionByName(table(spark, d, "items").where("body is not null").select("id", F.col("body").alias("text"))).distinct()
    caps = ocr.where("model <> 'rapidocr'")
    out = state.with_source(docs, ocr.where("model = 'rapidocr'"), caps)
    return out.groupBy("source").agg(F.count("*").alias("n"))


def book_dedupe(spark, d):
    rows = table(spark, d, "bookmarks").select(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("folder", F.lit("")).alias("author"), (F.pmod(F.col("bookmark_id"), F.lit(100)) / 100.0).alias("confidence"), F.col("bookmark_id").alias("seq"))
    return dedup.split_books(dedup.merged_books(rows))[0].select("title", "author", F.round("confidence", 2).alias("confidence"))


def status_counts(spark, d):
    return table(spark, d, "items").groupBy("kind", "status").agg(F.count("*").alias("n"))


def page_status(spark, d):
    """State of link pages as if their body were the fetched text."""
    rows = table(spark, d, "items").where("kind = 'link'").select("id", "url", "body").distinct()
    return rows.select("id", page_state(F.col("url"), F.lit("text/html"), F.lit(200), F.coalesce("body", F.lit(""))).alias("state"))


def html_extract(spark, d):
    page = F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title><script>var x=1</script></head><body><p>"), F.coalesce("body", F.lit("")), F.lit("</p></body></html>"))
    rows = table(spark, d, "items").where("kind = 'link'").select("id", page.alias("html")).distinct()
    return rows.select("id", extract("html").alias("p")).select("id", "p.title", F.sha2("p.text", 256).alias("digest"))


def ingest_stats(spark, d):
    """Seen, skipped and changed files of every folder against a later listing."""
    known = table(spark, d, "files")
    f = known.groupBy("path").agg(F.min("folder").alias("folder"))
    todo = state.changed(_listing(spark, d), known).select("path", F.lit(1).alias("todo"))
    rows = _listing(spark, d).join(f, "path", "left").join(todo.distinct(), "path", "left")
    return rows.groupBy(F.coalesce("folder", F.lit("")).alias("folder")).agg(F.count("*").alias("seen"), F.count_if(F.col("todo").isNull()).alias("skipped"), F.count_if(F.col("todo") == 1).alias("changed"))


def link_components(spark, d):
    """Images tied by shared directories: connected components of (image, directory) links."""
    f = table(spark, d, "files").where("image_id is not null").select(F.concat(F.lit("i:"), "image_id").alias("a"), F.concat(F.lit("p:"), F.regexp_replace("path", "/[^/]+$", "")).alias("b"))
    return components.components(f).groupBy("root").agg(F.count("*").alias("nodes"))


def event_windows(spark, d):
    return feeds.windowed(table(spark, d, "events")).withColumn("total", F.round("total", 4))


def event_sessions(spark, d):
    return feeds.sessions(table(spark, d, "events"))


def event_distinct(spark, d):
    e = table(spark, d, "events")
    return feeds.distinct(e.unionByName(e)).groupBy("event_type").agg(F.count("*").alias("n"))


def order_report(spark, d):
    """A star join with partial aggregation."""
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rows.groupBy("n_name", "c_mktsegment").agg(F.round(F.sum("net"), 0).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


def customers_without_orders(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        content_hash_ids, duplicate_groups, dupes_report, note_titles, searchable_text, snippets, page_sampling, collapsed_words,
        query_facets, normalize_urls, fetchable_reasons, bookmark_dedupe, dedupe_stats, link_lines, financial_names, financial_contents,
        knn_topk_l2, knn_cosine, knn_named, similar_images, vector_tables, zero_shot_tags, facet_all_tags, facet_admits_items, routing_gate,
        hidden_ids, hits_without_hidden, top_labelled, backfill_untagged, bm25_topk, bm25_all, bm25_field, phrase_match, corpus_words,
        hybrid_concat, hybrid_rrf, hits_rrf, captured_notes, relevance_cliff, resolve_hits, folder_scope, incremental_diff, vanished_files, merged_files,
        prune_orphans, purged_counts, links_diff, source_backfill, book_dedupe, status_counts, page_status,
        html_extract, ingest_stats, link_components, event_windows, event_sessions, event_distinct, facet_counts, order_report, customers_without_orders,
    )
}

_URL = "trim(url, chr(9) || chr(10) || chr(13) || ' ')"
_TRACK = "['fbclid','gclid','dclid','msclkid','mc_eid','mc_cid','igshid','igsh','ref','ref_src','ref_url','si','spm','_ga','_gl','yclid','twclid','trk']"
_SQL_URLS = rf"""parts AS (
  SELECT bookmark_id, u0, title, folder, browser, lower(regexp_extract(u0, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
    regexp_extract(u0, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS netloc,
    regexp_extract(u0, '^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)', 1) AS path,
    regexp_extract(u0, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(u0, '#(.*)$', 1) AS fragment
  FROM (SELECT *, {_URL} AS u0 FROM bookmarks)
), hosts AS (SELECT *, lower(regexp_extract(netloc, '^(?:[^@]*@)?([^:]*)', 1)) AS host, regexp_extract(netloc, ':([0-9]+)$', 1) AS port FROM parts),
canon AS (
  SELECT *, regexp_replace(host, '^www\.', '') || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END AS loc,
    CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END AS path2,
    list_sort([{{'k': url_decode(replace(regexp_extract(p, '^([^=]*)', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(p, '=(.*)$', 1), '+', ' '))}}
      for p in string_split(query, '&') if p <> '' AND NOT list_contains({_TRACK}, lower(url_decode(replace(regexp_extract(p, '^([^=]*)', 1), '+', ' '))))
        AND NOT regexp_matches(lower(url_decode(replace(regexp_extract(p, '^([^=]*)', 1), '+', ' '))), '^(utm_|pk_|piwik_|matomo_|hsa_|vero_)')]) AS pairs
  FROM hosts
), keyed AS (
  SELECT *, scheme || ':' || CASE WHEN loc <> '' THEN '//' || loc ELSE '' END || path2
    || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string([replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+') for x in pairs], '&') ELSE '' END
    || CASE WHEN fragment LIKE '!%' THEN '#' || fragment ELSE '' END AS url_key,
  CASE WHEN scheme NOT IN ('http', 'https') THEN 'unsupported scheme ''' || scheme || ''''
    WHEN host = '' THEN 'no host'
    WHEN host IN ('localhost', '127.0.0.1', '::1') OR host LIKE '%.local' THEN 'local address'
    WHEN regexp_matches(host, '^(10\.[0-9]+\.[0-9]+\.[0-9]+|192\.168\.[0-9]+\.[0-9]+|172\.(1[6-9]|2[0-9]|3[01])\.[0-9]+\.[0-9]+|127\.[0-9]+\.[0-9]+\.[0-9]+|0\.[0-9]+\.[0-9]+\.[0-9]+|169\.254\.[0-9]+\.[0-9]+)$') THEN 'private address'
    WHEN host IN ('accounts.google.com', 'login.microsoftonline.com', 'login.live.com') OR regexp_matches(lower(path), '/login|/signin|/sign-in|/auth|/oauth|/logout|/register') THEN 'auth endpoint'
    WHEN query <> '' AND regexp_matches(lower(rtrim(path, '/')), '(/search|/results)$') THEN 'search results page' ELSE '' END AS reason
  FROM canon
)"""
_SQL_MERGED = f"""{_SQL_URLS}, raw AS (SELECT b.bookmark_id, b.url, coalesce(b.title, '') AS title, b.folder, b.browser, k.url_key FROM keyed k JOIN bookmarks b USING (bookmark_id) WHERE k.reason = ''),
merged AS (SELECT url_key, arg_min(url, bookmark_id) AS url, arg_max(title, length(title) * 1000000000 - bookmark_id) AS title,
  coalesce(array_to_string(list_sort(list(DISTINCT browser) FILTER (WHERE browser IS NOT NULL)), ','), '') AS browsers,
  coalesce(array_to_string(list_sort(list(DISTINCT folder) FILTER (WHERE folder <> '')), '; '), '') AS folders FROM raw GROUP BY url_key)"""
_HIDDEN = "hidden AS (SELECT id FROM images WHERE path LIKE '/lib/phone/%' OR path = '/lib/phone' OR regexp_matches(path, '/screenshots/.*mirror') UNION SELECT id FROM tags WHERE tag = 'nsfw' AND rank <= 1)"
_KNN = f"WITH {_SQL_QUERY} "
_NEAR = f"(SELECT v.id, v.rowid, 0 - list_distance(e, qe) AS s FROM ({_SQL_VEC}) v, q WHERE space = 'image' AND model = '{MODEL}')"
_NEAR_T = f"""qt AS (SELECT e AS qe FROM ({_SQL_VEC}) WHERE space = 'text' AND model = 'bge-small-en-v1.5' ORDER BY rowid LIMIT 1)"""


def _near_text(k: int) -> str:
    return f"near AS (SELECT v.id, 0 - list_distance(e, qe) AS score FROM ({_SQL_VEC}) v, qt WHERE space = 'text' AND model = 'bge-small-en-v1.5' ORDER BY score DESC, id, rowid LIMIT {k})"


_LAST = f"last AS (SELECT id, kind, src_path, title, url, substr(body, 1, 300) AS snippet, created_at FROM {_SQL_ITEMS} WHERE status IS NULL OR status = 'ok')"
_SQL_LAST_ANY = "last AS (SELECT id, arg_max(struct_pack(kind := kind, src_path := src_path, title := title, url := url, snippet := substr(body, 1, 300)), struct_pack(a := coalesce(created_at, 0), b := coalesce(title, ''))) AS i FROM items WHERE status IS NULL OR status = 'ok' GROUP BY id)"
_RESOLVED = "SELECT h.id, query_id, coalesce(m.path, l.src_path) AS path, CASE WHEN m.path IS NOT NULL THEN 'image' ELSE l.kind END AS kind, CASE WHEN m.path IS NULL THEN l.title END AS title, CASE WHEN m.path IS NULL THEN l.url END AS url FROM (SELECT DISTINCT image_id AS id, query_id FROM search_hits) h LEFT JOIN images m ON m.id = h.id LEFT JOIN last l ON l.id = h.id WHERE m.path IS NOT NULL OR l.id IS NOT NULL"

ORACLE: dict[str, str] = {
    "content_hash_ids": "SELECT doc_id, sha256(text) AS id, sha256('link:' || coalesce(origin, '')) AS link_id FROM documents",
    "duplicate_groups": "SELECT image_id, string_agg(path, '|' ORDER BY path) AS paths, count(*) AS n FROM (SELECT DISTINCT image_id, path FROM files WHERE image_id IS NOT NULL) GROUP BY image_id HAVING count(*) > 1",
    "dupes_report": "WITH f AS (SELECT DISTINCT image_id, path, min(path) OVER (PARTITION BY image_id) AS kept FROM files WHERE image_id IS NOT NULL) SELECT image_id, kept, path FROM f WHERE path <> kept",
    "facet_counts": f"WITH {_SQL_TAGS} SELECT tag, count(DISTINCT id) AS n FROM tags WHERE rank <= 2 GROUP BY tag",
    "event_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM s GROUP BY user_id, no""",
    "event_distinct": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "link_components": """WITH RECURSIVE e AS (SELECT DISTINCT 'i:' || image_id AS a, 'p:' || regexp_replace(path, '/[^/]+$', '') AS b FROM files WHERE image_id IS NOT NULL), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS node, a AS reached FROM both_ UNION SELECT node, b FROM reach JOIN both_ ON reached = a), root AS (SELECT node, min(reached) AS root FROM reach GROUP BY node) SELECT root, count(*) AS nodes FROM root GROUP BY root""",
    "html_extract": rf"""WITH p AS (SELECT DISTINCT id, coalesce(title, '') AS t, regexp_replace(coalesce(body, '') || '</p></body></html>', '(?is)<(noscript)>.*?</noscript>', '<br>', 'g') AS b FROM items WHERE kind = 'link'),
c AS (SELECT id, t, regexp_replace(b, '(?is)<noscript>.*', '<br>') AS b FROM p),
s AS (SELECT id, regexp_replace(t, '(?s)<[/A-Za-z!?][^>]*(>|\z)', '', 'g') || coalesce(array_to_string(list_transform(regexp_extract_all(b, '(?is)<title>(.*?)(?:</title>|\z)', 1), lambda x: regexp_replace(x, '(?s)<[/A-Za-z!?][^>]*(>|\z)', '', 'g')), ''), '') AS t, regexp_split_to_array(regexp_replace(b, '(?is)<title>.*?(</title>|\z)', '<br>', 'g'), '(?s)<[/A-Za-z!?][^>]*(?:>|\z)') AS xs FROM c)
SELECT id, nullif(trim(regexp_replace(t, '{_WS}', ' ', 'g')), '') AS title, sha256(array_to_string(list_filter(list_transform(xs, lambda x: regexp_replace(x, '^{_WS}|{_WS}$', '', 'g')), lambda x: x <> ''), ' ')) AS digest FROM s""",
    "note_titles": rf"""SELECT id, coalesce(nullif(regexp_replace(regexp_replace(coalesce(list_filter([regexp_replace(x, '^{_WS}|{_WS}$', '', 'g') for x in regexp_split_to_array(coalesce(body, ''), '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{{85}}\x{{2028}}\x{{2029}}]')], lambda y: y <> '')[1], ''), '^#+', ''), '^{_WS}|{_WS}$', '', 'g'), ''), regexp_replace(regexp_extract(src_path, '[^/]*$'), '(.)\.[^.]+$', '\1')) AS title FROM (SELECT DISTINCT id, body, src_path FROM items WHERE kind = 'note')""",
    "searchable_text": f"SELECT id, sha256(t) AS digest, length(t) AS chars FROM (SELECT DISTINCT id, title, url, body, {_SQL_SEARCHABLE} AS t FROM items)",
    "snippets": "SELECT DISTINCT id, sha256(coalesce(substr(body, 1, 300), '')) AS digest FROM items",
    "page_sampling": "SELECT doc_id, array_to_string(CASE WHEN n_chars % 60 <= 5 THEN range(n_chars % 60) ELSE [CAST(round_even(i * (n_chars % 60 - 1) / 4.0, 0) AS BIGINT) for i in range(5)] END, ',') AS pages FROM documents",
    "collapsed_words": rf"SELECT bookmark_id, trim(regexp_replace(coalesce(title, ''), '{_WS}', ' ', 'g')) AS flat, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) AS plain FROM bookmarks",
    "query_facets": "WITH f(w, f) AS (VALUES " + ", ".join(f"('{w}', '{f}')" for w, f in text.FACET_WORDS.items()) + rf"""), t AS (SELECT doc_id, coalesce(title, '') AS title, unnest(list_filter(regexp_split_to_array(coalesce(title, ''), '{_WS}'), lambda x: x <> '')) AS tok, generate_subscripts(list_filter(regexp_split_to_array(coalesce(title, ''), '{_WS}'), lambda x: x <> ''), 1) AS i FROM documents),
m AS (SELECT t.*, f.f FROM t LEFT JOIN f ON f.w = lower(trim(tok, '.,!?'))), g AS (SELECT doc_id, string_agg(tok, ' ' ORDER BY i) FILTER (WHERE f IS NULL) AS rest, array_to_string(list_sort(list(DISTINCT f) FILTER (WHERE f IS NOT NULL)), ',') AS facets FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(nullif(g.rest, ''), coalesce(d.title, '')) AS rest, coalesce(facets, '') AS facets FROM documents d LEFT JOIN g USING (doc_id)""",
    "normalize_urls": f"WITH {_SQL_URLS} SELECT bookmark_id, url_key FROM keyed",
    "fetchable_reasons": f"WITH {_SQL_URLS} SELECT bookmark_id, reason FROM keyed",
    "bookmark_dedupe": f"WITH {_SQL_MERGED} SELECT url_key, url, title, browsers, folders FROM merged",
    "dedupe_stats": f"""WITH {_SQL_URLS} SELECT 'total' AS stat, count(*) AS n FROM bookmarks UNION ALL SELECT 'skipped: ' || reason, count(*) FROM keyed WHERE reason <> '' GROUP BY reason
UNION ALL SELECT 'duplicates merged', count(*) - count(DISTINCT url_key) FROM keyed WHERE reason = '' UNION ALL SELECT 'unique', count(DISTINCT url_key) FROM keyed WHERE reason = ''""",
    "link_lines": f"WITH {_SQL_MERGED} SELECT url, rtrim(url || ' ' || trim(replace(concat_ws(' ', nullif(title, ''), CASE WHEN folders <> '' THEN '[' || folders || ']' END, '(' || browsers || ')'), chr(10), ' '))) AS line FROM merged",
    "financial_names": r"""SELECT path, regexp_matches(lower(regexp_extract(path, '[^/]*$')), '1099|statement|invoice|receipt|payroll|paystub|(^|[^a-z0-9])(w-?2|1040|tax(es|-?return)?|k-?1)([^a-z0-9]|$)') AS excluded FROM (SELECT path FROM files UNION SELECT * FROM (VALUES ('/x/W-2_2023.pdf'), ('/x/taxi.pdf'), ('/x/tax-return.pdf'), ('/x/K1 final.pdf'), ('/x/1099.pdf'), ('/x/w23.pdf')) v(path))""",
    "financial_contents": "WITH d AS (SELECT DISTINCT id, title, body FROM items WHERE kind = 'pdf' UNION ALL SELECT * FROM (VALUES ('a', 'Letter', 'Your Account Number is 5'), ('b', NULL, 'call 123-45-6789 now'), ('c', 'Routing number', 'account number')) v(id, title, body)), h AS (SELECT id, lower(coalesce(title, '') || chr(10) || substr(coalesce(body, ''), 1, 4000)) AS hay, substr(coalesce(body, ''), 1, 4000) AS head FROM d) SELECT id, CASE "
    + " ".join(f"WHEN contains(hay, '{m}') THEN '{m}'" for m in exclusions.CONTENT_MARKERS)
    + rf" WHEN regexp_matches(head, '\b\d{{3}}-\d{{2}}-\d{{4}}\b') THEN '{exclusions.NUMBER_NAME}' END AS marker FROM h",
    "knn_topk_l2": f"{_KNN} SELECT id, rowid, round(s, 6) AS score FROM {_NEAR} ORDER BY s DESC, id, rowid LIMIT 20",
    "knn_cosine": f"{_KNN} SELECT v.id, rowid, round(list_cosine_similarity(e, qe), 6) AS score FROM ({_SQL_VEC}) v, q WHERE space = 'image' AND model = '{MODEL}' ORDER BY list_cosine_similarity(e, qe) DESC, v.id, rowid LIMIT 20",
    "knn_named": f"{_KNN} SELECT image_id, round(s, 6) AS score FROM (SELECT * FROM {_NEAR} ORDER BY s DESC, id, rowid LIMIT 20) n JOIN vec_map m ON m.rowid = n.rowid AND vec_table = 'vec_image__siglip2_base'",
    "similar_images": f"{_KNN}, near AS (SELECT * FROM {_NEAR} ORDER BY s DESC, id, rowid LIMIT 251) SELECT n.id AS image_id, i.path, round(s, 6) AS score FROM near n JOIN images i ON i.id = n.id AND i.folder = 'scans' WHERE n.id <> (SELECT qid FROM q) AND i.width IS NOT NULL ORDER BY s DESC, n.id LIMIT 50",
    "vector_tables": f"SELECT 'vec_' || space || '__' || regexp_replace(model, '[^0-9a-zA-Z_]', '_', 'g') AS vec_table, count(*) AS vectors, count(*) FILTER (WHERE ok) AS usable, count(*) FILTER (WHERE ok AND abs(sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])) - 1) < 0.001) AS unit FROM (SELECT *, coalesce({_USABLE}, FALSE) AS ok FROM vectors) GROUP BY 1",
    "zero_shot_tags": f"WITH {_SQL_TAGS} SELECT id, tag, round(score, 6) + 0.0 AS score, rank FROM tags",
    "facet_all_tags": f"WITH {_SQL_TAGS} SELECT id FROM tags WHERE rank <= 2 AND tag IN ('chart', 'document') GROUP BY id HAVING count(DISTINCT tag) = 2",
    "facet_admits_items": f"WITH {_SQL_TAGS} SELECT id FROM tags WHERE rank <= 2 AND tag = 'chart' UNION SELECT id FROM items WHERE folder = '{FOLDER}'",
    "routing_gate": f"WITH {_SQL_TAGS} SELECT id, bool_or(tag IN ('meme', 'chart', 'screenshot', 'document') AND rank <= 2) AS ocr, bool_or(tag IN ('meme', 'chart', 'screenshot', 'document', 'photo', 'art') AND rank <= 6) AS caption FROM tags GROUP BY id",
    "hidden_ids": f"WITH {_SQL_TAGS}, {_HIDDEN} SELECT id FROM hidden",
    "hits_without_hidden": f"WITH {_SQL_TAGS}, {_HIDDEN} SELECT DISTINCT image_id AS id, query_id, source FROM search_hits WHERE image_id NOT IN (SELECT id FROM hidden)",
    "top_labelled": f"WITH {_SQL_TAGS} SELECT path, round(score, 6) AS score FROM tags t JOIN images i USING (id) WHERE tag = 'nsfw' ORDER BY t.score DESC, path DESC LIMIT 30",
    "backfill_untagged": f"WITH {_SQL_TAGS} SELECT DISTINCT id FROM ({_SQL_VEC}) WHERE space = 'image' AND model = '{MODEL}' AND id IN (SELECT id FROM images) AND id NOT IN (SELECT id FROM tags WHERE id IN (SELECT id FROM images WHERE width = 1280))",
    "bm25_topk": f"WITH {_sql_bm25(KEYWORDS)} SELECT id, source, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, id LIMIT 50",
    "bm25_all": f"WITH {_sql_bm25('lantern')} SELECT id, source, round(score, 6) AS score FROM scored",
    "bm25_field": f"WITH {_sql_bm25('lantern', 'source IS NULL OR source = ' + chr(39) + 'ocr' + chr(39))} SELECT id, source, round(score, 6) AS score FROM scored",
    "phrase_match": f"WITH {_sql_bm25(PHRASE)} SELECT id, source, round(score, 6) AS score FROM scored",
    "corpus_words": f"WITH {_SQL_DOCS}, t AS (SELECT sha256(concat_ws(chr(1), id, text, source)) AS r, unnest(list_concat({_sql_words('id')}, {_sql_words(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')})) AS word FROM docs) SELECT word, count(DISTINCT r) AS rows, count(*) AS occurrences FROM t GROUP BY word HAVING count(DISTINCT r) >= 3",
    "hybrid_concat": f"WITH {_sql_bm25('lantern')}, {_NEAR_T}, {_near_text(40)}, kw AS (SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 40), both_ AS (SELECT id, score, 'vector' AS source, 0 AS part FROM near UNION ALL SELECT id, score, 'fts', 1 FROM kw WHERE id NOT IN (SELECT id FROM near)), {_SQL_LAST_ANY} SELECT b.id, round(b.score, 6) AS score, b.source, coalesce(m.path, l.i.src_path) AS path, CASE WHEN m.path IS NOT NULL THEN 'image' ELSE l.i.kind END AS kind, CASE WHEN m.path IS NULL THEN l.i.title END AS title, CASE WHEN m.path IS NULL THEN l.i.url END AS url, CASE WHEN m.path IS NULL THEN l.i.snippet END AS snippet FROM both_ b LEFT JOIN images m ON m.id = b.id LEFT JOIN last l ON l.id = b.id WHERE m.path IS NOT NULL OR l.id IS NOT NULL ORDER BY part, b.score DESC, b.id LIMIT 60",
    "hybrid_rrf": f"WITH {_sql_bm25('lantern')}, {_NEAR_T}, {_near_text(100)}, kw AS (SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 100), placed AS (SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id)) AS part, 'vector' AS source FROM (SELECT id, max(score) AS score FROM near GROUP BY id) UNION ALL SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id)), 'fts' FROM (SELECT id, max(score) AS score FROM kw GROUP BY id)), f AS (SELECT id, sum(part) AS s, CASE WHEN count(*) > 1 THEN 'both' ELSE min(source) END AS source FROM placed GROUP BY id) SELECT id, round(s, 9) AS score, source FROM f ORDER BY s DESC, id LIMIT 60",
    "hits_rrf": "WITH b AS (SELECT query_id, source, image_id AS id, max(score) AS score FROM search_hits WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2, 3), p AS (SELECT query_id, id, source, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id)) AS part FROM b) SELECT query_id, id, round(sum(part), 9) AS score, string_agg(source, '+' ORDER BY source) AS sources FROM p GROUP BY 1, 2",
    "captured_notes": f"SELECT DISTINCT 'note-' || substr(sha256(c), 1, 8) || '.md' AS name, sha256(c) AS digest FROM (SELECT CASE WHEN coalesce(t, '') <> '' THEN '# ' || t || chr(10) || chr(10) ELSE '' END || b || chr(10) AS c, b FROM (SELECT regexp_replace(title, '^{_WS}|{_WS}$', '', 'g') AS t, regexp_replace(coalesce(text, ''), '^{_WS}|{_WS}$', '', 'g') AS b FROM documents)) WHERE b <> ''",
    "relevance_cliff": f"{_KNN} SELECT id, rowid, round(s, 6) AS score FROM {_NEAR} WHERE -s <= 1.2",
    "resolve_hits": f"WITH {_LAST} {_RESOLVED}",
    "folder_scope": f"WITH {_LAST} SELECT h.id, query_id, coalesce(m.path, l.src_path) AS path, CASE WHEN m.path IS NOT NULL THEN 'image' ELSE l.kind END AS kind FROM (SELECT DISTINCT image_id AS id, query_id FROM search_hits) h LEFT JOIN (SELECT * FROM images WHERE folder = '{FOLDER}') m ON m.id = h.id LEFT JOIN (SELECT * FROM last WHERE id IN (SELECT id FROM {_SQL_ITEMS} WHERE folder = '{FOLDER}')) l ON l.id = h.id WHERE m.path IS NOT NULL OR l.id IS NOT NULL",
    "incremental_diff": f"WITH {_SQL_LISTING}, old AS (SELECT path, max(mtime) AS old FROM files GROUP BY path) SELECT l.path, l.mtime FROM listing l LEFT JOIN old USING (path) WHERE old IS NULL OR l.mtime IS NULL OR old <> l.mtime",
    "vanished_files": f"WITH {_SQL_LISTING} SELECT DISTINCT path FROM files WHERE path NOT IN (SELECT path FROM listing)",
    "merged_files": f"WITH {_SQL_LISTING}, new AS (SELECT path, 'lib' AS folder, sha256(path) AS image_id, max(mtime) AS mtime FROM listing GROUP BY path) SELECT DISTINCT path, folder, image_id, mtime FROM files WHERE path NOT IN (SELECT path FROM new) UNION ALL SELECT * FROM new",
    "prune_orphans": f"WITH {_SQL_LISTING}, f AS (SELECT * FROM files WHERE path IN (SELECT path FROM listing)) SELECT id, 'image' AS kind FROM images WHERE id NOT IN (SELECT image_id FROM f WHERE image_id IS NOT NULL) UNION SELECT id, kind FROM items WHERE (kind = 'note' AND id NOT IN (SELECT image_id FROM f WHERE image_id IS NOT NULL)) OR (kind = 'link' AND src_path NOT IN (SELECT path FROM f))",
    "purged_counts": "WITH gone AS (SELECT id FROM images WHERE id NOT IN (SELECT image_id FROM files WHERE image_id IS NOT NULL)) SELECT 'images' AS tbl, count(*) AS n FROM images WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'ocr', count(*) FROM ocr_text WHERE image_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'vectors', count(*) FROM vectors WHERE id NOT IN (SELECT id FROM gone)",
    "links_diff": """WITH old AS (SELECT DISTINCT id, src_path FROM items WHERE kind = 'link'), now AS (SELECT DISTINCT id, CASE WHEN length(url) % 5 = 1 THEN '/lib/other.links' ELSE src_path END AS src_path FROM items WHERE kind = 'link' AND length(url) % 5 <> 0),
fresh AS (SELECT * FROM now EXCEPT SELECT * FROM old) SELECT id, src_path, CASE WHEN id IN (SELECT id FROM old) THEN 'moved' ELSE 'new' END AS change FROM fresh
UNION ALL SELECT id, src_path, 'stale' FROM (SELECT * FROM old WHERE src_path IN (SELECT src_path FROM now) EXCEPT SELECT * FROM now)""",
    "source_backfill": "WITH docs AS (SELECT image_id AS id, text FROM ocr_text WHERE text IS NOT NULL UNION SELECT id, body FROM items WHERE body IS NOT NULL) SELECT CASE WHEN EXISTS (SELECT 1 FROM ocr_text o WHERE o.model = 'rapidocr' AND o.image_id = d.id AND o.text = d.text) THEN 'ocr' WHEN EXISTS (SELECT 1 FROM ocr_text o WHERE o.model <> 'rapidocr' AND o.image_id = d.id AND o.text = d.text) THEN 'caption' END AS source, count(*) AS n FROM docs d GROUP BY 1",
    "book_dedupe": r"""WITH b AS (SELECT coalesce(title, '') AS title, coalesce(folder, '') AS author, (bookmark_id % 100) / 100.0 AS confidence, bookmark_id AS seq FROM bookmarks), k AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t, trim(regexp_replace(lower(author), '[^a-z0-9]+', ' ', 'g')) AS a FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY t, a ORDER BY confidence DESC, seq) AS n FROM k) SELECT title, author, CAST(round(confidence, 2) AS DOUBLE) AS confidence FROM r WHERE n = 1 AND confidence >= 0.7""",
    "status_counts": "SELECT kind, status, count(*) AS n FROM items GROUP BY kind, status",
    "page_status": "SELECT id, CASE WHEN regexp_matches(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '/login|/signin|/sign-in|/auth|/oauth|/logout|/register') THEN 'skipped' WHEN "
    + " OR ".join(f"contains(lower(substr(coalesce(body, ''), 1, 2000)), '{w}')" for w in WALLS)
    + " THEN 'blocked' WHEN length(coalesce(body, '')) < 200 THEN 'thin' ELSE 'ok' END AS state FROM (SELECT DISTINCT id, url, body FROM items WHERE kind = 'link')",
    "ingest_stats": f"WITH {_SQL_LISTING}, f AS (SELECT path, min(folder) AS folder, max(mtime) AS old FROM files GROUP BY path) SELECT coalesce(folder, '') AS folder, count(*) AS seen, count(*) FILTER (WHERE mtime = old) AS skipped, count(*) FILTER (WHERE NOT coalesce(mtime = old, FALSE)) AS changed FROM listing LEFT JOIN f USING (path) GROUP BY 1",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "order_report": "SELECT n_name, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
    "customers_without_orders": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
}
