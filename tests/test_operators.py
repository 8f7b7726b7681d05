import math

import pytest
from pyspark.sql import functions as F

from siftspark.operators import clusters, components, dedup, hits, keyword, nearest, state, tags


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


DOCS = [("img1", "quarterly unemployment chart", "ocr"), ("img1", "a chart of unemployment", "caption"), ("n1", "deja-vu in the café", None), ("n2", None, None)]


def docs(spark):
    return spark.createDataFrame(DOCS, "id string, text string, source string")


def test_bm25_score(spark):
    got = {(r.id, r.source): r.score for r in keyword.bm25(docs(spark), "chart").collect()}
    dl = [4, 5, 6, 1]
    idf = max(math.log((4 - 2 + 0.5) / (2 + 0.5)), 0) or 1e-6
    for key, n in (("ocr", 4), ("caption", 5)):
        assert got["img1", key] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * n / (sum(dl) / 4))))


def test_keyword_semantics(spark):
    ids = lambda q, **o: sorted(r.id for r in keyword.bm25(docs(spark), q, **o).collect())
    assert ids("unemployment chart") == ["img1", "img1"]
    assert ids("charts") == []
    assert ids("CAFE") == ["n1"] and ids("deja-vu") == ["n1"] and ids("vu-deja") == []
    assert ids("img1") == ["img1", "img1"]
    assert ids("chart !!") == ["img1", "img1"] and ids("!!") == [] and ids("") == []
    assert ids("chart", field="ocr") == ["img1"] and ids("vu", field="caption") == ["n1"]
    assert len(ids("chart", k=1)) == 1
    with pytest.raises(ValueError):
        keyword.bm25(docs(spark), "x", field="title")


def test_overlapping_phrases(spark):
    d = spark.createDataFrame([("a", "x x x", None)], DOCS and "id string, text string, source string")
    c = keyword._counted(d, "x-x")[0].first()
    assert c.f0 == 2 and c.dl == 4


@pytest.mark.parametrize("query", ["storm", "old-storm", "the storm lamp", "the-old-storm lamp", "none", "a-a", "", "id3"])
@pytest.mark.parametrize("field", [None, "ocr"])
def test_a_stored_index_finds_the_same(spark, tmp_path, query, field):
    rows = [(f"id{i}", t, [None, "ocr", "caption"][i % 3]) for i, t in enumerate(["the old storm", "old lamp, the STORM", "a a a a", None, "", "storm storm old storm lamp", "the lamp of the old storm", "the old storm"])] + [("id0", "the old storm", None)]
    docs = spark.createDataFrame(rows, "id string, text string, source string").repartition(3)
    keyword.write_index(docs, str(tmp_path / "index"), 4)
    plain = lambda df: sorted((r.id, r.source or "", round(r.score, 9)) for r in df.collect())
    stored = keyword.search_index(spark, str(tmp_path / "index"), query, None, field)
    assert plain(stored) == plain(keyword.bm25(docs, query, None, field))


def test_a_search_reads_its_words_buckets_only(spark, tmp_path):
    docs = spark.createDataFrame([(f"i{i}", f"w{i} common", None) for i in range(50)], "id string, text string, source string")
    keyword.write_index(docs, str(tmp_path / "index"), 16)
    rows = spark.read.parquet(str(tmp_path / "index" / "postings")).where("bucket in (3)")
    assert all("bucket=3" in r[0] for r in rows.select(F.input_file_name()).distinct().collect())
    assert 0 < rows.select("word").distinct().count() < 30


def test_copies_of_a_third_of_all_files(spark):
    rows = [("hot" if i % 3 == 0 else f"h{i}", f"/p/{i:03}") for i in range(90)] + [("hot", "/p/000"), (None, "/p/x")]
    got = dedup.extra_copies(spark.createDataFrame(rows, "image_id string, path string")).collect()
    assert sorted((r.kept, r.path) for r in got) == [("/p/000", f"/p/{i:03}") for i in range(3, 90, 3)]


def test_postings(spark):
    d = docs(spark).withColumn("doc_row", F.monotonically_increasing_id())
    got = {(r.word, r.source): r.tf for r in keyword.postings(d).where("id = 'img1'").collect()}
    assert got["chart", "ocr"] == 1 and got["img1", "caption"] == 1


VECTORS = [
    ("image", "m", 1, "img1", [1.0, 0.0, 0.0]), ("image", "m", 2, "img2", [0.9, 0.1, 0.0]), ("image", "m", 3, "img3", [-1.0, 0.0, 0.0]),
    ("image", "m", 4, "zero", [0.0, 0.0, 0.0]), ("image", "m", 5, "short", [1.0]), ("image", "m", 6, "none", None), ("text", "m", 1, "img1", [1.0, 0.0, 0.0]),
]
VS = "space string, model string, rowid bigint, id string, embedding array<float>"


def test_nearest_stays_in_its_partition(spark):
    v = spark.createDataFrame(VECTORS, VS)
    assert [r.id for r in nearest.nearest(v, "image", "m", [1.0, 0.0, 0.0]).collect()] == ["img1", "img2", "img3"]
    assert nearest.nearest(v, "image", "other", [1.0, 0.0, 0.0]).count() == 0
    assert nearest.get_vector(v, "image", "m", "nobody") is None
    images = spark.createDataFrame([(f"img{i}", "f", f"/x/{i}.png") for i in (1, 2, 3)], "id string, folder string, path string")
    assert [r.image_id for r in nearest.similar(v, images, "f", "m", "img1").collect()] == ["img2", "img3"]
    hide = spark.createDataFrame([("img2",)], "id string")
    assert [r.image_id for r in nearest.similar(v, images, "f", "m", "img1", exclude=hide).collect()] == ["img3"]
    with pytest.raises(ValueError):
        nearest.similar(v, images, "f", "m", "nobody")


def test_tags(spark):
    lab = spark.createDataFrame([(i, t, [1.0 if i == j else 0.0 for j in range(7)]) for i, t in enumerate(tags.LABELS)], "pos int, tag string, embedding array<double>")
    v = spark.createDataFrame([("a", [0.1, 0.9, 0.2, 0.0, 0.0, 0.0]), ("b", [0.0, 0.5, 0.5, 0.9, 0.0, 0.0])], "id string, embedding array<float>")
    t = tags.zero_shot(v, lab)
    best = {r.id: r.tag for r in t.where("rank = 1").collect()}
    assert best == {"a": "chart", "b": "document"}
    assert [r["rank"] for r in t.where("id = 'b' and tag in ('chart', 'screenshot')").orderBy("rank").collect()] == [2, 3]  # ties: label order
    assert rows(tags.with_all(t, ["chart", "screenshot"])) == [("a",)]
    items = spark.createDataFrame([("n", "f"), ("o", "g")], "id string, folder string")
    assert rows(tags.allowed(t, items, "f", [], ["chart"])) == [("a",), ("b",), ("n",)]
    assert rows(tags.allowed(t, items, "f", ["chart"], [])) == [("a",), ("b",)]


def test_routing(spark):
    df = spark.createDataFrame([([("art", 0.4, 1), ("meme", 0.3, 2)],), ([("photo", 0.4, 1), ("art", 0.3, 2), ("meme", 0.2, 3)],), ([],), (None,)], "t array<struct<tag string, score double, rank int>>")
    assert [r.x for r in df.select(tags.wants("ocr", F.col("t")).alias("x")).collect()] == [True, False, True, True]
    assert df.select(tags.wants("text_embed", F.col("t")).alias("x")).first().x


def test_hidden(spark):
    images = spark.createDataFrame([("a", "/p/private/x.png"), ("b", "/p/y.png"), ("c", "/p/z.png")], "id string, path string")
    t = spark.createDataFrame([("b", "nsfw", 1), ("c", "nsfw", 2)], "id string, tag string, rank int")
    assert rows(tags.hidden(images, t, ["/p/private"])) == [("a",), ("b",)]


def test_fusion_of_lists(spark):
    v = spark.createDataFrame([("a", -0.1), ("b", -0.2)], "id string, score double")
    k = spark.createDataFrame([("b", 5.0), ("c", 4.0), ("c", 3.0)], "id string, score double")
    assert [(r.id, r.source) for r in hits.cut(hits.concatenated(v, k), 9).collect()] == [("a", "vector"), ("b", "vector"), ("c", "fts"), ("c", "fts")]
    got = hits.rrf(v, k, 9).collect()
    assert [(r.id, r.source) for r in got] == [("b", "both"), ("a", "vector"), ("c", "fts")]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61)
    assert hits.near_enough(v, 0.15).count() == 1
    assert '"id":"a"' in hits.as_json(v).orderBy("hit").first().hit


def test_resolution(spark):
    images = spark.createDataFrame([("a", "/x/a.png", "f"), ("both", "/x/b.png", "f")], "id string, path string, folder string")
    items = spark.createDataFrame(
        [("n", "note", "f", "/n.md", "T", None, "b" * 400, "ok", 1.0), ("both", "note", "f", "/m.md", "T", None, "b", None, 1.0), ("d", "link", "f", "/l", "T", "u", "b", "dead", 1.0), ("n", "note", "f", "/n2.md", "new", None, None, None, 2.0)],
        "id string, kind string, folder string, src_path string, title string, url string, body string, status string, created_at double",
    )
    h = spark.createDataFrame([("a", 1.0), ("n", 1.0), ("both", 1.0), ("d", 1.0), ("gone", 1.0)], "id string, score double")
    got = {r.id: (r.kind, r.path, r.title) for r in hits.resolved(h, images, items, "f").collect()}
    assert got == {"a": ("image", "/x/a.png", None), "both": ("image", "/x/b.png", None), "n": ("note", "/n2.md", "new")}
    assert hits.resolved(h, images, items, "g").count() == 0


def test_duplicates(spark):
    f = spark.createDataFrame([("/x/b.png", "d"), ("/x/a.png", "d"), ("/x/a.png", "d"), ("/x/u.png", "u"), ("/x/n.png", None), ("/x/m.png", None)], "path string, image_id string")
    assert rows(dedup.duplicate_groups(f)) == [("d", ["/x/a.png", "/x/b.png"])]
    assert rows(dedup.dupes_report(f)) == [("d", "/x/a.png", ["/x/b.png"], 1)]


def test_bookmarks(spark):
    b = spark.createDataFrame(
        [(1, "https://e.com/p", "Post", "A", "firefox"), (2, "https://www.e.com/p/", "A longer title", "", "chrome"), (3, "https://e.com/p?utm_source=x", None, "B/C", "edge"), (4, "http://localhost/", "x", "A", "edge"), (5, "https://e.com/q", "Post", None, None)],
        "bookmark_id long, url string, title string, folder string, browser string",
    )
    m = {r.url_key: r for r in dedup.merged_bookmarks(b).collect()}
    assert m["https://e.com/p"].url == "https://e.com/p" and m["https://e.com/p"].title == "A longer title"
    assert m["https://e.com/p"].browsers == ["chrome", "edge", "firefox"] and m["https://e.com/p"].folders == ["A", "B/C"]
    assert {r.stat: r.n for r in dedup.bookmark_stats(b).collect()} == {"total": 5, "skipped: local address": 1, "duplicates merged": 2, "unique": 2}
    lines = {r.url: r.line for r in dedup.link_lines(dedup.merged_bookmarks(b)).collect()}
    assert lines["https://e.com/p"] == "https://e.com/p A longer title [A; B/C] (chrome,edge,firefox)"
    assert dedup.merged_bookmarks(b.where("false")).count() == 0


def test_books(spark):
    b = spark.createDataFrame([("The Book", "Ann", 0.5, 1), ("the  book!", "ann", 0.9, 2), ("Other", "Bo", 0.6, 3), ("The Book", "Ann", 0.9, 4)], "title string, author string, confidence double, seq int")
    m = dedup.merged_books(b)
    assert rows(m.select("title", "confidence")) == [("Other", 0.6), ("the  book!", 0.9)]
    sure, review = dedup.split_books(m)
    assert (sure.count(), review.count()) == (1, 1)
    t = spark.createDataFrame([("A Tale of Two Cities", "Tale of Two"), ("A tale of one", "A Tale Of"), ("X", "Y")], "a string, b string")
    assert [r.x for r in t.select(dedup.same_title(F.col("a"), F.col("b")).alias("x")).collect()] == [True, True, False]


def test_state(spark):
    files = spark.createDataFrame([("/a", "f", "ia", 1.0), ("/b", "f", "ib", 1.0), ("/c", "f", "ic", None)], "path string, folder string, image_id string, mtime double")
    now = spark.createDataFrame([("/a", 1.0), ("/b", 2.0), ("/c", 1.0), ("/d", 1.0)], "path string, mtime double")
    assert rows(state.changed(now, files).select("path")) == [("/b",), ("/c",), ("/d",)]
    assert state.vanished(files, now).count() == 0
    new = spark.createDataFrame([("/b", "f", "ib2", 2.0), ("/b", "f", "ib1", 1.5)], "path string, folder string, image_id string, mtime double")
    merged = state.merge(files, new, "path", F.desc("mtime"))
    assert rows(merged.select("path", "image_id")) == [("/a", "ia"), ("/b", "ib2"), ("/c", "ic")]
    images = spark.createDataFrame([("ia", "f"), ("ib", "f")], "id string, folder string")
    assert rows(state.orphan_images(images, merged, "f").select("id")) == [("ib",)]
    items = spark.createDataFrame([("x", "note", "f", "/a"), ("ia", "note", "f", "/a"), ("l", "link", "f", "/gone"), ("p", "pdf", "f", "/gone")], "id string, kind string, folder string, src_path string")
    assert rows(state.orphan_items(items, merged).select("id")) == [("l",), ("x",)]
    left = state.purge(images.where("id = 'ib'"), images=(images, "id"), files=(files, "image_id"))
    assert left["images"].count() == 1 and left["files"].count() == 2


def test_link_changes(spark):
    items = spark.createDataFrame([("a", "link", "/1"), ("b", "link", "/1"), ("c", "link", "/2")], "id string, kind string, src_path string")
    now = spark.createDataFrame([("a", "/1"), ("c", "/1"), ("n", "/1")], "id string, src_path string")
    assert rows(state.link_changes(now, items)) == [("b", "/1", "stale"), ("c", "/1", "moved"), ("n", "/1", "new")]


def test_sources_of_texts(spark):
    d = spark.createDataFrame([("i", "x"), ("i", "y"), ("n", "z")], "id string, text string")
    o = spark.createDataFrame([("i", "x"), ("i", "x")], "image_id string, text string")
    c = spark.createDataFrame([("i", "y")], "image_id string, text string")
    assert rows(state.with_source(d, o, c).select("text", "source")) == [("x", "ocr"), ("y", "caption"), ("z", None)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = dict(rows(components.components(spark.createDataFrame(chain, "a long, b long"))))
    assert {got[i] for i in range(1, 41)} == {1} and got[101] == got[100] == 100
    star = spark.createDataFrame([("m", f"x{i}") for i in range(300)], "a string, b string")
    assert {r.root for r in components.components(star).collect()} == {"m"}
    assert components.components(star.where("false")).count() == 0


def test_density_clusters(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefgz"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("e", "f"), ("b", "a")], "a string, b string")
    assert dict(rows(clusters.density_clusters(nodes, edges, 3))) == {"a": "a", "b": "a", "c": "a", "d": "a", "e": None, "f": None, "g": None, "z": None}
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), (None, [5.0, 5.0])], "cluster string, embedding array<float>")
    c = clusters.centroids(v)
    assert rows(c) == [("a", [0.5, 0.5], 2)]
    new = spark.createDataFrame([("x", [2.0, 2.0]), ("y", [-1.0, 1.0])], "id string, embedding array<float>")
    assert rows(clusters.assigned(new, c, 0.9)) == [("x", "a"), ("y", None)]


def test_fusion_of_many_lists(spark):
    h = spark.createDataFrame([(1, "a", "x", 5.0), (1, "a", "y", 9.0), (1, "b", "x", -1.0), (1, "b", "z", None), (1, "b", "w", float("nan")), (1, "a", "x", 4.0)], "q int, source string, id string, score double")
    got = {r.id: (r.score, r.sources) for r in hits.rrf_lists(h, "q").collect()}
    assert got == {"x": (pytest.approx(1 / 62 + 1 / 61), "a+b"), "y": (pytest.approx(1 / 61), "a")}
