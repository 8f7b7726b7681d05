import json
import os
import struct
import warnings

import pytest
from pyspark.sql import functions as F

from siftspark.operators import dedup, tags
from siftspark.plans import cli, search
from siftspark.plans.ingest import Processors, backfill_tags, forget_texts, ingest_all, ingest_folder
from siftspark.plans.store import SCHEMAS, Store
from siftspark.sources import bookmarks, capture, config, files, sinks
from siftspark.streaming import feeds


def png(w, h, extra=b""):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\x08\x02\0\0\0" + extra


@pytest.fixture
def lib(tmp_path):
    d = tmp_path / "lib"
    (d / "sub dir").mkdir(parents=True)
    (d / "a.md").write_text("# Big Idea\n\nwrite a meme search engine\n")
    (d / "sub dir" / "b+c.txt").write_text("plain note about lighthouses")
    (d / "l.links").write_text("# c\nhttps://example.com/a  why it matters\nhttps://example.com/b\nnot a url\n\n")
    (d / "i.png").write_bytes(png(4, 5))
    (d / "j.png").write_bytes(png(4, 5))
    (d / "bad.png").write_bytes(b"nope")
    (d / "x.exe").write_bytes(b"x")
    return d


def names(df):
    return sorted(os.path.basename(r.path) for r in df.select("path").collect())


def test_listing(spark, lib):
    rows = files.listing(spark, str(lib))
    assert names(rows) == ["a.md", "b+c.txt", "bad.png", "i.png", "j.png", "l.links"]
    assert files.listing(spark, str(lib / "none")).count() == 0
    assert "content" not in rows._jdf.queryExecution().optimizedPlan().output().mkString(",")


def test_readers(spark, lib):
    n = files.notes(files.contents(spark, [str(lib / "a.md"), str(lib / "sub dir" / "b+c.txt")])).orderBy("title").collect()
    assert [r.title for r in n] == ["Big Idea", "plain note about lighthouses"]
    got = files.links(files.contents(spark, [str(lib / "l.links")])).orderBy("seq").collect()
    assert [(r.url, r.comment) for r in got] == [("https://example.com/a", "why it matters"), ("https://example.com/b", "")]
    im = files.images(files.contents(spark, [str(lib / "i.png"), str(lib / "bad.png")])).orderBy("path").collect()
    assert [(r.width, r.height, r.error is None) for r in im] == [(None, None, False), (4, 5, True)]


@pytest.mark.parametrize("total", range(1, 60))
def test_sampled_pages(total):
    p = files.sampled_pages(total)
    assert p[0] == 0 and p[-1] == total - 1 and len(p) == min(5, total) and p == sorted(set(p))


def test_ingest(spark, lib, tmp_path):
    cfg = config.parse({"folders": {str(lib): {"text_embed": "stub"}}})
    store = Store(spark, str(tmp_path / "store"))
    pages = spark.createDataFrame([("https://example.com/a", "text/html", 200, "Example A", "meme page " * 40)], "url string, content_type string, code int, title string, text string")
    p = Processors(pages=pages)
    p.models.register("text_embed", "stub")(lambda: lambda c: F.array((F.length(c) % 7).cast("double"), F.lit(1.0), F.lit(0.0)))
    first = ingest_folder(store, cfg, str(lib), p)
    assert first == {"seen": 6, "skipped": 0, "indexed": 5, "pruned": 0, "failed": 1}
    assert ingest_folder(store, cfg, str(lib), p) == {"seen": 6, "skipped": 5, "indexed": 0, "pruned": 0, "failed": 1}
    status = {r.title: r.status for r in store.read("items").collect()}
    assert status["Example A"] == "ok" and status["https://example.com/b"] == "dead"
    e = search.SearchEngine(store.read, cfg, {"stub": lambda q: [len(q) % 7, 1.0, 0.0]})
    assert {r.title for r in e.search_text(str(lib), "meme", 5).collect()} == {"Example A", "Big Idea", "plain note about lighthouses"}
    assert e.search_text(str(lib), "meme", 5, mode="rrf").first().source == "both"
    assert e.duplicates().count() == 1
    (lib / "l.links").write_text("https://example.com/b\n")
    os.utime(lib / "l.links", (1, 1))
    os.remove(lib / "a.md")
    os.remove(lib / "i.png")
    assert ingest_folder(store, cfg, str(lib), p)["pruned"] == 1
    assert {r.title for r in store.read("items").collect()} == {"https://example.com/b", "plain note about lighthouses"}
    assert store.read("images").count() == 1 and store.read("text_docs").count() == 2


def test_a_failing_folder_leaves_the_last_version(spark, lib, tmp_path):
    cfg = config.parse({"folders": {str(lib): {"ocr": "m"}, str(tmp_path / "other"): {}}})
    store = Store(spark, str(tmp_path / "store"))

    def broken(rows):
        raise RuntimeError("model is gone")

    p = Processors()
    p.models.register("ocr", "m")(lambda: broken)
    out = ingest_all(store, cfg, p)
    assert out[str(lib)]["error"].endswith("model is gone") and store.read("files").count() == 0


def test_routes_and_overrides(spark, tmp_path):
    """Tags decide what an auto-routed folder's images are read by; an override has its own processors; OCR comes before captions."""
    d = tmp_path / "pics"
    (d / "Phone").mkdir(parents=True)
    for k, n in enumerate(("meme.png", "photo.png", "Phone/shot.png")):
        (d / n).write_bytes(png(4, 5, bytes([k])))
    cfg = config.parse({"folders": {str(d): {"tagger": "t", "ocr": "o", "caption": "c", "text_embed": "e", "route": "auto", "overrides": {"phone": {"ocr": "o2", "tagger": "off", "caption": "off"}}}}})
    p, asked = Processors(), []
    name = F.regexp_extract("path", "([a-z]+)[.]png$", 1)

    def tagger():
        asked.append("t")
        both = F.array(F.struct(F.when(name == "meme", "meme").otherwise("photo").alias("tag"), F.lit(0.9).alias("score"), F.lit(0).alias("pos")), F.struct(F.lit("art").alias("tag"), F.lit(0.1).alias("score"), F.lit(1).alias("pos")))
        return lambda rows: rows.select("id", F.explode(both).alias("x")).select("id", "x.*")

    p.models.register("tagger", "t")(tagger)
    for kind, m in (("ocr", "o"), ("ocr", "o2"), ("caption", "c")):
        p.models.register(kind, m)(lambda m=m: lambda rows: rows.select("id", F.concat(F.lit(f"{m} of "), name).alias("text")))
    p.models.register("text_embed", "e")(lambda: lambda c: F.array(F.length(c).cast("double"), F.when(c.startswith("o of meme\nc of"), 1.0).otherwise(0.0)))
    p.models.register("caption", "unused")(lambda: 1 / 0)
    store = Store(spark, str(tmp_path / "store"))
    ingest_folder(store, cfg, str(d), p)
    assert sorted((r.text, r.source) for r in store.read("text_docs").collect()) == [("c of meme", "caption"), ("c of photo", "caption"), ("o of meme", "ocr"), ("o2 of shot", "ocr")]
    assert {(r.tag, r["rank"]) for r in store.read("tags").collect()} == {("meme", 1), ("photo", 1), ("art", 2)} and asked == ["t"]
    assert sorted(r.embedding[1] for r in store.read("vectors").collect()) == [0.0, 0.0, 1.0]
    assert {r.tag: r.n for r in tags.facet_counts(store.read("tags")).collect()} == {"meme": 1, "photo": 1, "art": 2}
    version = store.version
    assert ingest_folder(store, cfg, str(d), p)["skipped"] == 3 and store.version == version
    ids = store.read("images").where(F.col("path").endswith("meme.png"))
    assert forget_texts(store, ids, "caption") == 1 and store.read("text_docs").count() == 3 and store.read("vectors").count() == 2
    with pytest.raises(KeyError):
        p.models.get("ocr", "none")


def test_tag_backfill(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    images = [(i, f"/x/{i}", "x", i, 1.0, 1, 1, 0.0) for i in "abc"]
    vectors = [("image", "m", k, i, [1.0, float(k)]) for k, i in enumerate("abcd")]
    store.commit(images=spark.createDataFrame(images, SCHEMAS["images"]), vectors=spark.createDataFrame(vectors, SCHEMAS["vectors"]), tags=spark.createDataFrame([("a", "art", "s", 0.5, 1)], SCHEMAS["tags"]))
    labels = spark.createDataFrame([(0, "meme", [1.0, 0.0]), (1, "photo", [0.0, 1.0])], "pos int, tag string, embedding array<double>")
    cfg = config.parse({"folders": {"x": {"image_embed": "m"}}})
    assert backfill_tags(store, cfg, Processors(), labels) == 2
    assert sorted((r.id, r.tag) for r in store.read("tags").where("rank = 1").collect()) == [("a", "art"), ("b", "meme"), ("c", "photo")]
    assert backfill_tags(store, cfg, Processors(), labels) == 0


def test_store_keeps_what_did_not_change(spark, tmp_path):
    root = tmp_path / "store"
    store = Store(spark, str(root))
    docs = spark.createDataFrame([("a", "t", None)], SCHEMAS["text_docs"])
    store.commit(text_docs=docs)
    for k in range(5):
        store.commit(files=spark.createDataFrame([("p", "f", "i", float(k))], SCHEMAS["files"]))
    assert store.version == 6 and store.read("files").first().mtime == 4.0 and store.read("text_docs").count() == 1 and store.read("tags").count() == 0
    assert sorted(p.name for p in root.glob("v*")) == ["v1", "v4", "v5", "v6"] and sorted(p.name for p in root.glob("v1/*")) == ["text_docs"]


def test_image_sizes():
    lossy = b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 640, 480)
    lossless = b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", 639 | 479 << 14)
    entries = lambda e, k: b"".join(struct.pack(e + "HHI", t, k, 1) + (struct.pack(e + "HH", v, 0) if k == 3 else struct.pack(e + "I", v)) for t, v in ((256, 640), (257, 480)))
    tiffs = [m + struct.pack(e + "IH", 8, 2) + entries(e, k) for m, e in ((b"II*\0", "<"), (b"MM\0*", ">")) for k in (3, 4)]
    assert [files._size(b) for b in (lossy, lossless, *tiffs)] == [(640, 480)] * 6
    assert files._size(b"RIFF\0\0\0\0WEBPVP8 ") is None and files._size(b"II*\0") is None


def test_command_line(spark, lib, tmp_path, capsys):
    (tmp_path / "c.yaml").write_text(json.dumps({"folders": {str(lib): {}}}))
    base = ["--config", str(tmp_path / "c.yaml"), "--store", str(tmp_path / "store")]
    assert cli.main([*base, "index"]) == 1  # one file cannot be read
    capsys.readouterr()
    assert cli.main([*base, "--tsv", "search", str(lib), "meme", "-k", "3", "--field", "ocr"]) == 0
    head, row = capsys.readouterr().out.splitlines()
    assert "title" in head.split("\t") and "Big Idea" in row.split("\t")
    assert cli.main([*base, "dupes"]) == 0 and len(json.loads(capsys.readouterr().out)["paths"]) == 2


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("defaults: {ocr: a, caption: b}\nfolders:\n  /x: {caption: off, route: auto, ocr_when: meme, overrides: {Shots: {ocr: c}}}\nprivate: [/x/p]\n")
    c = config.load(str(f))
    folder = c.folders["/x"]
    assert folder.processors == {"ocr": "a"} and folder.auto and folder.gates["ocr"] == (("meme",), 2)
    assert folder.processors_for("/x/shots/1.png") == {"ocr": "c", "caption": "b"} and folder.processors_for("/x/1.png") == {"ocr": "a"}
    assert c.models() == {("ocr", "a"), ("ocr", "c"), ("caption", "b")} and c.private == ("/x/p",)
    for bad in ({"ocr": True}, {"route": "manual"}, {"exclude_patterns": ["("]}, {"ocr_when": [1]}):
        with pytest.raises(ValueError):
            config.parse({"folders": {"/x": bad}})
    with pytest.warns(UserWarning):
        config.parse({"folders": {"/x": {"text_embed": "a"}, "/y": {"text_embed": "b"}}})
    with pytest.warns(UserWarning):
        config.parse({"folders": {"/x": {"orc": "a"}}})
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert config.parse({}) == config.Config()


def test_firefox(spark, tmp_path):
    places = spark.createDataFrame([(1, "https://a.b/"), (2, "javascript:x")], "id long, url string")
    marks = spark.createDataFrame([(1, 2, None, 0, "root"), (2, 2, None, 1, "Bookmarks Toolbar"), (3, 2, None, 2, "Reading"), (4, 1, 1, 3, " A "), (5, 1, 2, 3, "js"), (6, 2, None, 7, "loop"), (7, 2, None, 6, "loop2")], "id long, type int, fk long, parent long, title string")
    assert [tuple(r) for r in bookmarks.firefox(places, marks).collect()] == [("https://a.b/", "A", "Bookmarks Toolbar/Reading", "firefox")]
    assert bookmarks.firefox_profile(spark, str(tmp_path)).count() == 0


def test_chromium(spark, tmp_path):
    tree = {"roots": {"bar": {"name": "Bookmarks bar", "type": "folder", "children": [{"type": "url", "url": "https://a.b/", "name": " A "}, {"name": "Nested", "children": [{"type": "url", "url": "javascript:1"}, {"type": "url", "url": "http://c.d/"}]}]}, "x": 3}}
    path = tmp_path / bookmarks.CHROMIUM["chrome"]
    path.parent.mkdir(parents=True)
    path.write_text(json.dumps(tree))
    got = sorted(tuple(r) for r in bookmarks.chromium(spark, str(tmp_path), "chrome").collect())
    assert got == [("http://c.d/", "", "Bookmarks bar/Nested", "chrome"), ("https://a.b/", "A", "Bookmarks bar", "chrome")]
    assert bookmarks.chromium(spark, str(tmp_path), "edge").count() == 0
    assert bookmarks.chromium_json("{broken", "edge") == []


def test_request():
    r = search.request({"folder": "f", "q": "x", "k": "500", "tags": "chart,nsfw,zzz", "field": "title"}, ["f"])
    assert r == {"folder": "f", "query": "x", "k": 100, "facets": ["chart"], "field": None}
    assert search.request({"folder": "f", "k": "no"}, ["f"])["k"] == 10
    with pytest.raises(ValueError):
        search.request({"folder": "g"}, ["f"])


def test_change_feed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    landing = str(tmp_path / "landing")
    spark.createDataFrame([("/a", "f", "i1", 1.0, False), ("/a", "f", "i2", 2.0, False), ("/b", "f", "i3", 1.0, False)], feeds.CHANGES).write.parquet(landing)
    feeds.follow(store, landing, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.path, r.image_id) for r in store.read("files").collect()) == [("/a", "i2"), ("/b", "i3")]
    spark.createDataFrame([("/b", "f", None, 3.0, True)], feeds.CHANGES).write.mode("append").parquet(landing)
    feeds.follow(store, landing, str(tmp_path / "cp")).awaitTermination()
    assert [r.path for r in store.read("files").collect()] == ["/a"]


def test_windows_and_sessions(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "u", "a", 1.0), (1, "2024-01-01 00:10:00", "u", "a", 1.0), (2, "2024-01-01 00:20:00", "u", "a", 2.0), (3, "2024-01-01 02:00:00", "u", "b", 1.0)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id string, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    once = feeds.distinct(df)
    assert once.count() == 3
    assert sorted((r.event_type, r.n, r.total) for r in feeds.windowed(once).collect()) == [("a", 2, 3.0), ("b", 1, 1.0)]
    assert sorted(r.n for r in feeds.sessions(once).collect()) == [1, 2]
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    feeds.windowed(feeds.distinct(stream), late=None).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("w").count() >= 0


def test_captures(spark, tmp_path):
    df = spark.createDataFrame([("https://a.b/ ", "ignored", None, "why  it\nmatters"), (None, " body ", " T ", None), ("", "plain", "", None), (None, " ", "T", None)], "url string, text string, title string, comment string")
    got = sorted((r.kind, r.content) for r in capture.captured(df).collect())
    assert got == [("link", "https://a.b/ why it matters\n"), ("note", "# T\n\nbody\n"), ("note", "plain\n")]
    folder = str(tmp_path / "drop")
    assert capture.land(capture.captured(df), folder) == 3 and capture.land(capture.captured(df), folder) == 0
    posts = spark.createDataFrame([("1", "A  b", "https://x.y/z.PNG", "t"), ("2", "T", "https://x.y/", "text"), ("3", "T", "https://x.y/", None), ("4", None, None, None)], "id string, title string, url string, text string")
    assert [(r.kind, r.name, r.content) for r in capture.saved_posts(posts).orderBy("name").collect()] == [("image", "post-1.png", "https://x.y/z.PNG"), ("note", "post-2.md", "# T\n\ntext\n"), ("link", "saved.links", "https://x.y/ T\n")]


def test_sinks(spark, tmp_path):
    lines = spark.createDataFrame([("b", "b x"), ("a", "a y")], "url string, line string")
    sinks.write_links(lines, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a y", "b x"]
    books = dedup.merged_books(spark.createDataFrame([("The Sea", "Ann", 0.9, 1), ("Odd", "Bo", 0.9, 2), ("Low", "Cy", 0.2, 3)], "title string, author string, confidence double, seq int"))
    cat = spark.createDataFrame([("the sea", "https://c/1", "The Sea", ["Ann B"], 1990, ["s"] * 20, "long  text"), ("odd", "https://c/2", "Something else", [], None, [], None)], "title_key string, key string, title string, authors array<string>, year int, subjects array<string>, description string")
    matched, left = sinks.catalogued(books, cat)
    assert [r.line for r in matched.collect()] == ["https://c/1 The Sea — Ann B (1990) [" + "; ".join(["s"] * 12) + "] long text"]
    assert sorted(r.title for r in left.collect()) == ["Low", "Odd"]
    assert sinks.review_lines(left).orderBy("confidence").first().line == "0.20\tLow\tCy"
