import random

import pandas as pd
from pyspark.sql import functions as F

from siftspark.functions import exclusions, html, paths, text, urls
from siftspark.functions import vectors as V

SAME = [
    "https://example.com/post", "https://www.example.com/post", "HTTPS://EXAMPLE.com/post/", "https://example.com:443/post",
    "https://example.com/post?utm_source=x", "https://example.com/post#top", " https://user@example.com/post?fbclid=1 ",
]


def one(spark, expr, **values):
    df = spark.createDataFrame(pd.DataFrame({k: [v] for k, v in values.items()})) if values else spark.range(1)
    return df.select(expr.alias("x")).first().x


def column(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string").select("i", f("u").alias("x")).collect()
    return [r.x for r in sorted(rows)]


def test_spellings_of_one_url(spark):
    assert set(column(spark, urls.normalize_url, SAME)) == {"https://example.com/post"}
    cases = {
        "http://a.b:8080/x?b=2&a=1&a=": "http://a.b:8080/x?a=&a=1&b=2", "https://a.b/#!/route": "https://a.b/#!/route",
        "https://a.b/?trkCampaign=1&trk=2": "https://a.b/?trkCampaign=1", "http://[bad": "http://[bad", "http://a.b:port/x": "http://a.b:port/x",
        "http://a.b:99999/": "http://a.b:99999/", "http://a.b:0/": "http://a.b/", "http://a.b/?q=%7e*~%zz+x": "http://a.b/?q=~%2A~%25zz+x", "a.b/x/": "a.b/x",
        "http://a.b?q=é&p=%C3%A9": "http://a.b/?p=%C3%A9&q=%C3%A9", "mailto:a@b.c": "mailto:a@b.c", "": "/", "http://[::1]:80/x": "http://::1/x", "HTTP://a.b//": "http://a.b/",
    }
    assert column(spark, urls.normalize_url, list(cases)) == list(cases.values())


def test_a_key_is_stable_for_any_text(spark):
    rnd = random.Random(3)
    signs = "abAZ09./?&=%#:@[]!~*+ -_;,'é漢\t\n\\"
    made = [rnd.choice(["https://h.example/", "http:", "//", ""]) + "".join(rnd.choices(signs, k=rnd.randint(0, 30))) for _ in range(500)]
    once = column(spark, urls.normalize_url, made)
    twice = column(spark, urls.normalize_url, once)
    assert None not in once and twice == column(spark, urls.normalize_url, twice)


def test_refusals(spark):
    cases = {
        "http://localhost:3000/x": "local address", "http://192.168.1.5/": "private address", "ftp://a.b/": "unsupported scheme 'ftp'",
        "https://a.b/login": "auth endpoint", "https://a.b/search?q=1": "search results page", "https://a.b/search": "", "https:///x": "no host",
        "http://[x": "unparseable url", "https://printer.local/": "local address", "https://accounts.google.com/x": "auth endpoint", "": "unsupported scheme ''",
        "http://172.16.0.1/": "private address", "http://172.32.0.1/": "", "http://01.2.3.4/": "", "http://[fc00::1]/": "private address", "http://10.1.2.3.4/": "", "http://a]b/": "unparseable url",
    }
    assert column(spark, urls.refusal_reason, list(cases)) == list(cases.values())


def test_url_columns_keep_nulls(spark):
    df = spark.createDataFrame([(None,), ("https://www.a.b/",)], "url string")
    got = df.select(urls.normalize_url("url").alias("n"), urls.refusal_reason("url").alias("r")).collect()
    assert [tuple(r) for r in got] == [(None, "unsupported scheme ''"), ("https://a.b/", "")]


def test_titles_and_texts(spark):
    t = lambda b: one(spark, text.note_title(F.lit(b), F.lit("stem")))
    assert [t("# Big Idea\n\nx"), t("\n  \nplain\n# later"), t(""), t("##\nx"), t("\r\n## A \r\nb")] == ["Big Idea", "plain", "stem", "stem", "A"]
    assert one(spark, text.searchable(F.lit(""), F.lit(None), F.lit(" body\n"))) == "body"
    assert one(spark, text.collapse_ws(F.lit(" a \t\n b\xa0c "))) == "a b c"
    assert one(spark, text.plain_words(F.lit("  The C++ Book! "))) == "the c book"
    assert one(spark, text.words(F.lit("Café-Déjà VU 2"))) == ["cafe", "deja", "vu", "2"]


def test_facets(spark):
    assert text.facets_of("unemployment Graphs, memes") == ("unemployment", {"chart", "meme"})
    assert text.facets_of("memes") == ("memes", {"meme"})
    assert text.facets_of("") == ("", set())
    rest, found = text.facets(F.lit("Photos of a chart!"))
    assert (one(spark, rest), one(spark, found)) == ("of a", ["chart", "photo"])


def test_phrases():
    assert text.phrases('deja-vu "Café" !!') == [["deja", "vu"], ["cafe"]]
    assert text.phrases("?! ") == []


def test_vectors(spark):
    a, b = F.lit([3.0, 4.0]), F.lit([0.0, 0.0])
    assert one(spark, V.l2(a, b)) == 5.0
    assert one(spark, V.unit(a)) == [0.6, 0.8]
    assert one(spark, V.unit(b)) is None
    assert one(spark, V.cosine(a, b)) is None
    assert one(spark, V.dot(a, F.lit([1.0, 1.0, 9.0]))) == 7.0
    assert one(spark, V.table_name(F.lit("text"), F.lit("bge-small/v1.5"))) == "vec_text__bge_small_v1_5"


def test_paths(spark):
    p = F.lit("/x/My.Dir/a.tar.PNG")
    assert (one(spark, paths.suffix(p)), one(spark, paths.stem(p)), one(spark, paths.name(p))) == (".png", "a.tar", "a.tar.PNG")
    hit = lambda path, *pats: one(spark, paths.matches_any(F.lit(path), pats))
    assert hit("/p/private/x.png", "/p/private") and not hit("/p/private2/x.png", "/p/private")
    assert hit("/p/a/secret-1.png", "*/secret-*") and not hit("/p/a.png", "*/secret-*") and not hit("/p/a.png")
    assert one(spark, paths.override_for(F.lit("/a/SCREENSHOTS/b.png"), {"Screenshots": 1, "b": 2})) == "Screenshots"


def test_exclusions(spark):
    names = {"W-2_2023.pdf": True, "1099.pdf": True, "tax.pdf": True, "taxi.pdf": False, "K1.pdf": True, "w23.pdf": False, "my statement.pdf": True, "x1040x.pdf": False}
    for n, want in names.items():
        assert one(spark, exclusions.name_excluded(F.lit(n))) is want, n
    assert one(spark, exclusions.name_excluded(F.lit("1099.pdf"), [])) is False
    assert one(spark, exclusions.content_marker(F.lit("x"), F.lit("Account Number, routing number"))) == "routing number"
    assert one(spark, exclusions.content_marker(F.lit(None).cast("string"), F.lit("is 123-45-6789"))) == exclusions.NUMBER_NAME
    assert one(spark, exclusions.content_marker(F.lit("x"), F.lit(None).cast("string"))) is None


def test_html(spark):
    page = "<title> A  &amp; B</title><body><script>no</script><p>one</p> two<style>x</style><noscript>no</noscript>"
    assert html.parse(page) == ("A & B", "one two")
    cases = {
        "": (None, ""),
        "<noscript>a<style>b</style>c</noscript>d": (None, "d"),
        "<template><template>x</template>y</template>z": (None, "z"),
        "<!-- <p>no</p> -->a < b, c&lt;d": (None, "a < b, c<d"),
        "<title>A</title>t<svg><title>B</title></svg>": ("AB", "t"),
        "<script>if (a<b) '</p>'</script>ok": (None, "ok"),
        "<p title='a>b'>t<b>u</b>": (None, "t u"),
        "yes<script>never closed <p>no": (None, "yes"),
        "<TITLE>x\n  y</TITLE><p>a\nb</p>": ("x y", "a\nb"),
    }
    for source, want in cases.items():
        assert html.parse(source) == want
    rows = [
        ("https://a.b/x", "text/html", 200, "w" * 300), ("https://a.b/x", "text/html", 200, "short"), ("https://a.b/x", "text/html", 403, None),
        ("https://a.b/x", "text/html", 404, None), ("https://a.b/x", "application/pdf", 200, "w" * 300), ("http://localhost/", "text/html", 200, "w" * 300),
        ("https://a.b/x", "text/html", 200, "Please ENABLE javascript " + "w" * 300), ("https://a.b/x", None, None, None), ("https://a.b/x", "application/json", 200, "{}"),
    ]
    df = spark.createDataFrame(rows, "u string, c string, k int, t string")
    got = [r.s for r in df.select(html.page_state(F.col("u"), F.col("c"), F.col("k"), F.col("t")).alias("s")).collect()]
    assert got == ["ok", "thin", "blocked", "dead", "skipped", "skipped", "blocked", "dead", "skipped"]
