import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftspark.llm import labels, languages, leaks, mixing

DOC = "doc_id long, text string, lang string, source string, item_id long, tokens string"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute_leaks(docs, items, run):
    index = {}
    for i, p in items:
        w = words(p)
        for k in range(len(w) - run + 1):
            index.setdefault(tuple(w[k : k + run]), set()).add(i)
    split = [(d, words(t)) for d, t in docs]
    return {(d, i) for d, w in split for k in range(len(w) - run + 1) for i in index.get(tuple(w[k : k + run]), ())}


def test_leaks_against_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(40))) for i in range(12)] + [(90, None), (91, ""), (92, "too short"), (93, None)]
    items.append((94, items[0][1]))
    docs = []
    for d in range(60):
        text = [rnd.choice(vocab) for _ in range(80)]
        if d % 3 == 0:
            p = items[d % 12][1].split()
            n = rnd.choice([8, 10, 15, 40])
            a = rnd.randrange(0, len(p) - n + 1)
            text[20:20] = [f"{w.upper()}," for w in p[a : a + n]]
        docs.append((d, " ".join(text)))
    docs += [(100, None), (101, ""), (102, "..."), (103, "x " * 50_000 + items[3][1]), docs[0]]
    ddf = spark.createDataFrame([(d, t, None, None, 5, "") for d, t in docs], DOC)
    idf = spark.createDataFrame([(i, "s", "p", t, "a") for i, t in items], "item_id long, suite string, prompt string, passage string, text string")
    want = brute_leaks(docs, [x for x in items if x[1]], 10)
    for block in (leaks.BLOCK_WORDS, 50):
        got = {(r.doc_id, r.item_id) for r in leaks.leaks(ddf, idf, block_words=block).where("longest >= 10").collect()}
        assert got == want
    assert leaks.leaked(ddf.where("false"), idf).count() == 0 and leaks.leaked(ddf, idf.where("false")).count() == 0


def test_reordered_passages_are_covered(spark):
    p = [f"p{i}" for i in range(40)]
    moved = p[30:] + ["z"] + p[10:18] + ["y"] + p[:9] + p[20:29]
    d = spark.createDataFrame([(1, " ".join(moved), None, None, 1, "")], DOC)
    i = spark.createDataFrame([(7, " ".join(p))], "item_id long, passage string")
    r = leaks.leaks(d, i).first()
    assert r.longest == 10 and r.covered == 36 and r.coverage == 0.9
    assert leaks.leaked(d, i, run=20, coverage=0.8).count() == 1 and leaks.leaked(d, i, run=20).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-1, 5), max_size=30), st.lists(st.integers(0, 5), max_size=20))
def test_tiles_do_not_overlap_and_are_greedy(doc, passage):
    doc, passage = np.array(doc, np.int64), np.array(passage, np.int64)
    got = leaks.tiles(doc, passage, 2)
    assert [n for *_, n in got] == sorted((n for *_, n in got), reverse=True)
    for side, x in ((0, passage), (1, doc)):
        used = [i for t in got for i in range(t[side], t[side] + t[2])]
        assert len(used) == len(set(used))
    for p, d, n in got:
        assert np.array_equal(passage[p : p + n], doc[d : d + n])
    best = max((n for a in range(len(passage)) for b in range(len(doc)) for n in [next((k for k in range(min(len(passage) - a, len(doc) - b) + 1) if k == min(len(passage) - a, len(doc) - b) or passage[a + k] != doc[b + k]), 0)]), default=0)
    assert (got[0][2] if got else 0) == (best if best >= 2 else 0)


def test_running_hashes():
    a = np.array([3, 1, 2, 3, 1, 2, 9, 3, 1, 2], np.int64)
    runs = leaks.Runs(a)
    for n in range(1, 11):
        h = runs(n)
        assert len(h) == 11 - n
        for i in range(len(h)):
            for j in range(len(h)):
                assert (h[i] == h[j]) == np.array_equal(a[i : i + n], a[j : j + n])
    assert len(runs(11)) == 0


def test_one_word_a_thousand_times():
    doc, passage = np.zeros(20_000, np.int64), np.zeros(900, np.int64)
    assert leaks.tiles(doc, passage, 5) == [(0, 0, 900)]
    assert leaks.tiles(np.tile([0, 0, 0, 0, 0, -1], 2000), passage, 5) == [(5 * k, 6 * k, 5) for k in range(180)]


needs_tokenizer = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer here")
TARGET = "source string, target_share double, max_repeats int, lang string"


def mix_docs():
    rnd = random.Random(6)
    rows = []
    for i in range(600):
        s = "big" if i % 3 == 0 else rnd.choice([" Small", "small", "SMALL ", "mid", "mid", "mid", "other", None, ""])
        rows.append((i, " ".join(["word"] * rnd.randint(1, 40)), rnd.choice(["en", "German", None, "xx"]), s, None, "x"))
    return rows + [(9000, None, "en", "big", None, None), (9001, "", "en", "big", None, None), (9002, " \n", "en", "mid", None, None)]


@needs_tokenizer
@pytest.mark.parametrize("buckets", [4096, 3])
def test_mix(spark, buckets):
    rows = mix_docs()
    docs = spark.createDataFrame(rows, DOC)
    targets = spark.createDataFrame([("big", 0.3, 2, ""), ("small", 0.4, 1, ""), ("Mid ", 0.2, 1, ""), ("none", 0.1, 5, "")], TARGET)
    shares = {r.source: r for r in mixing.shares(docs, targets, buckets=buckets).collect()}
    enc = mixing.encoder(open(mixing.TOKENIZER, "rb").read())
    n = {r[0]: len(enc.encode_ordinary(r[1])) if r[1] and r[1].strip() else 0 for r in rows}
    own = {s: sum(n[r[0]] for r in rows if (r[3] or "").strip().lower() == s) for s in ("big", "small", "mid", "none")}
    total = sum(n[r[0]] for r in rows if (r[3] or "").strip())
    repeats = {"big": 2, "small": 1, "mid": 1, "none": 5}
    share = {"big": 0.3, "small": 0.4, "mid": 0.2, "none": 0.1}
    for s, r in shares.items():
        assert r.available == own[s] and r.short == (own[s] * repeats[s] < share[s] * total)
    assert {r.source for r in mixing.short_sources(docs, targets).collect()} == {s for s in share if own[s] * repeats[s] < share[s] * total}
    assert shares["none"].short and shares["small"].short
    got = mixing.mix(docs, targets, buckets=buckets).collect()
    assert len({r.doc_id for r in got}) == len(got)
    for s in own:
        mine = [r for r in got if r.source == s]
        assert all(1 <= r.copies <= repeats[s] and r.tokens == n[r.doc_id] for r in mine)
        assert shares[s].reached == sum(r.tokens * r.copies for r in mine) <= own[s] * repeats[s]
    assert abs(sum(r.reached for r in shares.values()) - min(total, sum(own[s] * repeats[s] for s in own))) <= 40 * 4 * 4
    again = mixing.mix(docs.orderBy("text"), targets, buckets=buckets).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


@needs_tokenizer
def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], DOC)
    targets = spark.createDataFrame([("a", 1.0, 2, "")], TARGET)
    assert mixing.mix(docs, targets).count() == 0 and mixing.short_sources(docs, targets).count() == 0
    assert mixing.shares(docs, targets).first().reached == 0


def test_short_sources_come_from_the_tree():
    root, got = mixing.tree([("a", "en", 10.0), ("a", "de", 30.0), ("b", "en", 200.0)], [("a", 0.5, 2), ("b", 0.4, 1), ("c", 0.1, 9)], {"a": "x", "b": "x"})
    mixing.propagate(root, 240.0)
    assert got["a", "en"].own == pytest.approx(30) and got["a", "en"].short == pytest.approx(10) and got["a", "de"].short == pytest.approx(30)
    assert got["b", "en"].short == 0 and got["c", "und"].short == pytest.approx(24)


def test_a_leaf_of_a_third_of_all_rows(spark):
    """It is cut at bucket totals; no task sorts it."""
    counted = spark.range(3000).selectExpr("id as doc_id", "'en' as lang", "case when id % 3 = 0 then 'hot' else concat('s', id % 40) end as source", "id % 7 as tokens")
    p = mixing.plan(counted, spark.createDataFrame([("hot", 0.5, 1, ""), ("s1", 0.5, 4, "")], TARGET))
    got = mixing._marked(counted, p, 1, 16).collect()
    for s in ("hot", "s1"):
        assert p.leaves[s, "en"].given - 7 <= sum(r.tokens * r.copies for r in got if r.source == s) <= p.leaves[s, "en"].given + 1


def test_siblings_take_over_before_ancestors():
    leaves = [("a", "en", 10.0), ("b", "en", 1000.0), ("c", "en", 1000.0)]
    root, got = mixing.tree(leaves, [("a", 0.5, 1), ("b", 0.2, 1), ("c", 0.3, 1)], {"a": "x", "b": "x", "c": "y"})
    assert mixing.allot(root, 100.0) == 0
    assert [round(got[k, "en"].given) for k in "abc"] == [10, 60, 30]
    assert mixing.allot(root, 5000.0) == pytest.approx(5000 - 2010)
    assert sum(n.given for n in got.values()) == pytest.approx(2010)


def test_labels(spark):
    want = {"EN": "en", "en-US": "en", "English": "en", "eng": "en", "Deutsch": "de", "pt_BR": "pt", "und": None, "unknown": None, "": None, None: None, "sv": "sv", " Dutch ": "nl"}
    assert {k: labels.label_code(k) for k in want} == want
    df = spark.createDataFrame([(k,) for k in want], "lang string")
    assert {r.lang: r.c for r in df.select("lang", labels.label_expr("lang").alias("c")).collect()} == want


SENTENCES = {
    "en": "the old gardener opened the narrow door and put the wooden box behind the house before it was dark".split(),
    "de": "der alte gärtner öffnete die schmale tür und stellte die hölzerne kiste hinter das haus bevor es dunkel wurde".split(),
    "fr": "le vieux jardinier ouvre la porte étroite et pose une boîte en bois derrière la maison avant que la nuit ne tombe".split(),
    "nl": "de oude tuinman opent de smalle deur en zet de houten kist achter het huis voordat het donker wordt".split(),
}


def line(lang, rnd, n=14):
    w = SENTENCES[lang]
    a = rnd.randrange(len(w))
    return " ".join((w * 3)[a : a + n]).capitalize() + "."


def test_languages(spark):
    rnd = random.Random(8)
    rows, truth = [], {}
    for i in range(240):
        lang = list(SENTENCES)[i % 4]
        text = "\n".join(line(lang, rnd) for _ in range(4))
        label, langs = rnd.choice([lang, lang.upper()]), {lang}
        if i % 15 == 0:
            label = rnd.choice([None, "", "und", "sv", "de" if lang != "de" else "en"])
        if i % 20 == 3:
            second = "fr" if lang != "fr" else "en"
            text += "\n\n" + line(second, rnd)
            langs.add(second)
        rows.append((i, text, label, None, None, None))
        if labels.label_code(label) != lang or len(langs) > 1:
            truth[i] = langs
    rows += [(900, None, None, None, None, None), (901, "", "en", None, None, None), (902, "123 456\n78", None, None, None, None), (903, line("de", rnd) * 3000, "en", None, None, None)]
    truth[903] = {"de"}
    docs = spark.createDataFrame(rows, DOC)
    got = {}
    for r in languages.mislabelled(docs, size=40).collect():
        got.setdefault(r.doc_id, set()).add(r.lang)
    assert got == truth
    seg = {(r.doc_id, r.first_line, r.last_line, r.lang) for r in languages.segments(docs, size=40).collect()}
    assert (3, 0, 3, "nl") in seg and (3, 5, 5, "fr") in seg
    assert languages.mislabelled(docs.where("false")).count() == 0
    assert languages.mislabelled(docs.where("doc_id >= 900"), languages=("en", "de")).count() >= 0
