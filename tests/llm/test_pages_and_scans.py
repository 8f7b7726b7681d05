import random

import pytest
from pyspark.sql import functions as F

from siftspark.llm import pages, perceptron, residue, scans

ITEM = "id string, kind string, url string, title string, body string, host string, keys string"
RND = random.Random(12)
SYLLABLES = "lan tern har bour gar den val ley ket tle win dow bas ket lad der mir ror cel lar nee dle bri dge mea dow col umn tic ket wag on".split()
NOUNS = sorted({"".join(RND.choice(SYLLABLES) for _ in range(3)) for _ in range(400)})
VERBS = sorted({"".join(RND.choice(SYLLABLES) for _ in range(2)) + "ed" for _ in range(80)})


def sentence(rnd=RND):
    return f"The {rnd.choice(NOUNS)} beside the {rnd.choice(NOUNS)} was quietly {rnd.choice(VERBS)} after lunch, and nobody near the {rnd.choice(NOUNS)} ever {rnd.choice(VERBS)} the other {rnd.choice(NOUNS)} before noon."


def page(site, rnd, text, comment=None):
    head = ["Skip to content", "Home", "Garden", "Tower", "Log in"]
    tail = ["Related articles", "› How the kettle was mended", "Old bridge of Selby", f"© {rnd.randint(2000, 2024)} {site}. All rights reserved.", "Imprint · Privacy · Terms · Contact"]
    lines = ([comment] if comment else []) + head + text + tail
    first = len(lines) - len(tail)
    bad = set(range(bool(comment), bool(comment) + len(head))) | set(range(first, len(lines)))
    return "\n".join(lines), bad


def site_items():
    rnd = random.Random(5)
    rows, furniture, errors = [], {}, set()
    for h in range(14):
        site, host = f"Site{'abcdefghijklmnop'[h]} Review", f"site{'abcdefghijklmnop'[h]}review{h}.example"
        for k in range(1 if h > 8 else 8):
            i = f"{h}-{k}"
            odd = lambda: "".join(rnd.choice("abcdefgh") for _ in range(7))
            text = [f"Garden {odd()} of the old ferry", *[sentence(rnd) for _ in range(3)], f"The {odd()}", *[sentence(rnd) for _ in range(2)]]
            if k == 3:
                text = [rnd.choice(["Page not found", "404 Not Found"]), "Error code: 404", rnd.choice(["Try again in a few minutes.", "Request id 7a9"])]
                errors.add(i)
            if k == 5:
                text = ["{{ title }}", "lorem ipsum dolor sit amet", "Hello undefined, your order of null is ready"]
                errors.add(i)
            if k == 6:
                text.insert(2, f"A 404 page can be charming, as the {rnd.choice(NOUNS)} near the {rnd.choice(NOUNS)} showed to everyone who visited.")
            body, bad = page(site, rnd, text, "read later" if k == 2 else None)
            rows.append((i, "link", f"https://www.{host}/x/{k}", "t", body, None, None))
            furniture[i] = bad
    rows += [("short", "link", "https://lone.example/", None, sentence(rnd), None, None), ("null", "link", "https://lone.example/", None, None, None, None), ("blank", "link", None, None, " \n ", None, None)]
    rows += [("bare", "link", "https://lone.example/", None, "read later", None, None), ("p1", "pdf", None, None, "Page not found\nError code: 404", None, None), ("p2", "pdf", None, None, " ".join(sentence(rnd) for _ in range(4)), None, None)]
    rows += [("note", "note", None, None, "404 Not Found", None, None), rows[0], ("long", "link", "https://long.example/", None, "\n".join(sentence(rnd) for _ in range(3000)), None, None)]
    errors.add("p1")
    return rows, furniture, errors


def test_main_text_and_residue(spark):
    rows, furniture, errors = site_items()
    items = spark.createDataFrame(rows, ITEM)
    got = {}
    for r in residue.furniture(items).collect():
        got.setdefault(r.id, set()).add(r.line_no)
    assert got == furniture
    assert {r.id for r in residue.residues(items).collect()} == errors
    text = {r.id: r.text for r in residue.main_text(items).collect()}
    assert text["0-0"].startswith("Garden ") and text["0-0"].count("\n") == 6 and "Imprint" not in text["0-0"] and text["short"] == next(r[4] for r in rows if r[0] == "short")
    assert {r.id for r in residue.kept(items).collect()} == {r[0] for r in rows} - errors


def test_pages_of_nothing(spark):
    items = spark.createDataFrame([], ITEM)
    assert residue.furniture(items).count() == 0 and residue.residues(items).count() == 0 and residue.main_text(items).count() == 0


def test_busy_hosts_are_spread(spark, monkeypatch):
    rows, furniture, _ = site_items()
    monkeypatch.setattr(pages, "KEYS_SENT", -1)
    got = {}
    for r in residue.furniture(spark.createDataFrame(rows, ITEM)).collect():
        got.setdefault(r.id, set()).add(r.line_no)
    assert got == furniture


def test_hosts_and_paths():
    assert pages.host_of("https://user@WWW.a-b.example:8080/x") == "a-b.example" and pages.host_of(None) == "" and pages.host_of("nonsense") == ""
    assert pages.path_of("© 2019 Old Ferry. All rights reserved.", "oldferry12") == "© # \x01. W rights reserved."
    assert pages.is_nav("Home | Garden | Log in") and not pages.is_nav("one | two") and not pages.is_nav("A plain line")


def test_residue_model_without_trusted_records():
    m = residue.fit([(False, [["a", "plain", "line"]]), (False, [["another"]]), (False, [])])
    assert not m.record(["404 not found"]) and not m.record([])
    assert residue.trusted(["404 Not Found"]) and not residue.trusted(["JavaScript basics for new readers"]) and not residue.trusted(["503 steps up the tower"] * 11)


def test_no_passage_of_residue_is_clearly_content():
    m = residue.Model({"error": 5.0, "garden": -4.0, "plain": -2.0}, -1.0)
    assert m.record(["error", "plain"]) and not m.record(["error error error", "garden"]) and not m.record(["plain"])
    assert not residue.Model({"error": 1.0}, -2.0).record(["error"])  # the prior counts


def test_long_residue_is_found_too(spark):
    """No length makes a record content; a first line in lower case is a comment unless it is filler."""
    rows, _, errors = site_items()
    rnd = random.Random(4)
    latin = "lorem ipsum dolor sit amet massa erat urna nulla diam sem quam velit".split()
    filler = lambda n: "\n".join(" ".join(rnd.choices(latin, k=14)).capitalize() + "." for _ in range(n))
    rows += [(f"f{k}", "pdf", None, None, "Lorem ipsum dolor sit amet.\n" + filler(k), None, None) for k in range(12)] + [("long filler", "pdf", None, None, filler(80), None, None)]
    rows += [("low", "link", rows[0][2], None, "lorem ipsum dolor sit amet massa", None, None), ("bare", "link", rows[0][2], None, "read this later", None, None)]
    got = {r.id for r in residue.residues(spark.createDataFrame(rows, ITEM)).collect()}
    assert got >= errors | {"long filler", "low"} | {f"f{k}" for k in range(12)} and "bare" not in got


def test_every_body_of_an_id_keeps_its_own_lines(spark):
    rows, _, _ = site_items()
    twice = [("twice", *next(r for r in rows if r[0] == i)[1:]) for i in ("0-0", "1-1")]
    items = spark.createDataFrame(rows + twice, ITEM)
    text = {}
    for r in residue.main_text(items).collect():
        text.setdefault(r.id, set()).add(r.text)
    assert text["twice"] == text["0-0"] | text["1-1"]


def test_alignment():
    assert perceptron.align("laclder", "ladder") == [None, None, "d", "", None, None, None]
    assert perceptron.align("wnnkled", "wrinkled")[1] == "ri" and perceptron.align("same", "same") == [None] * 4
    for seen, true in [("a", ""), ("", "a"), ("ab", "axb"), ("rnoon", "moon"), ("x", "yyy")]:
        ops = perceptron.align(seen, true)
        if seen:
            assert "".join(c if op is None else op for c, op in zip(seen, ops)) == true


VOCAB = {*NOUNS, *VERBS, *sentence(random.Random(0)).replace(",", "").replace(".", "").lower().split()}
CONFUSED = [("o", "0"), ("i", "!"), ("d", "cl"), ("m", "rn"), ("e", "c"), ("t", "+"), ("h", "b"), ("u", "ii"), ("n", "ri")]


def wrap(text, width, rnd, break_words):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) + bool(line) <= width:
            line += (" " if line else "") + w
            continue
        room = width - len(line) - 2
        if break_words and w.isalpha() and len(w) >= 6 and 2 <= room <= len(w) - 2 and rnd.random() < 0.6:
            out.append((f"{line} {w[:room]}-", True))
            line = w[room:]
        else:
            out.append((line, False))
            line = w
    return out + [(line, False)]


def scanned(rnd, pages_n, title):
    lines, faults = [], set()
    for p in range(pages_n):
        body = wrap(" ".join(sentence(rnd) for _ in range(4)), 50, rnd, True)
        faults.add((len(lines), "furniture"))
        lines.append(title)
        for k, (x, broken) in enumerate(body):
            words = x.split()
            if rnd.random() < 0.6 and len(words) > 3:
                j = rnd.randrange(1, len(words) - 1)
                a, b = rnd.choice(CONFUSED)
                if words[j].isalpha() and a in words[j][1:] and len(words[j]) >= 5:
                    at = words[j].index(a, 1)
                    words[j] = words[j][:at] + b + words[j][at + 1 :]
                    faults.add((len(lines), "misread"))
            if broken:
                faults.add((len(lines), "broken_word"))
            lines.append(" ".join(words))
        faults.add((len(lines), "furniture"))
        lines.append(f"- {p + 11} -")
    return "\n".join(lines), faults


def test_scans(spark):
    rnd = random.Random(21)
    items, ocr, want = [], [], {}
    for i in range(60):
        items.append((f"n{i}", "note", None, "t", " ".join(sentence(rnd) for _ in range(8)), None, None))
    for i in range(60):
        text, faults = scanned(rnd, 2, f"Chapter {i % 9}: Harbour")
        items.append((f"s{i}", "pdf", None, f"scan{i}", text, None, None))
        want.update({("items", f"s{i}", "", *f): 1 for f in faults})
    for i in range(40):
        text, faults = scanned(rnd, 1, "THE OLD HARBOUR AND THE LANTERN")
        ocr.append((f"o{i}", "m", text, None))
        want.update({("ocr_text", f"o{i}", "m", *f): 1 for f in faults})
    ocr += [("screen", "m", "File  Edit  View\nOK\nThe lantern beside the har\n12:45", None), ("null", "m", None, None), ("blank", "m", " ", None), (None, "m", "x", None), ocr[0], ("long", "m", "w" * 200_000, None)]
    items += [("clean", "pdf", None, "t", sentence(rnd) * 2, None, None), ("empty", "pdf", None, None, "", None, None), ("nobody", "pdf", None, None, None, None, None)]
    idf = spark.createDataFrame(items, ITEM)
    odf = spark.createDataFrame(ocr, "image_id string, model string, text string, title string")
    got = {tuple(r) for r in scans.faults(idf, odf).collect()}
    exact = {k for k in want if k[4] != "misread"}
    assert {g for g in got if g[4] != "misread"} == exact
    mine, true = {g for g in got if g[4] == "misread"}, {k for k in want if k[4] == "misread"}
    assert len(mine & true) >= 0.9 * len(true) and len(mine - true) <= 0.02 * len(true)
    text = {r.rec_id: r.text for r in scans.repaired(idf, odf).collect()}
    assert set(text) == {f"s{i}" for i in range(60)} | {f"o{i}" for i in range(40)}
    unknown = [w for t in text.values() for w in t.replace(",", "").replace(".", "").split() if w.lower() not in VOCAB]
    assert len(unknown) <= 0.12 * len(true)


def test_an_edit_needs_the_editors_leave():
    """It must score as high as all but a few of the edits trained on, even if its result is a known word."""
    e = perceptron.Editor().train(PAIRS + [(w, w) for w in ("modern", "barn", "corn", "turn", "burn")] * 3)
    scores = sorted(e.against_keeping(s, perceptron.align(s, t)) for s, t in PAIRS)
    assert e.margin == min(0.0, scores[int(perceptron.MISSED * len(scores))])
    assert scans.Reader(frozenset({"chamber"}), frozenset(), e).correct("charnber") == ("chamber", [3, 4])
    e.margin = 1e9
    assert scans.Reader(frozenset({"chamber"}), frozenset(), e).correct("charnber") is None


PAIRS = [(w.replace("m", "rn"), w) for w in ("market", "lemon", "harm", "number", "lamp", "former", "camera", "timber", "amber", "remote")]


def test_more_edits_in_longer_words():
    e = perceptron.Editor().train(PAIRS * 2)
    word = "harmonylantemlemonskynumberofcamerasandlampshade"
    seen = word.replace("m", "rn")
    assert len(seen) > 40 and scans.Reader(frozenset({word}), frozenset(), e).correct(seen)[0] == word


def test_one_long_line_hides_no_faults():
    lines = ["the lantern beside the har-", "bour was counted on the final", "day and slowly painted again", "while nobody looked at the old", "storehouse"]
    assert scans.wrapped("\n".join(lines[:-1] + ["storehouse beside the pier of the village"])) and scans.wrapped("\n".join([*lines, "w" * 40, "x" * 400]))
    assert not scans.wrapped("\n".join(["w" * 300] * 5 + lines))


def test_headers_that_are_too_many_to_send(spark, monkeypatch):
    rnd = random.Random(2)
    items = [(f"n{i}", "note", None, "t", " ".join(sentence(rnd) for _ in range(8)), None, None) for i in range(30)]
    ocr = [(f"o{i}", "m", scanned(rnd, 1, "Chapter 2: Harbour")[0], None) for i in range(20)]
    idf, odf = spark.createDataFrame(items, ITEM), spark.createDataFrame(ocr, "image_id string, model string, text string, title string")
    sent = {tuple(r) for r in scans.faults(idf, odf).collect()}
    monkeypatch.setattr(scans, "HEADERS_SENT", -1)
    assert sent and {tuple(r) for r in scans.faults(idf, odf).collect()} == sent


def test_scans_of_nothing(spark):
    idf = spark.createDataFrame([], ITEM)
    odf = spark.createDataFrame([], "image_id string, model string, text string")
    assert scans.faults(idf, odf).count() == 0 and scans.repaired(idf, odf).count() == 0


@pytest.mark.parametrize("line,want", [("- 66 -", True), ("Page lO", True), ("[58]", True), ("p. 30", True), ("xii", True), ("63 / 120", True), ("12", True), ("i", True), ("labels.", False), ("The end", False), ("page turner", False)])
def test_page_numbers(line, want):
    assert scans.is_number(line) is want


def test_screens_are_no_scans():
    assert not scans.wrapped("File  Edit  View\nOK\nSome lantern photographs show the lec\nSave\nA slender locker stood between the")
    assert not scans.wrapped(None) and not scans.wrapped("") and not scans.wrapped("one line only")


def test_copies_of_a_page_vote_once(spark):
    rows, furniture, _ = site_items()
    rnd = random.Random(8)
    body, bad = page("Lone Review", rnd, [f"Mirror {rnd.choice(NOUNS)}", *[sentence(rnd) for _ in range(3)]])
    copies = [(f"c{k}", "link", f"https://lonereview.example/{k}", "t", ("keep this\n" if k % 2 else "") + body, None, None) for k in range(40)]
    copies += [(f"m{k}", "link", f"https://mirror{k}.example/", "t", body, None, None) for k in range(9)]
    furniture |= {r[0]: {n + r[4].startswith("keep") for n in bad} for r in copies if r[0][0] == "c"}
    got = {}
    for r in residue.furniture(spark.createDataFrame(rows + copies, ITEM)).collect():
        got.setdefault(r.id, set()).add(r.line_no)
    assert all(got.pop(f"m{k}") <= bad for k in range(9)) and got == furniture


def test_messages_do_not_vote(spark):
    rows, _, errors = site_items()
    rnd = random.Random(9)
    message = "404 Not Found: the page you asked for is not here, so check the address for errors or try again in a few minutes please."
    rows += [(f"e{k}", "link", f"https://www.{rows[0][2].split('/')[2][4:]}/e{k}", "t", page(f"Site{'abcdefgh'[k]} Review", rnd, [message, f"Request id {rnd.choice(NOUNS)}"])[0], None, None) for k in range(8)]
    got = {r.id for r in residue.residues(spark.createDataFrame(rows, ITEM)).collect()}
    assert got == errors | {f"e{k}" for k in range(8)}


def test_sample_takes_an_id_once(spark):
    ids = [r[0] for r in spark.range(40).selectExpr("cast(id as string) id").orderBy(F.xxhash64("id")).collect()]
    rows = [(i, "pdf", None, None, f"text {i}", None, None) for i in ids] + [(ids[0], "pdf", None, None, f"text {ids[0]}", None, None)] * 30
    got = residue.sample(spark.createDataFrame(rows, ITEM), pages.Web(), 20)
    assert sorted(t[0] for _, t in got) == sorted(residue.tokens(f"text {i}") for i in ids[:20])
    assert residue.sample(spark.createDataFrame([], ITEM), pages.Web(), 20) == []
