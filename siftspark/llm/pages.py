"""Main text of web pages, by consensus on line paths.

Page text comes line by line; a line's path is its text with site name, numbers, separators and inner capitals
generalised. Every text votes for its paths in Spark, once for each host that holds it and once for the web: a
path is furniture of a host if a large share of the host's texts has it, and furniture of the web if a share of
all hosts or texts has it. A page without a paragraph, fixed marks of messages aside, has no vote, and a
page's only paragraph has none from its own page. Opening words ("Tags:",
"Filed under") and list headers are voted on in the same way. Pages are then read again with the winning paths:
runs of menu words, separated lists, linked lists under a winning header and all that follows the last
paragraph go too. Global winners are bounded by their share; host winners travel as hashes.

Defined cases: null, empty and blank bodies have no lines; lines are those between line feeds, numbered from 0;
a first line in lower case that is no message is the user's own comment; lines that a residue model calls messages are no furniture;
a url without host votes under the empty host; copies of a text, whatever their id, url, comment or blank lines,
vote once a host, and for the web under their first host only; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.llm.buckets import sized
from siftspark.session import checkpoint

WEB_SHARE = 0.04  # of hosts or pages: furniture of the web
HOST_SHARE = 0.3  # of a host's pages: furniture of the host
LEAST = 3  # votes at least
FIRM = 0.2  # share of a first word's lines that go on with the same second word
HEADER = 0.5  # share of a path's lines that a list follows
KEYS_SENT = 2_000_000  # keys of all host models up to which they are broadcast
SALTS = 64
_SEP = re.compile(r"\s*[·|»>/•]\s+|\s{2,}")
_DIGITS = re.compile(r"\d+")
_INNER = re.compile(r"(?<=\S )[A-Z][a-zà-ÿ]+")
_BULLET = re.compile(r"^(?:[›•‣▸*–-]|\d{1,3}\.)\s+")
_CAPS2 = re.compile(r"[A-Z][a-z]+ [A-Z][a-z]+")
_WORD1 = re.compile(r"[A-Z][^\W\d_]+")
_END = re.compile(r"[.!?…][\"'”’)]*$")
TITLE = 3  # spaces of a title, as against a short heading
PARAGRAPH = 15  # spaces of a line that shows a page has content
DOUBT = -3.0  # odds down to which a short line of a message page is part of the message
LONG = 12  # words from which an unfinished line is a paragraph that was cut


def host_of(url: str | None) -> str:
    m = re.match(r"\s*[a-zA-Z]+://(?:[^/@]*@)?([^/:?#\s]+)", url or "")
    host = m.group(1).lower() if m else ""
    for sub in ("www.", "m.", "blog."):
        host = host.removeprefix(sub)
    return host


def site_letters(host: str) -> str:
    return host.split(".")[0].replace("-", "")


def path_of(line: str, letters: str) -> str:
    """The generalised path of a stripped line."""

    def site(m: re.Match) -> str:
        low = m.group(0).replace(" ", "").lower()
        return "\x01" if len(low) >= 6 and letters.startswith(low) else m.group(0)

    line = _CAPS2.sub(site, line)
    line = _SEP.sub(" \x02 ", line)
    line = _DIGITS.sub("#", line)
    return _INNER.sub("W", line)


def key(text: str) -> int:
    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def is_sentence(line: str) -> bool:
    n = line.count(" ") + 1
    return n >= LONG or (n >= 5 and bool(_END.search(line)))


def is_nav(line: str) -> bool:
    """A list of short chunks set apart by separators."""
    parts = _SEP.split(line)
    return len(parts) >= 3 and all(p.count(" ") <= 2 and not _END.search(p) for p in parts)


@dataclass
class Web:
    """Winning paths of the whole web; each kind holds at most 1 / WEB_SHARE x lines of a page."""

    paths: set[int] = field(default_factory=set)
    openings: set[int] = field(default_factory=set)
    headers: set[int] = field(default_factory=set)


def openings(path: str) -> list[str]:
    """Opening of a path: the first word with its colon, else the first two words."""
    words = path.split(" ", 2)
    out = [words[0]] if words[0].endswith(":") else []
    symbol = not any(c.isalnum() or c == "#" for c in words[0])
    if len(words) > 1 and (symbol or not words[1].startswith("W")) and words[0] != "#.":
        out.append(" ".join(words[:2]))
    return out


def _votes(batches: Iterator[pa.RecordBatch], marks: re.Pattern | None) -> Iterator[pa.RecordBatch]:
    """host, kind (p path, o opening, f first word, l path before a list), key, first, once: one row per text and path."""
    for b in batches:
        out = []
        for host, content, once in zip(*(b.column(k).to_pylist() for k in range(3))):
            letters = site_letters(host)
            lines = [s for x in content.split("\n") if (s := x.strip())]
            paths = [path_of(x, letters) for x in lines]
            paragraphs = {p for x, p in zip(lines, paths) if x.count(" ") >= PARAGRAPH and not (marks and marks.search(x))}
            if not paragraphs:
                continue  # a page of messages or nothing has no vote
            seen: set[tuple[str, int, int]] = set()
            for i, (line, p) in enumerate(zip(lines, paths)):
                if paragraphs == {p}:
                    continue  # may be all the page says
                k = key(p)
                seen.add(("p", k, 0))
                if i + 1 < len(lines) and _BULLET.match(lines[i + 1]) and not _BULLET.match(line):
                    seen.add(("l", k, 0))
                if not is_sentence(line):
                    for o in openings(p):
                        seen.add(("o", key(o), key(p.split(" ", 1)[0])))
                    seen.add(("f", key(p.split(" ", 1)[0]), 0))
            out += [(host, *s, once) for s in seen]
        cols = list(zip(*out)) if out else [[]] * 5
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["host", "kind", "key", "first", "once"])


def link_rows(items: DataFrame) -> DataFrame:
    """id, url, body of link items with a body."""
    return items.where((F.col("kind") == "link") & F.col("body").isNotNull() & F.col("id").isNotNull()).select(F.col("id").cast("string"), F.col("url").cast("string"), F.col("body").cast("string"))


def link_pages(items: DataFrame) -> DataFrame:
    """link_rows, each once."""
    return link_rows(items).distinct()


def _host() -> Column:
    """host_of as a column."""
    host = F.regexp_extract(F.lower("url"), r"^\s*[a-z]+://(?:[^/@]*@)?([^/:?#\s]+)", 1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(host, F.lit("")), r"^www\.", ""), r"^m\.", ""), r"^blog\.", "")


def contents(rows: DataFrame) -> DataFrame:
    """host, content, h: stripped lines of a page without blank ones and the user's comment, and their hash."""
    lines = F.filter(F.transform(F.split("body", "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    rows = rows.select(_host().alias("host"), lines.alias("lines"))
    comment = F.coalesce(F.get("lines", F.lit(0)).rlike(r"^\p{IsLowercase}"), F.lit(False))
    content = F.array_join(F.when(comment, F.expr("slice(lines, 2, size(lines))")).otherwise(F.col("lines")), "\n")
    return rows.select("host", content.alias("content")).withColumn("h", F.xxhash64("content"))


def consensus(rows: DataFrame, marks: re.Pattern | None = None) -> tuple[Web, DataFrame]:
    """(web winners, host winners: host, keys); marks are found in messages."""
    texts = contents(rows)
    held = checkpoint(texts.select("host", "h").distinct())
    shared = held.groupBy("h").agg(F.min("host").alias("head"), F.count("*").alias("n")).where("n > 1").select("h", "head")
    shared = sized(checkpoint(shared))  # texts of several hosts
    once = F.coalesce(F.col("host") == F.col("head"), F.lit(True)).cast("int").alias("once")
    total = checkpoint(held.join(shared, "h", "left").select("host", once).groupBy("host").agg(F.count("*").alias("pages"), F.sum("once").alias("once")))
    hosts, all_pages = total.agg(F.count_if(F.col("once") > 0), F.coalesce(F.sum("once"), F.lit(0))).first()
    texts = texts.distinct().join(shared, "h", "left").select("host", "content", once)
    votes = texts.mapInArrow(lambda batches: _votes(batches, marks), "host string, kind string, key long, first long, once int")
    by_host = checkpoint(votes.groupBy("host", "kind", "key", "first").agg(F.count("*").alias("n"), F.sum("once").alias("once")))
    web = by_host.groupBy("kind", "key", "first").agg(F.count_if(F.col("once") > 0).alias("hosts"), F.sum("once").alias("n"))
    common = (F.col("hosts") >= max(LEAST, WEB_SHARE * hosts)) | ((F.col("n") >= max(LEAST + 2, WEB_SHARE * all_pages)) & (F.col("hosts") >= LEAST))
    rows = checkpoint(web.where(F.col("kind").isin("p", "l", "o", "f") & common)).collect()  # bounded by the share
    pathn = {r.key: r.n for r in rows if r.kind == "p"}
    firsts = {r.key: r.n for r in rows if r.kind == "f"}
    model = Web(
        paths=set(pathn),
        openings={r.key for r in rows if r.kind == "o" and (r.key == r.first or r.n >= FIRM * firsts.get(r.first, 0))},
        headers={r.key for r in rows if r.kind == "l" and r.n >= HEADER * pathn.get(r.key, r.n)},
    )
    own = by_host.where("kind = 'p'").join(total.where(F.col("pages") >= LEAST).select("host", "pages"), "host")
    own = own.where((F.col("n") >= LEAST) & (F.col("n") >= HOST_SHARE * F.col("pages")))
    return model, checkpoint(own.groupBy("host").agg(F.collect_list("key").alias("keys")))  # at most lines of a page / HOST_SHARE keys


def with_host(pages: DataFrame, own: DataFrame) -> DataFrame:
    """id, host, body, keys: pages with the winners of their host; a busy host is spread over salts."""
    rows = pages.withColumn("host", _host())
    if own.agg(F.coalesce(F.sum(F.size("keys") + 1), F.lit(0))).first()[0] <= KEYS_SENT:
        return rows.join(F.broadcast(own), "host", "left").select("id", "host", "body", "keys")
    spread = own.withColumn("salt", F.explode(F.array([F.lit(i) for i in range(SALTS)])))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return rows.join(spread, ["host", "salt"], "left").select("id", "host", "body", "keys")


COMMENT, FURNITURE, HEADING, TEXT, BLANK, OTHER, MESSAGE = "comment", "furniture", "heading", "text", "blank", "other", "message"


def label_lines(body: str, host: str, web: Web, own: set[int], odds: Callable[[str], float] | None = None) -> list[str]:
    """A label for every line of a page; odds, if given, is above 0 for a line that stands in place of content."""
    raw = body.split("\n")
    at = [i for i, x in enumerate(raw) if x.strip()]
    lines = [raw[i].strip() for i in at]
    letters = site_letters(host)
    n = len(lines)
    got = [OTHER] * n
    keys = [key(path_of(x, letters)) for x in lines]
    for i, x in enumerate(lines):
        if i == 0 and at[0] == 0 and x[0].islower() and not (odds and odds(x) > 0):
            got[i] = COMMENT
        elif keys[i] in web.paths or keys[i] in own:
            got[i] = FURNITURE
        elif is_sentence(x) and not _BULLET.match(x) and not is_nav(x):
            got[i] = TEXT
        elif is_nav(x) or any(key(o) in web.openings for o in openings(path_of(x, letters))):
            got[i] = FURNITURE
    # menu words next to furniture of one word
    single = [bool(_WORD1.fullmatch(x)) for x in lines]
    for order in (range(1, n), range(n - 2, -1, -1)):
        step = -1 if order == range(1, n) else 1
        for i in order:
            if single[i] and got[i] == OTHER and got[i + step] == FURNITURE and single[i + step]:
                got[i] = FURNITURE
    # lists under a winning header
    i = 0
    while i < n:
        if got[i] == FURNITURE and keys[i] in web.headers:
            j = i + 1
            while j < n and (_BULLET.match(lines[j]) or got[j] == OTHER and not (odds and odds(lines[j]) > 0)):
                j += 1
            end = j
            if j < n and got[j] == TEXT and not (odds and odds(lines[j]) > 0):  # a title and a short heading right before a paragraph are the text's own
                while end > max(i + 1, j - 2) and not _BULLET.match(lines[end - 1]):
                    end -= 1
                    if lines[end].count(" ") >= TITLE:
                        break
            got[i + 1 : end] = [FURNITURE] * (end - i - 1)
            i = max(j, i + 1)
        else:
            i += 1
    text = [i for i in range(n) if got[i] == TEXT]
    if odds and all(odds(lines[i]) > 0 for i in text):  # nothing but messages
        for i in range(n):
            if got[i] in (TEXT, OTHER) and odds(lines[i]) > DOUBT:
                got[i] = MESSAGE
    elif text:
        for i in range(n):
            if got[i] == OTHER:
                got[i] = FURNITURE if i > text[-1] or (single[i] and i < text[0]) else HEADING
    out = [BLANK] * len(raw)
    for i, label in zip(at, got):
        out[i] = label
    return out
