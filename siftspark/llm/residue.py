"""Template residue and error pages: positive-unlabelled naive Bayes by expectation maximisation.

Passages are the lines of a record without site furniture, page numbers and the user's comment. Trusted
records, whose few passages mostly match fixed markers, start the positive class; all others are unlabelled and count as
content at first. The model is fitted on a bounded sample of records (SAMPLE ids, those of the smallest hashes of
all rows, with their whole bodies) and applied to all. A record is residue if no passage is clearly content (log odds
below pages.DOUBT) and all passages together, with the share of residue records as their prior, are more likely residue.

Defined cases: null, empty and blank bodies, bare comments and pages of furniture alone are no residue; notes
are not judged; a table without trusted records gives no residue; repeated rows give one result per id, and an
id with several bodies is residue if one of them is, each body keeping its own lines.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm import pages

SAMPLE = 12_000  # records the model is fitted on, at most
ROUNDS = 6
TRUSTED_LINES = 10  # passages of a trusted record, at most
MOST = 3  # times a word counts in one passage
SMOOTH = 0.1
# Marks of unfilled layout, filler, error messages and script notices.
MARKERS = re.compile(
    r"\{\{.*?\}\}|\{%.*?%\}|[$#]\{.*?\}|<%.*?%>|<\?=?.*?\?>|\[\[.*?\]\]|\[[A-Z][A-Z _]+ HERE\]|__[A-Z]+_[A-Z_]+__|<insert [^>]*>|%[A-Z_]{3,}%|@@\w+@@"
    r"|\[object Object\]|\bundefined\b|\bNaN\b|\bnull\b|lorem ipsum|dolor sit amet|^\W*(?:todo|tbd|placeholder|asdf\w*|x{3,})\b"
    r"|^\W*(?:(?:http|error)\W+(?:code\W+)?)?(?:404|403|500|502|503)\b|\b(?:404|403|500|502|503)\W+(?:error|not|bad|internal|service|forbidden|access)"
    r"|not found|bad gateway|internal server error|service unavailable|access denied|^\W*forbidden|(?:have|has|without|need) (?:\w+ )?permission"
    r"|(?:enable|activate|allow|turn on|requires?|needs?|without|disabled?)\W+(?:\w+\W+){0,2}(?:javascript|scripts?|cookies)\b"
    r"|(?:javascript|scripts?|cookies)\W+(?:is|are|must|has|have|required|needed|disabled|to)\b|\bnoscript\b|checking your browser|your browser (?:is|does|has|must)"
    r"|error code|request id|under maintenance|for maintenance|try again (?:in|later)",
    re.IGNORECASE,
)
_TOKEN = re.compile(r"\{\{|\}\}|\{%|%\}|\$\{|<%|%>|<\?|\[\[|\]\]|__|<[a-z/]+|[^\W\d_]+(?:['’][^\W\d_]+)?|\d+|[…{}<>\[\]/=_]")
_NUMBERED = re.compile(r"^\W*(?:(?:page|p\.|seite|s\.)\s*)?[\dlOI]{1,5}\W*$|^\W*[ivxlc]{1,7}\W*$|^\W*\d+\s*[/|]\s*\d+\W*$|^page [\dlO]+$", re.IGNORECASE)


def tokens(line: str) -> list[str]:
    out = []
    for k, m in enumerate(_TOKEN.finditer(line)):
        t = m.group(0)
        if t.isdigit():
            out.append("#")
        elif k and t[:1].isupper() and t[1:].islower():
            out.append("<Name>" if t.lower() not in _PLAIN else t.lower())
        else:
            out.append(t.lower())
    return out


_PLAIN = frozenset("javascript cookies page error here".split())


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)
    prior: float = 0.0  # log odds of a record

    def line(self, text: str) -> float:
        """Log odds of residue against content, of one passage by itself."""
        return sum(self.odds.get(t, 0.0) for t in tokens(text))

    def record(self, lines: list[str]) -> bool:
        if not lines or not self.odds:
            return False
        each = [self.line(x) for x in lines]
        return min(each) > pages.DOUBT and sum(each) + self.prior > 0


def split(body: str, kind: str | None, host: str, web: pages.Web, own: set[int], model: Model | None = None) -> tuple[list[str], list[str]]:
    """(label of every line of a link page, passages: lines that can be content or residue).

    Without a model, a comment that holds a marker is a passage too."""
    lines = body.split("\n")
    if kind == "link":
        labels = pages.label_lines(body, host, web, own, model.line if model else None)
        out = (pages.BLANK, pages.FURNITURE, pages.COMMENT)
        return labels, [x.strip() for x, g in zip(lines, labels) if g not in out or (not model and g == pages.COMMENT and MARKERS.search(x))]
    return [], [s for x in lines if (s := x.strip()) and not _NUMBERED.match(s)]


def trusted(lines: list[str]) -> bool:
    return 0 < len(lines) <= TRUSTED_LINES and 2 * sum(bool(MARKERS.search(x)) for x in lines) >= len(lines)


def fit(records: list[tuple[bool, list[list[str]]]], rounds: int = ROUNDS) -> Model:
    """From (trusted, tokens of every passage) of records."""
    records = [(s, [p for p in ps if p]) for s, ps in records]
    records = [(s, ps) for s, ps in records if ps]
    sure = np.array([s for s, _ in records], bool)
    if not sure.any():
        return Model()
    names: dict[str, int] = {}
    words, counts, passage = [], [], []
    owner = np.repeat(np.arange(len(records)), [len(ps) for _, ps in records])
    for k, p in enumerate(p for _, ps in records for p in ps):
        for t, n in Counter(p).items():
            words.append(names.setdefault(t, len(names)))
            counts.append(n)
            passage.append(k)
    words, counts, passage = np.array(words), np.array(counts, float), np.array(passage)
    capped, whose = np.minimum(counts, MOST), owner[passage]
    post = sure.astype(float)
    for _ in range(rounds):
        pos = np.bincount(words, capped * post[whose], len(names)) + SMOOTH
        neg = np.bincount(words, capped * (1 - post[whose]), len(names)) + SMOOTH
        odds = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
        prior = math.log((post.sum() + 1) / (len(post) - post.sum() + 1))
        each = np.bincount(passage, counts * odds[words], len(owner))
        least = np.full(len(records), np.inf)
        np.minimum.at(least, owner, each)
        score = np.minimum(least - pages.DOUBT, np.bincount(owner, each, len(records)) + prior)
        post = np.where(sure, 1.0, 1 / (1 + np.exp(-np.clip(score, -30, 30))))
    return Model({t: float(odds[k]) for t, k in names.items()}, prior)


def sample(items: DataFrame, web: pages.Web, size: int = SAMPLE) -> list[tuple[bool, list[list[str]]]]:
    """(trusted, tokens of every passage) of at most `size` ids, by the smallest hashes over all rows, each id once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        web = shared.value
        for b in batches:
            got = [split(body, kind, pages.host_of(url), web, set())[1] for kind, url, body in zip(*(b.column(k).to_pylist() for k in range(3)))]
            cols = [pa.array([trusted(g) for g in got], pa.bool_()), pa.array([[tokens(x) for x in g] for g in got], pa.list_(pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*cols, b.column(3)], ["sure", "tokens", "h"])

    shared = items.sparkSession.sparkContext.broadcast(web)
    rows = items.where(F.col("kind").isin("link", "pdf") & F.col("body").isNotNull()).select("kind", "url", "body", F.xxhash64("id").alias("h"))
    last = rows.select("h").distinct().orderBy("h").limit(size).agg(F.max("h")).first()[0]
    one = rows.where(F.col("h") <= F.lit(last).cast("long")).groupBy("h").agg(F.min(F.struct("kind", "url", "body")).alias("r"))
    got = one.select("r.kind", "r.url", "r.body", "h").mapInArrow(cut, "sure boolean, tokens array<array<string>>, h long")
    return [(r.sure, r.tokens) for r in sorted(got.collect(), key=lambda r: r.h)]  # of at most `size` ids


def judged(items: DataFrame, size: int = SAMPLE, texts: bool = False) -> DataFrame:
    """id, kind, residue, furniture (line numbers), text (without furniture, if asked for): each link and pdf record
    with its verdict."""
    spark = items.sparkSession
    links = pages.link_pages(items)
    web, own = pages.consensus(pages.link_rows(items), MARKERS)
    shared = spark.sparkContext.broadcast((web, fit(sample(items, web, size))))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        web, model = shared.value
        for b in batches:
            bad, lines, kept = [], [], []
            for kind, host, body, keys in zip(*(b.column(k).to_pylist() for k in range(1, 5))):
                labels, rest = split(body, kind, host, web, set(keys or ()), model)
                bad.append(model.record(rest))
                lines.append([k for k, g in enumerate(labels) if g == pages.FURNITURE])
                kept.append("\n".join(x for x, g in zip(body.split("\n"), labels) if g != pages.FURNITURE) if texts else None)
            cols = [pa.array(bad, pa.bool_()), pa.array(lines, pa.list_(pa.int32())), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["id", "kind", "residue", "furniture", "text"])

    hosted = pages.with_host(links, own).select("id", F.lit("link").alias("kind"), "host", "body", "keys")
    pdfs = items.where((F.col("kind") == "pdf") & F.col("body").isNotNull() & F.col("id").isNotNull())
    pdfs = pdfs.select(F.col("id").cast("string"), F.lit("pdf").alias("kind"), F.lit("").alias("host"), F.col("body").cast("string"), F.lit(None).cast("array<bigint>").alias("keys")).distinct()
    return hosted.unionByName(pdfs).mapInArrow(judge, "id string, kind string, residue boolean, furniture array<int>, text string")


def furniture(items: DataFrame) -> DataFrame:
    """id, line_no: lines of link pages that belong to the site."""
    return judged(items).where("kind = 'link'").select("id", F.explode("furniture").alias("line_no")).distinct()


def main_text(items: DataFrame) -> DataFrame:
    """id, text: link pages without their furniture; an id with several bodies has a row for each."""
    return judged(items, texts=True).where("kind = 'link'").select("id", "text").distinct()


def residues(items: DataFrame) -> DataFrame:
    """id of link and pdf records that hold residue only."""
    return judged(items).where("residue").select("id").distinct()


def kept(items: DataFrame) -> DataFrame:
    """Items without residue records."""
    return items.join(residues(items), "id", "left_anti")
